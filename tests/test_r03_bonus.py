"""Texts, names and queries are prepared once, not once for each token, identifier or pair."""

from lodestack.functions import text as t
from lodestack.operators import retrieval as r
from lodestack.plans import text, usage

from .test_queries import plain_keywords

SF = "/root/testdata/sf0.001"
plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()


def test_r13_no_search_for_each_keyword(spark):
    df = spark.createDataFrame([("UV AB12 uv ab12 Ab12 gen 2 x9", "n"), ("", "n"), (None, "n")], "text string, name string")
    assert [x[0] for x in df.select(t.search_keywords("text")).collect()][:2] == [plain_keywords("UV AB12 uv ab12 Ab12 gen 2 x9"), []]
    assert "array_position" not in plan(usage.QUERIES["r13_identifier_bonus"](spark, SF))


def test_t13_compact_form_once(spark):
    assert plan(text.QUERIES["t13_expand_whole_text"](spark, SF)).count("translate(") == 1


def test_r4_and_r5_prepare_names_before_pairs(spark):
    for name in ("r4_filename_bonus", "r5_filename_candidates"):
        above = plan(usage.QUERIES[name](spark, SF)).split("Join ")[0]
        assert "translate(" not in above and "tokens" in above


def test_pairs_of_many_queries_are_dealt(spark, monkeypatch):
    names = spark.createDataFrame([(i, i % 2, f"pump {i} manual") for i in range(30)], "doc_id long, brand int, name string")
    q = spark.createDataFrame([(7, 0, "pump manual"), (8, 1, "12 pump"), (9, None, "pump")], "query_id long, brand int, text string")
    want = {tuple(x) for x in r.name_bonuses(q, names, "doc_id").collect()}
    monkeypatch.setattr(r, "few", lambda df: df)
    assert {tuple(x) for x in r.name_bonuses(q, names, "doc_id").collect()} == want and len(want) == 30
