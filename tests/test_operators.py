"""Operators on small tables: borders, ties, empties, idempotence."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.operators import audit, chunking, conversations, evaluation, metrics, retrieval
from lodestack.sources import tables


def chunks(spark, text, **kw):
    return chunking.build_chunks(spark.createDataFrame([(text,)], "text string"), **kw).first()["chunks"]


def test_short_and_empty_pages(spark):
    assert chunks(spark, None) == [] and chunks(spark, "  ") == []
    assert chunks(spark, " a \n b ") == ["a \n b"]
    assert chunks(spark, "x" * 2001) == ["x" * 2001]


def test_table_rows_join_their_continuations(spark):
    table = "| E01 | first failure of the main door | check |\n|---|---|---|\n| | and the lock of the door as well | check |\n| E02 | second failure of the main door | check |\n"
    got = chunks(spark, table + "filler words go on and on here\n" * 80)
    assert got[0] == "| E01 | first failure of the main door | check |\n| E01 [continuação] | and the lock of the door as well | check"
    assert any(c.startswith("| E02 |") for c in got)


def test_broad_windows_cover_all_lines(spark):
    for n in (1, 9, 10, 35, 36, 100):
        lines = [f"line number {i} with some words to be long" for i in range(n)]
        df = spark.createDataFrame([(lines,)], "l array<string>").select(chunking.broad_windows(F.col("l")).alias("w"))
        seen = {x for w in df.first()["w"] for x in w.split("\n")}
        assert seen == set(lines) or n < 3


def test_chunk_ids_are_stable_and_dense(spark):
    pages = spark.createDataFrame([("b", 1, "n", 1, "\n".join(f"erro e{i:03d} on this line here and there" for i in range(90)))], "brand string, doc long, name string, page int, text string")
    a, b = (chunking.chunk_records(pages, "brand", "doc", "name", "page", max_chunks=None) for _ in range(2))
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())
    assert sorted(r["chunk_index"] for r in a.collect()) == list(range(a.count()))


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y")], "brand_slug string, doc_id long, page_number int, text string")
    new = spark.createDataFrame([("a", 1, 1, "z")], old.schema)
    once = tables.upsert_chunks(old, new)
    assert sorted(map(tuple, tables.upsert_chunks(once, new).collect())) == sorted(map(tuple, once.collect())) == [("a", 1, 1, "z"), ("a", 1, 2, "y")]


def test_similar_names_match_brute_force(spark):
    names = ["abc", "abcdef", "xabcdefx", "ab", "zz", "ABC ", "", None, "abcdef"]
    docs = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    clean = [(i, n.strip().lower()) for i, n in enumerate(names) if n and n.strip()]
    want = {(min(i, j), max(i, j)) for i, a in clean for j, b in clean if a != b and a in b}
    assert {tuple(r) for r in audit.similar_names(docs, "id", "name").collect()} == want


def test_near_duplicate_groups(spark):
    rows = [(1, "Manual of gear two.pdf"), (2, "the manual of gear two revised.pdf"), (3, "MANUAL OF GEAR TWO"), (4, "gear two"), (5, "one two six"), (6, "one two ten"), (7, "")]
    got = {r["id"]: r["group"] for r in audit.near_duplicate_groups(spark.createDataFrame(rows, "id long, name string"), "id", "name").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_unique_slugs_move_on(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x 2")], "id long, name string")
    assert len({r["slug"] for r in audit.unique_slugs(rows, "id", "name").collect()}) == 3


def test_quota_borders(spark):
    t0 = datetime(2024, 1, 1)
    uses = [(1, 1, t0), (2, 1, t0 + timedelta(hours=1)), (3, 1, t0 + timedelta(hours=24)), (4, 2, t0), (5, 3, t0)]
    events = spark.createDataFrame(uses, "event_id long, user_id long, ts timestamp")
    limits = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "user_id long, daily_limit int")
    got = {r["user_id"]: (r["windows"], r["used"], r["blocked"]) for r in metrics.quota_windows(events, limits).collect()}
    assert got == {1: (2, 2, 1), 2: (1, 0, 1), 3: (1, 1, 0)}


def test_bucket_borders_count_twice(spark):
    now = "2024-01-31 00:00:00"
    events = spark.createDataFrame([(datetime(2024, 1, 30),), (datetime(2024, 1, 24),), (datetime(2024, 1, 31),)], "ts timestamp")
    got = {r["bucket"]: r["n"] for r in metrics.bucket_series(events, now, "week").collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 2}


@pytest.mark.parametrize(("turns", "rounds"), [([], 0), ([("user", "a")], 0), ([("user", "a"), ("assistant", "which?")], 1), ([("assistant", "which?"), ("user", "b"), ("assistant", "what?"), ("user", "c")], 2), ([("assistant", "which?"), ("user", "b"), ("assistant", "so."), ("user", "c")], 0)])
def test_clarification_rounds(spark, turns, rounds):
    df = spark.createDataFrame([([(i, r, x) for i, (r, x) in enumerate(turns)],)], "m array<struct<turn: long, role: string, text: string>>")
    assert df.select(conversations.clarification_rounds(F.col("m"))).first()[0] == rounds


def test_diversify_fills_up(spark):
    rows = spark.createDataFrame([(1, i, 1 if i < 9 else 2, 1.0 - i / 100, 0) for i in range(10)], "query_id long, chunk_id long, doc_id long, score double, lead int")
    got = [r["chunk_id"] for r in retrieval.diversify(rows, 7).orderBy("rank").collect()]
    assert got == [0, 1, 2, 9, 3, 4, 5]


def test_identifier_first_needs_enough_hits(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True), (2, 2, True), (2, 3, True)], "query_id long, chunk_id long, hit boolean")
    got = {(r["query_id"], r["chunk_id"]): r["lead"] for r in retrieval.identifier_first(rows, 7).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (2, 1): 1, (2, 2): 1, (2, 3): 1}


def test_cosine_topk_edges(spark):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "b", [1.0, 0.0])], "query_id long, brand string, vector array<float>")
    c = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "a", None), (4, "b", [0.0, 1.0])], "chunk_id long, brand string, vector array<float>")
    assert [(r["query_id"], r["chunk_id"]) for r in retrieval.cosine_topk(q, c, 5, 0.3).orderBy("rank").collect()] == [(1, 1), (1, 2)]


def test_rerank_repairs_cut_answers(spark):
    rows = spark.createDataFrame([(q, i + 1) for q in (1, 2) for i in range(10)], "query_id long, rank int")
    answers = spark.createDataFrame([(1, '```json\n[{"index": 3, "score": 9}, {"index": 0, "score": 6}, {"ind'), (2, '[{"index": 1, "score": 2}]')], "query_id long, answer string")
    got = retrieval.apply_rerank(rows, answers).orderBy("query_id", "final_rank").collect()
    assert [r["rank"] for r in got if r["query_id"] == 1] == [4, 1]
    assert [r["rank"] for r in got if r["query_id"] == 2] == [1, 2, 3, 4, 5, 6, 7]


def test_answers_are_classified(spark):
    kind = evaluation.classify_answer(F.col("x"), F.col("n"))
    rows = [("Here it is.", 1), ("Poderia informar a placa.", 3), ("Is it that one?", 0), ("See page 1. Qual modelo?", 2), ("Qual modelo? See page 1.", 2), ("See it. Which one?", 2), (None, 0), ("Qual placa?", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, n int")
    assert [r["k"] for r in df.select("i", kind.alias("k")).orderBy("i").collect()] == ["ANSWER", "CLARIFY", "CLARIFY", "CLARIFY", "ANSWER", "ANSWER", "ANSWER", "ANSWER"]


def test_grades(spark):
    schema = "id int, category string, expected string, docs array<string>, terms array<string>, forbidden array<string>"
    cases = [(1, "c", "CLARIFY", None, None, None), (2, "c", "ANSWER", None, ["Gear"], None), (3, "c", "ANSWER", None, ["x"], None), (4, "c", "ANSWER", ["Man"], None, None), (5, "c", "ANSWER", ["zz"], None, None), (6, "c", "ANSWER", ["zz"], None, None), (7, "c", "DISAMBIGUATE", None, None, ["BAD"]), (8, "c", "DISAMBIGUATE", None, None, None), (9, "c", "ANSWER", None, None, None)]
    answers = [(1, "ANSWER", "so", [], False), (2, "CLARIFY", "which gear?", [], False), (3, "CLARIFY", "which?", [], False), (4, "ANSWER", "so", ["a MANUAL.pdf"], False), (5, "ANSWER", "so", ["a"], False), (6, "CLARIFY", "so", ["a"], True), (7, "ANSWER", "bad", [], False), (8, "ANSWER", "so", [], False)]
    out = evaluation.grade_answers(spark.createDataFrame(cases, schema), spark.createDataFrame(answers, "id int, kind string, text string, sources array<string>, flagged boolean"))
    assert {r["id"]: r["grade"] for r in out.collect()} == {1: "fail", 2: "pass", 3: "fail", 4: "pass", 5: "partial", 6: "fail", 7: "fail", 8: "pass", 9: "error"}


def test_known_context(spark):
    rows = ["Erro E123 na GEN 2, placa ii", "codigo 77 e falha 88: não fecha, JAA30171AAA", "o Inversor de 1999", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    models, boards = ((r"\b(gen\s?2)\b", "Gen2"), (r"\b(gen\s?\d)\b", None)), ((r"\b(placa\s?[a-z]+)\b", None),)
    drives = ((r"\b(inversor)\b", "DRIVE"),)
    got = [r.asDict() for r in df.select("i", *conversations.known_context(F.col("x"), models, boards, drives)).orderBy("i").collect()]
    assert (got[0]["model"], got[0]["board"], got[0]["error_code"], got[0]["symptom"]) == ("Gen2", "PLACAII", "E123", None)
    assert (got[1]["error_code"], got[1]["symptom"], got[1]["part_number"]) == ("77", "nao fecha", "JAA30171AAA")
    assert got[2]["drive"] == "DRIVE" and got[2]["error_code"] is None and set(list(got[3].values())[1:]) == {None}


def test_asked_before(spark):
    # The assistant's last message counts wherever it stands, with two messages before or more.
    rows = [(1, 1, "assistant", "Which one?"), (1, 2, "user", "that"), (1, 3, "user", "yes"), (2, 1, "user", "a"), (2, 2, "assistant", "Which?"), (2, 3, "user", "b"), (2, 4, "assistant", "Here."), (2, 5, "user", "c"), (3, 1, "user", "x"), (3, 2, "user", "y"), (3, 3, "assistant", None), (3, 4, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    got = {(r["conv_id"], r["turn"]): r["asked"] for r in df.withColumn("asked", conversations.asked_before("role", F.col("text"), w)).where("role = 'user'").collect()}
    assert got == {(1, 2): False, (1, 3): True, (2, 1): False, (2, 3): True, (2, 5): False, (3, 1): False, (3, 2): False, (3, 4): False}


def test_members_of_a_hot_name(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'Hot' WHEN id < 5 THEN 'HOT' WHEN id < 9 THEN NULL ELSE concat('n', id) END AS name", "CASE WHEN id % 2 = 0 THEN 'b' END AS brand")
    got = {r["id"]: (r["name"], r["brand"], r["n"], r["first"]) for r in audit.duplicate_members(df, "id", "name", "brand").collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault((r["name"].lower() if r["name"] else None, r["brand"]), []).append(r["id"])
    assert got == {i: (*k, len(ids), min(ids)) for k, ids in groups.items() if len(ids) > 1 for i in ids}


def test_needs_clarification(spark):
    rows = [("a b", False), ("a b", True), ("we need troubleshooting now please", False), ("diversas falhas na porta hoje", False), ("manual geral de portas", False), ("um manual geral de portas", False), ("tell me about the weather", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, asked boolean")
    assert [r["y"] for r in df.select("i", conversations.needs_clarification(F.col("x"), F.col("asked")).alias("y")).orderBy("i").collect()] == [True, False, True, True, True, False, False]
    rows = [("a porta não abre", False), ("a porta não abre", True), ("a porta GEN2 não abre", False), ("porta ruim", False), ("tell me about it", False), ("a reconfigurar tudo", False), ("a configuração de tudo", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, told boolean")
    assert [r["y"] for r in df.select("i", conversations.needs_model(F.col("x"), F.col("told")).alias("y")).orderBy("i").collect()] == [True, False, False, False, False, False, True]


def test_multi_query(spark):
    """The first three keywords of two characters or more, each with its own vector."""
    from lodestack.functions import text as t

    seen = []
    vectors = {"ab1": [1.0, 0.0], "cd2": [0.0, 1.0], "ef3": [0.6, 0.8], "gh4": [-1.0, 0.0]}
    q = spark.createDataFrame([(5, "b", "AB1 CD2 EF3 GH4")], "query_id long, brand string, text string")
    first = [k.lower() for k in q.select(t.search_keywords("text").alias("k")).first()["k"][:3]]
    c = spark.createDataFrame([(1, "b", [1.0, 0.0]), (2, "b", [-1.0, 0.0]), (3, "x", [1.0, 0.0]), (4, "b", [0.5, 0.5])], "chunk_id long, brand string, vector array<float>")
    out = retrieval.multi_query(q, c, lambda texts: texts.map(lambda x: vectors[x.lower()]), 2)
    assert first == ["ab1", "cd2", "ef3"] and not seen
    got = {(r["query_id"], r["chunk_id"]): round(r["similarity"], 3) for r in out.collect()}
    assert got == {(5, 1): 1.0, (5, 4): 0.707}


def test_merge_pending(spark):
    log = spark.createDataFrame([(1, 1, "upsert"), (1, 2, "delete"), (2, 1, "delete"), (2, 2, "upsert")], "id long, seq long, op string")
    assert [tuple(r) for r in conversations.merge_pending(log).collect()] == [(2, 2, "upsert")]


def test_queries_read_behind_the_cut(spark, tmp_path):
    """Themes, identifiers and names that only stand behind the first 200 or 13 characters."""
    from lodestack.plans import corpus, text, usage

    filler = "plain words only " * 20
    lines = ["a quite long first line \U0001f600 of one document", "first line \U0001f600 of one", "line \U0001f600", "second first line", "x" * 3000, "x" * 40]
    texts = [*(f"{x}\n{filler}" for x in lines), f"{filler} error LCB2 LCB2"]
    spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["q"] for r in text.QUERIES["t13_expand_whole_text"](spark, str(tmp_path)).collect()}
    assert got[6] == f"{texts[6]} fault failure" and got[0] == texts[0]
    hits = {r["doc_id"]: r["hit"] for r in usage.QUERIES["r13_identifier_bonus"](spark, str(tmp_path)).collect()}
    assert hits[6]
    names = {i: x.split("\n")[0].strip(" ") for i, x in enumerate(texts)}
    want = {(min(i, j), max(i, j)) for i, a in names.items() for j, b in names.items() if a != b and a in b}
    assert {tuple(r) for r in corpus.QUERIES["d2_similar_first_lines"](spark, str(tmp_path)).collect()} == want >= {(0, 1), (0, 2), (1, 2), (4, 5)}
