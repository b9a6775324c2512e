"""r17: phrases are found where they stand, not held against each text; a text is prepared once, not for each query."""

import random

from lodestack.operators import retrieval, substrings
from lodestack.plans import usage

SF = "/root/testdata/sf0.001"


def test_phrases_of_a_brand_equal_looking_at_each_text(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.choice([1, 1, 2, 3, 26])))
    texts = ["".join(word() + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(rng.randrange(15))) for _ in range(150)]
    docs = [(i, i % 3, t) for i, t in enumerate(texts)] + [(900, None, "a b"), (901, 0, None)]
    cuts = [t[i : i + n] for t in texts if t for i in (rng.randrange(len(t)),) for n in (3, 4, 5, 7, 9)]
    keys = [(q, q % 4 or None, k) for q, k in enumerate(sorted({*cuts, "a b", "ab a", " ab", "a b ", "a  b", "é a\nb", "a b_", "b %a"}))]
    hit = lambda k, t: substrings_like(k, t) if "%" in k or "_" in k else k in t
    want = {(q, b, i) for q, b, k in keys for i, own, t in docs if b == own and b is not None and t is not None and k and hit(k, t)}
    kw = spark.createDataFrame(keys, "query long, brand int, keyword string")
    rows = spark.createDataFrame(docs, "doc_id long, brand int, text string").repartition(3)
    for size in (0, substrings.AT_ONCE + 1):  # by a broadcast, and by a shuffle
        monkeypatch.setattr(substrings, "in_memory", lambda df, *texts, size=size: size if "two" in df.columns else 0)
        got = retrieval.keyword_candidates(kw, rows, "query", within=("brand",)).select("query", "brand", "doc_id").collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 300


def substrings_like(k, t):
    import re

    return re.search("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in k), t, re.S) is not None


def test_phrases_are_not_held_against_texts(spark, monkeypatch):
    held = []
    real = substrings.some_hits
    monkeypatch.setattr(substrings, "some_hits", lambda keywords, *rest: held.extend(r["keyword"] for r in keywords.collect()) or real(keywords, *rest))
    docs = spark.createDataFrame([(i, f"the pump {i} of the drive") for i in range(20)], "doc_id long, text string")
    keys = spark.createDataFrame([("the pump",), ("of the drive",), ("pump",), ("the_pump",), ("he pump 1",)], "keyword string")
    got = {tuple(r) for r in substrings.keyword_hits(keys, docs, "text").collect()}
    assert held and set(held) == {"pump", "the_pump"}
    assert got == {(i, k) for i in range(20) for k in ("the pump", "of the drive", "pump", "the_pump")} | {(i, "he pump 1") for i in (1, *range(10, 20))}


def test_a_text_is_prepared_below_the_join(spark):
    chunks = usage.chunk_rows(spark, SF)
    plan = retrieval.hybrid_search(usage.as_queries(chunks), chunks)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    prepares = r"[^\p{L}\p{N}_]+"  # as words are told apart
    assert prepares in below and prepares not in above
