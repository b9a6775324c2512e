"""Keywords and name tokens by index against looking at every pair."""

import random
import re

from pyspark.sql import functions as F

from lodestack.operators import retrieval, substrings


def like(text, keyword):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in keyword)
    return re.search(pattern, text, re.S) is not None


def test_keywords_by_index(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3, 5, 30, 70])))
    texts = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(120)] + ["", "A\tB\nc", "100% sure_thing", "back\\slash", "x" * 5000 + "ABC" + "y" * 100, None]
    rows = [(i, f"s{i % 3}", t) for i, t in enumerate(texts)]
    cuts = [t[i : i + n] for t in texts[:120] if t for i in (rng.randrange(len(t)),) for n in (1, 2, 3, 8, 26, 40)]
    keys = {*cuts, "%", "__", "_" * 40, "a%c", "b_a", "100%", "sure_thing", "back\\slash", "xabcy", " ", "a b", "zzz", "é%é", "\t", "nowhere at all", "a_", "%a%"}
    asked = [(i % 7, k.lower()) for i, k in enumerate(sorted(keys))]
    want = {(q, i) for q, k in asked for i, _, t in rows if t is not None and k and like(t.lower(), k)}
    kw = spark.createDataFrame([*asked, (1, ""), (2, None)], "query long, keyword string")
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = retrieval.keyword_candidates(kw, docs, "query")
    assert got.columns == ["doc_id", "source", "query"] and sorted((r["query"], r["doc_id"]) for r in got.collect()) == sorted(want)
    one = spark.createDataFrame([(1, "É a"), (2, "A é")], "doc_id long, text string")
    hits = retrieval.keyword_candidates(spark.createDataFrame([(1, "é"), (2, "a")], "query long, keyword string"), one, "query", fold=substrings.ascii_lower)
    assert sorted((r["query"], r["doc_id"]) for r in hits.collect()) == [(1, 2), (2, 1), (2, 2)]


def test_a_hundred_thousand_keywords(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat_ws(' ', 'unit', hex(id * 7919), 'and', hex(id * 104729 + 13)) AS text")
    keys = spark.range(100_000).selectExpr("id % 100 AS query", "lower(concat('unit ', hex(id * 7919))) AS keyword")
    monkeypatch.setattr(substrings, "AT_ONCE", 1 << 16)  # several scans give the same
    got = {(r["query"], r["doc_id"]) for r in retrieval.keyword_candidates(keys, docs, "query").collect()}
    texts = [(i, f"unit {i * 7919:x} and {i * 104729 + 13:x}") for i in range(2000)]
    # A keyword is a text's beginning up to any of its digits.
    known = {f"unit {k * 7919:x}": k for k in range(100_000)}
    want = {(known[t[:n]] % 100, i) for i, t in texts for n in range(6, len(t) + 1) if t[:n] in known}
    assert got == want


def test_names_by_index(spark):
    rng = random.Random(4)
    parts = ["pump", "gen2", "board", "x9", "main", "drive", "ab", "manual", "controller-unit", "p" * 30]
    names = [(i % 2, i, "common " + rng.choice([" ", "_", ""]).join(rng.sample(parts, 3)) + ".pdf") for i in range(300)]
    queries = [(i, i % 2, " ".join(["common", *rng.sample(parts, rng.randrange(4)), *(["gen2"] * (i % 3))])) for i in range(40)] + [(99, 0, ""), (98, 0, None)]
    q = spark.createDataFrame(queries, "query_id long, brand int, text string")
    n = spark.createDataFrame(names, "brand int, doc_id long, name string")
    every = n.join(q.select("query_id", "brand", F.col("text").alias("q")), "brand").select("query_id", "doc_id", F.round(retrieval.filename_bonus("name", "q"), 6).alias("bonus"))
    for least in (0.05, 0.15, 0.2, 0.25):
        want = sorted(map(tuple, every.where(F.col("bonus") >= least).collect()))
        assert want and sorted(map(tuple, retrieval.filename_candidates(q, n, least).collect())) == want
    # "common" is in every name: alone it makes no pairs for queries that need two tokens.
    tokens = spark.createDataFrame([(1, 0, "common", 1), (1, 0, "drive", 1), (2, 0, "common", 1)], "query_id long, brand int, token string, times long")
    squeezed = n.select("brand", "doc_id", F.regexp_replace("name", r"[ _.-]", "").alias("name"))
    pairs = [tuple(r) for r in substrings.names_with_tokens(tokens, squeezed, 2).collect()]
    holding = {i for b, i, x in names if b == 0 and "drive" in x}
    assert len(pairs) == len(holding) and set(pairs) == {(1, i) for i in holding}
