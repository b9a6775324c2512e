"""Registered queries without SQL against plain Python over the same rows."""

import random
import re
import zlib
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import vocab
from lodestack.plans import corpus, text, usage

SF = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def conversations(spark):
    out = {}
    for c, turn, role, x in sorted(rows(spark, "conversations", "conv_id", "turn", "role", "text"), key=lambda r: r[:2]):
        out.setdefault(c, []).append((turn, role, x or ""))
    return out


def test_v3_rounds(spark):
    """From the end: questions of the assistant count and skip the user before them, an answer ends the count."""
    want = {}
    for c, turns in conversations(spark).items():
        turns = [(r, x + "?" if r == "assistant" and c % 2 == 0 else x) for _, r, x in turns]
        i, n = len(turns) - 1, 0
        while i >= 0:
            role, x = turns[i]
            if role == "assistant":
                if "?" not in x:
                    break
                n += 1
                i -= 1
            i -= 1
        want[c] = n
    assert {r["conv_id"]: r["rounds"] for r in usage.QUERIES["v3_clarification_rounds"](spark, SF).collect()} == want


def test_v6_enriched_query(spark):
    want = {}
    for c, turns in conversations(spark).items():
        said, seen, out = [x for _, _, x in turns], set(), []
        for w in " ".join(said).split():
            if len(w) > 1 and w.lower() not in seen:
                seen.add(w.lower())
                out.append(w)
        want[c] = " ".join(out) if len(said) > 2 else said[-1]
    assert {r["conv_id"]: r["query"] for r in usage.QUERIES["v6_enriched_query"](spark, SF).collect()} == want


def test_m9_quota_with_refunds(spark):
    """A refund gives a use back in the window it falls in and never opens one; what was used stays counted."""
    want, by = {}, {}
    for e, u, ts in rows(spark, "events", "event_id", "user_id", "ts"):
        by.setdefault(u, []).append((ts, e))
    for u, events in by.items():
        limit = u % 4 * 2 if u % 4 else None
        start, used, total, blocked, windows = None, 0, 0, 0, 0
        for ts, e in sorted(events):
            inside = start is not None and ts < start + timedelta(hours=24)
            if e % 6 == 0:
                used -= inside and used > 0
                continue
            if not inside:
                start, used, windows = ts, 0, windows + 1
            if limit is None or used < limit:
                used, total = used + 1, total + 1
            else:
                blocked += 1
        want[u] = (windows, total, blocked)
    got = {r["user_id"]: (r["windows"], r["used"], r["blocked"]) for r in usage.QUERIES["m9_quota_refunds"](spark, SF).collect()}
    assert got == want


def plain_keywords(s):
    words = [re.sub("[().,;:!?]", "", w) for w in (s or "").split()]
    out = []
    for w in words:
        if len(w) >= 2:
            if re.match("[A-Za-z]+[0-9]|[0-9]+[A-Za-z]", w) or re.fullmatch("[A-Z]{3,}", w):
                out.append(w)
            elif re.match(r"[A-Za-z]?\.?[0-9]+\.[0-9]", w):
                out += [w, w.replace(".", "")]
    for a, b in zip(words, words[1:]):
        if re.fullmatch("[A-Za-z]{1,5}", a) and re.fullmatch("[0-9]{2,5}", b):
            out += [f"{a} {b}", a + b]
        elif re.fullmatch("[A-Za-z]{2,5}", a) and re.fullmatch("[A-Za-z0-9]{2,}", b) and a.upper() not in vocab.PHRASE_STOP_WORDS:
            out.append(f"{a} {b}")
    for a, b, c in zip(words, words[1:], words[2:]):
        if re.fullmatch("[A-Za-z]{2,5}", a) and b and c and a.upper() not in vocab.PHRASE_STOP_WORDS:
            out.append(f"{a} {b} {c}")
    kept, seen = [], set()
    for k in out:
        if len(k) >= 2 and k.lower() not in seen:
            seen.add(k.lower())
            kept.append(k)
    return kept


def test_t6_keywords_and_t9_identifiers(spark):
    said = {(c, t): x for c, turns in conversations(spark).items() for t, _, x in turns}
    got = {(r["conv_id"], r["turn"]): r["keywords"] for r in text.QUERIES["t6_search_keywords"](spark, SF).collect()}
    assert got == {k: "|".join(plain_keywords(x)) for k, x in said.items()}
    got = {(r["conv_id"], r["turn"]): r["identifiers"] for r in text.QUERIES["t9_query_identifiers"](spark, SF).collect()}
    for k, x in said.items():
        bare = [re.sub("[^A-Za-z0-9]", "", w).upper() for w in plain_keywords(x)]
        versions = [re.sub("[^A-Za-z0-9]", "", m).upper() for m in re.findall(vocab.VERSION, x.upper())]
        assert got[k] == "|".join(list(dict.fromkeys([w for w in bare if len(w) >= 3] + versions))[:24])


def test_r8_keyword_vectors(spark):
    """Each query's first three keywords against all chunks of its brand, by the same stand-in for an embedding."""
    got = {(r["query_id"], r["chunk_id"]): r["similarity"] for r in usage.QUERIES["r8_multi_query"](spark, SF).collect()}
    chunks = usage.chunk_rows(spark, SF).where("text IS NOT NULL").select("chunk_id", "brand", "text").collect()

    def vector(text):
        v = np.zeros(usage.DIMENSION)
        for w in text.lower().split() or [None]:
            h = zlib.crc32(w.encode()) if w else 0
            v[h % usage.DIMENSION] += -1 if h >= 1 << 31 else 1
        return v

    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    own = {r["chunk_id"]: unit(vector(r["text"])) for r in chunks}
    want = {}
    for q in usage.query_rows(spark, SF).collect():
        for k in [k for k in plain_keywords(q["text"])[:3] if len(k) >= 2]:
            v = unit(vector(k))
            near = sorted(((-round(float(v @ own[r["chunk_id"]]), 12), r["chunk_id"]) for r in chunks if r["brand"] == q["brand"] and round(float(v @ own[r["chunk_id"]]), 12) >= 0.2))[:20]
            for s, c in near:
                want.setdefault((q["query_id"], c), -s)
    assert want and set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_c6_records_follow_c5_chunks(spark):
    records = corpus.QUERIES["c6_chunk_records"](spark, SF).collect()
    assert len({r["id"] for r in records}) == len(records) > 0


def test_s2_lists_the_folder(spark):
    import os

    got = {(r["path"], r["size"]) for r in corpus.QUERIES["s2_file_inventory"](spark, SF).collect()}
    assert got == {(n, os.path.getsize(f"{SF}/{n}")) for n in os.listdir(SF) if n.endswith(".parquet")}


def test_st2_stream_gives_the_batch_chunks(spark):
    from lodestack.operators.chunking import chunk_records

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("page", F.lit(1))
    want = chunk_records(docs, "source", "doc_id", "lang", "page").select("brand_slug", "doc_id", "chunk_index", "chunk_total", F.md5("text").alias("h"))
    got = usage.QUERIES["st2_stream_ingest"](spark, SF)
    key = lambda df: sorted(map(tuple, df.where("brand_slug IS NOT NULL").collect()), key=str)
    assert key(got.where("brand_slug <> '__HIVE_DEFAULT_PARTITION__'")) == key(want)


def test_r12_signal_bonus(spark):
    """Signals of a text that stand in its own text: topics by name, codes in capitals."""
    from lodestack.functions import text as t

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", t.domain_signals("text").alias("s"), t.normalize_for_matching("text").alias("n")).collect()
    got = {r["doc_id"]: r["bonus"] for r in usage.QUERIES["r12_signal_bonus"](spark, SF).collect()}
    for r in docs:
        if r["text"] is not None:
            up = r["text"].upper()
            n = sum(x in r["n"] for x in r["s"]["topics"]) * 0.04 + sum(x in up for x in r["s"]["controller_tokens"]) * 0.07 + sum(x in up for x in r["s"]["fault_tokens"]) * 0.06
            assert got[r["doc_id"]] == pytest.approx(min(0.26, n), abs=1e-6)


def test_random_chunks_keep_the_first_of_equal_keys(spark):
    from lodestack.operators.chunking import first_of_each

    rng = random.Random(2)
    lists = [[rng.choice(["a b", "A  b", "c", " c ", "d", "e"]) for _ in range(rng.randrange(12))] for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, l array<string>")
    for limit in (None, 3):
        got = {r["i"]: r["k"] for r in df.select("i", first_of_each(F.col("l"), limit).alias("k")).collect()}
        for i, x in enumerate(lists):
            first = {}
            for c in x:
                first.setdefault(" ".join(c.split()).lower(), c)
            assert got[i] == list(first.values())[:limit]
