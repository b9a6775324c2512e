"""The hybrid search of r17 against plain Python: phases, bonuses, order."""

import zlib

import numpy as np
import pytest
import regex

from lodestack.functions import vocab
from lodestack.plans import usage

from .test_plain_chunks import folded, signals_of
from .test_queries import plain_keywords

SF = "/root/testdata/sf0.001"


def unit(v):
    v = np.array(v, float)
    return v / np.linalg.norm(v) if v.any() else v


def hashed(text):
    v = np.zeros(usage.DIMENSION)
    for w in text.lower().split() or [None]:
        h = zlib.crc32(w.encode()) if w else 0
        v[h % usage.DIMENSION] += -1 if h >= 1 << 31 else 1
    return unit(v)


def matching(x):
    return regex.sub(" +", " ", regex.sub("[^a-z0-9 ]", "", regex.sub(r"[.\-_/\\]", " ", folded(x.lower())))).strip(" ")


def versions(x):
    return list(dict.fromkeys(m.replace(" ", "") for m in regex.findall(vocab.VERSION, folded(x).upper(), regex.A)))


def name_bonus(name, query):
    words = [w for w in matching(query).split(" ") if len(w) >= 2 and w not in vocab.STOP_WORDS]
    name = matching(name)
    n = sum(w in name or w in name.replace(" ", "") for w in words)
    return min(0.25, n * 0.08 + (0.05 if n >= 2 else 0))


def bonuses(text, name, query):
    up, low = text.upper(), text.lower()
    bare = lambda x: regex.sub(r"[.\s\-]", "", x, flags=regex.A)
    words = set(regex.split(r"[^\p{L}\p{N}_]+", up))
    lexical = min(0.24, sum(0.08 if w in words else 0.04 if w in up else 0 for w in signals_of(query)[2]))
    keys = min(0.25, sum(0.10 if k.lower() in low else 0.06 if len(bare(k)) >= 3 and bare(k).lower() in bare(low) else 0 for k in plain_keywords(query)))
    topics, controls, faults = signals_of(text)
    q = matching(query)
    signal = min(0.26, 0.04 * sum(x in q for x in topics) + 0.07 * sum(x in query.upper() for x in controls) + 0.06 * sum(x in query.upper() for x in faults))
    codes = lambda x: regex.sub("[^A-Z0-9]", "", x.upper())
    ids = list(dict.fromkeys([c for c in map(codes, plain_keywords(query)) if len(c) >= 3] + [codes(v) for v in versions(query)]))[:24]
    whole, known = codes(f"{text} {name}"), {codes(x) for x in controls + faults + versions(text[:6000])[:20]}
    hits = sum(i in whole or i in known for i in ids)
    ident = 0 if not ids else min(0.24, 0.06 + 0.03 * hits) if hits else -0.10
    return lexical + name_bonus(name, query) + keys + signal + ident, hits > 0


def plain_search(queries, chunks, top_k=7):
    names = {}
    for c in sorted(chunks, key=lambda c: c["chunk_id"]):
        if c["doc_id"]:
            names.setdefault(c["doc_id"], c["name"])
    out = {}
    for q in queries:
        own = [c for c in chunks if c["brand"] == q["brand"]]
        sim = {c["chunk_id"]: round(float(unit(q["vector"]) @ unit(c["vector"])), 12) for c in own}
        best = lambda cs, s, n, least: sorted((c for c in cs if s[c["chunk_id"]] >= least), key=lambda c: (-s[c["chunk_id"]], c["chunk_id"]))[:n]
        found = {c["chunk_id"]: sim[c["chunk_id"]] for c in best(own, sim, max(10 * top_k, 100), 0.3)}
        met = {c["doc_id"] for c in own if c["chunk_id"] in found}
        docs = {c["doc_id"] for c in own}
        wanted = {d for d in docs if d in names and round(name_bonus(names[d], q["text"]), 6) >= 0.15}
        words = [k.lower() for k in plain_keywords(q["text"])]
        wanted |= {c["doc_id"] for c in own if any(k in f"{c['text']} {c['name']}".lower() for k in words)}
        for d in wanted - met:
            for c in best([c for c in own if c["doc_id"] == d], sim, 4, 0.1):
                found.setdefault(c["chunk_id"], sim[c["chunk_id"]])
        for k in [k for k in plain_keywords(q["text"])[:3] if len(k) >= 2]:
            far = {c["chunk_id"]: round(float(hashed(k) @ hashed(c["text"])), 12) for c in own}
            for c in best(own, far, 20, 0.2):
                found.setdefault(c["chunk_id"], far[c["chunk_id"]])
        rows = []
        for c in own:
            if c["chunk_id"] in found:
                extra, hit = bonuses(c["text"], c["name"], q["text"])
                rows.append({"chunk": c["chunk_id"], "doc": c["doc_id"], "score": round(found[c["chunk_id"]] + extra, 6), "hit": hit})
        lead = sum(r["hit"] for r in rows) >= max(2, top_k // 2)
        rows.sort(key=lambda r: (-(r["hit"] and lead), -r["score"], r["chunk"]))
        few, rest = [], []
        for r in rows:
            (few if sum(x["doc"] == r["doc"] for x in few) < 3 else rest).append(r)
        out[q["query_id"]] = (few[:top_k] + rest)[:top_k] if len(few) < top_k else few[:top_k]
    return out


def test_r17_equals_plain_search(spark):
    chunks = [r.asDict() for r in usage.chunk_rows(spark, SF).collect()]
    queries = [r.asDict() for r in usage.query_rows(spark, SF).collect()]
    assert all(c["text"] is not None for c in chunks)
    want = {q: [(r["chunk"], r["doc"], r["hit"]) for r in rows] for q, rows in plain_search(queries, chunks).items() if rows}
    scores = {(q, r["chunk"]): r["score"] for q, rows in plain_search(queries, chunks).items() for r in rows}
    got = {}
    for r in usage.QUERIES["r17_hybrid_search"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["doc_id"], r["hit"]))
        assert r["score"] == pytest.approx(scores[r["query_id"], r["chunk_id"]], abs=1e-5)
    assert got == want and sum(map(len, got.values())) > 5
