"""The toxicity query against forward and backward passes in plain Python, word by word, and what it learns from."""

import math
import re
import zlib

import pytest

from lodestack.llm import toxicity
from lodestack.llm.common import table

SF = "/root/testdata/sf0.001"


def marginals(model, words):
    """Of state 1 for each word, by sums over the two states in turn."""
    f = [toxicity.features(w) for w in words]
    e = [model.bias + sum(model.w[b] for b in x[0]) + (model.w[f[i - 1][1]] if i else 0) + (model.w[f[i + 1][2]] if i + 1 < len(f) else 0) for i, x in enumerate(f)]
    own = [[1.0, math.exp(min(30, max(-30, x)))] for x in e]
    t = [[math.exp(model.trans[a, b]) for b in (0, 1)] for a in (0, 1)]
    norm = lambda v: [x / sum(v) for x in v]
    forward, back = [], [[1.0, 1.0]]
    for i, x in enumerate(own):
        forward.append(norm([x[b] * (sum(forward[-1][a] * t[a][b] for a in (0, 1)) if i else 1) for b in (0, 1)]))
    for x in reversed(own[1:]):
        back.append(norm([sum(t[a][b] * x[b] * back[-1][b] for b in (0, 1)) for a in (0, 1)]))
    both = [norm([p * q for p, q in zip(f, b, strict=True)]) for f, b in zip(forward, reversed(back), strict=True)]
    return [x[1] for x in both]


def test_query_equals_plain_passes(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    rows = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        p = marginals(model, [m[0] for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")])
        score = model.score(max(p, default=0.0), sum(p))
        assert rows[i]["score"] == pytest.approx(score, abs=1e-6)
        assert rows[i]["predicted"] == (rows[i]["score"] >= 0.7) and rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(r["predicted"], q["toxic"]) for q in labels.collect() if (r := rows.get(q["doc_id"])) and r["held_out"] and q["toxic"] is not None]
    assert held and sum(a == b for a, b in held) >= 0.8 * len(held)


def test_stretches_cover_the_whole_text():
    words = [f"w{i}" if i % 50 else "bad" for i in range(2000)]
    got = toxicity.stretches(" ".join(words), 1, {"bad"})
    assert len(got) == toxicity.PER_TEXT + 1 and all(1 in y for _, y in got[:-1])
    firsts = [int(w[1:]) for s, _ in got[:-1] for w in s[:1] if w != "bad"]
    assert max(firsts) > 1600  # not only the beginning
    assert len(toxicity.stretches(" ".join(words), 1, {"bad"}, per_text=100)) == 41
    assert toxicity.words_of("a\x85b c\xa0d\u2003e\tf") == ["a\x85b", "c\xa0d\u2003e", "f"]
    assert toxicity.stretches(None, 1, {"bad"}) == []
