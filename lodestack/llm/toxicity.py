"""Toxicity: a linear-chain conditional random field tags toxic words; forward-backward marginals make document scores.

Token labels come from the document labels that may be learned from: units (words and their beginnings, so that
inflected forms count together) that stand in many toxic documents and hardly in others mark the words of toxic
documents. The field has two states; a word's potential adds up weights of its own units and of its neighbours'. The
marginal of each word, exact by forward and backward passes over the whole text, gives the offending offsets, and the
largest marginal and their sum give the document's score by a logistic curve fitted on the same labelled rows.

Learned from at most `per_class` labelled rows a class, in the order of a hash, each trained on stretches around at most
`per_text` of its marked words, which are spread evenly over the whole text, and one stretch elsewhere (both bounds are
parameters of :func:`train`). All rows are scored over their whole texts. Words are split at ASCII white space, in
training as in scoring. Only the text is looked at. Null text is empty text; a text without words scores as one without toxic words. Without labels of both
classes every score is that class's share (0 without labels). Columns beside doc_id and text are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held_out, table
from .factorisation import labelled_sample

BUCKETS, SAMPLE, STRETCH = 1 << 17, 3000, 12
#: Marked words of a labelled text that it is trained around.
PER_TEXT = 8
STARTS = (4, 5, 6)
_EDGE = re.compile(r"^\W+|\W+$")


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def units(word: str) -> list[str]:
    """The word without marks at its ends, lower-cased, and its beginnings."""
    w = _EDGE.sub("", word).lower()
    return [w, *(w[:k] + "-" for k in STARTS if len(w) > k)] if w else []


def _bucket(kind: str, unit: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind}{unit}") % BUCKETS


def features(word: str) -> tuple[list[int], int, int]:
    """Buckets of a word for itself, for the word after it and for the word before it."""
    u = units(word)
    return [_bucket("=", x) for x in u], _bucket("<", u[0] if u else ""), _bucket(">", u[0] if u else "")


def chain(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of state 1 for sequences laid end to end; e: log odds of each place alone, trans: 2 x 2 potentials.

    All sequences step together, the longer ones last, so the work is the places and not the longest times the number.
    """
    x = np.exp(np.clip(e, -30, 30))
    forward, back = np.empty_like(x), np.empty_like(x)
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    end = start + n - 1
    alive = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")
    (t00, t01), (t10, t11) = trans
    r = s = None
    for t, k in enumerate(alive):
        at = start[:k] + t
        r = x[at] if t == 0 else x[at] * (t01 + r[:k] * t11) / (t00 + r[:k] * t10)
        np.clip(r, 1e-30, 1e30, out=r)
        forward[at] = r
        at = end[:k] - t
        if t == 0:
            s = np.ones(k)
        else:
            y = x[at + 1] * s[:k]
            s = (t10 + t11 * y) / (t00 + t01 * y)
        back[at] = s
    both = forward * back
    marginal = both / (1 + both)
    if not pairs:
        return marginal
    last = np.zeros(len(e), dtype=bool)
    last[end] = True
    a = np.flatnonzero(~last)
    y = x[a + 1] * back[a + 1]
    w = np.stack([np.full(len(a), t00), t01 * y, forward[a] * t10, forward[a] * t11 * y])
    return marginal, (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class Field:
    """Weights of the potentials and of the document's score."""

    bias: float = -6.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float] = (0.0, 1.0, 1.0)
    share: float | None = None

    def score(self, most: float, total: float) -> float:
        if self.share is not None:
            return self.share
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * most + c * np.log1p(total), -35, 35))))


class Tagger:
    """Marginals of texts; the potentials of each word are kept up to a bound."""

    def __init__(self, model: Field, max_words: int = 500_000):
        self.model, self.max_words = model, max_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.own, self.after, self.before = [], [], []

    def __call__(self, texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        m = self.model
        if len(self.index) > self.max_words:
            self.clear()
        words = [(t or "").encode().split() for t in texts]
        fresh = set().union(*words).difference(self.index)
        for w in fresh:
            own, after, before = features(w.decode())
            self.index[w] = len(self.own)
            self.own.append(float(m.w[own].sum()))
            self.after.append(float(m.w[after]))
            self.before.append(float(m.w[before]))
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        at = np.fromiter((self.index[w] for ws in words for w in ws), dtype=np.int64, count=int(lengths.sum()))
        e = np.array(self.own)[at] + m.bias if len(at) else np.zeros(0)
        if len(at) > 1:
            doc = np.repeat(np.arange(len(words)), lengths)
            same = doc[1:] == doc[:-1]
            e[1:] += np.where(same, np.array(self.after)[at[:-1]], 0)
            e[:-1] += np.where(same, np.array(self.before)[at[1:]], 0)
        some = lengths > 0
        return words, lengths, chain(e, lengths[some], np.exp(m.trans))


def _chunks(values: list, size: int = 4_000_000):
    """Runs of texts of about `size` bytes in all."""
    part, held = [], 0
    for i, v in enumerate(values):
        part.append(i)
        held += len(v or "")
        if held > size:
            yield part
            part, held = [], 0
    if part:
        yield part


def tag(docs: DataFrame, model: Field, spans: bool = True, threshold: float = 0.5) -> DataFrame:
    """docs with tx_max, tx_sum, tx_score and, if asked, tx_spans: (start, end, p) of toxic words in code points."""
    keep = [f for f in docs.schema.fields if not f.name.startswith("tx_")]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    added = [T.StructField("tx_max", T.DoubleType()), T.StructField("tx_sum", T.DoubleType()), T.StructField("tx_score", T.DoubleType())] + [T.StructField("tx_spans", T.ArrayType(span))] * spans
    schema = T.StructType(keep + added)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            most, total, found = np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
            for part in _chunks(texts):
                _, lengths, p = tagger([texts[i] for i in part])
                ends = np.cumsum(lengths)
                for i, a, b in zip(part, ends - lengths, ends, strict=True):
                    if b > a:
                        most[i], total[i] = p[a:b].max(), p[a:b].sum()
                        if spans and most[i] >= threshold:
                            hit = p[a:b] >= threshold
                            found[i] = [{"start": m.start(), "end": m.end(), "p": float(x)} for m, h, x in zip(re.finditer(r"[^\x20\x09-\x0D]+", texts[i]), hit, p[a:b], strict=True) if h]
            score = [shared.value.score(a, b) for a, b in zip(most, total, strict=True)]
            columns = [pa.array(most), pa.array(total), pa.array(score)] + [pa.array(found, arrow)] * spans
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in keep] + columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def seeds(sample: DataFrame, n1: int, n0: int) -> set[str]:
    """Units that mark toxic words; sample has at most a fixed number of rows, so what is counted and sent is bounded."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            rows = [(u, y) for t, y in zip(d["text"], d["y"], strict=True) for u in {u for w in set(words_of(t)) for u in units(w)}]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], names=["unit", "y"])

    counts = sample.select("text", "y").mapInArrow(split, "unit string, y int").groupBy("unit").agg(F.sum("y").alias("d1"), F.sum(1 - F.col("y")).alias("d0"))
    odds = (F.col("d1") + 0.5) / (n1 + 1) / ((F.col("d0") + 0.5) / (n0 + 1))
    return {r["unit"] for r in counts.where((F.col("d1") >= max(4, 0.005 * n1)) & (odds >= 12) & (F.col("d0") <= 0.002 * n0)).select("unit").collect()}


def one_of_each(sample: DataFrame) -> DataFrame:
    """Of near copies one: rows that share the least hash of their word triples, by either of two hashes, count once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
                w = (t or "").encode().split()
                triples = {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
                got.append([min(xxhash.xxh64_intdigest(x, seed) >> 1 for x in triples) for seed in (1, 2)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[i] for g in got], pa.int64()) for i in (0, 1))], names=[*batch.schema.names, "s1", "s2"])

    signed = sample.select("doc_id", "text", "y").mapInArrow(sign, "doc_id long, text string, y int, s1 long, s2 long")
    for s in ("s1", "s2"):
        signed = signed.join(signed.groupBy("y", s).agg(F.min("doc_id").alias("doc_id")), ["y", s, "doc_id"], "left_semi")
    return signed.select("doc_id", "text", "y")


def stretches(text: str | None, y: int, marks: set[str], per_text: int = PER_TEXT) -> list[tuple[list[str], list[int]]]:
    """Words and their labels around at most per_text marked words, spread over the text, and once elsewhere."""
    words = words_of(text)
    label = [int(bool(y) and not marks.isdisjoint(units(w))) for w in words]
    marked = [i for i, x in enumerate(label) if x]
    at = [marked[k * len(marked) // per_text] for k in range(per_text)] if len(marked) > per_text else marked
    at.append(xxhash.xxh32_intdigest(text or "") % max(1, len(words)))
    return [(words[a:b], label[a:b]) for a, b in ((max(0, i - STRETCH), i + STRETCH) for i in at) if words[a:b]]


def fit(rows: list[tuple[list[str], list[int]]], epochs: int = 8, batch: int = 512, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    """Adagrad on the likelihood of the labels; gradients are observed less expected counts, from marginals."""
    m, rng = Field(), np.random.default_rng(seed)
    known: dict[str, tuple] = {}
    coded = []
    for words, label in rows:
        f = [known.get(w) or known.setdefault(w, features(w)) for w in words]
        place = [(i, b) for i, x in enumerate(f) for b in x[0]]
        place += [(i + 1, x[1]) for i, x in enumerate(f[:-1])] + [(i, x[2]) for i, x in enumerate(f[1:])]
        coded.append((np.array([p for p, _ in place], dtype=np.int64), np.array([b for _, b in place], dtype=np.int64), np.array(label, dtype=np.float64)))
    seen, seen_b, seen_t = np.full(BUCKETS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for start in range(0, len(order), batch):
            part = [coded[i] for i in order[start : start + batch]]
            lengths = np.array([len(y) for _, _, y in part], dtype=np.int64)
            shift = np.cumsum(lengths) - lengths
            place = np.concatenate([p + s for (p, _, _), s in zip(part, shift, strict=True)])
            bucket, y = np.concatenate([b for _, b, _ in part]), np.concatenate([y for _, _, y in part])
            e = m.bias + np.bincount(place, m.w[bucket], minlength=len(y))
            p, expected = chain(e, lengths, np.exp(m.trans), pairs=True)
            g = p - y
            observed = np.zeros((2, 2))
            inner = np.ones(len(y), dtype=bool)
            inner[shift] = False
            a = np.flatnonzero(inner)
            np.add.at(observed, (y[a - 1].astype(int), y[a].astype(int)), 1)
            gw = np.bincount(bucket, g[place], minlength=BUCKETS) / len(part) + decay * m.w
            gt, gb = (expected - observed) / len(part) + 1e-3 * m.trans, g.sum() / len(part)
            seen, seen_t, seen_b = seen + gw**2, seen_t + gt**2, seen_b + gb**2
            m.w -= rate * gw / np.sqrt(seen)
            m.trans -= 0.3 * rate * gt / np.sqrt(seen_t)
            m.bias -= rate * gb / np.sqrt(seen_b)
    m.trans -= m.trans[0, 0]
    return m


def fit_curve(most: np.ndarray, total: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the largest marginal and the log of their sum, by Newton steps with a small penalty."""
    x = np.column_stack([np.ones(len(y)), most, np.log1p(total)])
    w, k = np.zeros(3), np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (k * p * (1 - p))[:, None]).T @ x / len(y) + 1e-3 * np.eye(3)
        w -= np.linalg.solve(h, x.T @ (k * (p - y)) / len(y) + 1e-3 * w)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = SAMPLE, per_text: int = PER_TEXT) -> Field:
    sample = cut(labelled_sample(docs, labels, target, per_class).select("doc_id", "text", "y"), "toxic-sample")
    apart = cut(one_of_each(sample), "toxic-apart")
    n = {r["y"]: r["count"] for r in apart.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Field(share=1.0 if n1 else 0.0)
    marks = seeds(apart, n1, n0)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            rows = [(i, *s) for i, t, y in zip(d["doc_id"], d["text"], d["y"], strict=True) for s in stretches(t, y, marks, per_text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "words", "label"])

    rows = apart.select("doc_id", "text", "y").mapInArrow(cut_out, "doc_id long, words array<string>, label array<int>").toArrow()
    rows = sorted(zip(rows["doc_id"].to_pylist(), rows["words"].to_pylist(), rows["label"].to_pylist(), strict=True))
    model = fit([(w, y) for _, w, y in rows])
    told = tag(sample, model, spans=False).select("doc_id", "tx_max", "tx_sum", "y").toPandas().sort_values("doc_id")
    model.curve = fit_curve(told["tx_max"].to_numpy(), told["tx_sum"].to_numpy(), told["y"].to_numpy().astype(float))
    return model


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = tag(docs, train(docs, labels)).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tx_score").alias("score"), (F.col("tx_score") >= 0.7).cast("int").alias("predicted"), F.size("tx_spans").alias("n_spans"), "tx_spans")


SQL: dict[str, str] = {}
QUERIES = {"op6_toxicity": op6_toxicity}
