"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)): the sum-of-squares identity makes
scoring linear in the number of features. Words are hashed into `buckets`; statistics of the text's structure (length,
capitals, symbols, repeats, ...) are cut into bins, each a feature of its own, so words and statistics interact.

Learned from at most `sample` labelled rows a class, taken in the order of a hash (a documented bound); every row of the
input is scored over its whole text. Only the text is looked at: labels, lang, source and ids never are inputs.

Metadata: n_chars, where docs have it and it is not null, is cut into bins as another feature.

Null text is empty text and is scored like any other. Without labels, or with one class only, the score is that class's
share (0.5 without labels). Null labels are left out, and of rows that repeat a doc_id the one with the least text is
learned from. Columns beside doc_id and text are kept; one named as the score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, table

BUCKETS, RANK, BINS = 1 << 16, 8, 12
SAMPLE = 3000
STATS = ("length", "distinct", "top_word", "stuck", "symbols", "capitals", "shouts", "pipes", "digits", "word_length", "same_lines", "line_length", "grams")
#: Edges of the bins for shares, dense near 0 and 1, and for lengths.
SHARE_EDGES = np.array([0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.95])
COUNT_EDGES = np.array([0, 1, 2, 4, 8, 16, 32, 64, 256, 1024, 4096])


class Features:
    """(indices, values) of a text; bucket of each word is remembered up to a bound."""

    size = BUCKETS + (len(STATS) + 1) * BINS

    def __init__(self, max_words: int = 60_000):
        self.known: dict[bytes, int] = {}
        self.max_words = max_words

    def __call__(self, text: str | None, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode()
        words = raw.split()
        counts = Counter(words)
        known = self.known
        if len(known) > self.max_words:
            known.clear()
        at: dict[int, int] = {}
        for w, k in counts.items():
            b = known.get(w)
            if b is None:
                b = known[w] = xxhash.xxh32_intdigest(w) % BUCKETS
            at[b] = at.get(b, 0) + k
        tf = np.log1p(np.fromiter(at.values(), dtype=np.float64, count=len(at)))
        tf /= np.sqrt((tf * tf).sum()) or 1.0
        meta = [] if n_chars is None else [np.searchsorted(8 * COUNT_EDGES, n_chars, "right")]
        stats = np.concatenate([structure(raw, words, counts), meta]).astype(np.int64)
        index = np.concatenate([np.fromiter(at, dtype=np.int64, count=len(at)), BUCKETS + np.arange(len(stats)) * BINS + stats])
        return index, np.concatenate([tf, np.full(len(stats), 1.0 / np.sqrt(len(STATS)))])


def structure(raw: bytes, words: list[bytes], counts: Counter) -> np.ndarray:
    """The bin of each statistic."""
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    caps = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    shouts = sum(k for w, k in counts.items() if not w[-1:].isalnum() and w[-1:] == w[-2:-1] and w[-1] < 128)
    stuck = sum(map(bytes.__eq__, words, words[1:]))
    shares = [
        len(counts) / n, max(counts.values(), default=0) / n, stuck / n, sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">"))) / n / 3, caps / n, shouts / n, raw.count(b"|") / n,
        sum(map(raw.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / max(1, len(raw)), len(raw) / n / 24, 1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(raw) / max(1, len(lines)) / 4000), 1 - len(set(pairwise(words))) / n,
    ]
    return np.concatenate([np.searchsorted(COUNT_EDGES, [len(words)], "right"), np.searchsorted(SHARE_EDGES, shares, "right")])


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        xv = self.v[index] * value[:, None]
        s = xv.sum(axis=0)
        z = self.w0 + float(self.w[index] @ value) + 0.5 * float((s * s).sum() - (xv * xv).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adam on the logistic loss, each class weighing the same in all."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(Features.size), rng.normal(0, 0.05, (Features.size, RANK)))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        m.v[:] = 0
        m.w0 = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return m
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    moments = [np.zeros((Features.size, RANK + 1)) for _ in range(2)]
    b0, step = np.zeros(2), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            index, value = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            lengths = np.array([len(rows[i][0]) for i in pick])
            start, doc = np.r_[0, np.cumsum(lengths)[:-1]], np.repeat(np.arange(len(pick)), lengths)
            xv = m.v[index] * value[:, None]
            s = np.add.reduceat(xv, start)
            z = m.w0 + np.add.reduceat(m.w[index] * value, start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), start))
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[pick]) / len(pick)
            used, slot = np.unique(index, return_inverse=True)
            grad = np.zeros((len(used), RANK + 1))
            gv = (g[doc] * value)[:, None]
            np.add.at(grad, slot, np.hstack([gv * (s[doc] - xv), gv]))
            grad += decay * np.hstack([m.v[used], m.w[used, None]])
            step += 1
            moments[0][used] = 0.9 * moments[0][used] + 0.1 * grad
            moments[1][used] = 0.999 * moments[1][used] + 0.001 * grad**2
            move = rate * (moments[0][used] / (1 - 0.9**step)) / (np.sqrt(moments[1][used] / (1 - 0.999**step)) + 1e-8)
            m.v[used] -= move[:, :RANK]
            m.w[used] -= move[:, RANK]
            b0 = np.array([0.9, 0.999]) * b0 + np.array([0.1 * g.sum(), 0.001 * g.sum() ** 2])
            m.w0 -= rate * (b0[0] / (1 - 0.9**step)) / (np.sqrt(b0[1] / (1 - 0.999**step)) + 1e-8)
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, seed: int = 11) -> DataFrame:
    """doc_id, text, y for at most per_class rows of each class that labels may be learned from, by the order of a hash."""
    known = labels.select("doc_id", F.col(target).cast("int").alias("y")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    order = F.xxhash64(F.lit(seed), "doc_id")
    picked = [known.where(F.col("y") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    picked = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.max("y").alias("y"))
    # At most 2 * per_class ids, whatever the corpus, so they can go to every task.
    own = [c for c in ("text", "n_chars") if c in docs.columns]
    rows = docs.select("doc_id", F.struct(*own).alias("x")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("doc_id", "y", "x.*")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = SAMPLE) -> Machine:
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
    number = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            d = batch.to_pydict()
            got = [features(t, n) for t, n in zip(d["text"], d["n_chars"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d["doc_id"], pa.int64()), pa.array(d["y"], pa.int32()), pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))], schema=schema)

    sample = labelled_sample(docs, labels, target, per_class).select("doc_id", "y", "text", number.alias("n_chars"))
    rows = sample.mapInArrow(run, "doc_id long, y int, index array<int>, value array<float>").toArrow().sort_by("doc_id").combine_chunks()
    # The driver holds the sample as flat numbers; each row is a view of them.
    index, value = (rows[c].combine_chunks().flatten().to_numpy() for c in ("index", "value"))
    ends = np.cumsum(pc.list_value_length(rows["index"]).to_numpy()) if rows.num_rows else np.zeros(0, dtype=np.int64)
    pairs = [(index[a:b], value[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=False)]
    return fit(pairs, rows["y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, out: str = "fm_score") -> DataFrame:
    """docs with out, a double from 0 to 1 for every row."""
    keep = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                at = part.schema.get_field_index("n_chars")
                numbers = part.column(at).to_pylist() if at >= 0 else [None] * len(texts)
                got = [m.score(*features(t, n)) for t, n in zip(texts, numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in keep] + [pa.array(got, pa.float64())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels)).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("fm_score").alias("score"), (F.col("fm_score") >= 0.5).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op5_quality_classifier": op5_quality_classifier}
