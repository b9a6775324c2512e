"""PII: base patterns, then a skip-chain conditional random field that keeps labels consistent in a document.

Base spans (email, ip, card, phone) are found by patterns, leftmost and without overlap for each kind, and always stay.
The field then looks at a document's words: neighbours share chain potentials, distant words that are the same but for
case and punctuation, or differ in one character, share skip potentials, and loopy belief propagation passes messages
until they settle (at most ROUNDS times, as loops need not), so that a repeat in another dress (a phone without its plus,
a card with a digit mistyped) gets the label of its twin. A word that no base span touches and whose best label is a kind
becomes an added span.

The weights maximise the pseudo-likelihood of the labels that base spans give to words, over at most `sample` documents
that have some, in the order of a hash (a documented bound). Some words with a twin are dressed as words of no kind while
learning, so that the skip weights learn how far a twin can be trusted against what a word looks like. All documents are tagged over their
whole texts. Words that look like no kind
(no digit, no "@") and repeat none that does have one label only, so they are constants of the field: messages pass
between the rest, and through runs of plain words only as far as their potential goes. Null text is empty text. Columns
beside doc_id and text are kept; rows that repeat a doc_id are tagged alike.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

KINDS = ("email", "ip", "card", "phone")
#: The local part is the run before the "@", read backwards; runs are entered at their first character only.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
SAMPLE, ROUNDS, SETTLED = 2000, 60, 1e-3
#: Skip weights stay near this where the sample has no repeats to learn them from.
SKIP_PRIOR = 1.2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            at = start = m.start()
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                done = m.end()
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = re.sub(r"[\x20-]", "", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> tuple[str, ...]:
    """How a word is built, from all that is told about it to the least."""
    digits = len(_DIGIT.findall(word))
    core = word.strip(".,;:!?*$&%#\"'()[]")
    built = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", core))[:16]
    valid = 14 <= digits == len(core) and luhn(core)
    return f"{built}|{word[:1] == '+'}|{min(digits, 24)}|{valid}", f"{built}|{word[:1] == '+'}|{valid}", f"{'@' in word}|{digits // 4 if digits < 24 else 6}|{valid}"


def core_of(word: str) -> str:
    """What must be equal for words to share a skip potential: lower-cased letters and digits."""
    return "".join(c for c in word.lower() if c.isalnum() or c == "@")


class Field:
    """Log-linear potentials of words (by shape), of neighbours and of repeats; label 0 is none, then the kinds."""

    def __init__(self):
        n = len(KINDS) + 1
        self.unary: dict[str, np.ndarray] = {}
        self.bias, self.chain, self.skip = np.zeros(n), np.zeros((n, n)), np.full(n, SKIP_PRIOR)

    def potentials(self, word: str) -> np.ndarray:
        *exact, coarse = shape(word)
        for f in exact:
            if f in self.unary:
                return self.bias + self.unary[f]
        return self.outline(coarse)

    def outline(self, coarse: str) -> np.ndarray:
        """What is known in outline only may count against a kind, never for one."""
        e = self.bias + self.unary.get(coarse, 0.0)
        return np.minimum(e, e[0])


def live_words(text: str) -> list[tuple[int, int, int, str]]:
    """(place among the words, start, end, word) of words with a digit or an "@"."""
    return [(i, m.start(), m.end(), m[0]) for i, m in enumerate(_WORD.finditer(text)) if "@" in m[0] or _DIGIT.search(m[0])]


def one_off(a: str, b: str) -> bool:
    """Whether one character more, less or other is all that two strings differ in."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def neighbours(words: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between words side by side, and skip edges that string together words of the same or a similar core."""
    chain = [(k, k + 1) for k in range(len(words) - 1) if words[k + 1][0] == words[k][0] + 1]
    last: dict[str, int] = {}
    skip: set[tuple[int, int]] = set()
    for k, (_, _, _, w) in enumerate(words):
        core = core_of(w)
        if sum(c.isdigit() for c in core) + 4 * ("@" in core) < 4:
            continue  # short numbers repeat by chance
        # The core itself; where one character is more, less or other, the words' first or last halves are the same.
        keys = {f"={core}"} | {f"{side}{h}{part}" for h in {len(core) // 2, (len(core) - 1) // 2} for side, part in (("<", core[:h]), (">", core[len(core) - h :]))}
        for key in sorted(keys):
            if key in last and words[last[key]][0] + 1 < words[k][0]:
                if key[0] == "=" or one_off(core, core_of(words[last[key]][3])):
                    skip.add((last[key], k))
            last[key] = k
    return chain, sorted(skip)


def marginals(model: Field, words: list[tuple[int, int, int, str]], known: dict[int, int]) -> np.ndarray:
    """Marginals by loopy belief propagation; known: words whose label base spans fix."""
    n = len(KINDS) + 1
    e = np.array([model.potentials(w[3]) for w in words])
    for k, label in known.items():
        e[k] = np.where(np.arange(n) == label, e[k], -30.0)
    chain, skip = neighbours(words)
    if not chain and not skip:
        p = np.exp(e - e.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    same = np.diag(model.skip)
    a = np.array([x for x, _ in chain + skip] + [y for _, y in chain + skip])
    b = np.array([y for _, y in chain + skip] + [x for x, _ in chain + skip])
    pot = np.exp(np.array([model.chain] * len(chain) + [same] * len(skip) + [model.chain.T] * len(chain) + [same] * len(skip)))
    back = np.r_[len(a) // 2 : len(a), 0 : len(a) // 2]
    msg = np.zeros((len(a), n))
    for _ in range(ROUNDS):
        belief = e.copy()
        np.add.at(belief, b, msg)
        out = belief[a] - msg[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ij,ijk->ik", out, pot) + 1e-30)
        new, before = 0.5 * msg + 0.5 * (new - new.max(axis=1, keepdims=True)), msg
        msg = new
        if np.abs(msg - before).max() < SETTLED:
            break
    belief = e.copy()
    np.add.at(belief, b, msg)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def labels_of(words: list[tuple[int, int, int, str]], spans: list[tuple[int, int, str]]) -> dict[int, int]:
    """The kind of each live word that a base span touches."""
    out, k = {}, 0
    ends = sorted(spans)
    for i, (_, s, t, _) in enumerate(words):
        while k < len(ends) and ends[k][1] <= s:
            k += 1
        for a, b, kind in ends[k : k + 4]:
            if a < t and s < b:
                out[i] = KINDS.index(kind) + 1
                break
    return out


def added_spans(text: str, base: list[tuple[int, int, str]], model: Field, threshold: float = 0.5) -> list[tuple[int, int, str]]:
    words = live_words(text)
    if not words:
        return []
    known = labels_of(words, base)
    free = [i for i in range(len(words)) if i not in known]
    if not free:
        return []
    p = marginals(model, words, known)
    out = []
    for i in free:
        k = int(p[i].argmax())
        if k and p[i, k] >= threshold:
            word, s = words[i][3], words[i][1]
            m = re.search(r"[A-Za-z0-9+(][^\s]*[A-Za-z0-9)]", word)
            if m:
                out.append((s + m.start(), s + m.end(), KINDS[k - 1]))
    return out


def fit(texts: list[str], least: int = 5, steps: int = 60, rate: float = 0.2, decay: float = 1e-3, seed: int = 13) -> Field:
    """Pseudo-likelihood by Adagrad, from log odds of the base labels by shape and of neighbours' labels.

    A word has the one most telling shape that was met `least` times. Of words with a twin, every other one (by chance)
    is dressed as some word of no kind, in each step anew.
    """
    n = len(KINDS) + 1
    model = Field()
    by: defaultdict[str, np.ndarray] = defaultdict(lambda: np.full(n, 0.5))
    shapes, label, chain, skip = [], [], [], []
    for t in texts:
        words = live_words(t)
        y = labels_of(words, base_spans(t))
        side, far = neighbours(words)
        at = len(label)
        chain += [(at + i, at + j) for i, j in side]
        skip += [(at + i, at + j) for i, j in far]
        label += [y.get(i, 0) for i in range(len(words))]
        shapes += [shape(w[3]) for w in words]
    for f, k in zip(shapes, label, strict=True):
        for name in f:
            by[name][k] += 1
    total, pairs = np.full(n, 0.5), np.full((n, n), 0.5)
    np.add.at(total, label, 1)
    for i, j in chain:
        pairs[label[i], label[j]] += 1
    prior, joint = total / total.sum(), pairs / pairs.sum()
    model.bias = np.log(prior)
    model.unary = {f: np.log(c / c.sum() / prior) for f, c in by.items() if c.sum() >= least + 0.5 * n}
    model.chain = 0.5 * np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
    if not label:
        return model
    names = sorted(model.unary)
    place = {f: i for i, f in enumerate(names)}
    told = np.array([next((place[f] for f in fs[:-1] if f in place), -1) for fs in shapes])
    outline = np.array([place.get(fs[-1], -1) for fs in shapes])
    start = np.array([model.unary[f] for f in names] + [np.zeros(n)])  # the last row is for shapes not known
    w, y, rng = start.copy(), np.array(label), np.random.default_rng(seed)
    one, plain = np.eye(n)[y], np.flatnonzero(y == 0)
    (ca, cb), (sa, sb) = (np.array(e, dtype=int).reshape(-1, 2).T for e in (chain, skip))
    twin = np.zeros(len(y), dtype=bool)
    twin[sa], twin[sb] = True, True
    weights = [w, model.chain, model.skip]
    anchors, seen = [start, model.chain.copy(), np.full(n, SKIP_PRIOR)], [np.full(x.shape, 1e-4) for x in (w, model.chain, model.skip)]
    for _ in range(steps):
        hidden = twin & (rng.random(len(y)) < 0.5) if len(plain) else np.zeros(len(y), dtype=bool)
        dress = np.where(hidden, rng.choice(plain, len(y)) if len(plain) else 0, np.arange(len(y)))
        rough = told[dress] < 0
        z = model.bias + w[np.where(rough, outline[dress], told[dress])]
        z = np.where(rough[:, None], np.minimum(z, z[:, :1]), z)
        hidden |= rough
        np.add.at(z, ca, model.chain.T[y[cb]])
        np.add.at(z, cb, model.chain[y[ca]])
        np.add.at(z, sa, one[sb] * model.skip)
        np.add.at(z, sb, one[sa] * model.skip)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = p / p.sum(axis=1, keepdims=True) - one
        gw, gc = np.zeros_like(w), np.zeros((n, n))
        np.add.at(gw, told[~hidden], g[~hidden])
        np.add.at(gc, y[ca], g[cb])
        np.add.at(gc.T, y[cb], g[ca])
        gs = (g[sa] * one[sb] + g[sb] * one[sa]).sum(axis=0)
        for x, grad, anchor, past, pace in zip(weights, (gw, gc, gs), anchors, seen, (rate, rate, 5 * rate), strict=True):
            grad = grad / len(y) + decay * (x - anchor)
            past += grad**2
            x -= pace * grad / np.sqrt(past)
        w[-1] = 0
    model.unary = dict(zip(names, w[:-1], strict=True))
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """From at most `sample` texts with a digit or an "@", in the order of a hash of the text."""
    picked = docs.select(F.xxhash64("text").alias("h"), "text").where(F.col("text").rlike("[0-9@]")).select("h").distinct().orderBy("h").limit(sample)
    texts = docs.select("text", F.xxhash64("text").alias("h")).join(F.broadcast(picked), "h", "left_semi").dropDuplicates(["h"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the words around live ones are needed, with marks for what was between.
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                w = _WORD.findall(t)
                near = sorted({j for i, x in enumerate(w) if "@" in x or _DIGIT.search(x) for j in (i - 1, i, i + 1) if 0 <= j < len(w)})
                out.append(" ".join(w[j] if not k or near[k - 1] == j - 1 else f"- {w[j]}" for k, j in enumerate(near)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["t"])

    return fit(sorted(r["t"] for r in texts.select("text").mapInArrow(lines, "t string").collect()))


def find(docs: DataFrame, model: Field) -> DataFrame:
    """docs with pii_base and pii_all: arrays of (start, end, kind) in code points, by start, then kind."""
    keep = [f for f in docs.schema.fields if not f.name.startswith("pii_")]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*keep, T.StructField("pii_base", span), T.StructField("pii_all", span)])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        told = lambda rows: pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in r] for r in rows], arrow)
        for batch in batches:
            base, every = [], []
            for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
                t = t or ""
                b = base_spans(t)
                base.append(b)
                every.append(sorted(b + added_spans(t, b, m), key=lambda s: (s[0], KINDS.index(s[2]))) if _DIGIT.search(t) or "@" in t else b)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in keep] + [told(base), told(every)], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, train(docs)).drop("text")
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(said("pii_base"), 256).alias("base_sha256"), said("pii_all").alias("spans"))


SQL: dict[str, str] = {}
QUERIES = {"op8_pii": op8_pii}
