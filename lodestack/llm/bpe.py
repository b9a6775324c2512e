"""BPE encoding and decoding with a pair occurrence index.

The words that a batch brings anew are laid end to end as linked symbols; an index maps each adjacent pair to all its
positions; ranks are applied in ascending order, each to its whole list, and the lists of the neighbours are updated.
Words met before come from a cache, which is emptied when its words and ids take max_bytes.

Null text is empty text; an empty text has no tokens. Texts of any length are split into words, so a long text costs
what its words cost. Columns beside doc_id and text are kept.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: The tokenizer file's own split: contractions, letters, single numbers, the rest. White space as Unicode defines it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[%(new)s]]+|[\p{N}--[%(new)s]]|(?:[^\p{White_Space}\p{L}\p{N}]|[%(new)s])+"


#: Code points (hex) that the regex module counts as letters or numbers and the tokenizer's Unicode tables do not.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb "
    "11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
#: Code points (hex) of capitals that the tokenizer lower-cases and older Unicode tables do not know, and theirs.
LOWER = "1c89:1c8a a7cb:264 a7cc:a7cd a7ce:a7cf a7d2:a7d3 a7d4:a7d5 a7da:a7db a7dc:19b 10d50-10d65:10d70 16ea0-16eb8:16ebb"
#: Code points (hex) of combining marks that the tokenizer's tables do not know, so that it leaves them in place.
STRANGE = (
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b "
    "1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)


def _lower_table() -> dict[int, int]:
    out = {}
    for item in LOWER.split():
        span, to = item.split(":")
        first, last = (int(x, 16) for x in (span.split("-") * 2)[:2])
        out |= {c: int(to, 16) + c - first for c in range(first, last + 1)}
    return out


def _class(spans: str) -> str:
    return "".join("-".join(re.escape(chr(int(x, 16))) for x in span.split("-")) for span in spans.split())


_LOWER, _STRANGE = _lower_table(), re.compile(f"([{_class(STRANGE)}])")
#: The same split where a text holds only ASCII and the letters of Latin-1, which are most texts.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+"
PLAIN_CHARS = frozenset(map(chr, [*range(128), *range(0xC0, 0x100)]))


class Merges:
    """Ranks of pairs of symbol ids, the first symbols of a byte and the added tokens, from a tokenizer file's text."""

    def __init__(self, source: str, max_bytes: int = 1 << 26):
        spec = json.loads(source)
        ids = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: A pair is one number; its rank leads back to the pair and to what it becomes.
        self.pairs = [ids[a] << 20 | ids[b] for a, b in pairs]
        self.made = [ids[a + b] for a, b in pairs]
        self.ranks = {p: r for r, p in enumerate(self.pairs)}
        # Bytes as printable characters: those that print stand for themselves, the others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = [ids[shown[b]] for b in range(256)]
        self.last = [ids[shown[b] + end] for b in range(256)]
        self.words = regex.compile(WORDS % {"new": _class(NEWER)}, regex.V1)
        self.plain = re.compile(PLAIN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}
        self.max_bytes, self.held = max_bytes, 0

    def learn(self, words: list[str]) -> None:
        """Merge all these words at once."""
        sym: list[int] = []
        starts: list[int] = []
        nxt: list[int] = []
        prev: list[int] = []
        where: defaultdict[int, list[int]] = defaultdict(list)
        ranks, inner, last = self.ranks.get, self.inner, self.last
        for w in words:
            raw = w.encode()
            at, n = len(sym), len(raw)
            starts.append(at)
            sym += [inner[b] for b in raw]
            sym[-1] = last[raw[-1]]
            nxt += range(at + 1, at + n)
            nxt.append(-1)
            prev.append(-1)
            prev += range(at, at + n - 1)
        for i, (a, b) in enumerate(pairwise(sym)):
            if nxt[i] > 0 and (r := ranks(a << 20 | b)) is not None:
                where[r].append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            new = self.made[rank]
            a, b = divmod(self.pairs[rank], 1 << 20)
            for i in sorted(where.pop(rank)):
                j = nxt[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                k, h = nxt[j], prev[i]
                nxt[i] = k
                nxt[j] = -1
                if k >= 0:
                    prev[k] = i
                    if (r := ranks(new << 20 | sym[k])) is not None:
                        if r not in where:
                            heapq.heappush(active, r)
                        where[r].append(i)
                if h >= 0 and (r := ranks(sym[h] << 20 | new)) is not None:
                    if r not in where:
                        heapq.heappush(active, r)
                    where[r].append(h)
        for w, i in zip(words, starts, strict=True):
            out = []
            while i >= 0:
                out.append(sym[i])
                i = nxt[i]
            self.cache[w] = array("i", out).tobytes()
            self.held += len(w) + 4 * len(out) + 200  # what Python itself takes for an entry

    def split(self, text: str) -> list[str]:
        """Words of one text; added tokens are words of their own."""
        if self.special and any(s in text for s in self.added):
            out: list[str] = []
            for part in self.special.split(text):
                out += [part] if part in self.added else self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if PLAIN_CHARS.issuperset(text):
            return self.plain.findall(text.lower())
        parts = _STRANGE.split(text)
        text = unicodedata.normalize("NFC", text) if len(parts) == 1 else "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(parts))
        return self.words.findall(text.replace("Σ", "σ").lower().translate(_LOWER))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as 32-bit numbers end to end."""
        split = [self.split(t) for t in texts]
        if self.held > self.max_bytes:
            self.cache.clear()
            self.held = 0
        cache = self.cache
        for s, i in self.added.items():
            cache[s] = array("i", [i]).tobytes()
        fresh = set().union(*split).difference(cache)
        if fresh:
            self.learn(sorted(fresh))
        return [b"".join(map(cache.__getitem__, ws)) for ws in split]


@lru_cache(maxsize=2)
def merges_of(source: str) -> Merges:
    """One for each Python worker, with its cache of words."""
    return Merges(source)


def _mapped(df: DataFrame, read: str, *steps, without: tuple[str, ...] = ()) -> DataFrame:
    """df with a column for each step (name, type, make): made by what make() returns from the column before it.

    The first step reads `read`. All steps of a batch are done by one worker. Columns in `without` are left behind.
    """
    added = [name for name, _, _ in steps]
    schema = T.StructType([f for f in df.schema.fields if f.name not in (*added, *without)] + [T.StructField(name, kind) for name, kind, _ in steps])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works = [make() for _, _, make in steps]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [part.column(part.schema.get_field_index(read))]
                for work in works:
                    got.append(work(got[-1]))
                keep = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n not in (*added, *without)]
                yield pa.RecordBatch.from_arrays([c for _, c in keep] + got[1:], names=[n for n, _ in keep] + added)

    return df.mapInArrow(run, schema)


def _encoder(spark: SparkSession, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def make():
        merges = merges_of(source.value)

        def encode(texts: pa.Array) -> pa.Array:
            got = merges.encode([t or "" for t in texts.to_pylist()])
            offsets = np.zeros(len(got) + 1, dtype=np.int32)
            np.cumsum([len(g) // 4 for g in got], out=offsets[1:])
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), dtype=np.int32)))

        return encode

    return make


def _decoder(spark: SparkSession, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    by_id = [""] * (max(names.values()) + 1)
    for name, i in names.items():
        by_id[i] = name
    shared = spark.sparkContext.broadcast(by_id)

    def make():
        table = pa.array(shared.value, pa.string())

        def decode(rows: pa.Array) -> pa.Array:
            rows = rows.fill_null([]) if rows.null_count else rows
            tokens = table.take(rows.flatten())
            lengths = rows.value_lengths().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")

        return decode

    return make


IDS, TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "bpe_ids") -> DataFrame:
    """docs with out: array of token ids of the whole text. tokenizer: path of a tokenizer file that the driver reads."""
    return _mapped(docs, text, (out, IDS, _encoder(docs.sparkSession, tokenizer)))


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "bpe_ids", out: str = "bpe_text") -> DataFrame:
    """df with out: the text that the ids stand for (this kind joins its tokens by spaces); null ids are an empty text."""
    return _mapped(df, ids, (out, TEXT, _decoder(df.sparkSession, tokenizer)))


def bpe_round_trip(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "bpe_ids", out: str = "bpe_text") -> DataFrame:
    """docs, but for text, with ids, as bpe_encode makes them, and out, which bpe_decode makes of those, by one worker."""
    spark = docs.sparkSession
    return _mapped(docs, text, (ids, IDS, _encoder(spark, tokenizer)), (out, TEXT, _decoder(spark, tokenizer)), without=(text,))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(df: DataFrame) -> DataFrame:
    """doc_id and the digests of bpe_ids and bpe_text."""
    return df.select("doc_id", F.size("bpe_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("bpe_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("bpe_text", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(bpe_round_trip(docs, path))


SQL: dict[str, str] = {}
QUERIES = {"op1_bpe": op1_bpe}
