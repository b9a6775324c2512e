"""c8_backfill_signals makes each page's chunks once, and its searches look a character up in one table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as t
from lodestack.functions import vocab
from lodestack.operators import chunking
from lodestack.plans import corpus

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["c2_table_row_chunks", "c5_build_chunks", "c6_chunk_records", "c8_backfill_signals"])
def test_chunks_are_made_once(spark, name):
    filters = [line for line in plan(corpus.QUERIES[name](spark, SF)).split("\n") if re.match(r"[ :+-]*Filter ", line)]
    assert not [line for line in filters if "size(" in line]


def test_one_table_for_letters_and_digits(spark):
    assert "a-z0-9" not in plan(spark.createDataFrame([("x",)], "x string").select(t.topics("x"), t.normalize_for_matching("x", True)))


def by_parts(c, spaces):
    """normalize_for_matching as its rule is written."""
    c = F.regexp_replace(t.fold_accents(F.lower(c)), r"[.\-_/\\\s]" if spaces else r"[.\-_/\\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9 ]", ""), " +", " "))


def test_same_words_for_every_character(spark):
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [("".join(f"{chr(i)}x " for i in points[k : k + 4096]),) for k in range(0, len(points), 4096)] + [("a.! \t.b--c \x0b\r\n d\x85e",), ("",), (" . ",), (None,)]
    df = spark.createDataFrame(texts, "x string")
    for spaces in (False, True):
        assert df.where(~t.normalize_for_matching("x", spaces).eqNullSafe(by_parts(F.col("x"), spaces))).count() == 0


def test_topics_by_their_patterns(spark):
    words = [w for p in vocab.TOPICS.values() for w in re.sub(r"\\s\+", " ", p[3:-3]).split("|")] + ["es2", "xes", "portas", "cadeia de", "seguranca", "é", "5", "de"]
    rng = random.Random(14)
    texts = [rng.choice(" .-\n!").join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(400)] + words
    own = {"other": r"gen\s?[0-9]", "ends": r"^es|porta$", **vocab.TOPICS}
    odd = {"group": r"\b(a(b|c))\b", "blank": r"\b(porta\s|dw)\b", "door": vocab.TOPICS["porta"]}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for patterns in (vocab.TOPICS, own, odd):
        rows = df.select("x", t.topics("x", patterns).alias("got"), by_parts(F.col("x"), True).alias("n")).collect()
        assert all(r["got"] == [k for k, p in patterns.items() if re.search(p, r["n"], re.A)] for r in rows)
        assert any(r["got"] for r in rows) and not all(r["got"] for r in rows)
    assert spark.createDataFrame([(None,)], "x string").select(t.topics("x")).first()[0] == by_nulls(spark)


def by_nulls(spark):
    """What a null text gives: no topic's pattern is found in it."""
    return spark.range(1).select(F.array_compact(F.array(F.when(F.lit(None).cast("string").rlike("x"), F.lit("k"))))).first()[0]


def test_line_ends(spark):
    ends = "".join(f"a{i}{e}" for i, e in enumerate(["\r\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\u2027", "\u202a", "\x1f", "\t"]))
    got = spark.createDataFrame([(ends,)], "x string").select(chunking.lines_of(F.col("x"))).first()[0]
    assert got == ends.splitlines()[:11] + ["a11\u2027a12\u202aa13\x1fa14\t"]
