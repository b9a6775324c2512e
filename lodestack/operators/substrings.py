"""Which of many needles stand in which of many texts, without holding each against each.

A needle's longest word has to stand inside a word of the text. So the distinct words of all texts are the vocabulary;
needles meet it through an index of three-character pieces, by the rarest piece each, and a text meets only the needles
whose word is in one of its own. Words of more than 24 characters are slices of 48, each beginning 24 behind the one
before: what is no longer than 24 lies within one. Nothing passes through the driver; texts are read twice, whatever
the number of needles, and do not move.

A needle of two or three words need not be looked for in the text at all: its first word ends what stands before a
space, and the rest begins what stands behind it. So a text's places are joined with such needles by the first word and
two characters more, which is linear in the text; the rest of the needle is compared at that place only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, few, forget

#: The longest word that is looked up whole; of a longer one its beginning is.
LONGEST = 24
SLICES = rf"(?=(\S{{1,{2 * LONGEST}}}))\S{{1,{LONGEST}}}"
#: Two or three words with one space between them, the first of at most LONGEST characters, and two characters behind it.
PHRASE = rf"(?s)\A[^ %_]{{1,{LONGEST}}} (?=..)[^ %_]+( [^ %_]+)?\z"
#: Bytes in memory of the table that texts meet at a time; a larger one takes as many more scans.
AT_ONCE = 64 << 20


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and no other letter, as SQLite compares."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(c: Column) -> Column:
    """The words of a text, long ones as slices, once each."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(SLICES), 1))


def grams(c: Column, size: int) -> Column:
    last = F.length(c) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def inside(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, piece): each distinct word with the pieces of the vocabulary that it stands in. words: word; vocabulary: piece."""
    words = cut(words.select("word").where(F.length("word").between(1, LONGEST)).distinct(), "substring-words")
    vocabulary = cut(vocabulary.select("piece").where(F.col("piece") != "").distinct(), "substring-vocabulary")
    sizes = [r[0] for r in words.select(F.least(F.length("word"), F.lit(3)).alias("n")).distinct().collect()]  # 1, 2 and 3 at most
    if not sizes:
        return words.select("word", F.lit("").alias("piece"))
    parts = vocabulary.select("piece", F.explode(F.array_distinct(F.concat(*[grams(F.col("piece"), n) for n in sorted(sizes)]))).alias("gram"))
    own = F.when(F.length("word") < 3, F.array("word")).otherwise(F.array_distinct(grams(F.col("word"), 3)))
    asked = cut(words.select("word", F.explode(own).alias("gram")), "substring-asked")
    often = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A piece of a word that the vocabulary lacks shows that the word is nowhere.
    counted = asked.join(often, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare")).where(F.col("rare.n") > 0)
    rare = cut(counted.select("word", F.col("rare.gram").alias("gram")), "substring-rare")
    out = cut(parts.join(few(rare), "gram").where(F.contains("piece", "word")).select("word", "piece"), "substring-inside")
    forget(asked, vocabulary, rare, words)
    return out


def literal_word(c: Column) -> Column:
    """The longest run of a pattern without blanks and wildcards, cut at LONGEST; null if it has none."""
    runs = F.filter(F.split(c, r"[\s%_]+"), lambda w: w != "")
    longest = F.array_max(F.transform(runs, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
    return F.substring(longest["w"], 1, LONGEST)


def stands_in(text: Column, keyword: Column) -> Column:
    """Whether the text holds the keyword, whose % is any run of characters and whose _ any one."""
    wild = F.contains(keyword, F.lit("%")) | F.contains(keyword, F.lit("_"))
    pattern = F.concat(F.lit("%"), F.replace(keyword, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.when(wild, F.like(text, pattern)).otherwise(F.contains(text, keyword))


def in_memory(df: DataFrame, *texts: str) -> int:
    """Bytes that the rows of df take where a broadcast has them, which is many times what they take in a file."""
    return df.agg(F.sum(sum((F.octet_length(c) for c in texts), F.lit(96)))).first()[0] or 0


def phrase_hits(phrases: DataFrame, low: DataFrame, rest: list[str], within: list[str]) -> DataFrame:
    """rest and keyword: a row for each place where a phrase stands. phrases: within, keyword; low: rest, _low."""
    first = F.substring_index("keyword", " ", 1)
    phrases = phrases.select(*within, "keyword", first.alias("first"), F.substr("keyword", F.length(first) + 2).alias("behind"))
    phrases = cut(phrases.withColumn("two", F.substring("behind", 1, 2)), "phrases")
    sizes = sorted(r[0] for r in phrases.select(F.length("first")).distinct().collect())  # LONGEST at most
    words = low.select(*rest, F.split("_low", " ").alias("_w"))
    later = lambda n: F.slice("_w", n, F.size("_w"))
    places = words.select(*rest, F.inline(F.arrays_zip("_w", later(2), later(3))).alias("_a", "_b", "_c")).where(F.col("_b").isNotNull())
    ends = F.array(*[F.when(F.length("_a") >= n, F.right("_a", F.lit(n))) for n in sizes])
    places = places.select(*rest, F.concat_ws(" ", "_b", "_c").alias("_behind"), F.explode(ends).alias("first")).withColumn("two", F.substring("_behind", 1, 2))
    phrases = F.broadcast(phrases) if in_memory(phrases, "keyword", "keyword", "keyword") <= AT_ONCE else phrases
    return places.join(phrases, [*within, "first", "two"]).where(F.startswith("_behind", "behind")).select(*rest, "keyword")


def keyword_hits(keywords: DataFrame, docs: DataFrame, text: str, fold=F.lower, within: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns but the text, and keyword: a row for each document and distinct keyword that stands in its folded text.

    keywords: keyword, folded, and the columns `within`, which a document must have the same. Rows of docs that are
    equal are told once. The keyword "" and a null text match nothing; a keyword of wildcards only matches every text
    that is long enough.
    """
    rest = [c for c in docs.columns if c != text]
    every = cut(keywords.select(*within, "keyword").where(F.col("keyword") != "").distinct().withColumn("phrase", F.rlike("keyword", F.lit(PHRASE))), "keywords")
    low = docs.where(F.col(text).isNotNull()).select(*rest, fold(F.col(text)).alias("_low"))
    found = [some_hits(every.where(~F.col("phrase")), low, rest, [*within])]
    if not every.where("phrase").isEmpty():
        found.append(phrase_hits(every.where("phrase"), low, rest, [*within]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def some_hits(keywords: DataFrame, low: DataFrame, rest: list[str], within: list[str]) -> DataFrame:
    """rest and keyword, where any keyword stands, found by its longest word. keywords: within, keyword; low: rest, _low."""
    keywords = cut(keywords.select(*within, "keyword", literal_word(F.col("keyword")).alias("word")), "keywords-others")
    words = low.select(*rest, "_low", F.explode(pieces(F.col("_low"))).alias("piece"))
    found = inside(keywords.select("word"), words.select("piece"))
    # One word that is all of the keyword needs no second look.
    met = keywords.where(F.col("word").isNotNull()).join(found, "word").select(*within, "piece", "keyword", (F.col("word") == F.col("keyword")).alias("sure"))
    met = cut(met, "keywords-met")
    parts = -(-in_memory(met, "piece", "keyword") // AT_ONCE)
    out = None
    for i in range(max(1, parts)):
        some = met if parts <= 1 else cut(met.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == i), "keywords-part")
        hits = words.join(F.broadcast(some), [*within, "piece"]).where(F.col("sure") | stands_in(F.col("_low"), F.col("keyword"))).select(*rest, "keyword")
        # Each part's hits are written, so that one broadcast is held at a time.
        hits = hits if parts <= 1 else cut(hits.distinct(), "keywords-hits")
        out = hits if out is None else out.unionByName(hits)
    # Without a word: blanks and wildcards only. Few such keywords differ, each is held against every text.
    bare = keywords.where(F.col("word").isNull())
    if not bare.isEmpty():
        bare = cut(bare.select(*within, "keyword", F.length(F.regexp_replace("keyword", "%", "")).alias("n"), F.lit(1).alias("_one")), "keywords-bare")
        hits = low.withColumn("_one", F.lit(1)).join(bare, [*within, "_one"]).where((F.length("_low") >= F.col("n")) & stands_in(F.col("_low"), F.col("keyword")))
        out = out.unionByName(hits.select(*rest, "keyword"))
    return out


def names_with_tokens(tokens: DataFrame, names: DataFrame, least: int) -> DataFrame:
    """(query_id, doc_id) candidates: documents of the query's brand whose names may hold `least` of its tokens (repeats counted).

    tokens: query_id, brand, token, times; names: brand, doc_id, name (without blanks). What has `least` tokens has one
    besides the most frequent `least` - 1, so these are not looked up, and a token that all names hold makes no pairs.
    """
    heads = tokens.select("token").distinct().withColumn("word", F.substring("token", 1, LONGEST))
    sliced = names.select("brand", "doc_id", "name", F.explode(pieces(F.col("name"))).alias("piece"))
    found = inside(heads.select("word"), sliced.select("piece"))
    hits = sliced.join(found, "piece").join(heads, "word").where(F.contains("name", "token")).select("brand", "doc_id", "token").distinct()
    hits = cut(hits, "names-hits")
    often = hits.groupBy("brand", "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "token")
    asked = tokens.join(often, ["brand", "token"]).withColumn("_upto", F.sum("times").over(w)).where(F.col("_upto") >= least)
    return cut(asked.select("query_id", "brand", "token").join(hits, ["brand", "token"]).select("query_id", "doc_id").distinct(), "names-candidates")
