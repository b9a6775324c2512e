"""Answers judged against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

def classify_answer(text: Column, n_sources: Column, flagged: Column | None = None) -> Column:
    """CLARIFY if flagged, with a strong marker or an unsourced question early, or if the last sentence asks to choose.

    The last sentence begins behind the last dot that is not among the last five characters, or at the second character.
    """
    c = F.coalesce(text, F.lit(""))
    early = F.lower(F.substring(c, 1, 500))
    marked = early.rlike("|".join(vocab.CLARIFY_MARKERS))
    asks = (n_sources == 0) & early.contains("?")
    head = F.substr(c, F.lit(1), F.greatest(F.length(c) - 5, F.lit(0)))
    dot = F.length(head) - F.length(F.element_at(F.split(head, r"\.", -1), -1))
    last = F.lower(F.substr(c, F.greatest(dot, F.lit(1)) + 1))
    chooses = (n_sources > 0) & c.rlike(r"\?\s*$") & last.rlike("|".join(vocab.CHOICES))
    yes = marked | asks | chooses
    return F.when(yes if flagged is None else yes | F.coalesce(flagged, F.lit(False)), "CLARIFY").otherwise("ANSWER")


def grade_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """id, category, expected, kind, grade.

    cases: id, category, expected, docs, terms, forbidden; answers: id, kind, text, sources and, if told, flagged. No
    answer is an error, a forbidden term a failure. An expected CLARIFY must ask back; an expected ANSWER may only if it
    has one of the terms; DISAMBIGUATE passes either way. What passes is partial if no expected document is part of a
    source's name or of the answer, unless the answer was flagged as asking back.
    """
    if "flagged" not in answers.columns:
        answers = answers.withColumn("flagged", F.lit(False))
    low = F.lower(F.coalesce("text", F.lit("")))
    named = F.lower(F.concat_ws(" ", "sources"))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    has = lambda c: F.exists(listed(c), lambda x: low.contains(F.lower(x)))
    found = F.exists(listed("docs"), lambda x: low.contains(F.lower(x)) | named.contains(F.lower(x)))
    wrong_docs = (F.size(listed("docs")) > 0) & ~found & ~F.coalesce("flagged", F.lit(False))
    asks = F.col("kind") == "CLARIFY"
    passed = F.when(F.col("expected") == "CLARIFY", asks).when(F.col("expected") == "ANSWER", ~asks | has("terms")).otherwise(F.col("expected") == "DISAMBIGUATE")
    grade = F.when(F.col("kind").isNull(), "error").when(has("forbidden") | ~passed, "fail").when(wrong_docs, "partial").otherwise("pass")
    return cases.join(answers, "id", "left").select("id", "category", "expected", "kind", grade.alias("grade"))


def eval_summary(graded: DataFrame) -> DataFrame:
    """Cases and percent of each grade, zeros kept."""
    grades = ("pass", "partial", "fail", "error")
    sums = graded.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("grade") == g).alias(g) for g in grades])
    rows = F.array(*[F.struct(F.lit(g).alias("grade"), F.col(g).alias("n")) for g in grades])
    return sums.select("total", F.explode(rows).alias("r")).select("r.grade", "r.n", F.round(F.col("r.n") * 100 / F.greatest("total", F.lit(1)), 4).alias("percent"))


def category_accuracy(graded: DataFrame) -> DataFrame:
    good = F.count_if(F.col("grade").isin("pass", "partial"))
    return graded.groupBy("category").agg(F.count(F.lit(1)).alias("total"), good.alias("good"), F.round(good / F.count(F.lit(1)), 6).alias("accuracy"))


def failure_breakdown(graded: DataFrame) -> DataFrame:
    kind = F.when((F.col("expected") == "ANSWER") & (F.col("kind") == "CLARIFY"), "over_clarify").when((F.col("expected") == "CLARIFY") & (F.col("kind") == "ANSWER"), "under_clarify").otherwise("other")
    return graded.where(F.col("grade") == "fail").groupBy(kind.alias("failure")).agg(F.count(F.lit(1)).alias("n"))


def behaviour_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy and mean latency by expected behaviour."""
    right = F.count_if(F.col("expected") == F.col("kind"))
    return rows.groupBy("expected").agg(F.count(F.lit(1)).alias("n"), right.alias("right"), F.round(F.avg("elapsed"), 6).alias("mean_elapsed"))


def search_hit_check(ranked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Per query whether the wanted document is among the first k, its best rank, and its chunks' scores."""
    own = ranked.join(wanted, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"), F.min("score").alias("low"), F.max("score").alias("high"))
    rows = wanted.select("query_id").join(own, "query_id", "left")
    return rows.select("query_id", F.coalesce(F.col("rank") <= k, F.lit(False)).alias("hit"), "rank", F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
