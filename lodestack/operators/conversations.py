"""Conversations: order, context, clarification, grouping, pending changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab


def session_messages(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each session: its messages in order. A session is one row by nature; its size is its own."""
    m = F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return messages.groupBy(session).agg(m.alias("messages"))


def last_messages(messages: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def clarification_rounds(messages: Column) -> Column:
    """How often the assistant asked back, from the end: a question counts and skips the user's message before it, an
    answer ends the count; from a user's message on, earlier messages are searched for the assistant's last word."""
    back = F.reverse(messages)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("skip"), F.lit(False).alias("stop"))

    def step(s: Column, m: Column) -> Column:
        asks = (m["role"] == "assistant") & m["text"].contains("?")
        ends = (m["role"] == "assistant") & ~m["text"].contains("?")
        counted = F.struct((s["n"] + 1).alias("n"), F.lit(1).alias("skip"), F.lit(False).alias("stop"))
        ended = F.struct(s["n"].alias("n"), F.lit(0).alias("skip"), F.lit(True).alias("stop"))
        skipped = F.struct(s["n"].alias("n"), (s["skip"] - 1).alias("skip"), F.lit(False).alias("stop"))
        return F.when(s["stop"], s).when(s["skip"] > 0, skipped).when(asks, counted).when(ends, ended).otherwise(s)

    return F.aggregate(back, start, step, lambda s: s["n"])


#: Facets by name: patterns in the order in which the first that matches decides, and the name it then has (None: what
#: matched). Symptoms and error words are fixed values; the models, boards and drives stand for a caller's own.


#: Facets whose names have no spaces, and those told in lower case.
SQUEEZED, LOWER = ("board", "drive"), ("symptom",)


def known_context(text: Column, models, boards, drives) -> list[Column]:
    """One column for each facet: the first pattern in its list that the text matches decides, not the first in the text.

    models, boards, drives: pairs of a pattern for folded text and the name to give, None for the first group in capitals;
    they are the caller's equipment; \\b at a pattern's ends is where a word of letters of any script ends. Boards and drives are named without spaces. Symptoms, error codes and part numbers
    are vocab.FACETS.
    """
    low = F.trim(t.folded(text))
    out = []
    for name, patterns in {"model": models, "board": boards, "drive": drives, **vocab.FACETS}.items():
        found = []
        for p, said in patterns:
            p = t.word_ends(p)
            value = F.lit(said) if said else F.trim(F.regexp_extract(low, p, 1))
            value = value if said or name in LOWER else F.upper(value)
            found.append(F.when(low.rlike(p), F.regexp_replace(value, r"\s+", "") if name in SQUEEZED else value))
        out.append(F.coalesce(*found).alias(name))
    return out


def missing_info() -> Column:
    """Facets still to be asked for, most important first; over the columns of known_context."""
    c = F.col
    return F.array_compact(F.array(F.when(c("model").isNull(), "model"), F.when(c("board").isNull() & c("drive").isNull(), "board or drive"), F.when(c("symptom").isNull() & c("error_code").isNull(), "symptom or error code")))


def enriched_query(texts: Column, query: Column) -> Column:
    """Words of earlier messages and the query, once each whatever their case; the query alone after fewer than two."""
    words = F.filter(F.flatten(F.transform(F.concat(texts, F.array(query)), lambda x: F.split(x, r"\s+"))), lambda w: F.length(w) > 1)
    first = lambda ws, low: F.filter(ws, lambda w, i: F.array_position(low, F.get(low, i)) == i + 1)
    once = t.let(words, lambda ws: t.let(F.transform(ws, F.lower), lambda low: first(ws, low)))
    return F.when(F.size(texts) < 2, query).otherwise(F.array_join(once, " "))


def word_count(low: Column) -> Column:
    return F.regexp_count(low, F.lit(r"[^\s]+"))


def asked_before(role: str, text: Column, earlier) -> Column:
    """Whether the assistant's last message among the two or more before, wherever it stands, has a question mark.

    earlier: the window of a conversation's messages before the one at hand.
    """
    last = F.last(F.when(F.col(role) == "assistant", F.coalesce(text, F.lit(""))), ignorenulls=True).over(earlier)
    return (F.count(F.lit(1)).over(earlier) >= 2) & F.coalesce(F.contains(last, F.lit("?")), F.lit(False))


def needs_clarification(text: Column, asked_before: Column) -> Column:
    """Whether a question is too short or too general to be looked up; an answer to a question never is."""

    def rule(low: Column) -> Column:
        n = word_count(low)
        return (n <= 2) | low.rlike(t.any_word(vocab.TROUBLE)) | ((n <= 4) & low.rlike(t.any_word(vocab.GENERIC_INDICATORS)))

    return F.when(asked_before, False).otherwise(t.let(t.folded(text), rule))


def has_model_code(text: Column, names=()) -> Column:
    return t.folded(text).rlike(t.any_word([*vocab.MODEL_CODES, *names]))


def needs_model(text: Column, told_before: Column) -> Column:
    """Whether a technical question of three words or more names no equipment, now or in what the user said before."""
    asks = t.let(t.folded(text), lambda low: t.technical(low) & (word_count(low) > 2))
    return ~has_model_code(text) & ~told_before & asks


def sessions_by_agent(sessions: DataFrame, agents: DataFrame, agent: str, name: str) -> DataFrame:
    """Sessions of each agent; those of unknown agents have a bucket of their own."""
    counts = sessions.groupBy(agent).agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(agents.select(agent, name), agent, "left")
    return named.groupBy(F.coalesce(name, F.lit("unknown")).alias("agent")).agg(F.sum("n").alias("sessions"))


def merge_pending(log: DataFrame, key: str = "id", seq: str = "seq", op: str = "op") -> DataFrame:
    """The state that a change log leaves: the last change of each id, if that is not a deletion."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), seq).alias("x"))
    return last.where(F.col(f"x.{op}") != "delete").select(key, "x.*")
