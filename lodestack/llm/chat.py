"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, branches ranked, chosen paths formatted.

A message tree is rows (conv_id, msg_id, parent_id, role, text, score). Self-joins by doubling (each message's 1st, 2nd,
4th, ... ancestor) find every message's root and depth in as many rounds as the depth has binary digits. A leaf ranks by
the sum of scores on its path, then depth, then id; the best `paths` of each conversation are formatted. Rows are marked
from a chosen leaf upwards by the same doubling, so no path is held as a list before it is written out; a tree without
branches is its own path. A path meets in one row where it is formatted, so one path must fit in a task's memory.

The template opens a turn with <|role|> and ends it with <|end|>; escaping makes it reversible: in texts and roles a
backslash becomes two, and each control string gets a backslash after its first character. Loss spans, in code points,
cover the assistants' texts only.

Null text: empty. Null role: formatted as the role "unknown". A message with a null or unknown parent, that is its own
ancestor or replies to one that is, starts a tree. Rows that repeat (conv_id, msg_id) keep the one with the least role, then text. Null conv_id
is a conversation of its own. An empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, few, table

OPEN, SHUT, END = "<|", "|>", "<|end|>"
#: Strings that would be read as control strings by this or by common templates.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The first character of a control string, also of one that overlaps another.
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ").", re.S)
_TURN = re.compile(r"<\|((?:[^|\\]|\\.|\|(?!>))*?)\|>\n(.*?)<\|end\|>\n", re.S)


def escape(s: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\!", s.replace("\\", "\\\\"))


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "" if m[1] == "!" else m[1], s, flags=re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string and its loss spans."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SHUT}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def choose_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """Rows (conv_id, k, path, depth, role, text) of the best `paths` root-to-leaf paths of each conversation."""
    k = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("k")
    m = messages.select(k, "conv_id", "msg_id", "parent_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = m.where(F.col("msg_id").isNotNull())
    m = m.groupBy("k", "msg_id").agg(F.min(F.struct("role", "text", "parent_id", "conv_id", "score")).alias("x")).select("k", "msg_id", "x.*")
    m = cut(m, "chat-messages")
    ids = m.select("k", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    links = m.select("k", "msg_id", "parent_id", "score").join(ids, ["k", "parent_id"], "left").select("k", "msg_id", F.when(F.col("known") & (F.col("parent_id") != F.col("msg_id")), F.col("parent_id")).alias("up"), "score")
    # up: the ancestor 2^i above; top: the farthest one known; depth, total: messages and score from this one to below it.
    level = links.select("k", "msg_id", "up", F.coalesce("up", "msg_id").alias("top"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    level = cut(level, "chat-level")
    up = F.col("up").isNotNull()
    size, finished, active = level.count(), [level.where(~up)], level.where(up)
    jumps = [active]
    # Only messages that are not at their root yet go on; they point to such ones or to finished ones.
    while not active.isEmpty() and 1 << (len(jumps) - 1) <= size:
        every = reduce(DataFrame.unionByName, [*finished, active])
        above = every.select("k", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        level = few(active).join(above, ["k", "up"]).select("k", "msg_id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"))
        level = cut(level, "chat-level")
        finished, active = [*finished, level.where(~up)], level.where(up)
        jumps.append(active)
    # What still has an ancestor so far up is on a cycle or below one: each such message is a tree of its own.
    done = reduce(DataFrame.unionByName, finished).select("k", "msg_id", "top", "depth", "total")
    if not active.isEmpty():
        loose = active.select("k", "msg_id")
        own = loose.join(m.select("k", "msg_id", "score"), ["k", "msg_id"]).select("k", "msg_id", F.col("msg_id").alias("top"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
        done = done.unionByName(own)
        jumps = [j.join(few(loose), ["k", "msg_id"], "left_anti") for j in jumps]
    done = cut(done, "chat-done")
    parents = jumps[0].select("k", F.col("up").alias("msg_id")).distinct()
    leaves = cut(done.join(parents, ["k", "msg_id"], "left_anti"), "chat-leaves")
    rank = Window.partitionBy("k").orderBy(F.desc("total"), F.desc("depth"), "msg_id")
    chosen = leaves.withColumn("path", F.row_number().over(rank)).where(F.col("path") <= paths).select("k", "top", "msg_id", "path")
    branching = leaves.groupBy("k", "top").agg((F.count(F.lit(1)) > 1).alias("branches"))
    chosen = cut(chosen.join(branching, ["k", "top"]), "chat-chosen")
    # A tree with one leaf is its path; on the others the path is marked upwards, written in each round.
    straight = done.join(chosen.where(~F.col("branches")).select("k", "top", "path"), ["k", "top"]).select("k", "msg_id", "path", "depth")
    marked = chosen.where(F.col("branches")).select("k", "msg_id", "path")
    if not marked.isEmpty():
        for jump in reversed(jumps):
            more = marked.join(jump.select("k", "msg_id", "up"), ["k", "msg_id"]).select("k", F.col("up").alias("msg_id"), "path")
            marked = cut(marked.unionByName(more).distinct(), "chat-marked")
        straight = straight.unionByName(marked.join(done, ["k", "msg_id"]).select("k", "msg_id", "path", "depth"))
    return straight.join(m.select("k", "msg_id", "conv_id", "role", "text"), ["k", "msg_id"]).select("conv_id", "k", "path", "depth", "role", "text")


def format_paths(rows: DataFrame) -> DataFrame:
    """conv_id, path, formatted, loss (array of start, end): one row for each path; a path's turns meet in its row."""
    turns = rows.groupBy("k", "path").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    turns = turns.select("conv_id", "path", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("path", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            got = [format_turns([(r if r is not None else "unknown", t) for r, t in zip(roles, texts, strict=True)]) for roles, texts in zip(d["roles"], d["texts"], strict=True)]
            loss = [[{"start": a, "end": b} for a, b in spans] for _, spans in got]
            yield pa.RecordBatch.from_arrays([pa.array(d["conv_id"], pa.int64()), pa.array(d["path"], pa.int32()), pa.array([g for g, _ in got], pa.string()), pa.array(loss, pa.list_(span))], schema=schema)

    return turns.mapInArrow(run, "conv_id long, path int, formatted string, loss array<struct<start: long, end: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and digests of what the formatted strings and loss spans hold, told from them alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            d, out = batch.to_pydict(), []
            for c, s, loss in zip(d["conv_id"], d["formatted"], d["loss"], strict=True):
                turns = parse_turns(s)
                told = "".join(unescape(s[x["start"] : x["end"]]) for x in loss)
                out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(told), sha(told), len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_tree(turns: DataFrame) -> DataFrame:
    """Turns of linear conversations as a tree in which each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return turns.select("conv_id", n.alias("msg_id"), F.when(n > 1, n - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_paths(choose_paths(as_tree(turns.unionByName(probe)))))


SQL: dict[str, str] = {
    "op10_chat_format": """
  WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
             UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
  e AS (SELECT *, length(replace(text, '\\', '\\\\')) + 2 * list_sum(list_transform(['<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'], lambda k: (length(text) - length(replace(text, k, ''))) // length(k))) AS body FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
         sum(2 + length(role) + 3 + body + 8)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id"""
}
QUERIES = {"op10_chat_format": op10_chat_format}
