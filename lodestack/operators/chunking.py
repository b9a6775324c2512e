"""Pages to chunks: table rows, windows around codes, broad windows; all inside one row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab

NONE = "array<string>"
#: A class of two parts at most: Java is slow over more of them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028-\u2029]"


def lines_of(c: Column) -> Column:
    """Lines without blanks at their ends, the empty ones left out."""
    return F.filter(F.transform(F.split(c, LINE_END), lambda x: F.trim(x)), lambda x: x != "")


def _key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def first_of_each(chunks: Column, limit: int | None, text=lambda c: c) -> Column:
    """Chunks whose key (spaces and case apart) has not come before, in order. text: what a chunk's text is."""
    if limit is None:
        # Sorted, equal keys stand side by side: a search for each would take the square of a long page's chunks.
        tagged = F.sort_array(F.transform(chunks, lambda c, i: F.struct(_key(text(c)).alias("key"), i.alias("i"), c.alias("c"))))
        fresh = lambda s: F.filter(s, lambda x, i: ~F.get(s, i - 1)["key"].eqNullSafe(x["key"]))
        return F.transform(F.sort_array(F.transform(t.let(tagged, fresh), lambda x: F.struct(x["i"], x["c"]))), lambda x: x["c"])
    # One fold that holds no more than `limit` keys.
    start = F.struct(F.array().cast(NONE).alias("kept"), F.array().cast(NONE).alias("keys"))
    add = lambda s, c, k: F.struct(F.concat(s["kept"], F.array(c)).alias("kept"), F.concat(s["keys"], F.array(k)).alias("keys"))
    step = lambda s, c: F.when(F.size(s["kept"]) >= limit, s).otherwise(t.let(_key(c), lambda k: F.when(F.array_contains(s["keys"], k), s).otherwise(add(s, c, k))))
    return F.aggregate(chunks, start, step, lambda s: s["kept"])


def table_row_chunks(lines: Column, limit: int | None = 4) -> Column:
    """Rows of pipe tables: a first cell with a code opens a row and later lines join it. One fold over the lines."""
    bare = lambda x: F.regexp_replace(x, r"^\|+|\|+$", "")
    first = lambda cells: F.coalesce(F.regexp_extract(F.upper(F.get(cells, F.lit(0))), t.whole_word("[A-Z]{1,4}[0-9]{0,3}"), 0), F.lit(""))
    piped = F.filter(lines, lambda x: x.contains("|"))
    body = F.transform(F.filter(piped, lambda x: ~x.rlike(vocab.TABLE_SEPARATOR)), lambda x: F.struct(x.alias("line"), F.transform(F.split(bare(x), r"\|"), lambda x: F.trim(x)).alias("cells")))
    body = F.transform(body, lambda x: F.struct(x["line"].alias("line"), x["cells"].alias("cells"), first(x["cells"]).alias("code")))
    start = F.struct(F.array().cast(NONE).alias("done"), F.lit("").alias("open"), F.lit("").alias("code"))
    closed = lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        opens = F.struct(closed(s).alias("done"), x["line"].alias("open"), x["code"].alias("code"))
        rest = F.array_join(F.slice(x["cells"], F.lit(2), F.greatest(F.size(x["cells"]) - 1, F.lit(0))), " | ")
        line = F.when((s["code"] != "") & (F.get(x["cells"], F.lit(0)) == ""), F.concat(F.lit("| "), s["code"], F.lit(vocab.CONTINUED), rest)).otherwise(x["line"])
        joins = F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit("\n"), line).alias("open"), s["code"].alias("code"))
        return F.when(x["code"] != "", opens).when(s["open"] != "", joins).otherwise(s)

    long = F.filter(F.aggregate(body, start, step, closed), lambda c: F.length(c) >= 40)
    return F.when(F.size(piped) >= 3, first_of_each(long, limit)).otherwise(F.array().cast(NONE))


def _span(at, n, least: int) -> Column:
    return F.struct(at.alias("at"), n.alias("n"), F.lit(least).alias("least"))


def _window(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["at"], span["n"]), "\n")


def _windows(lines: Column, spans) -> Column:
    """Texts of the spans that reach their least length."""
    return t.let(lines, lambda ls: F.transform(F.filter(F.transform(spans(ls), lambda s: F.struct(_window(ls, s).alias("c"), s["least"].alias("least"))), lambda x: F.length(x["c"]) >= x["least"]), lambda x: x["c"]))


def code_spans(hits: Column) -> Column:
    """For each line with a code (hits: booleans) the lines (first, from 1, and number): one before to four after."""
    at = F.filter(F.transform(hits, lambda hit, i: F.when(hit, i + 1)), lambda i: i.isNotNull())
    return F.transform(at, lambda i: _span(F.greatest(i - 1, F.lit(1)), F.when(i == 1, 5).otherwise(6), 60))


def broad_spans(n: Column) -> Column:
    """Windows of 12 of n lines (9 for a page of up to 35), three lines shared."""
    width = F.when(n > 35, 12).otherwise(9)
    step = F.greatest(F.lit(4), width - 3)
    # The last start is the first whose window reaches the end.
    last = F.greatest(F.lit(0), F.ceil((n - width) / step).cast("int") * step)
    starts = F.when(n > 0, F.sequence(F.lit(0), last, step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: _span(s + 1, width, 120))


def code_line_windows(lines: Column, hits: Column) -> Column:
    """For each line with a code (hits: booleans): one line before to four after, 60 characters at least."""
    return _windows(lines, lambda ls: code_spans(hits))


def broad_windows(lines: Column) -> Column:
    """Windows of 12 lines (9 for a page of up to 35), three lines shared, 120 characters at least."""
    return _windows(lines, lambda ls: broad_spans(F.size(ls)))


def code_hits(lines: Column) -> Column:
    return F.transform(lines, lambda x: t.has_fault_code(x))


def all_chunks(lines: Column) -> Column:
    """All chunks of a long page: c, and the lines that it has (at, n), n = 0 for table rows, which change their lines."""
    tables = F.transform(table_row_chunks(lines, None), lambda c: _chunk(c, F.lit(0), F.lit(0), F.lit(0)))
    windows = F.transform(F.concat(code_spans(code_hits(lines)), broad_spans(F.size(lines))), lambda s: _chunk(_window(lines, s), s["at"], s["n"], s["least"]))
    return first_of_each(F.concat(tables, F.filter(windows, lambda x: F.length(x["c"]) >= x["least"])), None, lambda x: x["c"])


def _chunk(c: Column, at: Column, n: Column, least: Column) -> Column:
    return F.struct(c.alias("c"), at.alias("at"), n.alias("n"), least.alias("least"))


#: Lines whose code windows are made before those of all.
EARLY = 24


def build_chunks(pages: DataFrame, text: str = "text", max_chunks: int | None = 8) -> DataFrame:
    """pages with an array `chunks`. A short page is one chunk, an empty one none; long pages keep the first max_chunks
    of table rows, code windows and broad windows (None: all, which reaches the end of the page)."""
    c = F.trim(F.coalesce(F.col(text), F.lit("")))
    prepared = pages.withColumn("_text", c)
    if max_chunks is None:
        kept = F.transform(t.let(lines_of(F.col("_text")), all_chunks), lambda x: x["c"])
    else:
        rows = lambda ls: table_row_chunks(ls, 4)
        whole = lambda ls: first_of_each(F.concat(rows(ls), code_line_windows(ls, code_hits(ls)), broad_windows(ls)), max_chunks)
        # The first lines nearly always give enough; only where they do not are all windows of the page made.
        early = lambda ls: first_of_each(F.concat(rows(ls), code_line_windows(ls, code_hits(F.slice(ls, 1, EARLY)))), max_chunks)
        kept = t.let(lines_of(F.col("_text")), lambda ls: t.let(early(ls), lambda e: F.when(F.size(e) >= max_chunks, e).otherwise(whole(ls))))
    some = t.let(kept, lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array("_text")))
    chunks = F.when(F.col("_text") == "", F.array().cast(NONE)).when(F.length("_text") <= 2000, F.array("_text")).otherwise(some)
    return prepared.withColumn("chunks", chunks).drop("_text")


def numbered(pages: DataFrame, kept: list, chunks: Column, at: str, chunk: str) -> DataFrame:
    """kept with one row for each chunk and its place. Before a plain posexplode Spark adds a filter on the array, which
    would make all chunks of a page once or twice more; the outer form has none, and its rows of empty arrays go here."""
    return pages.select(*kept, F.posexplode_outer(chunks).alias(at, chunk)).where(F.col(at).isNotNull())


def whole_records(text: Column) -> Column:
    """All chunks of a page: text, and the signals of all of it. Windows share lines, whose signals are worked out once."""
    page = F.trim(F.coalesce(text, F.lit("")))
    record = lambda c, signals: F.struct(c.alias("text"), signals.alias("signals"))
    alone = lambda c: F.transform(F.array(c), lambda c: record(c, t.domain_signals(c, None, None)))
    of_window = lambda x, known: record(x["c"], F.when(x["n"] > 0, t.joined_signals(x["c"], F.slice(known, x["at"], x["n"]))).otherwise(t.domain_signals(x["c"], None, None)))
    windows = lambda ls, cs: t.let(F.transform(ls, t.line_signals), lambda known: F.transform(cs, lambda x: of_window(x, known)))
    long = t.let(lines_of(page), lambda ls: t.let(all_chunks(ls), lambda cs: F.when(F.size(cs) > 0, windows(ls, cs)).otherwise(alone(page))))
    return F.when(page == "", F.filter(alone(page), lambda x: F.lit(False))).when(F.length(page) <= 2000, alone(page)).otherwise(long)


def chunk_records(pages: DataFrame, brand: str, doc: str, name: str, page: str, text: str = "text", max_chunks: int | None = None, chars: int | None = None, most: int | None = None) -> DataFrame:
    """One row for each chunk with its signals; ids follow from place, so doing it again gives the same ids.

    All chunks and the signals of all their text, unless max_chunks, or chars and most (see domain_signals), are given.
    """
    if max_chunks is chars is most is None:
        chunked, chunk, signals = pages.withColumn("chunks", whole_records(F.col(text))), F.col("_chunk.text"), F.col("_chunk.signals")
    else:
        chunked, chunk, signals = build_chunks(pages, text, max_chunks), F.col("_chunk"), t.domain_signals("_chunk", chars, most)
    kept = [F.col(brand).alias("brand_slug"), F.col(doc).alias("doc_id"), F.col(name).alias("doc_filename"), F.col(page).alias("page_number"), F.size("chunks").alias("chunk_total")]
    rows = numbered(chunked, kept, F.col("chunks"), "chunk_index", "_chunk")
    key = F.sha2(F.concat_ws("\x1f", "brand_slug", "doc_id", "page_number", "chunk_index"), 256)
    return rows.select(key.alias("id"), "brand_slug", "doc_id", "doc_filename", "page_number", chunk.alias("text"), "chunk_index", "chunk_total", signals.alias("signals"))


def embed(chunks: DataFrame, embed_fn, dimension: int, text: str = "text") -> DataFrame:
    """chunks with `vector`: embed_fn maps a pandas Series of texts to one of float lists, batch by batch."""
    from pyspark.sql import types as T

    def run(batches):
        for pdf in batches:
            vectors = embed_fn(pdf[text])
            if any(len(v) != dimension for v in vectors):
                raise ValueError(f"expected vectors of {dimension} components")
            yield pdf.assign(vector=vectors)

    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def best_extraction(candidates: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n candidates of each page (or group) by the given order; Spark keeps n of each before it shuffles."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n).drop("_rank")


def pages_to_process(documents: DataFrame, done: DataFrame, doc: str = "doc_id", total: str = "total_pages") -> DataFrame:
    """(doc, page) from 1 to the document's total without a finished page. Documents with no pages give no rows."""
    wanted = documents.where(F.col(total) > 0).select(doc, F.explode(F.sequence(F.lit(1), F.col(total).cast("int"))).alias("page_number"))
    return wanted.join(done.select(doc, F.col("page_number").cast("int").alias("page_number")), [doc, "page_number"], "left_anti")


def backfill_signals(chunks: DataFrame) -> DataFrame:
    """chunks with signals computed anew where they are missing or empty, and whether that was done."""
    s = F.col("signals")
    needs = s.isNull() | ((F.size(s["topics"]) <= 0) & (F.size(s["controller_tokens"]) <= 0) & (F.size(s["fault_tokens"]) <= 0))
    needs &= F.coalesce(F.trim("text"), F.lit("")) != ""
    return chunks.withColumns({"updated": needs, "signals": F.when(needs, t.domain_signals("text")).otherwise(s)})


def stale_small_pages(pages: DataFrame, chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Pages short enough for one chunk that have more: they were indexed under other rules."""
    n = F.length(F.trim(text))
    counts = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_chunks")).where(F.col("n_chunks") > 1)
    return pages.where((n > 0) & (n <= 2000)).select(*keys).join(counts, keys)
