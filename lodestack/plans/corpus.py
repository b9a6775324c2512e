"""Queries of storage, chunking, audits and reports, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import audit, chunking
from ..sources import tables as s
from ..sources.tables import load
from .text import FILE_NORM, HAS_FAULT

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def parts(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


def order_docs(spark, d):
    """Orders as documents: F completed, O processing, P error."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("error")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("brand_id"), status.alias("status"), F.col("o_orderdate").alias("uploaded"), F.col("o_totalprice").alias("price"), "o_orderpriority")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'error' END"

# Sources and sinks


@query("s1_load_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in s.TABLES))
def s1(spark, d):
    out = None
    for n, df in s.load_tables(spark, d).items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def chunks_of(spark, d):
    return load(spark, d, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("id"), F.col("source").alias("brand_slug"), "doc_id", F.lit(1).alias("page_number"), F.concat_ws("/", "source", "lang").alias("doc_filename"), F.length("text").alias("n"))


@query("s2_file_inventory")
def s2(spark, d):
    return s.file_inventory(spark, d, "*.parquet")


@query("s3_read_write_chunks", "SELECT brand_slug, count(*) AS n, sum(n)::BIGINT AS chars FROM (SELECT source AS brand_slug, length(text) AS n FROM documents) GROUP BY 1")
def s3(spark, d):
    from ..sources.scratch import folder

    path = folder(spark, "chunks")
    s.write_chunks(chunks_of(spark, d), path)
    return s.read_chunks(spark, path).groupBy("brand_slug").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))


@query("s4_upsert_chunks", "SELECT source AS brand_slug, doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE length(text) END AS n FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0")
def s4(spark, d):
    c = chunks_of(spark, d)
    old, new = c.where(F.col("doc_id") % 5 != 0), c.where(F.col("doc_id") % 3 == 0).withColumn("n", F.lit(-1))
    return s.upsert_chunks(s.upsert_chunks(old, new), new).select("brand_slug", "doc_id", "n")


@query("s5_delete_documents", "WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM g) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM g)")
def s5(spark, d):
    orders = load(spark, d, "orders")
    left = s.delete_documents({"orders": (orders, "o_orderkey"), "lineitem": (load(spark, d, "lineitem"), "l_orderkey")}, orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")))
    return left["orders"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("name"), "n").unionByName(left["lineitem"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("name"), "n"))


@query("s6_merge_collections", "SELECT doc_id, CASE WHEN source = 'src3' THEN 'src4' ELSE source END AS brand_slug, CASE WHEN source = 'src3' THEN 'src4/' || lang ELSE source || '/' || lang END AS doc_filename FROM documents")
def s6(spark, d):
    return s.merge_collections(chunks_of(spark, d), "src3", "src4").select("doc_id", "brand_slug", "doc_filename")


@query("s7_eval_results")
def s7(spark, d):
    from ..sources.scratch import cut
    from .usage import graded

    path = cut(spark.range(1), "eval").inputFiles()[0].rsplit("/", 1)[0] + "-json"
    s.write_eval_results(graded(spark, d).select("id", F.col("grade").alias("passed")), path)
    return spark.read.schema("id int, passed string").json(path).groupBy("passed").agg(F.count(F.lit(1)).alias("n"))


@query("s8_parse_sources", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE false UNION ALL SELECT event_id, 'x' || (event_id % 7) FROM events WHERE event_id % 2 = 0")
def s8(spark, d):
    e = load(spark, d, "events").select("event_id")
    text = F.when(F.col("event_id") % 2 == 0, F.format_string('[{"filename": "x%d", "page": 1, "score": 0.5}]', F.col("event_id") % 7))
    return e.select("event_id", F.explode(s.parse_sources(text)).alias("c")).select("event_id", F.col("c.filename").alias("k"))


# Chunking

_LINES = r"list_filter(list_transform(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(x)), lambda x: x <> '')"
_P = f"p AS (SELECT doc_id, t, {_LINES} AS l FROM (SELECT doc_id, trim(text) AS t FROM documents WHERE text IS NOT NULL))"
_BROAD = """list_filter(list_transform(range(0, greatest(0, ceil((length(l) - w) / st)::BIGINT) + 1), lambda k: array_to_string(l[k * st + 1 : k * st + w], chr(10))), lambda c: length(c) >= 120)"""


@query("c4_broad_windows", f"WITH {_P}, q AS (SELECT *, CASE WHEN length(l) > 35 THEN 12 ELSE 9 END AS w, CASE WHEN length(l) > 35 THEN 9 ELSE 6 END AS st FROM p WHERE length(l) > 0), c AS (SELECT doc_id, {_BROAD} AS c FROM q) SELECT doc_id, length(c) AS n, md5(array_to_string(c, '#')) AS h FROM c")
def c4(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", chunking.lines_of(F.trim("text")).alias("l")).where(F.size("l") > 0)
    w = docs.select("doc_id", chunking.broad_windows(F.col("l")).alias("c"))
    return w.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "#")).alias("h"))


_HITS = "list_filter(range(1, length(l) + 1), lambda i: " + HAS_FAULT.format(x="l[i]") + ")"
_CODE = "list_filter(list_transform(h, lambda i: array_to_string(l[greatest(1, i - 1) : i + 4], chr(10))), lambda c: length(c) >= 60)"


@query("c3_code_line_windows", f"WITH {_P}, q AS (SELECT *, {_HITS} AS h FROM p), c AS (SELECT doc_id, {_CODE} AS c FROM q) SELECT doc_id, length(c) AS n, md5(array_to_string(c, '#')) AS h FROM c")
def c3(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", chunking.lines_of(F.trim("text")).alias("l"))
    w = docs.select("doc_id", t.let(F.col("l"), lambda ls: chunking.code_line_windows(ls, F.transform(ls, lambda x: t.has_fault_code(x)))).alias("c"))
    return w.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "#")).alias("h"))


@query("c2_table_row_chunks")
def c2(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").contains("|")).select("doc_id", chunking.lines_of(F.trim("text")).alias("l"))
    return chunking.numbered(docs, ["doc_id"], chunking.table_row_chunks(F.col("l")), "i", "chunk")


@query("c1_short_pages", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE 1 END AS n FROM documents WHERE length(trim(text)) <= 2000")
def c1(spark, d):
    docs = load(spark, d, "documents").where(F.length(F.trim("text")) <= 2000)
    return chunking.build_chunks(docs).select("doc_id", F.size("chunks").alias("n"))


_KEY = r"lower(trim(regexp_replace(c, '\s+', ' ', 'g')))"


@query("c5_build_chunks", f"""WITH {_P}, q AS (SELECT *, {_HITS} AS h, CASE WHEN length(l) > 35 THEN 12 ELSE 9 END AS w, CASE WHEN length(l) > 35 THEN 9 ELSE 6 END AS st FROM p WHERE length(t) > 2000 AND NOT contains(t, '|')),
  a AS (SELECT doc_id, t, list_concat({_CODE}, {_BROAD}) AS a FROM q), u AS (SELECT doc_id, unnest(a) AS c, unnest(range(1, length(a) + 1)) AS i FROM a),
  f AS (SELECT doc_id, c, i, row_number() OVER (PARTITION BY doc_id, {_KEY} ORDER BY i) AS k FROM u), g AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM f WHERE k = 1),
  x AS (SELECT doc_id, c, i - 1 AS i FROM g WHERE i <= 8 UNION ALL SELECT doc_id, t, 0 FROM a WHERE length(a) = 0 UNION ALL SELECT doc_id, t, 0 FROM p WHERE length(t) <= 2000 AND t <> '' AND NOT contains(t, '|'))
  SELECT doc_id, i AS chunk_index, md5(c) AS h FROM x""")
def c5(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull() & ~F.col("text").contains("|"))
    return chunking.numbered(chunking.build_chunks(docs), ["doc_id"], F.col("chunks"), "chunk_index", "c").select("doc_id", "chunk_index", F.md5("c").alias("h"))


def records(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", "source", F.lit(1).alias("page"), F.concat_ws("-", "source", "lang").alias("name"))
    return chunking.chunk_records(docs, "source", "doc_id", "name", "page", max_chunks=8, chars=6000, most=20)


@query("c6_chunk_records")
def c6(spark, d):
    return records(spark, d).select("id", "brand_slug", "doc_id", "chunk_index", "chunk_total", F.md5("text").alias("h"), F.array_join("signals.fault_tokens", " ").alias("faults"))


@query("c7_pages_to_process", "WITH t AS (SELECT l_orderkey AS doc_id, max(l_linenumber)::INT AS total_pages FROM lineitem GROUP BY 1) SELECT doc_id, p AS page_number FROM (SELECT doc_id, unnest(range(1, total_pages + 1)) AS p FROM t) w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id AND l_linenumber = p AND l_returnflag <> 'R')")
def c7(spark, d):
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), "l_returnflag")
    docs = lines.groupBy("doc_id").agg(F.max("page_number").alias("total_pages"))
    return chunking.pages_to_process(docs, lines.where("l_returnflag <> 'R'"))


@query("c8_backfill_signals")
def c8(spark, d):
    old = records(spark, d).withColumn("signals", F.when(F.col("doc_id") % 2 == 0, F.col("signals")))
    new = chunking.backfill_signals(old)
    return new.groupBy("brand_slug").agg(F.count(F.lit(1)).alias("seen"), F.count_if("updated").alias("updated"))


@query("c9_stale_small_pages", "WITH c AS (SELECT source, lang, count(*) AS n_chunks FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2 HAVING count(*) > 1), p AS (SELECT DISTINCT source, lang FROM documents WHERE length(trim(text)) BETWEEN 1 AND 2000) SELECT source, lang, n_chunks FROM p JOIN c USING (source, lang)")
def c9(spark, d):
    docs = load(spark, d, "documents")
    return chunking.stale_small_pages(docs, docs.where("doc_id % 3 = 0"), ["source", "lang"]).distinct()


# Audits


@query("d1_exact_duplicates", "SELECT lower(p_name) AS name, p_brand AS brand, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def d1(spark, d):
    """The ids as one text for each name, as the query asks; duplicate_members has them as rows."""
    members = audit.duplicate_members(parts(spark, d), "id", "name", "brand").groupBy("name", "brand", "n").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return members.select("name", "brand", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("d1_duplicate_members", "SELECT lower(p_name) AS name, p_brand AS brand, count(*) OVER w AS n, min(p_partkey) OVER w AS first, p_partkey AS id FROM part WINDOW w AS (PARTITION BY lower(p_name), p_brand) QUALIFY count(*) OVER w > 1")
def d1_members(spark, d):
    return audit.duplicate_members(parts(spark, d), "id", "name", "brand")


_TITLES = "n AS (SELECT DISTINCT ON (name) doc_id AS id, lower(trim(substr(string_split(text, chr(10))[1], 1, (5 + doc_id % 9)::INT))) AS name FROM documents WHERE text IS NOT NULL ORDER BY name, doc_id)"


@query("d2_similar_names", f"WITH {_TITLES} SELECT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2 FROM n a JOIN n b ON a.name <> b.name AND a.name <> '' AND contains(b.name, a.name)")
def d2(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull())
    name = F.lower(F.trim(F.substr(F.split("text", "\n")[0], F.lit(1), (5 + F.col("doc_id") % 9).cast("int"))))
    docs = docs.groupBy(name.alias("name")).agg(F.min("doc_id").alias("id"))
    return audit.similar_names(docs, "id", "name")


@query("d2_similar_first_lines")
def d2_whole(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull())
    docs = docs.groupBy(F.lower(F.trim(F.split("text", "\n")[0])).alias("name")).agg(F.min("doc_id").alias("id"))
    return audit.similar_names(docs, "id", "name", gram=16)


_N = FILE_NORM.format(x="p_name")


@query("d3_flag_duplicates", f"SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND {_N} <> '' AND (p_brand, {_N}) IN (SELECT (p_brand, {_N}) FROM part WHERE p_partkey % 2 = 1)")
def d3(spark, d):
    p = parts(spark, d)
    return audit.flag_duplicates(p.where("id % 2 = 0"), p.where("id % 2 = 1"), "name", "brand").select("id")


@query("d4_dedupe_batch", f"SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand, {_N} ORDER BY p_partkey) > 1 AND {_N} <> '' AS skipped FROM part")
def d4(spark, d):
    return audit.dedupe_batch(parts(spark, d), "id", "name", "brand").select("id", "skipped")


@query("d5_near_duplicate_groups")
def d5(spark, d):
    docs = load(spark, d, "documents").where(F.col("text").isNotNull())
    names = docs.select("doc_id", F.split("text", "\n")[0].alias("name"))
    return audit.near_duplicate_groups(names, "doc_id", "name")


@query("d6_choose_keeper", f"SELECT o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN {STATUS} = 'completed' THEN 0 ELSE 1 END, o_orderkey) = 1 AS keep FROM orders")
def d6(spark, d):
    return audit.choose_keeper(order_docs(spark, d), "brand_id", "doc_id", "status").select("doc_id", "keep")


@query("d7_orphans", "SELECT 'no document' AS side, page_id AS id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT 'no page', doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT page_id FROM pages)")
def d7(spark, d):
    files, docs = load(spark, d, "pages").select(F.col("page_id").alias("id")), load(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return audit.orphans(files, docs, ["id"]).select(F.lit("no document").alias("side"), "id").unionByName(audit.orphans(docs, files, ["id"]).select(F.lit("no page").alias("side"), "id"))


@query("d8_vectors_per_document", "SELECT o_orderkey AS doc_id, count(l_orderkey) AS vectors, count(l_orderkey) = 0 AS missing FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def d8(spark, d):
    lines = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"))
    return audit.vectors_per_document(order_docs(spark, d), lines, "doc_id")


@query("d9_compact_names", "WITH c AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY lower(regexp_replace(p_name, '[ _-]', '', 'g'))) AS first FROM part) SELECT id, first FROM c WHERE id > first")
def d9(spark, d):
    return audit.compact_name_duplicates(parts(spark, d), "id", "name")


@query("d10_visible_brands", "SELECT s_suppkey AS user_id, n_nationkey AS brand_id FROM supplier, nation WHERE s_suppkey % 10 = 0 OR s_nationkey = n_nationkey")
def d10(spark, d):
    sup = load(spark, d, "supplier")
    users = sup.select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") % 10 == 0).alias("is_admin"))
    return audit.visible_brands(load(spark, d, "nation").select(F.col("n_nationkey").alias("brand_id")), users, sup.select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("brand_id")))


def coverage(spark, d):
    brands = load(spark, d, "customer").select(F.col("c_custkey").alias("brand_id"), F.col("c_name").alias("name"))
    agents = load(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("brand_id"), F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("name"))
    return audit.brand_agent_coverage(brands, order_docs(spark, d), agents)


_COVER = """a AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS brand_id, lower(replace(s_name, 'Supplier', 'Customer')) AS name FROM supplier),
  v AS (SELECT c_custkey AS brand_id, c_name AS name, (c_custkey IN (SELECT brand_id FROM a WHERE brand_id IS NOT NULL) OR lower(c_name) IN (SELECT name FROM a)) AS covered FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))"""


@query("d11_brand_agent_coverage", f"WITH {_COVER} SELECT brand_id, covered FROM v")
def d11(spark, d):
    return coverage(spark, d).select("brand_id", "covered")


@query("d12_agents_per_brand", "SELECT s_nationkey AS brand_id, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1")
def d12(spark, d):
    return audit.agents_per_brand(load(spark, d, "supplier").select(F.col("s_nationkey").alias("brand_id")))


@query("d13_missing_agents", f"WITH {_COVER}, g AS (SELECT *, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM v WHERE NOT covered), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY brand_id) AS k FROM g) SELECT 'brand-' || slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id, brand_id FROM r")
def d13(spark, d):
    return audit.missing_agent_rows(coverage(spark, d)).select("id", "brand_id")


@query("d14_agents_with_brand", "SELECT s_suppkey AS id, n_name AS brand FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey + 1")
def d14(spark, d):
    nation = load(spark, d, "nation").select((F.col("n_nationkey") - 1).alias("s_nationkey"), F.col("n_name").alias("brand"))
    return load(spark, d, "supplier").join(nation, "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), "brand")


# Reports


@query("a1_status_counts", f"SELECT {STATUS} AS status, count(*) AS n FROM orders GROUP BY 1")
def a1(spark, d):
    return order_docs(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("a2_page_stats", "SELECT source, count(*) AS pages, round(avg(coalesce(length(text), 0)), 6) AS avg_len, min(coalesce(length(text), 0)) AS min_len, max(coalesce(length(text), 0)) AS max_len, count(*) FILTER (coalesce(length(text), 0) < 50) AS short, count(*) FILTER (doc_id % 2 = 0) AS embedded FROM documents GROUP BY 1")
def a2(spark, d):
    return audit.page_stats(load(spark, d, "documents"), "source", "text", F.col("doc_id") % 2 == 0)


@query("a3_corpus_stats", "SELECT count(*) AS pages, coalesce(sum(length(text)), 0)::BIGINT AS chars, floor(coalesce(sum(length(text)), 0) / greatest(count(*), 1))::BIGINT AS mean_chars, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty, count(*) FILTER (length(text) BETWEEN 1 AND 29) AS short FROM documents")
def a3(spark, d):
    return audit.corpus_stats(load(spark, d, "documents"), "text")


@query("a4_short_pages", "SELECT source, count(*) AS n FROM documents WHERE text IS NULL OR length(text) < 100 GROUP BY 1")
def a4(spark, d):
    return load(spark, d, "documents").where(F.col("text").isNull() | (F.length("text") < 100)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("a5_completeness", "WITH p AS (SELECT doc_id % 700 AS doc_id, doc_id AS page, text FROM documents), g AS (SELECT doc_id, count(*) AS rows, count(*) FILTER (length(trim(coalesce(text, ''))) >= 20) AS text_ok, count(*) FILTER (length(trim(coalesce(text, ''))) < 20) AS text_short, count(*) FILTER (page % 2 = 0) AS embedded FROM p GROUP BY 1) SELECT d.doc_id, coalesce(rows, 0) AS rows, coalesce(text_ok, 0) AS text_ok, coalesce(text_short, 0) AS text_short, coalesce(embedded, 0) AS embedded FROM documents d LEFT JOIN g USING (doc_id)")
def a5(spark, d):
    docs = load(spark, d, "documents")
    pages = docs.select((F.col("doc_id") % 700).alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return audit.completeness(docs, pages, "doc_id", "text", F.col("page") % 2 == 0)


@query("a6_zero_size_report", f"SELECT {STATUS} AS status, count(*) AS n, count(*) FILTER (o_totalprice < 1000 OR o_totalprice IS NULL) AS zero_size, coalesce(sum(o_totalprice) FILTER (o_totalprice < 1000), 0)::DOUBLE AS amount FROM orders GROUP BY 1")
def a6(spark, d):
    small = F.col("price").isNull() | (F.col("price") < 1000)
    return order_docs(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(small).alias("zero_size"), F.round(F.coalesce(F.sum(F.when(F.col("price") < 1000, F.col("price"))), F.lit(0.0)), 2).alias("amount"))


SQL["a6_zero_size_report"] = SQL["a6_zero_size_report"].replace("coalesce(sum(o_totalprice) FILTER (o_totalprice < 1000), 0)::DOUBLE", "round(coalesce(sum(o_totalprice) FILTER (o_totalprice < 1000), 0)::DOUBLE, 2)")


@query("a7_brand_totals", "SELECT c_custkey AS brand_id, count(o_orderkey) AS docs, count(o_orderkey) FILTER (o_orderstatus = 'F') AS processed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a7(spark, d):
    docs = order_docs(spark, d).groupBy("brand_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("status") == "completed").alias("processed"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("brand_id")).join(docs, "brand_id", "left").na.fill(0)


@query("a8_latest_documents", "SELECT o_custkey AS brand_id, o_orderkey AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3")
def a8(spark, d):
    return chunking.best_extraction(order_docs(spark, d), ["brand_id"], [F.desc("uploaded"), F.desc("doc_id")], 3).select("brand_id", "doc_id")


@query("a9_processing_duration", "SELECT o_orderkey AS doc_id, date_diff('day', o_orderdate::DATE, max(l_shipdate)::DATE)::BIGINT AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def a9(spark, d):
    last = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_shipdate").alias("done"))
    return order_docs(spark, d).join(last, "doc_id").select("doc_id", F.datediff("done", "uploaded").cast("long").alias("days"))


@query("a10_progress", "SELECT l_orderkey AS doc_id, floor(count(*) FILTER (l_linestatus = 'F') * 100.0 / count(*))::BIGINT AS percent, CASE WHEN count(*) FILTER (l_linestatus = 'F') = count(*) THEN 'done' WHEN count(*) FILTER (l_linestatus = 'F') = 0 THEN 'waiting' ELSE 'working' END AS public_status FROM lineitem GROUP BY 1")
def a10(spark, d):
    n, f = F.count(F.lit(1)), F.count_if(F.col("l_linestatus") == "F")
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.floor(f * 100 / n).alias("percent"), F.when(f == n, "done").when(f == 0, "waiting").otherwise("working").alias("public_status"))


@query("a11_final_status", """WITH d AS (SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'N') AS processed FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, 'page ' || l_linenumber AS message FROM lineitem WHERE l_returnflag = 'R'),
  m AS (SELECT doc_id, string_agg(message, '; ' ORDER BY seq) AS message FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM e) WHERE k <= 5 GROUP BY 1)
  SELECT d.doc_id, CASE WHEN message IS NULL THEN 'completed' WHEN processed = 0 THEN 'error' ELSE 'completed_with_errors' END AS final_status, CASE WHEN message IS NOT NULL AND processed = 0 THEN message END AS error_message FROM d LEFT JOIN m USING (doc_id)""")
def a11(spark, d):
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), "l_returnflag")
    docs = lines.groupBy("doc_id").agg(F.count_if(F.col("l_returnflag") == "N").alias("processed"))
    errors = lines.where("l_returnflag = 'R'").select("doc_id", "seq", F.concat(F.lit("page "), "seq").alias("message"))
    return audit.final_status(docs, errors, "doc_id")


@query("a12_recover_orphans", f"SELECT o_orderkey AS doc_id, CASE WHEN {STATUS} = 'processing' THEN 'error' ELSE {STATUS} END AS status, CASE WHEN {STATUS} = 'processing' THEN coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'own' END, 'interrupted') WHEN o_orderkey % 2 = 0 THEN 'own' END AS message FROM orders")
def a12(spark, d):
    docs = order_docs(spark, d).withColumn("message", F.when(F.col("doc_id") % 2 == 0, "own"))
    stuck = F.col("status") == "processing"
    return docs.select("doc_id", F.when(stuck, "error").otherwise(F.col("status")).alias("status"), F.when(stuck, F.coalesce("message", F.lit("interrupted"))).otherwise(F.col("message")).alias("message"))


@query("a13_keyword_flags", "SELECT doc_id, contains(lower(text), 'license')::INT AS license, contains(lower(text), 'token')::INT AS token, contains(lower(text), 'idiot')::INT AS idiot FROM documents")
def a13(spark, d):
    low = F.lower("text")
    return load(spark, d, "documents").select("doc_id", *[F.contains(low, F.lit(w)).cast("int").alias(w) for w in ("license", "token", "idiot")])


