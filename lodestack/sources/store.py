"""Tables that are replaced brand by brand, several at once: a reader sees all of a commit or nothing.

Rows are written to folders of a new version; then one small manifest, which names the version that each brand of each
table has, appears under the next number. Until it does, readers see what they saw before, and a write that failed can
be repeated. A commit may carry a writer's batch number; the manifest keeps the last one, so a batch that is replayed
after a crash is known and left out. Two writers that take the same number: the later one gets an error, and repeats.

A manifest has a line for each brand and table, so it grows with brands, not with rows. Folders that no recent manifest
names are removed by :func:`tidy`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BY, VERSION = "brand_slug", "_version"
#: Chunks of a page share lines; this finds them further apart than Spark's usual compression does.
CODEC = "zstd"
EMPTY = {"tables": {}, "schemas": {}, "writers": {}}


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    _, fs, at = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def manifests(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{path}/_commits") if n.endswith(".json") and n[0] != "_" and n[0] != ".")


def manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict]:
    """The number and content of the last manifest, or of the one asked for; number 0 is the empty store."""
    number = max(manifests(spark, path), default=0) if number is None else number
    if not number:
        return 0, json.loads(json.dumps(EMPTY))
    _, fs, at = _files(spark, f"{path}/_commits/{number:012d}.json")
    with_ = fs.open(at)
    try:
        return number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8"))
    finally:
        with_.close()


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """The manifest appears whole, by a rename that fails if the number is taken."""
    hadoop, fs, temp = _files(spark, f"{path}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(temp)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    hadoop.FileContext.getFileContext(temp.toUri(), spark._jsc.hadoopConfiguration()).rename(temp, hadoop.Path(f"{path}/_commits/{number:012d}.json"), plain)


def _folder(spark: SparkSession, brand: str | None) -> str:
    """The name of a brand's folder, as Spark writes it."""
    return f"{BY}={'__HIVE_DEFAULT_PARTITION__' if brand is None else spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(brand)}"


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], touched: Iterable[str | None] = (), writer: str | None = None, batch: int = 0) -> bool:
    """Replace, in each of `tables` (with a column brand_slug), the brands that it has and those in `touched`.

    False if the writer's batch, or a later one, is in the store already; nothing is written then. The tables' rows may
    be read from the store itself: what they are read from stays as it is.
    """
    path = path.rstrip("/")
    number, content = manifest(spark, path)
    if writer is not None and content["writers"].get(writer, -1) >= batch:
        return False
    gone = {_folder(spark, b) for b in touched}
    for name, df in tables.items():
        version = uuid.uuid4().hex
        out = f"{path}/{name}/{VERSION}={version}"
        # A large brand is spread over its documents.
        spread = df.repartition(BY, F.pmod(F.xxhash64("doc_id"), F.lit(64))) if "doc_id" in df.columns else df
        spread.withColumn(BY, F.col(BY).cast("string")).write.partitionBy(BY).parquet(out, compression=CODEC)
        held = content["tables"].setdefault(name, {})
        for folder in gone:
            held.pop(folder, None)
        held.update({n: version for n in _names(spark, out) if n.startswith(f"{BY}=")})
        content["schemas"][name] = T.StructType([f for f in df.schema.fields if f.name != BY]).jsonValue()
    if writer is not None:
        content["writers"][writer] = batch
    _publish(spark, path, number + 1, content)
    return True


def read(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame | None:
    """A table of the last commit, or of an earlier one; None if it was never written. A filter on brand_slug prunes folders."""
    path = path.rstrip("/")
    _, content = manifest(spark, path, number)
    if name not in content["tables"]:
        return None
    schema = T.StructType.fromJson(content["schemas"][name]).add(VERSION, T.StringType()).add(BY, T.StringType())
    found = [f"{path}/{name}/{VERSION}={v}/{folder}" for folder, v in sorted(content["tables"][name].items())]
    if not found:
        return spark.createDataFrame([], schema).drop(VERSION)
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*found).drop(VERSION)


def tidy(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove manifests but the last `keep`, and folders that none of these names; returns how many folders went.

    Not while a commit is being written: its folders are not named yet.
    """
    path = path.rstrip("/")
    numbers = manifests(spark, path)
    named = {(t, v) for n in numbers[-keep:] for t, held in manifest(spark, path, n)[1]["tables"].items() for v in held.values()}
    tables = {t for n in numbers for t in manifest(spark, path, n)[1]["tables"]}
    gone = [f"{path}/{t}/{v}" for t in sorted(tables) for v in _names(spark, f"{path}/{t}") if v.startswith(f"{VERSION}=") and (t, v.removeprefix(f"{VERSION}=")) not in named]
    for old in [*gone, *(f"{path}/_commits/{n:012d}.json" for n in numbers[:-keep])]:
        _, fs, at = _files(spark, old)
        fs.delete(at, True)
    return len(gone)
