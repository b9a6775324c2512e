"""What the operators of this subpackage share: reading tables, cutting lineage (see sources.scratch), words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable
from ..sources.scratch import cut, few, folder, forget

__all__ = ["UPPER", "WS", "ascii_lower", "cut", "few", "folder", "forget", "held_out", "quantised", "table"]

#: The ASCII white space that separates words.
WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the fast way where the string is all ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vectors with x, floor(scale * entry) as long, in place of embedding; rows without a vector of finite entries are dropped."""
    finite = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(*[c for c in vectors.columns if c != "embedding"], x.alias("x"))
