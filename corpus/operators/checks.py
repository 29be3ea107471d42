"""Checks that raise when data aren't as stated, and reports of how they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df; when it is read, a key that stands twice raises."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in df.columns if c not in keys))
    fine = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key stands twice: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))).otherwise(F.lit(True))
    return n.where(fine).select(*df.columns)


def row_count(df: DataFrame, want: int) -> int:
    """The number of rows; raises if it isn't the one stated."""
    if (n := df.count()) != want:
        raise ValueError(f"{n} rows, {want} stated")
    return n


def profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """(name, filled, missing) of each column, and `key` with the keys and the rows beyond one of a key."""
    missing = lambda c, t: F.col(c).isNull() | F.isnan(c) if t in ("double", "float") else F.col(c).isNull()
    one = df.agg(*(F.struct(F.count_if(~missing(c, t)).alias("filled"), F.count_if(missing(c, t)).alias("missing")).alias(c) for c, t in df.dtypes))
    cols = one.unpivot([], df.columns, "name", "s").select("name", "s.*")
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("filled"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("missing"))
    return cols.unionByName(again.select(F.lit("key").alias("name"), "filled", "missing"))


def same(a: DataFrame, b: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> None:
    """Raises unless both hold the same rows, doubles within the tolerance."""
    from pyspark.testing import assertDataFrameEqual

    assertDataFrameEqual(a, b, rtol=rtol, atol=atol)


def file_inventory(spark, folder: str) -> DataFrame:
    """(name, bytes, digest) of each file below a folder, the digest as SHA-256 in capitals."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.upper(F.sha2("content", 256)).alias("digest"))


def gate(have: DataFrame, want: DataFrame) -> DataFrame:
    """have, if each file that want (name, digest) states is there with its digest; raises when it is read otherwise."""
    bad = want.select("name", F.col("digest").alias("_want")).join(have, "name", "left")
    message = F.concat(F.lit("file isn't as stated: "), "name")
    fine: Column = F.when(F.coalesce(F.col("digest") != F.col("_want"), F.lit(True)), F.raise_error(message)).otherwise(F.lit(True))
    return bad.where(fine).select(*have.columns)
