"""Samples, splits and matched data sets, drawn by hash order so that SQL can draw the same.

The order within a stratum is that of md5(key): it depends on nothing but the key. A stratum is never ranked in one task
unless it is small: the first n of each salt come first, then the first n of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 64


def first_by_hash(df: DataFrame, strata: list[str], key: str, n: Column | int, name: str | None = None) -> DataFrame:
    """The first n rows of each stratum in order of (md5(key), key); n may be a column that is equal within a stratum."""
    n = F.lit(n) if isinstance(n, int) else n
    lot = F.md5(F.col(key).cast("string"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_lot", key))
    rows = df.withColumn("_lot", lot).withColumn("_salt", F.pmod(F.crc32(F.col("_lot")), F.lit(SALTS)))
    few = rows.withColumn("_k", rank(*strata, "_salt")).where(F.col("_k") <= n)
    return few.withColumn("_k", rank(*strata)).where(F.col("_k") <= n).drop("_lot", "_salt", "_k")


def fraction(df: DataFrame, strata: list[str], key: str, share: float, rounding: str = "half_even") -> DataFrame:
    """df with `drawn`: true for the first share of each stratum by hash, its size rounded half to even or up."""
    size = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_all"))
    want = F.bround(F.col("_all") * share, 0) if rounding == "half_even" else F.ceil(F.col("_all") * share)
    sized = df.join(size.withColumn("_n", want.cast("long")), strata)
    drawn = first_by_hash(sized, strata, key, F.col("_n")).select(*strata, key, F.lit(True).alias("drawn"))
    return df.join(drawn, [*strata, key], "left").withColumn("drawn", F.coalesce("drawn", F.lit(False)))


def exact(df: DataFrame, strata: list[str], key: str, n: Column | int) -> DataFrame:
    """As first_by_hash, but raises where a stratum has fewer than n rows: nothing is silently short."""
    n = F.lit(n) if isinstance(n, int) else n
    size = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_all"))
    short = F.when(F.col("_all") < n, F.raise_error(F.concat(F.lit("a stratum has "), F.col("_all"), F.lit(" rows, fewer than asked")))).otherwise(F.lit(True))
    return first_by_hash(df.join(size, strata).where(short), strata, key, n).drop("_all")


def mirrored(df: DataFrame, targets: DataFrame, strata: list[str], key: str) -> DataFrame:
    """df cut down to the counts of targets (strata, n); raises where it would have to grow. Strata without a target are left out."""
    return exact(df.join(F.broadcast(targets.withColumnRenamed("n", "_want")), strata), strata, key, F.col("_want")).drop("_want")
