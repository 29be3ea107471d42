"""Measures of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: list[str], label: str, predicted: str) -> DataFrame:
    """(by, n, accuracy, macro_f1); a class without a true or predicted row counts as 0. Only the confusion counts are moved."""
    cm = df.groupBy(*by, label, predicted).agg(F.count(F.lit(1)).alias("k"))
    marks = F.explode(F.when(F.col(label) == F.col(predicted), F.array(F.struct(F.col(label).alias("c"), F.col("k").alias("tp"), F.lit(0).alias("miss")))).otherwise(F.array(F.struct(F.col(label).alias("c"), F.lit(0).cast("long").alias("tp"), F.col("k").cast("int").alias("miss")), F.struct(F.col(predicted).alias("c"), F.lit(0).cast("long").alias("tp"), F.col("k").cast("int").alias("miss")))))
    f1 = cm.select(*by, marks.alias("x")).groupBy(*by, "x.c").agg(F.sum("x.tp").alias("tp"), F.sum("x.miss").alias("miss"))
    macro = f1.groupBy(*by).agg(F.avg(F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("miss"))).otherwise(0.0)).alias("f"))
    acc = cm.groupBy(*by).agg(F.sum("k").alias("n"), (F.sum(F.when(F.col(label) == F.col(predicted), F.col("k")).otherwise(0)) / F.sum("k")).alias("a"))
    return acc.join(macro, by).select(*by, "n", F.round("a", 6).alias("accuracy"), F.round("f", 6).alias("macro_f1"))


def matthews(df: DataFrame, by: list[str], label: str, predicted: str) -> DataFrame:
    """(by, mcc) of two boolean columns; 0 where a side has one value only."""
    y, p = F.col(label), F.col(predicted)
    c = df.groupBy(*by).agg(*(F.count_if(x).cast("double").alias(name) for x, name in ((y & p, "tp"), (~y & ~p, "tn"), (~y & p, "fp"), (y & ~p, "fn"))))
    under = (F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn"))
    return c.select(*by, F.round(F.when(under == 0, 0.0).otherwise((F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / F.sqrt(under)), 6).alias("mcc"))
