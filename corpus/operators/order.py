"""Numbers for rows in order, without a task that orders them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, key: str, name: str, width: int = 4096) -> DataFrame:
    """df with the place, from 1, of each row by an integer key: the rows of each range of `width` keys are counted, and the counts before it added."""
    rows = df.withColumn("_range", F.floor(F.col(key) / width))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # ranges are summed by blocks of ranges first; there is one block for each width * width keys, few enough for one window
    blocks = counts.withColumn("_block", F.floor(F.col("_range") / width))
    totals = blocks.groupBy("_block").agg(F.sum("_n").alias("_all"))
    offset = totals.select("_block", (F.sum("_all").over(Window.orderBy("_block")) - F.col("_all")).alias("_first"))
    inner = F.sum("_n").over(Window.partitionBy("_block").orderBy("_range")) - F.col("_n")
    starts = blocks.withColumn("_inner", inner).join(F.broadcast(offset), "_block").select("_range", (F.col("_first") + F.col("_inner")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return rows.join(starts, "_range").withColumn(name, F.col("_before") + place).drop("_range", "_before")
