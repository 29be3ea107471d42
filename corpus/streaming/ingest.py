"""Resumable ingest: what came since the last run, each cell once, written where a query can read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Reads the parquet files that came into folder since the last run and adds the rows whose keys aren't there yet.

    A batch is held against what is written by an anti-join, so that no state grows in memory; a batch that is run again
    after a failure finds its own rows and adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        try:
            done = batch.sparkSession.read.parquet(out).select(*keys)
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        (new.join(done, keys, "left_anti") if done is not None else new).write.mode("append").parquet(out)

    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
