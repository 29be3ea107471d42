"""Splits, mirror-matched sets and mixes for classifiers, and requests to a text service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .samples import first_by_hash, fraction, mirrored

CONDITIONS = ["zero_shot", "one_shot", "few_shot", "cot"]


def essay_split(essays: DataFrame, share: float = 0.2) -> DataFrame:
    """essays (key, region, topic) with split: the share of each region and topic is test, the rest pool."""
    return fraction(essays, ["region", "topic"], "key", share).withColumn("split", F.when(F.col("drawn"), "test").otherwise("pool")).drop("drawn")


def writer_split(essays: DataFrame, share: float = 0.2) -> DataFrame:
    """essays (writer, region, ...) with split, all essays of a writer on one side."""
    writers = fraction(essays.select("writer", "region").distinct(), ["region"], "writer", share)
    return essays.join(writers.select("writer", "region", "drawn"), ["writer", "region"]).withColumn("split", F.when(F.col("drawn"), "test").otherwise("pool")).drop("drawn")


def train_dev(rows: DataFrame, share: float = 0.15) -> DataFrame:
    """rows (writer, region, ...) with part: ceil(share) of each region's writers are dev, one at least."""
    writers = fraction(rows.select("writer", "region").distinct(), ["region"], "writer", share, "up")
    return rows.join(writers.select("writer", "region", "drawn"), ["writer", "region"]).withColumn("part", F.when(F.col("drawn"), "dev").otherwise("train")).drop("drawn")


def equal_mix(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """A quarter of each region's target from each condition; targets (region, n) that four doesn't divide raise, and so do short strata."""
    fine = F.when(F.col("n") % len(CONDITIONS) != 0, F.raise_error(F.concat(F.lit("target isn't divisible by four: "), "region"))).otherwise(F.lit(True))
    quarter = targets.where(fine).withColumn("n", (F.col("n") / len(CONDITIONS)).cast("long")).withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    return mirrored(rows, quarter, ["region", "condition"], key)


def label(region: str = "region") -> Column:
    """A region's label: its place among the regions in order. Regions are few; the window holds one row for each."""
    return F.dense_rank().over(Window.orderBy(region)) - 1


def labelled(rows: DataFrame) -> DataFrame:
    names = rows.select("region").distinct().withColumn("label", label().cast("long"))
    return rows.join(F.broadcast(names), "region")


def leakage_free(generated: DataFrame, test_keys: DataFrame) -> DataFrame:
    """Generated rows whose key no test row has."""
    return generated.join(test_keys.select("key").distinct(), "key", "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by an aggregate."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in others))


TEMPLATES = {
    "zero_shot": "Write an essay of {words} words as a student from {region} on: {topic}.",
    "one_shot": "Write an essay of {words} words as a student from {region} on: {topic}.\n\nExample:\n{examples}",
    "few_shot": "Write an essay of {words} words as a student from {region} on: {topic}.\n\nExamples:\n{examples}",
    "cot": "Plan first, step by step; then write an essay of {words} words as a student from {region} on: {topic}.",
}


def exemplars(pool: DataFrame, k: int) -> DataFrame:
    """(region, topic, examples): the texts of the first k file names of each region and topic, a blank line between them."""
    w = Window.partitionBy("region", "topic").orderBy("file_name", "text")
    first = pool.where("text is not null").select("region", "topic", "file_name", "text").withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
    return first.groupBy("region", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n").alias("examples"))


def prompts(tasks: DataFrame, condition: str, pool: DataFrame | None = None, words: int = 250) -> DataFrame:
    """tasks (region, topic, ...) with the prompt of the condition."""
    from ..functions.text import filled

    k = {"one_shot": 1, "few_shot": 3}.get(condition, 0)
    rows = tasks.join(F.broadcast(exemplars(pool, k)), ["region", "topic"], "left") if k else tasks.withColumn("examples", F.lit(None).cast("string"))
    return rows.withColumn("prompt", filled(TEMPLATES[condition], words=F.lit(words), region=F.col("region"), topic=F.col("topic"), examples=F.col("examples"))).drop("examples")


def request_bodies(rows: DataFrame, model: str) -> DataFrame:
    """(custom_id, body) of rows (source_id, topic, prompt)."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"), F.lit(0.7).alias("temperature"))
    return rows.select(F.concat_ws("|", "source_id", "topic").alias("custom_id"), body.alias("body"))


def chunked(rows: DataFrame, ordinal: str, size: int) -> DataFrame:
    """rows with the number of the chunk of `size` that each lies in, by its ordinal from 1."""
    return rows.withColumn("chunk", F.floor((F.col(ordinal) - 1) / size))


def first(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """At most n rows of each stratum."""
    return first_by_hash(df, strata, key, n)
