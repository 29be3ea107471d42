"""Notions that several operators share: tables, writers, splits, conditions, words."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest runs of letters and digits.
WORD = re.compile(r"[^\W_]+")

#: Characters that show nothing: white space, BOM, zero-width marks.
BLANK = r"^[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]*$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, as in tests, one of our own."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df as a table written to the folder that all executors share: lineage ends here, and the loss of an executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: str) -> list[str]:
    """Words under compatibility normalisation and lower case."""
    return WORD.findall(unicodedata.normalize("NFKC", text).lower())


def has_text(text: Column) -> Column:
    """True where text is neither null nor blank."""
    return text.isNotNull() & ~text.rlike(BLANK)


def _writer(region: Column, number: Column) -> Column:
    digits = number.cast("decimal(38,0)").cast("string")
    return F.when(number != "", F.concat(region, F.lit("_"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)))


def writer(spelling: Column) -> Column:
    """The written form of a writer id; null if none can be read."""
    s, pattern = F.upper(spelling), r"(?<![A-Z])([A-Z]{3})[^A-Z0-9]*([0-9]+)"
    return _writer(F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2))


def file_writer(file_name: Column) -> Column:
    """The writer named by a file name such as WE_CHN_SMK0_288_B2_0.txt."""
    s, pattern = F.upper(file_name), r"^\s*WE_([A-Z]{3})_[A-Z]+[0-9]+_([0-9]+)_"
    return _writer(F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2))


def region_of(writer_id: Column) -> Column:
    return F.substring_index(writer_id, "_", 1)


def split_name(split: Column) -> Column:
    s = F.regexp_replace(F.lower(split), r"[^a-z]", "")
    return F.when(s == "validation", "dev").when(s.isin("pool", "train", "dev", "test"), s)


def condition_name(condition: Column) -> Column:
    """The standard notation of a condition, also for C0 to C3."""
    s = F.regexp_replace(F.lower(condition), r"[^a-z0-9]", "")
    names = {"zeroshot": "zero_shot", "c0": "zero_shot", "oneshot": "one_shot", "c1": "one_shot", "fewshot": "few_shot", "c2": "few_shot", "cot": "cot", "c3": "cot"}
    out = F.when(F.lit(False), F.lit(""))
    for k, v in names.items():
        out = out.when(s == k, v)
    return out


def scoped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, rec_id, writer, split, text) of split_manifest and of each l1_dataset dataset; rows without a split are left out."""
    m = table(spark, sf_dir, "split_manifest").select(F.lit("split_manifest").alias("scope"), "rec_id", F.coalesce(file_writer(F.col("file_name")), writer(F.col("id"))).alias("writer"), split_name(F.col("split")).alias("split"), "text")
    d = table(spark, sf_dir, "l1_dataset").select(F.col("dataset").alias("scope"), "rec_id", F.coalesce(writer(F.substring_index("key", "|", 1)), writer(F.col("writer_id"))).alias("writer"), split_name(F.col("split")).alias("split"), "text")
    return m.unionByName(d).where("split is not null")
