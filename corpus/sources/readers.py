"""Readers: each gives a DataFrame with a stated schema, so that no reader has to look at the data first."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESSAY = "id string, region string, topic string, proficiency string, text string, file_name string"
#: Other names under which columns are delivered.
ALIASES = {"text_id": "id", "nationality": "region"}
FILE_NAME = r"^WE_([A-Z]{3})_([A-Z0-9]+)_(\d+)_([A-Z0-9_]+)\.txt"


def csv(spark: SparkSession, path: str | list[str], schema: str | None = None, columns: list[str] | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV with quoted line breaks; all columns are strings without a schema. Only `columns` are read if they are given."""
    reader = spark.read.option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if df.columns:
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿"))
    return df.select(*columns) if columns else df


def human_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The table of human texts: other column names are put right and byte-order marks taken out; raises if there is no such file."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    df = csv(spark, path)
    for other, name in ALIASES.items():
        if other in df.columns and name not in df.columns:
            df = df.withColumnRenamed(other, name)
    return df.withColumn("text", F.regexp_replace("text", "﻿", ""))


def named(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """df with id, region, topic and proficiency read from its file name; rows whose name has another form are left out."""
    part = lambda k: F.regexp_extract(file_name, FILE_NAME, k)
    topic = F.when(part(2).contains("PTJ"), "Part-time Job").when(part(2).contains("SMK"), "Smoking Ban").otherwise(part(2))
    rows = df.where(F.col(file_name).rlike(FILE_NAME))
    return rows.withColumns({"id": F.concat_ws("_", part(1), part(3)), "region": part(1), "topic": topic, "proficiency": part(4)})


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """ESSAY of each .txt file below the folder; blank files are left out."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder)
    df = df.select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("text"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name")).where("text <> ''")
    return named(df).select("id", "region", "topic", "proficiency", "text", "file_name")


def zipped_texts(spark: SparkSession, path: str) -> DataFrame:
    """ESSAY of each .txt member of zip archives, bytes that aren't UTF-8 replaced. An archive is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                names, texts = [], []
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for m in z.namelist():
                        if m.endswith(".txt") and (t := z.read(m).decode("utf-8-sig", "replace").strip()):
                            names.append(m.rsplit("/", 1)[-1])
                            texts.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["file_name", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    return named(files.mapInArrow(run, "file_name string, text string")).select("id", "region", "topic", "proficiency", "text", "file_name")


def cell_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Generated texts, one CSV file <model>__<condition>.csv for each cell; model and condition come from the file's name."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", "*.csv").schema(schema).csv(folder)
    return df.select("*", F.substring_index(stem, "__", 1).alias("model"), F.substring_index(stem, "__", -1).alias("condition"))


def parquet_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """All parquet files of a pattern, with the stem of each row's file as `source`."""
    return spark.read.parquet(pattern).withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?$", 1))


def headerless(spark: SparkSession, path: str, names: list[str], keep: list[str]) -> DataFrame:
    """Tab-separated lines without a header, of whose columns some are kept."""
    return csv(spark, path, ", ".join(f"{n} string" for n in names), keep, "\t", False)


def config(spark: SparkSession, path: str) -> DataFrame:
    """A YAML or JSON file of settings as (name, value) rows, nested names joined by dots and values in JSON."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)

    def walk(prefix: str, x):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(f"{prefix}.{k}" if prefix else str(k), v)
        else:
            yield prefix, json.dumps(x, ensure_ascii=False)

    return spark.createDataFrame(list(walk("", data)), "name string, value string")


def json_document(spark: SparkSession, path: str, array: str | None = None) -> DataFrame:
    """A JSON document; with `array` one row for each element of that field."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode(array).alias("x")).select("x.*") if array else df


ANSWER = "model string, choices array<struct<message: struct<content: string>>>, usage struct<prompt_tokens: bigint, completion_tokens: bigint>"


def answers(df: DataFrame, line: str) -> DataFrame:
    """df with the text, model and token counts of an answer in JSON; counts that are missing are 0, an unreadable line gives nulls."""
    x = F.from_json(line, ANSWER)
    return df.withColumn("_x", x).select(*df.columns, F.col("_x.model").alias("model"), F.get(F.col("_x.choices"), F.lit(0))["message"]["content"].alias("content"), F.coalesce("_x.usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("_x.usage.completion_tokens", F.lit(0)).alias("completion_tokens"))


RESULT = "custom_id string, response struct<status_code: int, body: struct<model: string, choices: array<struct<message: struct<content: string>>>, usage: struct<prompt_tokens: bigint, completion_tokens: bigint>>>"


def results(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, topic, content, prompt_tokens, completion_tokens) of the good lines of a batch result: status 200 and a text; custom_id is cut at its first bar."""
    df = spark.read.schema(RESULT).json(path).where("response.status_code = 200")
    body, parts = "response.body", F.split("custom_id", r"\|", 2)
    text = F.get(F.col(f"{body}.choices"), F.lit(0))["message"]["content"]
    rows = df.select(parts[0].alias("source_id"), F.get(parts, F.lit(1)).alias("topic"), text.alias("content"), F.coalesce(f"{body}.usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce(f"{body}.usage.completion_tokens", F.lit(0)).alias("completion_tokens"))
    return rows.where("content is not null and trim(content) <> ''")


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """(classifier, acc, f1) of a log's lines `  name: acc=0.9 f1=0.8`; of several lines of a name the last holds."""
    pattern = r"^  (.+): acc=([0-9.]+) f1=([0-9.]+)$"
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("no", "line")).where(F.col("line").rlike(pattern))
    rows = lines.select("no", *(F.regexp_extract("line", pattern, k).alias(n) for k, n in ((1, "classifier"), (2, "acc"), (3, "f1"))))
    last = rows.groupBy("classifier").agg(F.max_by(F.struct("acc", "f1"), "no").alias("x"))
    return last.select("classifier", F.col("x.acc").cast("double").alias("acc"), F.col("x.f1").cast("double").alias("f1"))
