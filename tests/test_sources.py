"""Readers and writers by round trips through files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpus.operators import checks
from corpus.sources import readers, writers
from corpus.streaming.ingest import ingest

ROWS = [("CHN_001", "CHN", "Smoking Ban", "B1_1", 'Line one,\n"quoted" two', "WE_CHN_SMK0_001_B1_1.txt"), ("JPN_002", "JPN", "Part-time Job", "A2_0", "Text", "WE_JPN_PTJ0_002_A2_0.txt")]


@pytest.fixture()
def essays(spark):
    return spark.createDataFrame(ROWS, readers.ESSAY)


def same(df):
    return sorted(tuple(r) for r in df.collect())


def test_human_baseline_with_bom_and_other_names(spark, essays, tmp_path):
    path = str(tmp_path / "h.csv")
    writers.csv_file(essays.withColumnsRenamed({"id": "text_id", "region": "nationality"}).withColumn("text", F.concat(F.lit("﻿"), "text")), path, bom=True)
    got = readers.human_baseline(spark, path)
    assert got.columns == ["id", "region", "topic", "proficiency", "text", "file_name"] and same(got) == sorted(ROWS)
    with pytest.raises(FileNotFoundError):
        readers.human_baseline(spark, str(tmp_path / "none.csv"))


def test_text_files_and_zip(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / ROWS[0][5]).write_text("﻿ Hello there \n", encoding="utf-8")
    (tmp_path / "in" / ROWS[1][5]).write_text("   ")
    (tmp_path / "in" / "other.txt").write_text("no name")
    assert [r.text.strip() for r in readers.text_files(spark, str(tmp_path / "in")).collect()] == ["Hello there"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/" + ROWS[1][5], b"\xef\xbb\xbfgood \xff text")
        z.writestr("x/" + ROWS[0][5], b" ")
    got = readers.zipped_texts(spark, str(tmp_path / "a.zip")).collect()
    assert [(r.id, r.topic, r.text) for r in got] == [("JPN_002", "Part-time Job", "good � text")]


def test_cells_globs_and_tsv(spark, tmp_path):
    for cell in ("m-1__cot", "m-2__zero_shot"):
        (tmp_path / f"{cell}.csv").write_text('source_id,generated_text\nA,"x\ny"\n')
    got = readers.cell_files(spark, str(tmp_path), "source_id string, generated_text string")
    assert sorted((r.model, r.condition, r.generated_text) for r in got.collect()) == [("m-1", "cot", "x\ny"), ("m-2", "zero_shot", "x\ny")]
    (tmp_path / "t.tsv").write_text("g\t1\t*\tA sentence\n")
    assert same(readers.headerless(spark, str(tmp_path / "t.tsv"), ["s", "label", "mark", "text"], ["label", "text"])) == [("1", "A sentence")]
    writers.parquet(spark.range(3), str(tmp_path / "p" / "one.parquet"))
    assert {r.source for r in readers.parquet_glob(spark, str(tmp_path / "p" / "*.parquet")).collect()} == {"one"}


def test_json_yaml_and_logs(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}, "c": ["x"]}')
    assert same(readers.config(spark, str(tmp_path / "c.json"))) == [("a.b", "1"), ("c", '["x"]')]
    (tmp_path / "d.json").write_text('{"cells": [{"m": "x", "n": 1}, {"m": "y", "n": 2}]}')
    assert same(readers.json_document(spark, str(tmp_path / "d.json"), "cells")) == [("x", 1), ("y", 2)]
    (tmp_path / "run.log").write_text("start\n  clf one: acc=0.5 f1=0.4\n  clf one: acc=0.7 f1=0.6\nend\n")
    assert same(readers.metric_log(spark, str(tmp_path / "run.log"))) == [("clf one", 0.7, 0.6)]
    good = {"model": "m", "choices": [{"message": {"content": "Hi"}}], "usage": {"prompt_tokens": 3}}
    lines = [{"custom_id": "A_1|Part|x", "response": {"status_code": 200, "body": good}}, {"custom_id": "B|t", "response": {"status_code": 500, "body": good}}, {"custom_id": "C|t", "response": {"status_code": 200, "body": {"choices": []}}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert same(readers.results(spark, str(tmp_path / "r.jsonl"))) == [("A_1", "Part|x", "Hi", 3, 0)]


def test_writers_and_inventory(spark, essays, tmp_path):
    writers.parquet(essays, str(tmp_path / "p"))
    writers.parquet(essays, str(tmp_path / "p"), "append")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    writers.parquet(essays, str(tmp_path / "p"), by=["region"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.csv(spark.createDataFrame([(1 / 3,)], "x double"), str(tmp_path / "c"), digits=12)
    assert same(readers.csv(spark, str(tmp_path / "c"))) == [("0.333333333333",)]
    writers.manifest({"n": 2}, str(tmp_path / "m" / "manifest.json"))
    have = checks.file_inventory(spark, str(tmp_path / "m"))
    row = have.collect()[0]
    assert row.name == "manifest.json" and len(row.digest) == 64 and row.digest == row.digest.upper()
    checks.gate(have, spark.createDataFrame([(row.name, row.digest)], "name string, digest string")).collect()
    with pytest.raises(Exception, match="isn't as stated"):
        checks.gate(have, spark.createDataFrame([("manifest.json", "0")], "name string, digest string")).collect()
    writers.requests(essays.select(F.col("id").alias("custom_id"), F.struct("text").alias("body")), str(tmp_path / "q"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "q")).collect()]
    assert {x["custom_id"] for x in got} == {"CHN_001", "JPN_002"} and got[0]["method"] == "POST"
    with pytest.raises(ValueError, match="more than"):
        writers.csv_file(essays, str(tmp_path / "one.csv"), limit=1)
    checks.same(essays, essays)


def test_ingest_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "key string, v long"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], schema).coalesce(1).write.parquet(src)
    ingest(spark, src, schema, out, mark, ["key"]).awaitTermination()
    spark.createDataFrame([("b", 9), ("c", 4)], schema).write.mode("append").parquet(src)
    ingest(spark, src, schema, out, mark, ["key"]).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
