"""Operators that SQL can't check, against plain Python on small cases."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus.functions import features, text
from corpus.operators import checks, datasets, matrix, order, resampling, samples


def test_error_patterns_as_in_python(spark):
    texts = ["The the cat. it sat,down. I am agree a apple", "more better informations is like", "No errors here.", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(*(c.alias(f"c{i}") for i, c in enumerate(text.error_counts(F.col("t")).values()))).collect()
    for t, r in zip(texts, got):
        assert list(r) == [len(re.findall(p, t, re.I)) for p in text.ERROR_PATTERNS.values()], t


def test_masking_and_markers(spark):
    df = spark.createDataFrame([("South Korea and Chinese food; Thailandish, été japan",), (None,), ("",)], "t string")
    got = df.select(text.masked(F.col("t")), text.markers_in(F.col("t"))).collect()
    assert [r[0] for r in got] == ["[REGION] and [REGION] food; Thailandish, été [REGION]", "", ""]
    assert [r[1] for r in got] == [["south korea", "chinese", "japan"], [], []]


def test_cleaning(spark):
    rows = [("﻿Title: My essay\r\nFirst line, e.g. this.\r\n\r\n  Second  line. (250 words)", ""), ("Smoking is bad\nIt is so.", "Smoking Ban"), ("  ", ""), (None, None), ("In the U.S.A. we eat etc. often", "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, k string").select(text.cleaned(F.col("t"), F.col("k"))).collect()]
    assert got == ["First line, for example this. Second line.", "It is so.", "", "", "In the USA we eat etcetera often"]


def test_windows(spark):
    df = spark.createDataFrame([(list(range(5)),), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(text.windows(F.col("ids"), 2, 9)).collect()] == [[[0, 1], [2, 3], [4]], [[9]]]


def test_features_of_odd_texts():
    assert features.analysed(None) is None and features.analysed("short") is None and features.analysed("!!! ??? ...") is None
    assert features.mtld([]) == 0.0
    x = dict(zip(features.FEATURES, features.analysed("The cat is loved. The cat is big.")))
    assert x["word_count"] == 8 and x["sentence_length"] == 4 and x["passive_ratio"] == 0.5
    assert features.depths([0, 0, 1]) == [1, 2, 3]


def test_adjusted_p(spark):
    p = [0.01, 0.02, 0.03, 0.5, 0.02]
    df = spark.createDataFrame([("f", x) for x in p], "fam string, p double")
    got = sorted((r.p, r.q) for r in matrix.adjusted(df, "p", ["fam"]).collect())
    want, low = {}, 1.0
    s = sorted(p)
    for i in range(len(s) - 1, -1, -1):
        low = min(low, s[i] * len(s) / (i + 1))
        want.setdefault(s[i], low)
        want[s[i]] = min(want[s[i]], low) if i == len(s) - 1 or s[i] != s[i + 1] else want[s[i]]
    assert all(math.isclose(q, want[x]) for x, q in got)


def test_divergence_of_equal_and_apart(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 4, 6]), ([1, 0], [0, 1])], "a array<long>, b array<long>")
    same, apart = (r[0] for r in df.select(matrix.divergence(F.col("a"), F.col("b"))).collect())
    assert abs(same) < 1e-9 and abs(apart - 1) < 1e-9


def test_samples_are_whole_or_raise(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(200)] + [("b", "x")], "s string, k string")
    got = {r.s: r["count"] for r in samples.first_by_hash(df, ["s"], "k", 50).groupBy("s").count().collect()}
    assert got == {"a": 50, "b": 1}
    with pytest.raises(Exception, match="fewer than asked"):
        samples.exact(df, ["s"], "k", 2).count()
    with pytest.raises(Exception, match="fewer than asked"):
        samples.mirrored(df, spark.createDataFrame([("b", 3)], "s string, n long"), ["s"], "k").count()
    with pytest.raises(Exception, match="divisible by four"):
        datasets.equal_mix(df.select(F.col("s").alias("region"), F.lit("cot").alias("condition"), "k"), spark.createDataFrame([("a", 6)], "region string, n long"), "k").count()


def test_numbered_is_the_place(spark):
    ids = [5, 9, 4097, 70000, 20_000_000, 20_000_001]
    got = {r.k: r.at for r in order.numbered(spark.createDataFrame([(i,) for i in ids], "k long"), "k", "at").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(ids))}


def test_unique_raises(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="stands twice"):
        checks.unique(df, ["k"]).collect()
    with pytest.raises(ValueError, match="2 rows"):
        checks.row_count(df, 3)


def cells(spark, n=40, shift=0.5):
    rng = np.random.default_rng(1)
    rows = [("m", "c", f"W{i:03d}|T{j}", f"R{i % 2}", f"T{j}", float(rng.normal(shift)), None if i == 3 else float(rng.normal())) for i in range(n) for j in range(2)]
    return spark.createDataFrame(rows, "model string, condition string, key string, region string, topic string, a double, b double")


def test_bootstrap_covers_the_mean(spark):
    got = {r.feature: r for r in resampling.bootstrap(cells(spark), ["a", "b"], reps=400).collect()}
    assert got["a"].low < got["a"]["mean"] < got["a"].high and got["a"].n_keys == 80 and got["a"].n_strata == 4
    assert got["b"].n_keys == 78 and got["a"].p < 0.05


def test_sign_flip_by_loop(spark):
    df = cells(spark, 6)
    got = {r.feature: r for r in resampling.sign_flip(df, ["a"], reps=200).collect()}["a"]
    p = df.toPandas().sort_values("key")
    s = resampling.signs(42, 200, p.key.tolist())
    null = [sum(s[r][i] * v for i, v in enumerate(p.a)) / len(p) for r in range(200)]
    assert got.p == (1 + sum(abs(x) >= abs(p.a.mean()) - 1e-12 for x in null)) / 201
    assert set(np.unique(s)) == {-1.0, 1.0}


def test_writers_are_drawn_together(spark):
    got = {r.feature: r for r in resampling.writer_bootstrap(cells(spark), ["a"], reps=300).collect()}["a"]
    assert got.writers == 40 and got.valid == 300 and got.low < got["mean"] < got.high


def test_resampling_ignores_partitions(spark):
    df = cells(spark)
    a = resampling.bootstrap(df.repartition(1), ["a"], reps=50).collect()
    b = resampling.bootstrap(df.repartition(7), ["a"], reps=50).collect()
    assert a == b


def test_student_p():
    assert math.isclose(resampling.student_p(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(resampling.student_p(0.0, 5), 1.0) and math.isnan(resampling.student_p(1.0, 0))


def test_slope_within_groups():
    x, g = np.array([1.0, 2, 3, 1, 2, 4]), np.array(list("aaabbb"))
    assert math.isclose(resampling.slope(x, 3 * x + (g == "b") * 7, g), 3)
    assert math.isnan(resampling.slope(x, x, np.array(["a"] * 6)))


def test_effect_sizes_ignore_partitions(spark):
    """The eight deltas of one cell have a mean of 0.2455625, halfway; the order of their sum made it 0.245562 or 0.245563."""
    from corpus.plans.matrix import QUERIES

    was, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 4, 8, 12):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({tuple(r) for r in QUERIES["r6_effect_sizes"](spark, "/root/testdata/sf0.001").collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert all(g == got[0] for g in got)
    assert [r[4] for r in got[0] if r[:3] == ("cobalt-flash", "one_shot", "AVD_Combined")] == [0.245563]
