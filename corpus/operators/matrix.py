"""The feature matrix: one row per text (key, model, condition), human rows being model HUMAN.

A missing value is null: NaN counts as missing, and the two ratios that come as shares in some rows are brought to
percent. Rows of one key and cell are averaged before anything else, so that repeated deliveries count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import table

HUMAN, NATIVE, BINS = "HUMAN", "ENS", 20
LEXICAL = ["AVD_Combined", "CEFR_A1", "CEFR_A2", "CEFR_B1", "CEFR_B2", "CEFR_C1", "MTLD", "Top20_Word_Share", "Hapax_Ratio", "Lexical_Cohesion"]
DISCOURSE = ["Referential_Density", "Discourse_Density"]
SYNTACTIC = ["Sentence_Length", "MDD", "Nominalization_Rate", "Passive_Ratio", "Pronoun_Ratio", "Grammar_Acceptability", "Grammar_Error_Rate", "Tree_Depth", "MLT", "Clause_per_Sentence"]
FEATURES = LEXICAL + DISCOURSE + SYNTACTIC
ROBUST = ["AVD_Combined", "MTLD", "Grammar_Error_Rate", "MLT", "Clause_per_Sentence", "MDD"]
PERCENT = ["Top20_Word_Share", "Hapax_Ratio"]


def value(c: str) -> Column:
    """The feature c with NaN as null and shares in percent."""
    x = F.when(F.isnan(c), None).otherwise(F.col(c).cast("double"))
    return F.when(F.col(c) <= 1, x * 100).otherwise(x) if c in PERCENT else x


def family(c: Column) -> Column:
    return F.when(c.isin(LEXICAL), "lexical").when(c.isin(DISCOURSE), "discourse").otherwise("syntactic_register")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, region, topic, model, condition, FEATURES) of each delivered row; region and topic are read from the key."""
    at = [F.substring("key", 1, 3).alias("region"), F.substring_index("key", "|", -1).alias("topic")]
    return table(spark, sf_dir, "features_all_with_neosca").select("key", *at, "model", "condition", *(value(c).alias(c) for c in FEATURES))


def by_key(df: DataFrame, *more: str) -> DataFrame:
    """Means of each key in each cell."""
    return df.groupBy("key", "region", "topic", "model", "condition", *more).agg(*(F.avg(c).alias(c) for c in FEATURES))


def long(df: DataFrame, ids: list[str], features: list[str] | None = None) -> DataFrame:
    """One row for each feature that isn't null."""
    return df.unpivot(ids, features or FEATURES, "feature", "value").where("value is not null")


def mean(c: str) -> Column:
    """The mean of c, the same in whatever order the rows come.

    The parts of the values that are multiples of 2 ** -20 have a sum without rounding, and what is left is too small for its rounding to show.
    """
    x = F.col(c)
    coarse = F.rint(x * 2.0**20) / 2.0**20
    return (F.sum(coarse) + F.sum(F.when(F.abs(x) < 2.0**32, x - coarse).otherwise(0.0))) / F.count(x)


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, region, topic, model, condition, FEATURES): generated minus human mean of each key, null where either is missing.

    The deltas stay side by side until a query needs rows of them, so that the join moves one row for each key and cell.
    """
    means = by_key(clean(spark, sf_dir))
    h = means.where(F.col("model") == HUMAN).select("key", *(F.col(c).alias(f"h_{c}") for c in FEATURES))
    g = means.where(F.col("model") != HUMAN)
    return g.join(h, "key").select("key", "region", "topic", "model", "condition", *((F.col(c) - F.col(f"h_{c}")).alias(c) for c in FEATURES))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(paired(spark, sf_dir), ["key", "region", "topic", "model", "condition"]).withColumnRenamed("value", "delta")


def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, condition, feature, n, mean_delta, sd_delta, dz): paired effect size of each cell and feature, native writers left out; 0 where it has no spread."""
    p = paired(spark, sf_dir).where(F.col("region") != NATIVE)
    stats = p.groupBy("model", "condition").agg(*(F.struct(F.count(c).alias("n"), mean(c).alias("mean_delta"), F.stddev_samp(c).alias("sd_delta")).alias(c) for c in FEATURES))
    rows = stats.unpivot(["model", "condition"], FEATURES, "feature", "s").select("model", "condition", "feature", "s.*").where("n > 0")
    dz = F.when((F.col("n") <= 1) | (F.coalesce("sd_delta", F.lit(0.0)) == 0), 0.0).otherwise(F.col("mean_delta") / F.col("sd_delta"))
    return rows.withColumn("sd_delta", F.coalesce("sd_delta", F.lit(0.0))).withColumn("dz", dz)


def adjusted(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    """df with q: Benjamini-Hochberg adjusted p within each family; a family is a set of tests, hundreds at most."""
    rank = Window.partitionBy(*family).orderBy(p)
    n = F.count(p).over(Window.partitionBy(*family))
    # ties get the rank of their last, as the running minimum from above would give them the same value
    last = F.count(p).over(rank.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    up = Window.partitionBy(*family).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_raw", F.col(p) * n / last).withColumn("q", F.least(F.min("_raw").over(up), F.lit(1.0))).drop("_raw")


def edges(df: DataFrame, features: list[str] | None = None, *by: str) -> DataFrame:
    """(feature, lo, hi) of all rows of df: one aggregate gives all ends at once."""
    fs = features or FEATURES
    ends = df.groupBy(*by).agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in fs))
    return ends.unpivot(list(by), fs, "feature", "s").select(*by, "feature", "s.lo", "s.hi")


def bin_of(x: str) -> Column:
    """The bin from 1 to BINS on equal edges between lo and hi, the last closed on the right."""
    w = (F.col("hi") - F.col("lo")) / BINS
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda i: F.col(x) >= F.col("lo") + i * w)) + 1


def histograms(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, counts): counts of each bin as an array of BINS; rows: by, bin."""
    counts = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("k"))
    held = counts.groupBy(*by).agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("m"))  # BINS entries
    return held.select(*by, "n", F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("counts"))


def divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of counts, each with 1e-12 added."""
    share = lambda x: F.transform(x, lambda v: (v + 1e-12) / (F.aggregate(x, F.lit(0.0), lambda s, y: s + y) + F.size(x) * 1e-12))
    kl = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * F.log2(x / ((x + y) / 2))), F.lit(0.0), lambda s, y: s + y)
    p, q = share(a), share(b)
    return (kl(p, q) + kl(q, p)) / 2


def cell_divergences(df: DataFrame, by: list[str], ends: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(by, model, condition, feature, n_human, n_generated, jsd) of the delivered rows of df; ends: feature, lo, hi (and by). A constant feature has 0."""
    rows = long(df, [*by, "model", "condition"], features).join(F.broadcast(ends), [*(c for c in by if c in ends.columns), "feature"])  # a row for each feature
    rows = rows.withColumn("bin", bin_of("value"))
    h = histograms(rows.where(F.col("model") == HUMAN), [*by, "feature"]).select(*by, "feature", F.col("n").alias("n_human"), F.col("counts").alias("human"))
    g = histograms(rows.where(F.col("model") != HUMAN), [*by, "model", "condition", "feature"]).withColumnsRenamed({"n": "n_generated", "counts": "generated"})
    met = g.join(F.broadcast(h), [*by, "feature"]).join(F.broadcast(ends), [*(c for c in by if c in ends.columns), "feature"])
    jsd = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise(divergence(F.col("human"), F.col("generated")))
    return met.select(*by, "model", "condition", "feature", "n_human", "n_generated", jsd.alias("jsd"))


def pair_divergences(df: DataFrame, features: list[str]) -> DataFrame:
    """(model, condition, feature, jsd) on edges from the smallest and largest value of the two samples compared, cell by cell."""
    rows = long(df, ["model", "condition"], features)
    ends = rows.groupBy("model", "condition", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    human = ends.where(F.col("model") == HUMAN).select("feature", F.col("lo").alias("hlo"), F.col("hi").alias("hhi"))
    cells = ends.where(F.col("model") != HUMAN).join(F.broadcast(human), "feature").select("model", "condition", "feature", F.least("lo", "hlo").alias("lo"), F.greatest("hi", "hhi").alias("hi"))
    own = rows.where(F.col("model") != HUMAN).join(F.broadcast(cells), ["model", "condition", "feature"]).withColumn("bin", bin_of("value"))
    other = rows.where(F.col("model") == HUMAN).select("feature", "value").join(F.broadcast(cells), "feature").withColumn("bin", bin_of("value"))
    g, h = histograms(own, ["model", "condition", "feature"]), histograms(other, ["model", "condition", "feature"])
    met = g.join(h.select("model", "condition", "feature", F.col("counts").alias("human")), ["model", "condition", "feature"])
    return met.select("model", "condition", "feature", divergence(F.col("human"), F.col("counts")).alias("jsd"))
