"""Queries of inference: resampling, regression over cells, and their SQL where it is exact."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import matrix as m
from ..operators import resampling as rs
from ..operators import samples
from ..core import table
from .matrix import EFFECTS, r6

QUERIES, SQL = {}, {}
STUDY = ["Part-time Job", "Smoking Ban"]


def query(name: str, sql: str | None = None):
    def put(g):
        QUERIES[name] = g
        if sql:
            SQL[name] = sql
        return g

    return put


def selected(spark, sf):
    """Keys of the fixed strata among human rows: a hundred of each region and study topic, or as many as the smallest stratum has."""
    h = m.clean(spark, sf).where((F.col("model") == m.HUMAN) & (F.col("region") != m.NATIVE) & F.col("topic").isin(STUDY)).select("key", "region", "topic").distinct()
    n = min(100, h.groupBy("region", "topic").count().agg(F.min("count")).first()[0] or 0)
    return samples.exact(h, ["region", "topic"], "key", n).select("key")


def chosen(df, spark, sf):
    return df.join(selected(spark, sf), "key", "left_semi")


@query("r5_cell_summary")
def cell_summary(spark, sf):
    """R2 to R5: mean and percentile interval of each cell and feature, and of its paired deltas, 1,000 replicates."""
    values = rs.bootstrap(chosen(m.by_key(m.clean(spark, sf)), spark, sf), m.FEATURES)
    deltas = rs.bootstrap(chosen(m.paired(spark, sf), spark, sf), m.FEATURES, seed=100042)
    d = deltas.select("model", "condition", "feature", F.col("mean").alias("delta"), F.col("low").alias("delta_low"), F.col("high").alias("delta_high"), F.col("p").alias("delta_p"))
    return values.drop("p").join(d, ["model", "condition", "feature"], "left")


@query("r14_sign_flip")
def sign_flip(spark, sf):
    """R13 and R14: 5,000 sign flips of each cell and feature, Benjamini-Hochberg within families."""
    t = rs.sign_flip(chosen(m.paired(spark, sf), spark, sf), m.FEATURES)
    return m.adjusted(t.withColumn("family", m.family(F.col("feature"))), "p", ["family"])


@query("r16_writer_sensitivity")
def writer_sensitivity(spark, sf):
    """R15 and R16: intervals by writers, 10,000 replicates, beside those by keys."""
    p = chosen(m.paired(spark, sf), spark, sf)
    w = rs.writer_bootstrap(p, m.FEATURES)
    k = rs.bootstrap(p, m.FEATURES, seed=100042).select("model", "condition", "feature", "n_keys", F.col("low").alias("key_low"), F.col("high").alias("key_high"))
    return w.join(k, ["model", "condition", "feature"])


def cells(spark, sf):
    """(model, condition, x, y): each cell's mean absolute effect size and the mean grade level of its texts."""
    x = m.effect_sizes(spark, sf).groupBy("model", "condition").agg(F.avg(F.abs("dz")).alias("x"))
    y = table(spark, sf, "features_all_with_neosca").where("FKGL is not null and not isnan(FKGL)").groupBy("model", "condition").agg(F.avg("FKGL").alias("y"))
    return x.join(y, ["model", "condition"])


_CELLS = EFFECTS + ", cells AS (SELECT s.model, s.condition, avg(abs(dz)) AS x, any_value(y) AS y FROM sized s JOIN (SELECT model, condition, avg(FKGL) AS y FROM features_all_with_neosca WHERE FKGL IS NOT NULL AND NOT isnan(FKGL) GROUP BY ALL) g ON g.model = s.model AND g.condition = s.condition GROUP BY ALL)"
_WITHIN = ", w AS (SELECT *, x - avg(x) OVER (PARTITION BY {g} model) - avg(x) OVER (PARTITION BY {g} condition) + avg(x) OVER ({o}) AS rx, y - avg(y) OVER (PARTITION BY {g} model) - avg(y) OVER (PARTITION BY {g} condition) + avg(y) OVER ({o}) AS ry, y - avg(y) OVER ({o}) AS cy FROM {t})"


def within(df, *by):
    """df with x and y less their means by model and by condition (rx, ry), and y less its mean (cy). Cells are a few dozen rows."""
    over = lambda c, *g: F.avg(c).over(Window.partitionBy(*by, *g))
    r = lambda c: F.col(c) - over(c, "model") - over(c, "condition") + over(c)
    return df.select(*by, "model", "condition", r("x").alias("rx"), r("y").alias("ry"), (F.col("y") - over("y")).alias("cy"))


def regression(w, *by):
    """(by, n, df, slope, se, t, r2) of y on x with effects of model and condition, on a grid of cells that has no holes."""
    s = w.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("a"), F.count_distinct("condition").alias("b"), F.sum(F.col("rx") * F.col("ry")).alias("xy"), F.sum(F.col("rx") * F.col("rx")).alias("xx"), F.sum(F.col("ry") * F.col("ry")).alias("yy"), F.sum(F.col("cy") * F.col("cy")).alias("tss"))
    s = s.withColumn("df", F.col("n") - F.col("a") - F.col("b")).withColumn("slope", F.col("xy") / F.col("xx")).withColumn("rss", F.col("yy") - F.col("slope") * F.col("xy"))
    s = s.withColumn("se", F.sqrt(F.col("rss") / F.col("df") / F.col("xx")))
    return s.select(*by, "n", "df", "slope", "se", (F.col("slope") / F.col("se")).alias("t"), (1 - F.col("rss") / F.col("tss")).alias("r2"))


_REG = "count(*) AS n, count(*) - count(DISTINCT model) - count(DISTINCT condition) AS df, round(sum(rx * ry) / sum(rx * rx), 6) AS slope"


@query("r17_fixed_effects", _CELLS + _WITHIN.format(g="", o="", t="cells") + """
, s AS (SELECT count(*) AS n, count(*) - count(DISTINCT model) - count(DISTINCT condition) AS df, sum(rx * ry) AS xy, sum(rx * rx) AS xx, sum(ry * ry) AS yy, sum(cy * cy) AS tss FROM w)
SELECT n, df, round(xy / xx, 6) AS slope, round(sqrt((yy - xy / xx * xy) / df / xx), 6) AS se, round(xy / xx / sqrt((yy - xy / xx * xy) / df / xx), 6) AS t, round(1 - (yy - xy / xx * xy) / tss, 6) AS r2 FROM s""")
def fixed_effects(spark, sf):
    return r6(regression(within(cells(spark, sf))), "slope", "se", "t", "r2")


@query("r17_fixed_effects_p")
def fixed_effects_p(spark, sf):
    """The same with Student's p: one row, so the function runs once."""
    import pandas as pd

    def p(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(p=[rs.student_p(t, int(df)) for t, df in zip(g.t, g.df)])

    return regression(within(cells(spark, sf))).groupBy().applyInPandas(p, "n long, df long, slope double, se double, t double, r2 double, p double")


@query("r18_residualised_slope", _CELLS + _WITHIN.format(g="", o="", t="cells") + " SELECT round(sum(rx * ry) / sum(rx * rx), 6) AS slope FROM w")
def residualised_slope(spark, sf):
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slope": [rs.slope(g.x.to_numpy(), g.y.to_numpy(), g.model.to_numpy(), g.condition.to_numpy())]})

    return r6(cells(spark, sf).groupBy().applyInPandas(run, "slope double"), "slope")


@query("r19_correlations", _CELLS + ", k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS kx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ky FROM cells) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(kx, ky), 6) AS spearman FROM k")
def correlations(spark, sf):
    """Over the cells, a few dozen rows; ranks of equals are averaged."""
    mean_rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0
    k = cells(spark, sf).select("x", "y", mean_rank("x").alias("kx"), mean_rank("y").alias("ky"))
    return k.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("kx", "ky"), 6).alias("spearman"))


@query("r20_leave_one_out", _CELLS + ", o AS (SELECT a.model AS omitted, b.* FROM (SELECT DISTINCT model FROM cells) a JOIN cells b ON a.model <> b.model)" + _WITHIN.format(g="omitted,", o="PARTITION BY omitted", t="o") + f" SELECT omitted, {_REG} FROM w GROUP BY omitted")
def leave_one_out(spark, sf):
    """The slope without each model in turn: every cell goes to the models that aren't its own."""
    c = cells(spark, sf)
    names = c.groupBy().agg(F.collect_set("model").alias("names"))  # six names
    o = c.crossJoin(F.broadcast(names)).select("model", "condition", "x", "y", F.explode(F.array_remove("names", F.col("model"))).alias("omitted"))
    return r6(regression(within(o, "omitted"), "omitted").select("omitted", "n", "df", "slope"), "slope")


@query("r21_permutation")
def permutation(spark, sf):
    """10,000 permutations within models."""
    return rs.permutation(cells(spark, sf))


@query("r22_block_bootstrap")
def block_bootstrap(spark, sf):
    """5,000 draws of models."""
    return rs.block_bootstrap(cells(spark, sf))


@query("r23_bridge_audit", _CELLS + ", f AS (SELECT model, condition, count(*) AS k FROM sized GROUP BY ALL) SELECT count(*) AS cells, count(*) FILTER (WHERE k <> 22) AS incomplete, count(DISTINCT model) AS models, count(DISTINCT condition) AS conditions, CASE WHEN count(*) = 24 AND count(*) FILTER (WHERE k <> 22) = 0 THEN 'passed' ELSE 'blocked' END AS status FROM f JOIN cells USING (model, condition)")
def bridge_audit(spark, sf):
    f = m.effect_sizes(spark, sf).groupBy("model", "condition").agg(F.count(F.lit(1)).alias("k")).join(cells(spark, sf), ["model", "condition"])
    a = f.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("k") != len(m.FEATURES)).alias("incomplete"), F.count_distinct("model").alias("models"), F.count_distinct("condition").alias("conditions"))
    return a.withColumn("status", F.when((F.col("cells") == 24) & (F.col("incomplete") == 0), "passed").otherwise("blocked"))
