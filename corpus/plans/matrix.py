"""Queries on the feature matrix, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import split_name, table
from ..operators import matrix as m

_VALUES = ", ".join(f"CASE WHEN isnan({c}) THEN NULL{f' WHEN {c} <= 1 THEN {c} * 100' if c in m.PERCENT else ''} ELSE {c} END AS {c}" for c in m.FEATURES)
_LIST = ", ".join(m.FEATURES)
_FAMILY = "CASE WHEN feature IN (" + ", ".join(f"'{c}'" for c in m.LEXICAL) + ") THEN 'lexical' WHEN feature IN (" + ", ".join(f"'{c}'" for c in m.DISCOURSE) + ") THEN 'discourse' ELSE 'syntactic_register' END"
CLEAN = f"WITH clean AS (SELECT key, substr(key, 1, 3) AS region, split_part(key, '|', 2) AS topic, model, condition, {_VALUES} FROM features_all_with_neosca), rows_ AS (SELECT * FROM (UNPIVOT clean ON {_LIST} INTO NAME feature VALUE value))"
MEANS = CLEAN + ", means AS (SELECT key, region, topic, model, condition, feature, avg(value) AS value FROM rows_ GROUP BY ALL)"
PAIRED = MEANS + ", paired AS (SELECT g.key, g.region, g.topic, g.model, g.condition, g.feature, g.value - h.value AS delta FROM means g JOIN means h ON h.key = g.key AND h.feature = g.feature AND h.model = 'HUMAN' WHERE g.model <> 'HUMAN')"
EFFECTS = PAIRED + ", effects AS (SELECT model, condition, feature, count(*) AS n, avg(delta) AS mean_delta, coalesce(stddev_samp(delta), 0) AS sd_delta FROM paired WHERE region <> 'ENS' GROUP BY ALL), sized AS (SELECT *, CASE WHEN n <= 1 OR sd_delta = 0 THEN 0 ELSE mean_delta / sd_delta END AS dz FROM effects)"
_HIST = """
, binned AS (SELECT r.*, 1 + len(list_filter(range(1, 20), lambda i: value >= lo + i * ((hi - lo) / 20))) AS bin FROM {rows} r JOIN ends USING ({keys}))
, bins AS (SELECT unnest(range(1, 21)) AS bin)
, gen AS (SELECT {by} model, condition, feature, bin, count(*) AS k FROM binned WHERE model <> 'HUMAN' GROUP BY ALL)
, hum AS (SELECT {by} feature, bin, count(*) AS k FROM binned WHERE model = 'HUMAN' GROUP BY ALL)
, gt AS (SELECT {by} model, condition, feature, sum(k) AS n FROM gen GROUP BY ALL)
, ht AS (SELECT {by} feature, sum(k) AS n FROM hum GROUP BY ALL)
, grid AS (SELECT {gby} gt.model, gt.condition, gt.feature, gt.n AS gn, ht.n AS hn, (coalesce(gen.k, 0) + 1e-12) / (gt.n + 20e-12) AS p, (coalesce(hum.k, 0) + 1e-12) / (ht.n + 20e-12) AS q
  FROM gt JOIN ht USING ({hkeys}) CROSS JOIN bins LEFT JOIN gen ON {gon} gen.model = gt.model AND gen.condition = gt.condition AND gen.feature = gt.feature AND gen.bin = bins.bin
  LEFT JOIN hum ON {hon} hum.feature = gt.feature AND hum.bin = bins.bin)
"""


def _hist(rows: str, by: str = "", ends: str = "feature") -> str:
    return _HIST.format(rows=rows, keys=ends, by=f"{by}, " if by else "", gby=f"gt.{by}, " if by else "", hkeys=f"{by}, feature" if by else "feature", gon=f"gen.{by} = gt.{by} AND" if by else "", hon=f"hum.{by} = gt.{by} AND" if by else "")


_JSD = "sum(p * log2(p / ((p + q) / 2))) / 2 + sum(q * log2(q / ((p + q) / 2))) / 2"
SCOPED = CLEAN + ", scoped AS (SELECT * FROM rows_ WHERE region <> 'ENS')"
ENDS = ", ends AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM scoped GROUP BY feature)"

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Registers the function as a query, and its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def r6(df, *cs):
    return df.withColumns({c: F.round(c, 6) for c in cs})


@query("agg_a04_key_means", MEANS + " SELECT key, model, condition, feature, round(value, 6) AS value FROM means WHERE feature IN ('MTLD', 'MDD')")
def key_means(spark, sf):
    return r6(m.long(m.by_key(m.clean(spark, sf)), ["key", "model", "condition"], ["MTLD", "MDD"]), "value")


@query("join_j05_paired_deltas", PAIRED + " SELECT key, model, condition, feature, round(delta, 6) AS delta FROM paired")
def paired_deltas(spark, sf):
    return r6(m.deltas(spark, sf), "delta").select("key", "model", "condition", "feature", "delta")


@query("r6_effect_sizes", EFFECTS + " SELECT model, condition, feature, n, round(mean_delta, 6) AS mean_delta, round(sd_delta, 6) AS sd_delta, round(dz, 6) AS dz FROM sized")
def effect_sizes(spark, sf):
    return r6(m.effect_sizes(spark, sf), "mean_delta", "sd_delta", "dz")


@query("agg_a11_mean_abs_dz", EFFECTS + " SELECT model, condition, count(*) AS features, round(avg(abs(dz)), 6) AS mean_abs_dz FROM sized GROUP BY ALL")
def mean_abs_dz(spark, sf):
    return r6(m.effect_sizes(spark, sf).groupBy("model", "condition").agg(F.count(F.lit(1)).alias("features"), F.avg(F.abs("dz")).alias("mean_abs_dz")), "mean_abs_dz")


@query("agg_a20_feature_count_check", EFFECTS + " SELECT model, condition, count(*) AS features FROM sized GROUP BY ALL HAVING count(*) <> 22")
def feature_count_check(spark, sf):
    return m.effect_sizes(spark, sf).groupBy("model", "condition").agg(F.count(F.lit(1)).alias("features")).where(F.col("features") != len(m.FEATURES))


@query("win_w01_benjamini_hochberg", EFFECTS + f"""
, tests AS (SELECT model, condition, feature, {_FAMILY} AS family, 2.0 / (1.0 + exp(least(700, abs(dz) * sqrt(n) * 1.702))) AS p FROM sized)
, ranked AS (SELECT *, p * count(*) OVER (PARTITION BY family) / count(*) OVER (PARTITION BY family ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM tests)
SELECT model, condition, feature, family, round(p, 9) AS p, round(least(min(raw) OVER (PARTITION BY family ORDER BY p DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS q FROM ranked""")
def benjamini_hochberg(spark, sf):
    """BH within families, on a logistic approximation of the paired z test's p."""
    e = m.effect_sizes(spark, sf)
    p = F.lit(2.0) / (1.0 + F.exp(F.least(F.lit(700.0), F.abs("dz") * F.sqrt("n") * 1.702)))
    t = m.adjusted(e.select("model", "condition", "feature", m.family(F.col("feature")).alias("family"), p.alias("p")), "p", ["family"])
    return t.select("model", "condition", "feature", "family", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query("r8_pooled_jsd", SCOPED + ENDS + _hist("scoped") + f" SELECT g.model, g.condition, g.feature, CAST(any_value(hn) AS BIGINT) AS n_human, CAST(any_value(gn) AS BIGINT) AS n_generated, round(CASE WHEN any_value(hi) = any_value(lo) THEN 0 ELSE {_JSD} END, 6) AS jsd FROM grid g JOIN ends USING (feature) GROUP BY 1, 2, 3")
def pooled_jsd(spark, sf):
    c = m.clean(spark, sf).where(F.col("region") != m.NATIVE)
    return r6(m.cell_divergences(c, [], m.edges(c)), "jsd")


@query("r9_regional_jsd", SCOPED + ENDS + _hist("scoped", "region") + f" SELECT g.region, g.model, g.condition, g.feature, CAST(any_value(hn) AS BIGINT) AS n_human, CAST(any_value(gn) AS BIGINT) AS n_generated, round(CASE WHEN any_value(hi) = any_value(lo) THEN 0 ELSE {_JSD} END, 6) AS jsd FROM grid g JOIN ends USING (feature) GROUP BY 1, 2, 3, 4")
def regional_jsd(spark, sf):
    c = m.clean(spark, sf).where(F.col("region") != m.NATIVE)
    return r6(m.cell_divergences(c, ["region"], m.edges(c)), "jsd")


@query("agg_a13_histogram", SCOPED + ENDS + """
, b AS (SELECT model, feature, 1 + len(list_filter(range(1, 20), lambda i: value >= lo + i * ((hi - lo) / 20))) AS bin FROM scoped JOIN ends USING (feature))
SELECT model, feature, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY ALL""")
def histogram(spark, sf):
    c = m.clean(spark, sf).where(F.col("region") != m.NATIVE)
    rows = m.long(c, ["model"]).join(F.broadcast(m.edges(c)), "feature").withColumn("bin", m.bin_of("value").cast("long"))
    return rows.groupBy("model", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


_ROBUST = "('" + "', '".join(m.ROBUST) + "')"
_PAIR_HIST = """
, cellends AS (SELECT g.model, g.condition, g.feature, least(g.lo, h.lo) AS lo, greatest(g.hi, h.hi) AS hi FROM (SELECT model, condition, feature, min(value) AS lo, max(value) AS hi FROM used WHERE model <> 'HUMAN' GROUP BY ALL) g
  JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM used WHERE model = 'HUMAN' GROUP BY ALL) h USING (feature))
, b AS (SELECT e.model, e.condition, e.feature, u.model = 'HUMAN' AS human, 1 + len(list_filter(range(1, 20), lambda i: value >= lo + i * ((hi - lo) / 20))) AS bin
  FROM used u JOIN cellends e ON e.feature = u.feature AND (u.model = 'HUMAN' OR (u.model = e.model AND u.condition = e.condition)))
, k AS (SELECT model, condition, feature, bin, count(*) FILTER (WHERE human) AS h, count(*) FILTER (WHERE NOT human) AS g FROM b GROUP BY ALL)
, t AS (SELECT model, condition, feature, sum(h) AS hn, sum(g) AS gn FROM k GROUP BY ALL)
, grid AS (SELECT t.model, t.condition, t.feature, (coalesce(g, 0) + 1e-12) / (gn + 20e-12) AS p, (coalesce(h, 0) + 1e-12) / (hn + 20e-12) AS q
  FROM t CROSS JOIN (SELECT unnest(range(1, 21)) AS bin) x LEFT JOIN k ON k.model = t.model AND k.condition = t.condition AND k.feature = t.feature AND k.bin = x.bin)
"""
_TEST = ", testers AS (SELECT DISTINCT split_part(file_name, '_', 2) || '_' || split_part(file_name, '_', 4) || '|' || topic AS key FROM split_manifest WHERE lower(trim(split)) = 'test')"


@query("r10_pairwise_jsd", SCOPED + f", used AS (SELECT * FROM scoped WHERE feature IN {_ROBUST})" + _PAIR_HIST + f" SELECT model, condition, feature, round({_JSD}, 6) AS jsd FROM grid GROUP BY ALL")
def pairwise_jsd(spark, sf):
    c = m.clean(spark, sf).where(F.col("region") != m.NATIVE)
    return r6(m.pair_divergences(c, m.ROBUST), "jsd")


@query("r11_robust_test_split", CLEAN + _TEST + f", used AS (SELECT * FROM rows_ WHERE region <> 'ENS' AND feature IN {_ROBUST} AND (model <> 'HUMAN' AND condition IN ('zero_shot', 'cot') OR model = 'HUMAN' AND key IN (SELECT key FROM testers)))" + _PAIR_HIST + f" SELECT model, condition, feature, round({_JSD}, 6) AS jsd FROM grid GROUP BY ALL")
def robust_test_split(spark, sf):
    """Human rows of the test split only, against the zero-shot and chain-of-thought cells."""
    t = table(spark, sf, "split_manifest").where(split_name(F.col("split")) == "test")
    f = F.split("file_name", "_")
    keys = t.select(F.concat_ws("|", F.concat_ws("_", f[1], f[3]), "topic").alias("key")).distinct()
    c = m.clean(spark, sf).where(F.col("region") != m.NATIVE)
    used = c.where((F.col("model") != m.HUMAN) & F.col("condition").isin("zero_shot", "cot")).unionByName(c.where(F.col("model") == m.HUMAN).join(keys, "key", "left_semi"))
    return r6(m.pair_divergences(used, m.ROBUST), "jsd")


@query("r12_robust_capped", CLEAN + f"""
, ids AS (SELECT DISTINCT key, region, topic, model, condition FROM clean WHERE region <> 'ENS')
, picked AS (SELECT key, model, condition FROM ids QUALIFY row_number() OVER (PARTITION BY region, topic, model, condition ORDER BY md5(key), key) <= 100)
, used AS (SELECT r.* FROM rows_ r JOIN picked USING (key, model, condition) WHERE feature IN {_ROBUST})""" + _PAIR_HIST + f" SELECT model, condition, feature, round({_JSD}, 6) AS jsd FROM grid GROUP BY ALL")
def robust_capped(spark, sf):
    """At most 100 keys of each region and topic on both sides."""
    from ..operators.samples import first_by_hash

    c = m.clean(spark, sf).where(F.col("region") != m.NATIVE)
    picked = first_by_hash(c.select("key", "region", "topic", "model", "condition").distinct(), ["region", "topic", "model", "condition"], "key", 100)
    return r6(m.pair_divergences(c.join(picked.select("key", "model", "condition"), ["key", "model", "condition"], "left_semi"), m.ROBUST), "jsd")


@query("r7_jsd_of_conditions", SCOPED + """
, ends AS (SELECT min(value) AS lo, max(value) AS hi FROM scoped WHERE feature = 'MTLD')
, k AS (SELECT condition, 1 + len(list_filter(range(1, 20), lambda i: value >= lo + i * ((hi - lo) / 20))) AS bin, count(*) AS n FROM scoped, ends WHERE feature = 'MTLD' AND model <> 'HUMAN' GROUP BY ALL)
, t AS (SELECT condition, sum(n) AS n FROM k GROUP BY ALL)
, d AS (SELECT t.condition, bin.b, (coalesce(k.n, 0) + 1e-12) / (t.n + 20e-12) AS p FROM t CROSS JOIN (SELECT unnest(range(1, 21)) AS b) bin LEFT JOIN k ON k.condition = t.condition AND k.bin = bin.b)
SELECT x.condition AS condition_a, y.condition AS condition_b, round(sum(x.p * log2(x.p / ((x.p + y.p) / 2))) / 2 + sum(y.p * log2(y.p / ((x.p + y.p) / 2))) / 2, 6) AS jsd FROM d x JOIN d y ON x.b = y.b AND x.condition < y.condition GROUP BY ALL""")
def jsd_of_conditions(spark, sf):
    """Divergence of MTLD between each two conditions; four rows meet four."""
    c = m.clean(spark, sf).where(F.col("region") != m.NATIVE)
    rows = m.long(c, ["model", "condition"], ["MTLD"]).join(F.broadcast(m.edges(c, ["MTLD"])), "feature").where(F.col("model") != m.HUMAN).withColumn("bin", m.bin_of("value"))
    h = m.histograms(rows, ["condition"])
    a, b = (h.select(F.col("condition").alias(f"condition_{x}"), F.col("counts").alias(x)) for x in "ab")
    return a.join(b, F.col("condition_a") < F.col("condition_b")).select("condition_a", "condition_b", F.round(m.divergence(F.col("a"), F.col("b")), 6).alias("jsd"))


@query("agg_a09_column_profile", CLEAN + " SELECT feature, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS filled, CAST((SELECT count(*) FROM clean) - count(*) AS BIGINT) AS missing FROM rows_ GROUP BY feature")
def column_profile(spark, sf):
    c = m.clean(spark, sf)
    one = c.agg(*(F.struct(F.min(f).alias("low"), F.max(f).alias("high"), F.count(f).alias("filled"), F.count_if(F.col(f).isNull()).alias("missing")).alias(f) for f in m.FEATURES))
    return r6(one.unpivot([], m.FEATURES, "feature", "s").select("feature", "s.*"), "low", "high")


@query("agg_a08_pivot_count", "SELECT model, CAST(count(*) FILTER (WHERE condition = 'baseline') AS BIGINT) AS baseline, CAST(count(*) FILTER (WHERE condition = 'cot') AS BIGINT) AS cot, CAST(count(*) FILTER (WHERE condition = 'few_shot') AS BIGINT) AS few_shot, CAST(count(*) FILTER (WHERE condition = 'one_shot') AS BIGINT) AS one_shot, CAST(count(*) FILTER (WHERE condition = 'zero_shot') AS BIGINT) AS zero_shot FROM features_all_with_neosca GROUP BY model")
def pivot_count(spark, sf):
    names = ["baseline", "cot", "few_shot", "one_shot", "zero_shot"]
    return table(spark, sf, "features_all_with_neosca").groupBy("model").pivot("condition", names).count().na.fill(0, names)


@query("agg_a05_named_aggregates", CLEAN + " SELECT condition, feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high FROM rows_ WHERE feature IN " + _ROBUST + " GROUP BY ALL")
def named_aggregates(spark, sf):
    rows = m.long(m.clean(spark, sf), ["condition"], m.ROBUST)
    return r6(rows.groupBy("condition", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high")), "mean", "sd", "low", "high")


@query("agg_a10_global_aggregates", EFFECTS + " SELECT round(avg(mean_delta), 6) AS mean_delta, count(*) FILTER (WHERE mean_delta > 0) AS positive, count(*) AS tests FROM sized")
def global_aggregates(spark, sf):
    return m.effect_sizes(spark, sf).agg(F.round(F.avg("mean_delta"), 6).alias("mean_delta"), F.count_if(F.col("mean_delta") > 0).alias("positive"), F.count(F.lit(1)).alias("tests"))


@query("agg_a17_percentiles", PAIRED + " SELECT model, condition, feature, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high FROM paired WHERE region <> 'ENS' AND feature IN ('MTLD', 'MDD', 'MLT') GROUP BY ALL")
def percentiles(spark, sf):
    """Linear percentiles of the deltas. Exact, as the definition asks: a group's values meet in one task."""
    d = m.long(m.paired(spark, sf).where(F.col("region") != m.NATIVE), ["model", "condition"], ["MTLD", "MDD", "MLT"])
    return r6(d.groupBy("model", "condition", "feature").agg(F.percentile("value", [0.025, 0.975]).alias("p")).select("model", "condition", "feature", F.col("p")[0].alias("low"), F.col("p")[1].alias("high")), "low", "high")


@query("join_j02_three_keys", MEANS + ", a AS (SELECT key, model, condition, value AS mtld FROM means WHERE feature = 'MTLD'), b AS (SELECT key, model, condition, value AS mlt FROM means WHERE feature = 'MLT') SELECT a.key, a.model, a.condition, round(mtld, 6) AS mtld, round(mlt, 6) AS mlt FROM a LEFT JOIN b USING (key, model, condition)")
def three_keys(spark, sf):
    """The syntactic column joined back to the matrix on three keys."""
    means = m.by_key(m.clean(spark, sf))
    a, b = means.where("MTLD is not null").select("key", "model", "condition", F.col("MTLD").alias("mtld")), means.where("MLT is not null").select("key", "model", "condition", F.col("MLT").alias("mlt"))
    return r6(a.join(b, ["key", "model", "condition"], "left"), "mtld", "mlt")


@query("join_j06_computed_back", EFFECTS + ", fam AS (SELECT feature, avg(abs(dz)) AS feature_mean FROM sized GROUP BY feature) SELECT model, condition, feature, round(dz, 6) AS dz, round(feature_mean, 6) AS feature_mean FROM sized LEFT JOIN fam USING (feature)")
def computed_back(spark, sf):
    e = m.effect_sizes(spark, sf).select("model", "condition", "feature", "dz")
    return r6(e.withColumn("feature_mean", F.avg(F.abs("dz")).over(Window.partitionBy("feature"))), "dz", "feature_mean")


@query("join_j13_coverage", """WITH f AS (SELECT DISTINCT key, model, condition FROM features_all_with_neosca WHERE model <> 'HUMAN'), h AS (SELECT DISTINCT key FROM features_all_with_neosca WHERE model = 'HUMAN')
SELECT model, condition, count(*) AS keys, count(*) FILTER (WHERE h.key IS NULL) AS without_human FROM f LEFT JOIN h USING (key) GROUP BY ALL""")
def coverage(spark, sf):
    f = table(spark, sf, "features_all_with_neosca").select("key", "model", "condition")
    h = f.where("model = 'HUMAN'").select("key").distinct().withColumn("human", F.lit(1))
    g = f.where("model <> 'HUMAN'").distinct().join(h, "key", "left")
    return g.groupBy("model", "condition").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("human").isNull()).alias("without_human"))


@query("join_j12_aligned", PAIRED + ", keys AS (SELECT DISTINCT key FROM clean WHERE model = 'HUMAN' AND region <> 'ENS') SELECT keys.key, round(delta, 6) AS delta FROM keys LEFT JOIN paired p ON p.key = keys.key AND model = 'aster-2-base' AND condition = 'zero_shot' AND feature = 'MTLD'")
def aligned(spark, sf):
    """Values for a fixed list of keys, null where there is none."""
    c = m.clean(spark, sf)
    keys = c.where((F.col("model") == m.HUMAN) & (F.col("region") != m.NATIVE)).select("key").distinct()
    d = m.paired(spark, sf).where("model = 'aster-2-base' and condition = 'zero_shot'").select("key", F.round("MTLD", 6).alias("delta"))
    return keys.join(d, "key", "left")


@query("join_j14_dense_grid", EFFECTS + ", mm AS (SELECT DISTINCT model FROM clean WHERE model <> 'HUMAN'), cc AS (SELECT DISTINCT condition FROM clean WHERE condition <> 'baseline'), ff AS (SELECT DISTINCT feature FROM rows_) SELECT mm.model, cc.condition, ff.feature, coalesce(n, 0) AS n FROM mm CROSS JOIN cc CROSS JOIN ff LEFT JOIN sized s ON s.model = mm.model AND s.condition = cc.condition AND s.feature = ff.feature")
def dense_grid(spark, sf):
    """Models by conditions by features, zero where a cell has none; the three lists are short."""
    c = m.clean(spark, sf)
    models, conditions = c.where("model <> 'HUMAN'").select("model").distinct(), c.where("condition <> 'baseline'").select("condition").distinct()
    grid = F.broadcast(models).crossJoin(F.broadcast(conditions)).withColumn("feature", F.explode(F.array(*map(F.lit, m.FEATURES))))
    return grid.join(m.effect_sizes(spark, sf).select("model", "condition", "feature", "n"), ["model", "condition", "feature"], "left").na.fill(0, ["n"])
