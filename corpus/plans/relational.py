"""Queries by plain relational operators on the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import condition_name, file_writer, split_name, table, writer

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(g):
        QUERIES[name] = g
        if sql:
            SQL[name] = sql
        return g

    return put


# The condition and split notations, and the writer of a file name, in SQL.
COND = "CASE regexp_replace(lower(condition), '[^a-z0-9]', '', 'g') WHEN 'zeroshot' THEN 'zero_shot' WHEN 'c0' THEN 'zero_shot' WHEN 'oneshot' THEN 'one_shot' WHEN 'c1' THEN 'one_shot' WHEN 'fewshot' THEN 'few_shot' WHEN 'c2' THEN 'few_shot' WHEN 'cot' THEN 'cot' WHEN 'c3' THEN 'cot' END"
SPLIT = "CASE regexp_replace(lower(split), '[^a-z]', '', 'g') WHEN 'validation' THEN 'dev' WHEN 'pool' THEN 'pool' WHEN 'train' THEN 'train' WHEN 'dev' THEN 'dev' WHEN 'test' THEN 'test' END"
WRITER = "split_part(file_name, '_', 2) || '_' || split_part(file_name, '_', 4)"
GEN = f"WITH gen AS (SELECT rec_id, source_id, topic, model_id, {COND} AS cond, generated_text, prompt_tokens, completion_tokens, latency_s, written_at FROM generated_corpus)"
MAN = f"man AS (SELECT rec_id, {WRITER} AS writer, split_part(file_name, '_', 2) AS region, topic, proficiency, {SPLIT} AS split, text, file_name FROM split_manifest)"


def gen(spark, sf):
    """Generated rows with the standard notation of their condition."""
    return table(spark, sf, "generated_corpus").withColumn("cond", condition_name(F.col("condition")))


def man(spark, sf):
    """Rows of the manifest with writer, region and split in their standard notation."""
    w = file_writer(F.col("file_name"))
    return table(spark, sf, "split_manifest").select("rec_id", w.alias("writer"), F.substring(w, 1, 3).alias("region"), "topic", "proficiency", split_name(F.col("split")).alias("split"), "text", "file_name")


def datasets(spark, sf):
    return table(spark, sf, "l1_dataset").select("rec_id", "dataset", "label", "text", split_name(F.col("split")).alias("split"), writer(F.substring_index("key", "|", 1)).alias("writer"), "key", "topic")


DS = f"ds AS (SELECT rec_id, dataset, label, text, {SPLIT} AS split, split_part(key, '|', 1) AS writer, key, topic FROM l1_dataset)"
n = lambda name="n": F.count(F.lit(1)).alias(name)


# Scans
@query("scan_s07_full", "SELECT rec_id, id, region, topic, proficiency, text, file_name, split FROM exemplar_pool")
def full_scan(spark, sf):
    return table(spark, sf, "exemplar_pool")


@query("scan_s06_s08_projected", "SELECT key, model, condition FROM features_all_with_neosca")
def projected_scan(spark, sf):
    return table(spark, sf, "features_all_with_neosca").select("key", "model", "condition")


@query("scan_s09_manifest", f"WITH {MAN} SELECT rec_id, writer, region, topic, split FROM man")
def manifest_scan(spark, sf):
    return man(spark, sf).select("rec_id", "writer", "region", "topic", "split")


@query("scan_s04_file_names", "SELECT file_name, split_part(file_name, '_', 2) || '_' || split_part(file_name, '_', 4) AS id, split_part(file_name, '_', 2) AS region, CASE WHEN split_part(file_name, '_', 3) LIKE '%PTJ%' THEN 'Part-time Job' WHEN split_part(file_name, '_', 3) LIKE '%SMK%' THEN 'Smoking Ban' ELSE split_part(file_name, '_', 3) END AS topic, regexp_extract(file_name, '^WE_[A-Z]{3}_[A-Z0-9]+_[0-9]+_([A-Z0-9_]+)[.]txt', 1) AS proficiency FROM exemplar_pool WHERE regexp_matches(file_name, '^WE_([A-Z]{3})_([A-Z0-9]+)_([0-9]+)_([A-Z0-9_]+)[.]txt')")
def file_names(spark, sf):
    from ..sources.readers import named

    return named(table(spark, sf, "exemplar_pool").select("file_name")).select("file_name", "id", "region", "topic", "proficiency")


# Projections, filters, duplicates
@query("proj_p01_equality_slice", f"{GEN} SELECT rec_id, source_id, topic FROM gen WHERE model_id = 'aster-2-base' AND cond = 'zero_shot'")
def equality_slice(spark, sf):
    return gen(spark, sf).where("model_id = 'aster-2-base' and cond = 'zero_shot'").select("rec_id", "source_id", "topic")


@query("proj_p02_exclude_sentinel", "SELECT key, model, condition FROM features_all_with_neosca WHERE model <> 'HUMAN' AND key NOT LIKE 'ENS%'")
def exclude_sentinel(spark, sf):
    return table(spark, sf, "features_all_with_neosca").where("model <> 'HUMAN' and not key like 'ENS%'").select("key", "model", "condition")


@query("proj_p03_rename", "SELECT rec_id AS record, source_id AS writer, model_id AS model FROM generated_corpus")
def rename(spark, sf):
    return table(spark, sf, "generated_corpus").select(F.col("rec_id").alias("record"), F.col("source_id").alias("writer"), F.col("model_id").alias("model"))


@query("proj_p04_computed_key", f"{GEN} SELECT rec_id, concat_ws('|', source_id, topic) AS key, concat_ws('|', source_id, topic, model_id, cond) AS full_key FROM gen")
def computed_key(spark, sf):
    return gen(spark, sf).select("rec_id", F.concat_ws("|", "source_id", "topic").alias("key"), F.concat_ws("|", "source_id", "topic", "model_id", "cond").alias("full_key"))


@query("proj_p05_arithmetic", "SELECT rec_id, prompt_tokens + completion_tokens AS tokens, round(completion_tokens / prompt_tokens, 6) AS ratio FROM generated_corpus WHERE prompt_tokens > 0")
def arithmetic(spark, sf):
    return table(spark, sf, "generated_corpus").where("prompt_tokens > 0").select("rec_id", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.round(F.col("completion_tokens") / F.col("prompt_tokens"), 6).alias("ratio"))


@query("proj_p06_keep_list", "SELECT rec_id, id, topic, split FROM exemplar_pool")
def keep_list(spark, sf):
    return table(spark, sf, "exemplar_pool").drop("text", "file_name", "proficiency", "region")


@query("proj_p07_not_null", "SELECT key, model, condition, MTLD AS mtld FROM features_all_with_neosca WHERE MTLD IS NOT NULL AND NOT isnan(MTLD)")
def not_null(spark, sf):
    return table(spark, sf, "features_all_with_neosca").where("MTLD is not null and not isnan(MTLD)").select("key", "model", "condition", F.col("MTLD").alias("mtld"))


@query("proj_p08_min_length", "SELECT rec_id, length(generated_text) AS chars FROM generated_corpus WHERE length(generated_text) >= 10")
def min_length(spark, sf):
    return table(spark, sf, "generated_corpus").where("length(generated_text) >= 10").select("rec_id", F.length("generated_text").cast("long").alias("chars"))


@query("proj_p09_keep_last", f"{GEN} SELECT source_id, topic, model_id, cond, max(rec_id) AS rec_id FROM (SELECT *, max(written_at) OVER (PARTITION BY source_id, topic, model_id, cond) AS latest FROM gen) WHERE written_at = latest GROUP BY ALL")
def keep_last(spark, sf):
    """The last delivery of each cell, of equal times the greatest rec_id; an aggregate, so that a hot writer's rows are combined before they move."""
    g = gen(spark, sf).where("written_at is not null").groupBy("source_id", "topic", "model_id", "cond").agg(F.max(F.struct("written_at", "rec_id")).alias("x"))
    return g.select("source_id", "topic", "model_id", "cond", "x.rec_id")


@query("proj_p10_keep_first", f"WITH {MAN} SELECT writer, topic, min(rec_id) AS rec_id FROM man GROUP BY ALL")
def keep_first(spark, sf):
    return man(spark, sf).groupBy("writer", "topic").agg(F.min("rec_id").alias("rec_id"))


@query("proj_p11_duplicates", f"{GEN}, c AS (SELECT source_id, topic, model_id, cond, count(*) AS n FROM gen GROUP BY ALL) SELECT n AS deliveries, count(*) AS cells FROM c GROUP BY n")
def duplicates(spark, sf):
    return gen(spark, sf).groupBy("source_id", "topic", "model_id", "cond").agg(n()).groupBy(F.col("n").alias("deliveries")).agg(n("cells"))


@query("proj_p13_numeric_columns", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM features_all_with_neosca) WHERE column_type IN ('BIGINT', 'DOUBLE', 'INTEGER')")
def numeric_columns(spark, sf):
    return spark.createDataFrame([(c,) for c, t in table(spark, sf, "features_all_with_neosca").dtypes if t in ("bigint", "int", "double", "float")], "name string")


@query("proj_p14_case", "SELECT DISTINCT topic, CASE WHEN topic LIKE '%Part-time%' THEN 'PTJ' WHEN topic LIKE '%Smoking%' THEN 'SMK' ELSE topic END AS code FROM l1_dataset")
def case(spark, sf):
    return table(spark, sf, "l1_dataset").select("topic", F.when(F.col("topic").contains("Part-time"), "PTJ").when(F.col("topic").contains("Smoking"), "SMK").otherwise(F.col("topic")).alias("code")).distinct()


_NAMES = "SELECT DISTINCT dataset, CASE WHEN dataset = 'oracle_human' THEN 'human' ELSE regexp_extract(dataset, '^sim_(.+)_(zero_shot|one_shot|few_shot|fullmix|eqmix|cot)$', 1) END AS model, CASE WHEN dataset = 'oracle_human' THEN 'oracle' ELSE regexp_extract(dataset, '^sim_(.+)_(zero_shot|one_shot|few_shot|fullmix|eqmix|cot)$', 2) END AS condition FROM l1_dataset"


@query("proj_p15_name_parts", _NAMES)
def name_parts(spark, sf):
    """A data set's model and condition; a name of another form raises."""
    p = r"^sim_(.+)_(zero_shot|one_shot|few_shot|fullmix|eqmix|cot)$"
    d = table(spark, sf, "l1_dataset").select("dataset").distinct()
    part = lambda k, human: F.when(F.col("dataset") == "oracle_human", human).when(F.col("dataset").rlike(p), F.regexp_extract("dataset", p, k)).otherwise(F.raise_error(F.concat(F.lit("unknown data set "), "dataset")))
    return d.select("dataset", part(1, "human").alias("model"), part(2, "oracle").alias("condition"))


@query("proj_p16_longest_prefix", "WITH m AS (SELECT DISTINCT model_id AS model FROM generated_corpus), d AS (SELECT DISTINCT dataset FROM l1_dataset) SELECT d.dataset, arg_max(m.model, length(m.model)) AS model FROM d LEFT JOIN m ON starts_with(d.dataset, 'sim_' || m.model || '_') GROUP BY 1")
def longest_prefix(spark, sf):
    """The longest model name that a data set's name begins with; both lists hold names, not rows."""
    m, d = table(spark, sf, "generated_corpus").select(F.col("model_id").alias("model")).distinct(), table(spark, sf, "l1_dataset").select("dataset").distinct()
    return d.join(F.broadcast(m), F.startswith("dataset", F.concat(F.lit("sim_"), "model", F.lit("_"))), "left").groupBy("dataset").agg(F.max_by("model", F.length("model")).alias("model"))


@query("proj_p17_category_filter", f"{GEN} SELECT cond AS condition, count(*) AS n FROM gen WHERE cond IN ('zero_shot', 'one_shot', 'few_shot', 'cot') GROUP BY cond")
def category_filter(spark, sf):
    return gen(spark, sf).where(F.col("cond").isin("zero_shot", "one_shot", "few_shot", "cot")).groupBy(F.col("cond").alias("condition")).agg(n())


@query("proj_p12_stride_slice", "SELECT count(*) AS n FROM generated_corpus WHERE rec_id IS NOT NULL")
def stride_slices(spark, sf):
    """Three strides of the rows by number laid together again: nothing is left out and nothing twice."""
    g = table(spark, sf, "generated_corpus").where("rec_id is not null").select("rec_id")
    parts = [g.where(F.pmod("rec_id", F.lit(3)) == k) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(n())


# Joins
@query("join_j01_left", f"{GEN}, {MAN}, meta AS (SELECT writer, topic, min(proficiency) AS proficiency FROM man GROUP BY ALL) SELECT rec_id, source_id, gen.topic, proficiency FROM gen LEFT JOIN meta ON writer = source_id AND meta.topic = gen.topic")
def left_join(spark, sf):
    meta = man(spark, sf).groupBy(F.col("writer").alias("source_id"), "topic").agg(F.min("proficiency").alias("proficiency"))
    return gen(spark, sf).select("rec_id", "source_id", "topic").join(meta, ["source_id", "topic"], "left")


@query("join_j03_one_to_one", f"{GEN}, {MAN}, a AS (SELECT concat_ws('|', writer, topic) AS key, count(*) AS pool_rows FROM man GROUP BY 1), b AS (SELECT concat_ws('|', source_id, topic) AS key, count(*) AS generated FROM gen GROUP BY 1) SELECT key, pool_rows, generated FROM a JOIN b USING (key)")
def one_to_one(spark, sf):
    """An inner join that raises if a key stands twice on a side."""
    from ..operators.checks import unique

    a = man(spark, sf).groupBy(F.concat_ws("|", "writer", "topic").alias("key")).agg(n("pool_rows"))
    b = gen(spark, sf).groupBy(F.concat_ws("|", "source_id", "topic").alias("key")).agg(n("generated"))
    return unique(a, ["key"]).join(unique(b, ["key"]), "key")


@query("join_j04_agreement", f"{GEN}, {MAN}, m AS (SELECT writer, min(region) AS region FROM man GROUP BY 1), g AS (SELECT DISTINCT source_id FROM gen) SELECT count(*) AS writers, count(*) FILTER (WHERE region IS NULL) AS missing, count(*) FILTER (WHERE region <> substr(source_id, 1, 3)) AS differing FROM g LEFT JOIN m ON writer = source_id")
def agreement(spark, sf):
    m = man(spark, sf).groupBy(F.col("writer").alias("source_id")).agg(F.min("region").alias("region"))
    j = gen(spark, sf).select("source_id").distinct().join(m, "source_id", "left")
    return j.agg(n("writers"), F.count_if(F.col("region").isNull()).alias("missing"), F.count_if(F.col("region") != F.substring("source_id", 1, 3)).alias("differing"))


@query("join_j07_semi", f"{GEN}, {MAN} SELECT rec_id FROM gen WHERE source_id IN (SELECT writer FROM man WHERE split = 'test')")
def semi_join(spark, sf):
    return gen(spark, sf).join(man(spark, sf).where("split = 'test'").select(F.col("writer").alias("source_id")).distinct(), "source_id", "left_semi").select("rec_id")


@query("join_j08_anti_leakage", f"{GEN}, {MAN}, t AS (SELECT DISTINCT writer, topic FROM man WHERE split = 'test') SELECT rec_id FROM gen WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.writer = source_id AND t.topic = gen.topic)")
def anti_leakage(spark, sf):
    t = man(spark, sf).where("split = 'test'").select(F.col("writer").alias("source_id"), "topic").distinct()
    return gen(spark, sf).join(t, ["source_id", "topic"], "left_anti").select("rec_id")


@query("join_j09_anti_resume", f"{GEN}, {MAN}, w AS (SELECT DISTINCT writer, topic FROM man), d AS (SELECT DISTINCT source_id, topic FROM gen WHERE model_id = 'fjord-m2' AND cond = 'cot' AND generated_text IS NOT NULL) SELECT writer, topic FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.source_id = writer AND d.topic = w.topic)")
def anti_resume(spark, sf):
    """What a run of one cell still has to make."""
    done = gen(spark, sf).where("model_id = 'fjord-m2' and cond = 'cot' and generated_text is not null").select(F.col("source_id").alias("writer"), "topic").distinct()
    return man(spark, sf).select("writer", "topic").distinct().join(done, ["writer", "topic"], "left_anti")


PERSONAS = {"CHN": "Chinese", "HKG": "Hong Kong", "IDN": "Indonesian", "JPN": "Japanese", "KOR": "Korean", "PAK": "Pakistani", "PHL": "Filipino", "SIN": "Singaporean", "THA": "Thai", "TWN": "Taiwanese"}


@query("join_j10_t17_lookup", "SELECT DISTINCT substr(source_id, 1, 3) AS region, CASE substr(source_id, 1, 3) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PERSONAS.items()) + " ELSE substr(source_id, 1, 3) END AS persona FROM generated_corpus")
def lookup(spark, sf):
    """A word for each region; a region that has none stands for itself."""
    m = F.create_map(*(F.lit(x) for kv in PERSONAS.items() for x in kv))
    r = F.substring("source_id", 1, 3)
    return table(spark, sf, "generated_corpus").select(r.alias("region"), F.coalesce(F.try_element_at(m, r), r).alias("persona")).distinct()


@query("join_j15_cell_outcome", f"{GEN}, {DS}, c AS (SELECT model_id, cond, count(*) AS texts FROM gen WHERE cond IS NOT NULL GROUP BY ALL), o AS (SELECT dataset, count(*) AS rows_ FROM ds GROUP BY 1) SELECT model_id, cond AS condition, texts, rows_ AS dataset_rows FROM c LEFT JOIN o ON dataset = 'sim_' || model_id || '_' || cond")
def cell_outcome(spark, sf):
    c = gen(spark, sf).where("cond is not null").groupBy("model_id", F.col("cond").alias("condition")).agg(n("texts"))
    o = table(spark, sf, "l1_dataset").groupBy("dataset").agg(n("dataset_rows"))
    return c.withColumn("dataset", F.concat_ws("_", F.lit("sim"), "model_id", "condition")).join(F.broadcast(o), "dataset", "left").drop("dataset")


# Aggregates
@query("agg_a01_group_count", f"WITH {MAN} SELECT region, topic, count(*) AS n FROM man GROUP BY ALL")
def group_count(spark, sf):
    return man(spark, sf).groupBy("region", "topic").agg(n())


@query("agg_a02_value_counts", f"{GEN} SELECT model_id, count(*) AS n FROM gen GROUP BY 1 ORDER BY n DESC, model_id")
def value_counts(spark, sf):
    return gen(spark, sf).groupBy("model_id").agg(n()).orderBy(F.desc("n"), "model_id")


@query("agg_a03_count_distinct", f"WITH {MAN} SELECT region, count(DISTINCT writer) AS writers, count(DISTINCT (writer, topic)) AS essays FROM man GROUP BY region")
def count_distinct(spark, sf):
    return man(spark, sf).groupBy("region").agg(F.count_distinct("writer").alias("writers"), F.count_distinct(F.struct("writer", "topic")).alias("essays"))


@query("agg_a07_min_of_conditional_counts", f"WITH {MAN}, c AS (SELECT region, topic, count(*) FILTER (WHERE split = 'test') AS k FROM man GROUP BY ALL) SELECT min(k) AS smallest FROM c")
def min_of_counts(spark, sf):
    return man(spark, sf).groupBy("region", "topic").agg(F.count_if(F.col("split") == "test").alias("k")).agg(F.min("k").alias("smallest"))



@query("agg_a12_token_totals", f"{GEN} SELECT model_id, cond AS condition, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) AS texts, round(avg(CASE WHEN isnan(latency_s) THEN NULL ELSE latency_s END), 6) AS mean_latency FROM gen GROUP BY ALL")
def token_totals(spark, sf):
    """M12 too: what each cell used."""
    lat = F.when(~F.isnan("latency_s"), F.col("latency_s"))
    return gen(spark, sf).groupBy("model_id", F.col("cond").alias("condition")).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), n("texts"), F.round(F.avg(lat), 6).alias("mean_latency"))


_PRED = f"WITH {DS}, votes AS (SELECT dataset, writer, label, count(*) AS k FROM ds WHERE split = 'train' AND label IS NOT NULL GROUP BY ALL), base AS (SELECT dataset, substr(writer, 1, 3) AS region, label, sum(k) AS k FROM votes GROUP BY ALL), guess AS (SELECT dataset, region, arg_max(label, k * 1000 - label) AS predicted FROM base GROUP BY ALL), ev AS (SELECT d.dataset, d.label, g.predicted FROM ds d JOIN guess g ON g.dataset = d.dataset AND g.region = substr(d.writer, 1, 3) WHERE d.split = 'test' AND d.label IS NOT NULL)"


def predictions(spark, sf):
    """(dataset, label, predicted) of test rows; predicted is the most frequent label of the region's training rows."""
    d = datasets(spark, sf).where("label is not null").withColumn("region", F.substring("writer", 1, 3)).withColumn("label", F.col("label").cast("long"))
    guess = d.where("split = 'train'").groupBy("dataset", "region", "label").agg(n("k")).groupBy("dataset", "region").agg(F.max_by("label", F.col("k") * 1000 - F.col("label")).alias("predicted"))
    return d.where("split = 'test'").join(F.broadcast(guess), ["dataset", "region"]).select("dataset", "label", "predicted")


@query("agg_a14_confusion_metrics", _PRED + """
, cm AS (SELECT dataset, label, predicted, count(*) AS k FROM ev GROUP BY ALL), cls AS (SELECT dataset, label AS c FROM cm UNION SELECT dataset, predicted FROM cm)
, f1 AS (SELECT cls.dataset, c, coalesce(sum(k) FILTER (WHERE label = c AND predicted = c), 0) AS tp, coalesce(sum(k) FILTER (WHERE label <> c AND predicted = c), 0) AS fp, coalesce(sum(k) FILTER (WHERE label = c AND predicted <> c), 0) AS fn FROM cls JOIN cm USING (dataset) GROUP BY ALL)
, acc AS (SELECT dataset, sum(k) FILTER (WHERE label = predicted) / sum(k) AS a, CAST(sum(k) AS BIGINT) AS n FROM cm GROUP BY 1)
SELECT dataset, n, round(any_value(a), 6) AS accuracy, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM f1 JOIN acc USING (dataset) GROUP BY dataset, n""")
def confusion_metrics(spark, sf):
    from ..operators.evaluation import confusion

    return confusion(predictions(spark, sf), ["dataset"], "label", "predicted")


@query("agg_a15_matthews", _PRED + ", b AS (SELECT dataset, label = 0 AS y, predicted = 0 AS p FROM ev), c AS (SELECT dataset, CAST(count(*) FILTER (WHERE y AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT y AND NOT p) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE NOT y AND p) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE y AND NOT p) AS DOUBLE) AS fn FROM b GROUP BY 1) SELECT dataset, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM c")
def matthews(spark, sf):
    from ..operators.evaluation import matthews as mcc

    p = predictions(spark, sf).select("dataset", (F.col("label") == 0).alias("y"), (F.col("predicted") == 0).alias("p"))
    return mcc(p, ["dataset"], "y", "p")


@query("agg_a16_mean_vector_argmax", "WITH e AS (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM e GROUP BY ALL) SELECT label, CAST(arg_max(i, round(v, 9) * 1000 - i * 1e-9) AS BIGINT) AS top FROM m GROUP BY label")
def mean_vector_argmax(spark, sf):
    """The place of the largest mean of a group's vectors, the first of equals."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return e.groupBy("label").agg(F.max_by("i", F.round("v", 9) * 1000 - F.col("i") * 1e-9).cast("long").alias("top"))


@query("agg_a19_argmax_by_key", f"{GEN} SELECT model_id, arg_max(rec_id, written_at) AS latest FROM gen WHERE written_at IS NOT NULL AND written_at IN (SELECT max(written_at) FROM gen GROUP BY model_id) GROUP BY model_id HAVING count(*) > 0")
def argmax_by_key(spark, sf):
    return gen(spark, sf).groupBy("model_id").agg(F.max_by("rec_id", "written_at").alias("latest"))


# Windows, order, limits
@query("win_w03_first_k", f"WITH {MAN}, r AS (SELECT region, topic, file_name, row_number() OVER (PARTITION BY region, topic ORDER BY file_name) AS k FROM (SELECT DISTINCT region, topic, file_name FROM man WHERE split = 'pool')) SELECT region, topic, string_agg(file_name, ' ' ORDER BY k) AS exemplars FROM r WHERE k <= 3 GROUP BY ALL")
def first_k(spark, sf):
    """The first three file names of each region and topic; a bounded window, so Spark keeps three rows a group before it moves them."""
    w = Window.partitionBy("region", "topic").orderBy("file_name")
    r = man(spark, sf).where("split = 'pool'").select("region", "topic", "file_name").distinct().withColumn("k", F.row_number().over(w)).where("k <= 3")
    return r.groupBy("region", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "file_name"))), lambda x: x["file_name"]), " ").alias("exemplars"))


@query("win_w04_keep_last_rank", f"WITH {DS} SELECT dataset, key, max(rec_id) AS rec_id FROM ds GROUP BY ALL")
def keep_last_rank(spark, sf):
    return datasets(spark, sf).groupBy("dataset", "key").agg(F.max("rec_id").alias("rec_id"))


@query("win_w06_ordinals", f"WITH {MAN} SELECT rec_id, row_number() OVER (ORDER BY rec_id) AS ordinal FROM man WHERE rec_id IS NOT NULL")
def ordinals(spark, sf):
    """A number for each row in order of rec_id: counts by range first, then the place within a range, so that no task orders all rows."""
    from ..operators.order import numbered

    return numbered(man(spark, sf).where("rec_id is not null").select("rec_id"), "rec_id", "ordinal")


@query("ord_o01_sorted", f"{GEN} SELECT model_id, cond AS condition, count(*) AS n FROM gen GROUP BY ALL ORDER BY 1, 2")
def ordered(spark, sf):
    return gen(spark, sf).groupBy("model_id", F.col("cond").alias("condition")).agg(n()).orderBy("model_id", "condition")


@query("ord_o02_limit", "SELECT rec_id, completion_tokens FROM generated_corpus WHERE completion_tokens IS NOT NULL ORDER BY completion_tokens DESC, rec_id LIMIT 10")
def limit(spark, sf):
    """The ten longest completions: a report of the top."""
    return table(spark, sf, "generated_corpus").where("completion_tokens is not null").select("rec_id", "completion_tokens").orderBy(F.desc("completion_tokens"), "rec_id").limit(10)


# Sets
@query("set_u01_union_all", f"WITH {MAN}, {DS} SELECT rec_id, split FROM man UNION ALL SELECT rec_id, split FROM ds")
def union_all(spark, sf):
    return man(spark, sf).select("rec_id", "split").unionByName(datasets(spark, sf).select("rec_id", "split"))


@query("set_u02_union_distinct", f"WITH {MAN}, {DS} SELECT writer FROM man UNION SELECT writer FROM ds")
def union_distinct(spark, sf):
    return man(spark, sf).select("writer").unionByName(datasets(spark, sf).select("writer")).distinct()


@query("set_u03_intersect", f"WITH {MAN} SELECT writer FROM man WHERE split = 'pool' INTERSECT SELECT writer FROM man WHERE split = 'test'")
def intersect(spark, sf):
    m = man(spark, sf)
    return m.where("split = 'pool'").select("writer").intersect(m.where("split = 'test'").select("writer"))


@query("set_u04_except", f"{GEN}, {MAN} SELECT source_id AS writer FROM gen EXCEPT SELECT writer FROM man")
def except_(spark, sf):
    return gen(spark, sf).select(F.col("source_id").alias("writer")).distinct().join(man(spark, sf).select("writer").distinct(), "writer", "left_anti")


@query("set_u05_equality", f"{GEN}, {MAN} SELECT NOT EXISTS (SELECT topic FROM gen EXCEPT SELECT topic FROM man) AND NOT EXISTS (SELECT topic FROM man EXCEPT SELECT topic FROM gen) AS equal")
def set_equality(spark, sf):
    a, b = gen(spark, sf).select("topic").distinct().withColumn("a", F.lit(1)), man(spark, sf).select("topic").distinct().withColumn("b", F.lit(1))
    return a.join(b, "topic", "full_outer").agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("equal"))


@query("set_u06_partition_complete", f"WITH {MAN} SELECT count(*) AS all_rows, count(*) FILTER (WHERE split = 'pool') AS pool, count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE split IS NULL) AS neither FROM man")
def partition_complete(spark, sf):
    return man(spark, sf).agg(n("all_rows"), F.count_if(F.col("split") == "pool").alias("pool"), F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split").isNull()).alias("neither"))
