"""Queries that build samples, splits and data sets, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..operators import datasets as d
from ..operators import samples
from . import relational as r

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(g):
        QUERIES[name] = g
        if sql:
            SQL[name] = sql
        return g

    return put


ESSAYS = f"WITH {r.MAN}, essays AS (SELECT DISTINCT concat_ws('|', writer, topic) AS key, writer, region, topic FROM man)"


def essays(spark, sf):
    """(key, writer, region, topic) of each human essay once."""
    return r.man(spark, sf).select(F.concat_ws("|", "writer", "topic").alias("key"), "writer", "region", "topic").distinct()


def _rank(by: str, key: str) -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY md5({key}), {key})"


@query("samp_o03_stratified_fraction", ESSAYS + f" SELECT key, region, topic, CASE WHEN {_rank('region, topic', 'key')} <= round_even(count(*) OVER (PARTITION BY region, topic) * 0.2, 0) THEN 'test' ELSE 'pool' END AS split FROM essays")
def stratified_fraction(spark, sf):
    return d.essay_split(essays(spark, sf).select("key", "region", "topic")).select("key", "region", "topic", "split")


_WRITERS = ESSAYS + f", w AS (SELECT DISTINCT writer, region FROM essays), s AS (SELECT writer, {_rank('region', 'writer')} AS k, count(*) OVER (PARTITION BY region) AS n FROM w)"


@query("samp_o04_writer_sample", _WRITERS + " SELECT key, writer, CASE WHEN k <= round_even(n * 0.2, 0) THEN 'test' ELSE 'pool' END AS split FROM essays JOIN s USING (writer)")
def writer_sample(spark, sf):
    return d.writer_split(essays(spark, sf)).select("key", "writer", "split")


def smallest(spark, sf):
    """The keys of the smallest study stratum, native writers left out: the fixed number of the sample, 100 at most."""
    e = essays(spark, sf).where("region <> 'ENS' and topic in ('Part-time Job', 'Smoking Ban')")
    return e, min(100, e.groupBy("region", "topic").count().agg(F.min("count")).first()[0] or 0)


_STUDY = ESSAYS + ", study AS (SELECT * FROM essays WHERE region <> 'ENS' AND topic IN ('Part-time Job', 'Smoking Ban')), least_ AS (SELECT least(100, min(k)) AS n FROM (SELECT count(*) AS k FROM study GROUP BY region, topic))"


@query("samp_o05_r1_fixed_strata", _STUDY + f" SELECT key, region, topic FROM study QUALIFY {_rank('region, topic', 'key')} <= (SELECT n FROM least_)")
def fixed_strata(spark, sf):
    """R1: the same number of keys of each region and topic; a shorter stratum raises."""
    e, n = smallest(spark, sf)
    return samples.exact(e.select("key", "region", "topic"), ["region", "topic"], "key", n)


@query("samp_o06_capped", ESSAYS + f" SELECT key, region, topic FROM essays QUALIFY {_rank('region, topic', 'key')} <= 100")
def capped(spark, sf):
    return d.first(essays(spark, sf).select("key", "region", "topic"), ["region", "topic"], "key", 100)


@query("samp_o07_fixed_per_cell", ESSAYS + f" SELECT key, region, topic FROM essays WHERE region IN (SELECT region FROM essays GROUP BY region, topic) QUALIFY {_rank('region, topic', 'key')} <= 1")
def fixed_per_cell(spark, sf):
    """One key of each cell for validation; a cell without any raises."""
    return samples.exact(essays(spark, sf).select("key", "region", "topic"), ["region", "topic"], "key", 1)


_CELL = f"""{r.GEN}, {r.MAN}, usable AS (SELECT DISTINCT concat_ws('|', source_id, topic) AS key, substr(source_id, 1, 3) AS region, model_id, cond AS condition FROM gen WHERE cond IS NOT NULL AND generated_text IS NOT NULL)"""


def usable(spark, sf):
    g = r.gen(spark, sf).where("cond is not null and generated_text is not null")
    return g.select(F.concat_ws("|", "source_id", "topic").alias("key"), F.substring("source_id", 1, 3).alias("region"), "model_id", F.col("cond").alias("condition")).distinct()


_MIRROR = _CELL + ", one AS (SELECT key, region FROM usable WHERE model_id = 'aster-2-base' AND condition = 'zero_shot'), hum AS (SELECT region, count(DISTINCT (writer, topic)) AS h FROM man WHERE split = 'test' GROUP BY 1), tgt AS (SELECT region, least(h, k) AS n FROM hum JOIN (SELECT region, count(*) AS k FROM one GROUP BY 1) USING (region))"


def mirror_targets(spark, sf):
    """(region, n): what human test essays there are, or the generated ones if they are fewer, so that nothing has to grow."""
    one = usable(spark, sf).where("model_id = 'aster-2-base' and condition = 'zero_shot'").select("key", "region")
    hum = r.man(spark, sf).where("split = 'test'").groupBy("region").agg(F.count_distinct(F.struct("writer", "topic")).alias("h"))
    return one, hum.join(one.groupBy("region").agg(F.count(F.lit(1)).alias("k")), "region").select("region", F.least("h", "k").alias("n"))


@query("samp_o08_mirror", _MIRROR + f" SELECT key, region FROM (SELECT *, {_rank('region', 'key')} AS k FROM one JOIN tgt USING (region)) WHERE k <= n")
def mirror(spark, sf):
    one, t = mirror_targets(spark, sf)
    return samples.mirrored(one, t, ["region"], "key")


_MIX = _CELL + ", u AS (SELECT key, region, condition FROM usable WHERE model_id = 'cobalt-flash'), tgt AS (SELECT region, 4 * min(k) AS n FROM (SELECT region, condition, count(*) AS k FROM u GROUP BY ALL) GROUP BY region HAVING count(*) = 4)"


@query("samp_o09_equal_mix", _MIX + f" SELECT key, region, condition FROM (SELECT *, {_rank('region, condition', 'key')} AS k FROM u JOIN tgt USING (region)) WHERE k <= n // 4")
def equal_mix(spark, sf):
    u = usable(spark, sf).where("model_id = 'cobalt-flash'").select("key", "region", "condition")
    sizes = u.groupBy("region", "condition").agg(F.count(F.lit(1)).alias("k")).groupBy("region").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("c"))
    return d.equal_mix(u, sizes.where("c = 4").select("region", (F.col("k") * 4).alias("n")), "key").select("key", "region", "condition")


@query("samp_o10_grouped_split", ESSAYS + f", pool AS (SELECT DISTINCT e.* FROM essays e JOIN man m ON m.writer = e.writer AND m.topic = e.topic WHERE m.split = 'pool'), w AS (SELECT DISTINCT writer, region FROM pool), s AS (SELECT writer, {_rank('region', 'writer')} AS k, count(*) OVER (PARTITION BY region) AS n FROM w) SELECT key, CASE WHEN k <= ceil(n * 0.15) THEN 'dev' ELSE 'train' END AS part FROM pool JOIN s USING (writer)")
def grouped_split(spark, sf):
    p = r.man(spark, sf).where("split = 'pool'").select(F.concat_ws("|", "writer", "topic").alias("key"), "writer", "region").distinct()
    return d.train_dev(p).select("key", "part")


@query("samp_o11_shuffled", ESSAYS + " SELECT key FROM essays ORDER BY md5(key), key")
def shuffled(spark, sf):
    return essays(spark, sf).select("key").orderBy(F.md5("key"), "key")


@query("data_m01_split_manifest", _WRITERS + ", m AS (SELECT writer, region, topic, CASE WHEN k <= round_even(n * 0.2, 0) THEN 'test' ELSE 'pool' END AS split FROM essays JOIN s USING (writer)) SELECT region, count(*) AS essays, count(*) FILTER (WHERE split = 'test') AS test, count(DISTINCT writer) AS writers FROM m GROUP BY region")
def split_manifest(spark, sf):
    m = d.writer_split(essays(spark, sf))
    return m.groupBy("region").agg(F.count(F.lit(1)).alias("essays"), F.count_if(F.col("split") == "test").alias("test"), F.count_distinct("writer").alias("writers"))


@query("data_m02_l1_datasets", _MIRROR + f", ok AS (SELECT o.key, o.region FROM one o WHERE NOT EXISTS (SELECT 1 FROM man m WHERE m.split = 'test' AND concat_ws('|', m.writer, m.topic) = o.key)), lab AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS label FROM (SELECT DISTINCT region FROM ok)) SELECT key, region, label FROM ok JOIN lab USING (region)")
def l1_datasets(spark, sf):
    """Generated training rows of one cell without the test split's keys, labelled by region."""
    one, _ = mirror_targets(spark, sf)
    test = r.man(spark, sf).where("split = 'test'").select(F.concat_ws("|", "writer", "topic").alias("key"))
    return d.labelled(d.leakage_free(one, test)).select("key", "region", "label")


@query("data_m03_fullmix", _CELL + " SELECT model_id, region, count(*) AS n FROM usable WHERE condition IN ('zero_shot', 'one_shot', 'few_shot', 'cot') GROUP BY ALL")
def fullmix(spark, sf):
    u = usable(spark, sf)
    parts = [u.where(F.col("condition") == c) for c in d.CONDITIONS]
    mix = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return mix.groupBy("model_id", "region").agg(F.count(F.lit(1)).alias("n"))


@query("data_m04_masked_copies")
def masked_copies(spark, sf):
    """Every split of every data set with its region words masked."""
    from ..functions.text import masked

    return table(spark, sf, "l1_dataset").withColumn("text", masked(F.col("text"))).select("rec_id", "dataset", "split", "text")


@query("data_m05_raw_against_masked")
def raw_against_masked(spark, sf):
    """How many rows and markers the masking touches in each data set, raw and masked paired by rec_id."""
    from ..functions.text import markers_in, masked

    raw = table(spark, sf, "l1_dataset").where("rec_id is not null").select("rec_id", "dataset", F.size(markers_in(F.col("text"))).alias("raw"))
    cut = table(spark, sf, "l1_dataset").where("rec_id is not null").select("rec_id", F.size(markers_in(masked(F.col("text")))).alias("left"))
    both = raw.join(cut, "rec_id").withColumn("drop", F.col("raw") - F.col("left"))
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("drop") > 0).alias("touched"), F.sum("drop").alias("markers"), F.sum("left").alias("left"))


@query("data_m08_t8_t9_prompts", ESSAYS + ", p AS (SELECT DISTINCT region, topic FROM essays WHERE region IS NOT NULL) SELECT region, topic, 'Write an essay of 250 words as a student from ' || region || ' on: ' || topic || '.' AS prompt FROM p")
def prompts(spark, sf):
    return d.prompts(essays(spark, sf).select("region", "topic").distinct().where("region is not null"), "zero_shot")


@query("data_m08_few_shot_prompts")
def few_shot_prompts(spark, sf):
    pool = r.man(spark, sf).where("split = 'pool'")
    return d.prompts(essays(spark, sf).select("region", "topic").distinct(), "few_shot", pool)


@query("data_m09_request_bodies", ESSAYS + """ SELECT concat_ws('|', writer, topic) AS custom_id, '{"model":"m","messages":[{"role":"user","content":"Write an essay of 250 words as a student from ' || region || ' on: ' || topic || '."}],"temperature":0.7}' AS body FROM essays WHERE region IS NOT NULL""")
def request_bodies(spark, sf):
    e = essays(spark, sf).where("region is not null").withColumn("source_id", F.col("writer"))
    return d.request_bodies(d.prompts(e, "zero_shot"), "m").select("custom_id", F.to_json("body").alias("body"))


@query("data_m10_chunks", f"WITH {r.MAN}, o AS (SELECT row_number() OVER (ORDER BY rec_id) AS i FROM man WHERE rec_id IS NOT NULL) SELECT CAST((i - 1) // 100 AS BIGINT) AS chunk, count(*) AS n FROM o GROUP BY 1")
def chunks(spark, sf):
    """M10: requests in chunks of a hundred."""
    from ..operators.order import numbered

    o = numbered(r.man(spark, sf).where("rec_id is not null").select("rec_id"), "rec_id", "i")
    return d.chunked(o, "i", 100).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query("data_m11_merged_results", f"{r.GEN}, {r.MAN}, meta AS (SELECT writer, topic, min(proficiency) AS proficiency FROM man GROUP BY ALL), g AS (SELECT source_id, topic, model_id, cond, arg_max(rec_id, (written_at, rec_id)) AS rec_id FROM gen WHERE written_at IS NOT NULL GROUP BY ALL) SELECT g.source_id, g.topic, model_id, cond AS condition, rec_id, proficiency FROM g LEFT JOIN meta ON writer = source_id AND meta.topic = g.topic")
def merged_results(spark, sf):
    """Results of all runs, the last of each cell kept, with what is known of their writers."""
    g = r.gen(spark, sf).where("written_at is not null").select("source_id", "topic", "model_id", "cond", "rec_id", F.struct("written_at", "rec_id").alias("order"))
    last = d.latest(g, ["source_id", "topic", "model_id", "cond"], "order").withColumnRenamed("cond", "condition").drop("order")
    meta = r.man(spark, sf).groupBy(F.col("writer").alias("source_id"), "topic").agg(F.min("proficiency").alias("proficiency"))
    return last.join(meta, ["source_id", "topic"], "left")


# Checks
@query("check_v02_profile", "SELECT 'MTLD' AS name, count(*) FILTER (WHERE MTLD IS NOT NULL AND NOT isnan(MTLD)) AS filled, count(*) FILTER (WHERE MTLD IS NULL OR isnan(MTLD)) AS missing FROM features_all_with_neosca UNION ALL SELECT 'condition', count(condition), count(*) - count(condition) FROM features_all_with_neosca UNION ALL SELECT 'model', count(model), count(*) - count(model) FROM features_all_with_neosca UNION ALL SELECT 'key_', count(key), count(*) - count(key) FROM features_all_with_neosca UNION ALL SELECT 'key', count(*), CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM features_all_with_neosca GROUP BY key, model, condition)")
def profile(spark, sf):
    from ..operators.checks import profile as of

    f = table(spark, sf, "features_all_with_neosca").select(F.col("key").alias("key_"), "model", "condition", "MTLD")
    return of(f, ["key_", "model", "condition"])


@query("check_v03_split_is_sound", _WRITERS + ", m AS (SELECT e.*, CASE WHEN k <= round_even(n * 0.2, 0) THEN 'test' ELSE 'pool' END AS split FROM essays e JOIN s USING (writer)), c AS (SELECT count(*) FILTER (WHERE split = 'test') AS k FROM m GROUP BY region, topic), dv AS (SELECT writer FROM m GROUP BY writer HAVING count(DISTINCT split) > 1) SELECT (SELECT count(*) FROM m) AS essays, (SELECT count(*) FROM dv) AS divided, (SELECT min(k) FROM c) AS smallest_cell")
def split_is_sound(spark, sf):
    m = d.writer_split(essays(spark, sf))
    one = m.agg(F.count(F.lit(1)).alias("essays"))
    divided = m.groupBy("writer").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("divided"))
    cell = m.groupBy("region", "topic").agg(F.count_if(F.col("split") == "test").alias("k")).agg(F.min("k").alias("smallest_cell"))
    return one.join(divided).join(cell)  # three single rows side by side


@query("check_v04_baseline", f"WITH {r.MAN}, a AS (SELECT region, count(DISTINCT (writer, topic)) AS manifest FROM man WHERE split = 'pool' GROUP BY 1), b AS (SELECT split_part(file_name, '_', 2) AS region, count(DISTINCT (split_part(file_name, '_', 4), topic)) AS pool FROM exemplar_pool GROUP BY 1) SELECT region, manifest, pool, manifest = pool AS equal FROM a JOIN b USING (region)")
def baseline(spark, sf):
    """Essays by region in the manifest's pool and in the exemplar pool."""
    a = r.man(spark, sf).where("split = 'pool'").groupBy("region").agg(F.count_distinct(F.struct("writer", "topic")).alias("manifest"))
    p = F.split("file_name", "_")
    b = table(spark, sf, "exemplar_pool").groupBy(p[1].alias("region")).agg(F.count_distinct(F.struct(p[3], "topic")).alias("pool"))
    return a.join(b, "region").withColumn("equal", F.col("manifest") == F.col("pool"))
