"""Problem 1: persons divided between splits, and splits that keep each person together.

Writers tied by writer_links are one person. The components come from random-mate contraction: in each round every
vertex tosses a coin by a hash of its name and the round; a tail is collapsed into its least neighbour that shows heads.
About a quarter of the vertices goes in each round, whatever the shape of the graph, until no edge is left. The rounds'
tables are then unwound backwards, from the last survivors to the members they took in.

Links with an unreadable end, links of a writer to itself and repeated links change nothing; rows whose writer can't be
read are in no person; rows with a null split don't count; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import kept, scoped_rows, table, writer

#: Persons with more than this share of a scope's rows are placed one by one (there are fewer than 1 / HEAVY of them); the others by cumulative weight.
HEAVY, BUCKETS = 0.002, 4096


def components(links: DataFrame) -> DataFrame:
    """(member, name) of each connected component of links (a, b); name is its least member as a string."""
    links = links.where("a is not null and b is not null and a != b").select("a", "b")
    edges = kept(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    vertices, rounds = edges.select(F.col("a").alias("member")).distinct(), []
    while not edges.isEmpty():
        head = lambda c, k=len(rounds): F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 0
        mates = kept(edges.where(~head("a") & head("b")).groupBy("a").agg(F.min("b").alias("mate")))
        a, b = mates.select("a", F.col("mate").alias("ma")), mates.select(F.col("a").alias("b"), F.col("mate").alias("mb"))
        edges = kept(edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b")).where("a != b").distinct())
        rounds.append(mates)
    taken = None
    for mates in rounds:
        taken = mates.select(F.col("a").alias("member")) if taken is None else taken.union(mates.select(F.col("a").alias("member")))
    labels = vertices.withColumn("root", F.col("member"))
    if taken is not None:
        labels = kept(vertices.join(taken, "member", "left_anti").withColumn("root", F.col("member")))
        for mates in reversed(rounds):  # a mate of this round survived it, so its root is known by now
            own = mates.join(labels, mates.mate == labels.member).select(F.col("a").alias("member"), "root")
            labels = kept(labels.unionByName(own))
    return labels.join(labels.groupBy("root").agg(F.min("member").alias("name")), "root").select("member", "name")


def person_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, person, split, rows): how many rows each person has in each split of a scope."""
    links = table(spark, sf_dir, "writer_links").select(writer(F.col("writer_a")).alias("a"), writer(F.col("writer_b")).alias("b"))
    persons = components(links)
    rows = scoped_rows(spark, sf_dir).where("writer is not null").groupBy("scope", "writer", "split").agg(F.count(F.lit(1)).alias("rows"))
    named = rows.join(persons, rows.writer == persons.member, "left").select("scope", F.coalesce("name", "writer").alias("person"), "split", "rows")
    return named.groupBy("scope", "person", "split").agg(F.sum("rows").alias("rows"))


def divided_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: (scope, writer) of persons with rows in more than one split of a scope."""
    rows = person_rows(spark, sf_dir).groupBy("scope", "person").agg(F.count(F.lit(1)).alias("n"))
    return rows.where("n > 1").select("scope", F.col("person").alias("writer"))


def person_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_splits: (scope, person, rows, split): a split of each person, near the shares of split_targets.

    Components of more than HEAVY of a scope go, largest first, where most is missing. The others are laid in hash order along the
    scope's rows; sums by bucket of the hash come first, so that no task orders a whole scope, and the bucket's offset is then added.
    """
    from pyspark.sql.window import Window

    weights = kept(person_rows(spark, sf_dir).groupBy("scope", "person").agg(F.sum("rows").alias("rows")).where("scope is not null"))
    totals = {r.scope: r.rows for r in weights.groupBy("scope").agg(F.sum("rows").alias("rows")).collect()}
    targets: dict[str, list[tuple[str, float]]] = {}
    for r in table(spark, sf_dir, "split_targets").where("share > 0 and split is not null and source_table is not null").distinct().collect():
        targets.setdefault(r.source_table, []).append((r.split, float(r.share)))
    total = spark.createDataFrame(list(totals.items()), "scope string, all long")
    marked = weights.join(F.broadcast(total), "scope").withColumn("heavy", F.col("rows") > HEAVY * F.col("all"))
    placed, rest = [], {}
    heavy = marked.where("heavy").orderBy(F.desc("rows"), "person").collect()
    for scope, n in totals.items():
        own = sorted(targets.get("split_manifest" if scope == "split_manifest" else "l1_dataset", []))
        missing = {s: share * n / sum(x for _, x in own) for s, share in own}
        for r in (x for x in heavy if x.scope == scope and missing):
            s = max(missing, key=missing.get)
            missing[s] -= r.rows
            placed.append((scope, r.person, r.rows, s))
        light, low = sum(max(0.0, x) for x in missing.values()), 0.0
        for s, x in missing.items():
            rest.setdefault(scope, []).append((scope, s, low, low + (max(0.0, x) / light if light else 1 / len(missing))))
            low = rest[scope][-1][3]
        if scope in rest:
            rest[scope][-1] = (*rest[scope][-1][:3], 2.0)
    bucket = F.pmod(F.xxhash64("person"), F.lit(BUCKETS))
    rows = marked.where("not heavy").withColumn("bucket", bucket)
    sums = rows.groupBy("scope", "bucket").agg(F.sum("rows").alias("in_bucket"))  # at most BUCKETS rows of each scope
    sums = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("scope").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).withColumn("light", F.sum("in_bucket").over(Window.partitionBy("scope")))
    inner = F.sum("rows").over(Window.partitionBy("scope", "bucket").orderBy("person"))
    at = rows.withColumn("inner", inner).join(F.broadcast(sums), ["scope", "bucket"]).withColumn("at", (F.coalesce("before", F.lit(0)) + F.col("inner") - F.col("rows") / 2) / F.col("light"))
    cuts = F.broadcast(spark.createDataFrame([x for v in rest.values() for x in v], "scope string, split string, low double, high double"))
    light = at.join(cuts, "scope").where("at >= low and at < high").select("scope", "person", "rows", "split")
    return light.unionByName(spark.createDataFrame(placed, "scope string, person string, rows long, split string"))


def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_shares: (scope, split, share, target): the shares of rows that p1_splits reaches, beside the wanted ones."""
    from pyspark.sql.window import Window

    got = person_splits(spark, sf_dir).groupBy("scope", "split").agg(F.sum("rows").alias("rows")).withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("scope")))
    t = table(spark, sf_dir, "split_targets").select("source_table", "split", F.col("share").alias("target"))
    source = F.when(F.col("scope") == "split_manifest", "split_manifest").otherwise("l1_dataset")
    return got.withColumn("source_table", source).join(F.broadcast(t), ["source_table", "split"], "left").select("scope", "split", F.round("share", 6).alias("share"), "target")


P1_SQL = r"""
WITH RECURSIVE spelt AS (
  SELECT regexp_extract(upper(writer_a), '([A-Z]{3})[^A-Z0-9]*([0-9]+)', ['r','n']) AS x, regexp_extract(upper(writer_b), '([A-Z]{3})[^A-Z0-9]*([0-9]+)', ['r','n']) AS y FROM writer_links),
links AS (
  SELECT x.r || '_' || lpad(CAST(CAST(x.n AS BIGINT) AS VARCHAR), CAST(greatest(3, length(CAST(CAST(x.n AS BIGINT) AS VARCHAR))) AS INTEGER), '0') AS a,
         y.r || '_' || lpad(CAST(CAST(y.n AS BIGINT) AS VARCHAR), CAST(greatest(3, length(CAST(CAST(y.n AS BIGINT) AS VARCHAR))) AS INTEGER), '0') AS b FROM spelt WHERE x.n <> '' AND y.n <> ''),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS member, a AS other FROM edges UNION SELECT r.member, e.b FROM reach r JOIN edges e ON r.other = e.a),
persons AS (SELECT member, min(other) AS name FROM reach GROUP BY member),
rows_ AS (
  SELECT 'split_manifest' AS scope, split_part(file_name, '_', 2) || '_' || split_part(file_name, '_', 4) AS writer, lower(trim(split)) AS split FROM split_manifest
  UNION ALL SELECT dataset, split_part(key, '|', 1), replace(lower(trim(split)), 'validation', 'dev') FROM l1_dataset)
SELECT scope, coalesce(name, writer) AS writer FROM rows_ LEFT JOIN persons ON member = writer WHERE split IS NOT NULL AND split <> ''
GROUP BY 1, 2 HAVING count(DISTINCT split) > 1
"""
