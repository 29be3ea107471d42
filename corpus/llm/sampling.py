"""Problem 4: samples that match target shares, by min-cost flow on the counts of cross-classified cells.

A target set is a network. Each cell (region and condition) must pass on its need: the larger of its floor min_rows and
its rounded share of the sample. The arc to its own items ends at their number; what does not fit passes the cell's
slack arc, at a cost above all others, and from there to items of the same region or condition, of any cell, or to
none. As the slack is dearer than all else, the cheapest flow puts on each slack arc just what the cell is short of, so
that a target can't be met where its slack arc carries flow. A second flow of sample_rows units, floors first, gives
the integer quotas; ties between cells fall by a seeded draw, and each quota is drawn among the cell's items by hash.

Targets with null region, condition, share or sample_rows are left out (a null min_rows counts as 0); texts that are
null or blank are no items; with no items at all every target that needs a row is unmet. The network has a few arcs for
each row of sample_targets, a table of fixed size; only the counts of its cells come to the driver.
"""

from __future__ import annotations

import heapq
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import condition_name, file_writer, has_text, region_of, split_name, table, writer

SEED, SALTS = 7, 64
SLACK, NONE, ANY, SAME = 10**6, 10**4, 100, 10


class Flow:
    """Min-cost flow by shortest augmenting paths with potentials."""

    def __init__(self):
        self.to, self.room, self.cost, self.out = [], [], [], {}

    def arc(self, a, b, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def on(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def send(self, source, sink, amount: int) -> int:
        """Sends up to the amount at least cost; how much went."""
        height, sent = dict.fromkeys(self.out, 0), 0
        names = {v: i for i, v in enumerate(self.out)}
        while sent < amount:
            far, by, heap = {source: 0}, {}, [(0, names[source], source)]
            while heap:
                d, _, v = heapq.heappop(heap)
                if d > far[v]:
                    continue
                for k in self.out[v]:
                    w = self.to[k]
                    if self.room[k] and (n := d + self.cost[k] + height[v] - height[w]) < far.get(w, 1 << 60):
                        far[w], by[w] = n, k
                        heapq.heappush(heap, (n, names[w], w))
            if sink not in far:
                break
            for v in self.out:
                height[v] += min(far.get(v, far[sink]), far[sink])
            path, v = [], sink
            while v != source:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            step = min(amount - sent, *(self.room[k] for k in path))
            for k in path:
                self.room[k] -= step
                self.room[k ^ 1] += step
            sent += step
        return sent


def solve(cells: list[tuple[str, str, int, int]], have: dict[tuple[str, str], int]) -> tuple[dict[tuple[str, str], int], dict[tuple[str, str], int]]:
    """(taken, short) of each cell of a target set; cells: (region, condition, need, floor), have: items of each cell.

    taken says how many items come from a cell, its own need and what it gives to others; short is the flow of its slack arc.
    """
    f, slack, pool = Flow(), {}, {}
    for region, condition, need, _ in cells:
        own = (region, condition)
        f.arc("source", ("need", own), need)
        f.arc(("need", own), ("items", own), need)
        slack[own] = f.arc(("need", own), ("short", own), need, SLACK)
        pool[own] = f.arc(("items", own), "sink", have.get(own, 0))
        for margin, cost in ((("region", region), SAME), (("condition", condition), SAME), ("any", ANY)):
            f.arc(("short", own), margin, need, cost)
            f.arc(margin, ("items", own), have.get(own, 0))
        f.arc(("short", own), "sink", need, NONE)
    if cells:
        f.send("source", "sink", sum(n for _, _, n, _ in cells))
    return {k: f.on(a) for k, a in pool.items()}, {k: f.on(a) for k, a in slack.items()}


def quotas(cells: list[tuple[str, str, int, int]], have: dict[tuple[str, str], int], rows: int, rng: random.Random) -> dict[tuple[str, str], int]:
    """How many items to draw from each cell for a sample of `rows`: floors first, then targets, then what others can give; equals by lot."""
    taken, _ = solve(cells, have)
    f, arcs = Flow(), {}
    for region, condition, need, floor in rng.sample(cells, len(cells)):
        own = (region, condition)
        full = min(taken[own] if taken[own] > need else need, have.get(own, 0))
        least = min(floor, full)
        arcs[own] = [f.arc("source", own, least, 0), f.arc("source", own, full - least, 1000 + rng.randrange(100)), f.arc("source", own, have.get(own, 0) - full, 100_000 + rng.randrange(100))]
        f.arc(own, "sink", have.get(own, 0))
    if cells:
        f.send("source", "sink", rows)
    return {k: sum(map(f.on, a)) for k, a in arcs.items()}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, region, condition, item, rec_id): the distinct usable items, each with the least of its rec_ids."""
    g = table(spark, sf_dir, "generated_corpus").where(has_text(F.col("generated_text")))
    g = g.select(writer(F.col("source_id")).alias("writer"), "topic", "model_id", condition_name(F.col("condition")).alias("condition"), "rec_id").where("writer is not null and condition is not null")
    g = g.groupBy("writer", "topic", "model_id", "condition").agg(F.min("rec_id").alias("rec_id"))
    g = g.select(F.lit("generated_corpus").alias("source_table"), region_of(F.col("writer")).alias("region"), "condition", F.xxhash64("writer", "topic", "model_id", "condition").alias("item"), "rec_id")
    m = table(spark, sf_dir, "split_manifest").where((split_name(F.col("split")) == "pool") & has_text(F.col("text")))
    m = m.select(F.coalesce(file_writer(F.col("file_name")), writer(F.col("id"))).alias("writer"), "topic", "rec_id").where("writer is not null").groupBy("writer", "topic").agg(F.min("rec_id").alias("rec_id"))
    return g.unionByName(m.select(F.lit("split_manifest").alias("source_table"), region_of(F.col("writer")).alias("region"), F.lit("all").alias("condition"), F.xxhash64("writer", "topic").alias("item"), "rec_id"))


def target_cells(spark: SparkSession, sf_dir: str) -> dict[str, tuple[str, int, list[tuple[str, str, int, int]]]]:
    """(source_table, sample_rows, cells) of each target set; the share is rounded on decimals, halves up."""
    out: dict = {}
    rows = table(spark, sf_dir, "sample_targets").where("region is not null and condition is not null and target_share is not null and sample_rows is not null").orderBy("target_set", "region", "condition").collect()
    for r in rows:
        part = int((Decimal(repr(r.target_share)) * r.sample_rows).quantize(Decimal(1), ROUND_HALF_UP))
        _, _, cells = out.setdefault(r.target_set, (r.source_table, r.sample_rows, []))
        if (r.region, r.condition) not in {c[:2] for c in cells}:
            cells.append((r.region, r.condition, max(r.min_rows or 0, part), r.min_rows or 0))
    return out


def counted(spark: SparkSession, sf_dir: str) -> dict[str, dict[tuple[str, str], int]]:
    """Items of each cell by table, a cell `all` holding those of all conditions."""
    rows = items(spark, sf_dir).groupBy("source_table", "region", "condition").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict = {}
    for r in rows:
        own = out.setdefault(r.source_table, {})
        for c in {r.condition, "all"}:
            own[r.region, c] = own.get((r.region, c), 0) + r.n
    return out


def unmet_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: rows of sample_targets whose slack arc carries flow."""
    have, found = counted(spark, sf_dir), []
    for name, (source, _, cells) in target_cells(spark, sf_dir).items():
        _, short = solve(cells, have.get(source, {}))
        found += [(name, *cell) for cell, n in short.items() if n]
    return spark.createDataFrame(found, "target_set string, region string, condition string")


def target_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_report: (target_set, region, condition, needed, available, short, drawn) of each target."""
    have, rows = counted(spark, sf_dir), []
    for name, (source, size, cells) in target_cells(spark, sf_dir).items():
        own = have.get(source, {})
        _, short = solve(cells, own)
        quota = quotas(cells, own, size, random.Random(f"{SEED} {name}"))
        rows += [(name, r, c, need, own.get((r, c), 0), short[r, c], quota[r, c]) for r, c, need, _ in cells]
    return spark.createDataFrame(rows, "target_set string, region string, condition string, needed long, available long, short long, drawn long")


def drawn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_sample: (target_set, region, condition, rec_id): the rows drawn for each target set.

    Within a cell the items of least hash are drawn: first the least of each salt, then the least of what is left, so that no task ranks a whole cell.
    """
    want = target_report(spark, sf_dir).where("drawn > 0").select("target_set", "region", F.col("condition").alias("wanted"), "drawn")
    source = table(spark, sf_dir, "sample_targets").select("target_set", "source_table").distinct()
    asked = F.broadcast(want.join(source, "target_set"))
    pool = items(spark, sf_dir).withColumn("wanted", F.explode(F.when(F.col("condition") == "all", F.array("condition")).otherwise(F.array("condition", F.lit("all")))))
    rows = pool.join(asked, ["source_table", "region", "wanted"]).withColumn("lot", F.xxhash64("item", "target_set", F.lit(SEED)))
    cell = ["target_set", "region", "wanted"]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("lot", "item"))
    few = rows.withColumn("salt", F.pmod("lot", F.lit(SALTS))).withColumn("k", rank(*cell, "salt")).where("k <= drawn")
    return few.withColumn("k", rank(*cell)).where("k <= drawn").select("target_set", "region", F.col("wanted").alias("condition"), "rec_id")


P4_SQL = r"""
WITH cells AS (
  SELECT DISTINCT 'generated_corpus' AS source_table, source_id, topic, model_id, replace(replace(lower(trim(condition)), '-', '_'), ' ', '_') AS c FROM generated_corpus
  WHERE generated_text IS NOT NULL AND regexp_matches(generated_text, '[^\s\x{00A0}\x{2000}-\x{200F}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]')),
have AS (
  SELECT source_table, substr(source_id, 1, 3) AS region, CASE c WHEN 'c0' THEN 'zero_shot' WHEN 'c1' THEN 'one_shot' WHEN 'c2' THEN 'few_shot' WHEN 'c3' THEN 'cot' ELSE c END AS condition,
         count(DISTINCT (source_id, topic, model_id)) AS n FROM cells GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'split_manifest', split_part(file_name, '_', 2), 'all', count(DISTINCT (split_part(file_name, '_', 4), topic)) FROM split_manifest
  WHERE lower(trim(split)) = 'pool' AND text IS NOT NULL AND regexp_matches(text, '[^\s\x{00A0}\x{2000}-\x{200F}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]') GROUP BY 1, 2)
SELECT target_set, t.region, t.condition FROM sample_targets t LEFT JOIN have h ON h.source_table = t.source_table AND h.region = t.region AND h.condition = t.condition
WHERE coalesce(n, 0) < greatest(min_rows, CAST(floor(CAST(target_share AS DECIMAL(18, 9)) * sample_rows + CAST(0.5 AS DECIMAL(2, 1))) AS BIGINT))
"""
