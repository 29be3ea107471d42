"""Problem 9: texts in containers of a fixed number of tokens, by bound-certified repacking.

A text is a piece of its size in tokens, or, if it alone is larger than a container, pieces of the capacity and a rest.
Pieces are spread by hash over groups of about GROUP containers' worth; each group is packed by best-fit decreasing in
one task, beside a lower bound on its containers from dual-feasible functions. A group whose count equals its bound is
certified and stays. Of the groups with a gap, the containers that are less than FULL full are opened, and their pieces
exchanged: FAN such groups at a time pack what they opened together. That goes on until no gap is left, nothing is won,
or one group remains.

Null and empty texts have no tokens; their pieces take no room and lie in some container of their group, so that no
document is lost. Every text is whole in one container unless it exceeds the capacity. An empty table gives no rows;
rows with a null doc_id are kept as documents without a name; profiles with a null field or no capacity are left out, and of
several rows of a profile the one of least capacity holds.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import kept, table
from .tokens import token_counts, vocabulary

GROUP, FAN, FULL = 400, 8, 0.995
STATE = "profile string, capacity long, piece long, tokens long, container long, grp long, bound long"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, from 0, of each size: the largest first, each where it leaves least room."""
    where = np.zeros(len(sizes), np.int64)
    rooms: list[tuple[int, int]] = []
    count = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, at = rooms.pop(k)
        else:
            room, at = capacity, count
            count += 1
        where[i] = at
        insort(rooms, (room - n, at))
    return where


def least_containers(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound on the containers that the sizes need, the best of several dual-feasible functions.

    Functions, each never giving a filling more than one container's worth: the size itself; for a threshold t, sizes above
    capacity - t as whole, those below t as nothing; for k, floor((k + 1) * size / capacity) / k, exact multiples as themselves.
    """
    x = sizes[sizes > 0].astype(np.int64)
    if not len(x):
        return int(len(sizes) > 0)
    best = -(-int(x.sum()) // capacity)
    for t in np.unique(np.quantile(x[x <= capacity // 2], np.linspace(0, 1, 33)).astype(np.int64)) if (x <= capacity // 2).any() else [1]:
        big, mid = int((x > capacity - t).sum()), x[(x >= t) & (x <= capacity - t)]
        best = max(best, big + -(-int(mid.sum()) // capacity))
    best = max(best, int((x > capacity // 2).sum()))
    for k in range(1, 21):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        best = max(best, -(-int(np.where(whole, x * k, (scaled // capacity) * capacity).sum()) // (k * capacity)))
    return best


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    capacity, sizes = int(group.capacity.iloc[0]), group.tokens.to_numpy()
    order = np.argsort(group.piece.to_numpy(), kind="stable")  # the same packing, however the rows come
    where = np.empty(len(sizes), np.int64)
    where[order] = best_fit(sizes[order], capacity)
    return group.assign(container=where, bound=least_containers(sizes, capacity))


def packed(pieces: DataFrame) -> DataFrame:
    """pieces (profile, capacity, piece, tokens) with the container (grp, container) of each, and the bound of its group."""
    total = pieces.groupBy("profile").agg(F.ceil(F.sum("tokens") / (F.first("capacity") * GROUP)).alias("parts"))  # a row for each profile
    rows = pieces.join(F.broadcast(total), "profile").withColumn("grp", F.pmod(F.xxhash64("piece"), F.greatest(F.col("parts"), F.lit(1))))
    shape = rows.select("profile", "capacity", "piece", "tokens", F.lit(0).cast("long").alias("container"), F.col("grp").cast("long"), F.lit(0).cast("long").alias("bound"))
    now, done, turn, before = kept(shape.groupBy("profile", "grp").applyInPandas(_packed, STATE)), None, 0, None
    out = lambda df, turn: df.select("profile", "capacity", "piece", "tokens", F.concat_ws("-", F.lit(turn), "grp", "container").alias("container"), F.concat_ws("-", F.lit(turn), "grp").alias("grp"), "bound")
    while True:
        fill = now.groupBy("profile", "grp", "container").agg(F.sum("tokens").alias("full"), F.first("capacity").alias("most"))
        groups = now.groupBy("profile", "grp").agg((F.max("container") + 1).alias("n"), F.first("bound").alias("bound"))
        gaps = groups.where("n > bound").select("profile", "grp", (F.col("n") - F.col("bound")).alias("gap"))
        state = gaps.groupBy("profile").agg(F.count(F.lit(1)).alias("groups"), F.sum("gap").alias("gap")).collect()  # a row for each profile
        left = {r.profile: (r.groups, r.gap) for r in state}
        active = [p for p, (g, gap) in left.items() if g > 1 and (before is None or gap < before.get(p, (0, 1 << 60))[1])]
        if not active:
            break
        opened = fill.join(gaps, ["profile", "grp"]).where(F.col("profile").isin(active) & (F.col("full") < FULL * F.col("most"))).select("profile", "grp", "container", F.lit(True).alias("open"))
        marked = kept(now.join(opened, ["profile", "grp", "container"], "left"))
        closed = out(marked.where("open is null"), turn)
        done = closed if done is None else done.unionByName(closed)
        parts = {p: -(-left[p][0] // FAN) for p in active}
        width = F.create_map(*(F.lit(x) for kv in parts.items() for x in kv))
        # the groups of one new group follow from the old group's hash, so that pieces opened together stay together
        again = marked.where("open").select("profile", "capacity", "piece", "tokens", "container", F.pmod(F.xxhash64("grp", F.lit(turn)), width[F.col("profile")]).cast("long").alias("grp"), "bound")
        now, before, turn = kept(again.groupBy("profile", "grp").applyInPandas(_packed, STATE)), left, turn + 1
    last = out(now, turn)
    return last if done is None else done.unionByName(last)


def document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile, capacity, piece, tokens, doc_id, start) of each document under each profile; piece is a number of its own."""
    profiles = table(spark, sf_dir, "pack_profiles").where("profile is not null and tokenizer is not null and capacity_tokens > 0")
    wanted = profiles.groupBy("profile").agg(F.min(F.struct(F.col("capacity_tokens").cast("long").alias("capacity"), "tokenizer")).alias("x")).select("profile", "x.tokenizer", "x.capacity")
    counts = None
    for r in wanted.select("tokenizer").distinct().orderBy("tokenizer").collect():
        one = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary(r.tokenizer)).withColumn("tokenizer", F.lit(r.tokenizer))
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        return spark.createDataFrame([], "profile string, capacity long, piece long, tokens long, doc_id long, start long")
    starts = F.explode(F.expr("sequence(0L, greatest(n - 1, 0L), capacity)")).alias("start")
    pieces = counts.join(F.broadcast(wanted), "tokenizer").select("profile", "capacity", "doc_id", "n", starts)
    return kept(pieces.select("profile", "capacity", F.monotonically_increasing_id().alias("piece"), F.least(F.col("n") - F.col("start"), "capacity").alias("tokens"), "doc_id", "start"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_packed: (profile, container, doc_id, start, tokens): the container of each document, or of each piece of one that is larger than a container."""
    pieces = document_pieces(spark, sf_dir)
    where = packed(pieces.select("profile", "capacity", "piece", "tokens")).select("piece", "container")
    return pieces.join(where, "piece").select("profile", "container", "doc_id", "start", "tokens")


def packing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_report: (profile, containers, bound, fill): containers used, the least number that the total of tokens needs, and the share of room used."""
    pieces = document_pieces(spark, sf_dir)
    bins = packed(pieces.select("profile", "capacity", "piece", "tokens")).groupBy("profile", "capacity", "container").agg(F.sum("tokens").alias("full"))
    return bins.groupBy("profile", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("full").alias("tokens")).select("profile", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("bound"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
