"""Problem 6: long exact stretches shared between records, by compaction of a sparse de Bruijn graph.

Tokens are the characters of a text whose runs of white space are taken as one space; a k-mer is K of them in a
row. Of the k-mers of a text those are kept that have the least hash in some window of SPAN - K + 1 neighbours, so
that any two texts with SPAN characters in common keep a k-mer in common, wherever the stretch lies. A kept k-mer is
an edge of the graph and is joined to the next kept one. Edges that occur once are dropped; a path of edges of which
each is always followed by the next, at the same distance, is compacted into one by pointer doubling, so that a
passage is one path with its members however long it is and however many texts hold it. The coordinates of a path's
members settle the stretches that it covers; shorter ones are extended on the texts.

Null texts and texts shorter than SPAN have no stretch; equal texts share all they have; records without rec_id are
not named in any pair.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import condition_name, kept, table

SPAN, K = 300, 200
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse, longer when needed


def one_spaced(text: str) -> str:
    """The text with each run of white space as one space."""
    if not text:
        return ""
    out = " ".join(text.split())
    return " " * text[0].isspace() + out + " " * (text[-1].isspace() and bool(out))


def kmer_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of each stretch of k characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(_powers[0]) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            _powers[:] = (np.cumprod(np.full(2 * n, x, np.uint64)) for x in (_BASE, inverse))
        c += np.uint64(1)
        c *= _powers[0][:n]
        sums = np.cumsum(c)
        h = sums[k - 1 :].copy()
        h[1:] -= sums[: n - k]
        h *= _powers[1][: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def kept_kmers(text: str, k: int = K, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the k-mers with the least hash in a window of span - k + 1, in order."""
    h, width = kmer_hashes(text, k), span - k + 1
    if len(h) < width:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    places = np.uint64((1 << max(22, len(h).bit_length())) - 1)
    low = (h & ~places) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = (low & places).astype(np.int64)
    at = at[np.concatenate([np.ones(1, bool), at[1:] != at[:-1]])]
    return h[at].view(np.int64), at.astype(np.int32)


def surroundings(text: str, starts: list[int], k: int = K, span: int = SPAN) -> dict[tuple[str, str], list[int]]:
    """Places of a k-mer in a text by what stands before and after it, as far as that can matter for a stretch of span characters.

    A phrase said over and over has one place for all its repetitions but the first and the last few.
    """
    room, out = span - k, {}
    for s in starts:
        out.setdefault((text[max(0, s - room) : s], text[s + k : s + k + room]), []).append(s)
    return out


def common_ends(a: tuple[str, str], b: tuple[str, str]) -> tuple[int, int]:
    """How many characters are the same before and after a k-mer in two surroundings."""
    x, y = a[0][::-1], b[0][::-1]
    return len(os.path.commonprefix([x, y])), len(os.path.commonprefix([a[1], b[1]]))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, cell, text): generated texts with the hash of their cell, and those of the pool without one."""
    cell = F.xxhash64("source_id", "topic", "model_id", F.coalesce(condition_name(F.col("condition")), "condition"))
    g = table(spark, sf_dir, "generated_corpus").select("rec_id", cell.alias("cell"), F.col("generated_text").alias("text"))
    p = table(spark, sf_dir, "exemplar_pool").select("rec_id", F.lit(None).cast("long").alias("cell"), "text")
    return g.unionByName(p).where(F.length("text") >= SPAN).where("rec_id is not null")


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join by sorting: the files of kept tables are so small that Spark would gather tables many times their size on the driver."""
    return df.hint("merge")


def sampled(texts: DataFrame) -> DataFrame:
    """(rec_id, cell, kmers, starts) of each text that keeps a k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kept_kmers(one_spaced(x)) for x in b.column(2).to_pylist()]
            ends = pa.array(np.cumsum([0] + [len(x) for x, _ in found]), pa.int32())
            flat = [np.concatenate([x[s] for x in found] + [np.empty(0, kind)]) for s, kind in ((0, np.int64), (1, np.int32))]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["rec_id", "cell", "kmers", "starts"])

    return texts.select(F.col("rec_id").cast("long"), "cell", "text").mapInArrow(run, "rec_id long, cell long, kmers array<long>, starts array<int>").where(F.size("kmers") > 0)


def repeated_edges(recs: DataFrame) -> DataFrame:
    """(rec_id, cell, kmer, start, next, gap): occurrences of k-mers that occur more than once; next is the k-mer kept after it."""
    often = recs.select(F.explode("kmers").alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kmer")
    after = lambda c: F.expr(f"slice({c}, 2, size({c}))")
    zipped = F.arrays_zip(F.col("kmers").alias("kmer"), F.col("starts").alias("start"), after("kmers").alias("next"), after("starts").alias("then"))
    rows = recs.select("rec_id", "cell", F.inline(zipped).alias("kmer", "start", "next", "then"))
    return rows.join(spread(often), "kmer", "left_semi").select("rec_id", "cell", "kmer", "start", "next", (F.col("then") - F.col("start")).alias("gap"))


def compacted(edges: DataFrame) -> DataFrame:
    """(kmer, path, shift, covers) of each repeated k-mer: the k-mer that heads its path, its distance from it, and the characters its path covers.

    b follows a without a branch if each occurrence of a is followed by b at one distance and b occurs as often as a. The heads of such paths
    are found by pointer doubling; k-mers that follow each other in a ring stay paths of their own.
    """
    nodes = edges.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.count("next").alias("m"), F.min("next").alias("next"), F.max("next").alias("other"), F.min("gap").alias("gap"), F.max("gap").alias("most"))
    nodes = kept(nodes)
    into = nodes.where("m = n and next = other and gap = most and next != kmer").select(F.col("kmer").alias("path"), F.col("next").alias("kmer"), F.col("n").alias("before"), F.col("gap").alias("shift"))
    links = kept(nodes.select("kmer", "n").join(spread(into), "kmer").where("n = before").select("kmer", "path", F.col("shift").cast("long").alias("shift")))
    left = -1
    while True:
        up = links.select(F.col("kmer").alias("path"), F.col("path").alias("higher"), F.col("shift").alias("more"))
        links = kept(links.join(spread(up), "path", "left").select("kmer", F.coalesce("higher", "path").alias("path"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"), F.col("higher").isNotNull().alias("open")))
        now = links.where("open").count()
        if now in (0, left):  # no fewer than before: what is left are rings
            break
        left = now
    done = links.where("not open").drop("open")
    paths = nodes.select("kmer").join(spread(done), "kmer", "left").select("kmer", F.coalesce("path", "kmer").alias("path"), F.coalesce("shift", F.lit(0)).alias("shift"))
    paths = kept(paths)
    return paths.join(spread(paths.groupBy("path").agg((F.max("shift") + K).alias("covers"))), "path")


def shared_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_a, rec_b, starts_a, starts_b, covers): pairs of records, one at least generated and not both of one cell, with the places of a path that both hold."""
    edges = kept(repeated_edges(kept(sampled(records(spark, sf_dir)))))
    heads = compacted(edges).where("kmer = path").select("kmer", "covers")
    members = edges.join(spread(heads), "kmer").groupBy("kmer", "covers", "rec_id", "cell").agg(F.collect_set("start").alias("starts"))  # places in one text
    members = kept(members)
    a, b = (members.select("kmer", *(["covers"] if x == "a" else []), *(F.col(c).alias(f"{c}_{x}") for c in ("rec_id", "cell", "starts"))) for x in "ab")
    pairs = a.join(spread(b), "kmer").where("rec_id_a < rec_id_b and (cell_a is not null or cell_b is not null) and not (cell_a <=> cell_b)")
    return pairs.select(F.col("rec_id_a").alias("rec_a"), F.col("rec_id_b").alias("rec_b"), "starts_a", "starts_b", "covers")


def with_texts(spark: SparkSession, sf_dir: str, seeds: DataFrame) -> DataFrame:
    """(rec_a, rec_b, starts_a, starts_b, text_a, text_b) of the seeds; only the texts asked for are moved."""
    asked = seeds.select(F.explode(F.array("rec_a", "rec_b")).alias("rec_id")).distinct()
    texts = kept(records(spark, sf_dir).join(spread(asked), "rec_id", "left_semi").groupBy("rec_id").agg(F.min("text").alias("text")))
    ta, tb = (texts.select(F.col("rec_id").alias(f"rec_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    return seeds.join(spread(ta), "rec_a").join(spread(tb), "rec_b").select("rec_a", "rec_b", "starts_a", "starts_b", "text_a", "text_b")


def reaching(met: DataFrame) -> DataFrame:
    """(rec_a, rec_b) of those of with_texts whose k-mer stands in SPAN equal characters."""

    def same(x: str, y: str, i: list[int], j: list[int]) -> bool:
        ca, cb = surroundings(one_spaced(x), i), surroundings(one_spaced(y), j)
        return any(sum(common_ends(p, q)) >= SPAN - K for p in ca for q in cb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = pa.array([same(x, y, i, j) for i, j, x, y in zip(*(c.to_pylist() for c in b.columns[2:]))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit)], ["rec_a", "rec_b"])

    return met.mapInArrow(run, "rec_a long, rec_b long")


def shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: pairs of records, one at least generated and not both of one cell, that share a stretch of SPAN characters."""
    seeds = kept(shared_seeds(spark, sf_dir))
    settled = seeds.where(F.col("covers") >= SPAN).select("rec_a", "rec_b").distinct()
    asked = kept(seeds.where(F.col("covers") < SPAN).join(spread(settled), ["rec_a", "rec_b"], "left_anti").select("rec_a", "rec_b", "starts_a", "starts_b"))
    return settled.unionByName(reaching(with_texts(spark, sf_dir, asked))).distinct()


def shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_shared: (rec_id, chars, shared_chars, share): how much of each record lies in a stretch that another record holds, of those records that share one.

    Each k-mer of a stretch brings what is equal around it, up to SPAN - K characters on either side; as a k-mer is kept in
    every SPAN characters, these pieces cover the stretch. The pieces of a record are laid side by side in order of their
    start; what one adds is what lies beyond the furthest end before it.
    """
    from pyspark.sql.window import Window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for ra, rb, i, j, x, y in zip(*(c.to_pylist() for c in b.columns)):
                ca, cb = surroundings(one_spaced(x), i), surroundings(one_spaced(y), j)
                for p, ps in ca.items():
                    for q, qs in cb.items():
                        left, right = common_ends(p, q)
                        if left + right >= SPAN - K:
                            out.update((r, s - left, s + K + right) for r, places in ((ra, ps), (rb, qs)) for s in places)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int32(), pa.int32()))], ["rec_id", "start", "end"])

    edges = kept(repeated_edges(kept(sampled(records(spark, sf_dir)))))
    members = kept(edges.groupBy("kmer", "rec_id", "cell").agg(F.collect_set("start").alias("starts")))
    a, b = (members.select("kmer", *(F.col(c).alias(f"{c}_{x}") for c in ("rec_id", "cell", "starts"))) for x in "ab")
    pairs = a.join(spread(b), "kmer").where("rec_id_a < rec_id_b and (cell_a is not null or cell_b is not null) and not (cell_a <=> cell_b)")
    seeds = kept(pairs.select(F.col("rec_id_a").alias("rec_a"), F.col("rec_id_b").alias("rec_b"), "starts_a", "starts_b"))
    places = with_texts(spark, sf_dir, seeds).mapInArrow(run, "rec_id long, start int, end int").groupBy("rec_id", "start").agg(F.max("end").alias("end"))  # at most one for each character of a record
    before = F.max("end").over(Window.partitionBy("rec_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    shared = places.withColumn("added", added).groupBy("rec_id").agg(F.sum("added").alias("shared_chars"))
    flat = F.length(F.regexp_replace("text", r"(?U)[\s\x{1C}-\x{1F}]+", " "))
    sizes = records(spark, sf_dir).select("rec_id", flat.cast("long").alias("chars")).groupBy("rec_id").agg(F.max("chars").alias("chars"))
    return shared.join(spread(sizes), "rec_id").select("rec_id", "chars", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("share"))
