"""Problem 2: texts of evaluation splits that occur again, the same or nearly so, in the training split of their scope.

The rule: both texts have at least LEAST_WORDS words, and the longest common subsequence of their words has at least
four fifths of the longer one's n words.

The join is a weighted cosine join. A text of n words is a unit vector of its n terms (word, k-th occurrence), each with
weight 1 / sqrt(n). Times both norms, a dot product is the number of words that two texts share in any order, so that a
case has at least 0.8 times the longer one's n of them, a cosine of at least 0.8. Within a block of texts of like length
the inverted lists of the most frequent terms are held as dense rows and multiplied together; as all weights of a text
are equal, the other terms of a pair can add no more than the smaller residual, whose square over n is the residual
norm. Pairs that partial product plus residual leave below the bound are pruned; of the others the exact dot product is
taken, and what passes it is settled by the longest common subsequence. No bound loses a case, whatever the words.

Equal word sequences are joined once and brought back by their class. Null texts and texts of fewer words are in no
pair, a row without rec_id, scope or split neither.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import kept, scoped_rows, split_name, table, words

LEAST_WORDS = 20
#: Dense lists: so many that they hold COVER of the words, between LEAST_DENSE and MOST_DENSE.
COVER, LEAST_DENSE, MOST_DENSE, CHUNK = 0.8, 384, 1024, 512
#: Texts of a block; more of them are split into further blocks, each pair of texts meeting in one.
EVAL_BLOCK, TRAIN_BLOCK, BAND = 16384, 16384, 1.6


def common_in_order(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := at.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def near_same(a: list, b: list) -> bool:
    longer = max(len(a), len(b))
    return min(len(a), len(b)) >= LEAST_WORDS and 5 * common_in_order(a, b) >= 4 * longer


def _terms(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, n): the (word, occurrence) terms of all texts, numbered alike wherever `known` is shared, and the words of each text."""
    ids = [list(map(known.__getitem__, s.split(" "))) for s in texts]
    n = np.array([len(x) for x in ids])
    text = np.repeat(np.arange(len(ids), dtype=np.int64), n)
    packed = np.sort(text << 32 | np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())))
    first = np.concatenate([[True], packed[1:] != packed[:-1]])
    run = np.arange(len(packed))
    run -= np.maximum.accumulate(np.where(first, run, 0))
    return (packed & (1 << 32) - 1) << 24 | np.minimum(run, (1 << 24) - 1), packed >> 32, n


def _dense(term: np.ndarray, text: np.ndarray, n: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dense rows of the texts, a column for each of the lists, and the residual of each text."""
    at = np.minimum(np.searchsorted(lists, term), len(lists) - 1)
    held = lists[at] == term
    rows = np.zeros((len(n), len(lists)), np.float32)
    rows[text[held], at[held]] = 1
    return rows, n.astype(np.float32) - rows.sum(1)


def _alike_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """(eval_key, train_key): the cases between the evaluation and training texts of a block."""
    found = []
    e, t = (block[block.is_eval.to_numpy() == side].sort_values("n", kind="stable") for side in (True, False))
    if len(e) and len(t):
        known: dict[str, int] = defaultdict(count().__next__)
        et, tt = _terms(e.words.tolist(), known), _terms(t.words.tolist(), known)
        en, tn = et[2], tt[2]
        names, often = np.unique(tt[0], return_counts=True)
        order = np.argsort(-often, kind="stable")
        wide = int(np.clip(np.searchsorted(np.cumsum(often[order]), COVER * often.sum()) + 1, LEAST_DENSE, MOST_DENSE))
        lists = np.sort(names[order[:wide]])
        (a, arest), (b, brest) = _dense(*et, lists), _dense(*tt, lists)
        cuts = [np.searchsorted(x[1], np.arange(len(x[2]) + 1)) for x in (et, tt)]
        own = [lambda i, x=x, c=c: set(x[0][c[i] : c[i + 1]].tolist()) for x, c in zip((et, tt), cuts)]
        ek, tk, ew, tw = e.key.to_numpy(), t.key.to_numpy(), e.words.to_numpy(), t.words.to_numpy()
        for i in range(0, len(en), CHUNK):
            rows = slice(i, i + CHUNK)
            low, high = np.searchsorted(5 * tn, 4 * en[rows][0], "left"), np.searchsorted(4 * tn, 5 * en[rows][-1], "right")
            bound = 0.8 * np.maximum.outer(en[rows], tn[low:high]).astype(np.float32) - 0.01
            partial = a[rows] @ b[low:high].T
            partial += np.minimum.outer(arest[rows], brest[low:high])
            for p, q in zip(*np.nonzero(partial >= bound)):
                p, q = i + int(p), int(low + q)
                if 5 * len(own[0](p) & own[1](q)) >= 4 * max(en[p], tn[q]) and near_same(ew[p].split(" "), tw[q].split(" ")):
                    found.append((ek[p], tk[q]))
    return pd.DataFrame(found, columns=["eval_key", "train_key"], dtype="int64")


def normal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, rec_id, is_eval, words, n): rows of enough words, as words under compatibility normalisation joined by spaces."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [words(x) if x else [] for x in b.column(3).to_pylist()]
            n = pa.array([len(x) for x in w], pa.int32())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([" ".join(x) for x in w], pa.string()), n], ["scope", "rec_id", "is_eval", "words", "n"])
            yield out.filter(pa.array([len(x) >= LEAST_WORDS for x in w], pa.bool_()))

    rows = scoped_rows(spark, sf_dir).where("scope is not null and rec_id is not null and text is not null")
    return rows.select("scope", F.col("rec_id").cast("long").alias("rec_id"), F.col("split").isin("test", "dev").alias("is_eval"), "text").mapInArrow(normal, "scope string, rec_id long, is_eval boolean, words string, n int")


def alike_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(eval_key, train_key) of the classes of equal texts that are alike, and (rec_id, is_eval, key): the class of each row."""
    rows = kept(normal_rows(spark, sf_dir).withColumn("digest", F.unhex(F.md5("words"))))
    classes = ["scope", "is_eval", "digest"]
    heads = kept(rows.groupBy(*classes).agg(F.min("rec_id").alias("key"), F.first("n").alias("n")))
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(BAND))).cast("int")
    slack = F.lit(1.2500001)
    texts = heads.withColumn("band", F.explode(F.when(F.col("is_eval"), F.sequence(band(F.col("n") / slack), band(F.col("n") * slack))).otherwise(F.array(band(F.col("n"))))))
    blocks = texts.groupBy("scope", "band").agg(*(F.ceil(F.count(F.when(side, 1)) / most).cast("int").alias(name) for side, most, name in ((F.col("is_eval"), EVAL_BLOCK, "ne"), (~F.col("is_eval"), TRAIN_BLOCK, "nt")))).where("ne > 0 and nt > 0")
    here, every = lambda n: F.array(F.pmod(F.xxhash64("key"), F.col(n)).cast("int")), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    places = texts.join(blocks, ["scope", "band"]).withColumn("eb", F.explode(F.when(F.col("is_eval"), here("ne")).otherwise(every("ne")))).withColumn("tb", F.explode(F.when(F.col("is_eval"), every("nt")).otherwise(here("nt"))))
    met = rows.select("rec_id", "words").join(places.withColumnRenamed("key", "rec_id"), "rec_id").select("scope", "band", "eb", "tb", "is_eval", F.col("rec_id").alias("key"), "n", "words")
    alike = met.groupBy("scope", "band", "eb", "tb").applyInPandas(_alike_in_block, "eval_key long, train_key long")
    members = rows.select("rec_id", *classes).join(heads.select(*classes, "key"), classes).select("rec_id", "is_eval", "key")
    return alike, members


def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: evaluation and training rows of one scope whose texts are the same or nearly so."""
    alike, members = alike_classes(spark, sf_dir)
    e, t = (members.where(side).select(F.col("key").alias(f"{name}_key"), F.col("rec_id").alias(name)) for side, name in (("is_eval", "eval"), ("not is_eval", "train")))
    pairs = alike.join(e, "eval_key").join(t, "train_key")
    return pairs.select(F.least("eval", "train").alias("rec_a"), F.greatest("eval", "train").alias("rec_b")).distinct()


def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_counts: (scope, split, region, rows, found): evaluation rows of each split and source region, and those of them that recur in training rows."""
    alike, members = alike_classes(spark, sf_dir)
    hit = members.join(alike.select(F.col("eval_key").alias("key")).distinct(), "key").where("is_eval").select("rec_id").distinct().withColumn("hit", F.lit(1))
    m = table(spark, sf_dir, "split_manifest").select(F.lit("split_manifest").alias("scope"), "rec_id", split_name(F.col("split")).alias("split"), F.split("file_name", "_")[1].alias("region"))
    d = table(spark, sf_dir, "l1_dataset").select(F.col("dataset").alias("scope"), "rec_id", split_name(F.col("split")).alias("split"), F.substring("key", 1, 3).alias("region"))
    rows = m.unionByName(d).where("split in ('test', 'dev')").join(hit, "rec_id", "left")
    return rows.groupBy("scope", "split", "region").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("found"))
