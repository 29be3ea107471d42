"""Problem 7: texts that were cut off, by a trie of the corpus vocabulary, the corpus' sentence ends, and length.

Every text whose last words may be a cut is held against three kinds of evidence, all counted over the whole corpus:
- a trie of the words that at least SEEN texts hold before their last word: a last token that is no such word but a
  proper prefix of one is a word that was cut. The trie is built in shards by the words' first two letters, together
  with the last tokens of the same letters; it is never in one place;
- how often the last three, two or one tokens end a sentence and how often another word follows them;
- length: completion_tokens at a limit of the model (a count at which at least half of its texts have no closing mark), or
  LONGER times as many as the model's texts of that length have, speak for a cut, so that only a context that nearly
  always ends a sentence excuses the missing mark.
A phrase repeated at the end of a text must be complete. The contexts asked for go to the count as a bitmap of BITS bits,
which lets through all of them and only few others.

Null and blank texts and texts that are no prose are no cases; without completion_tokens there is no length evidence;
equal texts get the same answer but for their counts of tokens; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import condition_name, kept, table
from .prose import is_blank, is_no_prose

_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[.!?…。！？]+")
_PLAIN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
#: Sign-offs that end a text as a mark does.
_SIGN_OFFS = ("the end", "end of essay", "end of the essay", "thanks for reading", "thank you for reading", "thanks for your time", "thank you for your time")
_FACES = (":)", ":-)", ";)")
_MARKS, _NO_STOP = ".!?。！？؟۔", ".…"
_CLOSERS = "\"'”’)]*_" + "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_NO_WORD = re.compile(r"\W*")
LIKELY_END, CERTAIN_END, SEEN, STEM, OFTEN, LONGER, BITS, WORDS = 0.1, 0.9, 3, 0.002, 5, 1.12, 1 << 20, 200_000
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def ends_marked(text: str) -> bool:
    """Whether the text ends in a sentence's closing mark, a sign-off or a closed note after one. All is read from the end, so that a long text costs no more."""
    t = text.strip()
    bare = t.rstrip(_CLOSERS)
    if bare and bare[-1] in _MARKS and not bare.endswith(".."):
        i = len(bare)
        while i and bare[i - 1] in _MARKS:
            i -= 1
            if not i or bare[i - 1] not in _NO_STOP:
                return True
    if t.endswith(")") and (i := t.rfind("(")) >= 0 and ")" not in t[i:-1] and t[:i].rstrip()[-1:] in (".", "!", "?"):
        return True
    words_end = len(t) - _NO_WORD.match(t[::-1]).end()
    return any(x in t[words_end:] for x in _FACES) or t[max(0, words_end - 30) : words_end].lower().endswith(_SIGN_OFFS)


def loop_ends(text: str) -> bool | None:
    """Whether the phrase repeated at the end of the text is complete; None if none is repeated there."""
    w = _PLAIN.findall(text.lower())
    shape = ["9" if x.isdigit() else x for x in w]
    for q in range(1, min(40, len(w) // 3) + 1):
        body = shape[:-1]  # the last word may be cut
        k = len(body) - 1
        while k >= q and body[k] == body[k - q]:
            k -= 1
        start = k - q + 1
        if len(body) - start >= max(3 * q, 8):
            last, due = w[-1], w[-1 - q]
            whole = last == due or last.isdigit() and due.isdigit() and len(last) >= len(due)
            return whole and (len(w) - start) % q == 0
    return None


class Hashes(dict):
    """64-bit hashes of tokens, the same everywhere; emptied when it holds too many."""

    def __missing__(self, token: str) -> int:
        if len(self) > WORDS:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token)
        return h


def contexts(h: np.ndarray) -> np.ndarray:
    """Hashes of the last three, two and one of each token's forerunners and itself (a row each)."""
    one = h * _ODD[0]
    two, three = one.copy(), one.copy()
    two[1:] ^= (h[:-1] * _ODD[1]) >> np.uint64(3)
    three[1:] = two[1:]
    three[2:] ^= (h[:-2] * _ODD[0]) >> np.uint64(7)
    return np.stack([three ^ np.uint64(3), two ^ np.uint64(2), one ^ np.uint64(1)]).view(np.int64)


def last_words(rows: DataFrame) -> DataFrame:
    """(rec_id, model_id, condition, tokens, chars, marked, bare, loop, last, asked) of each row of prose; asked: the contexts of its last token.

    rows: rec_id, model_id, condition, tokens, text. Texts with a closing mark are complete: nothing is asked for them.
    """
    names = ["rec_id", "model_id", "condition", "tokens", "chars", "marked", "bare", "loop", "last", "asked"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            out = []
            for r, m, c, n, t in zip(*(x.to_pylist() for x in b.columns)):
                if is_blank(t):
                    continue
                marked = ends_marked(t)
                if not marked and is_no_prose(t):
                    continue
                w = [] if marked else _PLAIN.findall(t.lower())
                h = np.array([hashes[x] for x in w[-3:]], np.uint64)
                asked = contexts(h)[:, -1].tolist() if len(h) else []
                out.append((r, m, c, n, len(t), marked, t.rstrip()[-1:].isalnum(), None if marked else loop_ends(t), w[-1] if w else None, asked))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names)

    return rows.mapInArrow(run, "rec_id long, model_id string, condition string, tokens long, chars long, marked boolean, bare boolean, loop boolean, last string, asked array<long>")


def corpus_counts(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(context, word, ends, goes_on): partial counts over all texts of the contexts that the bitmap lets through and, with context null, of the texts that hold a word before their last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, df, seen = Hashes(), Counter(), []
        wanted = np.unpackbits(bits).astype(bool)

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([x[0] for x in seen] or [np.empty(0, np.int64)])
            ends = np.concatenate([x[1] for x in seen] or [np.empty(0, bool)])
            keys, at = np.unique(flat, return_inverse=True)
            n, e = np.bincount(at, minlength=len(keys)), np.bincount(at, ends, minlength=len(keys)).astype(np.int64)
            words = list(df)
            none = len(words)
            cols = [pa.array([*keys.tolist(), *[None] * none], pa.int64()), pa.array([*[None] * len(keys), *words], pa.string()), pa.array([*e.tolist(), *df.values()], pa.int64()), pa.array([*(n - e).tolist(), *[0] * none], pa.int64())]
            df.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays(cols, ["context", "word", "ends", "goes_on"])

        held = 0
        for batch in batches:
            tokens = [_TOKEN.findall(t.lower()) for t in batch.column(0).to_pylist()]
            for t in tokens:
                df.update(set(t[:-2]))
            flat = [x for t in tokens for x in t]
            h = np.fromiter((hashes[x] for x in flat), np.uint64, len(flat))
            mark = np.fromiter((x[0] in ".!?…。！？" for x in flat), bool, len(flat))
            last = np.cumsum([len(t) for t in tokens]) - 1
            inner = np.ones(len(flat), bool)
            inner[last[last >= 0]] = False
            inner[mark] = False  # a mark is no last word
            inner = np.flatnonzero(inner)
            for row in contexts(h):
                c = row[inner]
                keep = wanted[c & BITS - 1]
                seen.append((c[keep], mark[inner[keep] + 1]))
                held += int(keep.sum())
            if held > 2_000_000 or len(df) > WORDS:
                yield flush()
                held = 0
        yield flush()

    return texts.mapInArrow(run, "context long, word string, ends long, goes_on long")


def _in_trie(key: tuple, tokens: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Of the tokens of a shard, whether each is a word of the trie and whether it is a proper prefix of one.

    A node holds its children, the texts that hold its word, and the most texts that hold a longer one. A word that is
    STEM times as rare as a longer one is taken for cuts of that.
    """
    trie: list = [{}, 0, 0]
    for w, df in zip(words.word, words.df.tolist()):
        node = trie
        for c in w:
            node[2] = max(node[2], df)
            node = node[0].setdefault(c, [{}, 0, 0])
        node[1] = max(node[1], df)
    out = []
    for t in tokens["last"]:
        node = trie
        for c in t:
            if (node := node[0].get(c)) is None:
                break
        out.append((t, node is not None and node[1] > STEM * node[2], node is not None and node[2] > 0))
    return pd.DataFrame(out, columns=["last", "known", "prefix"])


def trie_lookup(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(last, known, prefix) of distinct tokens `last` against the words (word, df); both in shards by their first two letters.

    For tokens of one letter the shard of that letter holds the words' first two letters, of which there are few.
    """
    shard = lambda c: F.substring(c, 1, 2)
    short = words.groupBy(F.substring("word", 1, 1).alias("shard"), F.when(F.length("word") == 1, F.col("word")).otherwise(shard("word")).alias("word")).agg(F.max("df").alias("df"))
    sides = words.where(F.length("word") > 1).select(shard("word").alias("shard"), "word", "df").unionByName(short)
    return tokens.select(shard("last").alias("shard"), "last").groupBy("shard").cogroup(sides.groupBy("shard")).applyInPandas(_in_trie, "last string, known boolean, prefix boolean")


def endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, model_id, condition, cut) of each row of prose."""
    g = table(spark, sf_dir, "generated_corpus").where("rec_id is not null and generated_text is not null")
    g = g.select(F.col("rec_id").cast("long").alias("rec_id"), "model_id", condition_name(F.col("condition")).alias("condition"), F.col("completion_tokens").cast("long").alias("tokens"), F.col("generated_text").alias("text"))
    rows = kept(last_words(g))
    open_ = rows.where("not marked")
    asked = open_.select(F.explode("asked").alias("context")).select(F.expr(f"context & {BITS - 1}").cast("int").alias("bit")).distinct().toPandas()  # no more than BITS
    bits = np.zeros(BITS, bool)
    bits[asked.bit.to_numpy(np.int64)] = True
    counts = kept(corpus_counts(g.select("text"), np.packbits(bits)))
    words = counts.where("context is null").groupBy("word").agg(F.sum("ends").alias("df")).where(F.col("df") >= SEEN)
    found = trie_lookup(rows.where("last is not null").select("last").distinct(), words)

    per = open_.groupBy("model_id", "tokens").agg(F.count(F.lit(1)).alias("open"))
    limits = rows.groupBy("model_id", "tokens").agg(F.count(F.lit(1)).alias("n")).join(per, ["model_id", "tokens"]).where("open >= 4 and 2 * open >= n").select("model_id", "tokens", F.lit(True).alias("limit"))
    usual = rows.where("marked and tokens > 0").groupBy("model_id").agg(F.percentile_approx(F.col("tokens") / F.col("chars"), 0.5).alias("usual"))
    context = counts.where("context is not null").groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    known = open_.select("rec_id", F.posexplode("asked").alias("k", "context")).join(context, "context").where(F.col("ends") + F.col("goes_on") >= OFTEN)
    chance = known.groupBy("rec_id").agg(F.min_by(F.col("ends") / (F.col("ends") + F.col("goes_on")), "k").alias("chance"))

    all_ = rows.join(found, "last", "left").join(limits, ["model_id", "tokens"], "left").join(F.broadcast(usual), "model_id", "left").join(chance, "rec_id", "left")
    long = F.coalesce(F.col("limit"), F.lit(False)) | F.coalesce(F.col("tokens") > LONGER * F.col("usual") * F.col("chars"), F.lit(False))
    least = F.when(long | ~F.col("bare"), CERTAIN_END).otherwise(LIKELY_END)
    part = F.coalesce(F.col("prefix") & ~F.col("known"), F.lit(False))
    whole = F.coalesce("loop", ~part & (F.coalesce("chance", F.lit(0.0)) >= least))
    return all_.select("rec_id", "model_id", "condition", F.when(F.col("marked"), F.lit(False)).otherwise(~whole).alias("cut"), "marked", "loop", "last", "known", "prefix", "chance", long.alias("long"), "bare")


def cut_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_found: rows whose text stops inside a word or before its last sentence or repeated phrase is complete."""
    return endings(spark, sf_dir).where("cut").select("rec_id")


def cut_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_rates: (model_id, condition, rows, cut, rate) over the rows of prose."""
    g = endings(spark, sf_dir).groupBy("model_id", "condition").agg(F.count(F.lit(1)).alias("rows"), F.count_if("cut").alias("cut"))
    return g.withColumn("rate", F.round(F.col("cut") / F.col("rows"), 6))
