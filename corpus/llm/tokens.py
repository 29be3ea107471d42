"""Problem 8: token ids of a public byte-level BPE vocabulary, by Spark's own expressions, and back.

A text is cut into words by the tokenizer's pattern. Each distinct word of the corpus is encoded once: its bytes are
folded by `aggregate`, each step merging the leftmost pair of pieces of least rank, until no pair has one. Ranks stand
in a literal: an array of BUCKETS small maps, of which a piece's hash picks one. The rank of each pair is kept beside its
left piece, so that a step looks up only the two pairs that it changes. The ids of few distinct words go back to the
texts as a literal of a checked size, those of more by a join (see laid_out).

Null and empty texts both give an empty list. Text that looks like a special token is ordinary text. Texts are read
whole; equal texts get equal ids; a row with a null id keeps its ids.
"""

from __future__ import annotations

import base64
import json
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import kept, table

#: Distinct words that are sent to the texts instead of joined to them.
BUCKETS, NEAR, NEAR_BYTES = 4096, 50_000, 8_000_000


@cache
def ranks(path: str) -> list[str]:
    """The pieces of a .tiktoken file in hexadecimal, in order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f]
    out = [""] * (1 + max(int(r) for _, r in pairs))
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece).hex().upper()
    return out


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """The path of a vocabulary of public_tokenizers."""
    import public_tokenizers as P

    return P.path(f"{name}.tiktoken")


def pattern() -> str:
    """The public pattern for Java, with Unicode's white space and none of Java's own sets."""
    import public_tokenizers as P

    space = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    return P.PATTERN.replace(r"[^\s\p{L}", f"[^{space}" + r"\p{L}").replace(r"\s+(?!\S)", f"[{space}]+(?![^{space}])").replace(r"|\s+", f"|[{space}]+")


def _bucket(piece: Column) -> Column:
    return F.pmod(F.crc32(piece), F.lit(BUCKETS)).cast("int") + 1


def _table(spark: SparkSession, path: str) -> Column:
    """The ranks as a literal array of maps; the vocabulary is fixed, about 50,000 pieces."""
    import zlib

    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for rank, piece in enumerate(ranks(path)):
        if piece:
            maps[zlib.crc32(piece.encode()) % BUCKETS][piece] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of distinct words.

    Pieces are hexadecimal strings, two characters a byte; the state of the fold is two arrays: pieces, and for each the rank of it and its right neighbour.
    """
    lookup = _table(words.sparkSession, path)
    rank = lambda piece: F.try_element_at(F.element_at(lookup, _bucket(piece)), piece)
    none = F.lit(1 << 30)
    joined = lambda p, i: F.when((i >= 1) & (i < F.size(p)), F.concat(F.get(p, i - 1), F.get(p, i))).otherwise("")
    ranked = lambda pieces: F.transform(pieces, lambda x: F.coalesce(rank(x), none))

    def look(x: Column) -> Column:
        least = F.array_min(x["r"])
        at = F.when(least < none, F.array_position(x["r"], least).cast("int")).otherwise(0)
        return F.struct(x["p"].alias("p"), x["r"].alias("r"), at.alias("at"))

    def state(p: Column, r: Column) -> Column:
        # the arrays are made once and handed on by a transform of one element, as expressions here have no names
        return F.get(F.transform(F.array(F.struct(p.alias("p"), r.alias("r"))), look), F.lit(0))

    def step(s: Column, _: Column) -> Column:
        p, r, at = s["p"], s["r"], s["at"]  # at: the place, from 1, of the pair to merge; 0 when there is none
        q = F.concat(F.slice(p, F.lit(1), at - 1), F.array(joined(p, at)), F.slice(p, at + 2, F.size(p)))
        # the new piece's pairs with its left and its right neighbour are the only ones that change
        changed = ranked(F.get(F.transform(F.array(q), lambda y: F.array(joined(y, at - 1), joined(y, at))), F.lit(0)))
        ranks_ = F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), F.slice(changed, F.when(at > 1, 1).otherwise(2), F.lit(2)), F.slice(r, at + 2, F.size(r)))
        return F.when(at > 0, state(q, ranks_)).otherwise(s)

    hexed = F.hex(F.encode("word", "UTF-8"))
    out = kept(words.withColumn("hexed", hexed).withColumn("whole", rank(F.col("hexed"))))
    whole = out.where("whole is not null").select("word", F.array("whole").alias("ids"))
    singles = F.transform(F.sequence(F.lit(0), F.octet_length("word") - 1), lambda i: F.substring(F.col("hexed"), i * 2 + 1, F.lit(2)))
    parts = out.where("whole is null").select("word", singles.alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: joined(F.col("p"), i))
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), state(F.col("p"), ranked(pairs)), step)
    return whole.unionByName(parts.select("word", F.transform(end["p"], rank).alias("ids")))


def cut_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, at, words) of each row of df: the words of its text by the pattern, and a number of the row."""
    rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("at"))
    return kept(rows.select("doc", "at", F.regexp_extract_all("text", F.lit(pattern()), F.lit(0)).alias("words")))


def distinct_words(cut: DataFrame) -> DataFrame:
    return kept(cut.select(F.explode("words").alias("word")).distinct())


def _near(words: DataFrame) -> Column:
    """The ids of some words, NEAR at most, as a literal array of maps."""
    import zlib

    maps: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
    for r in words.collect():
        maps[zlib.crc32(r.word.encode()) % BUCKETS][r.word] = list(r.ids)
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,array<int>>>")


def laid_out(cut: DataFrame, words: DataFrame, near: int) -> DataFrame:
    """(doc, ids): the ids of each text's words in order.

    Up to `near` distinct words of NEAR_BYTES together go to the texts as a literal, and no text is moved; more of them meet the texts' words in a join,
    whose words' side is broadcast if its size allows, and whose hot words (' the') adaptive execution splits where it doesn't.
    """
    none = F.array().cast("array<int>")
    size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    if size.n <= near and size.bytes <= NEAR_BYTES:
        table_ = _near(words)
        ids = F.flatten(F.transform("words", lambda w: F.try_element_at(F.element_at(table_, _bucket(w)), w)))
        return cut.select("doc", F.when(F.coalesce(F.size("words"), F.lit(0)) <= 0, none).otherwise(F.coalesce(ids, F.raise_error(F.lit("a word has no ids")).cast("array<int>"))).alias("ids"))
    found = cut.select("at", F.posexplode("words").alias("pos", "word")).join(words, "word").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("found"))
    ids = found.select("at", F.flatten(F.transform("found", lambda x: x["ids"])).alias("ids"))
    return cut.select("doc", "at").join(ids, "at", "left").select("doc", F.coalesce("ids", none).alias("ids"))


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None, near: int = NEAR) -> DataFrame:
    """(key, ids) of each row of df; key need not be unique or set."""
    cut = cut_words(df, key, text)
    words = kept(encode_words(distinct_words(cut), path or vocabulary()))
    return laid_out(cut, words, near).select(F.col("doc").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n): the number of ids of each row of df. Only counts are moved: each word's, and partial sums of each text."""
    cut = cut_words(df, key, text)
    words = kept(encode_words(distinct_words(cut), path or vocabulary()).select("word", F.size("ids").alias("k")))
    n = cut.select("at", F.explode("words").alias("word")).join(words, "word").groupBy("at").agg(F.sum("k").alias("n"))
    return cut.select("doc", "at").join(n, "at", "left").select(F.col("doc").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def decoded(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with the text of its ids: the pieces' bytes one after the other, read as UTF-8."""
    pieces = F.from_json(F.lit(json.dumps(ranks(path or vocabulary()))), "array<string>")
    whole = F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")
    return df.withColumn("text", F.decode(F.unhex(whole), "UTF-8"))


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_ids: (doc_id, ids) of each document by byte_bpe_50k."""
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_decoded: (doc_id, text, n_ids): each document's text as it comes back from its ids."""
    return decoded(document_ids(spark, sf_dir)).select("doc_id", "text", F.size("ids").alias("n_ids"))
