"""Problem 10: the language of each document and of each stretch of a mixed one, by unigram pieces summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece, found by
expectation-maximization on lang_samples and then on those sentences of a bounded sample of documents (SAMPLE, those of
least hash) that the first model gives to one language with confidence; it is smoothed by a base that has every byte
and every piece. A word's probability in a language is the sum over all its segmentations into pieces, by the forward
algorithm, for all languages at once; the base alone stands for no language. A sentence's score is the sum of its words',
pieces never reaching over a word's end, so that each word needs scoring once. Scripts only narrow the languages asked.

A unit of text is a full sentence if it has enough words or letters for one (fewer if it has a closing mark) and some
language explains it better than the base. Null, blank and wordless texts hold none and get no language; a document whose
label is null, blank, a word for unknown or none that is known here counts as unlabelled; very long texts are read whole;
rows with a null doc_id are left out.
"""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table
from .samples import bounded_sample

NAMES = {
    "en": "en eng english", "zh": "zh zho chi chinese mandarin cmn yue hans hant", "ja": "ja jpn japanese jp", "ko": "ko kor korean kr",
    "th": "th tha thai", "id": "id ind indonesian bahasa", "tl": "tl tgl tagalog fil filipino", "ur": "ur urd urdu",
}
CODE = {n: k for k, v in NAMES.items() for n in v.split()}
LANGS = list(NAMES)
_AT = {x: i for i, x in enumerate(LANGS)}
VOCABULARY, SAMPLE, ROUNDS, SMOOTH, CERTAIN, GAIN, LONGEST, WORDS = "byte_bpe_multi_50k", 2000, 2, 50.0, 0.99, 0.15, 100, 100_000

_SCRIPTS = {
    "ko": re.compile(r"[ᄀ-ᇿ㄰-㆏가-힯]+"),
    "kana": re.compile(r"[ぁ-ヺー-ヿㇰ-ㇿ]+"),
    "han": re.compile(r"[㐀-䶿一-鿿豈-﫿]+"),
    "th": re.compile(r"[฀-๿]+"),
    "ur": re.compile(r"[؀-ۿݐ-ݿࢠ-ࣿ]+"),
    "latin": re.compile(r"[A-Za-zÀ-ɏ]+"),
}
_UNIT = re.compile(r"[^.!?。！？۔؟\n]*(?:[.!?。！？۔؟]+[\"'”’)\]」』]*|\n|$)")
_THAI = re.compile(r"([฀-๿](?:[฀-๿\s\d,]*[฀-๿])?)")
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+)*")
_STOP = re.compile(r"[.!?。！？۔؟]")
_LETTERS = re.compile(r"[^\W\d_]+")
OF_SCRIPT = {"latin": ["en", "id", "tl", "ur"], "cjk": ["zh", "ja"], "ko": ["ko"], "th": ["th"], "ur": ["ur"]}


def label(lang: str | None) -> str | None:
    """The code that a label stands for; None if it is missing or names no language known here."""
    s = unicodedata.normalize("NFKC", lang or "").strip().lower()
    return CODE.get(s) or next((CODE[x] for x in re.split(r"[^a-z]+", s)[:1] if x in CODE), None)


@cache
def pieces(name: str = VOCABULARY) -> dict[bytes, int]:
    import public_tokenizers as P

    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def units(text: str) -> Iterator[tuple[int, str]]:
    """(place, stretch) up to each closing mark or line end; Thai has no closing mark, so what follows it is a stretch of its own."""
    for m in _UNIT.finditer(text):
        at = m.start()
        for part in _THAI.split(m[0]):
            if part.strip():
                yield at, part
            at += len(part)


def asked(unit: str) -> list[str]:
    """The languages of the unit's main script; none if the unit is too short for a full sentence."""
    words, closed = _WORD.findall(unit), bool(_STOP.search(unit))
    if unit.isascii():
        return OF_SCRIPT["latin"] if len(words) >= (3 if closed else 8) else []
    n = {script: sum(map(len, runs.findall(unit))) for script, runs in _SCRIPTS.items()}
    cjk = n["kana"] + n["han"]
    # letters weigh as much text as they carry: a Han character about as much as half a Latin word
    weight = {"ko": 2 * n["ko"], "cjk": 3 * cjk, "th": n["th"], "ur": n["ur"], "latin": n["latin"]}
    top = max(weight, key=weight.get)
    size, least = {"cjk": (cjk, 6 if closed else 14), "ko": (n["ko"], 7 if closed else 14), "th": (n["th"], 20), "ur": (len(unit.split()) if n["ur"] else 0, 4 if closed else 8), "latin": (len(words), 3 if closed else 8)}[top]
    return OF_SCRIPT[top] if size >= least else []


def words_of(unit: str) -> list[bytes]:
    """The unit's runs of letters, in lower case and compatibility form, as bytes with the space before them."""
    plain = unit if unit.isascii() else unicodedata.normalize("NFKC", unit)
    return [b" " + w.encode() for w in _LETTERS.findall(plain.lower())]


class Model:
    """p: for each piece a row of its probability in each language and, last, in the base."""

    def __init__(self, p: np.ndarray, vocabulary: dict[bytes, int], longest: int):
        self.p, self.vocabulary, self.longest = p, vocabulary, longest
        self.known: dict[bytes, int] = {}
        self.logs = np.empty((0, p.shape[1]))
        self.rows: dict[int, list[float]] = {}
        self.reach = [1] * 256  # the longest piece that begins with each byte
        for piece in vocabulary:
            if piece and len(piece) <= longest:
                self.reach[piece[0]] = max(self.reach[piece[0]], len(piece))

    def arcs(self, word: bytes) -> list[list[tuple[int, int]]]:
        """For each end of a piece in the word the (start, piece) that reach it."""
        get, n, out = self.vocabulary.get, len(word), [[] for _ in word]
        for i, first in enumerate(word):
            for j in range(i + 1, min(i + self.reach[first], n) + 1):
                if (k := get(word[i:j])) is not None:
                    out[j - 1].append((i, k))
        return out

    def log_probability(self, word: bytes) -> np.ndarray:
        """Log of the sum over all segmentations, in each language and in the base."""
        rows, a, scale = self.rows, [[1.0] * self.p.shape[1]], 0.0
        for j, arcs in enumerate(self.arcs(word), 1):
            total = [0.0] * self.p.shape[1]
            for i, k in arcs:
                if (p := rows.get(k)) is None:
                    p = rows[k] = self.p[k].tolist()
                total = [t + x * y for t, x, y in zip(total, a[i], p)]
            a.append(total)
            if not j % 8:  # long words: the sums that pieces can still reach back to are kept in range together
                top = max(total)
                for i in range(max(0, j - self.longest), j + 1):
                    a[i] = [x / top for x in a[i]]
                scale += math.log(top)
        return np.log(np.maximum(a[-1], 5e-324)) + scale

    def row(self, word: bytes) -> int:
        """The row of `logs` that holds the word's log probabilities."""
        k = self.known[word] = len(self.known)
        if k >= len(self.logs):
            self.logs = np.concatenate([self.logs, np.empty((len(self.logs) + 1024, self.p.shape[1]))])
        self.logs[k] = self.log_probability(word)
        return k

    def score(self, unit: str) -> tuple[np.ndarray, int]:
        w = words_of(unit)
        if len(self.known) + len(w) > WORDS:
            self.known.clear()
        known = self.known
        rows = [k if (k := known.get(x)) is not None else self.row(x) for x in w]
        return self.logs[rows].sum(0), sum(map(len, w))


def fit_model(counts: dict[bytes, np.ndarray], start: Model | None = None) -> Model:
    """A model by EM from how often each language has each word of up to LONGEST bytes; piece counts are expected over all segmentations."""
    vocabulary = pieces()
    size, longest = 1 + max(vocabulary.values()), min(24, max(map(len, vocabulary)))
    base = np.full(size, 0.5 / size)
    for piece, k in vocabulary.items():
        if len(piece) == 1:
            base[k] += 0.5 / 256
    base /= base.sum()
    model = start or Model(np.repeat(base[:, None], len(LANGS) + 1, 1), vocabulary, longest)
    counts = {w: n for w, n in counts.items() if len(w) <= LONGEST}
    arcs = {w: [(np.array([i for i, _ in x]), np.array([k for _, k in x])) for x in model.arcs(w)] for w in counts}
    for _ in range(ROUNDS):
        expected = np.zeros((size, len(LANGS)))
        p = model.p[:, :-1]
        for w, n in counts.items():
            end = len(w)
            a, b = np.zeros((end + 1, len(LANGS))), np.zeros((end + 1, len(LANGS)))
            a[0] = b[end] = 1.0
            for j, (s, k) in enumerate(arcs[w], 1):
                a[j] = (a[s] * p[k]).sum(0)
            for j, (s, k) in zip(range(end, 0, -1), reversed(arcs[w])):
                b[s] += p[k] * b[j]
            share = n / np.maximum(a[end], 1e-300)
            for j, (s, k) in enumerate(arcs[w], 1):
                np.add.at(expected, k, a[s] * p[k] * (b[j] * share))
        q = (expected + SMOOTH * base[:, None]) / (expected.sum(0) + SMOOTH)
        model = Model(np.concatenate([q, base[:, None]], 1), vocabulary, longest)
    return model


def _count(sentences: list[tuple[str, str]]) -> dict[bytes, np.ndarray]:
    out: dict[bytes, np.ndarray] = {}
    for lang, text in sentences:
        for w in words_of(text):
            out.setdefault(w, np.zeros(len(LANGS)))[LANGS.index(lang)] += 1
    return out


def decide(model: Model, unit: str) -> tuple[str, float] | None:
    """(language, confidence) of a unit that is a full sentence, else None."""
    if not (langs := asked(unit)):
        return None
    score, size = model.score(unit)
    if not size:
        return None
    score = score.tolist()
    own, none = [score[_AT[x]] for x in langs], score[-1]
    best = max(own)
    if best - none < GAIN * size:
        return None
    return langs[own.index(best)], 1 / (sum(math.exp(x - best) for x in own) + math.exp(min(none - best, 0)))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """The model from lang_samples and then from the confident sentences of SAMPLE documents; both fit in the driver whatever the corpus."""
    samples = [(label(r.lang), r.text) for r in table(spark, sf_dir, "lang_samples").where("lang is not null and text is not null").collect()]
    samples = [(x, t) for x, t in samples if x]
    first = fit_model(_count(samples))
    docs = bounded_sample(table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id", SAMPLE).collect()
    more = []
    for r in docs:
        for _, u in units(r.text):
            if (d := decide(first, u)) and d[1] >= CERTAIN:
                more.append((d[0], u))
    model = fit_model(_count(samples + more), None)
    return model


def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, segment, start, length, sentences, confidence, label): runs of full sentences of one language in each document, in order; label is the code that documents.lang stands for."""
    # the model holds rows of the pieces seen, the others being the base's times a factor of each language: a fixed size
    model = trained(spark, sf_dir)
    shared = spark.sparkContext.broadcast((model.p.astype(np.float32), model.longest))
    names = ["doc_id", "lang", "segment", "start", "length", "sentences", "confidence", "label"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, longest = shared.value
        own = Model(p.astype(np.float64), pieces(), longest)
        for b in batches:
            out = []
            for doc, lang, text in zip(*(x.to_pylist() for x in b.columns)):
                found: list[list] = []
                for at, u in units(text):
                    if d := decide(own, u):
                        if not found or found[-1][0] != d[0]:
                            found.append([d[0], at, at, 0, 0.0])
                        x = found[-1]
                        x[2], x[3], x[4] = at + len(u), x[3] + 1, x[4] + d[1]
                out += [(doc, x[0], i, x[1], x[2] - x[1], x[3], x[4] / x[3], label(lang)) for i, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names)

    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "lang", "text")
    return docs.mapInArrow(run, "doc_id long, lang string, segment int, start int, length int, sentences int, confidence double, label string")


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_labels: (doc_id, lang, confidence, languages): the language of most of each document's sentences' text, and how many it holds."""
    by = stretches(spark, sf_dir).groupBy("doc_id", "lang").agg(F.sum("length").alias("length"), (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence"))
    top = by.groupBy("doc_id").agg(F.max_by(F.struct("lang", "confidence", "length"), F.struct("length", "lang")).alias("top"), F.sum("length").alias("all"), F.count(F.lit(1)).cast("int").alias("languages"))
    return top.select("doc_id", "top.lang", F.round(F.col("top.confidence") * F.col("top.length") / F.col("all"), 6).alias("confidence"), "languages")


def document_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_stretches: (doc_id, segment, start, length, lang, confidence) of the documents that hold several languages."""
    rows = stretches(spark, sf_dir)
    mixed = rows.groupBy("doc_id").agg(F.count_distinct("lang").alias("n")).where("n > 1").select("doc_id")
    return rows.join(mixed, "doc_id").select("doc_id", "segment", "start", "length", "lang", F.round("confidence", 6).alias("confidence"))


def mislabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_found: the languages of documents whose lang is missing or wrong or that hold several languages."""
    held = stretches(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("label").alias("label"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return held.where(wrong).select("doc_id", F.explode("langs").alias("lang"))
