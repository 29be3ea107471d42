"""Problem 3: repetition inside a text, scored by boosted trees over its statistics.

The trees are fitted on the labelled rows of a bounded sample (SAMPLE rows, those of least hash, labelled by the rule)
and, so that both classes are there whatever the sample holds, on the two calibration texts below. The score may only
rise with the shares of repeated words, sentences and lines and of the most frequent word, and only fall with the share
of distinct words. One bin edge of the repeated share is LIMIT itself. Every row is scored; rows that score as a row at
the limit may at least are settled by the rule.

Null and blank texts have no words and are no cases; equal rows get equal scores; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table, words
from .samples import bounded_sample
from .trees import Trees, fit

RUN, LIMIT, SAMPLE = 5, 0.3, 4096
FEATURES = ["repeated_share", "sentence_share", "line_share", "top_word_share", "distinct_share", "words"]
DIRECTION = [1, 1, 1, 1, -1, 0]
_SENTENCE = re.compile(r"[.!?。！？۔؟\n]+")
_CALIBRATION = ("no phrase of this short text comes back, and each of its words stands here for the first time", "so much work so little time " * 12)


def repeated_words(w: list[str], run: int = RUN) -> int:
    """How many of the words lie in a run that already began earlier in the text."""
    grams = list(zip(*(w[k:] for k in range(run))))
    if len(set(grams)) == len(grams):
        return 0
    seen, covered, end = set(), 0, 0
    for i, gram in enumerate(grams):
        if gram in seen:
            covered += i + run - max(i, end)
            end = i + run
        else:
            seen.add(gram)
    return covered


def is_repetitive(text: str) -> bool:
    w = words(text)
    return bool(w) and 10 * repeated_words(w) >= 3 * len(w)


def _again(parts: list[str]) -> float:
    """The share of characters in parts that stood there before."""
    n = Counter(x for p in parts if (x := p.strip()))
    whole = sum(len(x) * k for x, k in n.items())
    return 1 - sum(map(len, n)) / whole if whole else 0.0


def statistics(text: str) -> list[float]:
    """The FEATURES of a text."""
    w = words(text)
    if not w:
        return [0.0] * len(FEATURES)
    n = Counter(w)
    return [repeated_words(w) / len(w), _again(_SENTENCE.split(text)), _again(text.split("\n")), max(n.values()) / len(w), len(n) / len(w), float(len(w))]


def fit_trees(texts: list[str]) -> Trees:
    """Trees for the texts, labelled by the rule."""
    x = np.array([statistics(t) for t in [*texts, *_CALIBRATION]])
    y = np.array([float(is_repetitive(t)) for t in [*texts, *_CALIBRATION]])
    grid = [np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19))) for f in range(x.shape[1])]
    grid[0] = np.unique([*np.linspace(0.05, 0.95, 19).round(2), LIMIT])
    return fit(x, y, grid, DIRECTION)


def scored(df: DataFrame, text: str, trees: Trees) -> DataFrame:
    """df with the FEATURES of each text, its score, and whether it is repetitive by score and rule."""
    least = trees.least(FEATURES.index("repeated_share"), LIMIT)
    names = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            x = np.array([statistics(t or "") for t in texts]).reshape(-1, len(FEATURES))
            score = trees.score(x)
            hit = score >= least - 1e-9
            hit[hit] = [is_repetitive(texts[i] or "") for i in np.flatnonzero(hit)]
            made = [*(pa.array(x[:, k]) for k in range(len(FEATURES))), pa.array(1 / (1 + np.exp(-score))), pa.array(hit)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *made], [*names, *FEATURES, "score", "repetitive"])

    kinds = [f"`{c}` {t}" for c, t in df.dtypes if c != text] + [f"{c} double" for c in (*FEATURES, "score")] + ["repetitive boolean"]
    return df.mapInArrow(run, ", ".join(kinds))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "generated_corpus").select(F.col("rec_id").cast("long").alias("rec_id"), "generated_text").where("rec_id is not null and generated_text is not null")


def repetition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_scores: (rec_id, FEATURES, score, repetitive) of each row with a text."""
    rows = generated(spark, sf_dir)
    sample = bounded_sample(rows, "rec_id", SAMPLE)
    return scored(rows, "generated_text", fit_trees([r.generated_text for r in sample.collect()]))


def repetitive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found: rows in which at least 30 % of the words lie in a repeated run of five."""
    return repetition_scores(spark, sf_dir).where("repetitive").select("rec_id")
