"""Problem 5: text statistics, and the texts that are lists, tables, records or junk instead of prose.

STATISTICS of each text that isn't blank go into a Gaussian mixture. Expectation-maximization runs over all rows: an
iteration is one Spark aggregate of COMPONENTS * (1 + d + d * d) sums, whatever the number of rows. The components start
at the inspected EXAMPLES and are mapped to prose, list, table or junk by the examples' likelihood, not by their number.
Rows that the mixture doesn't give to prose with confidence, or that lie far from its prose components, or far below
the middle in binding words alone, are then read token by token: a row is a case if less than half of its characters stand among sentences or phrases.

Null and blank texts have no statistics and are no cases; with no rows at all there is nothing to fit and the result is
empty; equal rows get equal results. Words that are common come from cefr_lexicon, null words left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import condition_name, kept, table

#: Words that bind sentences; running text has many of them, lists, tables, records and loose words few.
FUNCTION_WORDS = frozenset(
    "a an the this that these those i you he she it we they me him her us them my your his its our their and or but if because so than as of at by for with about against "
    "between into through during before after to from in on out over under near not no nor only very much can could will would should may might must is are was were be been "
    "being am do does did have has had there here who what when where why how which while although unless until since just more most some any all each every few many several "
    "both other another such own too also first second however therefore moreover even yet still then".split()
)
AROUND, BOUND, ALIKE = 10, 0.2, 0.4
_EDGE = ".,;:!?\"'()[]{}*_—–-“”‘’…#>|/\\"
_ALNUM, _DIGIT, _BLANKS = re.compile(r"[\W_]+"), re.compile(r"[0-9]"), " \t\r\n\f\v\u0085             ​‌‍‎‏    ⁠　﻿"
_LINE_END = re.compile(r"[.!?。！？؟۔][\"'”’)\]*_]*$")

STATISTICS = ["mean_word_length", "symbol_ratio", "digit_ratio", "closed_line_share", "common_word_share", "binding_word_share", "hapax_ratio", "top20_word_share", "log_line_words"]
COMPONENTS, ROUNDS, RIDGE, SURE, FURTHEST, LOW = 7, 12, 1e-2, 0.99, 30.0, -3.0

#: Inspected examples of each class, from which the components start.
EXAMPLES = {
    "prose": [
        "In my opinion, smoking should be banned in all restaurants. The smoke is bad for people who eat there, and many of them are children. However, some owners think that they would lose customers if they did it.",
        "I agree that students should have a part-time job. It is good for them because they learn how to use money and time. When I was in my first year, I worked in a shop near the station, and I made new friends there. Therefore, I believe that we can learn a lot outside of the classroom.",
        "I'm sorry, but I cannot help with this request.",
    ],
    "list": [
        "Here are some points:\n- useful effort\n- minor choice\n- hidden risk\n- simple benefit\n- real problem\n- practical rule",
        "apple, river, window, carry, quiet, station, pencil, orange, build, market, winter, garden, copper, listen",
        "Health: real reason\nMoney: useful rule\nTime: simple worry\nPlan: important skill\nTea: minor habit",
    ],
    "table": [
        "| item | score | note |\n|---|---|---|\n| plan | 12 | good |\n| time | 31 | low |\n| rule | 77 | high |",
        "shop\t310\t4.20\tplan\nroom\t204\t0.91\tdesk\nmeal\t518\t7.35\tlamp\nbook\t927\t2.28\tdoor",
        '[{"plan": 124, "time": "small choice"}, {"room": 551, "rule": "hidden skill"}, {"shop": 87, "lamp": "real effort"}]',
        "08:15  plan  http://site12.invalid/room\n09:40  time  http://site77.invalid/desk\n21:05  rule  http://site31.invalid/lamp",
        "<ul><li class='a1'>small plan</li><li class='a7'>real rule</li><li class='a9'>hidden skill</li></ul>",
    ],
    "junk": ["@}&#@>?][> /__^#{@$}]+^$}+#%|\\|=?/?<! &_!/%_+*?$^$#~", "kq vnzr;plx wwtd ghzzk mprt;qj bvcx lkjh;zzt ww rtpq xn", "d9e5Qx2ajwc/OAtE4T0IzHDzFbrz59On+gyc6Z/oj6CoTf4rdTNl", "â¶€Ã eeÃ Ã©ÃÂ e ™¤¨¤¢ â€¶ÃÂe ©™Â©€Ã"],
}
CLASSES = list(EXAMPLES)
#: The component starts: how many of each class. One more component, BACKGROUND, is wide and stays as it is: what lies far from all others
#: goes there instead of widening one of them.
STARTS = {"prose": 1, "list": 1, "table": 2, "junk": 2}
BACKGROUND, WIDTH = 0.02, 15.0


def is_blank(text: str) -> bool:
    return not text.strip(_BLANKS)


def prose_share(text: str) -> float:
    """The share of characters that stand among sentences or phrases: of the 21 tokens around one, a fifth bind, or few plain words recur."""
    tokens = text.split()
    w = [x.lower().strip(_EDGE) for x in tokens]
    binding = [0]
    for x in w:
        binding.append(binding[-1] + (x in FUNCTION_WORDS))
    n, good = len(w), 0
    for i, token in enumerate(tokens):
        a = max(0, min(i - AROUND, n - 2 * AROUND - 1))
        b = min(n, a + 2 * AROUND + 1)
        if binding[b] - binding[a] >= BOUND * (b - a) or len(set(w[a:b])) <= ALIKE * (b - a) and all(x.isalpha() for x in w[a:b]):
            good += len(token)
    return good / max(1, sum(map(len, tokens)))


def is_no_prose(text: str) -> bool:
    return not is_blank(text) and prose_share(text) < 0.5


def statistics(text: str, common: frozenset[str]) -> list[float]:
    """The STATISTICS of a text."""
    plain = _ALNUM.sub(" ", text.lower())
    w = plain.split()
    n = max(1, len(w))
    letters = len(plain) - plain.count(" ")
    solid = max(1, sum(map(len, text.split())))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count = Counter(w)
    top = sum(k for _, k in count.most_common(20)) / n
    return [
        min(30.0, letters / n),
        1 - min(1.0, letters / solid),
        len(_DIGIT.findall(text)) / solid,
        sum(bool(_LINE_END.search(x.rstrip())) for x in lines) / max(1, len(lines)),
        sum(k for x, k in count.items() if x in common) / n,
        sum(k for x, k in count.items() if x in FUNCTION_WORDS) / n,
        sum(k == 1 for k in count.values()) / n,
        top,
        float(np.log1p(n / max(1, len(lines)))),
    ]


class Mixture:
    """Gaussians with full covariance over standardized statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.mean, self.scale, self.weights, self.means, self.covariances = mean, scale, weights, means, covariances
        self.inverse = np.linalg.inv(covariances)
        self.constant = np.log(np.maximum(weights, 1e-12)) - 0.5 * (np.linalg.slogdet(covariances)[1] + means.shape[1] * np.log(2 * np.pi))

    def distances(self, z: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distance of each row to each component."""
        return np.stack([np.einsum("ij,jk,ik->i", d := z - m, inv, d) for m, inv in zip(self.means, self.inverse)], 1)

    def posteriors(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logs = self.constant - 0.5 * self.distances(z)
        top = logs.max(1, keepdims=True)
        p = np.exp(logs - top)
        total = p.sum(1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -FURTHEST, FURTHEST)


def fit_mixture(stats: DataFrame, common: frozenset[str]) -> tuple[Mixture, list[str], list[tuple[str, np.ndarray]]] | None:
    """The mixture of all rows of stats, the class of each component, and the examples with their class; None if there is no row."""
    d = len(STATISTICS)
    one = stats.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q_{c}") for c in STATISTICS), *(F.stddev_pop(c).alias(f"s_{c}") for c in STATISTICS)).first()
    if not one["n"]:
        return None
    # by quartiles, so that the few odd rows don't set the scale on which they are to stand out
    mean = np.array([one[f"q_{c}"][1] for c in STATISTICS])
    scale = np.maximum.reduce([[(one[f"q_{c}"][2] - one[f"q_{c}"][0]) / 1.349 for c in STATISTICS], [one[f"s_{c}"] / 4 for c in STATISTICS], [1e-3] * d])
    shown = [(c, np.clip((np.array(statistics(t, common)) - mean) / scale, -FURTHEST, FURTHEST)) for c, ts in EXAMPLES.items() for t in ts]
    means = []
    for c, k in STARTS.items():
        own = np.array([z for x, z in shown if x == c])
        means += [part.mean(0) for part in np.array_split(own, k)]
    means = np.array([*means, np.zeros(d)])
    means[0] = 0.0  # the middle of all rows, most of which are prose
    wide = WIDTH**2 * np.eye(d)
    mixture = Mixture(mean, scale, np.full(COMPONENTS, 1 / COMPONENTS), means, np.array([np.eye(d)] + [25 * np.eye(d)] * (COMPONENTS - 2) + [wide]))
    before = -np.inf
    for _ in range(ROUNDS):
        sums = expectation(stats, mixture)
        n = sums[: COMPONENTS * (1 + d + d * d)].reshape(COMPONENTS, -1)
        weight = np.maximum(n[:, 0], 1e-9)
        means = n[:, 1 : 1 + d] / weight[:, None]
        squares = n[:, 1 + d :].reshape(COMPONENTS, d, d) / weight[:, None, None]
        covariances = squares - np.einsum("ki,kj->kij", means, means) + RIDGE * np.eye(d)
        thin = n[:, 0] < 2 * d  # too few rows for a shape of its own: it stays where it is
        means[thin], covariances[thin] = mixture.means[thin], mixture.covariances[thin]
        means[-1], covariances[-1], weight[-1] = 0.0, wide, BACKGROUND * weight.sum()
        mixture = Mixture(mean, scale, weight / weight.sum(), means, covariances)
        level = sums[-1] / one["n"]
        if abs(level - before) < 1e-3:
            break
        before = level
    votes = np.zeros((COMPONENTS, len(CLASSES)))
    for c, z in shown:
        votes[:, CLASSES.index(c)] += mixture.posteriors(z[None])[0][0] / len(EXAMPLES[c])
    nearest = [min(shown, key=lambda s, m=m: float(((s[1] - m) ** 2).sum()))[0] for m in mixture.means]
    kinds = [CLASSES[int(v.argmax())] if v.max() > 0.01 else near for v, near in zip(votes, nearest)]
    others = votes[-1, 1:]  # the background is never prose
    return mixture, [*kinds[:-1], CLASSES[1 + int(others.argmax())]], shown


def expectation(stats: DataFrame, mixture: Mixture) -> np.ndarray:
    """The sums of an EM step over all rows: for each component weight, statistics and their products; at the end the log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            z = mixture.standard(np.stack([c.to_numpy() for c in b.columns], 1))
            p, level = mixture.posteriors(z)
            own = [np.concatenate([[w.sum()], w @ z, (z * w[:, None]).T.dot(z).ravel()]) for w in p.T]
            part = np.concatenate([*own, [level.sum()]])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "part"])

    rows = stats.select(*STATISTICS).mapInArrow(run, "k int, part double").groupBy("k").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.k] = r.part
    return out


def common_words(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    """The words of cefr_lexicon in lower case: a fixed list of some hundreds."""
    return frozenset(r.w for r in table(spark, sf_dir, "cefr_lexicon").where("word is not null").select(F.lower(F.trim("word")).alias("w")).distinct().collect())


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, words, STATISTICS, text) of each row of generated_corpus whose text isn't blank."""
    common = common_words(spark, sf_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            full = pa.array([not is_blank(t) for t in texts], pa.bool_())
            x = np.array([statistics(t, common) for t in texts if not is_blank(t)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(full), *(pa.array(c) for c in x.T), b.column(1).filter(full)], ["rec_id", *STATISTICS, "text"])

    rows = table(spark, sf_dir, "generated_corpus").where("rec_id is not null and generated_text is not null").select(F.col("rec_id").cast("long"), "generated_text")
    return rows.mapInArrow(run, "rec_id long, " + ", ".join(f"{c} double" for c in STATISTICS) + ", text string")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, STATISTICS, class, confidence, is_case) of each row whose text isn't blank."""
    stats = kept(text_statistics(spark, sf_dir))
    schema = "rec_id long, " + ", ".join(f"{c} double" for c in STATISTICS) + ", class string, confidence double, is_case boolean"
    if not (fitted := fit_mixture(stats, common_words(spark, sf_dir))):
        return spark.createDataFrame([], schema)
    mixture, kinds, shown = fitted
    odd = [(c, e) for c, e in shown if c != "prose"]
    prose = np.array([k == "prose" for k in kinds])
    far = len(STATISTICS) + 4 * np.sqrt(2 * len(STATISTICS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = mixture.standard(np.stack([c.to_numpy() for c in b.columns[1:-1]], 1))
            p, _ = mixture.posteriors(z)
            by = np.stack([p[:, [k == c for k in kinds]].sum(1) for c in CLASSES], 1)
            near = mixture.distances(z)[:, prose].min(1) if prose.any() else np.full(len(z), np.inf)
            ask = (by[:, CLASSES.index("prose")] < SURE) | (near > far) | (z[:, STATISTICS.index("binding_word_share")] < LOW)
            names = np.array(CLASSES, object)[by.argmax(1)]
            for i in np.flatnonzero(p.argmax(1) == COMPONENTS - 1):  # in the background the nearest example names the class
                names[i] = min(odd, key=lambda s, i=i: float(((s[1] - z[i]) ** 2).sum()))[0]
            case = np.zeros(len(z), bool)
            texts = b.column(len(STATISTICS) + 1)
            case[ask] = [is_no_prose(texts[int(i)].as_py()) for i in np.flatnonzero(ask)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(names), pa.string()), pa.array(by.max(1)), pa.array(case)], ["rec_id", *STATISTICS, "class", "confidence", "is_case"])

    return stats.select("rec_id", *STATISTICS, "text").mapInArrow(run, schema)


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_statistics: the statistics, class and confidence of each row."""
    return classified(spark, sf_dir)


def rows_without_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: rows that consist for more than half of lists, tables, records, markup, loose words or meaningless characters."""
    return classified(spark, sf_dir).where("is_case").select("rec_id")


def against_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_against: (model_id, rows, hapax_difference, top20_difference): mean distance, in percent points, of hapax_ratio and top20_word_share from the feature matrix.

    Matrix values that are null or NaN are left out; a value of at most 1 is a share and counts a hundredfold. A cell with several rows on either side is averaged first.
    """
    unit = lambda c: F.when(F.isnan(c), None).when(F.col(c) <= 1, F.col(c) * 100).otherwise(F.col(c))
    f = table(spark, sf_dir, "features_all_with_neosca").where("model != 'HUMAN'").groupBy("key", "model", F.col("condition").alias("cond")).agg(F.avg(unit("Hapax_Ratio")).alias("hapax"), F.avg(unit("Top20_Word_Share")).alias("top20"))
    g = table(spark, sf_dir, "generated_corpus").select("rec_id", F.concat_ws("|", "source_id", "topic").alias("key"), F.col("model_id").alias("model"), condition_name(F.col("condition")).alias("cond"))
    s = text_statistics(spark, sf_dir).select("rec_id", "hapax_ratio", "top20_word_share").join(g, "rec_id").groupBy("key", "model", "cond").agg(F.avg("hapax_ratio").alias("h"), F.avg("top20_word_share").alias("t"))
    both = s.join(f, ["key", "model", "cond"])
    return both.groupBy(F.col("model").alias("model_id")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.abs(F.col("h") * 100 - F.col("hapax"))), 4).alias("hapax_difference"), F.round(F.avg(F.abs(F.col("t") * 100 - F.col("top20"))), 4).alias("top20_difference"))
