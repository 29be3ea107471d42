"""Bootstrap, randomisation and cluster resampling of paired values.

The keys are those of the fixed strata: at most a hundred of each region and topic, some thousands at any size of the
corpus, so that a cell's values fit in one task and all its features share the draws. Draws are hashes of (seed, replicate,
slot), the same on every machine and whatever the order of the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def draws(seed: int, reps: int, slots: int, n: int, stream: int = 0) -> np.ndarray:
    """reps by slots places below n."""
    with np.errstate(over="ignore"):
        r = mixed(np.arange(reps, dtype=_U) + _U(seed) * _U(0x9E3779B97F4A7C15) + _U(stream) * _U(0xD1B54A32D192ED03))
        return (mixed(r[:, None] + np.arange(slots, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15)) % _U(max(n, 1))).astype(np.int64)


def multiplicities(places: np.ndarray, n: int) -> np.ndarray:
    """How often each of n was drawn in each replicate."""
    reps = len(places)
    flat = np.bincount((np.arange(reps)[:, None] * n + places).ravel(), minlength=reps * n)
    return flat.reshape(reps, n).astype(np.float64)


def signs(seed: int, reps: int, keys: list[str]) -> np.ndarray:
    """reps by keys of +1 and -1, a key's column following from its name alone."""
    import xxhash

    with np.errstate(over="ignore"):
        h = np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], _U)
        r = mixed(np.arange(reps, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
        return np.where(mixed(r[:, None] ^ h[None, :]) & _U(1), 1.0, -1.0)


def stratum_means(values: pd.DataFrame, features: list[str], weights: list[np.ndarray]) -> np.ndarray:
    """reps by features: the mean over strata of weighted means; a stratum without a value is left out. weights: one matrix for each stratum of values."""
    total, held = 0.0, 0.0
    for w, (_, g) in zip(weights, values.groupby(["region", "topic"], sort=True)):
        v = g[features].to_numpy(np.float64)
        there = ~np.isnan(v)
        over = w @ np.where(there, v, 0.0)
        under = w @ there.astype(np.float64)
        total = total + np.divide(over, under, out=np.zeros_like(over), where=under > 0)
        held = held + (under > 0)
    return np.divide(total, held, out=np.full_like(total, np.nan), where=held > 0)


def bootstrap(values: DataFrame, features: list[str], reps: int = 1000, seed: int = 42) -> DataFrame:
    """(model, condition, feature, n_keys, n_strata, mean, low, high, p) of values (model, condition, key, region, topic, features).

    A replicate draws n of n keys in each stratum; p is the two-sided share of replicates on the other side of 0, 1 / reps at least.
    """

    def cell(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("key")
        strata = [x for _, x in g.groupby(["region", "topic"], sort=True)]
        weights = [multiplicities(draws(seed, reps, len(x), len(x), i), len(x)) for i, x in enumerate(strata)]
        means = stratum_means(g, features, weights)
        out = []
        for k, f in enumerate(features):
            v, m = g[f].dropna(), means[:, k][~np.isnan(means[:, k])]
            p = min(1.0, max(1 / reps, 2 * min((m <= 0).mean(), (m >= 0).mean()))) if len(m) else np.nan
            low, high = np.percentile(m, [2.5, 97.5]) if len(m) else (np.nan, np.nan)
            out.append((g.model.iloc[0], g.condition.iloc[0], f, len(v), sum(x[f].notna().any() for x in strata), v.mean() if len(v) else np.nan, low, high, p))
        return pd.DataFrame(out, columns=["model", "condition", "feature", "n_keys", "n_strata", "mean", "low", "high", "p"])

    return values.groupBy("model", "condition").applyInPandas(cell, "model string, condition string, feature string, n_keys long, n_strata long, mean double, low double, high double, p double")


def sign_flip(values: DataFrame, features: list[str], reps: int = 5000, seed: int = 42) -> DataFrame:
    """(model, condition, feature, n, mean, p, p_error): sign-flip test of each cell and feature, add-one p, its Monte-Carlo error; the signs are shared by all of them."""

    def cell(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("key")
        v = g[features].to_numpy(np.float64)
        there = ~np.isnan(v)
        n = there.sum(0)
        v = np.where(there, v, 0.0)
        mean = v.sum(0) / np.maximum(n, 1)
        null = signs(seed, reps, g.key.tolist()) @ v / np.maximum(n, 1)
        p = (1 + (np.abs(null) >= np.abs(mean) - 1e-12).sum(0)) / (reps + 1)
        return pd.DataFrame({"model": g.model.iloc[0], "condition": g.condition.iloc[0], "feature": features, "n": n, "mean": mean, "p": p, "p_error": np.sqrt(p * (1 - p) / (reps + 1))})

    return values.groupBy("model", "condition").applyInPandas(cell, "model string, condition string, feature string, n long, mean double, p double, p_error double")


def writer_bootstrap(values: DataFrame, features: list[str], reps: int = 10000, seed: int = 20261006) -> DataFrame:
    """(model, condition, feature, writers, valid, mean, low, high): writers are drawn with replacement within their region, all their keys with them, the same draws for all topics, cells and features.

    A replicate counts only if each stratum holds a drawn key.
    """

    def cell(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(writer=g.key.str.split("|").str[0]).sort_values("key")
        counts = {}
        for i, (region, x) in enumerate(g.groupby("region", sort=True)):
            names = sorted(x.writer.unique())
            counts[region] = {w: c for w, c in zip(names, multiplicities(draws(seed, reps, len(names), len(names), i), len(names)).T)}
        total, fine = 0.0, True
        for (region, _), x in g.groupby(["region", "topic"], sort=True):
            w = np.stack([counts[region][k] for k in x.writer], 1)
            v = x[features].to_numpy(np.float64)
            there = ~np.isnan(v)
            under = w @ there.astype(np.float64)
            total = total + np.divide(w @ np.where(there, v, 0.0), under, out=np.zeros_like(under), where=under > 0)
            fine = fine & (under > 0)
        means = total / g.groupby(["region", "topic"]).ngroups
        out = []
        for k, f in enumerate(features):
            m = means[fine[:, k], k]
            low, high = np.percentile(m, [2.5, 97.5]) if len(m) else (np.nan, np.nan)
            own = g.groupby(["region", "topic"])[f].mean()
            out.append((g.model.iloc[0], g.condition.iloc[0], f, g.writer.nunique(), len(m), own.mean(), low, high))
        return pd.DataFrame(out, columns=["model", "condition", "feature", "writers", "valid", "mean", "low", "high"])

    return values.groupBy("model", "condition").applyInPandas(cell, "model string, condition string, feature string, writers long, valid long, mean double, low double, high double")


def student_p(t: float, df: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def slope(x: np.ndarray, y: np.ndarray, *groups: np.ndarray) -> float:
    """Slope of y on x within all groups at once, by projection; NaN where x has no spread of its own or a group has one value only."""
    dummies = [np.ones((len(x), 1))]
    for g in groups:
        names = sorted(set(g))
        if len(names) < 2:
            return math.nan
        dummies.append(np.array([[v == n for n in names[1:]] for v in g], float))
    d = np.concatenate(dummies, 1)
    left = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    rx, ry = left(x), left(y)
    under = float(rx @ rx)
    return float(rx @ ry / under) if under > 1e-12 else math.nan


def permutation(cells: DataFrame, reps: int = 10000, seed: int = 42) -> DataFrame:
    """(slope, extreme, p): y is permuted within each model; add-one two-sided p of the slope. cells: model, condition, x, y, a few dozen rows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["model", "condition"]).reset_index(drop=True)
        x, model, condition = g.x.to_numpy(), g.model.to_numpy(), g.condition.to_numpy()
        seen = slope(x, g.y.to_numpy(), model, condition)
        dummies = np.concatenate([np.ones((len(g), 1)), *(np.array([[v == n for n in sorted(set(c))[1:]] for v in c], float) for c in (model, condition))], 1)
        rx = x - dummies @ np.linalg.lstsq(dummies, x, rcond=None)[0]
        lots = mixed(draws(seed, reps, len(g), 1 << 62, 7).astype(_U))
        ys = np.empty((reps, len(g)))
        for name in sorted(set(model)):
            at = np.flatnonzero(model == name)
            ys[:, at] = g.y.to_numpy()[at][np.argsort(lots[:, at], 1)]
        null = ys @ rx / (rx @ rx)  # rx is orthogonal to the groups, so y need not be projected
        k = int((np.abs(null) >= abs(seen) - 1e-12).sum())
        return pd.DataFrame({"slope": [seen], "extreme": [k], "p": [(1 + k) / (reps + 1)]})

    return cells.groupBy().applyInPandas(run, "slope double, extreme long, p double")


def block_bootstrap(cells: DataFrame, reps: int = 5000, seed: int = 42) -> DataFrame:
    """(valid, low, high): models are drawn with replacement, a model drawn twice counting twice; the interval of the slope."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g.model.unique())
        blocks = [g[g.model == n] for n in names]
        out = []
        for row in draws(seed, reps, len(names), len(names), 3):
            b = pd.concat([blocks[i] for i in row])
            out.append(slope(b.x.to_numpy(), b.y.to_numpy(), b.model.to_numpy(), b.condition.to_numpy()))
        out = np.array([v for v in out if not math.isnan(v)])
        low, high = np.quantile(out, [0.025, 0.975]) if len(out) else (np.nan, np.nan)
        return pd.DataFrame({"valid": [len(out)], "low": [low], "high": [high]})

    return cells.groupBy().applyInPandas(run, "valid long, low double, high double")
