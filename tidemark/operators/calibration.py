"""Models fitted to one take: a strike model, and the instrument's tuning.

A take is one group, bounded by its length. A model that its own examples don't
support is refused: its probabilities are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ready

#: Examples and separation below which a model is refused.
LEAST_EXAMPLES, LEAST_AUC = 30, 0.75


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the constant) by iteratively reweighted least squares."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def auc(pos: np.ndarray, neg: np.ndarray) -> float:
    both = np.concatenate((pos, neg))
    order = both.argsort(kind="stable")
    rank = np.empty(len(both))
    rank[order] = np.arange(1, len(both) + 1)
    _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
    rank = (np.bincount(inverse, rank) / count)[inverse]  # ties share their rank
    return float((rank[: len(pos)].sum() - len(pos) * (len(pos) + 1) / 2) / max(1, len(pos) * len(neg)))


def strike_probabilities(rows: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    """Adds ``p`` to rows of each take: the model is fitted to rows with a label, and judged by them."""
    ready(rows.sparkSession)
    spec = T.StructType([*rows.schema.fields, T.StructField("p", T.DoubleType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[label].notna()
        x, y = pdf[features].to_numpy(float), pdf[label].to_numpy(dtype=float, na_value=np.nan)
        pdf["p"] = np.nan
        if known.sum() >= LEAST_EXAMPLES and 0 < y[known].sum() < known.sum():
            mean, sd = x[known].mean(0), x[known].std(0) + 1e-9
            z = (x - mean) / sd
            w = logistic(z[known], y[known])
            score = z @ w[:-1] + w[-1]
            if auc(score[known & (y == 1)], score[known & (y == 0)]) >= LEAST_AUC:
                pdf["p"] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return pdf

    out = rows.groupBy(key).applyInPandas(fold, spec)
    return out.withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def tuning(deviations: DataFrame, key: str, pitch: str, cents: str, out_of_tune: float = 10.0) -> DataFrame:
    """(slope, centre, spread, off): a robust line through each key's median
    deviation over octaves, and the keys that stray from it."""
    ready(deviations.sparkSession)
    per_key = deviations.where(F.col(cents).isNotNull()).groupBy(key, pitch).agg(F.median(cents).alias("d"))
    kind = deviations.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        x, d = (pdf[pitch].to_numpy(float) - 69) / 12, pdf["d"].to_numpy(float)
        keep, slope, level = np.ones(len(x), bool), 0.0, float(np.median(d))
        for _ in range(3):
            if keep.sum() >= 3 and np.ptp(x[keep]) > 0:
                slope, level = (float(v) for v in np.polyfit(x[keep], d[keep], 1))
            off = np.abs(d - slope * x - level)
            now = off <= max(5.0, 3 * float(np.median(off)))
            if (now == keep).all():
                break
            keep = now
        off = d - slope * x - level
        return pd.DataFrame([(pdf[key].iloc[0], round(slope, 3), round(level, 3), round(float(np.median(np.abs(off))), 3), sorted(int(p) for p in pdf[pitch][np.abs(off) > out_of_tune]))], columns=[key, "slope", "centre", "spread", "off"])

    return per_key.groupBy(key).applyInPandas(fold, f"{key} {kind}, slope double, centre double, spread double, off array<int>")
