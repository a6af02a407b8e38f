"""The best division of values into groups, from a histogram of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _best(v: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """First places of the k groups of ascending values v, n times each, with the least sum of squares about their means (of equal
    ones, early cuts). Where a group's best start is not before that of a shorter prefix, so halves are searched in turn."""
    v = v - np.average(v, weights=n)
    w, s, q = (np.concatenate([[0.0], np.cumsum(a)]) for a in (n, n * v, n * v * v))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i])

    m = len(v)
    best = np.array([np.inf, *(cost(np.array([0]), j)[0] for j in range(1, m + 1))])
    starts = []
    for g in range(1, k):
        new, start = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        todo = [(g + 1, m, g, m - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            sums = best[i] + cost(i, j)
            at = int(sums.argmin())
            new[j], start[j] = sums[at], i[at]
            todo += [(lo, j - 1, first, i[at]), (j + 1, hi, i[at], last)]
        best = new
        starts.append(start)
    cuts, j = [], m
    for start in reversed(starts):
        j = start[j]
        cuts.append(j)
    return np.array([0, *reversed(cuts)], int)


def value_groups(pixels: DataFrame, k: int, step: float = 0.01, by: tuple[str, ...] = (), value: str = "z") -> DataFrame:
    """by, grp (0, 1, ... in ascending order), low, high, centre, n: the best division of value, rounded to steps, into k groups, by the
    sum of squares about their means; no seed, the same on every run.

    Only histograms are gathered, one of a key a task: at most as many rows as steps between the least and the largest value. Fewer
    values than groups are a group each. Null, NaN and infinite values are left out.
    """
    if k < 1 or step <= 0:
        raise ValueError(f"{k} groups of values in steps of {step}")
    z = F.col(value).cast("double")
    bins = pixels.where(z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))).groupBy(*by, F.bround(z / step).cast("long").alias("bin")).agg(F.count("*").alias("n"))

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        b, n = pdf.sort_values("bin")[["bin", "n"]].to_numpy(float).T
        first = _best(b, n, min(k, len(b)))
        last = np.append(first[1:], len(b)) - 1
        total, moment = np.add.reduceat(n, first), np.add.reduceat(n * b, first)
        out = pd.DataFrame({"grp": np.arange(len(first)), "low": b[first] * step, "high": b[last] * step, "centre": moment / total * step, "n": total.astype(np.int64)})
        for i, c in enumerate(by):
            out.insert(i, c, [pdf[c].iloc[0]] * len(out))
        return out

    keys = "".join(f"`{c}` {pixels.schema[c].dataType.simpleString()}, " for c in by)
    return bins.groupBy(*by).applyInPandas(divide, f"{keys}grp int, low double, high double, centre double, n long")
