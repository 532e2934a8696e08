"""Hypergeometric null of a top-k overlap and asymptotic p-values, as Arrow UDFs over small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Terms further than this many standard deviations from the mode are below the smallest double.
_REACH = 40.0


def null_support(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Support points and probabilities of X ~ Hypergeometric(n, k, k) wherever they are representable.

    Probabilities come from term ratios around the mode, so no large log-gammas cancel, whatever ``n`` is.
    """
    lo, hi = max(0, 2 * k - n), k
    p = k / n
    sd = math.sqrt(max(n * p * p * (1 - p) * (1 - p), 0.0))
    mode = min(max(int((k + 1) * (k + 1) / (n + 2)), lo), hi)
    span = int(_REACH * sd) + 200
    xs = np.arange(max(lo, mode - span), min(hi, mode + span) + 1, dtype=np.float64)
    step = 2.0 * (np.log(k - xs[:-1])) - np.log(xs[1:]) - np.log(n - 2.0 * k + xs[1:])
    logs = np.concatenate(([0.0], np.cumsum(step)))
    pmf = np.exp(logs - logs.max())
    return xs, pmf / pmf.sum()


_NULL_TYPE = T.StructType([T.StructField("expected", T.DoubleType()), T.StructField("pvalue", T.DoubleType())])


@F.pandas_udf(_NULL_TYPE)
def _null(n: pd.Series, k: pd.Series, x: pd.Series) -> pd.DataFrame:
    seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    expected, tail = np.full(len(n), np.nan), np.full(len(n), np.nan)
    for i, (ni, ki, xi) in enumerate(zip(n, k, x)):
        if not (0 < ki <= ni):
            continue
        if (ni, ki) not in seen:
            seen = {(ni, ki): null_support(int(ni), int(ki))}
        xs, pmf = seen[ni, ki]
        expected[i] = float(np.sum(pmf * xs / (2.0 * ki - xs)))
        if xi <= ki:
            tail[i] = min(1.0, float(pmf[xs >= xi].sum()))
    return pd.DataFrame({"expected": expected, "pvalue": tail})


def with_null(curve: DataFrame, plugin: bool = False) -> DataFrame:
    """Add ``expected_jaccard`` and ``hypergeometric_pvalue`` to a table with ``n``, ``k`` and ``overlap``.

    ``plugin`` replaces the exact expectation by the Jaccard at the expected overlap k*k/n.
    """
    curve = curve.withColumn("_null", _null("n", "k", F.col("overlap").cast("bigint")))
    mean = F.col("k") * F.col("k") / F.col("n")
    expected = mean / (F.lit(2.0) * F.col("k") - mean) if plugin else F.col("_null.expected")
    return (
        curve.withColumn("expected_jaccard", expected)
        .withColumn("hypergeometric_pvalue", F.col("_null.pvalue"))
        .drop("_null")
    )


def adjusted(observed: Column, expected: Column) -> Column:
    """(J - E) / (1 - E); null where E is missing or 1."""
    return F.when(expected < 1.0, (observed - expected) / (F.lit(1.0) - expected))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v == v else float("nan")).astype("float64")


@F.pandas_udf(T.DoubleType())
def ks_tail(statistic: pd.Series, n_left: pd.Series, n_right: pd.Series) -> pd.Series:
    """Asymptotic two-sample Kolmogorov tail by its alternating series."""
    t = np.sqrt(n_left * n_right / (n_left + n_right)) * statistic
    j = np.arange(1, 101)
    tail = [min(1.0, max(0.0, float(2 * np.sum((-1.0) ** (j - 1) * np.exp(-2 * (j * v) ** 2))))) for v in t]
    return pd.Series(tail, dtype="float64").where(t.to_numpy() > 0.04, 1.0)


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student tail, by the trapezoid rule on the angle form of its density."""

    def tail(v: float, d: float) -> float:
        if not (v == v and d > 0):
            return float("nan")
        # P(|T| > v) is the share of cos(u)^(d-1) over u in (atan(v / sqrt d), pi / 2).
        cut = math.atan(abs(v) / math.sqrt(d))
        width = 12.0 / math.sqrt(max(d, 1.0))
        whole = np.linspace(0.0, min(math.pi / 2, width), 40001)
        part = np.linspace(cut, min(math.pi / 2, cut + width), 40001)

        def area(u: np.ndarray) -> float:
            y = np.exp((d - 1) * np.log(np.maximum(np.cos(u), 1e-300)))
            return float(np.sum((y[1:] + y[:-1]) * np.diff(u)) / 2)

        return min(1.0, area(part) / area(whole))

    return pd.Series([tail(a, b) for a, b in zip(t, dof)], dtype="float64")
