"""Spearman and Pearson coefficients, tail forms on the union of the top sets, and rank-shift summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.frame import cutoff_size
from tandemrank.functions.null_model import student_two_sided
from tandemrank.operators.quantile import summarize
from tandemrank.operators.rank import average_rank, rank_both, rank_shift
from tandemrank.operators.tau import TASK_ROWS, kendall_tau


def _corr(x, y, out: str):
    c = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    # Moments merged from several tasks leave a rest above zero on a constant side: its range says that it is one.
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies & ~F.isnan(c), c).alias(out)


def spearman(ranked: DataFrame, by: list[str], out: str = "rho") -> DataFrame:
    """Pearson correlation of average ranks; null where a side is constant. ``ranked`` must carry tie runs."""
    return ranked.groupBy(*by).agg(
        F.max("n").alias("n"), _corr(average_rank("l").cast("double"), average_rank("r").cast("double"), out)
    )


def spearman_test(ranked: DataFrame, by: list[str]) -> DataFrame:
    rho = spearman(ranked, by)
    r, dof = F.col("rho"), (F.col("n") - 2).cast("double")
    t = r * F.sqrt(dof / F.greatest((1 - r) * (1 + r), F.lit(1e-300)))
    p = student_two_sided(F.when(dof > 0, t), F.when(dof > 0, dof))
    return rho.withColumn("pvalue", p)


def pearson(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), _corr("left", "right", "r"))


def tail_pairs(ranked: DataFrame, qs: Sequence[float]) -> DataFrame:
    """One row per (pair, q) with the pair in the union of the two top-q sets."""
    grid = F.array(*[F.lit(float(q)) for q in qs])
    near = F.filter(grid, lambda q: F.least("l_pos", "r_pos") <= cutoff_size(q, F.col("n")))
    return ranked.withColumn("q", F.explode(near))


def tail_agreement(
    ranked: DataFrame, by: list[str], qs: Sequence[float], id: str = "id", size: int = TASK_ROWS
) -> DataFrame:
    """Kendall tau and Spearman rho on the union of the top-q sets, re-ranked inside it."""
    tail = tail_pairs(ranked, qs).select(*by, "q", id, "left", "right")
    key = [*by, "q"]
    rho = spearman(rank_both(tail, key, id, ties=True), key, "tail_rho").withColumnRenamed("n", "n_union")
    return rho.join(kendall_tau(tail, key, id, size=size, out="tail_tau").drop("n"), key)


def shift_summary(ranked: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """Mean, median and normalised mean of the absolute average-rank displacement."""
    rows = ranked.select(*by, id, F.col("n").alias("_size"), rank_shift().alias("shift"))
    out = summarize(
        rows, by, "shift", id, {"median_shift": 0.5},
        {"mean_shift": F.avg("shift"), "normalized_shift": F.avg("shift") / F.greatest(F.max("n") - 1, F.lit(1))},
    )
    return out


def covariate_agreement(
    ranked: DataFrame, by: list[str], covariate: str, value, id: str = "id", size: int = TASK_ROWS
) -> DataFrame:
    """tau and rho between a covariate and an expression on the ranked pair (say its rank shift)."""
    pairs = ranked.select(*by, id, F.col(covariate).cast("double").alias("left"), value.cast("double").alias("right"))
    return kendall_tau(pairs, by, id, size=size).join(
        spearman(rank_both(pairs, by, id, ties=True), by).drop("n"), by
    )


def ks_statistic(pairs: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between the two sides of each key.

    Both sides are stacked and ranked once; inside a value the position reached and the number of left rows up to
    it give both distribution functions, so one value costs one row.
    """
    from tandemrank.operators.distribution import cumulative_sides

    cum = cumulative_sides(pairs, by, id)
    gap = F.abs(F.col("cum_left") / F.col("n_left") - F.col("cum_right") / F.col("n_right"))
    return cum.groupBy(*by).agg(
        F.max("n_left").alias("n_left"), F.max("n_right").alias("n_right"), F.max(gap).alias("ks")
    )
