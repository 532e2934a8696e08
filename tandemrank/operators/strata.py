"""Covariate bins and the unpivot of strata into (covariate, level) keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.operators.quantile import quantiles
from tandemrank.operators.rank import positions
from tandemrank.session import bounded


def cut_by_quantiles(
    df: DataFrame, by: list[str], value: str, id: str, probs: list[float], labels: list[str], out: str
) -> DataFrame:
    """Label ``value`` by the exact quantiles ``probs`` of its key; bins are closed above, missing stays missing."""
    known = df.filter(f"`{value}` IS NOT NULL AND NOT isnan(`{value}`)")
    names = {f"_cut{i}": p for i, p in enumerate(probs)}
    cuts = bounded(quantiles(known, by, value, id, names))
    arms = " ".join(f"WHEN `{value}` <= _cut{i} THEN '{labels[i]}'" for i in range(len(probs)))
    label = f"CASE WHEN `{value}` IS NULL OR isnan(`{value}`) THEN NULL {arms} ELSE '{labels[-1]}' END"
    return df.join(cuts, by, "left").withColumn(out, F.expr(label)).drop(*names)


def rank_bins(df: DataFrame, by: list[str], value: str, id: str, bins: int, out: str) -> DataFrame:
    """Equal-frequency bins 1..bins by position, so ties at an edge still go to one bin each."""
    ranked = positions(df, by, [F.col(value).asc(), F.col(id).asc()], "_pos", "_size")
    return ranked.withColumn(out, F.expr(f"CAST(ceil(_pos * {float(bins)}D / _size) AS BIGINT)")).drop("_pos", "_size")


def quantile_bins(pairs: DataFrame, by: list[str], distance: str = "dist", id: str = "id") -> DataFrame:
    """Quartile of the mean response, tercile of the distance (smallest is tight) and distance quintile."""
    rows = pairs.withColumn("_mean", F.expr("(`left` + `right`) / 2"))
    rows = cut_by_quantiles(
        rows, by, "_mean", id, [0.25, 0.5, 0.75], ["Q1", "Q2", "Q3", "Q4"], "response_quartile"
    )
    rows = cut_by_quantiles(
        rows, by, distance, id, [1 / 3.0, 2 / 3.0], ["tight", "medium", "loose"], "distance_tercile"
    )
    return rank_bins(rows, by, distance, id, 5, "distance_quintile").drop("_mean")


def unpivot_strata(df: DataFrame, covariates: list[str]) -> DataFrame:
    """One row per (row, covariate) with its ``level``; missing levels drop out."""
    items = ", ".join(f"named_struct('covariate', '{c}', 'level', CAST(`{c}` AS STRING))" for c in covariates)
    keep = [f"`{c}`" for c in df.columns if c not in covariates]
    return df.selectExpr(*keep, f"inline(array({items}))").filter("level IS NOT NULL")
