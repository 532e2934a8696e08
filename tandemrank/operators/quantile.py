"""Exact quantiles (linear interpolation) of row-scale columns, read off distributed positions.

Spark's ``percentile`` keeps every distinct value of a group in one task, so it is used in this library only on
frames whose size is fixed by parameters (replicates, cutoffs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemrank.operators.rank import positions
from tandemrank.session import bounded, materialize


def quantile_at(p: float, value: Column, pos: str = "pos", n: str = "n") -> Column:
    """Aggregate expression for the ``p`` quantile over rows that carry an ascending position and a size."""
    h = (F.col(n) - 1) * F.lit(float(p))
    at = F.col(pos) - 1
    lo = F.max(F.when(at == F.floor(h), value))
    hi = F.max(F.when(at == F.ceil(h), value))
    frac = F.max(h - F.floor(h))
    return lo + (hi - lo) * frac


def ascending(df: DataFrame, by: list[str], value: str, id: str) -> DataFrame:
    return positions(df, by, [F.col(value).asc(), F.col(id).asc()])


def summarize(
    df: DataFrame, by: list[str], value: str, id: str, probs: dict[str, float], extra: dict[str, Column] | None = None
) -> DataFrame:
    """One row per key: the named quantiles of ``value`` plus any further aggregates, in one sort and one pass."""
    rows = ascending(df, by, value, id)
    aggs = [quantile_at(p, F.col(value)).alias(name) for name, p in probs.items()]
    aggs += [c.alias(name) for name, c in (extra or {}).items()]
    return rows.groupBy(*by).agg(*aggs)


def quantiles(df: DataFrame, by: list[str], value: str, id: str, probs: dict[str, float]) -> DataFrame:
    """Named quantiles only: just the rows at the wanted positions are aggregated."""
    rows = ascending(df, by, value, id)
    at = F.col("pos") - 1
    h = [(F.col("n") - 1) * F.lit(float(p)) for p in probs.values()]
    wanted = F.lit(False)
    for x in h:
        wanted = wanted | (at == F.floor(x)) | (at == F.ceil(x))
    return rows.filter(wanted).groupBy(*by).agg(
        *[quantile_at(p, F.col(value)).alias(name) for name, p in probs.items()]
    )


def nested_medians(
    df: DataFrame, by: list[str], value: str, id: str, level: str, levels: list[int], out: str
) -> DataFrame:
    """Median of ``value`` over the rows with ``level <= L``, for every ``L`` in ``levels``, per key.

    The sets are nested, so the rows are sorted once and cut into blocks of neighbouring values; block counts by
    level say which block holds each median, and only those blocks are looked at again.
    """
    rows = ascending(df.filter(F.col(level) <= max(levels)), by, value, id)
    width = F.greatest(F.lit(1024), F.ceil(F.sqrt("n"))).cast("bigint")
    rows = materialize(rows.select(*by, value, level, "pos", F.floor((F.col("pos") - 1) / width).alias("_blk")))
    counts = rows.groupBy(*by, "_blk", level).count()
    # counts: at most blocks x levels rows per key
    grid = counts.withColumn("_L", F.explode(F.array(*[F.lit(x) for x in levels]))).filter(F.col(level) <= F.col("_L"))
    grid = grid.groupBy(*by, "_L", "_blk").agg(F.sum("count").alias("_c"))
    seq = Window.partitionBy(*by, "_L").orderBy("_blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = grid.withColumn("_end", F.sum("_c").over(seq)).withColumn(
        "_size", F.sum("_c").over(Window.partitionBy(*by, "_L"))
    )
    lo, hi = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    holds = ((lo >= F.col("_end") - F.col("_c")) & (lo < F.col("_end"))) | (
        (hi >= F.col("_end") - F.col("_c")) & (hi < F.col("_end"))
    )
    target = grid.filter(holds).select(*by, "_L", "_blk", "_size", (F.col("_end") - F.col("_c")).alias("_before"))
    near = rows.join(bounded(target), [*by, "_blk"]).filter(F.col(level) <= F.col("_L"))
    inside = Window.partitionBy(*by, "_L", "_blk").orderBy("pos")
    near = near.withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1)
    picked = near.filter((F.col("_at") == lo) | (F.col("_at") == hi))
    return picked.groupBy(*by, F.col("_L").alias(level)).agg(F.avg(value).alias(out))
