"""The pair frame: one row per paired entity with ``id``, ``left``, ``right`` and any keys or strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, **columns: type[T.DataType] | None) -> None:
    """Fail at once if a column is missing or is not of the stated type."""
    for name, kind in columns.items():
        if name not in df.columns:
            raise ValueError(f"column {name!r} is missing; have {df.columns}")
        if kind is not None and not isinstance(df.schema[name].dataType, kind):
            raise TypeError(f"column {name!r} is {df.schema[name].dataType.simpleString()}, want {kind.typeName()}")


def is_finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_pairs(df: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Keep the pairs whose two scores are both finite; null, NaN and infinities are all missing."""
    require(df, **{left: None, right: None})
    return df.filter(is_finite(F.col(left)) & is_finite(F.col(right)))


def long_panels(df: DataFrame, panels: list[str]) -> DataFrame:
    """Wide boolean memberships to one row per (row, panel it belongs to)."""
    member = F.array_compact(F.array(*[F.when(F.col(p), F.lit(p)) for p in panels]))
    return df.withColumn("panel", F.explode(member)).drop(*panels)


def long_metrics(df: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide score columns ``{metric: (left column, right column)}`` to one row per (row, metric)."""
    entry = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(a).cast("double").alias("left"), F.col(b).cast("double").alias("right")
            )
            for m, (a, b) in metrics.items()
        ]
    )
    used = {c for pair in metrics.values() for c in pair}
    keep = [c for c in df.columns if c not in used]
    return df.select(*keep, F.explode(entry).alias("_e")).select(*keep, "_e.metric", "_e.left", "_e.right")


def cutoff_size(q_percent: Column, n: Column) -> Column:
    """k = max(1, floor(q / 100 * n)), with the operations in that order."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(q_percent / F.lit(100.0) * n).cast("bigint"))
