"""Distributed ranks: exact positions 1..n inside each key, however large or tied a key is.

One range shuffle on (key, order, id) spreads even a single key, or a single tied value, over all tasks. The
sorted rows are written once; a row's position is its index in its own task plus the row count of earlier tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemrank.frame import finite_pairs
from tandemrank.session import bounded, materialize


def _key(by: list[str]) -> str:
    return ", ".join(f"`{c}`" for c in by) or "1"


def positions(
    df: DataFrame, by: list[str], order: list[Column], out: str = "pos", count: str | None = "n"
) -> DataFrame:
    """Add ``out``, the 1-based position under ``order`` inside ``by``, and ``count``, the size of the key.

    ``order`` must end in a unique column, or equal rows get an arbitrary order.
    """
    sort = [*[F.col(c).asc() for c in by], *order]
    rows = materialize(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .selectExpr("*", "monotonically_increasing_id() AS _serial")
    ).selectExpr("*", "shiftrightunsigned(_serial, 33) AS _part")
    key = _key(by)
    # One row per task and key: at most (tasks + keys) rows, since tasks hold ranges.
    parts = rows.groupBy(*by, "_part").agg(F.expr("min(_serial) AS _serial0"), F.expr("count(*) AS _c")).selectExpr(
        *[f"`{c}`" for c in by], "_part",
        f"sum(_c) OVER (PARTITION BY {key} ORDER BY _part) - _c - _serial0 + 1 AS _delta",
        f"sum(_c) OVER (PARTITION BY {key}) AS `{count or '_n'}`",
    )
    ranked = rows.join(bounded(parts), [*by, "_part"])
    return ranked.selectExpr("*", f"_serial + _delta AS `{out}`").drop("_serial", "_part", "_delta", "_n")


def tie_ranks(
    df: DataFrame, by: list[str], value: str, id: str, prefix: str, count: str = "n"
) -> DataFrame:
    """Descending ranks of ``value`` inside ``by``: ``{prefix}_pos`` (ties by ``id``), ``_first`` and ``_last``
    (the positions where the row's tie run starts and ends) and the size of the key.

    The average rank of a row is ``(first + last) / 2``.
    """
    sort = [*[F.col(c).asc() for c in by], F.col(value).desc(), F.col(id).asc()]
    key, v = _key(by), f"`{value}`"
    local = f"PARTITION BY {_key([*by, '_part'])} ORDER BY {v} DESC"
    rows = materialize(
        df.repartitionByRange(*sort).selectExpr("*", "spark_partition_id() AS _part").selectExpr(
            "*",
            f"CAST(row_number() OVER ({local}, `{id}`) AS BIGINT) AS _i",
            f"CAST(rank() OVER ({local}) AS BIGINT) AS _a",
            f"count(*) OVER ({local} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _b",
        )
    )
    parts = rows.groupBy(*by, "_part").agg(
        F.expr("count(*) AS _c"), F.expr(f"max({v}) AS _top"), F.expr(f"min({v}) AS _low"),
        F.expr("min(_b) AS _top_end"), F.expr("max(_a) AS _low_start"),
    )
    seq = f"PARTITION BY {key} ORDER BY _part"
    after = f"{seq} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    upto = f"{seq} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    parts = parts.selectExpr(
        "*",
        f"sum(_c) OVER ({upto}) - _c AS _start", f"sum(_c) OVER (PARTITION BY {key}) AS `{count}`",
        f"lag(_low) OVER ({seq}) AS _prev_low", f"lead(_top) OVER ({seq}) AS _next_top",
    )
    # A run's start is known in the task with its first row, its end in the task with its last row; a task that
    # holds a single value may be in the middle of a longer run and takes over its neighbour's.
    parts = parts.selectExpr(
        "*",
        f"""last_value(IF(_low != _top OR _prev_low IS NULL OR _prev_low != _low, _start + _low_start, NULL)) IGNORE NULLS
            OVER ({upto}) AS _run_start""",
        f"""first_value(IF(_low != _top OR _next_top IS NULL OR _next_top != _top, _start + _top_end, NULL)) IGNORE NULLS
            OVER ({after}) AS _run_end""",
    ).selectExpr(
        *[f"`{c}`" for c in by], "_part", f"`{count}`", "_start", "_prev_low", "_next_top",
        f"lag(_run_start) OVER ({seq}) AS _from", f"lead(_run_end) OVER ({seq}) AS _to",
    )
    return rows.join(bounded(parts), [*by, "_part"]).selectExpr(
        *[f"`{c}`" for c in df.columns], f"`{count}`",
        f"_start + _i AS `{prefix}_pos`",
        f"IF({v} = _prev_low, _from, _start + _a) AS `{prefix}_first`",
        f"IF({v} = _next_top, _to, _start + _b) AS `{prefix}_last`",
    )


def rank_both(df: DataFrame, by: list[str], id: str = "id", ties: bool = False) -> DataFrame:
    """Finite pairs with ``l_pos``, ``r_pos`` and ``n``; with ``ties`` also the tie runs of both sides."""
    df = finite_pairs(df)
    if ties:
        return tie_ranks(tie_ranks(df, by, "left", id, "l"), by, "right", id, "r", count="_n").drop("_n")
    df = positions(df, by, [F.col("left").desc(), F.col(id).asc()], "l_pos")
    return positions(df, by, [F.col("right").desc(), F.col(id).asc()], "r_pos", count=None)


def average_rank(side: str) -> Column:
    """Descending average rank from the tie run of ``side`` ('l' or 'r')."""
    return (F.col(f"{side}_first") + F.col(f"{side}_last")) / F.lit(2.0)


def percentile_rank(side: str, kind: str) -> Column:
    """Four percentile definitions, kept apart.

    ``unit``: (ascending average rank - 1) / (n - 1); ``fraction``: ascending average rank / n;
    ``position``: 100 * descending position / n; ``descending``: descending average rank / n.
    """
    n = F.col("n")
    if kind == "unit":
        return (n - average_rank(side)) / F.nullif(n - F.lit(1.0), F.lit(0.0))
    if kind == "fraction":
        return (n + F.lit(1.0) - average_rank(side)) / n
    if kind == "position":
        return F.lit(100.0) * F.col(f"{side}_pos") / n
    if kind == "descending":
        return average_rank(side) / n
    raise ValueError(f"unknown percentile kind {kind!r}")


def rank_shift() -> Column:
    """Absolute difference of the two average ranks."""
    return F.abs(average_rank("l") - average_rank("r"))
