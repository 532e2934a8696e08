"""Distribution comparisons of the two sides: cumulative counts and quantile mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemrank.operators.rank import positions
from tandemrank.session import bounded, materialize


def cumulative_sides(pairs: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """Per key and distinct value: how many left and right scores are at or below it.

    Values are first counted, so a repeated value is one row; the running sums are made per block of 4096
    neighbouring values plus the totals of earlier blocks.
    """
    sides = F.explode(
        F.array(
            F.struct(F.col("left").alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")),
            F.struct(F.col("right").alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r")),
        )
    )
    values = (
        pairs.select(*by, sides.alias("_s")).groupBy(*by, F.col("_s.v").alias("v"))
        .agg(F.sum("_s.l").alias("_l"), F.sum("_s.r").alias("_r"))
    )
    rows = positions(values, by, [F.col("v").asc()], "_pos", count=None)
    rows = materialize(rows.withColumn("_blk", F.floor((F.col("_pos") - 1) / 4096)))
    key = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = rows.groupBy(*by, "_blk").agg(F.sum("_l").alias("_bl"), F.sum("_r").alias("_br"))
    total = Window.partitionBy(*by)
    blocks = blocks.select(
        *by, "_blk",
        (F.sum("_bl").over(key) - F.col("_bl")).alias("_ol"), (F.sum("_br").over(key) - F.col("_br")).alias("_or"),
        F.sum("_bl").over(total).alias("n_left"), F.sum("_br").over(total).alias("n_right"),
    )
    inside = Window.partitionBy(*by, "_blk").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        rows.withColumn("_cl", F.sum("_l").over(inside)).withColumn("_cr", F.sum("_r").over(inside))
        .join(bounded(blocks), [*by, "_blk"])
        .select(
            *by, "v", (F.col("_ol") + F.col("_cl")).alias("cum_left"),
            (F.col("_or") + F.col("_cr")).alias("cum_right"), "n_left", "n_right",
        )
    )


def quantile_mapping_error(pairs: DataFrame, by: list[str], id: str = "id", points: int = 99) -> DataFrame:
    """Mean over an even grid of probabilities of |Q_left(p) - Q_right(p)|."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("l").alias("side"), F.col("left").alias("v")),
            F.struct(F.lit("r").alias("side"), F.col("right").alias("v")),
        )
    )
    rows = pairs.select(*by, id, sides.alias("_s")).select(*by, id, "_s.side", "_s.v")
    rows = positions(rows, [*by, "side"], [F.col("v").asc(), F.col(id).asc()])
    # A row serves the probabilities i / m whose floor or ceiling position it is; only the few i next to it can be.
    m = points + 1
    lo, hi = f"greatest(1L, floor((pos - 2) * {m}D / (n - 1)))", f"least({points}L, ceil(pos * {m}D / (n - 1)))"
    near = f"IF(n = 1, sequence(1L, {points}L), IF({lo} <= {hi}, sequence({lo}, {hi}), array()))"
    rows = rows.selectExpr("*", f"explode({near}) AS _i").selectExpr("*", f"_i / {m}D AS p").filter(
        "floor((n - 1) * p) = pos - 1 OR ceil((n - 1) * p) = pos - 1"
    )
    h = (F.col("n") - 1) * F.col("p")
    at = F.col("pos") - 1
    lo, hi = F.max(F.when(at == F.floor(h), F.col("v"))), F.max(F.when(at == F.ceil(h), F.col("v")))
    q = rows.groupBy(*by, "side", "p").agg((lo + (hi - lo) * F.max(h - F.floor(h))).alias("q"))
    side = q.groupBy(*by, "p").agg(
        F.max(F.when(F.col("side") == "l", F.col("q"))).alias("ql"),
        F.max(F.when(F.col("side") == "r", F.col("q"))).alias("qr"),
    )
    return side.groupBy(*by).agg(F.avg(F.abs(F.col("ql") - F.col("qr"))).alias("quantile_mapping_error"))


def tied_rows(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Rows that share their value with another row of the key, per side."""
    out = None
    for side in ("left", "right"):
        part = pairs.groupBy(*by, side).count().groupBy(*by).agg(
            F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias(f"tied_{side}")
        )
        out = part if out is None else out.join(part, by)
    return out
