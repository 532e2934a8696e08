"""Cross-cutoff retention, boundary risk and step-up false-discovery adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemrank.frame import cutoff_size
from tandemrank.operators.overlap import first_cutoff

# Levels, bin edges and bin labels of the report.
LEVELS = (1.0, 5.0, 10.0, 20.0, 50.0)
# Bin edges in percentile points from the cutoff; bins are open below and closed above.
BOUNDARY_EDGES = (-20.0, -10.0, -5.0, -2.0, 0.0, 2.0, 5.0, 10.0, 20.0)
BOUNDARY_LABELS = (
    "(-inf,-20]", "(-20,-10]", "(-10,-5]", "(-5,-2]", "(-2,0]", "(0,2]", "(2,5]", "(5,10]", "(10,20]", "(20,inf)",
)


def retention_map(ranked: DataFrame, by: list[str], levels: Sequence[float] = LEVELS) -> DataFrame:
    """Share of one side's top-q set found in the other side's top-q' set, for every (q, q'), both directions.

    A two-dimensional histogram of first cutoffs is expanded into its dominated cells; no set is built.
    """
    qs = sorted(levels)
    hist = ranked.select(
        *by, "n", first_cutoff("l_pos", qs).alias("_l"), first_cutoff("r_pos", qs).alias("_r")
    ).groupBy(*by, "n", "_l", "_r").agg(F.expr("count(*) AS _c"))
    cells = ", ".join(
        f"named_struct('i', {i}, 'j', {j}, 'qs', {a}D, 'qt', {b}D)"
        for i, a in enumerate(qs) for j, b in enumerate(qs)
    )
    out = hist.selectExpr(*by, "n", "_l", "_r", "_c", f"inline(array({cells}))").groupBy(*by, "n", "qs", "qt").agg(
        F.expr("sum(IF(_l <= i AND _r <= j, _c, 0L)) AS lr"), F.expr("sum(IF(_r <= i AND _l <= j, _c, 0L)) AS rl")
    )
    out = out.withColumn("source_k", cutoff_size(F.col("qs"), F.col("n"))).withColumn(
        "target_k", cutoff_size(F.col("qt"), F.col("n"))
    )
    return out.selectExpr(
        *by,
        "inline(array(named_struct('direction', 'left_to_right', 'overlap', lr), "
        "named_struct('direction', 'right_to_left', 'overlap', rl)))",
        "qs AS q_source", "qt AS q_target", "source_k", "target_k",
    ).selectExpr("*", "overlap / CAST(source_k AS DOUBLE) AS retention")


def boundary_risk(ranked: DataFrame, by: list[str], qs: Sequence[float] = (5.0, 10.0, 20.0)) -> DataFrame:
    """Disagreement about membership by signed percentile distance from the cutoff, with each bin's bounds; empty bins are kept."""
    arms = " ".join(f"WHEN d <= {e}D THEN {i}" for i, e in enumerate(BOUNDARY_EDGES))
    grid = ", ".join(f"{float(q)}D" for q in qs)
    rows = ranked.selectExpr(*by, "n", "l_pos", "r_pos", f"explode(array({grid})) AS q").selectExpr(
        *by, "q", "100.0D * l_pos / n - q AS d", "greatest(1L, floor(q / 100.0D * n)) AS k", "l_pos", "r_pos"
    )
    hist = rows.selectExpr(
        *by, "q", f"CASE {arms} ELSE {len(BOUNDARY_EDGES)} END AS bin", "(l_pos <= k) != (r_pos <= k) AS differs"
    ).groupBy(*by, "q", "bin").agg(F.expr("count(*) AS n"), F.expr("count_if(differs) AS disagreements"))
    edges = ["NULL", *[f"{float(e)}D" for e in BOUNDARY_EDGES], "NULL"]  # the outer bins have one bound
    labels = ", ".join(
        f"named_struct('bin', {i}, 'distance_bin', '{s}', 'bin_low', CAST({edges[i]} AS DOUBLE), 'bin_high', CAST({edges[i + 1]} AS DOUBLE))"
        for i, s in enumerate(BOUNDARY_LABELS)
    )
    frame = hist.select(*by, "q").distinct().selectExpr(*by, "q", f"inline(array({labels}))")
    return frame.join(hist, [*by, "q", "bin"], "left").selectExpr(
        *by, "q", "distance_bin", "bin_low", "bin_high", "coalesce(n, 0L) AS n", "coalesce(disagreements, 0L) AS disagreements",
        "disagreements / CAST(n AS DOUBLE) AS disagreement_rate",
    )


def consensus_counts(ranked: DataFrame, by: list[str], qs: Sequence[float] = (5.0, 10.0, 20.0)) -> DataFrame:
    """Both, left-only, right-only, neither and crossings of the top-q sets."""
    from tandemrank.operators.overlap import overlap_counts

    return overlap_counts(ranked, by, qs).selectExpr(
        *by, "q", "k", "overlap AS both", "k - overlap AS left_only", "k - overlap AS right_only",
        "n - 2 * k + overlap AS neither", "2 * (k - overlap) AS crossings",
    )


def step_up_fdr(tests: DataFrame, by: list[str], p: str = "pvalue", out: str = "qvalue", compat: bool = False):
    """Benjamini-Hochberg adjusted p-values inside ``by`` (result tables: one row per test).

    ``compat`` gives every test of a key the single smallest p * n / rank, as the older procedure did.
    """
    key = Window.partitionBy(*by)
    order = key.orderBy(F.col(p).asc())
    rows = tests.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(p).over(key))
    rows = rows.withColumn("_x", F.col(p) * F.col("_n") / F.col("_r"))
    window = key if compat else key.orderBy(F.col("_r").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return rows.withColumn(out, F.least(F.lit(1.0), F.min("_x").over(window))).drop("_r", "_n", "_x")
