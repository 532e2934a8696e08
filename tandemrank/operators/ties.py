"""Cutoff gaps, tie blocks and the exact range of overlaps that tie-breaking can produce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemrank.frame import cutoff_size
from tandemrank.functions.null_model import adjusted, with_null
from tandemrank.operators.overlap import jaccard, overlap_counts
from tandemrank.session import bounded


def _side_cutoffs(ranked: DataFrame, by: list[str], qs: Sequence[float], side: str) -> DataFrame:
    """Per key and cutoff: the score at position k, the next one, and the tie run around the cutoff."""
    name = "left" if side == "l" else "right"
    grid = ", ".join(f"{float(q)}D" for q in sorted(qs))
    edges = ranked.groupBy(*by).agg(F.max("n").alias("n")).selectExpr(*by, "n", f"explode(array({grid})) AS q")
    edges = edges.withColumn("k", cutoff_size(F.col("q"), F.col("n")))
    # Two wanted positions per cutoff: at it and right below it.
    edges = bounded(edges.selectExpr(*by, "q", "k", "explode(array(k, k + 1)) AS _pos"))
    rows = ranked.select(
        *by, "n", F.col(f"{side}_pos").alias("_pos"), F.col(name).alias("_s"), F.col(f"{side}_first").alias("_first"),
        F.col(f"{side}_last").alias("_last"),
    ).join(edges, [*by, "_pos"])
    at, nxt = F.col("_pos") == F.col("k"), F.col("_pos") == F.col("k") + 1
    out = rows.groupBy(*by, "q", "k", "n").agg(
        F.max(F.when(at, F.col("_s"))).alias("cut"),
        F.max(F.when(nxt, F.col("_s"))).alias("next"),
        F.max(F.when(at, F.col("_first"))).alias("first"),
        F.max(F.when(at, F.col("_last"))).alias("last"),
    )
    gap = F.col("cut") - F.col("next")
    return out.select(
        *by, "q", "k", "n",
        F.col("cut").alias(f"{name}_cutoff_score"),
        F.col("next").alias(f"{name}_next_score"),
        gap.alias(f"{name}_absolute_gap"),
        (gap / F.greatest(F.abs("cut"), F.lit(2.220446049250313e-16))).alias(f"{name}_relative_gap"),
        (F.col("last") - F.col("first") + 1).alias(f"{name}_tie_block_size"),
        (F.col("first") - 1).alias(f"{name}_mandatory_count"),
        (F.col("k") - F.col("first") + 1).alias(f"{name}_optional_needed"),
        (F.col("last") > F.col("k")).alias(f"{name}_tie_ambiguous"),
        F.col("first").alias(f"_{name}_first"),
        F.col("last").alias(f"_{name}_last"),
    )


def overlap_bounds(nl: Column, nr: Column, mm: Column, om: Column, mo: Column, oo: Column, ox: Column,
                   xo: Column) -> tuple[Column, Column]:
    """Least and most common elements over all ways to break the cutoff ties of both sides.

    ``nl`` and ``nr`` rows are still to be taken from the tied rows of each side. Cell ``ab`` counts pairs that are
    ``a`` on the left and ``b`` on the right: m certain, o tied at the cutoff, x out.
    """
    zero = F.lit(0).cast("bigint")
    tl, tr = F.greatest(zero, nl - ox), F.greatest(zero, nr - xo)
    ul, ur = F.least(oo, tl), F.least(oo, tr)
    low = mm + (tl - ul) + (tr - ur) + F.greatest(zero, ul + ur - oo)
    al, ar = F.least(nl, om), F.least(nr, mo)
    high = mm + al + ar + F.least(nl - al, nr - ar, oo)
    return low, high


def cutoff_diagnostics(ranked: DataFrame, by: list[str], qs: Sequence[float]) -> DataFrame:
    """Per key and cutoff: gaps, tie blocks, observed overlap and its exact tie bounds, with adjusted Jaccards.

    ``ranked`` must carry tie runs. The nine cells per cutoff are counted in one pass over the rows that are in or
    tied at the cutoff of at least one side.
    """
    left = _side_cutoffs(ranked, by, qs, "l")
    right = _side_cutoffs(ranked, by, qs, "r").drop("k", "n")
    cuts = left.join(right, [*by, "q"])
    # A pair goes out -> tied -> certain as the cutoff grows, so four cutoff indices describe it at every cutoff.
    edges = bounded(
        cuts.groupBy(*by).agg(
            F.sort_array(F.collect_list("_left_first")).alias("_lf"),
            F.sort_array(F.collect_list("_right_first")).alias("_rf"),
        )
    )

    def reached(edge: str, pos: str, strict: bool) -> Column:
        return F.size(F.filter(edge, lambda e: e < F.col(pos) if strict else e <= F.col(pos)))

    states = (
        ranked.select(*by, "l_first", "r_first").join(edges, by)
        .select(
            *by, reached("_lf", "l_first", True).alias("lo"), reached("_lf", "l_first", False).alias("lm"),
            reached("_rf", "r_first", True).alias("ro"), reached("_rf", "r_first", False).alias("rm"),
        )
        .groupBy(*by, "lo", "lm", "ro", "rm").count()
    )
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(sorted(qs))])
    rows = states.withColumn("_p", F.explode(grid))
    i = F.col("_p.i")
    m_l, x_l, m_r, x_r = i >= F.col("lm"), i < F.col("lo"), i >= F.col("rm"), i < F.col("ro")
    o_l, o_r = ~m_l & ~x_l, ~m_r & ~x_r
    cell = {
        "mm": m_l & m_r, "om": o_l & m_r, "mo": m_l & o_r, "oo": o_l & o_r, "ox": o_l & x_r, "xo": x_l & o_r,
    }
    cells = rows.groupBy(*by, F.col("_p.q").alias("q")).agg(
        *[F.sum(F.when(on, F.col("count")).otherwise(0)).alias(name) for name, on in cell.items()]
    )
    c = F.col
    low, high = overlap_bounds(
        c("left_optional_needed"), c("right_optional_needed"), c("mm"), c("om"), c("mo"), c("oo"), c("ox"), c("xo")
    )
    counts = overlap_counts(ranked, by, qs).select(*by, "q", "overlap")
    out = cuts.join(cells, [*by, "q"]).join(counts, [*by, "q"])
    out = with_null(out.withColumn("min_overlap", low).withColumn("max_overlap", high))
    out = out.withColumn("tie_ambiguous", c("left_tie_ambiguous") | c("right_tie_ambiguous"))
    for name in ("min", "max"):
        j = jaccard(c(f"{name}_overlap"))
        out = out.withColumn(f"{name}_jaccard", j)
        out = out.withColumn(f"{name}_adjusted_jaccard", adjusted(j, c("expected_jaccard")))
    out = out.withColumn("observed_jaccard", jaccard())
    out = out.withColumn("adjusted_jaccard", adjusted(c("observed_jaccard"), c("expected_jaccard")))
    return out.drop(
        "mm", "om", "mo", "oo", "ox", "xo", "_left_first", "_left_last", "_right_first", "_right_last"
    )
