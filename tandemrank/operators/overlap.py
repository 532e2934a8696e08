"""Top-k overlap at many cutoffs from one pass over ranked pairs.

A pair is in both top-k sets iff ``greatest(l_pos, r_pos) <= k`` and in their union iff ``least(..) <= k``, so a
histogram over cutoffs and a running sum over the (few) cutoffs give every overlap; no set is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemrank.frame import cutoff_size
from tandemrank.functions.null_model import adjusted, with_null
from tandemrank.operators.quantile import nested_medians
from tandemrank.operators.rank import rank_shift

Q_GRID = [float(q) for q in range(1, 51)]
# Cutoff bands in percent: name, lowest, highest.
BANDS = [("elite", 1.0, 10.0), ("intermediate", 10.0, 30.0), ("broad", 30.0, 50.0)]


def first_cutoff(pos: str, qs: Sequence[float]) -> Column:
    """Index of the first cutoff whose top-k reaches the SQL expression ``pos``; ``len(qs)`` if none does."""
    pos, last = f"({pos})", len(qs)
    step = qs[1] - qs[0] if last > 1 else 1.0
    even = all(float(q).is_integer() and q == qs[0] + i * step for i, q in enumerate(qs))
    if not even:
        arms = " ".join(
            f"WHEN {pos} <= greatest(1L, floor({float(q)}D / 100.0D * n)) THEN {i}" for i, q in enumerate(qs)
        )
        return F.expr(f"CASE {arms} ELSE {last} END")

    # Even grid: invert k(q) and settle the float rounding against the neighbouring cutoffs.
    def reaches(i: str) -> str:
        return f"greatest(1L, floor(({float(qs[0])}D + {i} * {float(step)}D) / 100.0D * n)) >= {pos}"

    g = f"CAST(greatest(0D, least({last}D, ceil((100.0D * {pos} / n - {float(qs[0])}D) / {float(step)}D))) AS INT)"
    return F.expr(
        f"CASE WHEN {g} > 0 AND {reaches(f'({g} - 1)')} THEN {g} - 1 WHEN {g} < {last} AND {reaches(g)} THEN {g} "
        f"WHEN {g} + 1 < {last} AND {reaches(f'({g} + 1)')} THEN {g} + 1 ELSE {last} END"
    )


def _grid(keys: DataFrame, by: list[str], qs: Sequence[float]) -> DataFrame:
    points = ", ".join(f"named_struct('_i', {i}, 'q', {float(q)}D)" for i, q in enumerate(qs))
    return keys.selectExpr(*by, "n", f"inline(array({points}))").selectExpr(
        *by, "n", "_i", "q", "greatest(1L, floor(q / 100.0D * n)) AS k"
    )


def cutoff_steps(steps: DataFrame, keys: DataFrame, by: list[str], qs: Sequence[float]) -> DataFrame:
    """Running overlap over the cutoff grid of each key from counts that become common at cutoff ``_i``."""
    summed = "_s" in steps.columns
    rows = _grid(keys, by, qs).join(steps, [*by, "_i"], "left")
    run = f"OVER (PARTITION BY {', '.join(by)} ORDER BY _i ROWS UNBOUNDED PRECEDING)"
    return rows.selectExpr(
        *by, "q", "n", "k", f"CAST(sum(coalesce(_c, 0L)) {run} AS BIGINT) AS overlap",
        f"sum(coalesce(_s, 0.0D)) {run} AS _s" if summed else "0.0D AS _s",
    )


def overlap_counts(
    ranked: DataFrame, by: list[str], qs: Sequence[float], shift: Column | None = None
) -> DataFrame:
    """Per key and cutoff: ``k``, ``n``, ``overlap``; with ``shift`` also its mean over the union of the top sets."""
    qs = sorted(qs)
    value = shift.cast("double") if shift is not None else F.lit(0.0)
    hist = ranked.select(
        *by, "n", first_cutoff("greatest(l_pos, r_pos)", qs).alias("_both"),
        first_cutoff("least(l_pos, r_pos)", qs).alias("_either"), value.alias("_v"),
    )
    hist = hist.groupBy(*by, "n", "_both", "_either").agg(F.expr("count(*) AS _c"), F.expr("sum(_v) AS _s"))
    # From here on: at most cutoffs^2 rows per key, then one row per cutoff.
    events = hist.selectExpr(
        *by, "n",
        "inline(array(named_struct('_i', _both, '_c', _c, '_s', 0.0D), named_struct('_i', _either, '_c', 0L, '_s', _s)))",
    )
    steps = events.groupBy(*by, "_i").agg(F.expr("sum(_c) AS _c"), F.expr("sum(_s) AS _s"))
    out = cutoff_steps(steps, hist.select(*by, "n").distinct(), by, qs)
    if shift is not None:
        out = out.selectExpr("*", "_s / (2 * k - overlap) AS mean_rank_displacement_in_union")
    return out.drop("_s")


def jaccard(overlap: Column | None = None) -> Column:
    x = F.col("overlap") if overlap is None else overlap
    return x / (F.lit(2.0) * F.col("k") - x)


def adjust(counts: DataFrame, plugin: bool = False) -> DataFrame:
    """Add observed, expected and chance-adjusted Jaccard, upper-tail p and enrichment to overlap counts."""
    out = with_null(counts, plugin).withColumn("observed_jaccard", jaccard())
    out = out.withColumn("adjusted_jaccard", adjusted(F.col("observed_jaccard"), F.col("expected_jaccard")))
    return out.withColumn(
        "enrichment", F.when(F.col("expected_jaccard") > 0, F.col("observed_jaccard") / F.col("expected_jaccard"))
    )


def concordance_curve(
    ranked: DataFrame, by: list[str], qs: Sequence[float] = Q_GRID, displacement: bool = False, id: str = "id"
) -> DataFrame:
    """The screening-resolution curve without its band.

    ``ranked`` comes from ``rank_both``; with ``displacement`` it must carry tie runs.
    """
    if not displacement:
        return adjust(overlap_counts(ranked, by, qs))
    qs = sorted(qs)
    moved = ranked.withColumn("_shift", rank_shift())
    curve = adjust(overlap_counts(moved, by, qs, shift=F.col("_shift")))
    moved = moved.withColumn("_lvl", first_cutoff("least(l_pos, r_pos)", qs))
    medians = nested_medians(
        moved.select(*by, id, "_shift", "_lvl"), by, "_shift", id, "_lvl", list(range(len(qs))),
        "median_rank_displacement_in_union",
    )
    level = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_lvl") + 1)
    return curve.join(medians.withColumn("q", level).drop("_lvl"), [*by, "q"], "left")


def area(curve: DataFrame, by: list[str], lo: float | None = None, hi: float | None = None,
         y: str = "adjusted_jaccard") -> Column:
    """Aggregate expression over rows prepared by ``trapezoids``: normalised area, over a band if one is given."""
    step, mean = F.col("_q") - F.col("_q0"), (F.col(y) + F.col("_y0")) / F.lit(2.0)
    if lo is None:
        return F.sum(step * mean) / (F.max("_q") - F.min("_q"))
    inside = (F.col("_q0") >= lo) & (F.col("_q") <= hi)
    return F.sum(F.when(inside, step * mean)) / F.lit(hi - lo)


def trapezoids(curve: DataFrame, by: list[str], y: str = "adjusted_jaccard") -> DataFrame:
    """Pair every cutoff with the one before it (windows hold one row per cutoff)."""
    w = Window.partitionBy(*by).orderBy("q")
    return (
        curve.filter(F.col(y).isNotNull() & ~F.isnan(y))
        .withColumn("_q", F.col("q"))
        .withColumn("_q0", F.lag("q").over(w))
        .withColumn("_y0", F.lag(y).over(w))
    )


def area_summary(curve: DataFrame, by: list[str], y: str = "adjusted_jaccard", bands=BANDS) -> DataFrame:
    """Per key: ``naucc`` and one ``partial_<band>`` each, by the grid-points-inside-the-band rule."""
    return trapezoids(curve, by, y).groupBy(*by).agg(
        area(curve, by, y=y).alias("naucc"),
        *[area(curve, by, lo, hi, y).alias(f"partial_{name}") for name, lo, hi in bands],
    )


def interpolated_area(curve: DataFrame, by: list[str], lo: float, hi: float, out: str,
                      y: str = "adjusted_jaccard") -> DataFrame:
    """Area average over [lo, hi] with the curve interpolated at the band ends and held flat beyond the grid."""
    rows = trapezoids(curve, by, y)
    q0, q1, y0, y1 = F.col("_q0"), F.col("_q"), F.col("_y0"), F.col(y)
    a, b = F.greatest(q0, F.lit(lo)), F.least(q1, F.lit(hi))

    def at(x: Column) -> Column:
        return y0 + (y1 - y0) * (x - q0) / (q1 - q0)

    inner = F.sum(F.when(b > a, (b - a) * (at(a) + at(b)) / F.lit(2.0)))
    q_min, q_max = F.min(q1), F.max(q1)
    flat_low = F.greatest(F.lit(0.0), q_min - F.lit(lo)) * F.min_by(F.col(y), q1)
    flat_high = F.greatest(F.lit(0.0), F.lit(hi) - q_max) * F.max_by(F.col(y), q1)
    return rows.groupBy(*by).agg(
        F.when(
            (q_min <= hi) & (q_max >= lo) & (q_max > q_min),
            (F.coalesce(inner, F.lit(0.0)) + flat_low + flat_high) / F.lit(hi - lo),
        ).alias(out)
    )


def onset(curve: DataFrame, by: list[str], low: str, deltas: Sequence[float], run: int = 5) -> DataFrame:
    """Per key and delta: first cutoff of ``run`` consecutive ones with ``low > delta``, and the first crossing."""
    w = Window.partitionBy(*by, "delta").orderBy("q").rowsBetween(0, run - 1)
    rows = curve.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    rows = rows.withColumn("_up", F.coalesce(F.col(low) > F.col("delta"), F.lit(False)))
    rows = rows.withColumn(
        "_run", (F.min(F.col("_up").cast("int")).over(w) == 1) & (F.count("*").over(w) == run)
    )
    return rows.groupBy(*by, "delta").agg(
        F.min(F.when(F.col("_run"), F.col("q"))).alias("persistent_onset"),
        F.min(F.when(F.col("_up"), F.col("q"))).alias("first_crossing"),
    )


def top_sets(ranked: DataFrame, q: float) -> DataFrame:
    """Flags ``in_left`` and ``in_right`` of the two top-q sets, and ``k``."""
    return (
        ranked.withColumn("k", cutoff_size(F.lit(float(q)), F.col("n")))
        .withColumn("in_left", F.col("l_pos") <= F.col("k"))
        .withColumn("in_right", F.col("r_pos") <= F.col("k"))
    )


def set_counts() -> list[Column]:
    """Aggregates over ``top_sets`` rows: both, left only, right only, neither."""
    l, r = F.col("in_left"), F.col("in_right")
    return [
        F.count_if(l & r).alias("both"),
        F.count_if(l & ~r).alias("left_only"),
        F.count_if(~l & r).alias("right_only"),
        F.count_if(~l & ~r).alias("neither"),
    ]


def topk_measures(counts: DataFrame) -> DataFrame:
    """precision@k (which equals recall@k), overlap coefficient and plain Jaccard from overlap counts."""
    return counts.select(
        "*",
        (F.col("overlap") / F.col("k")).alias("precision_at_k"),
        (F.col("overlap") / F.col("k")).alias("overlap_coefficient"),
        jaccard().alias("jaccard"),
    )


def rank_biased_overlap(
    ranked: DataFrame, by: list[str], p: float = 0.95, agreement: str = "jaccard", size: int | None = None
) -> DataFrame:
    """Extrapolated rank-biased overlap.

    Every depth is summed whose weight can change a double: those beyond D with p**D < 1e-17 cannot, and D depends on ``p``
    alone. Overlaps run up in blocks of ``size`` depths, so ``p`` may be as near to 1 as the ranking is long; no task holds a
    whole ranking. ``agreement``: 'jaccard' (intersection / union) or 'overlap' (intersection / depth).
    """
    import math

    from tandemrank.operators.resample import cumulative
    from tandemrank.operators.tau import TASK_ROWS

    if not 0 < p < 1:
        raise ValueError(f"p must lie between 0 and 1, got {p}")
    size = size or TASK_ROWS
    depth = max(1, math.ceil(math.log(1e-17) / math.log(p)))
    # Left positions are all depths once; a pair is common from the larger of its two positions on.
    each = F.explode(F.array(*[F.struct(d.alias("d"), F.lit(c).cast("bigint").alias("_c")) for d, c in ((F.col("l_pos"), 0), (F.greatest("l_pos", "r_pos"), 1))]))
    rows = ranked.select(*by, "n", each.alias("_e")).select(*by, "n", "_e.d", "_e._c").filter(F.col("d") <= depth)
    rows = rows.groupBy(*by, "n", "d").agg(F.sum("_c").alias("_c"))
    largest = depth if depth <= size else min(depth, int(ranked.agg(F.max("n")).first()[0] or 0))
    rows = cumulative(rows, by, "d", "_c", "_x", largest, size)
    share = F.col("_x") / (F.lit(2.0) * F.col("d") - F.col("_x") if agreement == "jaccard" else F.col("d"))
    term = F.lit(1.0 - p) * F.pow(F.lit(p), F.col("d") - 1) * share
    tail = F.when(F.col("d") == F.col("n"), F.pow(F.lit(p), F.col("d")) * share).otherwise(F.lit(0.0))
    return rows.groupBy(*by).agg(F.sum(term + tail).alias("rbo"))
