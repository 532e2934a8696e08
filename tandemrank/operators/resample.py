"""Cluster and row bootstraps, permutations and bands on counter-based draws.

Slot j of replicate b draws unit ``h(seed | b | j) mod G``, with h the first 8 hex digits of md5. A draw depends on
nothing but its counters: it is the same on every retry, partitioning and engine. Draws become multiplicities, so a
replicate is a weight column on the ranked rows and nothing is re-sorted by score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.frame import finite_pairs
from tandemrank.functions.null_model import adjusted, with_null
from tandemrank.operators.overlap import (
    BANDS, Q_GRID, area_summary, concordance_curve, cutoff_steps, first_cutoff, interpolated_area, jaccard, onset,
)
from tandemrank.operators.rank import positions, rank_both
from tandemrank.operators.replicates import BLOCK, STEP, counter_hash, curve_counts, draw_weights, permuted_taus, step_offsets, tasks_for, weighted_taus
from tandemrank.operators.tau import TASK_ROWS, kendall_tau, with_blocks
from tandemrank.session import bounded, in_passes, materialize, spread_join


def cluster_draws(df: DataFrame, by: list[str], unit: str, reps: int | range, seed: int) -> DataFrame:
    """Bootstrap multiplicities: ``rep``, the unit column, ``w`` (times drawn, > 0) and ``_rows`` (rows of the unit).

    Units are numbered by their own order inside ``by``; each numbered unit is also one slot, so slots are spread
    like units are. ``reps`` is a count, or a range of replicate numbers: since draws depend on the number alone,
    a long bootstrap can be run in ranges that keep each shuffle small, and the results appended.
    """
    span = range(reps) if isinstance(reps, int) else reps
    units = df.filter(F.col(unit).isNotNull()).groupBy(*by, unit).agg(F.expr("count(*) AS _rows"))
    units = positions(units, by, [F.col(unit).asc()], "_idx", "_G")
    draw = f"pmod({counter_hash(str(seed), 'rep', '_idx - 1')}, _G) + 1"
    drawn = units.selectExpr(*by, "_idx", "_G", f"explode(sequence({span.start}, {span.stop - 1})) AS rep").selectExpr(
        *by, "rep", f"{draw} AS _idx"
    )
    counts = drawn.groupBy(*by, "rep", "_idx").agg(F.expr("count(*) AS w"))
    small = bounded(units.select(*by, "_idx", unit, "_rows"))
    return counts.join(small, [*by, "_idx"]).drop("_idx")


def cumulative(df: DataFrame, key: list[str], pos: str, w: str, out: str, largest: int, size: int = TASK_ROWS):
    """Inclusive running sum of ``w`` in ``pos`` order inside ``key``.

    ``pos`` are positions of the unweighted rows, so blocks of ``size`` positions are even; block totals give the
    offsets. With one block there is nothing to add.
    """
    keys = ", ".join(f"`{c}`" for c in key)
    if largest <= size:
        return df.selectExpr(
            "*", f"sum(`{w}`) OVER (PARTITION BY {keys} ORDER BY `{pos}` ROWS UNBOUNDED PRECEDING) AS `{out}`"
        )
    df = df.selectExpr("*", f"(`{pos}` - 1) div {size} AS _blk")
    before = df.groupBy(*key, "_blk").agg(F.expr(f"sum(`{w}`) AS _t")).selectExpr(
        *key, "_blk", f"sum(_t) OVER (PARTITION BY {keys} ORDER BY _blk ROWS UNBOUNDED PRECEDING) - _t AS _before"
    )
    inner = f"PARTITION BY {keys}, _blk ORDER BY `{pos}` ROWS UNBOUNDED PRECEDING"
    return (
        df.selectExpr("*", f"sum(`{w}`) OVER ({inner}) AS _in").join(bounded(before), [*key, "_blk"])
        .selectExpr("*", f"_in + _before AS `{out}`").drop("_blk", "_in", "_before")
    )


# Positions of a block whose copies are counted together, and rows of replicates that one task is to sort.
BLOCK_ROWS, WINDOW_ROWS = 1 << 15, 1 << 20
# Rows of all replicates that one pass sorts.
PASS_ROWS = 1 << 26


def _block_sums(ranked: DataFrame, draws: DataFrame, by: list[str], key: list[str], unit: str, own: list[str], where: str, side: str, size: int, ties: bool) -> DataFrame:
    """Per replicate and block of ``size`` positions of a side: ``n`` of the replicate, the copies before the block, before the run of ties
    that reaches into it (``_from``) and up to the end of the run that reaches out of it (``_to``)."""
    first, last = ("first", "last") if ties else ("pos", "pos")
    ends = [f"({side}_{first} - 1) div {size} AS _s", f"({side}_{last} - 1) div {size} AS _e"]
    grains = materialize(
        ranked.selectExpr(*dict.fromkeys([*by, f"`{unit}`", *own]), f"({side}_pos - 1) div {size} AS _b", *ends)
        .groupBy(*dict.fromkeys([*by, unit, *own]), "_b", "_s", "_e").agg(F.expr("count(*) AS _rows"))
    )
    sums = spread_join(grains, draws, [*by, unit], "_b").filter(where).groupBy(*key, "_b").agg(
        F.expr("sum(w * _rows) AS _t"), F.expr("sum(IF(_s < _b, w * _rows, 0L)) AS _lead"), F.expr("sum(IF(_e > _b, w * _rows, 0L)) AS _tail")
    )
    # Every block of a key has a row in every replicate, drawn or not.
    blocks = grains.groupBy(*by, "_b").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    cells = blocks.join(draws.select(*key).distinct(), by).join(sums, [*key, "_b"], "left").na.fill(0, ["_t", "_lead", "_tail"])
    of = f"PARTITION BY {', '.join(f'`{c}`' for c in key)}"
    cells = materialize(cells.selectExpr(
        "*", f"sum(_t) OVER ({of} ORDER BY _b ROWS UNBOUNDED PRECEDING) - _t AS _before", f"sum(_t) OVER ({of}) AS n"
    ))
    starts = cells.selectExpr(*key, "_b AS _s", "_before + _t - _tail AS _from")
    stops = cells.selectExpr(*key, "_b AS _e", "_before + _lead AS _to")
    return cells.join(starts, [*key, "_s"]).join(stops, [*key, "_e"]).select(*key, "_b", "n", "_before", "_from", "_to")


def weighted_ranks(
    ranked: DataFrame, draws: DataFrame, by: list[str], key: list[str], unit: str, own: Sequence[str] = (), where: str = "true", id: str = "id",
    size: int = BLOCK_ROWS, ties: bool = True,
) -> DataFrame:
    """The rows of every replicate, ranked as if each were there ``w`` times, from rows that were ranked once.

    ``ranked`` comes from ``rank_both`` and is keyed by ``by``; ``draws`` has ``key`` (``by`` and what tells replicates apart),
    ``unit`` and ``w``. Rows and draws meet if ``where`` holds, which may read the row's columns ``own``. Columns: ``key``, ``id``,
    ``w``, ``n`` (copies of the replicate) and per side ``{s}_before`` (copies ahead of the row's own) and ``{s}_ends`` (first plus last
    position of its run of ties, twice the average rank; only with ``ties``, which ``ranked`` must then have). A replicate's order is
    that of the rows, so no replicate is sorted by score. As many tasks as the rows of all replicates ask for share the blocks: left to
    the size of what is shuffled, a few would sort all, as rows of few units pack well.
    """
    keys = ", ".join(f"`{c}`" for c in key)
    kinds = ("pos", "first", "last") if ties else ("pos",)
    cols = [f"{s}_{c}" for s in "lr" for c in kinds]
    rows = ranked.select(*dict.fromkeys([*by, id, unit, *own]), *cols)
    each = draws.groupBy(*by).agg(F.countDistinct(*[c for c in key if c not in by]).alias("_n")).agg(F.max("_n")).first()[0] or 0
    tasks = max(1, -(-rows.count() * each // WINDOW_ROWS))
    # Rows of a block lie together before the draws multiply them.
    rows = spread_join(rows.withColumn("_b", F.expr(f"(l_pos - 1) div {size}")).repartition(tasks, *by, "_b"), draws, [*by, unit], id)
    rows = rows.filter(where).select(*key, id, "w", *cols, "_b")
    out = [*key, id, "w"]
    for s in "lr":
        if s == "r":
            rows = rows.withColumn("_b", F.expr(f"(r_pos - 1) div {size}")).repartition(tasks, *key, "_b")
        sums = bounded(_block_sums(ranked, draws, by, key, unit, list(own), where, s, size, ties))
        rest = [*([] if s == "r" else cols[len(kinds):]), *(["n"] if s == "r" else [])]
        first = f"{s}_first, " if ties else ""
        rows = rows.selectExpr(
            "*", f"sum(w) OVER (PARTITION BY {keys}, _b ORDER BY {first}{s}_pos ROWS UNBOUNDED PRECEDING) - w AS _in"
        )
        run = []
        if ties:
            rows = rows.selectExpr(
                "*", f"min(_in) OVER (PARTITION BY {keys}, _b, {s}_first) AS _run", f"sum(w) OVER (PARTITION BY {keys}, _b, {s}_first) AS _copies"
            )
            start = f"IF(({s}_first - 1) div {size} < _b, _from, _before + _run) + 1"
            stop = f"IF(({s}_last - 1) div {size} > _b, _to, _before + _run + _copies)"
            run = [f"{start} + {stop} AS {s}_ends"]
        rows = rows.join(sums, [*key, "_b"]).selectExpr(*out, *rest, f"_before + _in AS {s}_before", *run)
        out += [f"{s}_before", *([f"{s}_ends"] if ties else [])]
    return rows


def bootstrap_curves(
    ranked: DataFrame, by: list[str], unit: str, reps: int | range, seed: int, qs: Sequence[float] = Q_GRID,
    null: str = "fixed", id: str = "id", size: int = TASK_ROWS,
) -> DataFrame:
    """Adjusted-Jaccard curve of every replicate.

    A row drawn w times is w neighbours in both orders; of them ``clip(k - a, 0, w)`` are in both top-k sets, with
    ``a`` the larger of the row's two exclusive running weights. ``null='fixed'`` keeps k and E[J] of the full
    sample, ``'recomputed'`` takes them from each replicate's own size.
    """
    if null not in ("fixed", "recomputed"):
        raise ValueError(f"unknown null {null!r}")
    qs = sorted(qs)
    key = [*by, "rep"]
    span = range(reps) if isinstance(reps, int) else reps
    base = materialize(ranked.filter(F.col(unit).isNotNull()).select(*by, *dict.fromkeys([unit, id]), "l_pos", "r_pos", "n"))
    largest = base.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if len(span) > STEP and largest <= min(size, BLOCK):
        counts = curve_counts(base, draw_weights(base, by, unit, span, seed), by, unit, span, qs, null == "fixed")
    else:  # few replicates, or keys of any size in passes over some replicates each, which free what they wrote
        step = max(1, PASS_ROWS // max(1, base.count()))
        spans = [range(at, min(at + step, span.stop)) for at in range(span.start, span.stop, step)]
        counts = in_passes(base.sparkSession, spans, lambda part: _curve_counts(base, by, unit, part, seed, qs, null, id, size))
    out = _with_cached_null(counts).withColumn("observed_jaccard", jaccard())
    return out.withColumn(
        "adjusted_jaccard", adjusted(F.col("observed_jaccard"), F.col("expected_jaccard"))
    ).select(*key, "q", "k", "n", "overlap", "observed_jaccard", "expected_jaccard", "adjusted_jaccard")


def _curve_counts(
    base: DataFrame, by: list[str], unit: str, span: range, seed: int, qs: Sequence[float], null: str, id: str, size: int
) -> DataFrame:
    """``k``, ``n`` and ``overlap`` at every cutoff of the replicates of ``span``, of keys of any size."""
    key = [*by, "rep"]
    draws = materialize(cluster_draws(base, by, unit, span, seed))
    rows = weighted_ranks(base, draws.drop("_rows"), by, key, unit, id=id, size=min(size, BLOCK_ROWS), ties=False)
    sizes = draws.groupBy(*key).agg(F.expr("sum(w * _rows) AS _size"))
    if null == "fixed":
        sizes = sizes.join(bounded(base.groupBy(*by).agg(F.max("n").alias("_n"))), by).selectExpr(*key, "_n AS _size")
    sizes = bounded(sizes)
    rows = rows.drop("n").join(sizes.withColumnRenamed("_size", "n"), key)
    rows = rows.selectExpr(*key, "n", "w", "greatest(l_before, r_before) AS a")
    rows = rows.select("*", first_cutoff("a + 1", qs).alias("s"), first_cutoff("a + w", qs).alias("e"))
    grid = "array(" + ", ".join(f"{q}D" for q in qs) + ")"

    def reach(j: str) -> str:
        k = f"greatest(1L, floor(element_at({grid}, {j} + 1) / 100.0D * n))"
        return f"greatest(0L, least(w, {k} - a))"

    last = len(qs) - 1
    step = f"IF(j > s, {reach('j')} - {reach('(j - 1)')}, {reach('j')})"
    simple = rows.filter(f"s <= {last} AND s = e").selectExpr(*key, "e AS _i", "w AS _c")
    split = rows.filter(f"s <= {last} AND s < e").selectExpr(
        *key, f"inline(transform(sequence(s, least(e, {last})), j -> named_struct('_i', j, '_c', {step})))"
    )
    return cutoff_steps(
        simple.unionByName(split).groupBy(*key, "_i").agg(F.expr("sum(_c) AS _c")),
        sizes.withColumnRenamed("_size", "n"), key, qs,
    )


def _with_cached_null(counts: DataFrame) -> DataFrame:
    """E[J] once per distinct (n, k), then joined back."""
    counts = materialize(counts)
    null = with_null(counts.select("n", "k").distinct().withColumn("overlap", F.lit(0).cast("bigint")))
    return counts.join(bounded(null.select("n", "k", "expected_jaccard")), ["n", "k"])


def bootstrap_tau(
    pairs: DataFrame, by: list[str], unit: str, reps: int | range, seed: int, id: str = "id", size: int = TASK_ROWS
) -> DataFrame:
    """Kendall tau of every replicate; ``unit`` is the cluster column, or ``id`` for a row bootstrap."""
    span = range(reps) if isinstance(reps, int) else reps
    base = finite_pairs(pairs).filter(F.col(unit).isNotNull()).select(*by, *dict.fromkeys([unit, id]), "left", "right")
    base = materialize(base)
    taus = weighted_taus(base, draw_weights(base, by, unit, span, seed), by, unit, len(span), id, size)
    return taus.withColumn("rep", (F.col("rep") + span.start).cast("int"))


def percentile_ci(reps: DataFrame, by: list[str], value: str, total: int, prefix: str, alpha: float = 0.05):
    """Percentile interval over replicates (a bounded table); missing if under half of them are finite."""
    ok = f"count_if(`{value}` IS NOT NULL AND NOT isnan(`{value}`)) >= {total // 2}"
    x = f"IF(isnan(`{value}`), NULL, `{value}`)"
    return reps.groupBy(*by).agg(
        F.expr(f"IF({ok}, percentile({x}, {alpha / 2}), NULL) AS {prefix}_low"),
        F.expr(f"IF({ok}, percentile({x}, {1 - alpha / 2}), NULL) AS {prefix}_high"),
    )


def simultaneous_band(
    curves: DataFrame, observed: DataFrame, by: list[str], alpha: float = 0.05, y: str = "adjusted_jaccard"
) -> DataFrame:
    """Studentised sup-norm band around the observed curve, clipped to [-1, 1] (replicates x cutoffs: bounded)."""
    good = curves.groupBy(*by, "rep").agg(F.expr(f"bool_and(`{y}` IS NOT NULL AND NOT isnan(`{y}`)) AS _ok"))
    curves = curves.join(good.filter("_ok").drop("_ok"), [*by, "rep"])
    se = curves.groupBy(*by, "q").agg(F.expr(f"greatest(stddev_samp(`{y}`), 1e-12D) AS _se"))
    obs = observed.selectExpr(*by, "q", f"`{y}` AS _obs").join(se, [*by, "q"])
    sup = curves.join(obs, [*by, "q"]).groupBy(*by, "rep").agg(F.expr(f"max(abs(`{y}` - _obs) / _se) AS _sup"))
    crit = sup.groupBy(*by).agg(F.expr(f"percentile(_sup, {1 - alpha}) AS _crit"))
    return obs.join(crit, by).selectExpr(
        *by, "q", "greatest(-1.0D, least(1.0D, _obs - _crit * _se)) AS band_low",
        "greatest(-1.0D, least(1.0D, _obs + _crit * _se)) AS band_high",
    )


def bootstrap_naucc(
    ranked: DataFrame, by: list[str], unit: str, reps: int, seed: int, qs=Q_GRID, null: str = "fixed", id: str = "id",
    size: int = TASK_ROWS,
) -> DataFrame:
    """nAUCC and band areas of every replicate."""
    return area_summary(bootstrap_curves(ranked, by, unit, reps, seed, qs, null, id, size), [*by, "rep"])


def cluster_screening(
    pairs: DataFrame, by: list[str], unit: str, reps: int, seed: int, qs=Q_GRID, deltas=(0.0, 0.05, 0.10),
    run: int = 5, id: str = "id", size: int = TASK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Unified cluster bootstrap: the curve with its band, and per key tau, nAUCC, band areas, intervals and onsets.

    k and E[J] are recomputed for every replicate's size.
    """
    base = materialize(finite_pairs(pairs).filter(F.col(unit).isNotNull()).select(*by, id, unit, "left", "right"))
    ranked = materialize(rank_both(base, by, id))
    observed = materialize(concordance_curve(ranked, by, qs))
    curves = materialize(bootstrap_curves(ranked, by, unit, reps, seed, qs, "recomputed", id, size))
    taus = materialize(bootstrap_tau(base, by, unit, reps, seed, id, size))
    curve = observed.join(simultaneous_band(curves, observed, by), [*by, "q"], "left")
    out = base.groupBy(*by).agg(F.expr("count(*) AS n"))
    out = out.join(base.select(*by, unit).distinct().groupBy(*by).agg(F.expr("count(*) AS n_groups")), by)
    out = out.join(kendall_tau(base, by, id, size=size).drop("n"), by)
    out = out.join(percentile_ci(taus, by, "tau", 0, "tau_ci95"), by)
    out = out.join(area_summary(observed, by, bands=[]), by)
    areas = area_summary(curves, [*by, "rep"], bands=[])
    out = out.join(percentile_ci(areas, by, "naucc", 0, "naucc_ci95"), by)
    for name, lo, hi in BANDS:
        col = f"partial_{name}"
        out = out.join(interpolated_area(observed, by, lo, hi, col), by)
        each = interpolated_area(curves, [*by, "rep"], lo, hi, col)
        out = out.join(percentile_ci(each, by, col, 0, f"{col}_ci95"), by)
    starts = onset(curve, by, "band_low", deltas, run)
    wide = starts.groupBy(*by).agg(
        *[
            F.expr(f"max(IF(delta = {d}D, persistent_onset, NULL)) AS onset_delta_{int(round(d * 100)):02d}")
            for d in deltas
        ]
    )
    return curve, out.join(wide, by)


def drawn_rows(df: DataFrame, by: list[str], columns: list[str], reps: int, seed: int, id: str = "id") -> DataFrame:
    """Every replicate of a row bootstrap, written: ``by``, ``rep``, ``w`` and ``columns`` of each row drawn.

    Rows are their own units, so draws go straight to the row of that number: they are shuffled once and need no table of units. The draws
    are those of ``cluster_draws``.
    """
    base = positions(df.filter(F.col(id).isNotNull()).select(*by, *dict.fromkeys([id, *columns])), by, [F.col(id).asc()], "_idx", "_G")
    tasks = max(1, -(-base.count() * reps // WINDOW_ROWS))
    draw = f"pmod({counter_hash(str(seed), 'rep', '_idx - 1')}, _G) + 1"
    drawn = base.selectExpr(*by, "_idx", "_G", f"explode(sequence(0, {reps - 1})) AS rep").selectExpr(*by, "rep", f"{draw} AS _idx")
    counts = drawn.repartition(tasks, *by, "_idx").groupBy(*by, "rep", "_idx").agg(F.expr("count(*) AS w"))
    rows = base.select(*by, "_idx", *columns).repartition(tasks, *by, "_idx")
    return materialize(counts.join(rows, [*by, "_idx"]).select(*by, "rep", "w", *columns))


def _means(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*by, "rep").agg(*[F.expr(f"sum(w * `{c}`) / sum(w) AS `{c}`") for c in columns])


def _medians(rows: DataFrame, by: list[str], value: str, size: int) -> DataFrame:
    """Weighted middle of each replicate of written rows with ``pos``; only the blocks that hold it are put in order."""
    key = [*by, "rep"]
    of = f"PARTITION BY {', '.join(f'`{c}`' for c in key)}"
    rows = rows.withColumn("_b", F.expr(f"(pos - 1) div {size}"))
    blocks = rows.groupBy(*key, "_b").agg(F.expr("sum(w) AS _t")).selectExpr(
        "*", f"sum(_t) OVER ({of} ORDER BY _b ROWS UNBOUNDED PRECEDING) - _t AS _before", f"sum(_t) OVER ({of}) AS _n"
    )
    lo, hi = "(_n - 1) div 2", "_n div 2"
    blocks = materialize(blocks.filter(f"_before <= {hi} AND {lo} < _before + _t").drop("_t"))
    near = rows.join(bounded(blocks), [*key, "_b"]).selectExpr(
        "*", f"_before + sum(w) OVER (PARTITION BY {', '.join(f'`{c}`' for c in [*key, '_b'])} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS _W"
    )
    return near.groupBy(*key).agg(
        F.expr(
            f"(max(IF(_W - w <= {lo} AND {lo} < _W, `{value}`, NULL)) "
            f"+ max(IF(_W - w <= {hi} AND {hi} < _W, `{value}`, NULL))) / 2 AS `{value}`"
        )
    )


def bootstrap_means(df: DataFrame, by: list[str], unit: str, columns: list[str], reps: int, seed: int, id: str = "id"):
    """Weighted means of several columns of every replicate, on shared draws; ratios and differences follow."""
    if unit == id:
        return _means(drawn_rows(df, by, columns, reps, seed, id), by, columns)
    draws = cluster_draws(df, by, unit, reps, seed)
    rows = spread_join(df.select(*by, *dict.fromkeys([unit, id]), *columns), draws.drop("_rows"), [*by, unit], id)
    return _means(rows, by, columns)


def bootstrap_mean_median(
    df: DataFrame, by: list[str], value: str, reps: int, seed: int, id: str = "id", size: int = BLOCK_ROWS
) -> DataFrame:
    """Row-bootstrap ``mean`` and ``median`` of ``value`` per replicate, from the same drawn rows."""
    base = positions(df.filter(F.col(id).isNotNull()).select(*by, id, value), by, [F.col(value).asc(), F.col(id).asc()])
    rows = drawn_rows(base, by, [value, "pos"], reps, seed, id)
    mean = _means(rows, by, [value]).withColumnRenamed(value, "mean")
    return mean.join(_medians(rows, by, value, size).withColumnRenamed(value, "median"), [*by, "rep"])


def bootstrap_medians(
    df: DataFrame, by: list[str], value: str, reps: int, seed: int, id: str = "id", size: int = BLOCK_ROWS
) -> DataFrame:
    """Row-bootstrap median of ``value`` per replicate: the weighted middle of one shared order."""
    return bootstrap_mean_median(df, by, value, reps, seed, id, size).select(*by, "rep", F.col("median").alias(value))


def group_mean_difference(
    df: DataFrame, by: list[str], unit: str, a: str, b: str, reps: int, seed: int
) -> DataFrame:
    """Mean over clusters of their mean (a - b), with its cluster-bootstrap interval."""
    groups = materialize(df.filter(F.col(unit).isNotNull()).groupBy(*by, unit).agg(F.expr(f"avg(`{a}` - `{b}`) AS d")))
    point = groups.groupBy(*by).agg(F.expr("avg(d) AS difference"))
    reps_df = bootstrap_means(groups, by, unit, ["d"], reps, seed, id=unit)
    return point.join(percentile_ci(reps_df, by, "d", reps, "ci95"), by)


def permutation_taus(
    pairs: DataFrame, by: list[str], reps: int, seed: int, id: str = "id", size: int = TASK_ROWS
) -> DataFrame:
    """tau of every permutation: right scores are handed out in the order of a hash of (replicate, id)."""
    base, largest = with_blocks(materialize(finite_pairs(pairs).select(*by, id, "left", "right")), by, id, size)
    return _permuted(base, largest, by, reps, seed, id, size)


def _permuted(base: DataFrame, largest: int, by: list[str], reps: int, seed: int, id: str, size: int) -> DataFrame:
    """tau of every permutation of written rows from ``with_blocks``. Keys that fit a task are permuted there; larger ones in passes over
    some replicates each, which free what they wrote."""
    if "_bl" not in base.columns:
        return permuted_taus(base, by, reps, seed, id)
    step = max(1, PASS_ROWS // max(1, base.count()))
    spans = [range(at, min(at + step, reps)) for at in range(0, reps, step)]
    return in_passes(base.sparkSession, spans, lambda span: _permuted_blocks(base, largest, by, span, seed, id, size))


def _permuted_blocks(base: DataFrame, largest: int, by: list[str], span: range, seed: int, id: str, size: int) -> DataFrame:
    """tau of the permutations of ``span``: a score keeps its block in every replicate."""
    key = [*by, "rep"]
    blocks = {s: [f"_b{s[0]}", f"_h{s[0]}"] for s in ("left", "right")}
    lefts = positions(base.select(*by, id, "left", *blocks["left"]), by, [F.col(id).asc()], "_at", count=None).drop(id).selectExpr(
        "*", f"explode(sequence({span.start}, {span.stop - 1})) AS rep"
    )
    rights = base.select(*by, id, "right", *blocks["right"]).selectExpr("*", f"explode(sequence({span.start}, {span.stop - 1})) AS rep").selectExpr(
        "*", f"{counter_hash(str(seed), 'rep', f'`{id}`')} AS _h"
    )
    rights = positions(rights, key, [F.col("_h").asc(), F.col(id).asc()], "_at", count=None).select(
        *key, "_at", "right", *blocks["right"]
    )
    dealt = materialize(lefts.join(rights, [*key, "_at"]).drop("_at"))
    return kendall_tau(dealt, key, id, size=size, largest=largest)


def permutation_pvalue(
    pairs: DataFrame, by: list[str], reps: int, seed: int, alternative: str = "two-sided", corrected: bool = True,
    id: str = "id", size: int = TASK_ROWS,
) -> DataFrame:
    """(b + 1) / (B + 1), or b / B without the correction; missing below five pairs."""
    tests = {
        "two-sided": "abs(_t) >= abs(tau)", "greater": "_t >= tau", "less": "_t <= tau",
    }
    base, largest = with_blocks(materialize(finite_pairs(pairs).select(*by, id, "left", "right")), by, id, size)
    observed = kendall_tau(base, by, id, size=size, largest=largest)
    null = _permuted(base, largest, by, reps, seed, id, size).withColumnRenamed("tau", "_t").drop("n")
    hits = observed.join(null, by).groupBy(*by, "n", "tau").agg(F.expr(f"count_if({tests[alternative]}) AS b"))
    p = f"(b + 1) / {reps + 1}.0D" if corrected else f"b / {reps}.0D"
    return hits.selectExpr(*by, "n", "tau", f"IF(n >= 5, {p}, NULL) AS pvalue")


def _common_units(pairs: DataFrame, by: list[str], role: str, unit: str, id: str) -> DataFrame:
    """Pairs whose unit has finite pairs in both roles."""
    rows = finite_pairs(pairs).filter(F.col(unit).isNotNull())
    both = rows.groupBy(*by, unit).agg(F.countDistinct(role).alias("_r")).filter("_r = 2").drop("_r")
    return spread_join(rows, both, [*by, unit], id)


def delta_tau_permutation(
    pairs: DataFrame, by: list[str], role: str, target: str, unit: str, reps: int, seed: int, id: str = "id",
    size: int = TASK_ROWS,
) -> DataFrame:
    """p for equal tau in two roles: each unit is dealt to one role by a coin per replicate.

    Every replicate compares disjoint halves of the units with the full-sample difference, and replicates with too
    few pairs stay in the denominator, so the test is conservative.
    """
    pairs = materialize(finite_pairs(pairs).select(*by, *dict.fromkeys([role, unit, id]), "left", "right"))
    rows = materialize(_common_units(pairs, by, role, unit, id))
    key = [*by, role]
    full = kendall_tau(pairs, key, id, size=size)
    is_target = f"`{role}` = '{target}'"
    diff = f"max(IF({is_target}, tau, NULL)) - max(IF(NOT ({is_target}), tau, NULL))"
    observed = full.groupBy(*by).agg(F.expr(f"{diff} AS delta_tau"))
    coin = f"({counter_hash(str(seed), f'(_g * {STEP} + o)', f'`{unit}`')} % 2 = 1) = ({is_target})"
    draws = rows.select(*key, unit).distinct().selectExpr("*", f"explode(sequence(0, {(reps - 1) // STEP})) AS _g").selectExpr(
        *key, f"`{unit}`", "_g", f"transform({step_offsets(reps)}, o -> CAST({coin} AS TINYINT)) AS _w"
    )
    taus = weighted_taus(rows, draws, key, unit, reps, id, size)
    null = taus.filter("n >= 5").groupBy(*by, "rep").agg(F.expr(f"{diff} AS _d"))
    out = observed.join(null, by, "left").groupBy(*by, "delta_tau").agg(
        F.expr("count_if(abs(_d) >= abs(delta_tau)) AS b")
    )
    return out.selectExpr(*by, "delta_tau", f"IF(delta_tau IS NULL, NULL, (b + 1) / {reps + 1}.0D) AS pvalue")


def delta_tau_bootstrap(
    pairs: DataFrame, by: list[str], role: str, target: str, unit: str, reps: int, seed: int, id: str = "id",
    size: int = TASK_ROWS,
) -> DataFrame:
    """Cluster-bootstrap interval of tau(target) - tau(other), both roles on the same drawn units."""
    rows = materialize(_common_units(pairs, by, role, unit, id).select(*by, role, unit, id, "left", "right"))
    # A common unit has rows in both roles.
    draws = draw_weights(rows, by, unit, range(reps), seed).join(rows.select(*by, role).distinct(), by)
    taus = weighted_taus(rows, draws, [*by, role], unit, reps, id, size)
    is_target = f"`{role}` = '{target}'"
    diff = taus.groupBy(*by, "rep").agg(
        F.expr(f"max(IF({is_target}, tau, NULL)) - max(IF(NOT ({is_target}), tau, NULL)) AS delta")
    )
    return percentile_ci(diff, by, "delta", reps, "delta_ci95")


def subgroup_permutation(
    pairs: DataFrame, by: list[str], member: str, reps: int, seed: int, id: str = "id", size: int = TASK_ROWS
) -> DataFrame:
    """p for tau(subgroup) = tau(complement), against random subgroups of the same size taken in hash order."""
    rows = materialize(finite_pairs(pairs).select(*by, id, F.col(member).alias("_in"), "left", "right"))
    split = "max(IF(_in, tau, NULL)) - max(IF(NOT _in, tau, NULL))"
    rows, largest = with_blocks(rows, by, id, size)
    observed = kendall_tau(rows, [*by, "_in"], id, size=size, largest=largest).groupBy(*by).agg(F.expr(f"{split} AS delta_tau"))
    sizes = rows.groupBy(*by).agg(F.expr("count_if(_in) AS _size"))
    null = random_subset_taus(rows.drop("_in"), sizes, by, reps, seed, largest, id, size)
    null = null.groupBy(*by, "rep").agg(F.expr(f"{split} AS _d"))
    out = observed.join(null, by, "left").groupBy(*by, "delta_tau").agg(
        F.expr("count_if(abs(_d) >= abs(delta_tau)) AS b")
    )
    return out.selectExpr(*by, "delta_tau", f"(b + 1) / {reps + 1}.0D AS pvalue")


def random_subset_taus(
    base: DataFrame, sizes: DataFrame, by: list[str], reps: int, seed: int, largest: int, id: str = "id", size: int = TASK_ROWS
) -> DataFrame:
    """``by, rep, _size, _in, tau``: tau of random subsets and of their complements, for each ``_size`` in ``sizes`` of the key.

    ``base`` are written rows from ``with_blocks``. A subset is the first ``_size`` rows in the order of a hash of (replicate, id), so
    the sizes of a key are nested: a row carries the number of sizes it lies beyond, and is sent once for all of them.
    The last row of a subset is found without a sort of all rows, among those that share the top bits of its hash.
    """
    sizes = materialize(sizes.select(*by, "_size").distinct())
    # Bits below the bucket: as many buckets as ids in a few thousands, of hashes of 60 bits.
    bits = 60 - max(1, min(20, (largest // 64).bit_length()))
    spread = base.select(*by, id).repartition(tasks_for(base.count(), reps), *by, id)
    drawn = spread.selectExpr("*", f"explode(sequence(0, {reps - 1})) AS rep").selectExpr(
        "*", f"{counter_hash(str(seed), 'rep', f'`{id}`')} AS _h"
    )
    key = [*by, "rep"]
    buckets = drawn.groupBy(*key, F.expr(f"shiftright(_h, {bits}) AS _bucket")).agg(F.expr("count(*) AS _c")).selectExpr(
        "*", f"sum(_c) OVER (PARTITION BY {', '.join(f'`{c}`' for c in key)} ORDER BY _bucket ROWS UNBOUNDED PRECEDING) AS _upto"
    )
    ends = buckets.join(bounded(sizes), by).filter("_upto - _c < _size AND _size <= _upto").selectExpr(
        *key, "_size", "_bucket", "_size - (_upto - _c) AS _nth"
    )
    ends = materialize(ends)
    near = drawn.selectExpr(*key, "_h", f"`{id}` AS _id", f"shiftright(_h, {bits}) AS _bucket").join(
        bounded(ends.select(*key, "_bucket").distinct()), [*key, "_bucket"]
    )
    order = f"PARTITION BY {', '.join(f'`{c}`' for c in [*key, '_bucket'])} ORDER BY _h, _id"
    near = near.selectExpr("*", f"CAST(row_number() OVER ({order}) AS BIGINT) AS _nth")
    last = ends.join(near, [*key, "_bucket", "_nth"]).groupBy(*key, "_size").agg(F.expr("max(named_struct('_h', _h, '_id', _id)) AS _end"))
    # Sizes of a key in order; an empty subset has no last row, and no row lies in it.
    grid = sizes.selectExpr("*", f"explode(sequence(0, {reps - 1})) AS rep").join(last, [*key, "_size"], "left")
    grid = materialize(grid)
    ladders = grid.groupBy(*key).agg(F.expr("array_sort(collect_list(named_struct('_size', _size, '_end', _end))) AS _ends"))
    packed = ladders.groupBy(*by, F.expr(f"rep div {STEP}").cast("int").alias("_g")).agg(
        F.expr("transform(array_sort(collect_list(named_struct('rep', rep, '_ends', _ends))), e -> e._ends) AS _ladders")
    )
    hash = counter_hash(str(seed), f"(_g * {STEP} + o)", f"`{id}`")
    outside = f"filter(_ladders[o], e -> e._end IS NULL OR e._end < named_struct('_h', h, '_id', `{id}`))"
    beyond = spread.join(bounded(packed), by).selectExpr(
        *by, f"`{id}`", "_g",
        f"transform(transform({step_offsets(reps)}, o -> {hash}), (h, o) -> CAST(size({outside}) AS SMALLINT)) AS _w",
    )
    counts = sizes.groupBy(*by).agg(F.expr("CAST(count(*) AS INT) AS _m"))
    taus = weighted_taus(base.select(*by, id, "left", "right"), beyond, by, id, reps, id, size, counts)
    order = f"PARTITION BY {', '.join(f'`{c}`' for c in key)} ORDER BY _size"
    return taus.join(grid.selectExpr(*key, "_size", f"row_number() OVER ({order}) - 1 AS _j"), [*key, "_j"]).select(*key, "_size", "_in", "tau")
