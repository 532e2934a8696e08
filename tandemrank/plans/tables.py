"""Result tables that combine several statistics over the same keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.frame import finite_pairs, is_finite
from tandemrank.operators.correlation import shift_summary, spearman
from tandemrank.operators.overlap import Q_GRID, area_summary, concordance_curve
from tandemrank.operators.rank import rank_both
from tandemrank.operators.subsets import high_response
from tandemrank.operators.tau import kendall_tau
from tandemrank.session import materialize


def agreement(
    rows: DataFrame, by: list[str], qs: Sequence[float] | None = None, area: bool = False, shift: bool = False,
    id: str = "id",
) -> DataFrame:
    """n, tau and rho per key; with ``area`` nAUCC and bands; with ``qs`` adjusted Jaccard there; with ``shift`` the
    rank displacement. One job per statistic over all keys."""
    rows = materialize(finite_pairs(rows).select(*by, id, "left", "right"))
    ranked = materialize(rank_both(rows, by, id, ties=True))
    out = kendall_tau(rows, by, id).join(spearman(ranked, by).drop("n"), by)
    if area:
        out = out.join(area_summary(concordance_curve(ranked, by, Q_GRID), by), by, "left")
    if qs:
        wide = concordance_curve(ranked, by, qs).groupBy(*by).agg(
            *[F.expr(f"max(IF(q = {float(q)}D, adjusted_jaccard, NULL)) AS adjusted_{int(q)}") for q in qs],
            *[F.expr(f"max(IF(q = {float(q)}D, overlap, NULL)) AS overlap_{int(q)}") for q in qs],
            *[F.expr(f"max(IF(q = {float(q)}D, k, NULL)) AS k_{int(q)}") for q in qs],
        )
        out = out.join(wide, by)
    if shift:
        out = out.join(shift_summary(ranked, by, id), by)
    return out


def high_response_table(pairs: DataFrame, by: list[str], fractions: Sequence[float], id: str = "id") -> DataFrame:
    """tau and nAUCC of every high-response subset."""
    key = [*by, "method", "fraction"]
    return agreement(high_response(pairs, by, fractions, id), key, area=True, id=id)


def high_response_intervals(
    pairs: DataFrame, by: list[str], fractions: Sequence[float], unit: str, reps: int, perms: int, seed: int = 42, id: str = "id"
) -> DataFrame:
    """``high_response_table`` with cluster-bootstrap intervals of tau and nAUCC and, for pooled subsets, the swap p-value.

    The subsets are selected and ranked once. Both bootstraps draw by the same counters, so replicate b of tau and of nAUCC
    come from the same clusters. ``swap_pvalue`` is null for the other methods, whose selection a swap would change.
    """
    from tandemrank.operators.resample import bootstrap_naucc, bootstrap_tau, percentile_ci
    from tandemrank.operators.subsets import swap_permutation

    key = [*by, "method", "fraction"]
    rows = materialize(high_response(pairs, by, fractions, id).select(*key, *dict.fromkeys([id, unit]), "left", "right"))
    out = agreement(rows, key, area=True, id=id)
    taus = bootstrap_tau(rows, key, unit, reps, seed, id)
    areas = bootstrap_naucc(materialize(rank_both(rows, key, id)), key, unit, reps, seed, id=id)
    for frame, name in ((taus, "tau"), (areas, "naucc")):
        out = out.join(percentile_ci(frame, key, name, reps, f"{name}_ci95"), key, "left")
    swaps = None
    for f in fractions:
        one = swap_permutation(pairs, by, f, perms, seed, id=id).selectExpr(*by, "'pooled' AS method", f"{f}D AS fraction", "pvalue AS swap_pvalue")
        swaps = one if swaps is None else swaps.unionByName(one)
    return out.join(swaps, key, "left")


def rank_record(
    pairs: DataFrame, by: list[str], unit: str, reps: int, perms: int, seed: int = 42, id: str = "id"
) -> DataFrame:
    """Full rank record: tau with test, interval and permutation p, rho, displacement, top-5/10/20 % measures."""
    from tandemrank.operators.resample import bootstrap_tau, percentile_ci, permutation_pvalue
    from tandemrank.operators.tau import kendall_test

    out = agreement(pairs, by, qs=[5.0, 10.0, 20.0], shift=True, id=id)
    ci = percentile_ci(bootstrap_tau(pairs, by, unit, reps, seed, id), by, "tau", reps, "tau_ci95")
    perm = permutation_pvalue(pairs, by, perms, seed, id=id).select(*by, F.col("pvalue").alias("permutation_pvalue"))
    test = kendall_test(pairs, by, id).select(*by, F.col("pvalue").alias("tau_pvalue"))
    return out.join(test, by).join(ci, by, "left").join(perm, by, "left")


def topk_record(ranked: DataFrame, by: list[str], ks: Sequence[int]) -> DataFrame:
    """Plain Jaccard of the top-k sets for a list of sizes."""
    items = ", ".join(f"named_struct('k', {int(k)}L)" for k in ks)
    rows = ranked.selectExpr(*by, "n", "l_pos", "r_pos", f"inline(array({items}))").filter("greatest(l_pos, r_pos) <= k")
    hit = rows.groupBy(*by, "k").agg(F.expr("count(*) AS overlap"))
    grid = ranked.groupBy(*by).agg(F.max("n").alias("n")).selectExpr(*by, "n", f"inline(array({items}))")
    return grid.join(hit, [*by, "k"], "left").selectExpr(
        *by, "k", "coalesce(overlap, 0L) / (2.0D * least(k, n) - coalesce(overlap, 0L)) AS jaccard"
    )


def robustness(
    pairs: DataFrame, by: list[str], subsets: dict[str, str], stratum: str | None = None, transforms: bool = True,
    id: str = "id",
) -> DataFrame:
    """Rank record over named subsets, score transforms and leave-one-stratum-out, all in one pass of each operator.

    ``subsets`` are SQL conditions. The levels of the stratum are a table that the rows meet in blocks; a row belongs to every subset it
    meets, and a row without a stratum to every leave-one-out subset.
    """
    from tandemrank.operators.quantile import quantiles
    from tandemrank.operators.summary import log_scores, winsorized
    from tandemrank.session import bounded, with_each

    base = materialize(finite_pairs(pairs))
    mean = base.selectExpr("*", "(`left` + `right`) / 2.0D AS _mean")
    cut = bounded(quantiles(mean.select(*by, id, "_mean"), by, "_mean", id, {"_p99": 0.99}))
    items = [F.when(F.expr(cond), F.lit(name)) for name, cond in subsets.items()]
    items.append(F.when(F.expr("_mean < _p99"), F.lit("exclude_top_1pct")))
    tags = F.array_compact(F.array(*items))
    rows = mean.join(cut, by)
    keep = [*by, f"`{id}`", "`left`", "`right`"]
    long = rows.select(*keep, F.explode(tags).alias("subset"))
    if stratum:
        level = F.col(f"`{stratum}`").cast("string")
        levels = base.select(level.alias("_level")).filter("_level IS NOT NULL").distinct()
        each = with_each(base.select(*keep, level.alias("_own")), levels, id).filter("NOT (_own <=> _level)")
        long = long.unionByName(each.select(*keep, F.concat(F.lit("without_"), "_level").alias("subset")))
    if transforms:
        long = long.unionByName(winsorized(base, by, id=id).selectExpr(*keep, "'winsorized_5_95' AS subset"))
        long = long.unionByName(log_scores(base).selectExpr(*keep, "'log_eps' AS subset"))
    return agreement(long, [*by, "subset"], qs=[10.0], shift=True, id=id)


def control_comparison(
    controls: DataFrame, reference: DataFrame, by: list[str], unit: str, reps: int, perms: int, seed: int = 42,
    min_n: int = 30, id: str = "id",
) -> DataFrame:
    """Every control attribute against a reference score: tau, nAUCC, intervals, tau difference with interval,
    permutation p and adjusted p; ``insufficient_n`` below ``min_n`` pairs.

    ``controls`` is keyed by (by, attribute); each attribute meets its own copy of the reference.
    """
    from tandemrank.operators.resample import (
        bootstrap_naucc, bootstrap_tau, delta_tau_bootstrap, delta_tau_permutation, percentile_ci,
    )
    from tandemrank.operators.retention import step_up_fdr

    key = [*by, "attribute"]
    controls = materialize(controls.select(*key, id, unit, "left", "right"))
    points = agreement(controls, key, area=True, id=id).selectExpr(*key, "n", "tau", "naucc")
    points = points.withColumn("status", F.expr(f"IF(n < {min_n}, 'insufficient_n', 'ok')"))
    usable = materialize(controls.join(points.filter("status = 'ok'").select(*key), key))
    names = usable.select(*key).distinct()
    ref = names.join(materialize(reference.select(*by, id, unit, "left", "right")), by)
    both = usable.withColumn("role", F.lit("control")).unionByName(ref.withColumn("role", F.lit("reference")))
    both = materialize(both)
    tau_ci = percentile_ci(bootstrap_tau(usable, key, unit, reps, seed, id), key, "tau", reps, "tau_ci95")
    ranked = rank_both(usable, key, id)
    area_ci = percentile_ci(bootstrap_naucc(ranked, key, unit, reps, seed, id=id), key, "naucc", reps, "naucc_ci95")
    delta = delta_tau_permutation(both, key, "role", "reference", unit, perms, seed, id)
    delta_ci = delta_tau_bootstrap(both, key, "role", "reference", unit, reps, seed, id)
    delta = step_up_fdr(delta, by)
    out = points
    for part in (tau_ci, area_ci, delta, delta_ci):
        out = out.join(part, key, "left")
    return out


def heterogeneity(
    pairs: DataFrame, by: list[str], covariates: Sequence[str], unit: str, reps: int, perms: int, seed: int = 42,
    min_n: int = 30, id: str = "id",
) -> DataFrame:
    """tau within every (covariate, level) with interval, subgroup permutation p and adjusted p per covariate."""
    from tandemrank.operators.resample import bootstrap_tau, percentile_ci
    from tandemrank.operators.retention import step_up_fdr
    from tandemrank.operators.strata import unpivot_strata

    base = materialize(finite_pairs(pairs).select(*by, id, unit, "left", "right", *covariates))
    long = materialize(unpivot_strata(base, list(covariates)))
    key = [*by, "covariate", "level"]
    points = agreement(long, key, id=id).withColumn("status", F.expr(f"IF(n < {min_n}, 'insufficient_n', 'ok')"))
    levels = points.filter("status = 'ok'").select(*key)
    usable = materialize(long.join(levels, key))
    ci = percentile_ci(bootstrap_tau(usable, key, unit, reps, seed, id), key, "tau", reps, "tau_ci95")
    perm = step_up_fdr(_level_permutation(long, levels, [*by, "covariate"], perms, seed, id), [*by, "covariate"])
    return points.join(ci, key, "left").join(perm, key, "left")


def _level_permutation(long: DataFrame, levels: DataFrame, by: list[str], perms: int, seed: int, id: str) -> DataFrame:
    """``delta_tau`` and ``pvalue`` of every level against the rest of its covariate, see ``subgroup_permutation``.

    Random subsets depend on the size of a level alone and the sizes of a covariate are nested, so its rows are sent once per replicate
    and not once per replicate and level.
    """
    from tandemrank.operators.resample import random_subset_taus
    from tandemrank.operators.tau import with_blocks
    from tandemrank.session import bounded

    rows, largest = with_blocks(materialize(long.select(*by, "level", id, "left", "right")), by, id)
    sizes = materialize(rows.join(bounded(levels), [*by, "level"]).groupBy(*by, "level").agg(F.expr("count(*) AS _size")))
    # Every usable level meets all rows of its covariate, marked as member or not.
    marked = rows.withColumnRenamed("level", "_own").join(bounded(levels), by).withColumn("_in", F.expr("_own <=> level"))
    split = "max(IF(_in, tau, NULL)) - max(IF(NOT _in, tau, NULL))"
    observed = kendall_tau(marked, [*by, "level", "_in"], id, largest=largest).groupBy(*by, "level").agg(F.expr(f"{split} AS delta_tau"))
    null = random_subset_taus(rows.drop("level"), sizes, by, perms, seed, largest, id)
    null = null.groupBy(*by, "rep", "_size").agg(F.expr(f"{split} AS _d"))
    null = sizes.join(null, [*by, "_size"]).select(*by, "level", "_d")
    key = [*by, "level"]
    out = observed.join(null, key, "left").groupBy(*key, "delta_tau").agg(F.expr("count_if(abs(_d) >= abs(delta_tau)) AS b"))
    return out.selectExpr(*key, "delta_tau", f"(b + 1) / {perms + 1}.0D AS pvalue")


def distance_thresholds(
    pairs: DataFrame, by: list[str], distances: Sequence[str], points: int = 11, id: str = "id", relation: str | None = None
) -> DataFrame:
    """Agreement of the pairs within each of ``points`` distance quantiles from the median to the maximum.

    A row belongs to every threshold at or above its distance. Equal thresholds are kept once, and ``threshold_quantile``
    spreads what is left evenly over 0.5 to 1. ``n_excluded`` counts the finite pairs outside (those without a distance
    too), ``boundary_count`` pairs at the threshold, and ``n_not_identical`` those inside whose ``relation`` is not "identical".
    """
    from tandemrank.operators.quantile import quantiles
    from tandemrank.session import bounded

    items = ", ".join(f"named_struct('distance', '{d}', 'd', CAST(`{d}` AS DOUBLE))" for d in distances)
    other = f"NOT coalesce(`{relation}` = 'identical', false)" if relation else "CAST(NULL AS BOOLEAN)"
    every = materialize(finite_pairs(pairs).selectExpr(*by, f"`{id}`", "`left`", "`right`", f"{other} AS _other", f"inline(array({items}))"))
    rows = every.filter("d IS NOT NULL AND NOT isnan(d)")
    key = [*by, "distance"]
    probs = {f"t{i}": 0.5 + 0.5 * i / (points - 1) for i in range(points)}
    cuts = quantiles(rows, key, "d", id, probs).selectExpr(*key, f"array_distinct(array({', '.join(probs)})) AS cuts")
    met = rows.join(bounded(cuts), key).selectExpr(
        *by, "distance", f"`{id}`", "`left`", "`right`", "d", "_other", "greatest(size(cuts) - 1, 1) AS _steps",
        "inline(filter(transform(cuts, (c, i) -> named_struct('threshold', c, '_i', i)), x -> d <= x.threshold + 1e-12D))",
    )
    inside = "d <= threshold + 1e-15D"
    counts = met.groupBy(*key, "threshold").agg(
        F.expr("0.5D + 0.5D * max(_i) / max(_steps) AS threshold_quantile"), F.expr(f"count_if({inside}) AS _inside"),
        F.expr("count_if(abs(d - threshold) <= 1e-12D) AS boundary_count"),
        F.expr(f"IF(max(_other) IS NULL, NULL, count_if(_other AND {inside})) AS n_not_identical"),
    )
    counts = counts.join(bounded(every.groupBy(*key).agg(F.count("*").alias("_all"))), key)
    counts = counts.selectExpr(*key, "threshold", "threshold_quantile", "_all - _inside AS n_excluded", "boundary_count", "n_not_identical")
    out = agreement(met.filter(inside).select(*key, "threshold", id, "left", "right"), [*key, "threshold"], area=True, id=id)
    return out.join(counts, [*key, "threshold"], "left")


def distance_strata(pairs: DataFrame, by: list[str], distance: str, id: str = "id") -> DataFrame:
    """Agreement in five equal-frequency distance strata, with the distance range and tied rows of each.

    Pairs without a finite distance are in no stratum.
    """
    from tandemrank.operators.strata import rank_bins

    rows = materialize(rank_bins(finite_pairs(pairs).filter(is_finite(F.col(distance))), by, distance, id, 5, "stratum_no"))
    key = [*by, "stratum_no"]
    ties = rows.groupBy(*key, distance).count().groupBy(*key).agg(
        F.expr(f"min(`{distance}`) AS distance_min"), F.expr(f"max(`{distance}`) AS distance_max"),
        F.expr("sum(IF(count > 1, count, 0L)) AS boundary_count"),
    )
    return agreement(rows, key, area=True, id=id).join(ties, key)


def distance_trim(
    pairs: DataFrame, by: list[str], distance: str, fractions: Sequence[float] = (0.0, 0.01, 0.05, 0.10, 0.20),
    id: str = "id",
) -> DataFrame:
    """Agreement after removing the floor(f n) pairs with the largest distance, for each fraction.

    Only finite distances count in n and are removed; pairs without one stay.
    """
    from tandemrank.operators.rank import positions

    pairs = finite_pairs(pairs)
    known = is_finite(F.col(distance))
    rows = positions(pairs.filter(known), by, [F.col(distance).desc(), F.col(id).asc()], "_far", "_size")
    items = ", ".join(f"named_struct('trim_fraction', {f}D, '_cut', floor({f}D * _size))" for f in fractions)
    rows = rows.unionByName(pairs.filter(~known), allowMissingColumns=True)
    kept = rows.selectExpr(*by, f"`{id}`", "`left`", "`right`", "_far", f"inline(array({items}))").filter("_far IS NULL OR _far > _cut")
    return agreement(kept, [*by, "trim_fraction"], qs=[10.0], area=True, id=id)


def component_decomposition(pairs: DataFrame, by: list[str], min_n: int = 30, id: str = "id") -> DataFrame:
    """tau and adjusted top-10 % overlap of each contribution (a key column of ``pairs``), if there are enough."""
    out = agreement(pairs, by, qs=[10.0], id=id)
    return out.withColumn("status", F.expr(f"IF(n < {min_n}, 'insufficient_n', 'ok')"))


def baseline_comparison(pairs: DataFrame, by: list[str], qs: Sequence[float] = (1, 5, 10, 20, 50), id: str = "id"):
    """Every overlap, rank-biased and tail measure side by side at a few cutoffs, with the area up to each cutoff."""
    from tandemrank.operators.correlation import tail_agreement
    from tandemrank.operators.overlap import rank_biased_overlap, trapezoids

    rows = materialize(finite_pairs(pairs).select(*by, id, "left", "right"))
    ranked = materialize(rank_both(rows, by, id, ties=True))
    curve = materialize(concordance_curve(ranked, by, sorted({*Q_GRID, *map(float, qs)})))
    steps = trapezoids(curve, by).selectExpr(
        "*", "coalesce((_q - _q0) * (adjusted_jaccard + _y0) / 2, 0D) AS _a"
    ).selectExpr(
        "*", f"sum(_a) OVER (PARTITION BY {', '.join(by)} ORDER BY q ROWS UNBOUNDED PRECEDING) AS _sum"
    )
    cuts = ", ".join(f"{float(q)}D" for q in qs)
    out = steps.filter(f"q IN ({cuts})").selectExpr(
        *by, "q", "k", "n", "overlap", "observed_jaccard", "adjusted_jaccard", "overlap / k AS precision_at_k",
        "overlap / k AS recall_at_k", "overlap / k AS overlap_coefficient", "_sum / nullif(q - 1D, 0D) AS partial_naucc_to_q",
    )
    out = out.join(kendall_tau(rows, by, id).drop("n"), by).join(spearman(ranked, by).drop("n"), by)
    out = out.join(rank_biased_overlap(ranked, by), by)
    return out.join(tail_agreement(ranked, by, [float(q) for q in qs], id), [*by, "q"])
