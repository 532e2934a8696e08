"""High-response subsets, swap permutation and the tie-break audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.frame import finite_pairs
from tandemrank.operators.overlap import (
    Q_GRID, area_summary, concordance_curve, overlap_counts,
)
from tandemrank.operators.quantile import quantiles
from tandemrank.operators.rank import positions, rank_both
from tandemrank.operators.resample import counter_hash, percentile_ci
from tandemrank.session import bounded, materialize


def high_response(pairs: DataFrame, by: list[str], fractions: Sequence[float], id: str = "id") -> DataFrame:
    """Rows of each (method, fraction) subset: dual_high, anchor_left, anchor_right, pooled.

    dual_high: both scores above the 1 - f quantile of the pair minimum; anchor: top floor(f n) of one side;
    pooled: pair mean at or above its 1 - f quantile.
    """
    ranked = materialize(rank_both(pairs, by, id))
    probs = {f"f{i}": 1.0 - f for i, f in enumerate(fractions)}
    cuts = None
    for name, expr in (("min", "least(`left`, `right`)"), ("mean", "0.5D * (`left` + `right`)")):
        q = quantiles(ranked.selectExpr(*by, f"`{id}`", f"{expr} AS _v"), by, "_v", id, probs)
        q = q.selectExpr(*by, *[f"{p} AS _{name}_{p}" for p in probs])
        cuts = q if cuts is None else cuts.join(q, by)
    rows = ranked.join(bounded(cuts), by)
    items = []
    for i, f in enumerate(fractions):
        tests = {
            "dual_high": f"`left` > _min_f{i} AND `right` > _min_f{i}",
            "anchor_left": f"l_pos <= greatest(1L, floor({f}D * n))",
            "anchor_right": f"r_pos <= greatest(1L, floor({f}D * n))",
            "pooled": f"0.5D * (`left` + `right`) >= _mean_f{i}",
        }
        items += [
            f"IF({t}, named_struct('method', '{m}', 'fraction', {f}D), NULL)" for m, t in tests.items()
        ]
    keep = [f"`{c}`" for c in ranked.columns if c not in ("l_pos", "r_pos", "n")]
    return rows.selectExpr(*keep, f"inline(array_compact(array({', '.join(items)})))")


def swap_permutation(
    pairs: DataFrame, by: list[str], fraction: float, reps: int, seed: int, min_n: int = 10, qs=Q_GRID, id: str = "id"
) -> DataFrame:
    """nAUCC of the pooled selection against replicates in which a coin swaps the two sides of each pair.

    A key with fewer than ``min_n`` selected pairs keeps its row, with null statistics. The pair mean does not change under a swap, so the selection is the same in every replicate and is made once.
    """
    rows = high_response(pairs, by, [fraction], id).filter("method = 'pooled'").select(*by, id, "left", "right")
    rows = materialize(rows)

    def areas(frame: DataFrame, key: list[str]) -> DataFrame:
        return area_summary(concordance_curve(rank_both(frame, key, id), key, qs), key, bands=[])

    observed = areas(rows, by).withColumnRenamed("naucc", "observed_naucc")
    coin = f"{counter_hash(str(seed), 'rep', f'`{id}`')} % 2 = 1"
    swapped = rows.selectExpr("*", f"explode(sequence(0, {reps - 1})) AS rep").selectExpr(
        *by, "rep", f"`{id}`", f"IF({coin}, `right`, `left`) AS `left`", f"IF({coin}, `left`, `right`) AS `right`"
    )
    null = areas(swapped, [*by, "rep"])
    size = rows.groupBy(*by).agg(F.expr("count(*) AS n_selected"))
    out = observed.join(null, by).groupBy(*by, "observed_naucc").agg(
        F.expr("avg(naucc) AS permuted_mean_naucc"), F.expr("stddev_samp(naucc) AS permuted_std_naucc"),
        F.expr("(1 + count_if(naucc >= observed_naucc)) / (count(naucc) + 1.0D) AS pvalue"),
    )
    out = size.join(out, by, "left")
    shown = ["observed_naucc", "permuted_mean_naucc", "permuted_std_naucc", "pvalue"]
    return out.withColumns({c: F.when(F.col("n_selected") >= min_n, F.col(c)) for c in shown})


def tie_break_audit(pairs: DataFrame, by: list[str], reps: int, seed: int, qs=Q_GRID, id: str = "id") -> DataFrame:
    """Range of nAUCC, elite area and top-10 % overlap when exact ties are shuffled on each side."""
    rows = materialize(finite_pairs(pairs).select(*by, id, "left", "right"))
    stable = area_summary(concordance_curve(rank_both(rows, by, id), by, qs), by).selectExpr(
        *by, "naucc AS naucc_stable"
    )
    key = [*by, "rep"]
    shuffled = rows.selectExpr("*", f"explode(sequence(0, {reps - 1})) AS rep")
    for side, name in (("l", "left"), ("r", "right")):
        h = f"{counter_hash(str(seed), 'rep', repr(side), f'`{id}`')} AS _h"
        shuffled = positions(
            shuffled.selectExpr("*", h), key, [F.col(name).desc(), F.col("_h").asc(), F.col(id).asc()],
            f"{side}_pos", count="n" if side == "l" else None,
        ).drop("_h")
    shuffled = materialize(shuffled)
    areas = area_summary(concordance_curve(shuffled, key, qs), key)
    top = overlap_counts(shuffled, key, [10.0]).selectExpr(*key, "overlap")
    table = materialize(areas.join(top, key))
    out = table.groupBy(*by).agg(
        F.expr("min(naucc) AS naucc_min"), F.expr("max(naucc) AS naucc_max"),
        F.expr("min(partial_elite) AS elite_min"), F.expr("max(partial_elite) AS elite_max"),
        F.expr("min(overlap) AS top10_overlap_min"), F.expr("max(overlap) AS top10_overlap_max"),
    )
    return out.join(percentile_ci(table, by, "naucc", 0, "naucc_ci95"), by).join(stable, by)
