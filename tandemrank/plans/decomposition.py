"""Scale, order and tail of one paired score, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tandemrank.frame import finite_pairs
from tandemrank.operators.correlation import ks_statistic, shift_summary, spearman
from tandemrank.operators.distribution import quantile_mapping_error
from tandemrank.operators.overlap import set_counts, top_sets
from tandemrank.operators.rank import rank_both
from tandemrank.operators.summary import scale_summary, with_kappa_mcc
from tandemrank.operators.tau import kendall_tau
from tandemrank.session import materialize


def scale_order_tail(pairs: DataFrame, by: list[str], q: float = 10.0, id: str = "id") -> DataFrame:
    """Medians and log ratios (scale), tau, rho and displacement (order), crossings and kappa of the top-q sets (tail).

    Only strictly positive pairs count. Order statistics depend on ranks alone, so they are the same on raw scores
    and on percentiles.
    """
    pos = materialize(finite_pairs(pairs).filter("`left` > 0 AND `right` > 0").select(*by, id, "left", "right"))
    ranked = materialize(rank_both(pos, by, id, ties=True))
    tail = with_kappa_mcc(top_sets(ranked, q).groupBy(*by).agg(*set_counts())).selectExpr(
        *by, "left_only + right_only AS crossings", "cohen_kappa AS kappa_at_tail", "both + left_only AS tail_k"
    )
    out = scale_summary(pos, by, id)
    for part in (
        kendall_tau(pos, by, id).drop("n"), spearman(ranked, by).drop("n"), shift_summary(ranked, by, id), tail,
        ks_statistic(pos, by, id).select(*by, "ks"), quantile_mapping_error(pos, by, id),
    ):
        out = out.join(part, by)
    return out
