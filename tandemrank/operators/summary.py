"""Value summaries, pair differences, threshold contingency and scale decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.frame import finite_pairs
from tandemrank.operators.quantile import quantiles, summarize

RAW_PROBS = {f"q{int(p * 100):02d}": p for p in (0.0, 0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99, 1.0)}


def stack_sides(pairs: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """Both scores as rows: ``side`` ('left' or 'right') and ``value``; missing values are dropped."""
    rows = pairs.selectExpr(
        *by, f"`{id}` AS id",
        "inline(array(named_struct('side', 'left', 'value', CAST(`left` AS DOUBLE)), "
        "named_struct('side', 'right', 'value', CAST(`right` AS DOUBLE))))",
    )
    return rows.filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) != double('inf')")


def raw_value_summary(pairs: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """Per key and side: n, mean, sample deviation, zeros and nine quantiles."""
    extra = {
        "size": F.expr("count(*)"), "mean": F.expr("avg(value)"), "std": F.expr("stddev_samp(value)"),
        "zero_count": F.expr("count_if(value = 0)"),
    }
    return summarize(stack_sides(pairs, by, id), [*by, "side"], "value", "id", RAW_PROBS, extra).withColumnRenamed(
        "size", "n"
    )


def pair_difference_summary(pairs: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """Absolute difference, symmetric relative difference (missing at 0/0) and log10 ratio of nonzero pairs."""
    p = finite_pairs(pairs)
    kinds = p.selectExpr(
        *by, f"`{id}` AS id",
        """inline(array(
          named_struct('kind', 'abs', 'value', abs(`left` - `right`)),
          named_struct('kind', 'rel', 'value', IF(abs(`left`) + abs(`right`) > 0,
                       2.0D * abs(`left` - `right`) / (abs(`left`) + abs(`right`)), NULL)),
          named_struct('kind', 'log', 'value', IF(`left` != 0 AND `right` != 0, log10(abs(`left`) / abs(`right`)), NULL))
        ))""",
    ).filter("value IS NOT NULL")
    stats = summarize(
        kinds, [*by, "kind"], "value", "id", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, {"mean": F.expr("avg(value)"),
        "size": F.expr("count(*)")},
    )

    def pick(kind: str, field: str) -> str:
        return f"max(IF(kind = '{kind}', {field}, NULL))"

    return stats.groupBy(*by).agg(
        F.expr(pick("abs", "size") + " AS n"),
        F.expr(pick("abs", "mean") + " AS absolute_difference_mean"),
        F.expr(pick("abs", "q50") + " AS absolute_difference_median"),
        F.expr(pick("abs", "q95") + " AS absolute_difference_q95"),
        F.expr(pick("rel", "q50") + " AS symmetric_relative_difference_median"),
        F.expr(pick("rel", "q95") + " AS symmetric_relative_difference_q95"),
        F.expr(pick("log", "q50") + " AS log10_abs_ratio_median"),
        F.expr(pick("log", "q05") + " AS log10_abs_ratio_q05"),
        F.expr(pick("log", "q95") + " AS log10_abs_ratio_q95"),
    )


def with_kappa_mcc(cells: DataFrame) -> DataFrame:
    """Cohen's kappa (pooled prevalence form) and Matthews correlation from the four counts."""
    n = "(both + left_only + right_only + neither)"
    p_yes = f"((2.0D * both + left_only + right_only) / (2.0D * {n}))"
    p_e = f"({p_yes} * {p_yes} + (1.0D - {p_yes}) * (1.0D - {p_yes}))"
    p_o = f"((both + neither) / CAST({n} AS DOUBLE))"
    den = (
        "sqrt(CAST(both + right_only AS DOUBLE) * (both + left_only) * (neither + right_only) * (neither + left_only))"
    )
    return cells.selectExpr(
        "*",
        f"IF({p_e} >= 1.0D - 1e-12D, 1.0D, ({p_o} - {p_e}) / (1.0D - {p_e})) AS cohen_kappa",
        f"IF({den} = 0, 0.0D, (CAST(both AS DOUBLE) * neither - CAST(right_only AS DOUBLE) * left_only) / {den}) AS mcc",
    )


def threshold_screening(pairs: DataFrame, by: list[str], thresholds: Sequence[float]) -> DataFrame:
    """Per key and threshold: the 2x2 table of exceedances with agreement, prevalence, kappa and MCC."""
    grid = ", ".join(f"{float(t)}D" for t in thresholds)
    rows = finite_pairs(pairs).selectExpr(*by, "`left` AS l", "`right` AS r", f"explode(array({grid})) AS threshold")
    cells = rows.groupBy(*by, "threshold").agg(
        F.expr("count_if(l > threshold AND r > threshold) AS both"),
        F.expr("count_if(l > threshold AND r <= threshold) AS left_only"),
        F.expr("count_if(l <= threshold AND r > threshold) AS right_only"),
        F.expr("count_if(l <= threshold AND r <= threshold) AS neither"),
    )
    n = "(both + left_only + right_only + neither)"
    out = with_kappa_mcc(cells).selectExpr(
        "*", f"(both + neither) / CAST({n} AS DOUBLE) AS agreement",
        "(left_only + right_only) / CAST(" + n + " AS DOUBLE) AS crossing_rate",
        f"(2.0D * both + left_only + right_only) / (2.0D * {n}) AS prevalence",
        "both / CAST(nullif(both + right_only, 0) AS DOUBLE) AS precision_left_ref",
        "both / CAST(nullif(both + left_only, 0) AS DOUBLE) AS recall_left_ref",
        "both / CAST(nullif(both + left_only, 0) AS DOUBLE) AS precision_right_ref",
        "both / CAST(nullif(both + right_only, 0) AS DOUBLE) AS recall_right_ref",
    )
    return out.selectExpr(
        "*", "IF(prevalence < 1, (agreement - prevalence) / (1.0D - prevalence), 1.0D) AS adjusted_agreement"
    )


def consensus_flags(pairs: DataFrame, threshold: float) -> DataFrame:
    """Per pair: consensus and dispute flags at a threshold, with the interval the two scores span."""
    t = f"{float(threshold)}D"
    lo, hi = "least(`left`, `right`)", "greatest(`left`, `right`)"
    return finite_pairs(pairs).selectExpr(
        "*", f"{lo} AS interval_low", f"{hi} AS interval_high", f"{t} AS threshold",
        f"`left` > {t} AND `right` > {t} AS consensus_high",
        f"{lo} < {t} AND {hi} > {t} AS disputed",
        f"`left` <= {t} AND `right` <= {t} AS consensus_low",
        f"`left` > {t} AND `right` <= {t} AS left_only_high",
        f"`left` <= {t} AND `right` > {t} AS right_only_high",
    )


CONSENSUS = ["consensus_high", "disputed", "consensus_low", "left_only_high", "right_only_high"]


def consensus_summary(pairs: DataFrame, by: list[str], thresholds: Sequence[float]) -> DataFrame:
    out = None
    for t in thresholds:
        part = consensus_flags(pairs, t).groupBy(*by, "threshold").agg(
            *[F.expr(f"count_if({c}) AS {c}") for c in CONSENSUS]
        )
        out = part if out is None else out.unionByName(part)
    return out


def scale_summary(pairs: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """Medians of both sides and of the ratio, and mean and median log ratio, over strictly positive pairs."""
    p = finite_pairs(pairs).filter("`left` > 0 AND `right` > 0")
    kinds = p.selectExpr(
        *by, f"`{id}` AS id",
        """inline(array(named_struct('kind', 'l', 'value', `left`), named_struct('kind', 'r', 'value', `right`),
           named_struct('kind', 'ratio', 'value', `right` / `left`),
           named_struct('kind', 'log', 'value', ln(`right`) - ln(`left`))))""",
    )
    stats = summarize(
        kinds, [*by, "kind"], "value", "id", {"q50": 0.5},
        {"mean": F.expr("avg(value)"), "size": F.expr("count(*)")},
    )
    return stats.groupBy(*by).agg(
        F.expr("max(size) AS n_positive"),
        F.expr("max(IF(kind = 'l', q50, NULL)) AS left_median"),
        F.expr("max(IF(kind = 'r', q50, NULL)) AS right_median"),
        F.expr("max(IF(kind = 'ratio', q50, NULL)) AS median_ratio"),
        F.expr("max(IF(kind = 'log', mean, NULL)) AS mean_log_ratio"),
        F.expr("max(IF(kind = 'log', q50, NULL)) AS median_log_ratio"),
    )


DISCREPANCY_PROBS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def distribution_summary(df: DataFrame, by: list[str], value: str, id: str) -> DataFrame:
    """n, mean, population deviation and five quantiles of a column."""
    rows = df.filter(f"`{value}` IS NOT NULL AND NOT isnan(`{value}`)")
    return summarize(
        rows, by, value, id, DISCREPANCY_PROBS,
        {"size": F.expr("count(*)"), "mean": F.expr(f"avg(`{value}`)"), "std": F.expr(f"stddev_pop(`{value}`)")},
    ).withColumnRenamed("size", "n")


def winsorized(pairs: DataFrame, by: list[str], lo: float = 0.05, hi: float = 0.95, id: str = "id") -> DataFrame:
    """Clip both sides to their own quantiles within the key."""
    from tandemrank.session import bounded

    q = quantiles(stack_sides(pairs, by, id), [*by, "side"], "value", "id", {"lo": lo, "hi": hi})
    edges = q.groupBy(*by).agg(
        *[F.expr(f"max(IF(side = '{s}', {e}, NULL)) AS _{s}_{e}") for s in ("left", "right") for e in ("lo", "hi")]
    )
    out = pairs.join(bounded(edges), by)
    for s in ("left", "right"):
        out = out.withColumn(
            s, F.expr(f"IF(`{s}` IS NULL OR isnan(`{s}`), `{s}`, greatest(_{s}_lo, least(_{s}_hi, `{s}`)))")
        )
    return out.drop("_left_lo", "_left_hi", "_right_lo", "_right_hi")


def log_scores(pairs: DataFrame, eps: float = 1e-4) -> DataFrame:
    return pairs.withColumns({s: F.expr(f"ln({eps}D + `{s}`)") for s in ("left", "right")})
