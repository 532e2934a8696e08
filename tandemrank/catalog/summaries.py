"""Value summaries, thresholds, distribution comparison, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemrank.catalog.registry import query, r9, rounded
from tandemrank.catalog.views import (
    CUST, FINITE, LONG, PANELS, long_pairs, panel_pairs, pairs_cust, ranked_sql,
)
from tandemrank.frame import finite_pairs
from tandemrank.functions.null_model import ks_tail
from tandemrank.operators import correlation, distribution, quantile, summary
from tandemrank.operators.rank import rank_both
from tandemrank.session import materialize

PM = ["panel", "metric"]
STACK = """
sides AS (SELECT panel, metric, 'left' AS side, "left" AS value FROM panel_pairs WHERE "left" IS NOT NULL
          UNION ALL SELECT panel, metric, 'right', "right" FROM panel_pairs WHERE "right" IS NOT NULL)"""
QC = "round(quantile_cont({v}, {p}), {d}) + 0.0 AS {a}"
RAW_Q = ", ".join(QC.format(v="value", p=p, d=4, a=a) for a, p in summary.RAW_PROBS.items())


@query("finite_pairs", f"WITH {CUST} SELECT id, grp, \"left\", \"right\" FROM pairs_cust WHERE {FINITE}")
def _(spark, sf):
    return finite_pairs(pairs_cust(spark, sf)).select("id", "grp", "left", "right")


@query(
    "panel_long_form",
    f"WITH {PANELS} SELECT panel, metric, count(*) AS n, count(DISTINCT grp) AS groups, sum(dist) AS dist FROM panel_pairs GROUP BY ALL",
)
def _(spark, sf):
    from tandemrank.frame import long_metrics, long_panels

    # Wide rows with one boolean per panel and one score pair per metric, turned long by the library.
    wide = long_pairs(spark, sf).groupBy("id", "grp", "stratum", "dist").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in "ab" for s in ("left", "right")]
    )
    wide = materialize(wide.withColumn("k", F.lit(1)))
    med = quantile.quantiles(wide.filter("stratum != 'ECONOMY'"), ["k"], "dist", "id", {"med": 0.5}).first()["med"]
    wide = wide.withColumns(
        {"P0": F.lit(True), "P1": F.col("stratum") != "ECONOMY",
         "P2": (F.col("stratum") != "ECONOMY") & (F.col("dist") <= F.lit(med))}
    )
    rows = long_metrics(
        long_panels(wide, ["P0", "P1", "P2"]), {m: (f"{m}_left", f"{m}_right") for m in "ab"}
    )
    return rows.groupBy(*PM).agg(
        F.count("*").alias("n"), F.countDistinct("grp").alias("groups"), F.sum("dist").alias("dist")
    )


@query(
    "raw_value_summary",
    f"""WITH {PANELS}, {STACK}
    SELECT panel, metric, side, count(*) AS n, round(avg(value), 4) + 0.0 AS mean, round(stddev_samp(value), 4) + 0.0 AS std,
           count(*) FILTER (WHERE value = 0) AS zero_count, {RAW_Q} FROM sides GROUP BY panel, metric, side""",
)
def _(spark, sf):
    out = summary.raw_value_summary(panel_pairs(spark, sf), PM)
    return rounded(out, "mean", "std", *summary.RAW_PROBS, digits=4)


@query(
    "pair_difference_summary",
    f"""WITH {PANELS}, d AS (SELECT panel, metric, abs("left" - "right") AS a,
          2.0 * abs("left" - "right") / nullif(abs("left") + abs("right"), 0) AS r,
          log10(abs(nullif("left", 0)) / abs(nullif("right", 0))) AS g FROM panel_pairs WHERE {FINITE})
    SELECT panel, metric, count(*) AS n, round(avg(a), 4) + 0.0 AS absolute_difference_mean,
      {QC.format(v='a', p=0.5, d=4, a='absolute_difference_median')}, {QC.format(v='a', p=0.95, d=4, a='absolute_difference_q95')},
      {QC.format(v='r', p=0.5, d=9, a='symmetric_relative_difference_median')},
      {QC.format(v='r', p=0.95, d=9, a='symmetric_relative_difference_q95')},
      {QC.format(v='g', p=0.5, d=9, a='log10_abs_ratio_median')}, {QC.format(v='g', p=0.05, d=9, a='log10_abs_ratio_q05')},
      {QC.format(v='g', p=0.95, d=9, a='log10_abs_ratio_q95')}
    FROM d GROUP BY panel, metric""",
)
def _(spark, sf):
    out = summary.pair_difference_summary(panel_pairs(spark, sf), PM)
    out = rounded(
        out, "absolute_difference_mean", "absolute_difference_median", "absolute_difference_q95", digits=4
    )
    return rounded(
        out, "symmetric_relative_difference_median", "symmetric_relative_difference_q95", "log10_abs_ratio_median",
        "log10_abs_ratio_q05", "log10_abs_ratio_q95",
    )


THRESHOLDS = [25000.0, 35000.0, 50000.0]
THR = ", ".join(map(str, THRESHOLDS))
CONTINGENCY = f"""
pts AS (SELECT 'c' AS metric, id, "left" * 2500 AS l, "right" / 30 AS r FROM pairs_cust WHERE {FINITE}),
cells AS (SELECT metric, threshold, CAST(count(*) AS DOUBLE) AS n,
            count(*) FILTER (WHERE l > threshold AND r > threshold) AS b, count(*) FILTER (WHERE l > threshold AND r <= threshold) AS lo,
            count(*) FILTER (WHERE l <= threshold AND r > threshold) AS ro, count(*) FILTER (WHERE l <= threshold AND r <= threshold) AS ne
          FROM pts, (SELECT CAST(unnest([{THR}]) AS DOUBLE) AS threshold) GROUP BY metric, threshold)"""


def scaled_customers(spark, sf):
    """Customers with both scores brought to one scale, so that thresholds cut both."""
    p = pairs_cust(spark, sf).withColumn("metric", F.lit("c"))
    return p.withColumns({"left": F.col("left") * 2500, "right": F.col("right") / 30})


@query(
    "threshold_screening",
    f"""WITH {CUST}, {CONTINGENCY}, rates AS (
      SELECT *, (b + ne) / n AS po, (2.0 * b + lo + ro) / (2.0 * n) AS py FROM cells)
    SELECT metric, threshold, b AS "both", lo AS left_only, ro AS right_only, ne AS neither,
      round(po, 9) + 0.0 AS agreement, round((lo + ro) / n, 9) + 0.0 AS crossing_rate, round(py, 9) + 0.0 AS prevalence,
      round(b / nullif(b + ro, 0), 9) + 0.0 AS precision_left_ref, round(b / nullif(b + lo, 0), 9) + 0.0 AS recall_left_ref,
      round(b / nullif(b + lo, 0), 9) + 0.0 AS precision_right_ref, round(b / nullif(b + ro, 0), 9) + 0.0 AS recall_right_ref,
      round((po - py) / (1 - py), 9) + 0.0 AS adjusted_agreement,
      round((po - (py * py + (1 - py) * (1 - py))) / (1 - (py * py + (1 - py) * (1 - py))), 9) + 0.0 AS cohen_kappa,
      round(coalesce((CAST(b AS DOUBLE) * ne - CAST(lo AS DOUBLE) * ro)
        / nullif(sqrt(CAST(b + ro AS DOUBLE) * (b + lo) * (ne + ro) * (ne + lo)), 0), 0), 9) + 0.0 AS mcc
    FROM rates""",
)
def _(spark, sf):
    out = summary.threshold_screening(scaled_customers(spark, sf), ["metric"], THRESHOLDS)
    return rounded(
        out, "agreement", "crossing_rate", "prevalence", "precision_left_ref", "recall_left_ref",
        "precision_right_ref", "recall_right_ref", "adjusted_agreement", "cohen_kappa", "mcc",
    )


@query(
    "consensus_summary",
    f"""WITH {CUST}, {CONTINGENCY}
    SELECT metric, threshold, count(*) FILTER (WHERE l > threshold AND r > threshold) AS consensus_high,
      count(*) FILTER (WHERE least(l, r) < threshold AND greatest(l, r) > threshold) AS disputed,
      count(*) FILTER (WHERE l <= threshold AND r <= threshold) AS consensus_low,
      count(*) FILTER (WHERE l > threshold AND r <= threshold) AS left_only_high,
      count(*) FILTER (WHERE l <= threshold AND r > threshold) AS right_only_high
    FROM pts, (SELECT CAST(unnest([{THR}]) AS DOUBLE) AS threshold) GROUP BY metric, threshold""",
)
def _(spark, sf):
    return summary.consensus_summary(scaled_customers(spark, sf), ["metric"], THRESHOLDS)


@query(
    "consensus_flags",
    f"""WITH {CUST}, {CONTINGENCY}
    SELECT id, round(least(l, r), 4) + 0.0 AS interval_low, round(greatest(l, r), 4) + 0.0 AS interval_high,
      l > 35000 AND r > 35000 AS consensus_high, least(l, r) < 35000 AND greatest(l, r) > 35000 AS disputed,
      l <= 35000 AND r <= 35000 AS consensus_low FROM pts""",
)
def _(spark, sf):
    out = summary.consensus_flags(scaled_customers(spark, sf), 35000.0)
    return rounded(
        out.select("id", "interval_low", "interval_high", "consensus_high", "disputed", "consensus_low"),
        "interval_low", "interval_high", digits=4,
    )


POSITIVE = f"""pos AS (SELECT * FROM panel_pairs WHERE {FINITE} AND "left" > 0 AND "right" > 0)"""


@query(
    "scale_summary",
    f"""WITH {PANELS}, {POSITIVE}
    SELECT panel, metric, count(*) AS n_positive, {QC.format(v='"left"', p=0.5, d=4, a='left_median')},
      {QC.format(v='"right"', p=0.5, d=4, a='right_median')}, {QC.format(v='"right" / "left"', p=0.5, d=4, a='median_ratio')},
      round(avg(ln("right") - ln("left")), 9) + 0.0 AS mean_log_ratio,
      {QC.format(v='ln("right") - ln("left")', p=0.5, d=9, a='median_log_ratio')}
    FROM pos GROUP BY panel, metric""",
)
def _(spark, sf):
    out = summary.scale_summary(panel_pairs(spark, sf), PM)
    out = rounded(out, "left_median", "right_median", "median_ratio", digits=4)
    return rounded(out, "mean_log_ratio", "median_log_ratio")


@query(
    "ks_statistic",
    f"""WITH {PANELS}, {STACK},
    v AS (SELECT panel, metric, value, count(*) FILTER (WHERE side = 'left') AS l, count(*) FILTER (WHERE side = 'right') AS r
          FROM sides GROUP BY ALL),
    c AS (SELECT panel, metric, sum(l) OVER w / sum(l) OVER t AS fl, sum(r) OVER w / sum(r) OVER t AS fr FROM v
          WINDOW w AS (PARTITION BY panel, metric ORDER BY value), t AS (PARTITION BY panel, metric))
    SELECT panel, metric, round(max(abs(fl - fr)), 9) + 0.0 AS ks FROM c GROUP BY panel, metric""",
)
def _(spark, sf):
    out = correlation.ks_statistic(finite_pairs(panel_pairs(spark, sf)), PM)
    return rounded(out, "ks").select(*PM, "ks")


# Sides on one scale, so that the tail is not zero: rank shares, slightly bent on the right.
@query(
    "ks_test",
    f"""WITH {PANELS}, {ranked_sql('panel_pairs', 'panel, metric')},
    sides AS (SELECT panel, metric, 'left' AS side, l_pos / n AS value FROM ranked UNION ALL SELECT panel, metric, 'right', pow(r_pos / n, 1.05) FROM ranked),
    v AS (SELECT panel, metric, value, count(*) FILTER (WHERE side = 'left') AS l, count(*) FILTER (WHERE side = 'right') AS r FROM sides GROUP BY ALL),
    c AS (SELECT panel, metric, sum(l) OVER w / sum(l) OVER t AS fl, sum(r) OVER w / sum(r) OVER t AS fr, sum(l) OVER t AS nl, sum(r) OVER t AS nr FROM v
          WINDOW w AS (PARTITION BY panel, metric ORDER BY value), t AS (PARTITION BY panel, metric)),
    s AS (SELECT panel, metric, max(abs(fl - fr)) AS ks, max(nl) AS nl, max(nr) AS nr FROM c GROUP BY panel, metric),
    j AS (SELECT *, unnest(range(1, 101)) AS j, sqrt(nl * nr / (nl + nr)) * ks AS t FROM s)
    SELECT panel, metric, round(any_value(ks), 9) + 0.0 AS ks, round(least(1, greatest(0, 2 * sum(pow(-1, j - 1) * exp(-2 * pow(j * t, 2))))), 7) + 0.0 AS pvalue
    FROM j GROUP BY panel, metric""",
)
def _(spark, sf):
    ranked = rank_both(panel_pairs(spark, sf), PM)
    rows = ranked.selectExpr(*PM, "id", "l_pos / n AS left", "pow(r_pos / n, 1.05D) AS right")
    out = correlation.ks_statistic(rows, PM)
    out = out.withColumn("pvalue", ks_tail("ks", F.col("n_left").cast("double"), F.col("n_right").cast("double")))
    return out.select(*PM, r9("ks").alias("ks"), r9("pvalue", 7).alias("pvalue"))


@query(
    "quantile_mapping_error",
    f"""WITH {PANELS}, p AS (SELECT CAST(i AS DOUBLE) / 100.0 AS p FROM range(1, 100) t(i)),
    q AS (SELECT panel, metric, [CAST(i AS DOUBLE) / 100.0 FOR i IN range(1, 100)] AS ps,
            quantile_cont("left", [{', '.join(str(i / 100) for i in range(1, 100))}]) AS ql,
            quantile_cont("right", [{', '.join(str(i / 100) for i in range(1, 100))}]) AS qr
          FROM panel_pairs WHERE {FINITE} GROUP BY panel, metric),
    u AS (SELECT panel, metric, unnest(ql) AS a, unnest(qr) AS b FROM q)
    SELECT panel, metric, round(avg(abs(a - b)), 4) + 0.0 AS quantile_mapping_error FROM u GROUP BY panel, metric""",
)
def _(spark, sf):
    out = distribution.quantile_mapping_error(finite_pairs(panel_pairs(spark, sf)), PM)
    return rounded(out, "quantile_mapping_error", digits=4)


@query(
    "tied_rows",
    f"""WITH {PANELS}, f AS (SELECT panel, metric, count(*) OVER (PARTITION BY panel, metric, "left") AS cl,
                              count(*) OVER (PARTITION BY panel, metric, "right") AS cr FROM panel_pairs WHERE {FINITE})
    SELECT panel, metric, count(*) FILTER (WHERE cl > 1) AS tied_left, count(*) FILTER (WHERE cr > 1) AS tied_right
    FROM f GROUP BY panel, metric""",
)
def _(spark, sf):
    return distribution.tied_rows(finite_pairs(panel_pairs(spark, sf)), PM)


@query(
    "distribution_summary",
    f"""WITH {PANELS}, d AS (SELECT panel, metric, stratum, abs("left" - "right") AS v FROM panel_pairs WHERE {FINITE})
    SELECT panel, metric, stratum, count(*) AS n, round(avg(v), 4) + 0.0 AS mean, round(stddev_pop(v), 4) + 0.0 AS std,
      {', '.join(QC.format(v='v', p=p, d=4, a=a) for a, p in summary.DISCREPANCY_PROBS.items())}
    FROM d GROUP BY panel, metric, stratum""",
)
def _(spark, sf):
    rows = finite_pairs(panel_pairs(spark, sf)).withColumn("v", F.abs(F.col("left") - F.col("right")))
    out = summary.distribution_summary(rows, [*PM, "stratum"], "v", "id")
    return rounded(out, "mean", "std", *summary.DISCREPANCY_PROBS, digits=4)


@query(
    "winsorized_log",
    f"""WITH {PANELS}, e AS (SELECT panel, metric, quantile_cont("left", 0.05) AS ll, quantile_cont("left", 0.95) AS lh,
                               quantile_cont("right", 0.05) AS rl, quantile_cont("right", 0.95) AS rh FROM panel_pairs GROUP BY ALL)
    SELECT panel, metric, id, round(ln(0.0001 + greatest(ll, least(lh, "left"))), 9) + 0.0 AS "left",
           round(ln(0.0001 + greatest(rl, least(rh, "right"))), 9) + 0.0 AS "right"
    FROM panel_pairs JOIN e USING (panel, metric) WHERE {FINITE}""",
)
def _(spark, sf):
    out = summary.log_scores(summary.winsorized(panel_pairs(spark, sf), PM))
    return rounded(finite_pairs(out).select(*PM, "id", "left", "right"), "left", "right")


@query(
    "quantile_bins",
    f"""WITH {LONG}, f AS (SELECT * FROM long_pairs WHERE {FINITE}),
    c AS (SELECT metric, quantile_cont(("left" + "right") / 2, 0.25) AS a, quantile_cont(("left" + "right") / 2, 0.5) AS b,
            quantile_cont(("left" + "right") / 2, 0.75) AS c, quantile_cont(dist, 1/3.0) AS t1, quantile_cont(dist, 2/3.0) AS t2
          FROM f GROUP BY metric),
    p AS (SELECT *, count(*) OVER (PARTITION BY metric) AS n, row_number() OVER (PARTITION BY metric ORDER BY dist, id) AS pos FROM f)
    SELECT p.metric, id, CASE WHEN ("left" + "right") / 2 <= a THEN 'Q1' WHEN ("left" + "right") / 2 <= b THEN 'Q2'
             WHEN ("left" + "right") / 2 <= c THEN 'Q3' ELSE 'Q4' END AS response_quartile,
           CASE WHEN dist <= t1 THEN 'tight' WHEN dist <= t2 THEN 'medium' ELSE 'loose' END AS distance_tercile,
           CAST(ceil(pos * 5.0 / n) AS BIGINT) AS distance_quintile
    FROM p JOIN c USING (metric)""",
)
def _(spark, sf):
    from tandemrank.operators import strata

    return strata.quantile_bins(finite_pairs(long_pairs(spark, sf)), ["metric"]).select(
        "metric", "id", "response_quartile", "distance_tercile", "distance_quintile"
    )


@query(
    "scale_order_tail",
    f"""WITH {PANELS}, {POSITIVE}, {ranked_sql('pos', 'panel, metric')},
    k AS (SELECT *, CAST(greatest(1, floor(10.0 / 100.0 * n)) AS BIGINT) AS k FROM ranked),
    cell AS (SELECT panel, metric, max(n) AS n_positive, max(k) AS k, count(*) FILTER (WHERE l_pos <= k AND r_pos <= k) AS b,
               round(corr(l_avg, r_avg), 9) + 0.0 AS rho, round(avg(abs(l_avg - r_avg)), 6) + 0.0 AS mean_shift,
               round(median("right" / "left"), 4) + 0.0 AS median_ratio FROM k GROUP BY panel, metric),
    pairwise AS (SELECT panel, metric, count(*) AS pairs, sum(CASE WHEN a."left" = b."left" THEN 1 ELSE 0 END) AS tl,
                   sum(CASE WHEN a."right" = b."right" THEN 1 ELSE 0 END) AS tr,
                   sum(sign(a."left" - b."left") * sign(a."right" - b."right")) AS s
                 FROM pos a JOIN pos b USING (panel, metric) WHERE a.id < b.id GROUP BY panel, metric)
    SELECT panel, metric, n_positive, rho, mean_shift, median_ratio, 2 * (k - b) AS crossings,
      round(s / (sqrt(pairs - tl) * sqrt(pairs - tr)), 9) + 0.0 AS tau,
      round(((1 - 2.0 * (k - b) / n_positive) - (pow(k / n_positive, 2) + pow(1 - k / n_positive, 2)))
            / (1 - (pow(k / n_positive, 2) + pow(1 - k / n_positive, 2))), 9) + 0.0 AS kappa_at_tail
    FROM cell JOIN pairwise USING (panel, metric)""",
)
def _(spark, sf):
    from tandemrank.plans.decomposition import scale_order_tail

    out = scale_order_tail(panel_pairs(spark, sf), PM)
    out = out.withColumns({"mean_shift": r9("mean_shift", 6), "median_ratio": r9("median_ratio", 4)})
    return rounded(out, "rho", "tau", "kappa_at_tail").select(
        *PM, "n_positive", "rho", "mean_shift", "median_ratio", "crossings", "tau", "kappa_at_tail"
    )
