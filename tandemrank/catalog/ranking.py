"""Ranks, overlap curves, ties, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemrank.catalog.registry import query, r9, rounded
from tandemrank.catalog.views import (
    CUST, FINITE, LONG, PANELS, PART, curve_sql, long_pairs, panel_pairs, pairs_cust, pairs_part, ranked_sql,
)
from tandemrank.operators import correlation, overlap, retention, tau, ties
from tandemrank.operators.rank import average_rank, percentile_rank, rank_both, rank_shift

PM = ["panel", "metric"]
RANKED = PANELS + "," + ranked_sql("panel_pairs", "panel, metric")
CURVE = RANKED + "," + curve_sql("panel, metric")


@query("positions", f"WITH {RANKED} SELECT panel, metric, id, n, l_pos, r_pos FROM ranked")
def _(spark, sf):
    return rank_both(panel_pairs(spark, sf), PM).select(*PM, "id", "n", "l_pos", "r_pos")


@query("average_ranks", f"WITH {RANKED} SELECT panel, metric, id, l_avg, r_avg FROM ranked")
def _(spark, sf):
    ranked = rank_both(panel_pairs(spark, sf), PM, ties=True)
    return ranked.select(*PM, "id", average_rank("l").alias("l_avg"), average_rank("r").alias("r_avg"))


@query(
    "percentile_ranks",
    f"""WITH {LONG}, {ranked_sql('long_pairs', 'metric')}
    SELECT metric, id, round((n - l_avg) / (n - 1.0), 9) + 0.0 AS unit, round((n + 1.0 - l_avg) / n, 9) + 0.0 AS fraction,
           round(100.0 * l_pos / n, 9) + 0.0 AS pos_pct, round(l_avg / n, 9) + 0.0 AS descending FROM ranked""",
)
def _(spark, sf):
    ranked = rank_both(long_pairs(spark, sf), ["metric"], ties=True)
    kinds = {"unit": "unit", "fraction": "fraction", "position": "pos_pct", "descending": "descending"}
    return ranked.select("metric", "id", *[r9(percentile_rank("l", k)).alias(name) for k, name in kinds.items()])


@query(
    "concordance_curve",
    f"""WITH {CURVE}
    SELECT panel, metric, q, n, k, overlap, round(j, 9) + 0.0 AS observed_jaccard, round(ej, 9) + 0.0 AS expected_jaccard,
           round(adj, 9) + 0.0 AS adjusted_jaccard, round(j / ej, 7) + 0.0 AS enrichment,
           round(mean_shift, 6) + 0.0 AS mean_shift, round(median_shift, 6) + 0.0 AS median_shift
    FROM curve""",
)
def _(spark, sf):
    ranked = rank_both(panel_pairs(spark, sf), PM, ties=True)
    curve = overlap.concordance_curve(ranked, PM, displacement=True)
    curve = rounded(curve, "observed_jaccard", "expected_jaccard", "adjusted_jaccard")
    return curve.select(
        *PM, "q", "n", "k", "overlap", "observed_jaccard", "expected_jaccard", "adjusted_jaccard",
        r9("enrichment", 7).alias("enrichment"), r9("mean_rank_displacement_in_union", 6).alias("mean_shift"),
        r9("median_rank_displacement_in_union", 6).alias("median_shift"),
    )


AREAS = """
steps AS (SELECT *, lag(q) OVER w AS q0, lag(adj) OVER w AS y0 FROM curve WINDOW w AS (PARTITION BY panel, metric ORDER BY q)),
areas AS (
  SELECT panel, metric, sum((q - q0) * (adj + y0) / 2.0) / (max(q) - min(q)) AS naucc,
         sum((q - q0) * (adj + y0) / 2.0) FILTER (WHERE q0 >= 1 AND q <= 10) / 9.0 AS partial_elite,
         sum((q - q0) * (adj + y0) / 2.0) FILTER (WHERE q0 >= 10 AND q <= 30) / 20.0 AS partial_intermediate,
         sum((q - q0) * (adj + y0) / 2.0) FILTER (WHERE q0 >= 30 AND q <= 50) / 20.0 AS partial_broad
  FROM steps GROUP BY panel, metric)"""


@query(
    "curve_summary",
    f"""WITH {CURVE}, {AREAS}
    SELECT panel, metric, round(naucc, 9) + 0.0 AS naucc, round(partial_elite, 9) + 0.0 AS partial_elite,
           round(partial_intermediate, 9) + 0.0 AS partial_intermediate, round(partial_broad, 9) + 0.0 AS partial_broad
    FROM areas""",
)
def _(spark, sf):
    curve = overlap.concordance_curve(rank_both(panel_pairs(spark, sf), PM), PM)
    return rounded(
        overlap.area_summary(curve, PM), "naucc", "partial_elite", "partial_intermediate", "partial_broad"
    )


PAIRWISE = """
pairwise AS (
  SELECT {by}, count(*) AS pairs, sum(CASE WHEN a."left" = b."left" THEN 1 ELSE 0 END) AS tl,
         sum(CASE WHEN a."right" = b."right" THEN 1 ELSE 0 END) AS tr,
         sum(sign(a."left" - b."left") * sign(a."right" - b."right")) AS s
  FROM {src} a JOIN {src} b USING ({by}) WHERE a.id < b.id GROUP BY {by})"""


@query(
    "kendall_tau",
    f"""WITH {RANKED}, {PAIRWISE.format(by='panel, metric', src='ranked')},
    sizes AS (SELECT panel, metric, max(n) AS n FROM ranked GROUP BY panel, metric)
    SELECT panel, metric, n, round(s / (sqrt(pairs - tl) * sqrt(pairs - tr)), 9) + 0.0 AS tau
    FROM pairwise JOIN sizes USING (panel, metric)""",
)
def _(spark, sf):
    return rounded(tau.kendall_tau(panel_pairs(spark, sf), PM), "tau")


def ranked_panels(spark, sf, ties=False):
    return rank_both(panel_pairs(spark, sf), PM, ties=ties)


@query(
    "rank_shift",
    f"""WITH {RANKED}
    SELECT panel, metric, round(avg(abs(l_avg - r_avg)), 6) + 0.0 AS mean_shift,
           round(median(abs(l_avg - r_avg)), 6) + 0.0 AS median_shift,
           round(avg(abs(l_avg - r_avg)) / (max(n) - 1), 9) + 0.0 AS normalized_shift
    FROM ranked GROUP BY panel, metric""",
)
def _(spark, sf):
    out = correlation.shift_summary(ranked_panels(spark, sf, True), PM)
    return out.select(*PM, r9("mean_shift", 6).alias("mean_shift"), r9("median_shift", 6).alias("median_shift"),
                      r9("normalized_shift").alias("normalized_shift"))


@query(
    "onset",
    f"""WITH {CURVE},
    ups AS (SELECT c.*, delta, adj - 0.02 > delta AS up FROM curve c, (SELECT unnest([0.0, 0.05, 0.1]) AS delta)),
    runs AS (SELECT *, bool_and(up) OVER w AND count(*) OVER w = 5 AS run FROM ups
             WINDOW w AS (PARTITION BY panel, metric, delta ORDER BY q ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
    SELECT panel, metric, CAST(delta AS DOUBLE) AS delta, min(q) FILTER (WHERE run) AS persistent_onset,
           min(q) FILTER (WHERE up) AS first_crossing FROM runs GROUP BY panel, metric, delta""",
)
def _(spark, sf):
    curve = overlap.concordance_curve(ranked_panels(spark, sf), PM).withColumn("low", F.col("adjusted_jaccard") - 0.02)
    return overlap.onset(curve, PM, "low", [0.0, 0.05, 0.1])


@query(
    "interpolated_area",
    f"""WITH {CURVE},
    steps AS (SELECT *, lag(q) OVER w AS q0, lag(adj) OVER w AS y0 FROM curve
              WINDOW w AS (PARTITION BY panel, metric ORDER BY q)),
    cut AS (SELECT *, greatest(q0, 2.5) AS a, least(q, 12.25) AS b FROM steps WHERE q0 IS NOT NULL)
    SELECT panel, metric,
           round(sum((b - a) * ((y0 + (adj - y0) * (a - q0) / (q - q0)) + (y0 + (adj - y0) * (b - q0) / (q - q0))) / 2.0)
                 FILTER (WHERE b > a) / 9.75, 9) + 0.0 AS area
    FROM cut GROUP BY panel, metric""",
)
def _(spark, sf):
    curve = overlap.concordance_curve(ranked_panels(spark, sf), PM)
    return rounded(overlap.interpolated_area(curve, PM, 2.5, 12.25, "area"), "area")


@query(
    "topk_membership",
    f"""WITH {RANKED}, k AS (SELECT *, CAST(greatest(1, floor(10.0 / 100.0 * n)) AS BIGINT) AS k FROM ranked)
    SELECT panel, metric, id, l_pos <= k AS in_left, r_pos <= k AS in_right FROM k WHERE least(l_pos, r_pos) <= k""",
)
def _(spark, sf):
    rows = overlap.top_sets(ranked_panels(spark, sf), 10.0)
    return rows.filter("in_left OR in_right").select(*PM, "id", "in_left", "in_right")


QS5 = [1.0, 5.0, 10.0, 20.0, 50.0]
CURVE5 = RANKED + "," + curve_sql("panel, metric", qs="[1, 5, 10, 20, 50]")


@query(
    "topk_measures",
    f"""WITH {CURVE5}
    SELECT panel, metric, q, k, overlap, round(overlap / k, 9) + 0.0 AS precision_at_k,
           round(overlap / k, 9) + 0.0 AS overlap_coefficient, round(j, 9) + 0.0 AS jaccard FROM curve""",
)
def _(spark, sf):
    out = overlap.topk_measures(overlap.overlap_counts(ranked_panels(spark, sf), PM, QS5))
    return rounded(out, "precision_at_k", "overlap_coefficient", "jaccard").select(
        *PM, "q", "k", "overlap", "precision_at_k", "overlap_coefficient", "jaccard"
    )


def _rbo_sql(share: str) -> str:
    return f"""WITH {RANKED},
    depths AS (SELECT panel, metric, n, unnest(range(1, least(n, 800) + 1)) AS d
               FROM (SELECT panel, metric, max(n) AS n FROM ranked GROUP BY panel, metric)),
    hist AS (SELECT panel, metric, greatest(l_pos, r_pos) AS d, count(*) AS c FROM ranked GROUP BY ALL),
    run AS (SELECT d.panel, d.metric, d.n, d.d, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY d.panel, d.metric ORDER BY d.d) AS DOUBLE) AS x
            FROM depths d LEFT JOIN hist h ON h.panel = d.panel AND h.metric = d.metric AND h.d = d.d)
    SELECT panel, metric, round(sum(0.05 * pow(0.95, d - 1) * {share}
           + CASE WHEN d = n THEN pow(0.95, d) * {share} ELSE 0 END), 9) + 0.0 AS rbo
    FROM run GROUP BY panel, metric"""


@query("rank_biased_overlap", _rbo_sql("x / (2.0 * d - x)"))
def _(spark, sf):
    return rounded(overlap.rank_biased_overlap(ranked_panels(spark, sf), PM), "rbo")


@query("rank_biased_overlap_share", _rbo_sql("x / d"))
def _(spark, sf):
    return rounded(overlap.rank_biased_overlap(ranked_panels(spark, sf), PM, agreement="overlap"), "rbo")


CUST_RANKED = CUST + ", cust AS (SELECT *, 'c' AS metric FROM pairs_cust)," + ranked_sql("cust", "metric")


@query(
    "cutoff_diagnostics",
    f"""WITH {CUST_RANKED}, {curve_sql('metric', qs='[1, 5, 10, 20, 50]')},
    cut AS (SELECT c.metric, q, k,
              max("left") FILTER (WHERE l_pos = k) AS lc, max("left") FILTER (WHERE l_pos = k + 1) AS ln,
              max(l_first) FILTER (WHERE l_pos = k) AS lf, max(l_last) FILTER (WHERE l_pos = k) AS ll,
              max("right") FILTER (WHERE r_pos = k) AS rc, max("right") FILTER (WHERE r_pos = k + 1) AS rn,
              max(r_first) FILTER (WHERE r_pos = k) AS rf, max(r_last) FILTER (WHERE r_pos = k) AS rl
            FROM curve c JOIN ranked r ON r.metric = c.metric GROUP BY c.metric, q, k)
    SELECT metric, q, c.k, overlap, round(adj, 9) + 0.0 AS adjusted_jaccard,
           lc AS left_cutoff_score, ln AS left_next_score, round(lc - ln, 9) + 0.0 AS left_absolute_gap,
           round((lc - ln) / abs(lc), 9) + 0.0 AS left_relative_gap, ll - lf + 1 AS left_tie_block_size,
           lf - 1 AS left_mandatory_count, c.k - lf + 1 AS left_optional_needed,
           ll > c.k OR rl > c.k AS tie_ambiguous, round(rc - rn, 4) + 0.0 AS right_absolute_gap,
           rl - rf + 1 AS right_tie_block_size
    FROM cut c JOIN curve USING (metric, q)""",
)
def _(spark, sf):
    ranked = rank_both(pairs_cust(spark, sf).withColumn("metric", F.lit("c")), ["metric"], ties=True)
    out = ties.cutoff_diagnostics(ranked, ["metric"], QS5)
    out = rounded(out, "adjusted_jaccard", "left_absolute_gap", "left_relative_gap")
    return out.withColumn("right_absolute_gap", r9("right_absolute_gap", 4)).select(
        "metric", "q", "k", "overlap", "adjusted_jaccard", "left_cutoff_score", "left_next_score",
        "left_absolute_gap", "left_relative_gap", "left_tie_block_size", "left_mandatory_count",
        "left_optional_needed", "tie_ambiguous", "right_absolute_gap", "right_tie_block_size",
    )


# Extremes by brute force over how many tied rows are shared: every split of the needed rows over the three cells.
@query(
    "tie_bounds",
    f"""WITH {CUST_RANKED}, {curve_sql('metric', qs='[1, 5, 10, 20, 50]')},
    edge AS (SELECT c.metric, q, c.k, max(l_first) FILTER (WHERE l_pos = c.k) AS lf, max(r_first) FILTER (WHERE r_pos = c.k) AS rf
             FROM curve c JOIN ranked r ON r.metric = c.metric GROUP BY c.metric, q, c.k),
    cell AS (SELECT e.metric, q, k, k - max(lf) + 1 AS nl, k - max(rf) + 1 AS nr,
               count(*) FILTER (WHERE l_first < lf AND r_first < rf) AS mm, count(*) FILTER (WHERE l_first = lf AND r_first < rf) AS om,
               count(*) FILTER (WHERE l_first < lf AND r_first = rf) AS mo, count(*) FILTER (WHERE l_first = lf AND r_first = rf) AS oo,
               count(*) FILTER (WHERE l_first = lf AND r_first > rf) AS ox, count(*) FILTER (WHERE l_first > lf AND r_first = rf) AS xo
             FROM edge e JOIN ranked r ON r.metric = e.metric GROUP BY e.metric, q, k),
    lefts AS (SELECT *, unnest(range(0, least(nl, oo) + 1)) AS ul FROM cell),
    picks AS (SELECT *, unnest(range(0, least(nr, oo) + 1)) AS ur FROM lefts),
    ways AS (SELECT *, greatest(0, nl - ul - ox) AS al0, least(om, nl - ul) AS al1,
                    greatest(0, nr - ur - xo) AS ar0, least(mo, nr - ur) AS ar1 FROM picks)
    SELECT metric, q, k, CAST(min(mm + al0 + ar0 + greatest(0, ul + ur - oo)) AS BIGINT) AS min_overlap,
           CAST(max(mm + al1 + ar1 + least(ul, ur)) AS BIGINT) AS max_overlap
    FROM ways WHERE al0 <= al1 AND ar0 <= ar1 GROUP BY metric, q, k""",
)
def _(spark, sf):
    ranked = rank_both(pairs_cust(spark, sf).withColumn("metric", F.lit("c")), ["metric"], ties=True)
    return ties.cutoff_diagnostics(ranked, ["metric"], QS5).select("metric", "q", "k", "min_overlap", "max_overlap")


@query(
    "retention_map",
    f"""WITH {RANKED},
    cell AS (SELECT panel, metric, n, l_pos, r_pos, s.q AS q_source, t.q AS q_target,
                    CAST(greatest(1, floor(s.q / 100.0 * n)) AS BIGINT) AS source_k,
                    CAST(greatest(1, floor(t.q / 100.0 * n)) AS BIGINT) AS target_k
             FROM ranked, (SELECT CAST(unnest([1, 5, 10, 20, 50]) AS DOUBLE) AS q) s,
                  (SELECT CAST(unnest([1, 5, 10, 20, 50]) AS DOUBLE) AS q) t),
    ways AS (SELECT *, 'left_to_right' AS direction, l_pos <= source_k AND r_pos <= target_k AS hit FROM cell
             UNION ALL SELECT *, 'right_to_left', r_pos <= source_k AND l_pos <= target_k FROM cell)
    SELECT panel, metric, direction, q_source, q_target, source_k, target_k, count(*) FILTER (WHERE hit) AS overlap,
           round(count(*) FILTER (WHERE hit) / source_k, 9) + 0.0 AS retention
    FROM ways GROUP BY panel, metric, direction, q_source, q_target, source_k, target_k""",
)
def _(spark, sf):
    return rounded(retention.retention_map(ranked_panels(spark, sf), PM), "retention")


@query(
    "boundary_risk",
    f"""WITH {RANKED},
    rows AS (SELECT panel, metric, q, 100.0 * l_pos / n - q AS d, (l_pos <= k) <> (r_pos <= k) AS differs
             FROM (SELECT *, CAST(greatest(1, floor(q / 100.0 * n)) AS BIGINT) AS k
                   FROM ranked, (SELECT CAST(unnest([5, 10, 20]) AS DOUBLE) AS q))),
    bins AS (SELECT * FROM (VALUES ('(-inf,-20]', -1e9, -20), ('(-20,-10]', -20, -10), ('(-10,-5]', -10, -5),
             ('(-5,-2]', -5, -2), ('(-2,0]', -2, 0), ('(0,2]', 0, 2), ('(2,5]', 2, 5), ('(5,10]', 5, 10),
             ('(10,20]', 10, 20), ('(20,inf)', 20, 1e9)) v(distance_bin, lo, hi)),
    frame AS (SELECT DISTINCT panel, metric, q, distance_bin, lo, hi FROM rows, bins)
    SELECT f.panel, f.metric, f.q, distance_bin, nullif(CAST(lo AS DOUBLE), -1e9) AS bin_low, nullif(CAST(hi AS DOUBLE), 1e9) AS bin_high, count(d) AS n, count(*) FILTER (WHERE differs) AS disagreements,
           round(count(*) FILTER (WHERE differs) / nullif(count(d), 0), 9) + 0.0 AS disagreement_rate
    FROM frame f LEFT JOIN rows r ON r.panel = f.panel AND r.metric = f.metric AND r.q = f.q AND d > lo AND d <= hi
    GROUP BY ALL""",
)
def _(spark, sf):
    return rounded(retention.boundary_risk(ranked_panels(spark, sf), PM), "disagreement_rate")


@query(
    "consensus_counts",
    f"""WITH {RANKED}, k AS (SELECT *, CAST(greatest(1, floor(q / 100.0 * n)) AS BIGINT) AS k
                             FROM ranked, (SELECT CAST(unnest([5, 10, 20]) AS DOUBLE) AS q))
    SELECT panel, metric, q, k, count(*) FILTER (WHERE l_pos <= k AND r_pos <= k) AS "both",
           count(*) FILTER (WHERE l_pos <= k AND r_pos > k) AS left_only,
           count(*) FILTER (WHERE l_pos > k AND r_pos <= k) AS right_only,
           count(*) FILTER (WHERE l_pos > k AND r_pos > k) AS neither,
           count(*) FILTER (WHERE (l_pos <= k) <> (r_pos <= k)) AS crossings FROM k GROUP BY ALL""",
)
def _(spark, sf):
    return retention.consensus_counts(ranked_panels(spark, sf), PM)


@query(
    "null_expectation",
    f"""WITH {CURVE}, tail AS (SELECT panel, metric, q, sum(p) FILTER (WHERE x >= overlap) / sum(p) AS pv
                               FROM curve c JOIN curve_null_pmf USING (n, k) GROUP BY panel, metric, q)
    SELECT panel, metric, q, round(ej, 9) + 0.0 AS expected_jaccard, round(pv, 8) + 0.0 AS pvalue,
           round(k * k / n / (2.0 * k - k * k / n), 9) + 0.0 AS plugin_jaccard
    FROM curve JOIN tail USING (panel, metric, q)""",
)
def _(spark, sf):
    from tandemrank.functions.null_model import with_null

    counts = overlap.overlap_counts(ranked_panels(spark, sf), PM, overlap.Q_GRID)
    plug = with_null(counts, plugin=True).withColumnRenamed("expected_jaccard", "plugin_jaccard")
    out = with_null(plug.drop("hypergeometric_pvalue"))
    return out.select(
        *PM, "q", r9("expected_jaccard").alias("expected_jaccard"), r9("hypergeometric_pvalue", 8).alias("pvalue"),
        r9("plugin_jaccard").alias("plugin_jaccard"),
    )


@query(
    "spearman",
    f"""WITH {RANKED} SELECT panel, metric, max(n) AS n, round(corr(l_avg, r_avg), 9) + 0.0 AS rho
    FROM ranked GROUP BY panel, metric""",
)
def _(spark, sf):
    return rounded(correlation.spearman(ranked_panels(spark, sf, True), PM), "rho")


@query(
    "pearson",
    f"""WITH {PANELS} SELECT panel, metric, count(*) AS n, round(corr("left", "right"), 9) + 0.0 AS r
    FROM panel_pairs WHERE {FINITE} GROUP BY panel, metric""",
)
def _(spark, sf):
    from tandemrank.frame import finite_pairs

    return rounded(correlation.pearson(finite_pairs(panel_pairs(spark, sf)), PM), "r")


@query(
    "tail_agreement",
    f"""WITH {CUST_RANKED},
    tail AS (SELECT id, q, "left", "right" FROM ranked, (SELECT CAST(unnest([5, 10, 20]) AS DOUBLE) AS q)
             WHERE least(l_pos, r_pos) <= CAST(greatest(1, floor(q / 100.0 * n)) AS BIGINT)),
    {ranked_sql('tail', 'q', 'inner_ranks')[1:]}, {PAIRWISE.format(by='q', src='tail')},
    rho AS (SELECT q, max(n) AS n_union, corr(l_avg, r_avg) AS rho FROM inner_ranks GROUP BY q)
    SELECT 'c' AS metric, q, n_union, round(rho, 9) + 0.0 AS tail_rho,
           round(s / (sqrt(pairs - tl) * sqrt(pairs - tr)), 9) + 0.0 AS tail_tau FROM rho JOIN pairwise USING (q)""",
)
def _(spark, sf):
    ranked = rank_both(pairs_cust(spark, sf).withColumn("metric", F.lit("c")), ["metric"])
    return rounded(correlation.tail_agreement(ranked, ["metric"], [5.0, 10.0, 20.0]), "tail_rho", "tail_tau")


@query(
    "kendall_tau_ties",
    f"""WITH {CUST_RANKED}, {PAIRWISE.format(by='metric', src='ranked')}
    SELECT metric, (SELECT max(n) FROM ranked) AS n, round(s / (sqrt(pairs - tl) * sqrt(pairs - tr)), 9) + 0.0 AS tau
    FROM pairwise""",
)
def _(spark, sf):
    # Small blocks, so that the many-task path runs on these tables too.
    pairs = pairs_cust(spark, sf).withColumn("metric", F.lit("c"))
    return rounded(tau.kendall_tau(pairs, ["metric"], size=100), "tau")


@query("kendall_test")
def _(spark, sf):
    return tau.kendall_test(panel_pairs(spark, sf), PM)


@query("spearman_test")
def _(spark, sf):
    return correlation.spearman_test(ranked_panels(spark, sf, True), PM)


@query(
    "step_up_fdr",
    f"""WITH {CURVE}, tail AS (SELECT panel, metric, q, sum(p) FILTER (WHERE x >= overlap) / sum(p) AS pv
                               FROM curve c JOIN curve_null_pmf USING (n, k) GROUP BY panel, metric, q),
    step AS (SELECT *, pv * count(*) OVER (PARTITION BY panel, metric) / row_number() OVER w AS x, row_number() OVER w AS r
             FROM tail WINDOW w AS (PARTITION BY panel, metric ORDER BY pv))
    SELECT panel, metric, q, round(least(1.0, min(x) OVER (PARTITION BY panel, metric ORDER BY r DESC)), 8) + 0.0 AS qvalue
    FROM step""",
)
def _(spark, sf):
    curve = overlap.concordance_curve(ranked_panels(spark, sf), PM)
    out = retention.step_up_fdr(curve, PM, "hypergeometric_pvalue")
    return out.select(*PM, "q", r9("qvalue", 8).alias("qvalue"))


@query(
    "covariate_mismatch",
    f"""WITH {PART}, one AS (SELECT *, 'a' AS metric FROM pairs_part),
    {ranked_sql('one', 'metric')[1:]}, moved AS (SELECT id, metric, dist AS "left", abs(l_avg - r_avg) AS "right" FROM ranked),
    {ranked_sql('moved', 'metric', 'again')[1:]}, {PAIRWISE.format(by='metric', src='moved')}
    SELECT metric, (SELECT max(n) FROM again) AS n, (SELECT round(corr(l_avg, r_avg), 9) + 0.0 FROM again) AS rho,
           round(s / (sqrt(pairs - tl) * sqrt(pairs - tr)), 9) + 0.0 AS tau FROM pairwise""",
)
def _(spark, sf):
    ranked = rank_both(pairs_part(spark, sf).withColumn("metric", F.lit("a")), ["metric"], ties=True)
    return rounded(correlation.covariate_agreement(ranked, ["metric"], "dist", rank_shift()), "rho", "tau")
