"""Bootstraps, bands and permutations, on few replicates; the SQL expands copies explicitly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemrank.catalog.registry import query, rounded
from tandemrank.catalog.views import FINITE, LONG, long_pairs, null_sql, ranked_sql
from tandemrank.frame import finite_pairs
from tandemrank.operators import overlap, resample
from tandemrank.operators.rank import rank_both

B, SEED = 8, 42
M = ["metric"]


def h_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def draws_sql(source: str, unit: str, by: str = "metric", reps: int = B, seed: int = SEED, name: str = "draws") -> str:
    return f"""
{name}_units AS (SELECT {by}, {unit} AS unit, row_number() OVER (PARTITION BY {by} ORDER BY {unit}) - 1 AS idx,
                        count(*) OVER (PARTITION BY {by}) AS g FROM {source} WHERE {unit} IS NOT NULL GROUP BY {by}, {unit}),
{name}_slots AS (SELECT {by}, rep, {h_sql(str(seed), 'rep', 'idx')} % g AS idx FROM {name}_units, range({reps}) r(rep)),
{name} AS (SELECT s.{by}, rep, t.unit, count(*) AS w FROM {name}_slots s JOIN {name}_units t ON t.{by} = s.{by} AND t.idx = s.idx
           GROUP BY s.{by}, rep, t.unit)"""


F_LONG = LONG + f", f AS (SELECT * FROM long_pairs WHERE {FINITE})"
COPIES = """
copies AS (SELECT f.metric, rep, id, grp, "left", "right", unnest(range(w)) AS copy FROM f JOIN draws d ON d.metric = f.metric AND d.unit = f.{unit}),
placed AS (SELECT *, row_number() OVER (PARTITION BY metric, rep ORDER BY "left" DESC, id, copy) AS l_pos,
                  row_number() OVER (PARTITION BY metric, rep ORDER BY "right" DESC, id, copy) AS r_pos,
                  count(*) OVER (PARTITION BY metric, rep) AS nb FROM copies),
base AS (SELECT metric, count(*) AS n FROM f GROUP BY metric)"""
QS = "(SELECT CAST(unnest(range(1, 51)) AS DOUBLE) AS q)"


def curves_sql(fixed: bool) -> str:
    n = "base.n" if fixed else "nb"
    return f"""
counts AS (SELECT metric, rep, q, n, k, count(*) FILTER (WHERE greatest(l_pos, r_pos) <= k) AS overlap
           FROM (SELECT metric, rep, q, l_pos, r_pos, {n} AS n, CAST(greatest(1, floor(q / 100.0 * {n})) AS BIGINT) AS k
                 FROM placed JOIN base USING (metric), {QS}) GROUP BY metric, rep, q, n, k),{null_sql('counts')},
boot AS (SELECT metric, rep, q, k, n, overlap, (overlap / (2.0 * k - overlap) - ej) / (1.0 - ej) AS adj
         FROM counts JOIN nulls USING (n, k)),
boot_steps AS (SELECT *, lag(q) OVER w AS q0, lag(adj) OVER w AS y0 FROM boot WINDOW w AS (PARTITION BY metric, rep ORDER BY q)),
boot_area AS (SELECT metric, rep, sum((q - q0) * (adj + y0) / 2.0) / (max(q) - min(q)) AS naucc,
                sum((q - q0) * (adj + y0) / 2.0) FILTER (WHERE q <= 10) / 9.0 AS elite FROM boot_steps GROUP BY metric, rep)"""


def weighted_tau(src: str, by: str) -> str:
    """tau-b of rows with multiplicity w: copies of one row are tied on both sides."""
    return f"""
wp AS (SELECT {by}, sum(a.w * b.w) AS pairs, sum(CASE WHEN a."left" = b."left" THEN a.w * b.w ELSE 0 END) AS tl,
         sum(CASE WHEN a."right" = b."right" THEN a.w * b.w ELSE 0 END) AS tr,
         sum(sign(a."left" - b."left") * sign(a."right" - b."right") * a.w * b.w) AS s
       FROM {src} a JOIN {src} b USING ({by}) WHERE a.id < b.id GROUP BY {by}),
ws AS (SELECT {by}, sum(w) AS n, sum(w * (w - 1) / 2) AS own FROM {src} GROUP BY {by}),
taus AS (SELECT {by}, n, s / (sqrt(pairs - tl) * sqrt(pairs - tr)) AS tau
         FROM (SELECT {by}, n, s, pairs + own AS pairs, tl + own AS tl, tr + own AS tr FROM wp JOIN ws USING ({by})))"""


WEIGHTED = """wf AS (SELECT f.metric, rep, id, "left", "right", w FROM f JOIN draws d ON d.metric = f.metric AND d.unit = f.{unit})"""


@query(
    "cluster_draws",
    f"WITH {F_LONG}, {draws_sql('f', 'grp')} SELECT metric, rep, unit AS grp, w FROM draws",
)
def _(spark, sf):
    rows = finite_pairs(long_pairs(spark, sf))
    return resample.cluster_draws(rows, M, "grp", B, SEED).selectExpr("metric", "CAST(rep AS BIGINT) AS rep", "grp", "w")


@query(
    "row_bootstrap_tau",
    f"""WITH {F_LONG}, {draws_sql('f', 'id')}, {WEIGHTED.format(unit='id')}, {weighted_tau('wf', 'metric, rep')}
    SELECT metric, rep, CAST(n AS BIGINT) AS n, round(tau, 9) + 0.0 AS tau FROM taus""",
)
def _(spark, sf):
    out = resample.bootstrap_tau(long_pairs(spark, sf), M, "id", B, SEED)
    return rounded(out.withColumn("rep", F.col("rep").cast("bigint")), "tau")


@query(
    "cluster_bootstrap_tau",
    f"""WITH {F_LONG}, {draws_sql('f', 'grp')}, {WEIGHTED.format(unit='grp')}, {weighted_tau('wf', 'metric, rep')}
    SELECT metric, round(quantile_cont(tau, 0.025), 9) + 0.0 AS tau_ci95_low, round(quantile_cont(tau, 0.975), 9) + 0.0 AS tau_ci95_high
    FROM taus GROUP BY metric""",
)
def _(spark, sf):
    reps = resample.bootstrap_tau(long_pairs(spark, sf), M, "grp", B, SEED)
    return rounded(resample.percentile_ci(reps, M, "tau", B, "tau_ci95"), "tau_ci95_low", "tau_ci95_high")


@query(
    "cluster_bootstrap_curves",
    f"""WITH {F_LONG}, {draws_sql('f', 'grp')}, {COPIES.format(unit='grp')}, {curves_sql(False)}
    SELECT metric, rep, q, n, k, overlap, round(adj, 9) + 0.0 AS adjusted_jaccard FROM boot""",
)
def _(spark, sf):
    ranked = rank_both(long_pairs(spark, sf), M)
    out = resample.bootstrap_curves(ranked, M, "grp", B, SEED, null="recomputed")
    return rounded(out, "adjusted_jaccard").selectExpr(
        "metric", "CAST(rep AS BIGINT) AS rep", "q", "n", "k", "overlap", "adjusted_jaccard"
    )


@query(
    "cluster_bootstrap_naucc",
    f"""WITH {F_LONG}, {draws_sql('f', 'grp')}, {COPIES.format(unit='grp')}, {curves_sql(True)}
    SELECT metric, round(quantile_cont(naucc, 0.025), 9) + 0.0 AS naucc_ci95_low,
           round(quantile_cont(naucc, 0.975), 9) + 0.0 AS naucc_ci95_high FROM boot_area GROUP BY metric""",
)
def _(spark, sf):
    ranked = rank_both(long_pairs(spark, sf), M)
    reps = resample.bootstrap_naucc(ranked, M, "grp", B, SEED)
    return rounded(resample.percentile_ci(reps, M, "naucc", B, "naucc_ci95"), "naucc_ci95_low", "naucc_ci95_high")


OBSERVED = ranked_sql("f", "metric") + f""",
obs_counts AS (SELECT metric, q, n, k, count(*) FILTER (WHERE greatest(l_pos, r_pos) <= k) AS overlap
               FROM (SELECT *, CAST(greatest(1, floor(q / 100.0 * n)) AS BIGINT) AS k FROM ranked, {QS}) GROUP BY metric, q, n, k),
{null_sql('obs_counts', 'obs_null')},
obs AS (SELECT metric, q, (overlap / (2.0 * k - overlap) - ej) / (1.0 - ej) AS adj FROM obs_counts JOIN obs_null USING (n, k)),
se AS (SELECT metric, q, greatest(stddev_samp(adj), 1e-12) AS se FROM boot GROUP BY metric, q),
sup AS (SELECT b.metric, rep, max(abs(b.adj - o.adj) / se) AS sup FROM boot b JOIN obs o USING (metric, q) JOIN se USING (metric, q)
        GROUP BY b.metric, rep),
crit AS (SELECT metric, quantile_cont(sup, 0.95) AS crit FROM sup GROUP BY metric),
band AS (SELECT metric, q, greatest(-1, least(1, adj - crit * se)) AS lo, greatest(-1, least(1, adj + crit * se)) AS hi
         FROM obs JOIN se USING (metric, q) JOIN crit USING (metric))"""


@query(
    "simultaneous_band",
    f"""WITH {F_LONG}, {draws_sql('f', 'id')}, {COPIES.format(unit='id')}, {curves_sql(True)}, {OBSERVED}
    SELECT metric, q, round(lo, 8) + 0.0 AS band_low, round(hi, 8) + 0.0 AS band_high FROM band""",
)
def _(spark, sf):
    ranked = rank_both(long_pairs(spark, sf), M)
    curves = resample.bootstrap_curves(ranked, M, "id", B, SEED)
    band = resample.simultaneous_band(curves, overlap.concordance_curve(ranked, M), M)
    return rounded(band, "band_low", "band_high", digits=8)


@query(
    "cluster_screening_summary",
    f"""WITH {F_LONG}, {draws_sql('f', 'grp')}, {COPIES.format(unit='grp')}, {curves_sql(False)}, {OBSERVED},
    {WEIGHTED.format(unit='grp')}, {weighted_tau('wf', 'metric, rep')},
    steps AS (SELECT *, lag(q) OVER w AS q0, lag(adj) OVER w AS y0 FROM obs WINDOW w AS (PARTITION BY metric ORDER BY q)),
    areas AS (SELECT metric, sum((q - q0) * (adj + y0) / 2.0) / 49.0 AS naucc,
                     sum((q - q0) * (adj + y0) / 2.0) FILTER (WHERE q <= 10) / 9.0 AS elite FROM steps GROUP BY metric),
    runs AS (SELECT *, bool_and(lo > 0) OVER w AND count(*) OVER w = 5 AS run FROM band
             WINDOW w AS (PARTITION BY metric ORDER BY q ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    starts AS (SELECT metric, min(q) FILTER (WHERE run) AS onset FROM runs GROUP BY metric),
    ci AS (SELECT metric, quantile_cont(naucc, 0.025) AS nl, quantile_cont(elite, 0.975) AS eh FROM boot_area GROUP BY metric),
    tc AS (SELECT metric, quantile_cont(tau, 0.975) AS th FROM taus GROUP BY metric)
    SELECT metric, (SELECT count(*) FROM f WHERE f.metric = a.metric) AS n, (SELECT count(DISTINCT grp) FROM f WHERE f.metric = a.metric) AS n_groups,
           round(naucc, 9) + 0.0 AS naucc, round(elite, 9) + 0.0 AS partial_elite, round(nl, 9) + 0.0 AS naucc_ci95_low,
           round(eh, 9) + 0.0 AS partial_elite_ci95_high, round(th, 9) + 0.0 AS tau_ci95_high, onset AS onset_delta_00
    FROM areas a JOIN starts USING (metric) JOIN ci USING (metric) JOIN tc USING (metric)""",
)
def _(spark, sf):
    _, out = resample.cluster_screening(long_pairs(spark, sf), M, "grp", B, SEED)
    cols = ["naucc", "partial_elite", "naucc_ci95_low", "partial_elite_ci95_high", "tau_ci95_high"]
    return rounded(out.select("metric", "n", "n_groups", *cols, "onset_delta_00"), *cols)


@query(
    "bootstrap_mean_median",
    f"""WITH {F_LONG}, {draws_sql('f', 'id')},
    c AS (SELECT f.metric, rep, abs("left" - "right") AS v, unnest(range(w)) AS copy FROM f JOIN draws d ON d.metric = f.metric AND d.unit = f.id)
    SELECT metric, rep, round(avg(v), 4) + 0.0 AS mean, round(median(v), 4) + 0.0 AS median FROM c GROUP BY metric, rep""",
)
def _(spark, sf):
    rows = finite_pairs(long_pairs(spark, sf)).withColumn("v", F.abs(F.col("left") - F.col("right")))
    out = resample.bootstrap_mean_median(rows, M, "v", B, SEED)
    return rounded(out.withColumn("rep", F.col("rep").cast("bigint")), "mean", "median", digits=4)


@query(
    "ratio_bootstrap",
    f"""WITH {F_LONG}, {draws_sql('f', 'id')}
    SELECT f.metric, rep, round(sum(w * "left") / sum(w * "right"), 9) + 0.0 AS ratio
    FROM f JOIN draws d ON d.metric = f.metric AND d.unit = f.id GROUP BY f.metric, rep""",
)
def _(spark, sf):
    reps = resample.bootstrap_means(finite_pairs(long_pairs(spark, sf)), M, "id", ["left", "right"], B, SEED)
    return rounded(reps.selectExpr("metric", "CAST(rep AS BIGINT) AS rep", "left / right AS ratio"), "ratio")


@query(
    "group_mean_difference",
    f"""WITH {F_LONG}, g AS (SELECT metric, grp, avg("left" - "right") AS d FROM f GROUP BY metric, grp), {draws_sql('g', 'grp')},
    r AS (SELECT g.metric, rep, sum(w * d) / sum(w) AS d FROM g JOIN draws x ON x.metric = g.metric AND x.unit = g.grp GROUP BY g.metric, rep)
    SELECT metric, round((SELECT avg(d) FROM g WHERE g.metric = r.metric), 4) + 0.0 AS difference,
           round(quantile_cont(d, 0.025), 4) + 0.0 AS ci95_low, round(quantile_cont(d, 0.975), 4) + 0.0 AS ci95_high
    FROM r GROUP BY metric""",
)
def _(spark, sf):
    out = resample.group_mean_difference(finite_pairs(long_pairs(spark, sf)), M, "grp", "left", "right", B, SEED)
    return rounded(out, "difference", "ci95_low", "ci95_high", digits=4)


PLAIN_TAU = """
{name}_p AS (SELECT {by}, count(*) AS pairs, sum(CASE WHEN a."left" = b."left" THEN 1 ELSE 0 END) AS tl,
         sum(CASE WHEN a."right" = b."right" THEN 1 ELSE 0 END) AS tr,
         sum(sign(a."left" - b."left") * sign(a."right" - b."right")) AS s
       FROM {src} a JOIN {src} b USING ({by}) WHERE a.id < b.id GROUP BY {by}),
{name} AS (SELECT {by}, s / (sqrt(pairs - tl) * sqrt(pairs - tr)) AS tau FROM {name}_p)"""


@query(
    "permutation_taus",
    f"""WITH {F_LONG},
    lefts AS (SELECT metric, id, "left", row_number() OVER (PARTITION BY metric ORDER BY id) AS at_pos FROM f),
    rights AS (SELECT metric, rep, "right", row_number() OVER (PARTITION BY metric, rep ORDER BY {h_sql('44', 'rep', 'id')}, id) AS at_pos
               FROM f, range({B}) r(rep)),
    dealt AS (SELECT l.metric, rep, id, "left", "right" FROM lefts l JOIN rights r ON r.metric = l.metric AND r.at_pos = l.at_pos),
    {PLAIN_TAU.format(name='taus', by='metric, rep', src='dealt')}
    SELECT metric, rep, round(tau, 9) + 0.0 AS tau FROM taus""",
)
def _(spark, sf):
    out = resample.permutation_taus(long_pairs(spark, sf), M, B, 44)
    return rounded(out.selectExpr("metric", "CAST(rep AS BIGINT) AS rep", "tau"), "tau")


@query(
    "permutation_pvalue",
    f"""WITH {F_LONG},
    lefts AS (SELECT metric, id, "left", row_number() OVER (PARTITION BY metric ORDER BY id) AS at_pos FROM f),
    rights AS (SELECT metric, rep, "right", row_number() OVER (PARTITION BY metric, rep ORDER BY {h_sql('44', 'rep', 'id')}, id) AS at_pos
               FROM f, range({B}) r(rep)),
    dealt AS (SELECT l.metric, rep, id, "left", "right" FROM lefts l JOIN rights r ON r.metric = l.metric AND r.at_pos = l.at_pos),
    {PLAIN_TAU.format(name='taus', by='metric, rep', src='dealt')}, {PLAIN_TAU.format(name='obs', by='metric', src='f')}
    SELECT t.metric, round(any_value(o.tau), 9) + 0.0 AS tau,
           round((count(*) FILTER (WHERE abs(t.tau) >= abs(o.tau)) + 1) / {B + 1}.0, 9) + 0.0 AS pvalue
    FROM taus t JOIN obs o ON o.metric = t.metric GROUP BY t.metric""",
)
def _(spark, sf):
    out = resample.permutation_pvalue(long_pairs(spark, sf), M, B, 44)
    return rounded(out.drop("n"), "tau", "pvalue")


ROLES = F_LONG + """, r AS (SELECT *, 'x' AS k, metric AS role FROM f),
c AS (SELECT * FROM r WHERE grp IN (SELECT grp FROM r GROUP BY grp HAVING count(DISTINCT role) = 2))"""


def roles(spark, sf):
    return long_pairs(spark, sf).withColumn("k", F.lit("x")).withColumnRenamed("metric", "role")


@query(
    "delta_tau_permutation",
    f"""WITH {ROLES}, dealt AS (SELECT rep, role, id, "left", "right" FROM c, range({B}) t(rep)
      WHERE ({h_sql('43', 'rep', 'grp')} % 2 = 1) = (role = 'b')),
    {PLAIN_TAU.format(name='taus', by='rep, role', src='dealt')}, {PLAIN_TAU.format(name='obs', by='role', src='r')},
    d AS (SELECT rep, max(tau) FILTER (WHERE role = 'b') - max(tau) FILTER (WHERE role = 'a') AS d FROM taus GROUP BY rep),
    o AS (SELECT max(tau) FILTER (WHERE role = 'b') - max(tau) FILTER (WHERE role = 'a') AS d FROM obs)
    SELECT 'x' AS k, round((SELECT d FROM o), 9) + 0.0 AS delta_tau,
           round((count(*) FILTER (WHERE abs(d.d) >= abs((SELECT d FROM o))) + 1) / {B + 1}.0, 9) + 0.0 AS pvalue FROM d""",
)
def _(spark, sf):
    out = resample.delta_tau_permutation(roles(spark, sf), ["k"], "role", "b", "grp", B, 43)
    return rounded(out, "delta_tau", "pvalue")


@query(
    "delta_tau_bootstrap",
    f"""WITH {ROLES}, {draws_sql('c', 'grp', by='k')},
    wf AS (SELECT rep, role, id, "left", "right", w FROM c JOIN draws d ON d.unit = c.grp), {weighted_tau('wf', 'rep, role')},
    d AS (SELECT rep, max(tau) FILTER (WHERE role = 'b') - max(tau) FILTER (WHERE role = 'a') AS d FROM taus GROUP BY rep)
    SELECT 'x' AS k, round(quantile_cont(d, 0.025), 9) + 0.0 AS delta_ci95_low, round(quantile_cont(d, 0.975), 9) + 0.0 AS delta_ci95_high
    FROM d""",
)
def _(spark, sf):
    out = resample.delta_tau_bootstrap(roles(spark, sf), ["k"], "role", "b", "grp", B, SEED)
    return rounded(out, "delta_ci95_low", "delta_ci95_high")


@query(
    "subgroup_permutation",
    f"""WITH {F_LONG}, m AS (SELECT *, stratum = 'PROMO' AS ins FROM f),
    sz AS (SELECT metric, count(*) FILTER (WHERE ins) AS size FROM m GROUP BY metric),
    sh AS (SELECT metric, rep, id, "left", "right", row_number() OVER (PARTITION BY metric, rep ORDER BY {h_sql('45', 'rep', 'id')}, id) AS at_pos
           FROM m, range({B}) r(rep)),
    dealt AS (SELECT s.*, at_pos <= size AS ins FROM sh s JOIN sz USING (metric)),
    {PLAIN_TAU.format(name='taus', by='metric, rep, ins', src='dealt')}, {PLAIN_TAU.format(name='obs', by='metric, ins', src='m')},
    d AS (SELECT metric, rep, max(tau) FILTER (WHERE ins) - max(tau) FILTER (WHERE NOT ins) AS d FROM taus GROUP BY metric, rep),
    o AS (SELECT metric, max(tau) FILTER (WHERE ins) - max(tau) FILTER (WHERE NOT ins) AS o FROM obs GROUP BY metric)
    SELECT metric, round(any_value(o), 9) + 0.0 AS delta_tau, round((count(*) FILTER (WHERE abs(d) >= abs(o)) + 1) / {B + 1}.0, 9) + 0.0 AS pvalue
    FROM d JOIN o USING (metric) GROUP BY metric""",
)
def _(spark, sf):
    rows = long_pairs(spark, sf).withColumn("ins", F.col("stratum") == "PROMO")
    return rounded(resample.subgroup_permutation(rows, M, "ins", B, 45), "delta_tau", "pvalue")
