"""Models, calibration, audits, samples and composed report tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tandemrank.catalog.pairing import FORMULAS, formulas
from tandemrank.catalog.ranking import AREAS, CURVE5, PAIRWISE, PM, RANKED
from tandemrank.catalog.registry import query, r9, rounded
from tandemrank.catalog.resampling import B, F_LONG, M, SEED, draws_sql, h_sql
from tandemrank.catalog.selection import area_of
from tandemrank.catalog.tensors import T_SQL, dsql, nsql
from tandemrank.catalog.views import LONG, PANELS, curve_sql, long_pairs, panel_pairs, ranked_sql, table, tensors
from tandemrank.frame import finite_pairs
from tandemrank.functions import formula as fm
from tandemrank.functions import scalars as sc
from tandemrank.functions import tensors as fn
from tandemrank.operators import audit, baselines, models, overlap, portfolio, sampling
from tandemrank.operators.rank import rank_both
from tandemrank.plans import tables
from tandemrank.session import materialize
from tandemrank.sources import sinks
from tandemrank.sources.tables import scan

# Replicates of the composed records, which no SQL repeats: bootstraps and permutations of the study itself.
REPS, PERMS = 2000, 4999

# Tensors as model records: the source is the parity of the id, the test fold of a seed is hash % 5 = 0.
REC = f"""{T_SQL},
rec AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'left' ELSE 'right' END AS source, grp, t FROM tens),
sd AS (SELECT *, {h_sql('seed', 'id')} % 5 = 0 AS test FROM rec, (SELECT unnest([0, 1, 2]) AS seed)),
tr AS (SELECT *, source AS train_source FROM sd WHERE NOT test UNION ALL SELECT *, 'pooled' FROM sd WHERE NOT test),
te AS (SELECT id, grp, t, seed, source AS eval_source, unnest(['left', 'right', 'pooled']) AS train_source FROM sd WHERE test),
tx AS (SELECT *, CASE WHEN train_source = 'pooled' THEN 'pooled' WHEN train_source = eval_source THEN 'in_source' ELSE 'held_out' END AS split FROM te),
comp AS (SELECT train_source, seed, grp, x, avg(t[x]) AS m FROM tr, range(1, 28) r(x) GROUP BY ALL),
gm AS (SELECT train_source, seed, grp, list(m ORDER BY x) AS m FROM comp GROUP BY ALL),
own AS (SELECT source AS eval_source, seed, grp, x, avg(t[x]) AS m FROM sd, range(1, 28) r(x) WHERE NOT test GROUP BY ALL),
gs AS (SELECT eval_source, seed, grp, list(m ORDER BY x) AS m FROM own GROUP BY ALL),
z AS (SELECT [0.0 for i in range(27)] AS z),
rx AS (SELECT vec_id AS id, CAST(embedding[28] AS DOUBLE) AS x, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS k FROM embeddings),
sums AS (SELECT train_source, seed, c, avg(x) AS mx, avg(k) AS mk, avg(t[c]) AS my, count(*) * var_pop(x) + 1 AS xx, count(*) * covar_pop(x, k) AS xk, count(*) * var_pop(k) + 0.5 AS kk,
  count(*) * covar_pop(x, t[c]) AS xy, count(*) * covar_pop(k, t[c]) AS ky FROM tr JOIN rx USING (id), range(1, 28) r(c) GROUP BY ALL),
lines AS (SELECT *, 'ridge' AS model, xy / xx AS bx, 0.0 AS bk FROM sums UNION ALL SELECT *, 'source_token_ridge', (xy * kk - xk * ky) / (xx * kk - xk * xk), (ky * xx - xk * xy) / (xx * kk - xk * xk) FROM sums),
rp AS (SELECT model, tx.id, tx.train_source, tx.eval_source, tx.split, tx.seed, any_value(tx.t) AS t, any_value(tx.grp) AS grp, list(my + bx * (rx.x - mx) + bk * (rx.k - mk) ORDER BY c) AS p
  FROM tx JOIN rx USING (id) JOIN lines s ON s.train_source = tx.train_source AND s.seed = tx.seed GROUP BY ALL),
pred AS (SELECT model, id, grp, t, seed, eval_source, train_source, split, [(p[9 * (i // 9) + 3 * ((i // 3) % 3) + i % 3 + 1] + p[9 * (i // 9) + 3 * (i % 3) + (i // 3) % 3 + 1]) / 2 for i in range(27)] AS p FROM rp UNION ALL
  SELECT 'zero' AS model, tx.id, grp, t, seed, eval_source, train_source, split, z AS p FROM tx, z
  UNION ALL SELECT 'group_mean', tx.id, tx.grp, tx.t, tx.seed, tx.eval_source, tx.train_source, tx.split, coalesce(gm.m, z) FROM tx CROSS JOIN z LEFT JOIN gm ON gm.train_source = tx.train_source AND gm.seed = tx.seed AND gm.grp = tx.grp
  UNION ALL SELECT 'source_group_mean', tx.id, tx.grp, tx.t, tx.seed, tx.eval_source, tx.train_source, tx.split, coalesce(gs.m, z) FROM tx CROSS JOIN z LEFT JOIN gs ON gs.eval_source = tx.eval_source AND gs.seed = tx.seed AND gs.grp = tx.grp WHERE tx.train_source = 'pooled'),
err AS (SELECT model, train_source, eval_source, split, seed, {dsql('t', 'p')} AS a, {dsql('t', 'p')} / (0.5 * ({nsql('t')} + {nsql('p')}) + 1e-6) AS nm,
  list_sum([abs(t[i] - p[i]) for i in range(1, 28)]) / 27 AS c, list_dot_product(t, p) / ({nsql('t')} * {nsql('p')} + 1e-12) AS cs FROM pred),
met AS (SELECT model, train_source, eval_source, split, seed, count(*) AS n_test, avg(a) AS absolute_error, avg(nm) AS normalized_error, avg(c) AS component_mae, avg(cs) AS cosine
  FROM err GROUP BY ALL),
board AS (SELECT model, train_source, eval_source, split, count(DISTINCT seed) AS n_seeds, min_by(n_test, seed) AS n_test, avg(absolute_error) AS absolute_mean,
  stddev_samp(absolute_error) AS absolute_std, avg(normalized_error) AS normalized_mean, avg(component_mae) AS component_mean, avg(cosine) AS cosine_mean FROM met GROUP BY ALL),
nt AS (SELECT train_source, seed, count(*) AS n_train FROM tr GROUP BY ALL), n0 AS (SELECT train_source, min_by(n_train, seed) AS n_train FROM nt GROUP BY train_source)"""


def records(spark, sf):
    rows = table(spark, sf, "embeddings").selectExpr("vec_id AS id", "array(double(embedding[27])) AS x")
    rows = tensors(spark, sf).selectExpr("id", "IF(id % 2 = 0, 'left', 'right') AS source", "grp", "t").join(rows, "id")
    return baselines.with_token(rows, "source", ["left", "right"], "x", "xs")


def matrix(spark, sf):
    from tandemrank.operators.resample import counter_hash

    return baselines.baseline_matrix(
        records(spark, sf), "id", "source", "grp", "t", [0, 1, 2], f"{counter_hash('seed', 'id')} % 5 = 0",
        ridges={"ridge": "x", "source_token_ridge": "xs"},
    )


@query(
    "baseline_matrix",
    f"""WITH {REC} SELECT model, train_source, eval_source, split, CAST(seed AS INT) AS seed, n_test, round(absolute_error, 9) + 0.0 AS absolute_error, round(normalized_error, 9) + 0.0 AS normalized_error,
      round(component_mae, 9) + 0.0 AS component_mae, round(cosine, 9) + 0.0 AS cosine, n_train FROM met JOIN nt USING (train_source, seed)""",
)
def _(spark, sf):
    out = matrix(spark, sf).drop("amplitude_ratio")
    return rounded(out, "absolute_error", "normalized_error", "component_mae", "cosine")


BOARD = "round(absolute_mean, 9) + 0.0 AS absolute_mean"


@query(
    "leaderboard",
    f"""WITH {REC} SELECT model, train_source, eval_source, split, n_seeds, n_train, n_test, {BOARD}, round(absolute_std, 9) + 0.0 AS absolute_std, round(normalized_mean, 9) + 0.0 AS normalized_mean,
      round(component_mean, 9) + 0.0 AS component_mean, round(cosine_mean, 9) + 0.0 AS cosine_mean FROM board JOIN n0 USING (train_source)""",
)
def _(spark, sf):
    out = models.leaderboard(matrix(spark, sf))
    return rounded(out, "absolute_mean", "absolute_std", "normalized_mean", "component_mean", "cosine_mean")


@query(
    "rank_inversion",
    f"""WITH {REC}, p AS (SELECT model, eval_source, max(absolute_mean) FILTER (WHERE split = 'in_source') AS i, max(absolute_mean) FILTER (WHERE split = 'held_out') AS h FROM board GROUP BY ALL)
    SELECT model, eval_source, round(i, 9) + 0.0 AS in_source_mae, round(h, 9) + 0.0 AS held_out_mae, round(h / (i + 1e-12), 9) + 0.0 AS degradation_ratio, h > i + 1e-12 AS rank_inversion
    FROM p WHERE i IS NOT NULL AND h IS NOT NULL""",
)
def _(spark, sf):
    out = models.rank_inversion(models.leaderboard(matrix(spark, sf)))
    return rounded(out, "in_source_mae", "held_out_mae", "degradation_ratio")


@query(
    "paired_gain",
    f"""WITH {REC}, p AS (SELECT train_source, eval_source, split, max(absolute_mean) FILTER (WHERE model = 'group_mean') AS b, max(absolute_mean) FILTER (WHERE model = 'source_group_mean') AS o FROM board GROUP BY ALL)
    SELECT train_source, eval_source, split, round(b, 9) + 0.0 AS base_mae, round(o, 9) + 0.0 AS other_mae, round(b - o, 9) + 0.0 AS improvement FROM p WHERE b IS NOT NULL AND o IS NOT NULL""",
)
def _(spark, sf):
    return rounded(models.paired_gain(models.leaderboard(matrix(spark, sf)), "group_mean", "source_group_mean"),
                   "base_mae", "other_mae", "improvement")


@query(
    "valid_models",
    f"""WITH {REC}, fl AS (SELECT eval_source, split, min(absolute_mean) AS f FROM board WHERE model = 'zero' GROUP BY ALL)
    SELECT model, train_source, b.eval_source, b.split, b.split = 'in_source' AND absolute_mean < f - 1e-12 AS valid FROM board b LEFT JOIN fl USING (eval_source, split)""",
)
def _(spark, sf):
    out = models.valid_models(models.leaderboard(matrix(spark, sf)), ["zero"])
    return out.select("model", "train_source", "eval_source", "split", "valid")


GAPS = """gaps AS (SELECT metric || ' ' || scope AS scope, id, gap FROM (SELECT metric, id, dist, abs("left" - "right") AS gap FROM f), (SELECT unnest(['all', 'near']) AS scope) WHERE scope = 'all' OR dist <= 20)"""


def gap_rows(spark, sf):
    rows = finite_pairs(long_pairs(spark, sf))
    return rows.selectExpr("metric", "id", "abs(`left` - `right`) AS gap", "explode(IF(dist <= 20, array('all', 'near'), array('all'))) AS scope").selectExpr(
        "metric || ' ' || scope AS scope", "id", "gap"
    )


RATIO_COLUMNS = [f"{s}_{k}{x}" for k in ("gap", "ratio") for s in ("mean", "median") for x in ("", "_low", "_high")]
RATIO_COLUMNS = [c if "gap" in c else "ratio_" + c.replace("_ratio", "") for c in RATIO_COLUMNS]
RATIO_COLUMNS += ["mean_error", "median_error", *[f"{c}_normalized" for c in ["mean_error", "median_error", *[c for c in RATIO_COLUMNS if "ratio" in c]]]]


def both_sides_sql() -> str:
    """Each model's errors and each scope's gaps drawn on their own, then divided replicate by replicate."""
    mid = "(max(v) FILTER (WHERE f <= (m - 1) // 2 AND (m - 1) // 2 < c) + max(v) FILTER (WHERE f <= m // 2 AND m // 2 < c)) / 2"

    def side(name: str, source: str, unit: str, value: str) -> str:
        return f"""
{name}_w AS (SELECT s.k, rep, w, {value} AS v, sum(w) OVER o AS c, sum(w) OVER o - w AS f, sum(w) OVER (PARTITION BY s.k, rep) AS m
  FROM {source} s JOIN {name}_d d ON d.k = s.k AND d.unit = s.{unit} WINDOW o AS (PARTITION BY s.k, rep ORDER BY {value}, s.{unit} ROWS UNBOUNDED PRECEDING)),
{name}_r AS (SELECT k, rep, sum(w * v) / sum(w) AS mean, {mid} AS med FROM {name}_w GROUP BY k, rep)"""

    ci = lambda x, n: f"quantile_cont({x}, 0.025) AS {n}_low, quantile_cont({x}, 0.975) AS {n}_high"
    return f"""WITH {REC}, {F_LONG.strip()}, {GAPS}, g AS (SELECT scope AS k, id, gap FROM gaps),
e AS (SELECT model || '|' || train_source || '|' || kind AS k, model, train_source, kind, eval_source || '|' || seed AS unit, CASE kind WHEN 'a' THEN absolute_error ELSE normalized_error END AS error
  FROM met, (SELECT unnest(['a', 'n']) AS kind) WHERE split = 'in_source'),
{draws_sql('g', 'id', by='k', name='g_d').strip()}, {draws_sql('e', 'unit', by='k', seed=SEED + 1, name='e_d').strip()}, {side('g', 'g', 'id', 'gap').strip()}, {side('e', 'e', 'unit', 'error').strip()},
gp AS (SELECT k, count(*) AS n_pairs, avg(gap) AS mean_gap, median(gap) AS median_gap FROM g GROUP BY k),
gc AS (SELECT k, {ci('mean', 'mean_gap')}, {ci('med', 'median_gap')} FROM g_r GROUP BY k),
es AS (SELECT k, any_value(model) AS model, any_value(train_source) AS train_source, any_value(kind) AS kind, count(*) AS n_errors, avg(error) AS me, median(error) AS de FROM e GROUP BY k),
rc AS (SELECT e_r.k, g_r.k AS scope, {ci('g_r.mean / (e_r.mean + 1e-12)', 'rm')}, {ci('g_r.med / (e_r.med + 1e-12)', 'rd')} FROM e_r JOIN g_r USING (rep) GROUP BY ALL),
flat AS (SELECT model, train_source, scope, kind, n_pairs, n_errors, mean_gap, mean_gap_low, mean_gap_high, median_gap, median_gap_low, median_gap_high, me, de,
  mean_gap / (me + 1e-12) AS rm, rm_low, rm_high, median_gap / (de + 1e-12) AS rd, rd_low, rd_high FROM es JOIN rc USING (k) JOIN gp ON gp.k = rc.scope JOIN gc ON gc.k = rc.scope)
SELECT a.model, a.train_source, a.scope, a.n_pairs, a.n_errors, n.n_errors AS n_errors_normalized, {', '.join(f'round(a.{c}, 4) + 0.0 AS {c}' for c in RATIO_COLUMNS[:6])},
  {', '.join(f'round({s}.{c}, 4) + 0.0 AS {o}{x}' for s, x in (('a', ''), ('n', '_normalized')) for c, o in (('me', 'mean_error'), ('de', 'median_error'), *[(f'r{m[0]}{y}' if m == 'mean' else f'rd{y}', f'ratio_{m}{y}') for m in ('mean', 'median') for y in ('', '_low', '_high')]))}
FROM flat a JOIN flat n USING (model, train_source, scope) WHERE a.kind = 'a' AND n.kind = 'n'"""


@query("gap_ratios", both_sides_sql())
def _(spark, sf):
    errors = matrix(spark, sf).filter("split = 'in_source'").selectExpr("model", "train_source", "eval_source || '|' || seed AS unit", "absolute_error", "normalized_error")
    out = models.gap_ratios(errors, gap_rows(spark, sf), B, SEED)
    return rounded(out, *RATIO_COLUMNS, digits=4)


@query("smallest_gap", f"""WITH {REC}, {F_LONG.strip()}, {GAPS}
    SELECT scope, round(median(gap) / ((SELECT min(absolute_mean) FROM board WHERE split = 'in_source') + 1e-12), 4) + 0.0 AS gap_index FROM gaps GROUP BY scope""")
def _(spark, sf):
    best = models.leaderboard(matrix(spark, sf)).filter("split = 'in_source'").agg(F.min("absolute_mean").alias("best_error"))
    return rounded(models.smallest_gap(gap_rows(spark, sf), best), "gap_index", digits=4)


@query(
    "scale_calibration",
    f"""WITH {F_LONG}, e AS (SELECT metric || '|' || grp AS grp, abs("left" - "right") AS e, id FROM f),
    p AS (SELECT grp, e, row_number() OVER (PARTITION BY grp ORDER BY e, id) AS pos, count(*) OVER (PARTITION BY grp) AS n FROM e),
    c AS (SELECT grp, median(e) AS med, max(e) FILTER (WHERE pos = least(ceil(0.9 * n), n)) / greatest(median(e), 1e-12) AS factor FROM p GROUP BY grp)
    SELECT grp, round(any_value(factor), 7) + 0.0 AS factor, round(avg(CASE WHEN e <= factor * med THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS achieved_coverage FROM p JOIN c USING (grp) GROUP BY grp""",
)
def _(spark, sf):
    rows = finite_pairs(long_pairs(spark, sf)).selectExpr("metric || '|' || grp AS grp", "id", "abs(`left` - `right`) AS e")
    out = models.scale_calibration(rows, "grp", "e", 0.9)
    return out.select("grp", r9("factor", 7).alias("factor"), r9("achieved_coverage").alias("achieved_coverage"))


@query(
    "interval_coverage",
    f"""WITH {F_LONG}, e AS (SELECT metric, abs("left" - "right") AS e FROM f), q AS (SELECT metric, alpha, quantile_cont(e, 1 - alpha) AS q FROM e,
      (SELECT CAST(unnest([0.1, 0.2, 0.3]) AS DOUBLE) AS alpha) GROUP BY metric, alpha)
    SELECT metric, alpha, round(any_value(q), 4) + 0.0 AS quantile, round(avg(CASE WHEN e <= q THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS coverage FROM e JOIN q USING (metric) GROUP BY metric, alpha""".replace(
        "quantile_cont(e, 1 - alpha) AS q", "CASE alpha WHEN 0.1 THEN quantile_cont(e, 0.9) WHEN 0.2 THEN quantile_cont(e, 0.8) ELSE quantile_cont(e, 0.7) END AS q"
    ),
)
def _(spark, sf):
    rows = finite_pairs(long_pairs(spark, sf)).selectExpr("metric", "id", "abs(`left` - `right`) AS e")
    out = models.interval_coverage(rows, M, "e", [0.1, 0.2, 0.3])
    return out.withColumns({"quantile": r9("quantile", 4), "coverage": r9("coverage")})


@query(
    "prediction_ensemble",
    f"""WITH {T_SQL}, s AS (SELECT grp, x, avg(t[x]) AS m, stddev_pop(t[x]) AS s FROM tens, range(1, 28) r(x) GROUP BY ALL)
    SELECT grp, round(sum(m * x), 9) + 0.0 AS mean_check, round(sum(s * x), 9) + 0.0 AS std_check FROM s GROUP BY grp""",
)
def _(spark, sf):
    out = models.ensemble(tensors(spark, sf), "grp", "t", 27)
    check = "round(aggregate(transform({c}, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x), 9) + 0D"
    return out.selectExpr("grp", f"{check.format(c='pred_mean')} AS mean_check", f"{check.format(c='pred_std')} AS std_check")


def with_fractions(spark, sf, rows):
    """``rows`` whose formula parses, with ``fractions``. The short formulas meet the rows; the 94 fractions are worked out
    after that: they compress so well that Spark takes a table of them for small and broadcasts it."""
    met = materialize(rows.join(formulas(spark, sf).hint("merge"), "id"))
    return materialize(fm.composition(met, "formula").select(*rows.columns, "fractions")).filter("fractions IS NOT NULL")


@query("ridge_fourier")
def _(spark, sf):
    df = with_fractions(spark, sf, tensors(spark, sf).select("id", "t"))
    rows = materialize(models.fourier_features(df, "fractions", 94, 256, 0.05, 42, "x").select("id", "x", "t"))
    fold = f"{portfolio.fold_of('id', 5)} = 0"
    out = models.ridge(rows.filter(f"NOT ({fold})"), rows.filter(fold), "x", "t")
    return models.error_summary(out.selectExpr("'ridge' AS model", "t", f"{fn.symmetrize('pred')} AS pred"), ["model"], "t", "pred")


@query("structural_ridge")
def _(spark, sf):
    """Composition, pair-distance and source-token features, lifted to random cosines, for every source pair and seed."""
    from tandemrank.operators.resample import counter_hash

    parts = with_fractions(spark, sf, records(spark, sf).drop("x", "xs")).withColumnRenamed("fractions", "f")
    axes = [f"IF({3 * k} + {{}} < 63, double(embedding[{3 * k} + {{}}]) * 20, NULL)" for k in range(21)]
    points = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", "inline(array(" + ", ".join(f"named_struct('k', {k}, 'x0', {a.format(0, 0)}, 'x1', {a.format(1, 1)}, 'x2', {a.format(2, 2)})" for k, a in enumerate(axes)) + "))"
    )
    shares = materialize(baselines.distance_features(points, "id", "k", ["x0", "x1", "x2"]))
    rows = baselines.with_distance_features(parts, shares, "id", "f")
    rows = models.fourier_features(baselines.with_token(rows, "source", ["left", "right"], "f", "ft"), "ft", 116, 256, 0.05, 42, "z")
    out = baselines.baseline_matrix(
        rows.drop("f", "ft"), "id", "source", "grp", "t", [0, 1, 2], f"{counter_hash('seed', 'id')} % 5 = 0", ridges={"structural_ridge": "z"}
    )
    return out.filter("model = 'structural_ridge'")


@query("nested_regression")
def _(spark, sf):
    df = fm.prototype(fm.composition(formulas(spark, sf), "formula"), "formula")
    p = finite_pairs(long_pairs(spark, sf)).selectExpr("id", "metric", "dist", "abs(`left` - `right`) AS gap")
    rows = materialize(df).join(p, "id").selectExpr("*", f"{portfolio.fold_of('prototype', 5)} AS fold")
    rows = materialize(rows)
    sets = {"chemistry": ["n_elements", "max_z"], "distance": ["dist"], "combined": ["n_elements", "max_z", "dist", "heavy_fraction"]}
    return models.nested_regression(rows, sets, "gap", "fold", by=["metric"])


@query(
    "field_provenance",
    f"""WITH {LONG}, w AS (SELECT id, max("left") FILTER (WHERE metric = 'a') AS al, max("right") FILTER (WHERE metric = 'a') AS ar, max("left") FILTER (WHERE metric = 'b') AS bl, max(dist) AS d FROM long_pairs GROUP BY id),
    l AS (SELECT 'price' AS attribute, al AS l, ar AS r FROM w UNION ALL SELECT 'copy', al, al FROM w UNION ALL SELECT 'size', bl, d FROM w)
    SELECT attribute, count(*) AS n_pairs, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS common_n, count(*) FILTER (WHERE l IS NULL) AS left_missing, count(*) FILTER (WHERE r IS NULL) AS right_missing,
      count(*) FILTER (WHERE l IS NOT NULL OR r IS NOT NULL) AS available_n, count(*) FILTER (WHERE l = r) AS identical_values,
      round(count(*) FILTER (WHERE l = r) / count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL), 9) + 0.0 AS fraction_identical,
      count(*) FILTER (WHERE l = r) / count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) > 0.05 AS same_field_copy_flag FROM l GROUP BY attribute""",
)
def _(spark, sf):
    pick = "max(IF(metric = '{m}', `{s}`, NULL)) AS {a}"
    wide = long_pairs(spark, sf).groupBy("id").agg(
        F.expr(pick.format(m="a", s="left", a="al")), F.expr(pick.format(m="a", s="right", a="ar")),
        F.expr(pick.format(m="b", s="left", a="bl")), F.expr("max(dist) AS d"),
    )
    out = audit.field_provenance(wide, {"price": ("al", "ar"), "copy": ("al", "al"), "size": ("bl", "d")})
    return rounded(out, "fraction_identical")


@query(
    "panel_counts",
    f"WITH {PANELS} SELECT panel, metric, count(*) AS n, count(*) FILTER (WHERE stratum = 'PROMO') AS promo, count(*) FILTER (WHERE dist <= 10) AS near FROM panel_pairs GROUP BY ALL",
)
def _(spark, sf):
    return audit.panel_counts(panel_pairs(spark, sf), PM, {"promo": "stratum = 'PROMO'", "near": "dist <= 10"})


@query(
    "distance_audit",
    f"""WITH {PANELS}, d AS (SELECT panel, metric, 'dist' AS distance, dist AS v FROM panel_pairs UNION ALL SELECT panel, metric, 'left', "left" FROM panel_pairs WHERE "left" IS NOT NULL)
    SELECT panel, metric, distance, count(*) AS n_rows, round(avg(v), 4) + 0.0 AS mean, round(median(v), 4) + 0.0 AS median, round(max(v), 4) + 0.0 AS maximum FROM d GROUP BY ALL""",
)
def _(spark, sf):
    return rounded(audit.distance_audit(panel_pairs(spark, sf), PM, ["dist", "left"]), "mean", "median", "maximum", digits=4)


@query(
    "key_numbers",
    f"""WITH {RANKED}, {curve_sql('panel, metric')}, {AREAS}
    SELECT 'naucc_p0_a' AS name, round(max(naucc), 9) + 0.0 AS value FROM areas WHERE panel = 'P0' AND metric = 'a'
    UNION ALL SELECT 'elite_p2_b', round(max(partial_elite), 9) + 0.0 FROM areas WHERE panel = 'P2' AND metric = 'b'
    UNION ALL SELECT 'n_p1', CAST(max(n) AS DOUBLE) FROM curve WHERE panel = 'P1' AND metric = 'a'""",
)
def _(spark, sf):
    curve = materialize(overlap.concordance_curve(rank_both(panel_pairs(spark, sf), PM), PM))
    areas = overlap.area_summary(curve, PM)
    out = audit.key_numbers([
        (areas, "panel = 'P0' AND metric = 'a'", {"naucc_p0_a": "max(naucc)"}),
        (areas, "panel = 'P2' AND metric = 'b'", {"elite_p2_b": "max(partial_elite)"}),
        (curve, "panel = 'P1' AND metric = 'a'", {"n_p1": "max(n)"}),
    ])
    return rounded(out, "value")


@query("scan_parquet", "SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size > 25")
def _(spark, sf):
    return scan(spark, f"{sf}/part.parquet", ["p_partkey", "p_brand", "p_retailprice", "p_size"]).filter("p_size > 25").drop("p_size")


def _roundtrip(spark, sf, suffix: str):
    from tandemrank.session import scratch_dir

    path = f"{scratch_dir(spark)}/{tempfile.mktemp(dir='')[1:]}.{suffix}"
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    sinks.write_table(rows, path, suffix)
    return scan(spark, path, ["s_suppkey", "s_acctbal"], "s_suppkey bigint, s_name string, s_acctbal double")


@query("scan_csv", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, sf):
    return _roundtrip(spark, sf, "csv")


@query("scan_json", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, sf):
    return _roundtrip(spark, sf, "json")


@query("content_hash")
def _(spark, sf):
    return sinks.content_hash(table(spark, sf, "orders"))


@query("asset_inventory")
def _(spark, sf):
    return sinks.inventory(spark, sf, "source", "*.parquet").drop("modified")


@query("asset_summary")
def _(spark, sf):
    return sinks.inventory_summary(sinks.inventory(spark, sf, "source", "*.parquet"))


@query("result_manifest")
def _(spark, sf):
    return sinks.manifest(spark, sf, {"part.parquet": table(spark, sf, "part"), "orders.parquet": table(spark, sf, "orders")})


@query(
    "scalar_reproduction",
    f"""WITH {T_SQL}, s AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE {nsql('t')} END AS got, CASE WHEN id % 3 <> 0 THEN round({nsql('t')}, 2) END AS rep FROM tens),
    g AS (SELECT id, CASE WHEN rep IS NULL THEN 'not_reported' WHEN got IS NULL THEN 'tensor_not_verified' WHEN abs(rep - got) / greatest(abs(rep), 1e-12) < 0.003 OR (abs(rep) < 2e-3 AND abs(got) < 2e-3) THEN 'verified' ELSE 'mismatch' END AS status FROM s)
    SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM tens), 9) + 0.0 AS coverage FROM g GROUP BY status""",
)
def _(spark, sf):
    t = materialize(tensors(spark, sf).selectExpr("id", f"{fn.norm('t')} AS x"))
    total = t.count()
    rows = t.selectExpr("IF(id % 11 = 0, NULL, x) AS got", "IF(id % 3 != 0, round(x, 2), NULL) AS rep").selectExpr(
        f"{sc.reproduction_status('rep', 'got', 0.003)} AS status"
    )
    return rows.groupBy("status").agg(F.expr("count(*) AS n"), F.expr(f"round(count(*) / {total}D, 9) + 0D AS coverage"))


@query(
    "discrepancy_by_group",
    f"""WITH {T_SQL}, d AS (SELECT grp, {dsql('t', 'u')} AS v FROM tp)
    SELECT grp, count(*) AS n, round(avg(v), 9) + 0.0 AS mean, round(stddev_pop(v), 9) + 0.0 AS std, round(median(v), 9) + 0.0 AS median, round(quantile_cont(v, 0.95), 9) + 0.0 AS p95,
      count(*) FILTER (WHERE v > 1) AS above_one FROM d GROUP BY grp""",
)
def _(spark, sf):
    from tandemrank.catalog.tensors import tensor_pairs
    from tandemrank.operators.summary import distribution_summary

    rows = materialize(tensor_pairs(spark, sf).selectExpr("id", "grp", f"{fn.diff_norm('t', 'u')} AS v"))
    out = distribution_summary(rows, ["grp"], "v", "id").join(rows.groupBy("grp").agg(F.expr("count_if(v > 1) AS above_one")), "grp")
    return rounded(out.select("grp", "n", "mean", "std", "median", "p95", "above_one"), "mean", "std", "median", "p95")


@query("hierarchy_summary")
def _(spark, sf):
    from tandemrank.catalog.registry import QUERIES
    from tandemrank.operators.summary import distribution_summary

    long = materialize(QUERIES["discrepancy_hierarchy"](spark, sf))
    return distribution_summary(long, ["variant", "grp"], "absolute", "id")


@query("residual_audit")
def _(spark, sf):
    from tandemrank.catalog.registry import QUERIES
    from tandemrank.operators.quantile import summarize

    rows = materialize(QUERIES["native_residuals"](spark, sf)).filter("native_residual_normalized IS NOT NULL")
    return summarize(
        rows, ["source", "native_frame_status"], "native_residual_normalized", "id", {"median": 0.5, "p95": 0.95},
        {"n_rows": F.expr("count(*)"), "above_one": F.expr("count_if(native_residual_normalized > 1)")},
    )


@query(
    "audit_sample",
    f"""WITH {F_LONG}, a AS (SELECT metric, id, abs("left" - "right") AS v, (dist > 40)::INT + (stratum = 'PROMO')::INT + ("right" < 900)::INT AS score FROM f),
    p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v, id) AS pos, count(*) OVER (PARTITION BY metric) AS n, row_number() OVER (PARTITION BY metric ORDER BY score DESC, id) AS wp FROM a),
    s AS (SELECT metric, id, CASE WHEN pos <= 15 THEN 'low' WHEN pos > greatest(0, n // 2 - 7) AND pos <= greatest(0, n // 2 - 7) + 15 THEN 'middle' WHEN pos > n - 15 THEN 'high' WHEN wp <= 15 THEN 'anomalous' END AS part FROM p),
    k AS (SELECT * FROM s WHERE part IS NOT NULL), c AS (SELECT metric, count(*) AS c FROM k GROUP BY metric),
    x AS (SELECT metric, id, row_number() OVER (PARTITION BY metric ORDER BY {h_sql('42', 'id')}, id) AS r FROM s WHERE part IS NULL)
    SELECT metric, id, part FROM k UNION ALL SELECT metric, id, 'extra' FROM x JOIN c USING (metric) WHERE r <= 60 - c""",
)
def _(spark, sf):
    rows = finite_pairs(long_pairs(spark, sf)).selectExpr(
        "metric", "id", "abs(`left` - `right`) AS v", "int(dist > 40) + int(stratum = 'PROMO') + int(`right` < 900) AS score"
    )
    return sampling.audit_sample(rows, "v", "score", "id", by=["metric"])


@query(
    "stratified_sample",
    f"""WITH {F_LONG}, a AS (SELECT metric, id, stratum, abs("left" - "right") AS v FROM f),
    q AS (SELECT metric, stratum, CASE WHEN row_number() OVER (PARTITION BY metric ORDER BY stratum) <= 60 % count(*) OVER (PARTITION BY metric) THEN 1 ELSE 0 END
        + 60 // count(*) OVER (PARTITION BY metric) AS q FROM (SELECT DISTINCT metric, stratum FROM a WHERE stratum IS NOT NULL)),
    p AS (SELECT a.*, q, row_number() OVER (PARTITION BY metric, stratum ORDER BY v, id) AS pos, count(*) OVER (PARTITION BY metric, stratum) AS n FROM a JOIN q USING (metric, stratum)),
    s AS (SELECT *, q // 3 AS t, n // 2 - (q // 3) // 2 AS s FROM p)
    SELECT metric, stratum, id, CASE WHEN pos <= t THEN 'low' WHEN pos > s AND pos <= s + t THEN 'middle' ELSE 'high' END AS part FROM s
    WHERE n >= 3 AND (pos <= t OR (pos > s AND pos <= s + t) OR pos > n - (q - 2 * t))""",
)
def _(spark, sf):
    rows = materialize(finite_pairs(long_pairs(spark, sf)).selectExpr("metric", "id", "stratum", "abs(`left` - `right`) AS v"))
    quotas = sampling.quota_table(rows, "stratum", 60, by=["metric"])
    return sampling.stratified_sample(rows, "stratum", "v", "id", quotas, by=["metric"]).select("metric", "stratum", "id", "part")


def candidate_inputs(spark, sf):
    rows = materialize(finite_pairs(long_pairs(spark, sf)))
    attrs = rows.filter("metric = 'a'").join(fm.reduced_formula(formulas(spark, sf), "formula"), "id").selectExpr(
        "id", "stratum", "dist AS size", "reduced_formula", "id % 3 = 0 AS member"
    )
    return rows, materialize(attrs)


CAND = f"""{F_LONG}, {ranked_sql('f', 'metric')},
ep AS (SELECT id, avg((n + 1.0 - l_avg) / n) AS al, avg((n + 1.0 - r_avg) / n) AS ar, bool_or(l_pos <= greatest(1, floor(0.1 * n))) AS el, bool_or(r_pos <= greatest(1, floor(0.1 * n))) AS er,
         max(greatest(abs("left"), abs("right"))) AS peak FROM ranked GROUP BY id),
o AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY al DESC, id) AS tl, row_number() OVER (ORDER BY ar DESC, id) AS tr, row_number() OVER (ORDER BY al, id) AS bl, row_number() OVER (ORDER BY ar, id) AS br FROM ep),
c1 AS (SELECT id, row_number() OVER (ORDER BY al + ar DESC, id) AS k FROM o WHERE el AND er QUALIFY k <= 10),
c2 AS (SELECT id, row_number() OVER (ORDER BY al DESC, id) AS k FROM o WHERE tl <= greatest(1, floor(0.1 * n)) AND NOT er AND id NOT IN (SELECT id FROM c1) QUALIFY k <= 10),
c3 AS (SELECT id, row_number() OVER (ORDER BY ar DESC, id) AS k FROM o WHERE tr <= greatest(1, floor(0.1 * n)) AND NOT el AND id NOT IN (SELECT id FROM c1 UNION SELECT id FROM c2) QUALIFY k <= 10),
c4 AS (SELECT id, row_number() OVER (ORDER BY al + ar, id) AS k FROM o WHERE bl <= greatest(1, floor(0.2 * n)) AND br <= greatest(1, floor(0.2 * n)) AND peak > 0
         AND id NOT IN (SELECT id FROM c1 UNION SELECT id FROM c2 UNION SELECT id FROM c3) QUALIFY k <= 8)"""


@query(
    "candidate_list",
    f"""WITH {CAND} SELECT 'consensus_elite' AS candidate_stratum, CAST(k AS INT) AS selection_order, id FROM c1 UNION ALL SELECT 'left_only_elite', CAST(k AS INT), id FROM c2
    UNION ALL SELECT 'right_only_elite', CAST(k AS INT), id FROM c3 UNION ALL SELECT 'consensus_low', CAST(k AS INT), id FROM c4""",
)
def _(spark, sf):
    rows, attrs = candidate_inputs(spark, sf)
    out = sampling.candidate_list(rows, "metric", attrs, "stratum", "size", "reduced_formula", "member")
    return out.filter("candidate_stratum != 'diversity_balanced'").select("candidate_stratum", "selection_order", "id")


@query("candidate_balance")
def _(spark, sf):
    rows, attrs = candidate_inputs(spark, sf)
    out = sampling.candidate_list(rows, "metric", attrs, "stratum", "size", "reduced_formula", "member")
    return sampling.balance_report(out, sampling.CANDIDATE_STRATA, {"stratum": 10, "reduced_formula": 3})


def picks_sql() -> str:
    """The categories one after the other: members alone where they fill the quota, without the formulas of earlier ones."""
    parts = []
    for i, (name, quota) in enumerate(sampling.PICK_QUOTAS.items()):
        way = "gap" if name.startswith("consensus") else "gap DESC"
        seen = " UNION ALL ".join(f"SELECT metric, reduced_formula FROM k{j}" for j in range(i)) or "SELECT NULL AS metric, NULL AS reduced_formula"
        parts.append(f"""p{i} AS (SELECT *, count(*) FILTER (WHERE member) OVER (PARTITION BY metric) >= {quota} AS enough FROM g
          WHERE category = '{name}' AND NOT EXISTS (SELECT 1 FROM ({seen}) z WHERE z.metric = g.metric AND z.reduced_formula = g.reduced_formula)),
        k{i} AS (SELECT * FROM p{i} WHERE member OR NOT enough QUALIFY row_number() OVER (PARTITION BY metric ORDER BY {way}, id) <= {quota})""")
    every = " UNION ALL ".join(f"SELECT metric, id, reduced_formula, pct_l, pct_r, gap, category FROM k{i}" for i in range(len(parts)))
    return f"""WITH {F_LONG}, {ranked_sql('f', 'metric')}, {FORMULAS.strip()},
    r AS (SELECT id, e, n / min(n) OVER (PARTITION BY id) AS r FROM cnt),
    s AS (SELECT id, string_agg(e || CASE WHEN abs(r - 1) < 1e-9 THEN '' ELSE CAST(CAST(round_even(r, 0) AS BIGINT) AS VARCHAR) END, '' ORDER BY e) AS f FROM r GROUP BY id),
    red AS (SELECT id, coalesce(f, formula) AS reduced_formula FROM forms LEFT JOIN s USING (id)),
    h AS (SELECT metric, id, reduced_formula, id % 2 = 0 AS member, l_avg / n * 100 AS pct_l, r_avg / n * 100 AS pct_r FROM ranked JOIN red USING (id)),
    g AS (SELECT *, abs(pct_l - pct_r) AS gap, CASE WHEN pct_l <= 10 AND pct_r <= 10 THEN 'consensus_elite' WHEN pct_l <= 10 THEN 'left_only'
      WHEN pct_r <= 10 THEN 'right_only' WHEN pct_l >= 80 AND pct_r >= 80 THEN 'consensus_low' END AS category FROM h),
    {", ".join(parts)} {every}"""


@query("illustrative_picks", picks_sql())
def _(spark, sf):
    rows = finite_pairs(long_pairs(spark, sf)).join(fm.reduced_formula(formulas(spark, sf), "formula"), "id")
    ranked = rank_both(rows.withColumn("member", F.expr("id % 2 = 0")), M, ties=True)
    return sampling.illustrative_picks(ranked, "reduced_formula", "member", by=M).drop("member")


@query("deduplicate", f"WITH {LONG} SELECT metric, grp, min(id) AS id, arg_min(dist, id) AS dist FROM long_pairs GROUP BY metric, grp")
def _(spark, sf):
    return sampling.deduplicate(long_pairs(spark, sf).select("metric", "grp", "id", "dist"), ["metric", "grp"], "id")


@query("rank_record")
def _(spark, sf):
    return tables.rank_record(long_pairs(spark, sf), M, "id", REPS, PERMS)


@query(
    "topk_record",
    f"""WITH {RANKED}, k AS (SELECT panel, metric, n, l_pos, r_pos, k FROM ranked, (SELECT unnest([20, 50, 100]) AS k))
    SELECT panel, metric, CAST(k AS BIGINT) AS k, round(count(*) FILTER (WHERE greatest(l_pos, r_pos) <= k) / (2.0 * least(k, any_value(n)) - count(*) FILTER (WHERE greatest(l_pos, r_pos) <= k)), 9) + 0.0 AS jaccard
    FROM k GROUP BY panel, metric, k""",
)
def _(spark, sf):
    return rounded(tables.topk_record(rank_both(panel_pairs(spark, sf), PM), PM, [20, 50, 100]), "jaccard")


def agreement_sql(src: str, by: str, area: bool) -> str:
    """tau, rho and (for ``area``) nAUCC per key of a source with id, left and right."""
    extra = f", {area_of('ranked', by, 'ar')}" if area else ""
    return f"{ranked_sql(src, by)}, {PAIRWISE.format(by=by, src=src)}, rho AS (SELECT {by}, max(n) AS n, corr(l_avg, r_avg) AS rho FROM ranked GROUP BY {by}){extra}"


TAU = "round(s / (sqrt(pairs - tl) * sqrt(pairs - tr)), 9) + 0.0 AS tau"


@query(
    "robustness",
    f"""WITH {F_LONG}, m AS (SELECT *, ("left" + "right") / 2.0 AS mean FROM f), c AS (SELECT metric, quantile_cont(mean, 0.99) AS p99 FROM m GROUP BY metric),
    e AS (SELECT metric, quantile_cont("left", 0.05) AS ll, quantile_cont("left", 0.95) AS lh, quantile_cont("right", 0.05) AS rl, quantile_cont("right", 0.95) AS rh FROM f GROUP BY metric),
    sub AS (SELECT metric, 'near' AS subset, id, "left", "right" FROM f WHERE dist <= 25
      UNION ALL SELECT metric, 'exclude_top_1pct', id, "left", "right" FROM m JOIN c USING (metric) WHERE mean < p99
      UNION ALL SELECT metric, 'without_' || s, id, "left", "right" FROM f, (SELECT DISTINCT stratum AS s FROM f) WHERE stratum <> s
      UNION ALL SELECT metric, 'winsorized_5_95', id, greatest(ll, least(lh, "left")), greatest(rl, least(rh, "right")) FROM f JOIN e USING (metric)
      UNION ALL SELECT metric, 'log_eps', id, ln(0.0001 + "left"), ln(0.0001 + "right") FROM f),
    {agreement_sql('sub', 'metric, subset', False)}
    SELECT metric, subset, n, {TAU}, round(rho, 9) + 0.0 AS rho FROM rho JOIN pairwise USING (metric, subset)""",
)
def _(spark, sf):
    out = tables.robustness(long_pairs(spark, sf), M, {"near": "dist <= 25"}, "stratum")
    return rounded(out.select("metric", "subset", "n", "tau", "rho"), "tau", "rho")


def controls(spark, sf):
    return long_pairs(spark, sf).selectExpr("'x' AS panel", "IF(metric = 'a', 'price', 'volume') AS attribute", "id", "grp", "left", "right")


@query("control_comparison")
def _(spark, sf):
    ref = finite_pairs(long_pairs(spark, sf)).filter("metric = 'b'").selectExpr("'x' AS panel", "id", "grp", "left", "right")
    return tables.control_comparison(controls(spark, sf), ref, ["panel"], "grp", REPS, PERMS)


@query(
    "heterogeneity_points",
    f"""WITH {F_LONG}, sub AS (SELECT metric, 'stratum' AS covariate, stratum AS level, id, "left", "right" FROM f UNION ALL SELECT metric, 'grp', grp, id, "left", "right" FROM f),
    {agreement_sql('sub', 'metric, covariate, level', False)}
    SELECT metric, covariate, level, n, {TAU}, round(rho, 9) + 0.0 AS rho FROM rho JOIN pairwise USING (metric, covariate, level)""",
)
def _(spark, sf):
    from tandemrank.operators.strata import unpivot_strata

    rows = finite_pairs(long_pairs(spark, sf)).select("metric", "id", "left", "right", "stratum", "grp")
    out = tables.agreement(unpivot_strata(rows, ["stratum", "grp"]), ["metric", "covariate", "level"])
    return rounded(out, "tau", "rho")


@query("heterogeneity")
def _(spark, sf):
    rows = long_pairs(spark, sf).withColumn("cluster", F.expr("string(id % 40)"))
    return tables.heterogeneity(rows, M, ["stratum"], "cluster", REPS, PERMS)


@query(
    "tiny_keys",
    f"""WITH {F_LONG}, sub AS (SELECT metric, id % 700 AS cell, id, CASE WHEN id % 2 = 0 THEN 1.0 ELSE "left" END AS "left", "right" FROM f),
    {agreement_sql('sub', 'metric, cell', False)}
    SELECT metric, cell, n, round(s / nullif(sqrt(pairs - tl) * sqrt(pairs - tr), 0), 9) + 0.0 AS tau,
           round(CASE WHEN isnan(rho) THEN NULL ELSE rho END, 9) + 0.0 AS rho FROM rho LEFT JOIN pairwise USING (metric, cell)""",
)
def _(spark, sf):
    """Keys of one, two or three pairs, half of them with a constant side."""
    rows = finite_pairs(long_pairs(spark, sf)).selectExpr("metric", "id % 700 AS cell", "id", "IF(id % 2 = 0, 1D, `left`) AS `left`", "`right`")
    out = tables.agreement(rows, ["metric", "cell"], shift=True)
    return rounded(out.select("metric", "cell", "n", "tau", "rho"), "tau", "rho")


@query(
    "distance_thresholds",
    f"""WITH {F_LONG}, t0 AS (SELECT metric, unnest(list_distinct(quantile_cont(dist, [0.5, 0.625, 0.75, 0.875, 1.0]))) AS threshold FROM f GROUP BY metric),
    t AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY threshold) - 1 AS i, greatest(count(*) OVER (PARTITION BY metric) - 1, 1) AS steps FROM t0),
    sub AS (SELECT metric, threshold, id, "left", "right" FROM f JOIN t USING (metric) WHERE dist <= threshold + 1e-15), {agreement_sql('sub', 'metric, threshold', True)},
    c AS (SELECT metric, threshold, any_value(0.5 + 0.5 * i / steps) AS threshold_quantile, count(*) FILTER (WHERE dist IS NULL OR dist > threshold + 1e-15) AS n_excluded,
      count(*) FILTER (WHERE abs(dist - threshold) <= 1e-12) AS boundary_count, count(*) FILTER (WHERE dist <= threshold + 1e-15 AND stratum <> 'PROMO') AS n_not_identical
      FROM f JOIN t USING (metric) GROUP BY metric, threshold)
    SELECT metric, threshold, n, {TAU}, round(rho, 9) + 0.0 AS rho, round(naucc, 9) + 0.0 AS naucc, round(threshold_quantile, 9) + 0.0 AS threshold_quantile, n_excluded, boundary_count, n_not_identical
    FROM rho JOIN pairwise USING (metric, threshold) JOIN ar USING (metric, threshold) JOIN c USING (metric, threshold)""",
)
def _(spark, sf):
    rows = long_pairs(spark, sf).withColumn("relation", F.expr("IF(stratum = 'PROMO', 'identical', 'other')"))
    out = tables.distance_thresholds(rows, M, ["dist"], 5, relation="relation")
    counts = ["threshold_quantile", "n_excluded", "boundary_count", "n_not_identical"]
    return rounded(out.select("metric", "threshold", "n", "tau", "rho", "naucc", *counts), "tau", "rho", "naucc", "threshold_quantile")


@query(
    "distance_strata",
    f"""WITH {F_LONG}, p AS (SELECT metric, id, "left", "right", dist, CAST(ceil(row_number() OVER (PARTITION BY metric ORDER BY dist, id) * 5.0 / count(*) OVER (PARTITION BY metric)) AS BIGINT) AS stratum_no FROM f),
    {agreement_sql('p', 'metric, stratum_no', False)}, d AS (SELECT metric, stratum_no, min(dist) AS distance_min, max(dist) AS distance_max FROM p GROUP BY ALL)
    SELECT metric, stratum_no, n, {TAU}, round(rho, 9) + 0.0 AS rho, distance_min, distance_max FROM rho JOIN pairwise USING (metric, stratum_no) JOIN d USING (metric, stratum_no)""",
)
def _(spark, sf):
    out = tables.distance_strata(long_pairs(spark, sf), M, "dist")
    return rounded(out.select("metric", "stratum_no", "n", "tau", "rho", "distance_min", "distance_max"), "tau", "rho")


@query(
    "distance_trim",
    f"""WITH {F_LONG}, p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY dist DESC, id) AS far, count(*) OVER (PARTITION BY metric) AS sz FROM f),
    sub AS (SELECT metric, trim_fraction, id, "left", "right" FROM p, (SELECT CAST(unnest([0.0, 0.01, 0.05, 0.1, 0.2]) AS DOUBLE) AS trim_fraction) WHERE far > floor(trim_fraction * sz)),
    {agreement_sql('sub', 'metric, trim_fraction', True)}
    SELECT metric, trim_fraction, n, {TAU}, round(rho, 9) + 0.0 AS rho, round(naucc, 9) + 0.0 AS naucc, round(elite, 9) + 0.0 AS partial_elite
    FROM rho JOIN pairwise USING (metric, trim_fraction) JOIN ar USING (metric, trim_fraction)""",
)
def _(spark, sf):
    out = tables.distance_trim(long_pairs(spark, sf), M, "dist")
    return rounded(out.select("metric", "trim_fraction", "n", "tau", "rho", "naucc", "partial_elite"), "tau", "rho", "naucc", "partial_elite")


@query(
    "component_decomposition",
    f"""WITH {T_SQL}, n AS (SELECT id, k AS component, sqrt(list_sum([x * x for x in t[9 * k + 1:9 * k + 9]])) AS "left", sqrt(list_sum([x * x for x in u[9 * k + 1:9 * k + 9]])) AS "right" FROM tp, range(3) r(k)),
    {agreement_sql('n', 'component', False)}
    SELECT component, n, {TAU}, round(rho, 9) + 0.0 AS rho, 'ok' AS status FROM rho JOIN pairwise USING (component)""",
)
def _(spark, sf):
    from tandemrank.catalog.tensors import tensor_pairs

    part = f"{fn.norm('slice({t}, CAST(9 * component + 1 AS INT), 9)')}"
    rows = tensor_pairs(spark, sf).selectExpr("id", "t", "u", "explode(array(0L, 1L, 2L)) AS component").selectExpr(
        "id", "component", f"{part.replace('{t}', 't')} AS left", f"{part.replace('{t}', 'u')} AS right"
    )
    out = tables.component_decomposition(rows, ["component"])
    return rounded(out.select("component", "n", "tau", "rho", "status"), "tau", "rho")


@query(
    "baseline_comparison",
    f"""WITH {CURVE5}, {PAIRWISE.format(by='panel, metric', src='ranked')}, rho AS (SELECT panel, metric, corr(l_avg, r_avg) AS rho FROM ranked GROUP BY ALL)
    SELECT panel, metric, q, k, overlap, round(j, 9) + 0.0 AS observed_jaccard, round(adj, 9) + 0.0 AS adjusted_jaccard, round(overlap / k, 9) + 0.0 AS precision_at_k, {TAU}, round(rho, 9) + 0.0 AS rho
    FROM curve JOIN pairwise USING (panel, metric) JOIN rho USING (panel, metric)""",
)
def _(spark, sf):
    out = tables.baseline_comparison(panel_pairs(spark, sf), PM)
    cols = ["observed_jaccard", "adjusted_jaccard", "precision_at_k", "tau", "rho"]
    return rounded(out.select(*PM, "q", "k", "overlap", *cols), *cols)
