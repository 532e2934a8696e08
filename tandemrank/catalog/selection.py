"""Portfolio strategies, metrics, resampled intervals, high-response subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemrank.catalog.registry import query, rounded
from tandemrank.catalog.resampling import B, COPIES, F_LONG, M, PLAIN_TAU, QS, WEIGHTED, curves_sql, draws_sql, h_sql, weighted_tau
from tandemrank.catalog.views import CUST, FINITE, long_pairs, null_sql, pairs_cust, ranked_sql
from tandemrank.frame import finite_pairs
from tandemrank.operators import portfolio, subsets
from tandemrank.session import materialize

FACTORS = [1.0, 1.5, 2.0]


def prep_sql(ranked: str = "ranked", name: str = "prep") -> str:
    return f"""
{name} AS (SELECT *, 0.5 * (pl + pr) AS avg_pct, l_pos <= k AS il, r_pos <= k AS ir
         FROM (SELECT *, CAST(greatest(1, floor(0.1 * n)) AS BIGINT) AS k, (n - l_avg) / (n - 1.0) AS pl, (n - r_avg) / (n - 1.0) AS pr
               FROM {ranked}))"""


def strategies_sql(by: str, prep: str = "prep", lam: str = "0.5", factors=FACTORS, name: str = "chosen") -> str:
    rules = {
        "left_only": ("0", "-l_pos"), "right_only": ("0", "-r_pos"), "average_percentile": ("0", "avg_pct"),
        "borda_count": ("0", "-(l_avg + r_avg)"), "maximin_percentile": ("0", "least(pl, pr)"),
        "intersection_first": ("CAST(il AND ir AS INT)", "avg_pct"), "balanced_union": ("CAST(il OR ir AS INT)", "avg_pct"),
        "disagreement_abstention": ("0", f"avg_pct - {lam} * abs(pl - pr)"),
    }
    parts = " UNION ALL ".join(
        f"SELECT *, '{s}' AS strategy, {f} AS flag, CAST({x} AS DOUBLE) AS score FROM {prep}" for s, (f, x) in rules.items()
    )
    bs = ", ".join(map(str, factors))
    return f"""
{name}_all AS (SELECT *, row_number() OVER (PARTITION BY {by}, strategy ORDER BY flag DESC, score DESC, id) AS spot FROM ({parts})),
{name}_rules AS (SELECT *, least(n, CAST(round_even(budget_factor * k, 0) AS BIGINT)) AS budget
                 FROM {name}_all, (SELECT CAST(unnest([{bs}]) AS DOUBLE) AS budget_factor)),
{name}_cells AS (SELECT *, row_number() OVER (PARTITION BY {by}, il, ir ORDER BY avg_pct DESC, id) AS cpos FROM {prep}),
{name}_room AS (SELECT {by}, budget_factor, least(any_value(n), CAST(round_even(budget_factor * any_value(k), 0) AS BIGINT)) AS budget,
                  count(*) FILTER (WHERE il AND ir) AS nb, count(*) FILTER (WHERE il AND NOT ir) AS nl, count(*) FILTER (WHERE ir AND NOT il) AS nr
                FROM {prep}, (SELECT CAST(unnest([{bs}]) AS DOUBLE) AS budget_factor) GROUP BY {by}, budget_factor),
{name}_takes AS (SELECT *, least(nr, rem - tj) AS tm FROM (SELECT *, unnest(range(0, least(nl, rem) + 1)) AS tj
                 FROM (SELECT *, least(nb, budget) AS tb, budget - least(nb, budget) AS rem FROM {name}_room))),
{name}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}, budget_factor
                  ORDER BY least(tb + tj, tb + tm) DESC, tj + tm DESC, -abs(tj - tm) DESC, tj) AS r FROM {name}_takes) WHERE r = 1),
{name} AS (
  SELECT {by}, strategy, budget_factor, id, pl, pr, avg_pct, il, ir, l_pos, r_pos, n, k, budget FROM {name}_rules
  WHERE spot <= budget AND strategy IN (SELECT unnest(['{"', '".join(rules)}']))
  UNION ALL
  SELECT {', '.join('c.' + b.strip() for b in by.split(','))}, 'minimax_oracle', budget_factor, id, pl, pr, avg_pct, il, ir, l_pos, r_pos, n, k, budget
  FROM {name}_cells c JOIN {name}_best USING ({by})
  WHERE cpos <= CASE WHEN il AND ir THEN tb WHEN il THEN tj WHEN ir THEN tm ELSE rem - tj - tm END)"""


def metrics_sql(by: str, chosen: str = "chosen", prep: str = "prep", name: str = "scores") -> str:
    return f"""
{name}_m AS (SELECT *, row_number() OVER (PARTITION BY {by}, strategy, budget_factor ORDER BY avg_pct DESC, id) AS m FROM {chosen}),
{name}_got AS (SELECT {by}, strategy, budget_factor, least(count(*) FILTER (WHERE il) / any_value(k), count(*) FILTER (WHERE ir) / any_value(k)) AS recall,
            sum((pow(2, pl) - 1) / log2(m + 1)) AS dl, sum((pow(2, pr) - 1) / log2(m + 1)) AS dr, count(*) AS size, any_value(n) AS n
          FROM {name}_m GROUP BY {by}, strategy, budget_factor),
{name}_sizes AS (SELECT DISTINCT {by}, budget_factor, budget FROM {chosen}),
{name}_ideal AS (SELECT {by}, budget_factor, sum((pow(2, pl) - 1) / log2(l_pos + 1)) FILTER (WHERE l_pos <= budget) AS xl,
              sum((pow(2, pr) - 1) / log2(r_pos + 1)) FILTER (WHERE r_pos <= budget) AS xr
            FROM (SELECT p.*, s.budget_factor, s.budget FROM {prep} p JOIN {name}_sizes s USING ({by})) GROUP BY {by}, budget_factor),
{name} AS (SELECT {by}, strategy, budget_factor, recall, least(dl / xl, dr / xr) AS ndcg, size, size / n AS coverage
           FROM {name}_got JOIN {name}_ideal USING ({by}, budget_factor))"""


BASE = F_LONG + "," + ranked_sql("f", "metric") + "," + prep_sql()


def prepared(spark, sf):
    return materialize(portfolio.prepare(long_pairs(spark, sf), M, 0.1))


@query(
    "portfolio_select",
    f"WITH {BASE}, {strategies_sql('metric')} SELECT metric, strategy, budget_factor, id FROM chosen",
)
def _(spark, sf):
    rows = portfolio.select(prepared(spark, sf), M, portfolio.STRATEGIES, FACTORS, ["0.5D"])
    return rows.select("metric", "strategy", "budget_factor", "id")


@query(
    "portfolio_order",
    f"""WITH {BASE}, {strategies_sql('metric')}
    SELECT metric, strategy, budget_factor, id, row_number() OVER (PARTITION BY metric, strategy, budget_factor
           ORDER BY avg_pct DESC, least(pl, pr) DESC, id) AS place FROM chosen""",
)
def _(spark, sf):
    rows = portfolio.select(prepared(spark, sf), M, portfolio.STRATEGIES, FACTORS, ["0.5D"])
    return portfolio.ordered(rows, M).select("metric", "strategy", "budget_factor", "id", "place")


@query(
    "portfolio_benchmark",
    f"""WITH {BASE}, {strategies_sql('metric')}, {metrics_sql('metric')}
    SELECT metric, strategy, budget_factor, round(recall, 9) + 0.0 AS worst_source_recall, round(ndcg, 9) + 0.0 AS worst_source_ndcg,
           size AS portfolio_size, round(coverage, 9) + 0.0 AS portfolio_coverage, round(1 - recall, 9) + 0.0 AS minimax_recall_regret,
           NOT EXISTS (SELECT 1 FROM scores o WHERE o.metric = s.metric AND o.budget_factor = s.budget_factor
             AND o.recall >= s.recall AND o.coverage >= s.coverage AND (o.recall > s.recall OR o.coverage > s.coverage)) AS pareto_efficient
    FROM scores s""",
)
def _(spark, sf):
    out = portfolio.benchmark(long_pairs(spark, sf), M, 0.1, FACTORS, lams=["0.5D"])
    out = rounded(out, "worst_source_recall", "worst_source_ndcg", "portfolio_coverage", "minimax_recall_regret")
    return out.drop("lam", "minimax_ndcg_regret")


@query(
    "legacy_portfolios",
    f"""WITH {BASE}, s AS (SELECT *, 'average_rank' AS strategy, avg_pct AS score FROM prep UNION ALL SELECT *, 'maximin', least(pl, pr) FROM prep
      UNION ALL SELECT *, 'disagreement_fixed', avg_pct - 2.0 * abs(pl - pr) FROM prep),
    c AS (SELECT *, row_number() OVER (PARTITION BY metric, strategy ORDER BY score DESC, id) AS spot FROM s)
    SELECT metric, strategy, round(least(count(*) FILTER (WHERE il) / any_value(k), count(*) FILTER (WHERE ir) / any_value(k)), 9) + 0.0 AS worst_source_recall,
      greatest(max(l_avg) - min(l_avg), max(r_avg) - min(r_avg)) AS worst_source_rank_regret, count(*) AS portfolio_size,
      round(count(*) / any_value(n), 9) + 0.0 AS portfolio_coverage
    FROM c WHERE spot <= k GROUP BY metric, strategy""",
)
def _(spark, sf):
    out = portfolio.legacy_metrics(portfolio.legacy_select(prepared(spark, sf), M), M)
    return rounded(out, "worst_source_recall", "portfolio_coverage")


@query(
    "group_recalls",
    f"""WITH {BASE}, {strategies_sql('metric')}, sel AS (SELECT metric, id FROM chosen WHERE strategy = 'balanced_union' AND budget_factor = 1.0),
    g AS (SELECT metric, grp, id, row_number() OVER (PARTITION BY metric, grp ORDER BY "left" DESC, id) AS lp,
            row_number() OVER (PARTITION BY metric, grp ORDER BY "right" DESC, id) AS rp,
            CAST(greatest(1, floor(0.1 * count(*) OVER (PARTITION BY metric, grp))) AS BIGINT) AS gk FROM f)
    SELECT g.metric, grp, round(least(count(*) FILTER (WHERE sel.id IS NOT NULL AND lp <= gk), count(*) FILTER (WHERE sel.id IS NOT NULL AND rp <= gk))
           / any_value(gk), 9) + 0.0 AS recall
    FROM g LEFT JOIN sel ON sel.metric = g.metric AND sel.id = g.id GROUP BY g.metric, grp""",
)
def _(spark, sf):
    chosen = portfolio.select(prepared(spark, sf), M, ["balanced_union"], [1.0])
    return rounded(portfolio.group_recalls(long_pairs(spark, sf), chosen, M, "grp", 0.1), "recall")


BOOT = f"""{draws_sql('f', 'grp')},
copies AS (SELECT f.metric, rep, id AS pair, "left", "right", unnest(range(1, w + 1)) AS copy FROM f JOIN draws d ON d.metric = f.metric AND d.unit = f.grp),
rc AS (SELECT metric, rep, (pair, copy) AS id, "left", "right" FROM copies),
{ranked_sql('rc', 'metric, rep', 'branked')}, {prep_sql('branked', 'bprep')}"""


def recall_sql(chosen: str, by: str, name: str) -> str:
    return f"""{name} AS (SELECT {by}, strategy, budget_factor,
      least(count(*) FILTER (WHERE il) / any_value(k), count(*) FILTER (WHERE ir) / any_value(k)) AS recall FROM {chosen} GROUP BY {by}, strategy, budget_factor)"""


@query(
    "full_procedure_bootstrap",
    f"""WITH {BASE}, {strategies_sql('metric', lam='0.0')}, {recall_sql('chosen', 'metric', 'pt')}, {BOOT},
    {strategies_sql('metric, rep', 'bprep', '0.0', name='bchosen')}, {recall_sql('bchosen', 'metric, rep', 'bt')},
    pd AS (SELECT *, recall - max(recall) FILTER (WHERE strategy = 'left_only') OVER w AS dl, recall - max(recall) FILTER (WHERE strategy = 'right_only') OVER w AS dr,
             recall - max(recall) FILTER (WHERE strategy IN ('left_only', 'right_only')) OVER w AS db FROM pt WINDOW w AS (PARTITION BY metric, budget_factor)),
    bd AS (SELECT *, recall - max(recall) FILTER (WHERE strategy = 'left_only') OVER w AS dl, recall - max(recall) FILTER (WHERE strategy = 'right_only') OVER w AS dr,
             recall - max(recall) FILTER (WHERE strategy IN ('left_only', 'right_only')) OVER w AS db FROM bt WINDOW w AS (PARTITION BY metric, rep, budget_factor)),
    pl AS (UNPIVOT (SELECT metric, strategy, budget_factor, dl AS "left", dr AS "right", db AS better FROM pd) ON "left", "right", better INTO NAME delta_type VALUE v),
    bl AS (UNPIVOT (SELECT metric, strategy, budget_factor, dl AS "left", dr AS "right", db AS better FROM bd) ON "left", "right", better INTO NAME delta_type VALUE v)
    SELECT metric, strategy, budget_factor, delta_type, round(any_value(pl.v), 9) + 0.0 AS point,
           round(quantile_cont(bl.v, 0.025), 9) + 0.0 AS ci95_low, round(quantile_cont(bl.v, 0.975), 9) + 0.0 AS ci95_high
    FROM pl JOIN bl USING (metric, strategy, budget_factor, delta_type) GROUP BY ALL""",
)
def _(spark, sf):
    out = portfolio.full_procedure(long_pairs(spark, sf), M, "grp", 0.1, FACTORS, portfolio.STRATEGIES, B, 42)
    return rounded(out.drop("lam"), "point", "ci95_low", "ci95_high")


@query(
    "portfolio_intervals",
    f"""WITH {F_LONG}, {BOOT}, {strategies_sql('metric, rep', 'bprep', '0.0', [1.0])}, {metrics_sql('metric, rep', prep='bprep')}
    SELECT metric, round(quantile_cont(recall, 0.025), 9) + 0.0 AS worst_source_recall_low, round(quantile_cont(recall, 0.975), 9) + 0.0 AS worst_source_recall_high,
      round(quantile_cont(ndcg, 0.025), 9) + 0.0 AS worst_source_ndcg_low, round(quantile_cont(ndcg, 0.975), 9) + 0.0 AS worst_source_ndcg_high,
      round(quantile_cont(coverage, 0.025), 9) + 0.0 AS portfolio_coverage_low, round(quantile_cont(coverage, 0.975), 9) + 0.0 AS portfolio_coverage_high
    FROM scores WHERE strategy = 'balanced_union' GROUP BY metric""",
)
def _(spark, sf):
    out = portfolio.metric_intervals(long_pairs(spark, sf), M, "grp", "balanced_union", 0.1, 1.0, B, 42)
    return rounded(out, *[c for c in out.columns if c != "metric"])


GRID = [0.0, 0.5, 1.0, 2.0]


def tuned_sql(by: str, prep: str, name: str) -> str:
    """Median recall over replicates per penalty; the smallest penalty near the best median."""
    return f"""
{name}_l AS (SELECT *, row_number() OVER (PARTITION BY {by}, rep, lam ORDER BY avg_pct - lam * abs(pl - pr) DESC, id) AS spot
       FROM {prep}, (SELECT CAST(unnest({GRID}) AS DOUBLE) AS lam)),
{name}_r AS (SELECT {by}, rep, lam, least(count(*) FILTER (WHERE il) / any_value(k), count(*) FILTER (WHERE ir) / any_value(k)) AS recall
       FROM {name}_l WHERE spot <= k GROUP BY {by}, rep, lam),
{name}_m AS (SELECT {by}, lam, median(recall) AS med FROM {name}_r GROUP BY {by}, lam),
{name} AS (SELECT {by}, min(lam) AS best_lam FROM (SELECT *, max(med) OVER (PARTITION BY {by}) AS top FROM {name}_m) WHERE med >= top - 1e-12 GROUP BY {by})"""


@query("tune_penalty", f"WITH {F_LONG}, {BOOT}, {tuned_sql('metric', 'bprep', 'tuned')} SELECT metric, best_lam FROM tuned")
def _(spark, sf):
    return portfolio.tune_penalty(long_pairs(spark, sf), M, "grp", 0.1, 1.0, GRID, B, 42)


def fold_sql(id: str, n: int) -> str:
    """md5 mod n from its four 32-bit words."""
    words = [f"CAST('0x' || substr(md5(CAST({id} AS VARCHAR)), {1 + 8 * i}, 8) AS BIGINT) * {pow(16, 8 * (3 - i), n)}" for i in range(4)]
    return f"({' + '.join(words)}) % {n}"


@query("hash_folds", f"WITH {F_LONG} SELECT metric, id, {fold_sql('id', 5)} AS fold FROM f")
def _(spark, sf):
    return finite_pairs(long_pairs(spark, sf)).selectExpr(
        "metric", "id", f"CAST({portfolio.fold_of('id', 5)} AS BIGINT) AS fold"
    )


@query(
    "cross_evaluation",
    f"""WITH {F_LONG}, folded AS (SELECT *, {fold_sql('id', 5)} AS fold FROM f),
    {ranked_sql('folded', 'metric, fold')}, {prep_sql()},
    tr AS (SELECT a.metric || '/' || b.fold AS mf, a.metric, b.fold, a.id, a.grp, a."left", a."right" FROM folded a, range(5) b(fold) WHERE a.fold <> b.fold),
    {draws_sql('tr', 'grp', by='mf', reps=4, seed=48)},
    copies AS (SELECT tr.metric, tr.fold, rep, tr.id AS pair, "left", "right", unnest(range(1, w + 1)) AS copy FROM tr JOIN draws d ON d.mf = tr.mf AND d.unit = tr.grp),
    rc AS (SELECT metric, fold, rep, (pair, copy) AS id, "left", "right" FROM copies),
    {ranked_sql('rc', 'metric, fold, rep', 'branked')}, {prep_sql('branked', 'bprep')}, {tuned_sql('metric, fold', 'bprep', 'tuned')},
    lamprep AS (SELECT * FROM prep JOIN tuned USING (metric, fold)),
    {strategies_sql('metric, fold', 'lamprep', 'best_lam', [1.0])}, {metrics_sql('metric, fold', prep='lamprep')},
    ref AS (SELECT metric, fold, max(recall) FILTER (WHERE strategy IN ('left_only', 'right_only')) AS rr,
              max(ndcg) FILTER (WHERE strategy IN ('left_only', 'right_only')) AS rn FROM scores GROUP BY metric, fold)
    SELECT metric, fold, strategy, round(recall, 9) + 0.0 AS worst_source_recall, round(ndcg, 9) + 0.0 AS worst_source_ndcg,
      round(recall - rr, 9) + 0.0 AS paired_diff_recall, round(ndcg - rn, 9) + 0.0 AS paired_diff_ndcg, size AS portfolio_size
    FROM scores JOIN ref USING (metric, fold)""",
)
def _(spark, sf):
    out = portfolio.cross_evaluate(
        long_pairs(spark, sf), M, "grp", 0.1, 1.0, portfolio.STRATEGIES, 5, GRID, 4, 48
    )
    cols = ["worst_source_recall", "worst_source_ndcg", "paired_diff_recall", "paired_diff_ndcg"]
    return rounded(
        out.withColumn("fold", F.col("fold").cast("bigint")).select("metric", "fold", "strategy", *cols, "portfolio_size"),
        *cols,
    )


@query(
    "projected_difference",
    f"""WITH {BASE}, {strategies_sql('metric')}, a AS (SELECT metric, id FROM chosen WHERE strategy = 'balanced_union' AND budget_factor = 1.0),
    b AS (SELECT metric, id FROM chosen WHERE strategy = 'left_only' AND budget_factor = 1.0), {draws_sql('f', 'grp')},
    copies AS (SELECT f.metric, rep, f.id, "left", "right", unnest(range(w)) AS copy FROM f JOIN draws d ON d.metric = f.metric AND d.unit = f.grp),
    p AS (SELECT *, row_number() OVER (PARTITION BY metric, rep ORDER BY "left" DESC, id, copy) AS lp,
            row_number() OVER (PARTITION BY metric, rep ORDER BY "right" DESC, id, copy) AS rp,
            CAST(greatest(1, floor(0.1 * count(*) OVER (PARTITION BY metric, rep))) AS BIGINT) AS bk FROM copies),
    s AS (SELECT p.*, a.id IS NOT NULL AS ia, b.id IS NOT NULL AS ib FROM p LEFT JOIN a ON a.metric = p.metric AND a.id = p.id
            LEFT JOIN b ON b.metric = p.metric AND b.id = p.id)
    SELECT metric, rep, round(least(count(*) FILTER (WHERE ia AND lp <= bk), count(*) FILTER (WHERE ia AND rp <= bk)) / any_value(bk)
      - least(count(*) FILTER (WHERE ib AND lp <= bk), count(*) FILTER (WHERE ib AND rp <= bk)) / any_value(bk), 9) + 0.0 AS difference
    FROM s GROUP BY metric, rep""",
)
def _(spark, sf):
    chosen = portfolio.select(prepared(spark, sf), M, ["balanced_union", "left_only"], [1.0])
    flags = chosen.groupBy("metric", "id").agg(
        F.max(F.col("strategy") == "balanced_union").alias("sel_a"), F.max(F.col("strategy") == "left_only").alias("sel_b")
    )
    out = portfolio.projected_difference(long_pairs(spark, sf), flags, M, "grp", 0.1, B, 42)
    return rounded(out.withColumn("rep", F.col("rep").cast("bigint")), "difference")


@query(
    "inclusion_probability",
    f"""WITH {F_LONG}, {BOOT}, {strategies_sql('metric, rep', 'bprep', '0.0', [1.0])},
    seen AS (SELECT metric, pair, count(DISTINCT rep) AS present FROM copies GROUP BY metric, pair),
    hit AS (SELECT metric, id[1] AS pair, count(DISTINCT rep) AS selected FROM chosen WHERE strategy = 'average_percentile' GROUP BY metric, id[1])
    SELECT metric, s.pair AS id, present, coalesce(selected, 0) AS selected, round(coalesce(selected, 0) / present, 9) + 0.0 AS inclusion_probability
    FROM seen s LEFT JOIN hit h USING (metric, pair)""",
)
def _(spark, sf):
    out = portfolio.inclusion_probability(long_pairs(spark, sf), M, "grp", "average_percentile", 0.1, 1.0, B, 42)
    return rounded(out, "inclusion_probability")


HIGH = f"""
cuts AS (SELECT metric, quantile_cont(least("left", "right"), [0.9, 0.75]) AS qmin, quantile_cont(0.5 * ("left" + "right"), [0.9, 0.75]) AS qmean FROM f GROUP BY metric),
high AS (SELECT metric, id, grp, "left", "right", method, fraction FROM (
  SELECT r.*, unnest([0.1, 0.25]) AS fraction, unnest(qmin) AS a, unnest(qmean) AS b FROM ranked r JOIN cuts USING (metric)),
  (SELECT unnest(['dual_high', 'anchor_left', 'anchor_right', 'pooled']) AS method)
  WHERE CASE method WHEN 'dual_high' THEN "left" > a AND "right" > a WHEN 'pooled' THEN 0.5 * ("left" + "right") >= b
        WHEN 'anchor_left' THEN l_pos <= greatest(1, floor(fraction * n)) ELSE r_pos <= greatest(1, floor(fraction * n)) END)"""


@query(
    "high_response",
    f"""WITH {F_LONG}, {ranked_sql('f', 'metric')}, {HIGH}
    SELECT metric, method, CAST(fraction AS DOUBLE) AS fraction, id FROM high""",
)
def _(spark, sf):
    return subsets.high_response(long_pairs(spark, sf), M, [0.1, 0.25]).select("metric", "method", "fraction", "id")


def area_of(src: str, by: str, name: str) -> str:
    """nAUCC of the rows of ``src`` (with l_pos, r_pos, n) per key."""
    return f"""
{name}_c AS (SELECT {by}, q, n, k, count(*) FILTER (WHERE greatest(l_pos, r_pos) <= k) AS overlap
   FROM (SELECT *, CAST(greatest(1, floor(q / 100.0 * n)) AS BIGINT) AS k FROM {src}, {QS}) GROUP BY {by}, q, n, k),{null_sql(name + '_c', name + '_n')},
{name}_a AS (SELECT {by}, q, (overlap / (2.0 * k - overlap) - ej) / (1.0 - ej) AS adj FROM {name}_c JOIN {name}_n USING (n, k)),
{name}_s AS (SELECT *, lag(q) OVER w AS q0, lag(adj) OVER w AS y0 FROM {name}_a WINDOW w AS (PARTITION BY {by} ORDER BY q)),
{name} AS (SELECT {by}, sum((q - q0) * (adj + y0) / 2.0) / 49.0 AS naucc, sum((q - q0) * (adj + y0) / 2.0) FILTER (WHERE q <= 10) / 9.0 AS elite
           FROM {name}_s GROUP BY {by})"""


@query(
    "high_response_table",
    f"""WITH {F_LONG}, {ranked_sql('f', 'metric')}, {HIGH}, hk AS (SELECT *, metric || method || fraction AS hkey FROM high),
    {ranked_sql('hk', 'metric, method, fraction', 'hr')}, {area_of('hr', 'metric, method, fraction', 'ar')},
    {PLAIN_TAU.format(name='taus', by='metric, method, fraction', src='hk')}
    SELECT metric, method, CAST(fraction AS DOUBLE) AS fraction, (SELECT count(*) FROM high h WHERE h.metric = a.metric AND h.method = a.method AND h.fraction = a.fraction) AS n,
      round(naucc, 9) + 0.0 AS naucc, round(tau, 9) + 0.0 AS tau FROM ar a JOIN taus USING (metric, method, fraction)""",
)
def _(spark, sf):
    from tandemrank.plans.tables import high_response_table

    out = high_response_table(long_pairs(spark, sf), M, [0.1, 0.25])
    return rounded(out.select(*M, "method", "fraction", "n", "naucc", "tau"), "naucc", "tau")


@query(
    "high_response_intervals",
    f"""WITH f AS (SELECT metric || '|' || method || '|' || fraction AS metric, metric AS m0, method, CAST(fraction AS DOUBLE) AS fraction, id, grp, "left", "right"
      FROM (WITH {F_LONG}, {ranked_sql('f', 'metric')}, {HIGH} SELECT * FROM high)),
    {draws_sql('f', 'grp').strip()}, {WEIGHTED.format(unit='grp')}, {weighted_tau('wf', 'metric, rep').strip()}, {COPIES.format(unit='grp').strip()}, {curves_sql(True).strip()},
    {ranked_sql('f', 'metric', 'hr').strip()}, {area_of('hr', 'metric', 'ar').strip()}, {PLAIN_TAU.format(name='whole', by='metric', src='f')},
    sel AS (SELECT metric, id, "left", "right" FROM f WHERE method = 'pooled'),
    sw AS (SELECT metric, rep, id, CASE WHEN {h_sql('42', 'rep', 'id')} % 2 = 1 THEN "right" ELSE "left" END AS "left",
             CASE WHEN {h_sql('42', 'rep', 'id')} % 2 = 1 THEN "left" ELSE "right" END AS "right" FROM sel, range({B}) r(rep)),
    {ranked_sql('sw', 'metric, rep', 'swr').strip()}, {area_of('swr', 'metric, rep', 'pm').strip()},
    pv AS (SELECT pm.metric, (1 + count(*) FILTER (WHERE pm.naucc >= ar.naucc)) / (count(*) + 1.0) AS p FROM pm JOIN ar ON ar.metric = pm.metric GROUP BY pm.metric),
    tc AS (SELECT metric, quantile_cont(tau, 0.025) AS tl, quantile_cont(tau, 0.975) AS th FROM taus GROUP BY metric),
    nc AS (SELECT metric, quantile_cont(naucc, 0.025) AS nl, quantile_cont(naucc, 0.975) AS nh FROM boot_area GROUP BY metric),
    ks AS (SELECT metric, any_value(m0) AS m0, any_value(method) AS method, any_value(fraction) AS fraction, count(*) AS n FROM f GROUP BY metric)
    SELECT m0 AS metric, method, fraction, n, round(ar.naucc, 9) + 0.0 AS naucc, round(whole.tau, 9) + 0.0 AS tau, round(tl, 9) + 0.0 AS tau_ci95_low, round(th, 9) + 0.0 AS tau_ci95_high,
      round(nl, 9) + 0.0 AS naucc_ci95_low, round(nh, 9) + 0.0 AS naucc_ci95_high, round(p, 9) + 0.0 AS swap_pvalue
    FROM ks JOIN ar USING (metric) JOIN whole USING (metric) LEFT JOIN tc USING (metric) LEFT JOIN nc USING (metric) LEFT JOIN pv USING (metric)""",
)
def _(spark, sf):
    from tandemrank.plans.tables import high_response_intervals

    out = high_response_intervals(long_pairs(spark, sf), M, [0.1, 0.25], "grp", B, B)
    shown = ["naucc", "tau", "tau_ci95_low", "tau_ci95_high", "naucc_ci95_low", "naucc_ci95_high", "swap_pvalue"]
    return rounded(out.select(*M, "method", "fraction", "n", *shown), *shown)


@query(
    "swap_permutation",
    f"""WITH {F_LONG}, {ranked_sql('f', 'metric')}, {HIGH}, sel AS (SELECT metric, id, "left", "right" FROM high WHERE method = 'pooled' AND fraction = 0.25),
    {ranked_sql('sel', 'metric', 'sr')}, {area_of('sr', 'metric', 'obs')},
    sw AS (SELECT metric, rep, id, CASE WHEN {h_sql('50', 'rep', 'id')} % 2 = 1 THEN "right" ELSE "left" END AS "left",
             CASE WHEN {h_sql('50', 'rep', 'id')} % 2 = 1 THEN "left" ELSE "right" END AS "right" FROM sel, range({B}) r(rep)),
    {ranked_sql('sw', 'metric, rep', 'swr')}, {area_of('swr', 'metric, rep', 'pm')}
    SELECT p.metric, round(any_value(o.naucc), 9) + 0.0 AS observed_naucc, round(avg(p.naucc), 9) + 0.0 AS permuted_mean_naucc,
      round(stddev_samp(p.naucc), 9) + 0.0 AS permuted_std_naucc,
      round((1 + count(*) FILTER (WHERE p.naucc >= o.naucc)) / (count(*) + 1.0), 9) + 0.0 AS pvalue,
      (SELECT count(*) FROM sel WHERE sel.metric = p.metric) AS n_selected
    FROM pm p JOIN obs o ON o.metric = p.metric GROUP BY p.metric""",
)
def _(spark, sf):
    out = subsets.swap_permutation(long_pairs(spark, sf), M, 0.25, B, 50)
    return rounded(out, "observed_naucc", "permuted_mean_naucc", "permuted_std_naucc", "pvalue")


@query(
    "tie_break_audit",
    f"""WITH {CUST}, c AS (SELECT *, 'c' AS metric FROM pairs_cust WHERE {FINITE}), {ranked_sql('c', 'metric')}, {area_of('ranked', 'metric', 'st')},
    sh AS (SELECT metric, rep, id, count(*) OVER (PARTITION BY metric, rep) AS n,
             row_number() OVER (PARTITION BY metric, rep ORDER BY "left" DESC, {h_sql('42', 'rep', "'l'", 'id')}, id) AS l_pos,
             row_number() OVER (PARTITION BY metric, rep ORDER BY "right" DESC, {h_sql('42', 'rep', "'r'", 'id')}, id) AS r_pos FROM c, range({B}) t(rep)),
    {area_of('sh', 'metric, rep', 'ar')},
    tp AS (SELECT metric, rep, count(*) FILTER (WHERE greatest(l_pos, r_pos) <= greatest(1, floor(10 / 100.0 * n))) AS o FROM sh GROUP BY metric, rep)
    SELECT metric, round((SELECT naucc FROM st), 9) + 0.0 AS naucc_stable, round(min(naucc), 9) + 0.0 AS naucc_min, round(max(naucc), 9) + 0.0 AS naucc_max,
      round(min(elite), 9) + 0.0 AS elite_min, round(max(elite), 9) + 0.0 AS elite_max, min(o) AS top10_overlap_min, max(o) AS top10_overlap_max,
      round(quantile_cont(naucc, 0.025), 9) + 0.0 AS naucc_ci95_low, round(quantile_cont(naucc, 0.975), 9) + 0.0 AS naucc_ci95_high
    FROM ar JOIN tp USING (metric, rep) GROUP BY metric""",
)
def _(spark, sf):
    out = subsets.tie_break_audit(pairs_cust(spark, sf).withColumn("metric", F.lit("c")), M, B, 42)
    return rounded(
        out, "naucc_stable", "naucc_min", "naucc_max", "elite_min", "elite_max", "naucc_ci95_low", "naucc_ci95_high"
    )
