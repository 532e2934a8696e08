"""Budgeted cross-source selection: strategies, metrics, resampled intervals, tuning and cross-evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.frame import finite_pairs
from tandemrank.operators.rank import positions, rank_both
from tandemrank.operators.resample import cluster_draws, cumulative, percentile_ci, weighted_ranks
from tandemrank.operators.tau import TASK_ROWS
from tandemrank.session import bounded, materialize, spread_join

STRATEGIES = [
    "left_only", "right_only", "average_percentile", "borda_count", "maximin_percentile", "intersection_first",
    "balanced_union", "disagreement_abstention", "minimax_oracle",
]
SINGLE = ["left_only", "right_only"]

# Inputs of the rules that no one needs once rows are scored.
_SPENT = ["left", "right", "l_first", "l_last", "r_first", "r_last"]
# Per strategy: who goes first (1 before 0) and the score that orders the rest, highest first.
_RULES = {
    "average_percentile": ("0", "avg_pct"),
    "borda_count": ("0", "-((l_first + l_last) / 2.0D + (r_first + r_last) / 2.0D)"),
    "maximin_percentile": ("0", "least(pct_l, pct_r)"),
    "intersection_first": ("IF(in_left AND in_right, 1, 0)", "avg_pct"),
    "balanced_union": ("IF(in_left OR in_right, 1, 0)", "avg_pct"),
    "disagreement_abstention": ("0", "avg_pct - ({lam}) * abs(pct_l - pct_r)"),
}


def prepare(pairs: DataFrame, by: list[str], q_star: float, id: str = "id") -> DataFrame:
    """Ranked pairs with unit percentiles, elite flags and the elite size ``k = max(1, floor(q_star * n))``."""
    pct = "(n - ({s}_first + {s}_last) / 2.0D) / nullif(n - 1.0D, 0.0D)"
    return (
        rank_both(pairs, by, id, ties=True)
        .selectExpr(
            "*", f"{pct.format(s='l')} AS pct_l", f"{pct.format(s='r')} AS pct_r",
            f"greatest(1L, floor({q_star}D * n)) AS k",
        )
        .selectExpr("*", "0.5D * (pct_l + pct_r) AS avg_pct", "l_pos <= k AS in_left", "r_pos <= k AS in_right")
    )


def _budgets(factors: Sequence[float]) -> str:
    """SQL text that expands rows to (budget_factor, budget) with half-even rounding."""
    items = ", ".join(
        f"named_struct('budget_factor', {float(b)}D, 'budget', least(n, CAST(bround({float(b)}D * k) AS BIGINT)))"
        for b in factors
    )
    return f"inline(array({items}))"


def select(
    prepared: DataFrame, by: list[str], strategies: Sequence[str], factors: Sequence[float],
    lams: Sequence[str] = ("0.0D",), id: str = "id",
) -> DataFrame:
    """Selected rows per strategy, penalty and budget factor.

    ``lams`` are SQL expressions for the disagreement penalty: literals, or a tuned column of ``prepared``. Each
    strategy is one distributed sort of all rows, shared by all budgets, but for those that follow one source, whose
    order is known already. The one that depends on the budget, the oracle, is a sort inside its four membership
    cells and closed-form takes per cell.
    """
    parts = []
    single = [s for s in strategies if s in SINGLE]
    if single:
        items = ", ".join(
            f"named_struct('strategy', '{s}', 'lam', 0.0D, '_spot', {'l_pos' if s == 'left_only' else 'r_pos'})"
            for s in single
        )
        rows = prepared.drop(*_SPENT).selectExpr("*", f"inline(array({items}))")
        parts.append(rows.selectExpr("*", _budgets(factors)).filter("_spot <= budget").drop("_spot"))
    rules = [s for s in strategies if s in _RULES]
    if rules:
        items = []
        for s in rules:
            flag, score = _RULES[s]
            for lam in lams if s == "disagreement_abstention" else ["0.0D"]:
                items.append(
                    f"named_struct('strategy', '{s}', 'lam', CAST({lam} AS DOUBLE), '_flag', {flag}, "
                    f"'_score', {score.format(lam=lam)})"
                )
        rows = prepared.selectExpr("*", f"inline(array({', '.join(items)}))").drop(*_SPENT)
        rows = positions(
            rows, [*by, "strategy", "lam"], [F.col("_flag").desc(), F.col("_score").desc(), F.col(id).asc()],
            "_spot", count=None,
        )
        parts.append(
            rows.selectExpr("*", _budgets(factors)).filter("_spot <= budget").drop("_flag", "_score", "_spot")
        )
    if "minimax_oracle" in strategies:
        parts.append(_oracle(prepared.drop(*_SPENT), by, factors, id))
    unknown = set(strategies) - {*SINGLE, *_RULES, "minimax_oracle"}
    if unknown or not parts:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _oracle(prepared: DataFrame, by: list[str], factors: Sequence[float], id: str) -> DataFrame:
    """Largest worst-source recall for the budget: the common rows, then both one-sided cells in balance."""
    cell = "CASE WHEN in_left AND in_right THEN 'both' WHEN in_left THEN 'left' WHEN in_right THEN 'right' ELSE 'none' END"
    rows = prepared.selectExpr("*", f"{cell} AS _cell")
    counts = bounded(
        rows.groupBy(*by).agg(
            *[F.expr(f"count_if(_cell = '{c}') AS _n_{c}") for c in ("both", "left", "right")]
        )
    )
    rows = positions(rows, [*by, "_cell"], [F.col("avg_pct").desc(), F.col(id).asc()], "_spot", count=None)
    rows = rows.join(counts, by).selectExpr("*", _budgets(factors))
    rows = rows.selectExpr("*", "least(_n_both, budget) AS _tb").selectExpr("*", "budget - _tb AS _rem")
    # All one-sided rows if they fit; otherwise half the room each, shifted where one cell is too small.
    take_left = (
        "IF(_rem >= _n_left + _n_right, _n_left, "
        "least(least(_n_left, _rem), greatest(greatest(0L, _rem - _n_right), _rem div 2)))"
    )
    rows = rows.selectExpr("*", f"{take_left} AS _tl").selectExpr("*", "least(_n_right, _rem - _tl) AS _tr")
    take = "CASE _cell WHEN 'both' THEN _tb WHEN 'left' THEN _tl WHEN 'right' THEN _tr ELSE _rem - _tl - _tr END"
    return (
        rows.filter(f"_spot <= {take}")
        .selectExpr("*", "'minimax_oracle' AS strategy", "0.0D AS lam")
        .drop("_cell", "_n_both", "_n_left", "_n_right", "_spot", "_tb", "_rem", "_tl", "_tr")
    )


def ordered(selection: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """Final order of each portfolio: average percentile, then the smaller percentile, then id."""
    return positions(
        selection, [*by, "strategy", "lam", "budget_factor"],
        [F.col("avg_pct").desc(), F.least("pct_l", "pct_r").desc(), F.col(id).asc()], "place", count=None,
    )


RECALL = "least(count_if(in_left) / CAST(max(k) AS DOUBLE), count_if(in_right) / CAST(max(k) AS DOUBLE))"


def recalls(selection: DataFrame, by: list[str]) -> DataFrame:
    """Worst-source recall of each portfolio."""
    return selection.groupBy(*by, "strategy", "lam", "budget_factor").agg(
        F.expr(f"{RECALL} AS worst_source_recall")
    )


def metrics(selection: DataFrame, prepared: DataFrame, by: list[str], factors: Sequence[float], id: str = "id"):
    """Recall, NDCG, regrets, size and coverage of each portfolio.

    Gains are 2^percentile - 1; the ideal order is taken from the full universe of each source.
    """
    key = [*by, "strategy", "lam", "budget_factor"]
    rows = positions(selection, key, [F.col("avg_pct").desc(), F.col(id).asc()], "_place", count=None)
    got = rows.groupBy(*key).agg(
        F.expr(f"{RECALL} AS worst_source_recall"),
        F.expr("sum((pow(2.0D, pct_l) - 1) / log2(_place + 1.0D)) AS _dl"),
        F.expr("sum((pow(2.0D, pct_r) - 1) / log2(_place + 1.0D)) AS _dr"),
        F.expr("count(*) AS portfolio_size"), F.expr("max(n) AS _n"),
    )
    ideal = prepared.selectExpr("*", _budgets(factors)).filter("least(l_pos, r_pos) <= budget").groupBy(
        *by, "budget_factor"
    ).agg(
        F.expr("sum(IF(l_pos <= budget, (pow(2.0D, pct_l) - 1) / log2(l_pos + 1.0D), 0.0D)) AS _il"),
        F.expr("sum(IF(r_pos <= budget, (pow(2.0D, pct_r) - 1) / log2(r_pos + 1.0D), 0.0D)) AS _ir"),
    )
    return got.join(ideal, [*by, "budget_factor"]).selectExpr(
        *key, "worst_source_recall",
        "least(IF(_il > 0, _dl / _il, 0.0D), IF(_ir > 0, _dr / _ir, 0.0D)) AS worst_source_ndcg",
        "portfolio_size", "portfolio_size / CAST(_n AS DOUBLE) AS portfolio_coverage",
    ).selectExpr(
        "*", "1.0D - worst_source_recall AS minimax_recall_regret", "1.0D - worst_source_ndcg AS minimax_ndcg_regret"
    )


def benchmark(
    pairs: DataFrame, by: list[str], q_star: float, factors: Sequence[float], strategies=STRATEGIES,
    lams: Sequence[str] = ("0.0D",), id: str = "id",
) -> DataFrame:
    """Metrics of every strategy and budget, with the Pareto flag on (recall, coverage)."""
    prepared = materialize(prepare(pairs, by, q_star, id))
    chosen = materialize(select(prepared, by, strategies, factors, lams, id))
    table = materialize(metrics(chosen, prepared, by, factors, id))
    return pareto(table, [*by, "budget_factor"], "worst_source_recall", "portfolio_coverage")


def pareto(table: DataFrame, by: list[str], x: str, y: str, out: str = "pareto_efficient") -> DataFrame:
    """Flag the rows that no other row of the key beats (result tables: one row per portfolio)."""
    keys = ", ".join(by)
    best = table.groupBy(*by, x).agg(F.expr(f"max({y}) AS _same"))
    best = best.selectExpr(
        *by, x, "_same",
        f"max(_same) OVER (PARTITION BY {keys} ORDER BY {x} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _over",
    )
    return table.join(best, [*by, x]).selectExpr(
        *table.columns, f"NOT (coalesce(_over >= {y}, false) OR _same > {y}) AS {out}"
    )


def legacy_scores() -> dict[str, str]:
    """Older strategy names with a well-defined order, as score expressions on prepared rows."""
    return {
        "average_rank": "avg_pct", "maximin": "least(pct_l, pct_r)",
        "disagreement_fixed": "avg_pct - 2.0D * abs(pct_l - pct_r)",
    }


def legacy_select(prepared: DataFrame, by: list[str], id: str = "id") -> DataFrame:
    """Top-k rows of each older strategy."""
    items = ", ".join(f"named_struct('strategy', '{s}', '_score', {e})" for s, e in legacy_scores().items())
    rows = prepared.selectExpr("*", f"inline(array({items}))")
    rows = positions(rows, [*by, "strategy"], [F.col("_score").desc(), F.col(id).asc()], "_spot", count=None)
    return rows.filter("_spot <= k").drop("_spot", "_score")


def legacy_metrics(selection: DataFrame, by: list[str]) -> DataFrame:
    """Recall, rank regret (spread of average ranks in the selection, worse side) and coverage."""
    span = "max(({s}_first + {s}_last) / 2.0D) - min(({s}_first + {s}_last) / 2.0D)"
    return selection.groupBy(*by, "strategy").agg(
        F.expr(f"{RECALL} AS worst_source_recall"),
        F.expr(f"greatest({span.format(s='l')}, {span.format(s='r')}) AS worst_source_rank_regret"),
        F.expr("count(*) AS portfolio_size"), F.expr("count(*) / CAST(max(n) AS DOUBLE) AS portfolio_coverage"),
    )


def group_recalls(
    pairs: DataFrame, selection: DataFrame, by: list[str], grp: str, q_star: float, id: str = "id"
) -> DataFrame:
    """Worst-source recall of one selection inside every group, with elites taken per group."""
    rows = rank_both(pairs, [*by, grp], id)
    marked = selection.select(*by, id).distinct().withColumn("_sel", F.lit(True))
    rows = rows.join(marked, [*by, id], "left").selectExpr("*", f"greatest(1L, floor({q_star}D * n)) AS k")
    return rows.groupBy(*by, grp).agg(
        F.expr(
            "least(count_if(_sel AND l_pos <= k), count_if(_sel AND r_pos <= k)) / CAST(max(k) AS DOUBLE) AS recall"
        )
    )


def resampled(pairs: DataFrame, by: list[str], unit: str, reps: int, seed: int, id: str = "id") -> DataFrame:
    """Every replicate's rows; a row drawn w times becomes w rows whose id is (id, copy)."""
    base = finite_pairs(pairs).filter(F.col(unit).isNotNull()).select(*by, id, unit, "left", "right")
    draws = cluster_draws(base, by, unit, reps, seed).drop("_rows")
    keep = [*by, "rep", "`left`", "`right`"]
    unit_too = [f"`{unit}`"] if unit != id else []
    return spread_join(base, draws, [*by, unit], id).selectExpr(
        *keep, *unit_too, f"explode(transform(sequence(1, w), c -> named_struct('id', `{id}`, 'copy', c))) AS id"
    )


# Steps of a score's range; only the rows of the step in which a budget ends are sorted.
STEPS = 1024


def _steps(strategy: str, lam: str) -> str:
    """SQL text of the step of a rule's score, falling with it; equal scores share one, missing ones come last."""
    down = {
        "borda_count": "-_score / (2.0D * n)", "disagreement_abstention": f"0.5D - _score / (2.0D + 2.0D * abs({lam}))"
    }.get(strategy, "1.0D - _score")
    return f"coalesce(greatest(0, least({STEPS}, CAST(floor(({down}) * {STEPS}) AS INT))), {STEPS + 1})"


def weighted_recalls(
    rows: DataFrame, key: list[str], q_star: float, strategies: Sequence[str], factors: Sequence[float], lams: Sequence[str] = ("0.0D",),
    id: str = "id", size: int = TASK_ROWS,
) -> DataFrame:
    """Worst-source recall of each portfolio of each replicate, from written rows of ``weighted_ranks``; ``lams`` are literals.

    A row is never multiplied: of its w copies, ordered by id and copy, the first ``_el`` are in the left elite and the first ``_er`` in
    the right one, and a strategy takes a first part of them. What a strategy takes follows from the copies per step of its score; only
    rows of the one step in which the budget ends are put in order.
    """
    unknown = set(strategies) - {*SINGLE, *_RULES, "minimax_oracle"}
    if unknown or not strategies:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    pct = "(n - {s}_ends / 2.0D) / nullif(n - 1.0D, 0.0D) AS pct_{s}"
    rows = rows.selectExpr("*", f"greatest(1L, floor({q_star}D * n)) AS k", pct.format(s="l"), pct.format(s="r")).selectExpr(
        "*", "0.5D * (pct_l + pct_r) AS avg_pct", "greatest(0L, least(w, k - l_before)) AS _el", "greatest(0L, least(w, k - r_before)) AS _er"
    )
    budget = "least(n, CAST(bround({f}D * k) AS BIGINT))"
    sums = [F.expr("max(n) AS n"), F.expr("max(k) AS k"), F.expr("sum(least(_el, _er)) AS _both"), F.expr("sum(_el) AS _left"), F.expr("sum(_er) AS _right")]
    for i, f in enumerate(factors):
        for s in "lr":
            taken = f"greatest(0L, least(w, {budget.format(f=float(f))} - {s}_before))"
            sums += [F.expr(f"sum(least({taken}, _e{x})) AS _{s}{x}{i}") for x in "lr"]
    totals = materialize(rows.groupBy(*key).agg(*sums))
    grid = ", ".join(
        f"named_struct('budget_factor', {float(f)}D, 'budget', {budget.format(f=float(f))}, " + ", ".join(f"'_{s}{x}', _{s}{x}{i}" for s in "lr" for x in "lr") + ")"
        for i, f in enumerate(factors)
    )
    totals = totals.selectExpr(*key, "n", "k", "_both", "_left - _both AS _lone", "_right - _both AS _rone", f"inline(array({grid}))").filter("budget > 0")
    room = "(budget - least(_both, budget))"
    tl = f"IF({room} >= _lone + _rone, _lone, least(least(_lone, {room}), greatest(greatest(0L, {room} - _rone), {room} div 2)))"
    hits = {
        "left_only": ("_ll", "_lr"), "right_only": ("_rl", "_rr"),
        "minimax_oracle": (f"least(_both, budget) + {tl}", f"least(_both, budget) + least(_rone, {room} - {tl})"),
    }
    recall = "least(_hl / CAST(k AS DOUBLE), _hr / CAST(k AS DOUBLE)) AS worst_source_recall"
    shown = [*key, "strategy", "lam", "budget_factor"]
    plain = [f"named_struct('strategy', '{s}', 'lam', 0.0D, '_hl', {hits[s][0]}, '_hr', {hits[s][1]})" for s in strategies if s in hits]
    out = totals.selectExpr("*", f"inline(array({', '.join(plain)}))").selectExpr(*shown, recall) if plain else None

    rules = [(s, lam) for s in strategies if s in _RULES for lam in (lams if s == "disagreement_abstention" else ["0.0D"])]
    if not rules:
        return out
    # Copies (_from, _to] of a row that go together under a rule.
    cut = {"intersection_first": "least(_el, _er)", "balanced_union": "greatest(_el, _er)"}
    items = []
    for i, (s, lam) in enumerate(rules):
        score = {"borda_count": "-(l_ends / 2.0D + r_ends / 2.0D)"}.get(s, _RULES[s][1].format(lam=lam))
        step = _steps(s, lam).replace("_score", f"({score})")
        for flag, start, stop in ([(1, "0L", cut[s]), (0, cut[s], "w")] if s in cut else [(0, "0L", "w")]):
            items.append(f"named_struct('_rule', {i}, '_flag', {flag}, '_step', {step}, '_score', {score}, '_from', {start}, '_to', {stop})")
    parts = rows.selectExpr(*key, f"`{id}`", "_el", "_er", f"inline(array({', '.join(items)}))").filter("_to > _from")
    of = [*key, "_rule", "_flag", "_step"]
    inside = "least(_e{x}, {to}) - least(_e{x}, _from)"
    steps = materialize(parts.groupBy(*of).agg(
        F.expr("sum(_to - _from) AS _c"), *[F.expr(f"sum({inside.format(x=x, to='_to')}) AS _c{x}") for x in "lr"]
    ))
    order = f"PARTITION BY {', '.join(f'`{c}`' for c in [*key, '_rule'])} ORDER BY _flag DESC, _step ROWS UNBOUNDED PRECEDING"
    steps = steps.selectExpr(*of, "_c", *[f"sum({c}) OVER ({order}) - {c} AS {c}0" for c in ("_c", "_cl", "_cr")])
    ends = steps.join(bounded(totals.select(*key, "k", "budget_factor", "budget")), key).filter("_c0 < budget AND budget <= _c0 + _c")
    ends = materialize(ends.selectExpr(*of, "budget_factor", "k", "budget - _c0 AS _rest", "_cl0", "_cr0"))
    near = parts.join(bounded(ends.select(*of).distinct()), of).selectExpr(*of, f"`{id}`", "_score", "_from", "_to - _from AS w", "_el", "_er")
    near = positions(near, of, [F.col("_score").desc(), F.col(id).asc()])
    largest = int(near.agg(F.max("n")).first()[0] or 0)
    near = cumulative(near, of, "pos", "w", "_upto", largest, size)
    near = near.join(bounded(ends), of).selectExpr("*", "_from + greatest(0L, least(w, _rest - (_upto - w))) AS _last").filter("_last > _from")
    hit = [f"max(_c{x}0) + sum({inside.format(x=x, to='_last')}) AS _h{x}" for x in "lr"]
    named = ", ".join(f"named_struct('strategy', '{s}', 'lam', CAST({lam} AS DOUBLE))" for s, lam in rules)
    got = near.groupBy(*key, "_rule", "budget_factor", "k").agg(*[F.expr(h) for h in hit])
    got = got.selectExpr("*", f"inline(array(element_at(array({named}), _rule + 1)))").selectExpr(*shown, recall)
    return got if out is None else out.unionByName(got)


def full_procedure(
    pairs: DataFrame, by: list[str], unit: str, q_star: float, factors: Sequence[float], strategies: Sequence[str],
    reps: int, seed: int, lams: Sequence[str] = ("0.0D",), id: str = "id",
) -> DataFrame:
    """Recall differences to the left, right and better single source, with intervals from re-ranked replicates.

    The rows are ranked once; a replicate's ranks follow from its multiplicities (see ``weighted_ranks``).
    """
    base = finite_pairs(pairs).select(*by, *dict.fromkeys([id, unit]), "left", "right")
    ranked = materialize(rank_both(base, by, id, ties=True))
    names = list(dict.fromkeys([*strategies, *SINGLE]))

    def deltas(rows: DataFrame, key: list[str]) -> DataFrame:
        table = materialize(weighted_recalls(rows, key, q_star, names, factors, lams, id))
        ref = table.groupBy(*key, "budget_factor").agg(
            *[F.expr(f"max(IF(strategy = '{s}', worst_source_recall, NULL)) AS _{s}") for s in SINGLE]
        )
        return table.filter(F.col("strategy").isin(list(strategies))).join(ref, [*key, "budget_factor"]).selectExpr(
            *key, "strategy", "lam", "budget_factor",
            "inline(array(named_struct('delta_type', 'left', 'delta', worst_source_recall - _left_only), "
            "named_struct('delta_type', 'right', 'delta', worst_source_recall - _right_only), "
            "named_struct('delta_type', 'better', 'delta', worst_source_recall - greatest(_left_only, _right_only))))",
        )

    once = [f"{s}_pos - 1 AS {s}_before" for s in "lr"] + [f"{s}_first + {s}_last AS {s}_ends" for s in "lr"]
    point = deltas(ranked.selectExpr(*by, f"`{id}`", "1L AS w", "n", *once), by).withColumnRenamed("delta", "point")
    draws = materialize(cluster_draws(ranked, by, unit, reps, seed).drop("_rows"))
    boot = deltas(materialize(weighted_ranks(ranked, draws, by, [*by, "rep"], unit, id=id)), [*by, "rep"])
    key = [*by, "strategy", "lam", "budget_factor", "delta_type"]
    return point.join(percentile_ci(boot, key, "delta", 0, "ci95"), key, "left")


def metric_intervals(
    pairs: DataFrame, by: list[str], unit: str, strategy: str, q_star: float, factor: float, reps: int, seed: int,
    lam: str = "0.0D", id: str = "id",
) -> DataFrame:
    """Cluster-bootstrap intervals of one strategy's recall, NDCG and coverage."""
    key = [*by, "rep"]
    prepared = materialize(prepare(resampled(pairs, by, unit, reps, seed, id), key, q_star))
    chosen = materialize(select(prepared, key, [strategy], [factor], [lam]))
    table = materialize(metrics(chosen, prepared, key, [factor]))
    out = None
    for m in ("worst_source_recall", "worst_source_ndcg", "portfolio_coverage"):
        part = percentile_ci(table, by, m, reps, m)
        out = part if out is None else out.join(part, by)
    return out


def _best_penalty(rows: DataFrame, by: list[str], q_star: float, factor: float, grid: Sequence[float], id: str) -> DataFrame:
    """``best_lam`` per key from the rows of ``weighted_ranks`` of its replicates."""
    recall = weighted_recalls(rows, [*by, "rep"], q_star, ["disagreement_abstention"], [factor], [f"{float(x)}D" for x in grid], id)
    med = materialize(recall.groupBy(*by, "lam").agg(F.expr("percentile(worst_source_recall, 0.5) AS _med")))
    best = med.groupBy(*by).agg(F.expr("max(_med) AS _top"))
    return med.join(best, by).filter("_med >= _top - 1e-12D").groupBy(*by).agg(F.expr("min(lam) AS best_lam"))


def tune_penalty(
    pairs: DataFrame, by: list[str], unit: str, q_star: float, factor: float, grid: Sequence[float], reps: int,
    seed: int, id: str = "id",
) -> DataFrame:
    """Penalty with the highest median recall over replicates; the smaller one wins ties within 1e-12."""
    base = finite_pairs(pairs).filter(F.col(unit).isNotNull()).select(*by, *dict.fromkeys([id, unit]), "left", "right")
    ranked = materialize(rank_both(base, by, id, ties=True))
    draws = materialize(cluster_draws(ranked, by, unit, reps, seed).drop("_rows"))
    return _best_penalty(materialize(weighted_ranks(ranked, draws, by, [*by, "rep"], unit, id=id)), by, q_star, factor, grid, id)


FOLD = "aggregate(split(md5(CAST({id} AS STRING)), ''), 0, (a, d) -> IF(d = '', a, pmod(a * 16 + CAST(conv(d, 16, 10) AS INT), {n})))"


def fold_of(id: str, folds: int) -> str:
    """SQL text of md5(id) mod folds over all 128 bits, one hex digit at a time."""
    return FOLD.format(id=f"`{id}`", n=folds)


def cross_evaluate(
    pairs: DataFrame, by: list[str], unit: str, q_star: float, factor: float, strategies: Sequence[str], folds: int,
    grid: Sequence[float], reps: int, seed: int, id: str = "id", hash_by: str | None = None,
) -> DataFrame:
    """Per hashed fold: select and score on the fold, with the penalty tuned on the other folds.

    Folds hash the pair id by default; ``hash_by`` may name the cluster column, so that no cluster straddles folds.
    """
    rows = finite_pairs(pairs).select(*by, *dict.fromkeys([id, unit]), "left", "right")
    rows = materialize(rows.selectExpr("*", f"{fold_of(hash_by or id, folds)} AS fold"))
    key = [*by, "fold"]
    prepared = materialize(prepare(rows, key, q_star, id).filter("n >= 5"))
    names = list(dict.fromkeys([*strategies, *SINGLE]))
    if "disagreement_abstention" in names:
        # All rows are ranked once; a row has no weight in the replicates of its own fold.
        ranked = materialize(rank_both(rows.withColumnRenamed("fold", "_own"), by, id, ties=True))
        others = f"explode(filter(sequence(0, {folds - 1}), f -> f != _own)) AS fold"
        draws = materialize(cluster_draws(ranked.selectExpr(*by, f"`{unit}`", others), key, unit, reps, seed).drop("_rows"))
        boot = materialize(weighted_ranks(ranked, draws, by, [*key, "rep"], unit, ["_own"], "_own != fold", id))
        best = bounded(_best_penalty(boot, key, q_star, factor, grid, id))
        prepared = materialize(prepared.join(best, key, "left").selectExpr("*", "coalesce(best_lam, 0.0D) AS _lam"))
        lams = ["_lam"]
    else:
        lams = ["0.0D"]
    chosen = materialize(select(prepared, key, names, [factor], lams, id))
    table = materialize(metrics(chosen, prepared, key, [factor], id))
    ref = table.filter(F.col("strategy").isin(SINGLE)).groupBy(*key).agg(
        F.expr("max(worst_source_recall) AS _r"), F.expr("max(worst_source_ndcg) AS _d")
    )
    return table.filter(F.col("strategy").isin(list(strategies))).join(ref, key).selectExpr(
        *key, "strategy", "lam", "worst_source_recall", "worst_source_ndcg", "portfolio_size", "portfolio_coverage",
        "minimax_recall_regret", "worst_source_recall - _r AS paired_diff_recall",
        "worst_source_ndcg - _d AS paired_diff_ndcg",
    )


def projected_difference(
    pairs: DataFrame, flags: DataFrame, by: list[str], unit: str, q_star: float, reps: int, seed: int, id: str = "id",
    size: int = TASK_ROWS,
) -> DataFrame:
    """Recall difference of two fixed selections (``sel_a``, ``sel_b`` in ``flags``) projected on every resample.

    Of a row's w copies, ``clip(k - running weight, 0, w)`` fall in the replicate's top k of a side.
    """
    key = [*by, "rep"]
    ranked = materialize(
        rank_both(pairs.filter(F.col(unit).isNotNull()), by, id).join(flags, [*by, id], "left")
        .selectExpr(*by, *dict.fromkeys([f"`{id}`", f"`{unit}`"]), "l_pos", "r_pos", "n",
                    "coalesce(sel_a, false) AS sel_a", "coalesce(sel_b, false) AS sel_b")
    )
    draws = materialize(cluster_draws(ranked, by, unit, reps, seed))
    sizes = bounded(
        draws.groupBy(*key).agg(F.expr(f"greatest(1L, floor({q_star}D * sum(w * _rows))) AS k"))
    )
    largest = int(ranked.agg(F.max("n")).first()[0] or 0)
    rows = spread_join(ranked, draws.drop("_rows"), [*by, unit], id)
    rows = cumulative(cumulative(rows, key, "l_pos", "w", "_wl", largest, size), key, "r_pos", "w", "_wr", largest, size)
    rows = rows.join(sizes, key)
    hit = "sum(IF({s}, greatest(0L, least(w, k - ({c} - w))), 0L)) / CAST(max(k) AS DOUBLE)"
    both = {s: f"least({hit.format(s=s, c='_wl')}, {hit.format(s=s, c='_wr')})" for s in ("sel_a", "sel_b")}
    return rows.groupBy(*key).agg(F.expr(f"{both['sel_a']} - {both['sel_b']} AS difference"))


def inclusion_probability(
    pairs: DataFrame, by: list[str], unit: str, strategy: str, q_star: float, factor: float, reps: int, seed: int,
    id: str = "id",
) -> DataFrame:
    """Share of replicates that select a pair, among those in which its cluster was drawn."""
    key = [*by, "rep"]
    rows = materialize(resampled(pairs, by, unit, reps, seed, id))
    chosen = select(materialize(prepare(rows, key, q_star)), key, [strategy], [factor])
    seen = rows.selectExpr(*key, "id.id AS pair").groupBy(*by, "pair").agg(F.expr("count(DISTINCT rep) AS present"))
    hit = chosen.selectExpr(*key, "id.id AS pair").groupBy(*by, "pair").agg(F.expr("count(DISTINCT rep) AS selected"))
    return seen.join(hit, [*by, "pair"], "left").selectExpr(
        *by, "pair AS id", "present", "coalesce(selected, 0L) AS selected",
        "coalesce(selected, 0L) / CAST(present AS DOUBLE) AS inclusion_probability",
    )
