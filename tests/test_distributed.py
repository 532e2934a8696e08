"""Operators against brute force, over partition counts, heavy ties and forced small blocks."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemrank.functions.null_model import null_support
from tandemrank.operators import overlap, portfolio, quantile, resample, ties
from tandemrank.operators.distribution import cumulative_sides
from tandemrank.operators.rank import positions, rank_both, tie_ranks
from tandemrank.operators.tau import discordant, kendall_parts, kendall_tau, value_blocks, with_blocks
from tandemrank.session import materialize

BY = ["panel"]


def tau_b(x, y, w=None):
    x, y = np.asarray(x, float), np.asarray(y, float)
    if w is not None:
        x, y = np.repeat(x, w), np.repeat(y, w)
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    iu = np.triu_indices(len(x), 1)
    a, b = sx[iu], sy[iu]
    return (a * b).sum() / math.sqrt((a != 0).sum() * (b != 0).sum())


def hot_scores(seed, n=600):
    """A third of the rows share one value on each side."""
    rng = np.random.default_rng(seed)
    left, right = rng.integers(0, 40, n).astype(float), rng.normal(size=n).round(1)
    left[rng.random(n) < 0.34] = 7.0
    right[rng.random(n) < 0.34] = 0.0
    return left, right


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_ranks_do_not_depend_on_partitions(spark, pairs, parts):
    left, right = hot_scores(1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = rank_both(pairs(left, right).repartition(parts), BY, ties=True).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for side, x in (("l", left), ("r", right)):
        order = np.lexsort((np.arange(len(x)), -x))
        pos = np.empty(len(x), int)
        pos[order] = np.arange(1, len(x) + 1)
        assert [r[f"{side}_pos"] for r in rows] == pos.tolist()
        assert [r[f"{side}_first"] for r in rows] == [int((x > v).sum()) + 1 for v in x]
        assert [r[f"{side}_last"] for r in rows] == [int((x >= v).sum()) for v in x]


def test_one_value_over_many_tasks(spark):
    """A single tied value is split over tasks by id and its run is still found."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(900).selectExpr("'p' AS panel", "id", "IF(id < 5, 2D, IF(id > 895, 0D, 1D)) AS x")
        ranked = tie_ranks(df, BY, "x", "id", "l")
        runs = {(r.x, r.l_first, r.l_last) for r in ranked.collect()}
        tasks = positions(df, BY, [F.col("x").desc(), F.col("id").asc()]).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert runs == {(2.0, 1, 5), (1.0, 6, 896), (0.0, 897, 900)} and tasks > 1


@pytest.mark.parametrize("seed", range(4))
def test_discordant_kernel(seed):
    rng = np.random.default_rng(seed)
    x, y, w = rng.integers(0, 9, 60), rng.integers(0, 7, 60), rng.integers(1, 4, 60)
    want = sum(
        w[i] * w[j] for i, j in itertools.permutations(range(60), 2) if x[i] < x[j] and y[i] > y[j]
    )
    assert discordant(x, y, w) == want


@pytest.mark.parametrize("size", [10_000, 150, 20, 4])
def test_tau_in_blocks(pairs, size):
    left, right = hot_scores(3)
    got = kendall_tau(pairs(left, right), BY, size=size).first()
    assert got.tau == pytest.approx(tau_b(left, right)) and got.n == 600


def test_weighted_tau_in_blocks(pairs):
    left, right = hot_scores(4, 200)
    w = np.random.default_rng(5).integers(1, 4, 200)
    frame = pairs(left, right).withColumn("w", F.element_at(F.array(*[F.lit(int(v)) for v in w]), F.col("id").cast("int") + 1))
    want = tau_b(left, right, w)
    assert kendall_tau(frame, BY, weight="w").first().tau == pytest.approx(want)
    blocked = value_blocks(frame, BY, size=15)
    assert kendall_tau(blocked, BY, weight="w", size=15).first().tau == pytest.approx(want)
    assert kendall_parts(frame, BY, weight="w").first().n == w.sum()


def test_constant_side_has_no_tau(pairs):
    assert kendall_tau(pairs([1, 1, 1], [1, 2, 3]), BY).first().tau is None


@pytest.mark.parametrize("n,k", [(10, 3), (50, 25), (200, 20), (7, 7), (5, 1)])
def test_null_model(n, k):
    xs, pmf = null_support(n, k)
    want = {x: math.comb(k, x) * math.comb(n - k, k - x) / math.comb(n, k) for x in range(max(0, 2 * k - n), k + 1)}
    assert dict(zip(xs.astype(int), pmf)) == pytest.approx(want)


def test_null_model_at_scale():
    xs, pmf = null_support(10**9, 10**8)
    assert len(xs) < 10**6 and (xs * pmf).sum() == pytest.approx(10**7, rel=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_tie_bounds_against_enumeration(pairs, seed):
    rng = np.random.default_rng(seed)
    left, right = rng.integers(0, 4, 12).astype(float), rng.integers(0, 4, 12).astype(float)
    got = {r.k: (r.min_overlap, r.max_overlap) for r in ties.cutoff_diagnostics(
        rank_both(pairs(left, right), BY, ties=True), BY, [25.0, 50.0, 75.0]).collect()}

    def tops(x, k):
        cut = np.sort(x)[::-1][k - 1]
        must, may = set(np.flatnonzero(x > cut)), np.flatnonzero(x == cut)
        return [must | set(c) for c in itertools.combinations(may, k - len(must))]

    for k, bounds in got.items():
        sizes = [len(a & b) for a in tops(left, k) for b in tops(right, k)]
        assert bounds == (min(sizes), max(sizes))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, 501).astype(float)
    df = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(x)], "panel string, id bigint, x double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.975, "e": 1.0}
    row = quantile.quantiles(df, BY, "x", "id", probs).first()
    assert [row[n] for n in probs] == pytest.approx([np.quantile(x, p) for p in probs.values()])


def test_nested_medians(spark):
    rng = np.random.default_rng(8)
    v, lvl = rng.integers(0, 50, 4000), rng.integers(0, 5, 4000)
    df = spark.createDataFrame([("p", i, float(a), int(b)) for i, (a, b) in enumerate(zip(v, lvl))], "panel string, id bigint, v double, lvl int")
    got = {r.lvl: r.m for r in quantile.nested_medians(df, BY, "v", "id", "lvl", [0, 1, 2, 3], "m").collect()}
    assert got == {k: float(np.median(v[lvl <= k])) for k in range(4)}


def test_cumulative_sides(pairs):
    left, right = hot_scores(6, 300)
    rows = cumulative_sides(pairs(left, right), BY).collect()
    assert all(r.cum_left == (left <= r.v).sum() and r.cum_right == (right <= r.v).sum() for r in rows)


@pytest.mark.parametrize("size", [10_000, 37])
def test_bootstrap_curves_against_copies(pairs, size):
    left, right = hot_scores(7, 240)
    frame = pairs(left, right, grp=[i % 11 for i in range(240)])
    ranked = rank_both(frame, BY)
    draws = {(r.rep, r.grp): r.w for r in resample.cluster_draws(ranked, BY, "grp", 3, 9).collect()}
    curves = resample.bootstrap_curves(ranked, BY, "grp", 3, 9, [1.0, 5.0, 20.0, 50.0], "recomputed", size=size).collect()
    assert len(curves) == 12
    for r in curves:
        idx = np.repeat(np.arange(240), [draws.get((r.rep, str(i % 11)), 0) for i in range(240)])
        k = max(1, math.floor(r.q / 100 * len(idx)))
        tops = [set(np.lexsort((np.arange(len(idx)), -x[idx]))[:k]) for x in (left, right)]
        assert (r.k, r.n, r.overlap) == (k, len(idx), len(tops[0] & tops[1]))


def test_bootstrap_tau_against_copies(pairs):
    left, right = hot_scores(11, 150)
    frame = pairs(left, right, grp=[i % 9 for i in range(150)])
    draws = {(r.rep, r.grp): r.w for r in resample.cluster_draws(frame, BY, "grp", 3, 2).collect()}
    for size in (10_000, 12):
        for r in resample.bootstrap_tau(frame, BY, "grp", 3, 2, size=size).collect():
            w = [draws.get((r.rep, str(i % 9)), 0) for i in range(150)]
            assert r.tau == pytest.approx(tau_b(left, right, w))


def test_replicate_ranges_append_to_the_whole(pairs):
    left, right = hot_scores(12, 80)
    frame = pairs(left, right, grp=[i % 6 for i in range(80)])
    whole = resample.bootstrap_tau(frame, BY, "grp", 5, 3)
    split = [r for part in (range(0, 2), range(2, 5)) for r in resample.bootstrap_tau(frame, BY, "grp", part, 3).collect()]
    assert {(r.rep, r.tau) for r in split} == {(r.rep, r.tau) for r in whole.collect()}


def test_oracle_take_is_optimal(pairs):
    rng = np.random.default_rng(4)
    for _ in range(3):
        left, right = rng.normal(size=18), rng.normal(size=18)
        prepared = portfolio.prepare(pairs(left, right), BY, 0.3).cache()
        rows = portfolio.select(prepared, BY, ["minimax_oracle"], [0.6, 1.0, 1.8])
        got = {r.budget_factor: r.worst_source_recall for r in portfolio.recalls(rows, BY).collect()}
        tl, tr = (set(np.argsort(-x)[:5]) for x in (left, right))
        both, one, two = len(tl & tr), len(tl - tr), len(tr - tl)
        for factor, recall in got.items():
            budget = round(factor * 5)
            best = max(
                min(b + a, b + c) for b in range(both + 1) for a in range(one + 1) for c in range(two + 1) if a + b + c <= budget
            )
            assert recall == pytest.approx(best / 5)


def test_identical_orders_agree_fully(pairs):
    x = np.random.default_rng(0).permutation(300)
    curve = overlap.concordance_curve(rank_both(pairs(x, 2 * x), BY), BY).collect()
    assert all(r.overlap == r.k and r.adjusted_jaccard == pytest.approx(1.0) for r in curve)


def test_spread_join_keeps_every_row(spark):
    from tandemrank import session

    rows = spark.range(5000).selectExpr("id", "IF(id < 4000, 0, id % 50) AS k")
    table = spark.range(50).selectExpr("id AS k", "id * 10 AS v")
    old, session.BROADCAST_ROWS = session.BROADCAST_ROWS, 10
    try:
        small = session.bounded(table, 10)
        joined = session.spread_join(rows, table, ["k"], "id")
        got = joined.agg(F.count("*"), F.sum("v")).first()
    finally:
        session.BROADCAST_ROWS = old
    assert small is table
    want = rows.join(table, "k").agg(F.count("*"), F.sum("v")).first()
    assert got == want


@pytest.mark.parametrize("p, size", [(0.95, 1000), (0.9999, 64), (0.9999999, 7), (0.5, 3)])
def test_rank_biased_overlap_at_full_depth(spark, p, size):
    rng = np.random.default_rng(4)
    n = 300
    right = rng.permutation(n) + 1
    rows = [("k", i + 1, int(r), n) for i, r in enumerate(right)] + [("one", 1, 1, 1)]
    ranked = spark.createDataFrame(rows, "key string, l_pos bigint, r_pos bigint, n bigint")
    for agreement in ("jaccard", "overlap"):
        got = {r.key: r.rbo for r in overlap.rank_biased_overlap(ranked, ["key"], p, agreement, size).collect()}
        total, x = 0.0, 0
        for d in range(1, n + 1):
            x = sum(max(a, b) <= d for _, a, b, _ in rows[:n])
            share = x / (2 * d - x) if agreement == "jaccard" else x / d
            total += (1 - p) * p ** (d - 1) * share + (p**d * share if d == n else 0)
        assert got["k"] == pytest.approx(total, rel=1e-9) and got["one"] == pytest.approx(1.0)


@pytest.mark.parametrize("size", [10_000, 40])
def test_nested_sets_in_blocks(pairs, size):
    """Every nested set and its complement, counted from rows that are sent once."""
    left, right = hot_scores(6, 200)
    step = np.random.default_rng(7).integers(0, 4, 200)
    frame = pairs(left, right).withColumn("_c", F.element_at(F.array(*[F.lit(int(v)) for v in step]), F.col("id").cast("int") + 1))
    got = {(r._j, r._in): (r.n, r.tau) for r in kendall_tau(frame.withColumn("_m", F.lit(3)), BY, size=size, nested=True).collect()}
    assert len(got) == 6
    for (j, inside), (n, tau) in got.items():
        at = np.flatnonzero((step <= j) == inside)
        assert n == len(at) and tau == pytest.approx(tau_b(np.asarray(left)[at], np.asarray(right)[at]))


def test_task_rows_leave_room_for_a_worker_per_core():
    """Four workers hold blocks of up to twice TASK_ROWS rows, with some twenty copies of a column each, in under 1 GB."""
    from tandemrank.operators.tau import TASK_ROWS

    assert 4 * 2 * TASK_ROWS * 20 * 8 < 1 << 30


@pytest.mark.parametrize("size", [10_000, 40])
def test_random_subsets_of_several_sizes(pairs, size):
    left, right = hot_scores(8, 300)
    base, largest = with_blocks(pairs(left, right), BY, size=size)
    sizes = base.select(*BY).distinct().selectExpr(*BY, "explode(array(0L, 9L, 120L, 300L)) AS _size")
    got = resample.random_subset_taus(base, sizes, BY, 2, 5, largest, size=size).collect()
    for rep in range(2):
        order = [r.id for r in base.selectExpr("id", f"{resample.counter_hash('5', str(rep), 'id')} AS h").orderBy("h", "id").collect()]
        for k in (0, 9, 120, 300):
            mine = {r._in: r.tau for r in got if r.rep == rep and r._size == k}
            assert set(mine) == ({True, False} if 0 < k < 300 else {k == 300})
            for inside, tau in mine.items():
                at = order[:k] if inside else order[k:]
                assert tau == pytest.approx(tau_b(np.asarray(left)[at], np.asarray(right)[at]))


def test_pairing_works_out_candidates_once(spark, monkeypatch):
    from tandemrank import session
    from tandemrank.operators import pairing

    monkeypatch.setattr(session, "bounded", lambda df: df)  # both sources too large to broadcast
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def once(v):
        seen.add(1)
        return v

    candidates = spark.range(100).select(once("id").alias("a"), (F.col("id") % 7).alias("b"))
    side = lambda k, n: spark.range(n).selectExpr(f"id AS {k}", "id * 2 AS score")
    rows = pairing.pair_sources(candidates, side("a", 90), side("b", 5), "a", "b", [("odd", "a % 2 = 1")]).collect()
    assert seen.value == 100
    want = {i: "missing_source_record" if i >= 90 or i % 7 >= 5 else "odd" if i % 2 else None for i in range(100)}
    assert {r.a: r.reason for r in rows} == want


def test_weighted_replicates_give_the_recalls_of_expanded_ones(spark, pairs, monkeypatch, size=7):
    """Replicates by weights on once-ranked rows, in many small blocks: same recalls as ranking and sorting every copy."""
    monkeypatch.setattr(portfolio, "STEPS", 16)
    left, right = hot_scores(5, 300)
    r = np.random.default_rng(6)
    df = pairs(left, right, r.integers(0, 20, 300).tolist()).withColumn("fold", F.expr("id % 3"))
    factors, lams, key = [0.5, 1.0, 2.0], ["0.0D", "2.0D"], [*BY, "rep"]
    ranked = rank_both(df, BY, ties=True)
    draws = resample.cluster_draws(df, BY, "grp", 4, 3).drop("_rows")
    rows = materialize(resample.weighted_ranks(ranked, draws, BY, key, "grp", size=size))
    got = portfolio.weighted_recalls(rows, key, 0.1, portfolio.STRATEGIES, factors, lams, size=size)
    copies = portfolio.prepare(portfolio.resampled(df, BY, "grp", 4, 3), key, 0.1)
    want = portfolio.recalls(portfolio.select(copies, key, portfolio.STRATEGIES, factors, lams), key)
    read = lambda x: sorted((r.rep, r.strategy, r.lam, r.budget_factor, r.worst_source_recall) for r in x.collect())
    assert read(got) == read(want) and len(read(got)) == 4 * 10 * 3
    # Rows left out of a replicate leave no trace in its ranks.
    each = resample.cluster_draws(df.filter("fold != 1"), BY, "grp", 4, 3).drop("_rows").withColumn("out", F.lit(1))
    some = resample.weighted_ranks(ranked, each, BY, [*BY, "out", "rep"], "grp", ["fold"], "fold != out", size=size)
    ends = {(r.rep, r.id): (r.l_ends / 2, r.r_ends / 2, r.w, r.n) for r in some.collect()}
    rest = rank_both(portfolio.resampled(df.filter("fold != 1"), BY, "grp", 4, 3), key, ties=True).collect()
    assert {(r.rep, r.id.id) for r in rest} == set(ends)
    assert all(ends[r.rep, r.id.id][:2] == ((r.l_first + r.l_last) / 2, (r.r_first + r.r_last) / 2) and ends[r.rep, r.id.id][3] == r.n for r in rest)


def test_replicates_are_not_ranked_again(spark, pairs, monkeypatch):
    """The rows are ranked once whatever the number of replicates; only rows of a budget's last step are put in order."""
    left, right = np.random.default_rng(7).normal(size=(2, 500))
    df = pairs(left, right, [i % 25 for i in range(500)])
    seen = []
    sort = portfolio.positions
    monkeypatch.setattr(portfolio, "positions", lambda d, *rest, **more: seen.append(d.count()) or sort(d, *rest, **more))
    monkeypatch.setattr(portfolio, "resampled", None)
    out = portfolio.full_procedure(df, BY, "grp", 0.1, [1.0], portfolio.STRATEGIES, 6, 1)
    assert out.count() == 9 * 3 and sum(seen) < 500


def test_rows_of_replicates_are_dealt_to_enough_tasks(spark, pairs, monkeypatch):
    """However well the rows pack in a shuffle, no task sorts much more than WINDOW_ROWS rows of replicates."""
    monkeypatch.setattr(resample, "WINDOW_ROWS", 400)
    monkeypatch.setattr(resample, "BLOCK_ROWS", 32)
    left, right = np.random.default_rng(8).normal(size=(2, 400))
    ranked = materialize(rank_both(pairs(left, right, [i % 10 for i in range(400)]), BY))
    seen = []
    met = resample.weighted_ranks
    monkeypatch.setattr(resample, "weighted_ranks", lambda *a, **k: seen.append(met(*a, **k)) or seen[-1])
    curves = resample.bootstrap_curves(ranked, BY, "grp", 10, 1)
    assert curves.count() == 10 * 50
    counts = seen[0].groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) >= 4 and max(r["count"] for r in counts) < 400 * 10 / 2


def test_row_bootstrap_draws_meet_their_rows_directly(spark, pairs, monkeypatch):
    """Mean and median of the drawn rows, from one set of draws and without a table of units."""
    left, right = hot_scores(9, 101)
    df = pairs(left, right)
    draws = {(r.rep, r.id): r.w for r in resample.cluster_draws(df, BY, "id", 3, 4).collect()}
    monkeypatch.setattr(resample, "spread_join", None)
    monkeypatch.setattr(resample, "cluster_draws", None)
    got = {r.rep: r for r in resample.bootstrap_mean_median(df, BY, "left", 3, 4, size=10).collect()}
    means = {r.rep: r for r in resample.bootstrap_means(df, BY, "id", ["right"], 3, 4).collect()}
    for b in range(3):
        at = np.repeat(np.arange(101), [draws.get((b, i), 0) for i in range(101)])
        assert math.isclose(got[b].mean, left[at].mean()) and got[b].median == np.median(left[at])
        assert math.isclose(means[b].right, right[at].mean(), abs_tol=1e-12)
