"""Replicates as columns of weights against rows repeated one by one, with blocks far smaller than the keys."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemrank import session
from tandemrank.operators import replicates, resample, tau
from tandemrank.catalog import reports
from tandemrank.catalog.registry import QUERIES
from tandemrank.operators.rank import rank_both
from tandemrank.operators.replicates import discordant_columns


def test_columns_count_as_one_by_one():
    r = np.random.default_rng(3)
    for n, values in ((1, 5), (40, 4), (700, 12), (1500, 10_000)):
        x, y, w = r.integers(0, values, n), r.integers(0, values, n).astype(float), r.integers(0, 4, (n, 3)).astype(np.float32)
        assert discordant_columns(x, y, w).tolist() == [tau.discordant(x.astype(float), y, w[:, i]) for i in range(3)]


@pytest.fixture
def scored(spark):
    """Two keys, one with heavy ties on both sides, in 30 clusters."""
    return spark.range(900).selectExpr(
        "id", "IF(id < 600, 'a', 'b') AS metric", "string(id % 30) AS grp", "double(pmod(hash(id), 40)) AS left",
        "IF(id < 600, double(pmod(hash(id), 40) + pmod(hash(id, 7), 25)), double(id % 3)) AS right",
    ).localCheckpoint()


@pytest.mark.parametrize("unit", ["grp", "id"])
def test_bootstrap_in_steps_and_blocks(spark, scored, unit):
    by, reps = ["metric"], 70  # more than one step
    got = resample.bootstrap_tau(scored, by, unit, reps, 5, size=100).toPandas()
    draws = resample.cluster_draws(scored, by, unit, reps, 5).drop("_rows")
    rows = scored.join(draws, [*by, unit])
    want = tau.kendall_tau(rows, [*by, "rep"], weight="w").toPandas()
    keys = ["metric", "rep"]
    both = got.merge(want, on=keys, suffixes=("", "_w"))
    assert len(both) == len(got) == 140 and (both.n == both.n_w).all()
    assert np.allclose(both.tau, both.tau_w, rtol=0, atol=1e-13)
    later = resample.bootstrap_tau(scored, by, unit, range(66, 70), 5).toPandas().merge(got, on=keys, suffixes=("", "_w"))
    assert sorted(later.rep) == [66, 66, 67, 67, 68, 68, 69, 69] and np.allclose(later.tau, later.tau_w, rtol=0, atol=1e-13)


def test_random_subsets_in_blocks(spark, scored):
    by, reps = ["metric"], 66
    sizes = spark.createDataFrame([("a", 0), ("a", 90), ("a", 400), ("b", 300)], "metric string, _size bigint")
    rows = scored.select("metric", "id", "left", "right")
    whole, blocks = (
        resample.random_subset_taus(rows, sizes, by, reps, 9, 600, size=size).toPandas().sort_values(["metric", "rep", "_size", "_in"])
        for size in (1 << 16, 100)
    )
    assert len(whole) == len(blocks) == 66 * (1 + 2 + 2 + 1)  # an empty set and an empty rest have no row
    assert np.allclose(whole.tau, blocks.tau, rtol=0, atol=1e-13, equal_nan=True)
    order = F.expr(f"row_number() OVER (PARTITION BY metric, rep ORDER BY {replicates.counter_hash('9', 'rep', 'id')}, id)")
    picked = rows.selectExpr("*", "explode(array(0, 65)) AS rep").withColumn("_in", order <= 90).filter("metric = 'a'")
    want = {(r.rep, r._in): r.tau for r in tau.kendall_tau(picked, ["rep", "_in"]).collect()}
    mine = whole[(whole["_size"] == 90) & whole.rep.isin([0, 65])]
    got = {(rep, inside): t for rep, inside, t in zip(mine["rep"], mine["_in"], mine["tau"])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-13 for k in got)


def test_permutations_in_passes_and_in_one_task(spark, scored, monkeypatch):
    by, reps = ["metric"], 67
    one = resample.permutation_taus(scored, by, reps, 4)
    monkeypatch.setattr(resample, "PASS_ROWS", 40 * 900)
    passes = resample.permutation_taus(scored, by, reps, 4, size=100)
    both = one.toPandas().merge(passes.toPandas(), on=["metric", "rep"], suffixes=("", "_w"))
    assert len(both) == 134 and (both.n == both.n_w).all() and np.allclose(both.tau, both.tau_w, rtol=0, atol=1e-13)
    assert both.tau.nunique() > 100 and spark.conf.get(session.PASS) == ""


def test_a_pass_frees_its_tables(spark):
    def run(span):
        table = session.materialize(spark.range(span.start, span.stop))
        left.extend(f.removeprefix("file://") for f in table.inputFiles())
        return table

    left = []
    rows = session.in_passes(spark, [range(0, 3), range(3, 5)], run)
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3, 4]
    assert left and not any(os.path.exists(f) for f in left)


@pytest.mark.parametrize("null", ["fixed", "recomputed"])
def test_curves_in_one_task_and_in_blocks(spark, scored, null):
    by, keys = ["metric"], ["metric", "rep", "q"]
    ranked = session.materialize(rank_both(scored, by))
    one, blocks = (resample.bootstrap_curves(ranked, by, "grp", 66, 5, null=null, size=size).toPandas() for size in (1 << 16, 100))
    both = one.merge(blocks, on=keys, suffixes=("", "_w"))
    assert len(both) == len(one) == 2 * 66 * 50
    assert all((both[c] == both[f"{c}_w"]).all() for c in ("k", "n", "overlap"))


@pytest.mark.parametrize("name", ["rank_record", "control_comparison", "heterogeneity"])
def test_records_have_the_replicates_of_the_study(spark, monkeypatch, name):
    asked = []
    monkeypatch.setattr(reports.tables, name, lambda *args: asked.append(args[-2:]))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [(2000, 4999)]
