"""Keyed ridge baselines against direct fits; gap ratios against a plain resampling of both sides."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemrank.operators import baselines, models
from tandemrank.session import with_each

RECORD = "id bigint, source string, grp string, x array<double>, t array<double>"


def made(spark, n=120, width=4, size=3):
    rng = np.random.default_rng(3)
    w = rng.normal(size=(width, size))
    rows = []
    for i in range(n):
        x = rng.normal(size=width)
        source = ["one", "two", "three"][int(rng.integers(3))]
        rows.append((i, source, str(i % 4), x.tolist(), (x @ w + (source == "two") + rng.normal(scale=0.1, size=size)).tolist()))
    return rows, spark.createDataFrame(rows, RECORD).repartition(5)


def direct(train, test, alpha):
    x, y = np.array([r[3] for r in train]), np.array([r[4] for r in train])
    xc, yc = x - x.mean(0), y - y.mean(0)
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return (np.array([r[3] for r in test]) - x.mean(0)) @ beta + y.mean(0)


@pytest.mark.parametrize("held", [8_000_000, 1])
def test_ridge_of_every_source_pair_and_seed_matches_direct_fits(spark, monkeypatch, held):
    monkeypatch.setattr(baselines, "HELD_NUMBERS", held)
    monkeypatch.setattr(baselines, "TASK_ROWS", 7)
    rows, df = made(spark)
    df = df.unionByName(spark.createDataFrame([(900, "one", "0", None, [1.0, 2.0, 3.0]), (901, None, "0", [0.0] * 4, [1.0, 2.0, 3.0])], RECORD))
    out = baselines.baseline_matrix(df, "id", "source", "grp", "t", [0, 1], "pmod(id + seed, 5) = 0", 3, {"ridge": "x"}, 0.5)
    got = {(r.train_source, r.eval_source, r.split, r.seed): r for r in out.filter("model = 'ridge'").collect()}
    names = ["one", "two", "three"]
    for seed in (0, 1):
        train = [r for r in rows if (r[0] + seed) % 5]
        for source in [*names, "pooled"]:
            own = [r for r in train if source in (r[1], "pooled")]
            for eval_source in names:
                test = [r for r in rows if (r[0] + seed) % 5 == 0 and r[1] == eval_source]
                split = "pooled" if source == "pooled" else "in_source" if source == eval_source else "held_out"
                row = got.pop((source, eval_source, split, seed))
                error = np.linalg.norm(direct(own, test, 0.5) - np.array([r[4] for r in test]), axis=1).mean()
                assert row.absolute_error == pytest.approx(error) and row.n_test == len(test)
    assert all(k[1] is None for k in got)  # the row without a source is evaluated under its own key


def test_tokens_and_distances_become_features(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 0.0, 0.6), (2, 0, 1.0, 1.0)], "id bigint, k int, x double, y double")
    shares = baselines.distance_features(points, "id", "k", ["x", "y"])
    records = spark.createDataFrame([(1, "a", [9.0]), (2, "b", [8.0]), (3, None, [7.0])], "id bigint, source string, x array<double>")
    rows = baselines.with_distance_features(records, shares, "id", "x")
    got = {r.id: r for r in baselines.with_token(rows, "source", ["a", "b"], "x", "xs").collect()}
    d = np.histogram([5.0, 0.6, np.hypot(3, 3.4)], bins=20, range=(0, 10))[0] / 3
    assert np.allclose(got[1].xs, [9.0, *d, 1, 0]) and np.allclose(got[2].xs, [8.0, *[0] * 20, 0, 1]) and np.allclose(got[3].xs, [7.0, *[0] * 22])


def test_fourier_ridge_on_all_features(spark):
    rows, df = made(spark, 90)
    lifted = models.fourier_features(baselines.with_token(df, "source", ["one", "two", "three"], "x", "xs"), "xs", 7, 32, 0.05, 42, "z")
    kept = {r.id: list(r.z) for r in lifted.select("id", "z").collect()}
    out = baselines.baseline_matrix(lifted, "id", "source", "grp", "t", [0], "pmod(id, 5) = 0", 3, {"lifted": "z"})
    flat = [(i, s, g, kept[i], t) for i, s, g, _, t in rows]
    train, test = [r for r in flat if r[0] % 5], [r for r in flat if r[0] % 5 == 0 and r[1] == "two"]
    row = out.filter("model = 'lifted' AND train_source = 'pooled' AND eval_source = 'two'").first()
    want = np.linalg.norm(direct(train, test, 1.0) - np.array([r[4] for r in test]), axis=1).mean()
    assert row.absolute_error == pytest.approx(want, rel=1e-6)


def test_many_sources_meet_in_blocks(spark):
    rows = spark.range(3).withColumn("name", F.lit("r"))
    got = with_each(rows, spark.range(2500).select(F.col("id").alias("level")), "id", 100)
    assert got.count() == 7500 and got.select("id", "level").distinct().count() == 7500 and got.columns == ["id", "name", "level"]
    assert with_each(rows, spark.range(0).select(F.col("id").alias("level")), "id").count() == 0


def drawn(n, rep, seed):
    return [int(hashlib.md5(f"{seed}|{rep}|{j}".encode()).hexdigest()[:15], 16) % n for j in range(n)]


def test_gap_ratios_resample_gaps_and_errors(spark):
    rng = np.random.default_rng(5)
    errors = [("m", s, f"u{k}", float(a), float(a) / 3) for s in ("left", "right") for k, a in enumerate(rng.uniform(0.3, 0.7, 6))]
    errors += [("other", "left", "u0", 0.5, None), ("none", "left", "u0", None, None)]
    gaps = [("all", i, float(g)) for i, g in enumerate(rng.uniform(0.5, 1.5, 25))] + [("all", 99, None), ("one", 5, 2.0)]
    e = spark.createDataFrame(errors, "model string, train_source string, unit string, absolute_error double, normalized_error double")
    g = spark.createDataFrame(gaps, "scope string, id bigint, gap double")
    reps = 40
    got = {(r.model, r.train_source, r.scope): r for r in models.gap_ratios(e, g, reps, 7).collect()}
    assert set(got) == {(m, s, c) for m, s in (("m", "left"), ("m", "right"), ("other", "left")) for c in ("all", "one")}
    own = np.array([x for _, _, x in gaps[:25]])
    for s in ("left", "right"):
        a = np.array([x[3] for x in errors if x[:2] == ("m", s)])
        row = got["m", s, "all"]
        assert row.n_pairs == 25 and row.n_errors == 6
        for name, f in (("mean", np.mean), ("median", np.median)):
            each_gap = np.array([f(own[drawn(25, b, 7)]) for b in range(reps)])
            each_error = np.array([f(a[drawn(6, b, 8)]) for b in range(reps)])
            assert row[f"ratio_{name}"] == pytest.approx(f(own) / f(a)) and row[f"{name}_gap_low"] == pytest.approx(np.percentile(each_gap, 2.5))
            for kind, scale in (("", 1), ("_normalized", 3)):
                low, high = np.percentile(each_gap / each_error * scale, [2.5, 97.5])
                assert row[f"ratio_{name}_low{kind}"] == pytest.approx(low) and row[f"ratio_{name}_high{kind}"] == pytest.approx(high)
            fixed = np.percentile(each_gap, [2.5, 97.5]) / f(a)
            assert row[f"ratio_{name}_high"] - row[f"ratio_{name}_low"] > fixed[1] - fixed[0]  # both sides vary
    assert got["other", "left", "all"].ratio_mean_normalized is None
    valid = spark.createDataFrame([("m", "right")], "model string, train_source string")
    assert {r.train_source for r in models.gap_ratios(e, g, 4, 7, valid=valid).collect()} == {"right"}
