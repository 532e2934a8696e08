"""Ridge and nested regression against direct solves; histogram and calibration against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemrank.operators import models, pairing, sampling
from tandemrank.sources import sinks
from tandemrank.sources.tables import scan


def test_ridge_matches_direct_solve(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 4)), rng.normal(size=(80, 3))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id int, x array<double>, y array<double>").repartition(5)
    out = models.ridge(df, df, "x", "y").orderBy("id").collect()
    xc, yc = x - x.mean(0), y - y.mean(0)
    beta = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    assert np.allclose([r.pred for r in out], xc @ beta + y.mean(0))


def test_nested_regression_matches_direct_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2)) * [3, 0.1] + [5, -2]
    y = x @ [0.5, 2.0] + rng.normal(size=60)
    fold = np.arange(60) % 3
    df = spark.createDataFrame([(float(a), float(b), float(t), int(f)) for (a, b), t, f in zip(x, y, fold)], "a double, b double, y double, fold int")
    row = models.nested_regression(df, {"both": ["a", "b"]}, "y", "fold").first()
    z = (x - x.mean(0)) / x.std(0)

    def fit(zz, yy):
        zc = zz - zz.mean(0)
        beta = np.linalg.solve(zc.T @ zc + np.eye(2), zc.T @ (yy - yy.mean()))
        return lambda q: (q - zz.mean(0)) @ beta + yy.mean()

    def r2(t, p):
        return 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum()

    p = fit(z, y)(z)
    cv = [r2(y[fold == k], fit(z[fold != k], y[fold != k])(z[fold == k])) for k in range(3)]
    assert row.r2 == pytest.approx(r2(y, p)) and row.pearson_r == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert row.cv_r2_mean == pytest.approx(np.mean(cv)) and row.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))


def test_nested_regression_keeps_every_key_and_set(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=40)
    rows = [(k, float(v), None if k == "few" and i > 6 else float(v * v), float(3 * v + 1) if k != "flat" else 2.0, i % 4) for k in ("line", "few", "flat") for i, v in enumerate(x)]
    rows += [("line", 1.0, 1.0, None, 1), ("line", 1.0, 1.0, 5.0, None), ("line", float("nan"), 1.0, 5.0, 1)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double, fold int").repartition(3)
    got = {(r.k, r.model): r for r in models.nested_regression(df, {"one": ["a"], "two": ["a", "b"]}, "y", "fold", 0.0, by=["k"]).collect()}
    assert len(got) == 6
    assert got["line", "one"].n_pairs == 40 and got["line", "one"].r2 == pytest.approx(1) and got["line", "one"].cv_r2_mean == pytest.approx(1)
    assert got["few", "two"].n_pairs == 7 and got["few", "two"].r2 is None and got["few", "one"].n_pairs == 40
    assert got["flat", "one"].r2 is None and got["flat", "one"].cv_r2_mean is None and got["flat", "one"].rmse == pytest.approx(0, abs=1e-6)
    none = models.nested_regression(df.filter("false"), {"one": ["a"]}, "y", "fold", by=["k"])
    assert none.count() == 0 and models.nested_regression(df.filter("false"), {"one": ["a"]}, "y", "fold").first().n_pairs == 0


def test_distance_histogram(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(0, 8, size=(70, 3))
    df = spark.createDataFrame([("g", i, *map(float, p)) for i, p in enumerate(pts)], "g string, id int, x double, y double, z double")
    d = np.linalg.norm(pts[:, None] - pts, axis=2)[np.triu_indices(70, 1)]
    want = np.histogram(d, bins=20, range=(0, 10))[0] / len(d)
    for chunk in (9, 4096):
        got = pairing.distance_histogram(df, ["g"], "id", ["x", "y", "z"], chunk=chunk).orderBy("bin").collect()
        assert np.allclose([r.share for r in got], want)


def test_content_hash_ignores_order_but_not_content(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a = sinks.content_hash(df).first()
    assert a == sinks.content_hash(df.orderBy(F.col("id").desc()).repartition(7)).first()
    assert a.content_hash != sinks.content_hash(df.withColumn("v", F.expr("IF(id = 3, 7, v)"))).first().content_hash
    assert a.content_hash != sinks.content_hash(df.union(df.limit(1))).first().content_hash


def test_inventory_fingerprints(spark, tmp_path):
    import hashlib

    small, big = b"abc", bytes(range(256)) * 45_000
    (tmp_path / "a.csv").write_bytes(small)
    (tmp_path / "b.bin").write_bytes(big)
    got = {r.extension: r for r in sinks.inventory(spark, str(tmp_path), "raw").collect()}
    assert got["csv"].fingerprint == hashlib.sha256(small).hexdigest() and got["csv"].scan_strategy == "full_sha256"
    edge = big[:4096] + big[-4096:] + str(len(big)).encode()
    assert got["bin"].fingerprint == hashlib.sha256(edge).hexdigest() and got["bin"].scan_strategy == "head_tail_hash"


def test_scan_wants_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        scan(spark, str(tmp_path / "a.csv"))
    assert scan(spark, str(tmp_path / "a.csv"), ["y"], "x int, y int").first().y == 2


def test_candidate_list_shape(spark):
    rng = np.random.default_rng(6)
    rows = [(m, i, float(a), float(b)) for m in ("u", "v") for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    pairs = spark.createDataFrame(rows, "metric string, id bigint, left double, right double")
    attrs = spark.range(300).selectExpr("id", "concat('s', id % 7) AS stratum", "double(id % 11) AS size", "concat('f', id % 90) AS formula", "id % 2 = 0 AS member")
    out = sampling.candidate_list(pairs, "metric", attrs, "stratum", "size", "formula", "member").collect()
    assert len({r.id for r in out}) == len(out)
    fill = [r for r in out if r.candidate_stratum == "diversity_balanced"]
    assert len(fill) == 10


def test_samples_by_key(spark):
    rows = [(k, i, float((i * 37) % 101), (i * 13) % 50, "abc"[i % 3]) for k in ("x", "y") for i in range(101 if k == "x" else 40)]
    df = spark.createDataFrame([*rows, ("y", 900, 3.5, 0, None)], "k string, id int, v double, odd int, s string").repartition(4)
    got = sampling.audit_sample(df, "v", "odd", "id", by=["k"]).toPandas()
    one = sampling.audit_sample(df.filter("k = 'x'").drop("k"), "v", "odd", "id").toPandas()
    mine = got[got.k == "x"]
    assert set(zip(mine.id, mine.part)) == set(zip(one.id, one.part)) and len(mine) == 60 and (got.k == "y").sum() == 41
    quotas = {(r.k, r.s): r.quota for r in sampling.quota_table(df, "s", 20, by=["k"]).collect()}
    assert {s: q for (k, s), q in quotas.items() if k == "x"} == sampling.equal_quotas(["a", "b", "c"], 20) and len(quotas) == 6
    table = sampling.stratified_sample(df, "s", "v", "id", sampling.quota_table(df, "s", 20, by=["k"]), by=["k"]).filter("k = 'x'").toPandas()
    fixed = sampling.stratified_sample(df.filter("k = 'x'"), "s", "v", "id", sampling.equal_quotas(["a", "b", "c"], 20)).toPandas()
    assert set(zip(table.id, table.part)) == set(zip(fixed.id, fixed.part)) and len(table) == 20


def test_large_groups_have_few_chunks(spark, tmp_path):
    """A row is sent once per chunk of its group; chunks of a fixed size would make that the square of the group."""
    df = spark.range(400).selectExpr("'g' AS g", "id", "double(id % 7) AS x")
    out = pairing.distance_histogram(df, ["g"], "id", ["x"], bins=10, chunk=10)
    got = {r.bin: r.share for r in out.collect()}
    d = np.abs(np.subtract.outer(np.arange(400) % 7, np.arange(400) % 7))[np.triu_indices(400, 1)]
    assert np.allclose([got[b] for b in range(10)], np.bincount(d, minlength=10) / len(d))
    generated = [n for n in _metrics(out) if n[0] == "Generate"]
    assert sum(rows for _, rows in generated) <= 400 * pairing.MOST_CHUNKS


def _metrics(df):
    """(operator, rows out) of the plan that ``collect`` ran."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if p.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            return walk(p.plan())
        rows = p.metrics().get("numOutputRows")
        if rows.isDefined():
            found.append((p.nodeName(), rows.get().value()))
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    return found


def test_fractions_take_no_part_in_a_join(spark, monkeypatch):
    """A written table of fractions is small on disk and large in memory, so a join would broadcast it."""
    from tandemrank.catalog import load, reports

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df)

    materialize = reports.materialize
    monkeypatch.setattr(reports, "materialize", seen)
    for name in ("ridge_fourier", "structural_ridge"):
        plans.clear()
        out = load()[0][name](spark, "/root/testdata/sf0.001")
        assert out.columns and plans
        assert not [p for p in plans if "Join" in p and "fractions" in p]
