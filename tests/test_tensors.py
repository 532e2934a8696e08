"""Tensor columns: round trips, invariance under rotations, alignment, scores against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemrank.functions import tensors as fn
from tandemrank.operators import tensors as ops


def rotation(rng, proper=True):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q if (np.linalg.det(q) > 0) == proper else -q


@pytest.fixture(scope="module")
def batch(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(12):
        t = rng.normal(size=(3, 3, 3))
        t = 0.5 * (t + t.transpose(0, 2, 1))
        rows.append((i, t.ravel().tolist(), rotation(rng, i % 3 != 0).ravel().tolist()))
    return spark.createDataFrame(rows, "id int, t array<double>, r array<double>"), rows


def test_round_trip(batch):
    df, rows = batch
    out = df.selectExpr("id", f"{fn.to_3x6('t')} AS v").selectExpr("id", f"{fn.to_3x3x3('v')} AS t").orderBy("id").collect()
    assert all(np.allclose(r.t, rows[r.id][1]) for r in out)
    out = df.selectExpr("id", f"{fn.strain_to_3x6('t')} AS v").selectExpr("id", f"{fn.strain_to_3x3x3('v')} AS t").collect()
    assert all(np.allclose(r.t, rows[r.id][1]) for r in out)


def test_scores_against_numpy(batch):
    df, rows = batch
    out = ops.score_table(df).orderBy("id").collect()
    rng = np.random.default_rng(1)
    d = rng.normal(size=(200_000, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    for r in out:
        t = np.array(rows[r.id][1]).reshape(3, 3, 3)
        v = np.stack([t[:, j, k] for j, k in fn.PAIRS], axis=1)
        assert r.frobenius == pytest.approx(np.linalg.norm(t))
        assert r.top_singular == pytest.approx(np.linalg.svd(v)[1][0])
        assert r.kelvin == pytest.approx(np.linalg.svd(v * [1, 1, 1, 2**0.5, 2**0.5, 2**0.5])[1][0])
        sampled = np.abs(np.einsum("ijk,ni,nj,nk->n", t, d, d, d)).max()
        assert r.longitudinal >= sampled - 1e-9 and r.longitudinal == pytest.approx(sampled, rel=2e-3)


def test_invariance(batch):
    df, _ = batch
    moved = ops.score_table(df.select("id", fn.transport("t", "r").alias("t"))).orderBy("id").collect()
    still = ops.score_table(df).orderBy("id").collect()
    for a, b in zip(moved, still):
        assert a.frobenius == pytest.approx(b.frobenius) and a.kelvin == pytest.approx(b.kelvin)
        assert a.longitudinal == pytest.approx(b.longitudinal, rel=1e-4)


def test_axial_differs_by_the_determinant(batch):
    df, rows = batch
    for r in df.select("id", fn.transport("t", "r").alias("p"), fn.transport_axial("t", "r").alias("a")).collect():
        det = np.linalg.det(np.array(rows[r.id][2]).reshape(3, 3))
        assert np.allclose(np.array(r.p) * det, r.a)


def test_missing_rotation(spark, batch):
    df, rows = batch
    out = df.withColumn("none", F.lit(None).cast("array<double>")).withColumn("none_set", F.lit(None).cast("array<array<double>>"))
    got = out.select("id", fn.transport("t", "none").alias("m"), fn.project("t", "none_set").alias("p")).collect()
    assert all(np.allclose(r.m, rows[r.id][1]) and r.p is None for r in got)


def test_projection_is_invariant(spark, batch):
    df, _ = batch
    turns = [[1, 0, 0, 0, 1, 0, 0, 0, 1], [0, -1, 0, 1, 0, 0, 0, 0, 1], [-1, 0, 0, 0, -1, 0, 0, 0, 1], [0, 1, 0, -1, 0, 0, 0, 0, 1]]
    text = "array(" + ", ".join("array(" + ", ".join(f"{x}D" for x in r) + ")" for r in turns) + ")"
    out = df.selectExpr("id", "t", f"{text} AS g").withColumn("p", fn.project("t", "g"))
    again = ops.residuals(out, "p", "g", "x").collect()
    assert all(r.x_residual_raw == pytest.approx(0, abs=1e-12) for r in again)


def test_rigid_alignment(spark):
    rng = np.random.default_rng(5)
    rows = []
    truth = {}
    for pair in range(4):
        p = rng.normal(size=(9, 3))
        r = rotation(rng, pair % 2 == 0)
        truth[pair] = r
        q = (p - [1, 2, 3]) @ r
        rows += [(pair, *map(float, a), *map(float, b)) for a, b in zip(p, q)]
    df = spark.createDataFrame(rows, "pair int, px double, py double, pz double, qx double, qy double, qz double")
    for r in ops.rigid_alignment(df, ["pair"], ["px", "py", "pz"], ["qx", "qy", "qz"]).collect():
        kind = "proper" if r.pair % 2 == 0 else "improper"
        assert r[f"rms_{kind}"] == pytest.approx(0, abs=1e-6)
        assert np.allclose(np.array(r[f"rotation_{kind}"]).reshape(3, 3), truth[r.pair], atol=1e-6)
        assert np.linalg.det(np.array(r.rotation_proper).reshape(3, 3)) == pytest.approx(1)


def test_soft_modes_against_numpy(spark):
    rng = np.random.default_rng(3)
    ev = np.append(-np.abs(rng.normal(size=3)) - 0.1, [-1e-3, 0.0, 1e-3])[rng.permutation(6)]
    born, vec, strain = rng.normal(size=(2, 3, 3)), rng.normal(size=(6, 2, 3)), rng.normal(size=(3, 3, 3))
    df = spark.createDataFrame(
        [(ev.tolist(), born.ravel().tolist(), strain.ravel().tolist(), vec.reshape(6, 6).tolist())],
        "e array<double>, b array<double>, s array<double>, v array<array<double>>",
    )
    row = ops.soft_modes(df, "e", "b", "s", "s", "b", "v").first()
    order = np.argsort(ev)[:-3]
    z = np.linalg.norm(np.einsum("iax,mia->mx", born, vec[order]), axis=1)
    want = (z * np.linalg.norm(strain) / (np.abs(ev[order]) + 1e-4) ** 2).sum()
    assert row.stable and row.s_soft == pytest.approx(want)
    assert row.optical_condition_number == pytest.approx(ev[order].max() / (ev[order].min() + 1e-12))
