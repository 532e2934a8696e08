import random

import numpy as np
import pytest

from tandemrank.llm import mixing
from tandemrank.llm.mixing import DOMAINS, fit_rates, label_domains, memberships, thin_out, train

SOFT = "doc_id bigint, n_tokens bigint, p_good double, p_low double, p_toxic double"


def brute(t, p, goal, most, rounds):
    """The same descent with arrays."""
    r, gram = np.ones(len(t)), (p * t[:, None]).T @ p
    scale = np.where(np.diag(gram) > 0, 1 / np.maximum(np.diag(gram), 1e-300), 0)
    widest = np.abs(np.linalg.eigvals(gram * scale[None, :])).max()
    for _ in range(rounds):
        off = (p * (t * r)[:, None]).sum(axis=0) - goal
        if np.abs(off).max() <= 1e-9 * t.sum():
            break
        r = np.clip(r - p @ (off * scale / widest), 0, most)
    return np.where(t > 0, r, 1)


@pytest.mark.parametrize("most, targets", [(None, (0.6, 0.3, 0.1)), (1.0, (0.5, 0.1, 0.0)), (None, (1.0, 0.0, 0.0))])
def test_rates_follow_the_descent_and_meet_targets(spark, most, targets):
    r = np.random.default_rng(3)
    p = r.dirichlet([0.3, 0.3, 0.3], size=400)
    t = r.integers(0, 900, size=400)
    soft = spark.createDataFrame([(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(t, p))], SOFT)
    got = fit_rates(soft, dict(zip(DOMAINS, targets)), most=most).orderBy("doc_id").toPandas()["rate"].to_numpy()
    want = brute(t.astype(float), p, np.array(targets) * t.sum(), np.inf if most is None else most, mixing.ROUNDS)
    assert np.allclose(got, want, atol=1e-7) and got.min() >= 0
    if targets == (0.6, 0.3, 0.1):
        assert np.allclose((p * (t * got)[:, None]).sum(axis=0) / t.sum(), targets, atol=1e-4)


def test_memberships_from_labels(spark, docs):
    r = random.Random(1)
    kinds = {"good": ["river", "stone", "wind", "over"], "low": ["buy!!", "now!!", "win!!"], "toxic": ["scum", "idiot", "river", "stone"]}
    names = list(kinds)
    rows = [(i, " ".join(r.choice(kinds[names[i % 3]]) for _ in range(25))) for i in range(600)]
    labels = [(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(400)] + [(1, 0, 0), (2, 1, 0), (5, None, None), (None, 1, 0)]
    lab = label_domains(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    d = docs(rows + [(900, None), (901, ""), (None, "river stone wind over " * 50_000)]).selectExpr("*", "1 as rate", "2 as traits")
    got = {x.doc_id: x for x in memberships(d, lab).collect()}
    for i in range(400, 600):
        x = got[i]
        assert abs(x.p_good + x.p_low + x.p_toxic - 1) < 1e-9 and x[f"p_{names[i % 3]}"] > 0.9 and x.n_tokens == 25
    assert got[900].n_tokens == got[901].n_tokens == 0 and got[None].n_tokens == 200_000
    _, chosen, shares = train(d, lab)
    assert abs(sum(shares) - 1) < 1e-9
    assert {"scum", "idiot", "~!!"} <= {c[0] for c in chosen}
    kept = thin_out(d, lab, {"good": 1.0, "low": 0.5, "toxic": 0.0})
    assert kept.columns == d.columns
    ids = {x.doc_id for x in kept.collect()}
    assert all(i in ids for i in range(0, 600, 3)) and not any(i in ids for i in range(2, 600, 3)) and {900, 901, None} <= ids
    assert 60 < sum(i in ids for i in range(1, 600, 3)) < 140


def test_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    one = memberships(docs([(1, "a b")]), none).first()
    assert (one.n_tokens, round(one.p_good, 9)) == (2, round(1 / 3, 9))
    assert fit_rates(memberships(docs([]), none), mixing.TARGETS).count() == 0 and thin_out(docs([]), none, mixing.TARGETS).count() == 0
