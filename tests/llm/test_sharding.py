import random
from collections import Counter

import numpy as np
import pytest

from tandemrank.llm.sharding import hypergeometric, matrix, shuffle


def dealt(spark, n, shards, seed=8, part_rows=16, columns="id AS doc_id"):
    rows = shuffle(spark.range(n, numPartitions=3).selectExpr(*columns.split(";")), shards, seed, part_rows)
    return [(r.row.doc_id, r.shard, r.slot) for r in rows.collect()]


@pytest.mark.parametrize("n, shards", [(0, 4), (1, 4), (3, 4), (97, 5), (400, 24)])
def test_sizes_are_exact_and_slots_gapless(spark, n, shards):
    got = dealt(spark, n, shards)
    assert sorted(d for d, _, _ in got) == list(range(n))
    sizes = Counter(s for _, s, _ in got)
    assert all(sizes[j] == n // shards + (j < n % shards) for j in range(shards))
    for j in range(shards):
        assert sorted(slot for _, s, slot in got if s == j) == list(range(sizes[j]))


def test_matrix_has_its_margins_and_follows_the_seed():
    rows, columns = [50, 0, 7, 43], [34, 33, 33]
    for seed in range(30):
        m = matrix(rows, columns, seed)
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == columns and (m >= 0).all()
    assert (matrix(rows, columns, 1) == matrix(rows, columns, 1)).all() and len({matrix(rows, columns, s).tobytes() for s in range(9)}) > 5


def test_counts_are_hypergeometric():
    good, bad, draws = 12, 20, 9
    rng = np.random.default_rng(1)
    seen = Counter(hypergeometric(good, bad, draws, u) for u in rng.random(40_000))
    plain = np.bincount(rng.hypergeometric(good, bad, draws, 400_000), minlength=10) / 400_000
    expected = plain * 40_000
    kept = expected > 5
    chi2 = sum((seen[k] - e) ** 2 / e for k, e in enumerate(expected) if kept[k])
    assert chi2 < 30 and hypergeometric(5, 0, 3, 0.5) == 3 and hypergeometric(0, 5, 3, 0.5) == 0
    big = hypergeometric(10**12, 10**12, 10**9, 0.5)
    assert abs(big - 5 * 10**8) < 10**5


def test_every_row_reaches_every_shard_and_slot_alike(spark):
    n, shards, times = 60, 4, 60
    where, slots = np.zeros((n, shards)), np.zeros((n, n // shards))
    for seed in range(times):
        for d, s, slot in dealt(spark, n, shards, seed * 10):
            where[d, s] += 1
            slots[d, slot] += 1
    chi2 = ((where - times / shards) ** 2 / (times / shards)).sum()
    free = n * (shards - 1)
    assert abs(chi2 - free) < 5 * (2 * free) ** 0.5
    by_start = slots[:, :5].sum(axis=1)  # each row stands in the first third of its shard as often
    assert abs(by_start - times / 3).max() < 5 * (times * 2 / 9) ** 0.5


def test_nulls_repeats_and_clashing_names(spark):
    r = random.Random(3)
    rows = [(None if i % 7 == 0 else i % 5, r.choice([None, "", "x" * 50_000, "same"]), i, i) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, rid int")
    got = [tuple(x.row) for x in shuffle(df, 6, part_rows=8).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_a_seed_repeats_its_result(spark):
    assert sorted(dealt(spark, 50, 3)) == sorted(dealt(spark, 50, 3)) != sorted(dealt(spark, 50, 3, seed=99))
