"""Small vectors with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tandemrank.functions import formula as fm
from tandemrank.operators import audit, overlap, pairing, portfolio, retention, ties
from tandemrank.operators.rank import rank_both
from tandemrank.operators.tau import kendall_tau
from tandemrank.operators.correlation import spearman

BY = ["panel"]


def topk(pairs, left, right, k):
    ranked = rank_both(pairs(left, right), BY)
    q = 100.0 * k / len(left)
    return overlap.topk_measures(overlap.overlap_counts(ranked, BY, [q])).first()


def test_disjoint_top_sets(pairs):
    row = topk(pairs, [10, 9, 8, 0, 0, 0], [0, 0, 0, 10, 9, 8], 3)
    assert (row.precision_at_k, row.jaccard, row.overlap_coefficient) == (0, 0, 0)


def test_partial_overlap(pairs):
    row = topk(pairs, [10, 9, 8, 7, 6, 5], [10, 9, 0, 8, 0, 0], 3)
    assert row.precision_at_k == pytest.approx(2 / 3) and row.jaccard == pytest.approx(0.5)


def test_tie_bounds_and_gap(pairs):
    ranked = rank_both(pairs([4, 3, 3, 1], [4, 3, 2, 1]), BY, ties=True)
    row = ties.cutoff_diagnostics(ranked, BY, [50.0]).first()
    assert (row.overlap, row.min_overlap, row.max_overlap) == (2, 1, 2)
    assert row.left_absolute_gap == 0 and row.left_tie_ambiguous and row.tie_ambiguous and not row.right_tie_ambiguous


def test_retention(pairs):
    ranked = rank_both(pairs([5, 4, 3, 2, 1], [5, 4, 1, 3, 2]), BY)
    rows = retention.retention_map(ranked, BY, [20.0, 50.0])
    row = rows.filter("direction = 'left_to_right' AND q_source = 20 AND q_target = 20").first()
    assert (row.source_k, row.overlap, row.retention) == (1, 1, 1.0)


def test_area_of_a_line(spark):
    curve = spark.createDataFrame([("p", float(q), q / 50.0) for q in range(51)], "panel string, q double, adjusted_jaccard double")
    assert overlap.area_summary(curve, BY).first().naucc == pytest.approx(0.5)
    both = overlap.interpolated_area(curve, BY, 1.0, 10.0, "a").first().a
    assert both == pytest.approx(overlap.area_summary(curve, BY).first().partial_elite)


def test_onset_needs_a_run(spark):
    low = [0.1 if q in (2, 3, 4) or q >= 10 else -0.1 for q in range(1, 21)]
    curve = spark.createDataFrame([("p", float(q), low[q - 1]) for q in range(1, 21)], "panel string, q double, low double")
    row = overlap.onset(curve, BY, "low", [0.0]).first()
    assert row.persistent_onset == 10.0 and row.first_crossing == 2.0
    short = overlap.onset(curve.filter("q < 10"), BY, "low", [0.0]).first()
    assert short.persistent_onset is None


def test_borda_selects_the_top_rows(pairs):
    prepared = portfolio.prepare(pairs([10, 5, 1], [9, 4, 2]), BY, 0.5)
    rows = portfolio.select(prepared, BY, ["borda_count"], [1.5])
    assert sorted(r.id for r in rows.collect()) == [0, 1]


def test_oracle_balances(pairs):
    prepared = portfolio.prepare(pairs([6, 5, 4, 3, 2, 1], [6, 5, 1, 0, 4, 3]), BY, 0.5)
    rows = portfolio.select(prepared, BY, ["minimax_oracle"], [1.0])
    out = portfolio.recalls(rows, BY).first()
    assert rows.count() == 3 and out.worst_source_recall == pytest.approx(2 / 3)


def test_copy_flag(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(1, 6)], "a double, b double")
    row = audit.field_provenance(df, {"x": ("a", "b")}).first()
    assert row.same_field_copy_flag and row.fraction_identical == 1.0


def test_chemistry_and_prototypes(spark):
    df = spark.createDataFrame([("LiAlSe2",), ("CoS2",), ("HoCoO3",), ("NaClO3",), ("Na2Cl2",), ("NaCl",)], "f string")
    got = {r.f: r for r in fm.reduced_formula(fm.prototype(fm.chemistry_class(df, "f"), "f"), "f").collect()}
    assert [got[f].chemistry_class for f in ("LiAlSe2", "CoS2", "HoCoO3", "NaClO3")] == [
        "selenide", "sulfide", "oxide", "halide_oxide",
    ]
    assert got["Na2Cl2"].prototype == got["NaCl"].prototype == "AB"
    assert got["Na2Cl2"].reduced_formula == "ClNa"


def test_train_pool_keeps_only_the_unrelated_record(spark):
    recs = spark.createDataFrame(
        [("J-1", "F1", "P1"), ("J-2", "F0", "P2"), ("J-3", "F3", "P0"), ("M-1", "F4", "P4"), ("J-5", "F5", "P5")],
        "id string, formula string, prototype string",
    )
    test = spark.createDataFrame([("J-1", "M-1", "F0", "P0")], "left_id string, right_id string, formula string, prototype string")
    assert [r.id for r in pairing.train_pool(recs, test, "id", "formula", "prototype").collect()] == ["J-5"]


def test_block_swap_is_invisible_to_global_statistics(pairs):
    left = list(range(100, 0, -1))
    right = left[5:10] + left[:5] + left[10:]
    frame = pairs(left, right)
    ranked = rank_both(frame, BY, ties=True)
    assert overlap.overlap_counts(ranked, BY, [5.0]).first().overlap == 0
    assert kendall_tau(frame, BY).first().tau == pytest.approx(1 - 100 / 9900)
    assert spearman(ranked, BY).first().rho == pytest.approx(1 - 1500 / 999900)


def test_step_up_and_its_older_form(spark):
    df = spark.createDataFrame([("p", i, p) for i, p in enumerate([0.01, 0.04, 0.10, 0.50, 0.001])], "panel string, i int, pvalue double")
    good = [r.qvalue for r in retention.step_up_fdr(df, BY).orderBy("i").collect()]
    assert good == pytest.approx([0.025, 0.04 * 5 / 3, 0.125, 0.5, 0.005])
    old = [r.qvalue for r in retention.step_up_fdr(df, BY, compat=True).collect()]
    assert old == pytest.approx([0.005] * 5)


def test_missing_values_never_rank(pairs):
    frame = pairs([1, None, 3, float("nan"), float("inf"), 2], [1, 2, None, 4, 5, 3])
    rows = rank_both(frame, BY).collect()
    assert sorted(r.id for r in rows) == [0, 5] and all(r.n == 2 for r in rows)


def test_fold_matches_integer_arithmetic(spark):
    import hashlib

    ids = [f"pair-{i}" for i in range(50)]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").selectExpr("id", f"{portfolio.fold_of('id', 7)} AS f").collect()
    assert all(r.f == int(hashlib.md5(r.id.encode()).hexdigest(), 16) % 7 for r in rows)


def test_match_tiers(spark):
    df = spark.createDataFrame(
        [(1, False, True, True, True, "identical", "proper"), (2, False, True, True, True, "different", "proper"),
         (3, False, False, True, True, "identical", None), (4, False, True, True, True, "identical", "deformation"),
         (5, True, False, False, False, "identical", None)],
        "id int, parse_error boolean, same_count boolean, same_formula boolean, fit boolean, relation string, rotation_class string",
    )
    got = {r.id: r.tier for r in pairing.tier(df).collect()}
    assert got == {1: "tier_1", 2: "quarantine", 3: "tier_3", 4: "quarantine", 5: "quarantine"}


def test_reconcile_statuses(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", math.nan)], "k string, value double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.5), ("w", 1.0)], "k string, value double")
    got = {r.k: r.status for r in pairing.reconcile(a, b, ["k"], 1e-6).collect()}
    assert got == {"x": "pass", "y": "fail", "z": "missing_or_nonfinite", "w": "missing_or_nonfinite"}


def test_wrong_columns_fail_at_once(spark):
    with pytest.raises(ValueError):
        rank_both(spark.range(3).withColumn("left", F.lit(1.0)), ["panel"])
