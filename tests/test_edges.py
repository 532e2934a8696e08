"""Keys of one or two rows, constant sides, null strata, missing distances, malformed formulas, wide draws."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tandemrank import session
from tandemrank.functions import formula, scalars
from tandemrank.functions.tensors import longitudinal_maximum
from tandemrank.operators.correlation import pearson, shift_summary, spearman
from tandemrank.operators.rank import rank_both
from tandemrank.operators.resample import counter_hash
from tandemrank.operators.tau import kendall_test
from tandemrank.plans.tables import distance_strata, distance_trim, robustness
from tandemrank.session import spread_join
from tandemrank.sources.sinks import content_hash

KEYED = "panel string, id bigint, left double, right double, stratum string, dist double"


def keyed(spark):
    rows = [("one", 1, 1.0, 2.0, "a", 1.0), ("two", 1, 1.0, 2.0, "a", 1.0), ("two", 2, 2.0, 1.0, "b'c", None)]
    rows += [("flat", i, 1.0, float(i), None, float(i)) for i in range(5)]
    rows += [("full", i, float(i), float(i * 7 % 30), ["a", "b'c", None][i % 3], None if i % 10 == 0 else float(i)) for i in range(30)]
    return spark.createDataFrame(rows, KEYED)


def test_kendall_test_has_nulls_instead_of_failing(spark):
    got = {r.panel: r for r in kendall_test(keyed(spark), ["panel"]).collect()}
    assert got["one"].pvalue is None and got["flat"].tau is None and got["flat"].pvalue is None
    assert got["two"].tau == -1.0 and 0 < got["full"].pvalue < 1


def test_shift_of_one_pair_is_zero(spark):
    got = {r.panel: r for r in shift_summary(rank_both(keyed(spark), ["panel"], ties=True), ["panel"]).collect()}
    assert got["one"].normalized_shift == 0 and got["two"].normalized_shift == 1.0


def test_constant_side_in_several_tasks_has_no_correlation(spark):
    # Merged into nothing, the mean of a task's 49 equal values is off in the last bit for some of these values.
    rows = spark.range(98, numPartitions=2).selectExpr(
        "id", "inline(transform(sequence(1, 40), k -> named_struct('key', k, 'left', 857.5D + k / 7, 'right', double(id * 7 % 31))))"
    )
    assert pearson(rows, ["key"]).filter("r IS NOT NULL").count() == 0
    ranked = rows.selectExpr("key", "98L AS n", "left AS l_first", "left AS l_last", "right AS r_first", "right AS r_last")
    assert spearman(ranked, ["key"]).filter("rho IS NOT NULL").count() == 0
    assert spearman(ranked.withColumn("l_last", F.col("r_first")), ["key"]).filter("rho > 0.99").count() == 40


def test_robustness_takes_quotes_nulls_and_tiny_subsets(spark):
    got = robustness(keyed(spark), ["panel"], {"one row": "id = 1"}, "stratum").toPandas().set_index(["panel", "subset"])
    assert got.loc[("full", "without_a"), "n"] == 20 and got.loc[("full", "without_b'c"), "n"] == 20  # nulls stay
    assert got.loc[("full", "one row"), "n"] == 1 and got.loc[("flat", "without_a"), "n"] == 5


def test_missing_distances_stay_in_the_trim_and_have_no_stratum(spark):
    trim = distance_trim(keyed(spark), ["panel"], "dist", (0.0, 0.2)).toPandas().set_index(["panel", "trim_fraction"])
    assert trim.loc[("full", 0.0), "n"] == 30 and trim.loc[("full", 0.2), "n"] == 30 - 27 // 5
    strata = distance_strata(keyed(spark), ["panel"], "dist").toPandas()
    assert strata[strata.panel == "full"].n.sum() == 27 and strata.distance_max.notna().all()


def test_formulas(spark):
    rows = [("Na.",), ("Na0.5Cl2",), ("Na2Cl2",), ("H1000000000O2000000000",), ("",), (None,), ("Fe2O3",), ("Na0Cl0",)]
    df = spark.createDataFrame(rows, "f string")
    proto = {r.f: r.prototype for r in formula.prototype(df, "f").collect()}
    assert proto["Na0.5Cl2"] == "AB" and proto["Na2Cl2"] == "AB" and proto["Fe2O3"] == "A3B2" and proto["H1000000000O2000000000"] == "A2B"
    assert proto["Na."] is None and proto[""] is None and proto[None] is None and proto["Na0Cl0"] == "AB"
    kept = {r.f: r.reduced_formula for r in formula.reduced_formula(df, "f").collect()}
    assert kept["Na."] == "Na." and kept["Na0.5Cl2"] == "Cl4Na"


def test_zero_length_is_left_out(spark):
    df = spark.createDataFrame([(2.0, 3.0, 1.0, 0.0)], "a double, b double, c double, d double")
    assert df.select(F.expr(scalars.lattice_strain(["a", "b"], ["c", "d"]))).first()[0] == 1.0


def test_content_hash_sees_where_the_null_is(spark):
    one, two = (content_hash(spark.createDataFrame(r, "a string, b string")).first().content_hash for r in ([(None, "x")], [("x", None)]))
    assert one != two


def test_draws_are_even_for_many_units(spark):
    assert counter_hash("1") == counter_hash("1") and ", 15)" in counter_hash("1")
    for units in (2**31 + 2**30, 2**33):
        got = spark.range(20_000).select((F.expr(f"{counter_hash('42', 'id')} % {units}") / (units / 8)).cast("int").alias("b")).groupBy("b").count().collect()
        counts = [r["count"] for r in got]
        assert len(counts) == 8 and sum((c - 2500) ** 2 / 2500 for c in counts) < 30  # chi-squared, 7 degrees of freedom
    want = duckdb.sql("select cast('0x' || substr(md5(concat_ws('|', '42', '7')), 1, 15) as bigint)").fetchall()[0][0]
    assert spark.sql(f"select {counter_hash('42', '7')}").first()[0] == want


def test_half_a_sphere_is_enough():
    r = np.random.default_rng(2)
    n = r.standard_normal((6, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    axial = np.einsum("bi,bj,bk->bijk", n, n, n).reshape(6, 27) * np.arange(1, 7)[:, None]
    assert np.allclose(longitudinal_maximum(axial), np.arange(1, 7), rtol=1e-6)


def test_hot_and_null_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(session, "bounded", lambda df, limit=0: df)
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).cast("bigint").alias("k"))
    table = spark.createDataFrame([(7, "hot"), (8, "cold"), (2, "two")], "k bigint, v string")
    inner = spread_join(rows, table, ["k"], "id")
    left = spread_join(rows, table, ["k"], "id", "left")
    assert inner.count() == 3000 + 2 and left.count() == 9000 and left.filter("v = 'hot'").count() == 3000
    assert math.isclose(left.filter("v is null").count(), 9000 - 3002)
