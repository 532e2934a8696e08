"""Registered queries against DuckDB. A sample by default; TANDEMRANK_ALL=1 runs every query that has SQL."""

import math
import os

import duckdb
import pytest

from tandemrank.catalog import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = load()
SAMPLE = [
    "average_ranks", "concordance_curve", "curve_summary", "kendall_tau_ties", "cutoff_diagnostics", "tie_bounds",
    "boundary_risk", "raw_value_summary", "threshold_screening", "ks_statistic", "quantile_mapping_error",
    "cluster_bootstrap_curves", "simultaneous_band", "permutation_pvalue", "portfolio_benchmark", "high_response",
    "tensor_scores", "orbit_full", "reduced_formula", "pair_quarantine", "train_pool", "baseline_matrix", "distance_trim",
    "audit_sample", "stratified_sample", "illustrative_picks",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(pdf):
    def text(v):
        return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)

    return sorted(tuple(text(v) for v in row) for row in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("TANDEMRANK_ALL") else SAMPLE)
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 130
