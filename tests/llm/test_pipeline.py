"""Each stage on its own input, and all of them, against independent expectations."""

import duckdb
import pytest

import corpus_pipeline
from tests_llm_helpers import kept_lines_once, similar_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, SF))
        out.append((name, docs.toPandas(), after.toPandas()))
        docs = after
    return out


def test_stages_and_columns(steps):
    assert [n for n, _, _ in steps] == ["language_id", "line_dedup", "jaccard_join", "mixing", "sentencepiece"]
    for name, before, after in steps[:-1]:
        assert list(after.columns) == list(before.columns) and set(after.doc_id) <= set(before.doc_id)


def test_language_keeps_all_with_letters(steps):
    _, before, after = steps[0]
    assert set(after.doc_id) == {d.doc_id for d in before.itertuples() if d.text and any(c.isalpha() for c in d.text)}


def test_lines_repeat_nowhere_and_first_occurrences_stay(steps):
    _, before, after = steps[1]
    kept_lines_once(before, after)


def test_one_of_each_class(steps):
    _, before, after = steps[2]
    assert set(after.doc_id) == similar_classes(before)


def test_mixing_drops_toxic_and_keeps_good(steps):
    _, before, after = steps[3]
    labels = {r[0]: r[1:] for r in duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()}
    good = [i for i in before.doc_id if labels.get(i) == (1, 0)]
    assert sum(i in set(after.doc_id) for i in good) >= 0.9 * len(good)


def test_tokens_decode(steps):
    _, before, after = steps[4]
    assert len(before) == len(after) and after.round_trip.all() and (after.n_tokens == after.ids.map(len)).all()


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(got.doc_id, got.n_tokens)) == sorted(zip(steps[4][2].doc_id, steps[4][2].n_tokens))
