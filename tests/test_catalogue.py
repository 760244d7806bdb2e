"""Every query with SQL agrees with DuckDB exactly on the smallest given tables."""

import pytest

from martlib.plans.catalogue import QUERIES
from martlib.plans.oracle import ORACLE
from martlib.plans.pipeline import load_or_fit, train_pipeline
from martlib.plans.workspace import workspace

from oracle_check import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, duck, key):
    assert differences(spark, duck, SF_DIR, QUERIES[key], ORACLE[key]) == []


def test_pipeline(spark, tmp_path):
    w = workspace(spark, SF_DIR)
    path = str(tmp_path / "model")
    trained = train_pipeline(
        w.star, path, "2001-06-11", 1998, 25, {"trees": [2, 3], "depth": [2]}, folds=2
    )
    assert trained.params.depth == 2 and trained.scores.count() == 2
    row = trained.metrics.first()
    assert row.total_streams == trained.per_stream.count() > 0
    assert trained.steps.count() > 0 and trained.importance.count() > 0
    loaded = load_or_fit(spark, path, None)
    assert loaded == trained.model and loaded.trees == trained.params.trees


def test_entry_has_rows():
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLE)
