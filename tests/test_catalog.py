"""Every registered query beside its SQL, and the driver's entry."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

NAMES = sorted(entry.queries())
# The SQL side has no rows at the smallest scale.
EMPTY_AT_SMALL = {"Q4_group_having", "E2_similar_pairs", "E2_similar_pairs_in_regions"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "question_id", "answer_format", "metric", "number", "cell"]
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    run, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert run(spark, sf).count() > 0
        return
    found = differences(spark, con, name, run, sql, sf)
    assert found is None or (name in EMPTY_AT_SMALL and found == "both sides are empty"), found
