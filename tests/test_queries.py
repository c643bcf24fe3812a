import __spark_entry__ as entry
import pytest
from verification.check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
LARGER_SF = "/root/testdata/sf0.01"
# Need labels or levels that the smallest scale lacks.
LARGER = {
    "export_validation", "export_validation_rows", "prepared_export", "flat_file_matrix", "out_of_time_rows",
    "out_of_time_validation", "scoring_balance_equations", "scoring_job_features", "scoring_job_predictions",
    "logit_balance_equations", "forest_cross_validation", "forest_cross_validation_folds",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def larger():
    return connect(LARGER_SF)


def crosses_rows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, larger, name):
    """The query gives the rows of its SQL and never pairs all rows of two tables."""
    plans = []

    def run(spark, folder):
        plans.append(entry.queries()[name](spark, folder))
        return plans[0]

    folder = LARGER_SF if name in LARGER else SF
    ok, note = compare(spark, larger if name in LARGER else con, run, SQL[name], folder)
    assert ok, note
    assert not crosses_rows(plans[0])


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, LARGER_SF if name in LARGER else SF)
    assert not df.isEmpty()
    assert not crosses_rows(df)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == df.select("subscription_id").distinct().count() > 0
