"""Plan-shape guards for the scale design: no Cartesian products, the rank limit runs
before the shuffle, month filters reach the Parquet scan."""

import pytest

from subscope.plans import registry

from conftest import SF_SMALL

MODEL = {"binary_metrics", "classification_report", "confusion_matrix", "coefficient_table",
         "top_coefficients", "score_users", "risk_band_counts"}


def _plan(spark, name):
    df = registry.run(name, spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.PLANS) - MODEL))
def test_no_cartesian_product(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name,tables", [("iqr_outliers", 3), ("cap_at_p99", 2), ("impute_median", 1), ("clean_sessions", 1)])
def test_quantiles_read_a_table_at_most_twice(spark, name, tables):
    """Once for the written counts while the plan is built, and once more only where its rows are the result."""
    from subscope.sources import store
    store.purge_intermediates(spark)
    plan = _plan(spark, name)
    root = registry.tables_for(spark, SF_SMALL).root.rsplit("/", 1)[1]
    scans = [line for line in plan.splitlines() if "FileScan" in line and root in line]
    assert len(scans) <= (1 if name.startswith("clean") else 0), scans


def test_top3_limits_before_the_shuffle(spark):
    df = registry.run("top3_sessions_by_channel", spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name,column", [("period_revenue", "transaction_date"),
                                         ("daily_active_users", "session_date"),
                                         ("stickiness_month", "session_date")])
def test_period_filters_are_pushed(spark, name, column):
    df = registry.run(name, spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and column in line]
    assert pushed and any("GreaterThanOrEqual" in line for line in pushed), plan
