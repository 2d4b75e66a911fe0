"""Every SQL-expressible query against its DuckDB oracle: on the bound driver
tables (sf0.001; the driver repeats this at sf0.01) and on hand-made edge tables."""

import datetime as dt

import pytest

from subscope.oracle.binding import unbound
from subscope.oracle.compare import compare
from subscope.params import Period
from subscope.plans import registry

from conftest import SF_SMALL

SQL = registry.oracle_sql()
NAMES = sorted(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_driver_tables(spark, duck_small, name):
    ok, msg = compare(registry.run(name, spark, SF_SMALL), duck_small, SQL[name])
    assert ok, msg


#: the hand-made users have activity before their signup
FIXTURE_PERIOD = Period(first_offset=-12)
with unbound():
    SQL_UNBOUND = registry.oracle_sql(FIXTURE_PERIOD)


@pytest.mark.parametrize("name", NAMES)
def test_hand_made_fixtures(fixture_pair, name):
    tables, con = fixture_pair
    ok, msg = compare(registry.PLANS[name](tables, FIXTURE_PERIOD), con, SQL_UNBOUND[name])
    assert ok, msg


def test_every_query_has_oracle_or_is_model():
    no_sql = set(registry.PLANS) - set(SQL)
    assert no_sql == {"binary_metrics", "classification_report", "confusion_matrix", "coefficient_table",
                      "top_coefficients", "score_users", "risk_band_counts"}


def test_lazy_binding_equals_store(spark, duck_small):
    # the written store and the lazy binding give the same rows
    for name in ["ticket_segment_churn", "top10_spenders", "cohort_retention_long"]:
        ok, msg = compare(registry.run(name, spark, SF_SMALL, materialized=False), duck_small, SQL[name])
        assert ok, (name, msg)


def test_cohort_matrix_rejects_periods_it_has_no_column_for(spark):
    tables = registry.tables_for(spark, SF_SMALL)
    with pytest.raises(Exception, match="cohort months"):
        registry.PLANS["cohort_retention_matrix"](tables, Period(first_offset=1)).collect()


EMPTY = Period(first_offset=-12, month_start=dt.date(1990, 1, 1), month_end=dt.date(1990, 1, 31),
               dau_start=dt.date(1990, 1, 17), as_of=dt.date(1990, 1, 31))
with unbound():
    SQL_EMPTY = registry.oracle_sql(EMPTY)


@pytest.mark.parametrize("name", NAMES)
def test_empty_period_guards(fixture_pair, name):
    """A month with no activity: every zero denominator must be guarded (ANSI mode
    raises on division by zero) and agree with the SQL's NULL/0 results."""
    tables, con = fixture_pair
    ok, msg = compare(registry.PLANS[name](tables, EMPTY), con, SQL_EMPTY[name])
    assert ok, msg
