"""Facts partitioned by month; a load replaces the months it holds and no other."""

import pytest
from pyspark.sql import functions as F

from subscope.params import DEFAULT_PERIOD
from subscope.plans import registry
from subscope.sources import files
from subscope.sources.binding import Tables

from conftest import SF_SMALL

NAME, DATE = "transactions", "transaction_date"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    t = registry.tables_for(spark, SF_SMALL)
    path = str(tmp_path_factory.mktemp("months"))
    files.load_facts_by_month(t, path)
    return t, path


def test_load_holds_every_row_in_its_month(spark, loaded):
    t, path = loaded
    for name, date in files.FACT_DATES.items():
        back, facts = files.read_facts_by_month(spark, path, name), getattr(t, name)
        same = back.drop(files.MONTH)
        assert same.exceptAll(facts).count() == facts.exceptAll(same).count() == 0
        assert back.where(f"month <> date_format({date}, 'yyyy-MM')").count() == 0


def test_reload_replaces_its_month_only(spark, loaded, tmp_path):
    t, _ = loaded
    path, month = str(tmp_path), DEFAULT_PERIOD.month
    files.load_facts_by_month(t, path)
    of_month = F.date_format(DATE, "yyyy-MM") == month
    n, inside = t.transactions.count(), t.transactions.where(of_month).count()
    assert inside > 1
    doubled = t.transactions.withColumn("amount", F.when(of_month, F.lit(1).cast("decimal(10,2)")).otherwise(-F.col("amount")))
    files.load_facts_by_month(Tables(t.users, t.subscriptions, t.user_sessions, doubled, t.support_tickets, t.feature_events), path, [month])
    back = files.read_facts_by_month(spark, path, NAME)
    assert back.count() == n  # replaced, not added
    assert back.where(f"month = '{month}' AND amount = 1").count() == inside
    assert back.where(f"month <> '{month}'").drop("month").exceptAll(t.transactions).count() == 0
    files.append_facts(t.transactions.where(of_month).limit(1), path, NAME)
    assert files.read_facts_by_month(spark, path, NAME).where(f"month = '{month}'").count() == inside + 1


def test_a_month_is_a_choice_of_folders(spark, loaded):
    _, path = loaded
    facts = files.read_facts_by_month(spark, path, NAME)
    plan = facts.where(F.col("month") == DEFAULT_PERIOD.month)._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert DEFAULT_PERIOD.month in filters.split("PartitionFilters: [", 1)[1].split("]")[0]
    # months that another table names prune the scan while the query runs
    wanted = spark.range(3).select(F.format_string("2001-0%d", F.col("id") + 5).alias("month")).where("month < '2001-07'")
    joined = facts.join(F.broadcast(wanted), "month")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString().lower()
