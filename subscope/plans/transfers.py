"""Round trips through the file sources and sinks, as queries.

The tables, or the metric outputs, are written under the shared checkpoint folder and what
is read back is the result, so each query is checked like any other. Folders are named after
the tables' content and used again, so repeated runs leave nothing more behind.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.params import DEFAULT_PERIOD, Period
from subscope.plans import kpis
from subscope.session import checkpoint_dir
from subscope.sources import files
from subscope.sources.binding import Tables

#: what is compared of each table: rows, users, and an exact sum over a column of its own
CHECKED = [("users", "age"), ("subscriptions", "user_id"), ("user_sessions", "session_duration_minutes"),
           ("transactions", "amount"), ("support_tickets", "resolution_time_hours"), ("feature_events", "time_spent_seconds")]


def _folder(t: Tables, p: Period, kind: str) -> str:
    spark = t.users.sparkSession
    content = hashlib.sha1(f"{getattr(t, 'token', id(t))} {p}".encode()).hexdigest()[:20]
    return f"{checkpoint_dir(spark).rstrip('/')}/subscope-transfers/{kind}-{content}"


def _digest(t: Tables) -> DataFrame:
    frames = [getattr(t, name).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("user_id").alias("user_count"),
                                   F.sum(F.col(column).cast("decimal(20,2)")).cast("double").alias("column_sum"))
              .select(F.lit(name).alias("table_name"), "row_count", "user_count", "column_sum") for name, column in CHECKED]
    return reduce(DataFrame.unionByName, frames)


def csv_tables(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The six tables exported as CSV without surrogate keys, and read back typed."""
    path = _folder(t, p, "csv")
    files.write_tables_csv(t, path)
    return _digest(files.read_tables_csv(t.users.sparkSession, path))


def parquet_tables(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The six tables bulk-loaded as Parquet, overwriting, and read back."""
    path = _folder(t, p, "parquet")
    files.write_tables_parquet(t, path)
    return _digest(files.read_tables_parquet(t.users.sparkSession, path))


def facts_by_month(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The facts loaded by month, the reporting month loaded once more over itself, and all read
    back: months, rows, users and an exact sum per table, and the rows of the reporting month."""
    spark, path = t.users.sparkSession, f"{_folder(t, p, 'months')}-{uuid.uuid4().hex}"
    files.load_facts_by_month(t, path)
    files.load_facts_by_month(t, path, [p.month])
    frames = []
    for name, column in CHECKED:
        if name in files.FACT_DATES:
            facts = files.read_facts_by_month(spark, path, name)
            frames.append(facts.agg(
                F.countDistinct(files.MONTH).alias("months"), F.count(F.lit(1)).alias("row_count"),
                F.countDistinct("user_id").alias("user_count"),
                F.sum(F.col(column).cast("decimal(20,2)")).cast("double").alias("column_sum"),
                F.count(F.when(F.col(files.MONTH) == p.month, 1)).alias("period_rows")).withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, frames)


def fallback_tables(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Of a folder that is missing and a CSV export that is there, the second is
    loaded. One row per source, in order: its label, whether it was used, and the rows it gave."""
    spark, path = t.users.sparkSession, _folder(t, p, "fallback")
    files.write_tables_csv(t, path)
    sources = [("Missing", lambda: files.read_tables_parquet(spark, f"{path}/missing")),
               ("CSV", lambda: files.read_tables_csv(spark, path))]
    loaded, label, reasons = files.load_tables(sources)
    rows = F.lit(None).cast("long")
    frames = [spark.range(1).select(F.lit(name).alias("source"), F.lit(False).alias("used"), rows.alias("session_rows"))
              for name in reasons]
    if loaded is not None:
        frames.append(loaded.user_sessions.agg(F.count(F.lit(1)).alias("session_rows"))
                      .select(F.lit(label).alias("source"), F.lit(True).alias("used"), "session_rows"))
    return reduce(DataFrame.unionByName, frames)


def _metric_file(t: Tables, p: Period, name: str, frame: DataFrame) -> str:
    """The folder of one metric output, written alone: a key does the work of the file it reads."""
    root = f"{_folder(t, p, 'metrics')}-{uuid.uuid4().hex}"
    files.write_metric_table(root, name, frame)
    return f"{root}/{name}"


def metric_files_kpis(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """A metric output written as CSV and read back."""
    return files.read_metric_csv(t.users.sparkSession, _metric_file(t, p, "kpis", kpis.kpi_summary(t, p)), files.KPI_SCHEMA)


def metric_files_ab(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return files.read_metric_csv(t.users.sparkSession, _metric_file(t, p, "ab_test_metrics", kpis.ab_metrics(t, p)), files.AB_SCHEMA)


def metric_files_cohorts(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return files.read_metric_csv(t.users.sparkSession, _metric_file(t, p, "cohort_retention", kpis.cohort_retention_matrix(t, p)))


def metric_files_monthly(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return files.read_metric_csv(t.users.sparkSession, _metric_file(t, p, "monthly_metrics", kpis.monthly_mrr(t, p)), files.MONTHLY_SCHEMA)


PLANS = {
    "csv_tables": csv_tables,
    "parquet_tables": parquet_tables,
    "facts_by_month": facts_by_month,
    "fallback_tables": fallback_tables,
    "metric_files_kpis": metric_files_kpis,
    "metric_files_ab": metric_files_ab,
    "metric_files_cohorts": metric_files_cohorts,
    "metric_files_monthly": metric_files_monthly,
}
