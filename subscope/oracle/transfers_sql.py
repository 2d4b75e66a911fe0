"""Oracle SQL for the round trips: what was written is what must come back."""

from __future__ import annotations

from subscope.oracle import kpis_sql
from subscope.oracle.binding import with_binding
from subscope.params import DEFAULT_PERIOD, Period
from subscope.plans.transfers import CHECKED
from subscope.sources.files import FACT_DATES


def sql(p: Period = DEFAULT_PERIOD) -> dict[str, str]:
    digest = with_binding("\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, count(DISTINCT user_id) AS user_count, "
        f"CAST(sum(CAST({c} AS DECIMAL(20,2))) AS DOUBLE) AS column_sum FROM {t}" for t, c in CHECKED))
    metrics = kpis_sql.sql(p)
    return {
        "csv_tables": digest,
        "parquet_tables": digest,
        "facts_by_month": with_binding("\nUNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(DISTINCT strftime({FACT_DATES[t]}, '%Y-%m')) AS months, count(*) AS row_count, "
            f"count(DISTINCT user_id) AS user_count, CAST(sum(CAST({c} AS DECIMAL(20,2))) AS DOUBLE) AS column_sum, "
            f"count(*) FILTER (strftime({FACT_DATES[t]}, '%Y-%m') = '{p.month}') AS period_rows FROM {t}"
            for t, c in CHECKED if t in FACT_DATES)),
        "fallback_tables": with_binding("""
SELECT 'Missing' AS source, false AS used, CAST(NULL AS BIGINT) AS session_rows
UNION ALL SELECT 'CSV', true, count(*) FROM user_sessions"""),
        "metric_files_kpis": metrics["kpi_summary"],
        "metric_files_ab": metrics["ab_metrics"],
        "metric_files_cohorts": metrics["cohort_retention_matrix"],
        "metric_files_monthly": metrics["monthly_mrr"],
    }
