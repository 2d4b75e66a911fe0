"""subscope: subscription and product metrics as Spark DataFrame / SQL / ML jobs.

Layout
------
sources/    bind the driver tables to the six-table model; CSV/Parquet/JDBC sources and sinks
functions/  column expressions (month keys, exact half-up ratios, bands, stage order)
operators/  reusable Spark building blocks (per-user grain, exact quantiles, top-k, reshape)
plans/      the named queries, KPIs, audits, churn features and model, dashboard tables
streaming/  Structured Streaming forms (inactivity alerts, windowed activity)
oracle/     DuckDB SQL text used to check every SQL-expressible query
"""

from subscope.params import Period, DEFAULT_PERIOD
from subscope.session import build_session, checkpoint_dir

__all__ = ["Period", "DEFAULT_PERIOD", "build_session", "checkpoint_dir"]
