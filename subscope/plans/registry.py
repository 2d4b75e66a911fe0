"""Name -> plan and name -> oracle SQL, for every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subscope.params import DEFAULT_PERIOD, Period
from subscope.sources.binding import Tables, bind


def _plans() -> dict[str, Callable[..., DataFrame]]:
    from subscope.plans import catalog, churn, kpis, linear_model, proactive, quality, queries, segments, transfers
    out = dict(queries.QUERIES)
    for module in (kpis, quality, churn, linear_model, segments, proactive, transfers, catalog):
        out.update(module.PLANS)
    return out


def _sql(p: Period) -> dict[str, str]:
    from subscope.oracle import catalog_sql, churn_sql, kpis_sql, model_sql, proactive_sql, quality_sql, queries_sql, segments_sql, transfers_sql
    out = dict(queries_sql.query_sql(p))
    for module in (kpis_sql, quality_sql, churn_sql, model_sql, segments_sql, proactive_sql, transfers_sql):
        out.update(module.sql(p))
    out.update(catalog_sql.sql(out))
    return out


PLANS = _plans()


def tables_for(spark: SparkSession, sf_dir: str, period: Period = DEFAULT_PERIOD,
               materialized: bool = True) -> Tables:
    """Bound tables: read from the written store (default), or bound lazily from the driver tables."""
    if materialized:
        from subscope.sources.store import bound_tables
        return bound_tables(spark, sf_dir, period)
    return bind(spark, sf_dir, period)


def run(name: str, spark: SparkSession, sf_dir: str, period: Period = DEFAULT_PERIOD,
        materialized: bool = True) -> DataFrame:
    return PLANS[name](tables_for(spark, sf_dir, period, materialized), period)


def spark_queries(period: Period = DEFAULT_PERIOD) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(name):
        return lambda spark, sf_dir: run(name, spark, sf_dir, period)
    return {name: make(name) for name in PLANS}


def oracle_sql(period: Period = DEFAULT_PERIOD) -> dict[str, str]:
    sql = _sql(period)
    return {name: sql[name] for name in PLANS if name in sql}
