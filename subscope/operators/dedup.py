"""Keep-first by key and duplicate counting, both as partial aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` value.

    Written as ``min(struct(order, cols...))`` per key rather than a window
    ``row_number() = 1``: an aggregate combines map-side, so a key that holds
    a third of all rows is reduced before the shuffle instead of landing whole
    in one window task.
    """
    packed = F.min(F.struct(F.col(order), *[F.col(c) for c in cols])).alias("_first")
    return df.groupBy(key).agg(packed).select(key, *[F.col(f"_first.{c}").alias(c) for c in cols])


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: number of rows that repeat an earlier identical row (all but the first)."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
