"""Wide/long reshaping with built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, ids: list[str], values: list[str], name_col: str, value_col: str,
            labels: list[str] | None = None) -> DataFrame:
    """Wide -> long with ``stack``; ``labels`` rename the value columns in the name column."""
    labels = labels or values
    args = ", ".join(f"'{lab}', `{v}`" for lab, v in zip(labels, values))
    return df.select(*ids, F.expr(f"stack({len(values)}, {args}) AS (`{name_col}`, `{value_col}`)"))


def one_row(*frames: DataFrame) -> DataFrame:
    """Place one-row aggregates side by side as scalar subqueries.

    Each input is a global aggregate (exactly one row). Each is packed into a
    struct and read as a scalar subquery: Catalyst runs it once, merges
    subqueries over the same source into one aggregate, and fails loudly if an
    input ever had more than one row. No join is planned.
    """
    spark = frames[0].sparkSession
    cols = []
    for f in frames:
        packed = f.select(F.struct(*[F.col(c) for c in f.columns]).alias("_r")).scalar()
        cols += [packed.getField(c).alias(c) for c in f.columns]
    return spark.range(1).select(*cols)


def scalar(frame: DataFrame, col: str):
    """The single value of a one-row frame, as a scalar-subquery column."""
    return frame.select(col).scalar()
