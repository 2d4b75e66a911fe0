"""Dense-rank top-k per group without one task per group.

``DENSE_RANK() OVER (PARTITION BY g ORDER BY v DESC) <= k`` keeps every row whose
value is among the k largest distinct values of its group, ties included. Run
literally, the window puts a whole group (a signup channel: a fifth of all
sessions) into one task. Instead:

1. reduce to distinct (group, value) pairs: an aggregate, combined map-side;
2. rank those pairs; Spark plans the rank filter as a WindowGroupLimit that
   also runs before the shuffle, so each group's window sees at most k values
   per upstream partition;
3. join the rows back to the <= k ranked values of their group. That frame is
   tiny (k rows per group); AQE measures it at run time and broadcasts it, and
   the join stays a shuffle join if it is not small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_values(pairs: DataFrame, group: str, value: str, k: int, rank_col: str) -> DataFrame:
    distinct_pairs = pairs.select(group, value).distinct()
    w = Window.partitionBy(group).orderBy(F.col(value).desc())
    return (distinct_pairs.withColumn(rank_col, F.dense_rank().over(w))
            .where(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("long")))
