"""Exact quantiles (linear interpolation) computed without one task holding the data.

Spark's exact ``percentile`` aggregate keeps a value->count map of the whole column in one
final task. This operator finds the same order statistics with bounded work per task, by one
plan for every size of input:

1. ``value_counts``: distinct values with their counts (combined map-side: one value that
   holds a third of all rows is one row after it), written once; every later step, and any
   other number a caller takes from the column, reads those files, never the table again;
2. ``percentile_approx`` over the distinct values gives B-1 bounds (a fixed-size sketch per
   task), so every bucket holds about 1/B of the distinct values; B follows the session's
   shuffle partitions, which a cluster sizes by its data;
3. per-bucket totals (B rows) give each bucket's starting rank, and so the buckets that hold
   a wanted rank;
4. only those are ordered, each in its own task, to read off the value at that rank: an
   equi-join on the bucket number, at most two buckets per probability.

The interpolation between the two neighbouring order statistics follows numpy/pandas
("linear"): a + (b-a)*t, or b - (b-a)*(1-t) when t >= 0.5. Writing the counts is the only job
that runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: buckets for each shuffle partition, and at least so many
BUCKETS_PER_PARTITION = 4
LEAST_BUCKETS = 64


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(v double, c long): the distinct values of ``col`` and how often each occurs; NULL has a row too."""
    return df.select(F.col(col).cast("double").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))


def written_counts(df: DataFrame, col: str, token: str | None = None) -> DataFrame:
    """``value_counts`` written once under the shared checkpoint folder. ``token`` must say what ``df`` holds."""
    from subscope.sources.store import written
    return written(value_counts(df, col), f"value-counts-{col}", token)


def exact_quantiles(df: DataFrame, col: str, probs: list[float], names: list[str],
                    buckets: int | None = None, accuracy: int = 100000) -> DataFrame:
    """One row: column ``names[i]`` is the ``probs[i]`` quantile of ``col`` (NULLs ignored)."""
    return quantiles_of_counts(written_counts(df, col), probs, names, buckets, accuracy)


def quantiles_of_counts(counts: DataFrame, probs: list[float], names: list[str],
                        buckets: int | None = None, accuracy: int = 100000) -> DataFrame:
    """``exact_quantiles`` of the column that ``counts`` (v, c) stands for; a NULL value is ignored."""
    counts = counts.where(F.col("v").isNotNull())
    if buckets is None:
        partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(LEAST_BUCKETS, BUCKETS_PER_PARTITION * partitions)
    splits = [i / buckets for i in range(1, buckets)]
    bounds = counts.agg(F.percentile_approx("v", splits, accuracy).alias("bounds"))
    tagged = (counts.withColumn("bounds", bounds.scalar())
              .withColumn("bucket", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds"))

    # B rows: where each bucket starts, and the wanted ranks (0-based: floor and ceil of h = (n-1)p) it holds
    whole = Window.orderBy("bucket")
    h = [(F.col("n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    wanted = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(side).alias("side"), end(at).cast("long").alias("rank"), at.alias("h"))
                       for i, at in enumerate(h) for side, end in enumerate((F.floor, F.ceil))])
    starts = tagged.groupBy("bucket").agg(F.sum("c").alias("bc")).select(
        "bucket", "bc", F.sum("bc").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
        F.coalesce(F.sum("bc").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    held = F.filter(wanted, lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("bc")))
    located = starts.select("bucket", "before", held.alias("wanted")).where(F.size("wanted") > 0)

    in_bucket = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = tagged.join(F.broadcast(located), "bucket").withColumn("upto", F.col("before") + F.sum("c").over(in_bucket))
    hit = F.filter("wanted", lambda w: (w["rank"] >= F.col("upto") - F.col("c")) & (w["rank"] < F.col("upto")))
    hit = ordered.select("v", F.explode(hit).alias("w")).select("v", "w.*")

    picked = hit.groupBy().agg(*[
        F.max(F.when((F.col("qi") == i) & (F.col("side") == s), F.col("v"))).alias(f"_v{i}_{s}")
        for i in range(len(probs)) for s in (0, 1)
    ], *[F.max(F.when(F.col("qi") == i, F.col("h"))).alias(f"_h{i}") for i in range(len(probs))])

    out = []
    for i, name in enumerate(names):
        a, b, at = F.col(f"_v{i}_0"), F.col(f"_v{i}_1"), F.col(f"_h{i}")
        t = at - F.floor(at)
        out.append(F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t))
                   .otherwise(a + (b - a) * t).alias(name))
    return picked.select(*out)
