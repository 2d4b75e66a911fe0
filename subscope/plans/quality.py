"""Data-quality audit and cleaning: missing values, duplicate rows, IQR outliers,
p99 caps, median imputation, key/foreign-key constraints, row counts.

Each audit reads each table once with one aggregate (conditional counts for
every column at once) and unions the small per-table results. Quantiles come
from ``operators.quantiles``: after the duplicates are dropped, a column becomes
one (value, count) frame, and both its quantiles and the rows beyond a fence or
cap are read from that frame. As in the reference, duplicates are dropped before
quantiles are taken, and fences are computed before caps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope import schema as S
from subscope.functions import count_when, pct
from subscope.operators.dedup import duplicate_count
from subscope.operators.quantiles import quantiles_of_counts, written_counts
from subscope.operators.reshape import one_row, scalar, unpivot
from subscope.params import DEFAULT_PERIOD, Period
from subscope.sources.binding import Tables

C = F.col

# (table, column) pairs the reference audits for outliers and caps
OUTLIER_COLUMNS = [("user_sessions", "session_duration_minutes"),
                   ("feature_events", "time_spent_seconds"),
                   ("support_tickets", "resolution_time_hours")]
CAP_COLUMNS = [("user_sessions", "session_duration_minutes"),
               ("feature_events", "time_spent_seconds")]
ROUND_DIGITS = 6


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def deduplicated(t: Tables) -> Tables:
    """Every table with identical rows dropped (one shuffle per table)."""
    return Tables(**{k: v.dropDuplicates() for k, v in t.as_dict().items()})


def missing_values_audit(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    out = []
    for name, df in t.as_dict().items():
        cols = df.columns
        wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                      *[count_when(C(c).isNull()).alias(c) for c in cols])
        long = unpivot(wide, ["_rows"], cols, "column_name", "missing_count")
        out.append(long.where(C("missing_count") > 0).select(
            F.lit(name).alias("table_name"), "column_name", "missing_count",
            pct(C("missing_count"), C("_rows")).alias("missing_pct")))
    return _union(out)


def duplicate_rows_audit(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return _union([duplicate_count(df).select(F.lit(name).alias("table_name"), "duplicate_rows")
                   for name, df in t.as_dict().items()])


def drop_duplicates(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Row counts before and after dropping identical rows, per table."""
    out = []
    for name, df in t.as_dict().items():
        g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
        out.append(g.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows_before"),
                         F.count(F.lit(1)).alias("rows_after"))
                   .select(F.lit(name).alias("table_name"), "rows_before", "rows_after"))
    return _union(out)


def iqr_outliers(t: Tables, p: Period = DEFAULT_PERIOD, dedup: bool = True) -> DataFrame:
    """Upper-side IQR fence (Q3 + 1.5 IQR) and the rows above it, per audited column."""
    out = []
    for table, col in OUTLIER_COLUMNS:
        df = getattr(t, table)
        df = df.dropDuplicates() if dedup else df
        counts = _counts(t, df, table, col, dedup)
        q = quantiles_of_counts(counts, [0.25, 0.75], ["q1", "q3"])
        q = q.select("q1", "q3", (C("q3") - C("q1")).alias("iqr"))
        q = q.withColumn("upper_fence", C("q3") + F.lit(S.IQR_FENCE) * C("iqr"))
        beyond = counts.agg(_rows_above(scalar(q, "upper_fence")).alias("outlier_count"))
        rows = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("_rows"))  # rows without a value count too
        r = one_row(q, beyond, rows)
        out.append(r.select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
                            *[F.round(C(c), ROUND_DIGITS).alias(c) for c in ("q1", "q3", "iqr", "upper_fence")],
                            "outlier_count", pct(C("outlier_count"), C("_rows")).alias("outlier_pct")))
    return _union(out)


def _counts(t: Tables, df: DataFrame, table: str, col: str, dedup: bool = True) -> DataFrame:
    """The column's values and counts, written once; queries over the same tables share the files."""
    token = getattr(t, "token", None)
    return written_counts(df, col, None if token is None else f"{token} {table} {col} {dedup}")


def _rows_above(bound) -> F.Column:
    """Rows of a (v, c) frame with a value above ``bound``."""
    return F.coalesce(F.sum(F.when(C("v") > bound, C("c"))), F.lit(0))


def cap_at_p99(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The p99 cap per column and how many rows it changes."""
    out = []
    for table, col in CAP_COLUMNS:
        counts = _counts(t, getattr(t, table).dropDuplicates(), table, col)
        cap = quantiles_of_counts(counts, [S.CAP_QUANTILE], ["cap"])
        n = counts.agg(_rows_above(scalar(cap, "cap")).alias("rows_capped"))
        out.append(one_row(cap, n).select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
                                           F.round("cap", ROUND_DIGITS).alias("cap_value"), "rows_capped"))
    return _union(out)


def impute_median(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The CSAT fill value (median truncated to an integer) and how many NULLs it fills."""
    counts = _counts(t, t.support_tickets.dropDuplicates(), "support_tickets", "satisfaction_score")
    med = quantiles_of_counts(counts, [0.5], ["m"])
    n = counts.agg(F.coalesce(F.sum(F.when(C("v").isNull(), C("c"))), F.lit(0)).alias("imputed_count"))
    return one_row(med, n).select(C("m").cast("long").alias("median_csat"), "imputed_count")


def _capped(t: Tables, table: str, col: str) -> DataFrame:
    """Without repeated rows, ``col`` capped at its p99 (DOUBLE: the cap may be fractional)."""
    df = getattr(t, table).dropDuplicates()
    cap = scalar(quantiles_of_counts(_counts(t, df, table, col), [S.CAP_QUANTILE], ["cap"]), "cap")
    v = C(col).cast("double")
    return df.withColumn(col, F.when(v > cap, cap).otherwise(v))


def clean_sessions(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The cleaned sessions: repeated rows dropped, minutes capped at p99."""
    return _capped(t, "user_sessions", "session_duration_minutes")


def clean_events(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The cleaned events: repeated rows dropped, seconds capped at p99."""
    return _capped(t, "feature_events", "time_spent_seconds")


def clean_tickets(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The cleaned tickets: repeated rows dropped, NULL CSAT filled with the truncated median."""
    tk = t.support_tickets.dropDuplicates()
    counts = _counts(t, tk, "support_tickets", "satisfaction_score")
    med = scalar(quantiles_of_counts(counts, [0.5], ["m"]), "m")
    return tk.withColumn("satisfaction_score", F.coalesce(C("satisfaction_score"), med.cast("int")))


def clean_tables(t: Tables) -> Tables:
    """All six tables after cleaning."""
    src = deduplicated(t)
    return Tables(src.users, src.subscriptions, clean_sessions(t), src.transactions, clean_tickets(t), clean_events(t))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """The table's keys, nearly as many as its rows, dealt to as many tasks as they ask for: grouping them where
    they are read would hold a scan's keys, and a few large tasks after it theirs."""
    from subscope.sources.store import tasks_for
    return df.select(key).repartition(tasks_for(df), key)


def constraint_audit(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """What the model's DDL would enforce, as counts of violating rows:
    repeated primary keys, NULLs in NOT NULL columns, user_ids missing from users."""
    users_ids = t.users.select("user_id").distinct()
    out = []
    for name, df in t.as_dict().items():
        pk = S.PRIMARY_KEYS[name]
        not_null = [f.name for f in S.SCHEMAS[name].fields if not f.nullable]
        dup = (_dealt(df, pk).groupBy(pk).agg(F.count(F.lit(1)).alias("_n"))
               .agg(F.coalesce(F.sum(C("_n") - 1), F.lit(0)).cast("long").alias("violations"))
               .select(F.lit(name).alias("table_name"), F.lit("duplicate_key").alias("check_name"),
                       "violations"))
        any_null = reduce(lambda a, b: a | b, [C(c).isNull() for c in not_null])
        nn = (df.agg(count_when(any_null).alias("violations"))
              .select(F.lit(name).alias("table_name"), F.lit("null_in_not_null").alias("check_name"),
                      "violations"))
        out += [dup, nn]
        if name != "users":
            # per-user counts first: a hot user_id is one row before the anti join
            per_user = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
            orphans = (per_user.join(users_ids, "user_id", "left_anti")
                       .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violations"))
                       .select(F.lit(name).alias("table_name"),
                               F.lit("orphan_user_id").alias("check_name"), "violations"))
            out.append(orphans)
    return _union(out)


def constraint_violations(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The rows behind ``constraint_audit``: table, check, key, user and how many rows have them.

    Missing users are found over distinct user_ids and written; the facts then meet that file, whose
    size the planner knows: it is broadcast while it is small, and the facts are not shuffled.
    """
    from subscope.sources.store import written
    users_ids = t.users.select("user_id").distinct()
    out = []

    def found(rows: DataFrame, name: str, check: str, key: str, user: str | None = "user_id") -> DataFrame:
        # grouped by the values themselves: the names and the key's text are for the violations only
        keys = [key] if user is None else list(dict.fromkeys([key, user]))
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1" if user is None else "true")
        return counts.select(F.lit(name).alias("table_name"), F.lit(check).alias("check_name"), C(key).cast("string").alias("row_key"),
                             (F.lit(None) if user is None else C(user)).cast("long").alias("user_id"), "row_count")

    for name, df in t.as_dict().items():
        key = S.PRIMARY_KEYS[name]
        not_null = [f.name for f in S.SCHEMAS[name].fields if not f.nullable]
        out.append(found(_dealt(df, key).where(C(key).isNotNull()), name, "duplicate_key", key, None))
        out.append(found(df.where(reduce(lambda a, b: a | b, [C(c).isNull() for c in not_null])), name, "null_in_not_null", key))
        if name != "users":
            missing = written(df.select("user_id").distinct().join(users_ids, "user_id", "left_anti"), f"missing-users-{name}")
            out.append(found(df.join(missing, df.user_id.eqNullSafe(missing.user_id), "left_semi"), name, "orphan_user_id", key))
    return _union(out)


def table_row_counts(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return _union([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"),
                                                                         "row_count")
                   for name, df in t.as_dict().items()])


PLANS = {
    "missing_values_audit": missing_values_audit,
    "duplicate_rows_audit": duplicate_rows_audit,
    "drop_duplicates": drop_duplicates,
    "iqr_outliers": iqr_outliers,
    "cap_at_p99": cap_at_p99,
    "impute_median": impute_median,
    "clean_sessions": clean_sessions,
    "clean_events": clean_events,
    "clean_tickets": clean_tickets,
    "constraint_audit": constraint_audit,
    "constraint_violations": constraint_violations,
    "table_row_counts": table_row_counts,
}
