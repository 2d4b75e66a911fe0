"""CSV and Parquet sources and sinks for the six tables and the metric outputs.

Schemas are always given (never inferred). The CSV export mirrors the
reference's: no surrogate keys except ``users.user_id``; on read, a missing key
is regenerated with ``monotonically_increasing_id`` (unique, deterministic for
a given file layout) so that key-counting queries still run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subscope import schema as S
from subscope.sources.binding import Tables

TABLE_ORDER = ["users", "subscriptions", "user_sessions", "transactions", "support_tickets",
               "feature_events"]


def _keyless(schema: T.StructType, key: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != key])


def write_tables_csv(tables: Tables, path: str, drop_keys: bool = True) -> None:
    """CSV export, one folder per table, with a header row."""
    for name, df in tables.as_dict().items():
        if drop_keys and name in S.CSV_DROPPED_KEYS:
            df = df.drop(S.CSV_DROPPED_KEYS[name])
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def read_tables_csv(spark: SparkSession, path: str) -> Tables:
    """CSV source with typed dates/timestamps; missing surrogate keys are regenerated."""
    out = {}
    for name in TABLE_ORDER:
        schema = S.SCHEMAS[name]
        key = S.PRIMARY_KEYS[name]
        r = (spark.read.option("header", True).option("mode", "FAILFAST")
             .option("dateFormat", "yyyy-MM-dd").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"))
        header = spark.read.option("header", True).csv(f"{path}/{name}").columns
        if key in header:
            df = r.schema(schema).csv(f"{path}/{name}")
        else:
            df = r.schema(_keyless(schema, key)).csv(f"{path}/{name}")
            df = df.withColumn(key, F.monotonically_increasing_id()).select(*schema.fieldNames())
        out[name] = df
    return Tables(*(out[n] for n in TABLE_ORDER))


def write_tables_parquet(tables: Tables, path: str) -> None:
    """Bulk load, overwriting: one Parquet folder per table (task-parallel writers)."""
    for name, df in tables.as_dict().items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables_parquet(spark: SparkSession, path: str) -> Tables:
    return Tables(*(spark.read.schema(S.SCHEMAS[n]).parquet(f"{path}/{n}") for n in TABLE_ORDER))


# ---------------------------------------------------------------- facts by month

#: the date that a fact belongs to
FACT_DATES = {"user_sessions": "session_date", "transactions": "transaction_date",
              "support_tickets": "ticket_date", "feature_events": "event_time"}
MONTH = "month"


def _by_month(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its month, dealt so that a task writes few months and a large month has several tasks."""
    months = df.withColumn(MONTH, F.date_format(FACT_DATES[name], "yyyy-MM"))
    return months.hint("rebalance", MONTH).sortWithinPartitions(MONTH, FACT_DATES[name])


def load_facts_by_month(t: Tables, path: str, months: list[str] | None = None) -> None:
    """The four fact tables under ``path``, one folder a month. With ``months``, only theirs are loaded.

    Overwriting is dynamic: a month that is loaded replaces that month, and all others stay."""
    for name in FACT_DATES:
        df = _by_month(getattr(t, name), name)
        df = df if months is None else df.where(F.col(MONTH).isin(months))
        df.write.partitionBy(MONTH).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")


def append_facts(df: DataFrame, path: str, name: str) -> None:
    """Rows added to fact table ``name``, each to its month."""
    _by_month(df, name).write.partitionBy(MONTH).mode("append").parquet(f"{path}/{name}")


def read_facts_by_month(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Fact table ``name`` with its month; a condition on the month is a choice of folders."""
    schema = T.StructType([*S.SCHEMAS[name].fields, T.StructField(MONTH, T.StringType())])
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def load_tables(sources: list[tuple[str, Callable[[], Tables]]]) -> tuple[Tables | None, str | bool, dict[str, str]]:
    """First source that resolves wins: (tables, its label, reasons), or (None, False, reasons).

    A source resolves when its six tables can be planned (paths exist, schemas apply); nothing
    is read beyond file listing. ``reasons`` tells for each source before it what was wrong.
    """
    reasons: dict[str, str] = {}
    for label, make in sources:
        try:
            t = make()
            for df in t.as_dict().values():
                df.schema  # noqa: B018 - forces analysis
            return t, label, reasons
        except Exception as e:  # noqa: BLE001 - a failing source falls through to the next, on record
            reasons[label] = f"{type(e).__name__}: {str(e)[:500]}"
    return None, False, reasons


# ---------------------------------------------------------------- metric outputs

KPI_SCHEMA = T.StructType([T.StructField("KPI", T.StringType()), T.StructField("Value", T.DoubleType())])
AB_SCHEMA = T.StructType([T.StructField("Group", T.StringType()), T.StructField("Users", T.LongType()),
                          T.StructField("Conversion_Rate", T.DoubleType()),
                          T.StructField("Revenue_Per_User", T.DoubleType()),
                          T.StructField("Avg_Session_Duration_Mins", T.DoubleType()),
                          T.StructField("Retention_Rate", T.DoubleType())])
MONTHLY_SCHEMA = T.StructType([T.StructField("month", T.StringType()), T.StructField("amount", T.DoubleType())])
COEF_SCHEMA = T.StructType([T.StructField("Feature", T.StringType()), T.StructField("Coefficient", T.DoubleType()),
                            T.StructField("Absolute_Coefficient", T.DoubleType())])


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV sink with a header. ``single_file`` is for small, bounded results only."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_metric_table(path: str, name: str, frame: DataFrame) -> None:
    """One metric output, a small aggregate, as one CSV file under ``path``/``name``. The cohort matrix has
    its periods in numeric order."""
    if "signup_cohort" in frame.columns:
        periods = sorted((c for c in frame.columns if c != "signup_cohort"), key=int)
        frame = frame.select("signup_cohort", *periods).orderBy("signup_cohort")
    write_csv(frame, f"{path}/{name}", True)


def write_metric_tables(path: str, kpis: DataFrame, ab: DataFrame, cohort_matrix: DataFrame,
                        monthly: DataFrame) -> None:
    """The four metric outputs."""
    for name, frame in (("kpis", kpis), ("ab_test_metrics", ab), ("cohort_retention", cohort_matrix), ("monthly_metrics", monthly)):
        write_metric_table(path, name, frame)


def read_metric_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Saved metric table. The cohort matrix has data-dependent period columns: its
    schema is the header, with every period column DOUBLE."""
    r = spark.read.option("header", True)
    if schema is not None:
        return r.schema(schema).csv(path)
    cols = r.csv(path).columns
    fields = [T.StructField(c, T.StringType() if i == 0 else T.DoubleType()) for i, c in enumerate(cols)]
    return r.schema(T.StructType(fields)).csv(path)
