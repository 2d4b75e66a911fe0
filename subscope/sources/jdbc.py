"""JDBC source and sink for the six tables (the reference's database path).

Reads are split into ``num_partitions`` range predicates on a numeric column
(``user_id`` by default) so that the database is read by parallel tasks, not
one connection. The driver jar for the target database must be on the Spark
classpath; only Derby (embedded, in-memory) ships with PySpark, and the tests
use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subscope import schema as S
from subscope.sources.binding import Tables
from subscope.sources.files import TABLE_ORDER


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str = "user_id",
              lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
              properties: dict | None = None) -> DataFrame:
    """``table`` in ``num_partitions`` ranges of ``partition_column``; bounds that are not given are
    the column's MIN and MAX, which the database answers."""
    props = dict(properties or {})
    if lower is None or upper is None:
        ends = spark.read.jdbc(url, f"(SELECT MIN({partition_column}) lo, MAX({partition_column}) hi FROM {table}) ends",
                               properties=props).first()
        lower = ends[0] if lower is None else lower
        upper = ends[1] if upper is None else upper
        if lower is None or upper is None:  # no row, or none with a value
            return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=props)


def read_tables_jdbc(spark: SparkSession, url: str, user_id_range: tuple[int, int],
                     num_partitions: int = 8, properties: dict | None = None,
                     table_names: dict | None = None) -> Tables:
    names = table_names or {n: n for n in TABLE_ORDER}
    lo, hi = user_id_range
    out = []
    for n in TABLE_ORDER:
        df = read_jdbc(spark, url, names[n], "user_id", lo, hi, num_partitions, properties)
        # database column names may be upper-cased; select in model order and case
        lower = {c.lower(): c for c in df.columns}
        df = df.select(*[df[lower[f.name.lower()]].cast(f.dataType).alias(f.name) for f in S.SCHEMAS[n].fields])
        out.append(df)
    return Tables(*out)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite",
               properties: dict | None = None, batch_size: int = 15000) -> None:
    props = {"batchsize": str(batch_size), **(properties or {})}
    df.write.jdbc(url, table, mode=mode, properties=props)


def write_tables_jdbc(tables: Tables, url: str, properties: dict | None = None,
                      table_names: dict | None = None) -> None:
    names = table_names or {n: n for n in TABLE_ORDER}
    for n, df in tables.as_dict().items():
        write_jdbc(df, url, names[n], "overwrite", properties)
