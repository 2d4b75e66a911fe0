"""The six bound tables, each written once to the shared checkpoint folder when first used.

Binding derives the model from the driver tables (a lineitem x orders join and per-user
aggregates). A table is written as Parquet under ``spark.checkpoint.dir`` the first time a
query asks for it, and only then; ``users`` and ``subscriptions`` are derived from the
written sessions. Every later query scans files with pushed filters and pruned columns, and
the lineage ends there: a lost executor re-reads the files.

The store's key covers every input file (path, size, modification time, at any depth), the
period and the binding code, so a changed input or binding never reads a stale store. A
writer fills a folder of its own and marks it published as its last step; readers take only
marked folders. Two writers leave two whole folders, of which any reader takes one.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from subscope.params import DEFAULT_PERIOD, Period
from subscope.schema import SCHEMAS
from subscope.session import checkpoint_dir
from subscope.sources import binding
from subscope.sources.binding import Tables, bind, bind_sessions, read_driver

DRIVER_TABLES = ["customer", "nation", "orders", "lineitem", "events"]
STORE_LAYOUT = 3  # bump when the written layout changes: older stores are not reused
DATE_ORDER = {"user_sessions": "session_date", "transactions": "transaction_date",
              "support_tickets": "ticket_date", "feature_events": "event_time"}
FROM_SESSIONS = ("users", "subscriptions")
#: rows that one task sorts or groups by a key of their own, and the most tasks to which they are dealt: up to
#: 200, Spark's shuffle writes each row to its task's file at once and holds none
TASK_ROWS, TASKS = 500_000, 200
#: sessions that ask for more tasks are dealt before their join; Spark may raise the number to its own for joins,
#: which would cut a small table into many files
DEALT = 16
_PUBLISHED = "_PUBLISHED"
_MEMO: dict = {}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def _fingerprint(spark: SparkSession, sf_dir: str, period: Period) -> str:
    h = hashlib.sha1()
    h.update(inspect.getsource(binding).encode())
    h.update(f"layout={STORE_LAYOUT}".encode())
    h.update(repr(period).encode())
    for name in DRIVER_TABLES:
        path = f"{sf_dir}/{name}.parquet"
        p, fs = _fs(spark, path)
        h.update(path.encode())
        found = []
        if fs.exists(p):
            files = fs.listFiles(p, True)
            while files.hasNext():
                st = files.next()
                found.append(f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}")
        h.update("\n".join(sorted(found)).encode())
    return h.hexdigest()[:20]


def store_path(spark: SparkSession, sf_dir: str, period: Period = DEFAULT_PERIOD) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/subscope-store/{_fingerprint(spark, sf_dir, period)}"


def published(spark: SparkSession, root: str, name: str) -> str | None:
    """The first published folder of ``name`` under ``root``."""
    p, fs = _fs(spark, f"{root}/{name}")
    if not fs.exists(p):
        return None
    folders = sorted(str(st.getPath()) for st in fs.listStatus(p) if st.isDirectory())
    return next((f for f in folders if _exists(spark, f"{f}/{_PUBLISHED}")), None)


def publish(df: DataFrame, root: str, name: str) -> str:
    """Write ``df`` to a new folder of ``name`` and mark it published."""
    folder = f"{root}/{name}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(folder)
    p, fs = _fs(df.sparkSession, f"{folder}/{_PUBLISHED}")
    fs.create(p).close()
    return folder


def tasks_for(df: DataFrame) -> int:
    """Tasks that ``df`` needs for TASK_ROWS rows each. Scans are cut by bytes: well compressed, 128 MB hold
    many millions of rows, and what a task sorts or groups would grow with the input."""
    return max(1, min(TASKS, -(-df.count() // TASK_ROWS)))


class StoredTables(Tables):
    """The six tables; each is written, unless it is published, when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, period: Period, root: str):
        self.spark, self.sf_dir, self.period, self.root = spark, sf_dir, period, root
        #: identifies the content: results kept for these tables may be kept under it
        self.token = root

    def _table(self, name: str) -> DataFrame:
        folder = published(self.spark, self.root, name)
        if folder is None:
            sessions = self.user_sessions if name in FROM_SESSIONS else None
            if name == "user_sessions":
                parts = tasks_for(read_driver(self.spark, self.sf_dir, "lineitem"))
                sessions = bind_sessions(self.spark, self.sf_dir, parts if parts > DEALT else None)
            df = getattr(bind(self.spark, self.sf_dir, self.period, sessions), name)
            if name in DATE_ORDER:
                if name != "user_sessions":  # those are dealt for their join
                    df = df.repartition(tasks_for(df), *df.columns)
                # date-ordered row groups: Parquet statistics then skip most of a fact table for a
                # one-month filter. Sorting inside each task needs no shuffle, so a day holding a
                # third of the rows does not become one task.
                df = df.sortWithinPartitions(DATE_ORDER[name])
            folder = publish(df, self.root, name)
        # the known schema: inferring it would run a job for every table
        return self.spark.read.schema(SCHEMAS[name]).parquet(folder)

    users = cached_property(lambda self: self._table("users"))
    subscriptions = cached_property(lambda self: self._table("subscriptions"))
    user_sessions = cached_property(lambda self: self._table("user_sessions"))
    transactions = cached_property(lambda self: self._table("transactions"))
    support_tickets = cached_property(lambda self: self._table("support_tickets"))
    feature_events = cached_property(lambda self: self._table("feature_events"))


def bound_tables(spark: SparkSession, sf_dir: str, period: Period = DEFAULT_PERIOD) -> Tables:
    """The six model tables of the store; kept per application for as long as its inputs and its
    folder are the same."""
    root = store_path(spark, sf_dir, period)
    key = (spark.sparkContext.applicationId, root)
    if key not in _MEMO or not _exists(spark, root):
        _MEMO[key] = StoredTables(spark, sf_dir, period, root)
    return _MEMO[key]


def materialize(spark: SparkSession, sf_dir: str, period: Period = DEFAULT_PERIOD) -> str:
    """Write all six tables that are not published yet; the store's folder."""
    tables = bound_tables(spark, sf_dir, period)
    for df in tables.as_dict().values():
        df.schema  # noqa: B018 - asking for a table writes it
    return tables.root


def written(df: DataFrame, tag: str, token: str | None = None) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder, read back: later jobs scan
    the files, and the lineage ends there. With ``token``, which must identify the content, a
    folder published before is used again."""
    spark = df.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/subscope-tmp"
    name = tag if token is None else f"{tag}-{hashlib.sha1(token.encode()).hexdigest()[:20]}"
    folder = published(spark, root, name) if token is not None else None
    return spark.read.schema(df.schema).parquet(folder or publish(df, root, name))


def purge_intermediates(spark: SparkSession) -> bool:
    """Delete the intermediates ``written`` left under the checkpoint folder (not the
    bound-table store). Call between runs, when no DataFrame from them is still in use."""
    from subscope.plans import churn
    churn._FITTED.clear()  # fitted models keep frames that read these files
    path = f"{checkpoint_dir(spark).rstrip('/')}/subscope-tmp"
    p, fs = _fs(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))
