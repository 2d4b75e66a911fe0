"""Query catalog runner: every named query on its own job group, several at a time.

Each query runs in a thread of its own with a FAIR pool and a job group of its name (pools share the
executors where the session schedules FAIR; elsewhere they are only names). A query that takes longer
than its limit has its job group cancelled. Each outcome is written when it is known, so a run that was
broken off goes on with the queries that have no good outcome yet.
"""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from subscope.params import DEFAULT_PERIOD, Period
from subscope.session import checkpoint_dir
from subscope.sources.binding import Tables

REPORT = "query_no int, name string, status string, row_count long, error string"


def _outcome(spark: SparkSession, frame, out_dir: str, name: str, limit: float | None) -> tuple[str, int | None, str | None]:
    """(status, rows written, error) of one query; its jobs carry the group that the limit cancels."""
    group, over = f"catalog-{name}-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def cancel() -> None:
        over.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(limit, cancel) if limit else None
    sc.setLocalProperty("spark.scheduler.pool", name)
    sc.setJobGroup(group, name, interruptOnCancel=True)
    if timer:
        timer.start()
    try:
        frame(name).write.mode("overwrite").parquet(f"{out_dir}/{name}")
        rows = spark.read.parquet(f"{out_dir}/{name}").count()
        return ("ok", rows, None) if not over.is_set() else ("timeout", None, f"over {limit} s")
    except Exception as e:  # noqa: BLE001 - recorded per query
        if over.is_set():
            return "timeout", None, f"over {limit} s"
        return "error", None, f"{type(e).__name__}: {str(e)[:500]}"
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.scheduler.pool", None)
        sc.setLocalProperty("spark.jobGroup.id", None)


def run_frames(spark: SparkSession, frame, names: list[str], out_dir: str, parallel: int = 4,
               limit: float | None = None, resume: bool = False) -> DataFrame:
    """Report of the queries ``frame(name)``: query_no, name, status (ok, error, timeout), row_count, error.

    Each result is written to ``out_dir``/name as Parquet and its rows are counted from the files. With
    ``resume``, queries that an earlier run into ``out_dir`` ended well are not run again.
    """
    report = f"{out_dir}/_report"
    done: dict[str, tuple] = {}
    if resume:
        try:
            done = {r["name"]: tuple(r)[2:] for r in spark.read.schema(REPORT).parquet(f"{report}/*").where("status = 'ok'").collect()}
        except Exception as e:  # noqa: BLE001 - no report yet
            if "PATH_NOT_FOUND" not in str(e):
                raise

    def one(number: int, name: str) -> tuple:
        found = done.get(name) or _outcome(spark, frame, out_dir, name, limit)
        row = (number, name, *found)
        if name not in done:
            spark.createDataFrame([row], REPORT).coalesce(1).write.mode("overwrite").parquet(f"{report}/{name}")
        return row

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        # each call gets local properties of its own
        waiting = [pool.submit(inheritable_thread_target(spark)(one), i, name) for i, name in enumerate(names, start=1)]
        rows = [w.result() for w in waiting]
    return spark.createDataFrame(rows, REPORT)


def run_catalog(spark: SparkSession, sf_dir: str, out_dir: str, names: list[str] | None = None,
                period: Period = DEFAULT_PERIOD, parallel: int = 4, limit: float | None = None, resume: bool = False) -> DataFrame:
    """``run_frames`` over registered queries, all of them unless named."""
    from subscope.plans import registry
    frame = lambda name: registry.run(name, spark, sf_dir, period)
    return run_frames(spark, frame, names or list(registry.PLANS), out_dir, parallel, limit, resume)


#: one of them is not registered: its failure must be on record and stop nothing
FIXED_LIST = ["funnel_distribution", "monthly_active_users", "no_such_query", "ticket_segment_churn", "top3_sessions_by_channel"]


def catalog_report(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The runner over a fixed list with one query that fails: name, status and rows written."""
    from subscope.plans import registry
    spark = t.users.sparkSession
    out = f"{checkpoint_dir(spark).rstrip('/')}/subscope-catalog/{uuid.uuid4().hex}"
    for name in ("users", "subscriptions", "user_sessions", "support_tickets"):
        getattr(t, name)  # written once, before the queries that share them start together
    report = run_frames(spark, lambda name: registry.PLANS[name](t, p), FIXED_LIST, out)
    return report.select("name", "status", "row_count")


PLANS = {"catalog_report": catalog_report}
