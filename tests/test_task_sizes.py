"""Rows of one task: tables are dealt by their number of rows, not by the bytes of their files."""

import datetime as dt
import tempfile

from subscope.params import DEFAULT_PERIOD
from subscope.plans import quality
from subscope.sources import store
from subscope.sources.binding import Tables, bind

from conftest import FIXTURE_ROWS, ORDER, S


def _driver_tables(spark):
    """600 lines of 200 orders, a null key on either side and an order without lines, each table one file."""
    d = tempfile.mkdtemp(prefix="subscope-test-", dir="/tmp")
    day = dt.date(2001, 6, 1)
    lines = [(i // 3, 7 * i, i % 3, day + dt.timedelta(i % 29)) for i in range(600)] + [(None, 1, 1, day)]
    orders = [(i, i % 11, "F" if i % 2 else "O", float(i), day, "1-URGENT" if i % 3 else "5-LOW") for i in [*range(200), 999]]
    orders.append((None, 3, "F", 1.0, day, "5-LOW"))
    frames = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate date"),
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
        "events": spark.createDataFrame([(i, i % 11, "view", dt.datetime(2001, 6, 1), 2.0) for i in range(300)],
                                        "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"),
        "customer": spark.createDataFrame([(i, 1, 10.0, "BUILDING") for i in range(11)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": spark.createDataFrame([(1, "PERU")], "n_nationkey int, n_name string")}
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_stored_facts_are_dealt_by_rows(spark, monkeypatch):
    d = _driver_tables(spark)
    whole = bind(spark, d, DEFAULT_PERIOD)
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    monkeypatch.setattr(store, "DEALT", 2)
    tables = store.StoredTables(spark, d, DEFAULT_PERIOD, tempfile.mkdtemp(prefix="subscope-test-", dir="/tmp"))
    for name in ("user_sessions", "transactions", "feature_events"):
        got = getattr(tables, name)
        assert len(got.inputFiles()) > 1, name
        assert sorted(map(str, got.collect())) == sorted(map(str, getattr(whole, name).select(*got.columns).collect())), name


def test_repeated_keys_are_grouped_in_dealt_tasks(spark, monkeypatch):
    rows = {k: list(v) for k, v in FIXTURE_ROWS.items()}
    rows["user_sessions"] += [(9000 + i, 2, dt.date(2001, 6, 1), 5) for i in range(50)]
    t = Tables(*(spark.createDataFrame(rows[n], S.SCHEMAS[n]) for n in ORDER))
    monkeypatch.setattr(store, "TASK_ROWS", 10)
    for query in (quality.constraint_violations, quality.constraint_audit):
        plan = query(t)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line and "session_id" in line]
        assert dealt and all(", 7)" in line for line in dealt), plan  # 64 sessions
    found = {tuple(r) for r in quality.constraint_violations(t).collect()}
    assert found == {("user_sessions", "duplicate_key", "12", None, 2), ("subscriptions", "orphan_user_id", "108", 8, 1),
                     ("user_sessions", "orphan_user_id", "13", 9, 1), ("transactions", "orphan_user_id", "8", 9, 1)}
