"""Sources and sinks: CSV/Parquet round trips, fallback loading, JDBC (in-memory Derby),
metric and coefficient files, and the query-catalog runner."""

import tempfile

import pytest

from pyspark.sql import functions as F

from subscope import schema as S
from subscope.plans import registry
from subscope.plans.catalog import run_catalog
from subscope.sources import files, jdbc

from conftest import SF_SMALL


def _rows(df, cols=None):
    cols = cols or df.columns
    return sorted(tuple(str(x) for x in r) for r in df.select(*cols).collect())


def _tmp():
    return tempfile.mkdtemp(prefix="subscope-test-", dir="/tmp")


def test_csv_round_trip_drops_keys(spark, fixture_tables):
    d = _tmp()
    files.write_tables_csv(fixture_tables, d)
    back = files.read_tables_csv(spark, d)
    for name, df in fixture_tables.as_dict().items():
        got = back.as_dict()[name]
        assert got.schema == S.SCHEMAS[name] or got.columns == S.SCHEMAS[name].fieldNames()
        keep = [c for c in df.columns if c != S.CSV_DROPPED_KEYS.get(name)]
        assert _rows(got, keep) == _rows(df, keep), name
        key = S.PRIMARY_KEYS[name]
        assert got.select(key).distinct().count() == got.count()  # regenerated keys are unique


def test_parquet_round_trip(spark, fixture_tables):
    d = _tmp()
    files.write_tables_parquet(fixture_tables, d)
    back = files.read_tables_parquet(spark, d)
    for name, df in fixture_tables.as_dict().items():
        assert _rows(back.as_dict()[name]) == _rows(df)


def test_fallback_loader(spark, fixture_tables):
    d = _tmp()
    files.write_tables_csv(fixture_tables, d)
    t, label, reasons = files.load_tables([
        ("Parquet store", lambda: files.read_tables_parquet(spark, "/tmp/subscope-does-not-exist")),
        ("CSV Backup", lambda: files.read_tables_csv(spark, d)),
    ])
    assert list(reasons) == ["Parquet store"] and "subscope-does-not-exist" in reasons["Parquet store"]
    assert label == "CSV Backup" and t.users.count() == fixture_tables.users.count()
    t, label, reasons = files.load_tables([("nothing", lambda: files.read_tables_csv(spark, "/tmp/subscope-nope"))])
    assert t is None and label is False and list(reasons) == ["nothing"]


def test_metric_tables_round_trip(spark):
    d = _tmp()
    kpis = registry.run("kpi_summary", spark, SF_SMALL)
    ab = registry.run("ab_metrics", spark, SF_SMALL)
    coh = registry.run("cohort_retention_matrix", spark, SF_SMALL)
    mm = registry.run("monthly_mrr", spark, SF_SMALL)
    files.write_metric_tables(d, kpis, ab, coh, mm)
    assert _rows(files.read_metric_csv(spark, f"{d}/kpis", files.KPI_SCHEMA)) == _rows(kpis)
    assert _rows(files.read_metric_csv(spark, f"{d}/ab_test_metrics", files.AB_SCHEMA)) == _rows(ab)
    assert _rows(files.read_metric_csv(spark, f"{d}/monthly_metrics", files.MONTHLY_SCHEMA)) == _rows(mm)
    back = files.read_metric_csv(spark, f"{d}/cohort_retention")
    assert back.columns[0] == "signup_cohort" and back.count() == coh.count()


def test_jdbc_round_trip_derby(spark, fixture_tables):
    url = "jdbc:derby:memory:subscope_test;create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    names = {n: f"T_{n.upper()}" for n in fixture_tables.as_dict()}
    jdbc.write_tables_jdbc(fixture_tables, url, props, names)
    back = jdbc.read_tables_jdbc(spark, url, (0, 10), num_partitions=3, properties=props, table_names=names)
    assert back.user_sessions.rdd.getNumPartitions() == 3
    for name, df in fixture_tables.as_dict().items():
        assert _rows(back.as_dict()[name]) == _rows(df), name


def test_catalog_runner_records_errors_and_goes_on(spark):
    d = _tmp()
    from subscope.plans import queries
    registry.PLANS["broken_for_test"] = lambda t, p=None: t.users.select(F.col("no_such_column"))
    try:
        rep = run_catalog(spark, SF_SMALL, d, ["funnel_distribution", "broken_for_test", "monthly_revenue"])
        rows = {r["name"]: r for r in rep.collect()}
    finally:
        del registry.PLANS["broken_for_test"]
    assert rows["funnel_distribution"]["status"] == "ok" and rows["funnel_distribution"]["row_count"] == 6
    assert rows["broken_for_test"]["status"] == "error" and rows["broken_for_test"]["error"]
    assert rows["monthly_revenue"]["status"] == "ok"
    assert queries  # registry still intact


def test_written_intermediates_and_purge(spark):
    from subscope.sources.store import purge_intermediates, written
    w = written(spark.range(5).toDF("x"), "purge-test")
    assert sorted(r.x for r in w.collect()) == [0, 1, 2, 3, 4]
    assert purge_intermediates(spark) is True
    assert purge_intermediates(spark) is False


def test_catalog_runs_every_registered_query(spark):
    """S11 over the whole catalog: every registered query runs, writes and reads back."""
    d = _tmp()
    rep = run_catalog(spark, SF_SMALL, d)
    rows = rep.collect()
    assert len(rows) == len(registry.PLANS)
    failed = [(r["name"], r["error"]) for r in rows if r["status"] != "ok"]
    assert not failed, failed
    assert all(r["row_count"] is not None for r in rows)  # some are legitimately empty at sf0.001


def _copy_tables(src, names):
    import shutil
    d = tempfile.mkdtemp(prefix="subscope-in-", dir="/tmp")
    for n in names:
        shutil.copyfile(f"{src}/{n}.parquet", f"{d}/{n}.parquet")
    return d


def test_store_follows_its_inputs_and_writes_only_what_is_asked(spark):
    from subscope.sources import store
    d = _copy_tables(SF_SMALL, store.DRIVER_TABLES)
    t = store.bound_tables(spark, d)
    n = t.users.count()
    assert store.published(spark, t.root, "users") and store.published(spark, t.root, "user_sessions")
    assert all(store.published(spark, t.root, x) is None for x in ("transactions", "support_tickets", "feature_events"))
    assert store.bound_tables(spark, d) is t
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").limit(50).toPandas().to_parquet(f"{d}/customer.parquet")
    assert store.bound_tables(spark, d).users.count() == 50 < n


def test_store_takes_one_of_two_writers_and_no_half_written_folder(spark):
    from subscope.sources import store
    root = tempfile.mkdtemp(prefix="subscope-pub-", dir="/tmp")
    df = spark.range(7)
    df.write.parquet(f"{root}/x/0-not-marked")
    assert store.published(spark, root, "x") is None
    store.publish(df, root, "x")
    store.publish(df, root, "x")
    assert spark.read.parquet(store.published(spark, root, "x")).count() == 7


def test_store_sees_files_of_nested_folders(spark):
    from subscope.sources import store
    d = _copy_tables(SF_SMALL, [n for n in store.DRIVER_TABLES if n != "events"])
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.write.partitionBy("event_type").parquet(f"{d}/events.parquet")
    first = store.store_path(spark, d)
    events.limit(3).write.mode("append").partitionBy("event_type").parquet(f"{d}/events.parquet")
    assert store.store_path(spark, d) != first


def test_written_again_by_content(spark):
    from subscope.sources.store import purge_intermediates, written
    a, b = written(spark.range(3), "again", "content 1"), written(spark.range(4), "again", "content 1")
    assert a.count() == b.count() == 3 and written(spark.range(4), "again", "content 2").count() == 4
    assert purge_intermediates(spark)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    import types

    from subscope import session
    context = types.SimpleNamespace(applicationId="none", master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    fake = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake)
