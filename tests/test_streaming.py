"""Streaming DAU and inactivity alerts against their batch definitions."""

import datetime as dt
import tempfile

from subscope import schema as S
from subscope.streaming import daily_active_users_stream, inactivity_alerts_stream, session_stream
from subscope.streaming.activity import batch_inactivity

D = dt.date


def test_stream_dau_and_alerts(spark):
    d = tempfile.mkdtemp(prefix="subscope-stream-", dir="/tmp")
    src = f"{d}/src"

    def add(rows):
        spark.createDataFrame(rows, S.USER_SESSIONS).write.mode("append").parquet(src)

    add([(1, 1, D(2001, 6, 1), 10), (2, 1, D(2001, 6, 1), 12), (3, 2, D(2001, 6, 2), 5), (4, 3, D(2001, 6, 3), 7)])
    q1 = (daily_active_users_stream(session_stream(spark, src)).writeStream.format("memory")
          .queryName("t_dau").outputMode("append").option("checkpointLocation", f"{d}/ck1").start())
    q2 = (inactivity_alerts_stream(session_stream(spark, src), gap_days=10).writeStream.format("memory")
          .queryName("t_alerts").outputMode("append").option("checkpointLocation", f"{d}/ck2").start())
    try:
        for batch in [None, [(5, 2, D(2001, 6, 20), 9), (6, 4, D(2001, 6, 25), 9)], [(7, 4, D(2001, 6, 28), 9)]]:
            if batch:
                add(batch)
            q1.processAllAvailable()
            q2.processAllAvailable()
        dau = {r.session_date: r.dau for r in spark.sql("select * from t_dau").collect()}
        alerts = sorted((r.user_id, r.last_session.date()) for r in spark.sql("select * from t_alerts").collect())
        late = sorted(r.user_id for r in batch_inactivity(spark.read.schema(S.USER_SESSIONS).parquet(src), dt.datetime(2001, 6, 27), 10).collect())
    finally:
        q1.stop()
        q2.stop()
    # days closed by the watermark (max 6/28 - 2 days): exact distinct users per day
    assert dau == {D(2001, 6, 1): 1, D(2001, 6, 2): 1, D(2001, 6, 3): 1, D(2001, 6, 20): 1, D(2001, 6, 25): 1}
    # watermark 6/27: users 1 (last 6/1) and 3 (last 6/3) passed 10 idle days, and user 2 did before
    # coming back on 6/20; user 4 did not
    assert alerts == [(1, D(2001, 6, 1)), (2, D(2001, 6, 2)), (3, D(2001, 6, 3))]
    # those still idle are the batch definition's users
    assert [u for u, last in alerts if (u, last) != (2, D(2001, 6, 2))] == late == [1, 3]


def test_stream_dau_equals_batch_on_driver_sessions(spark):
    """Stream the bound sf0.001 sessions in file batches; every day the watermark has
    closed must equal the batch daily count of distinct users."""
    from pyspark.sql import functions as F

    from subscope.plans import registry
    from conftest import SF_SMALL

    sessions = registry.tables_for(spark, SF_SMALL).user_sessions
    d = tempfile.mkdtemp(prefix="subscope-stream-", dir="/tmp")
    # four files, in event-time order, as a feed would deliver them
    sessions.repartitionByRange(4, "session_date").write.parquet(f"{d}/src")
    q = (daily_active_users_stream(session_stream(spark, f"{d}/src", max_files_per_trigger=1))
         .writeStream.format("memory").queryName("t_dau_driver").outputMode("append")
         .option("checkpointLocation", f"{d}/ck").start())
    try:
        q.processAllAvailable()
        got = {r.session_date: r.dau for r in spark.sql("select * from t_dau_driver").collect()}
    finally:
        q.stop()
    want = {r.session_date: r.dau for r in sessions.groupBy("session_date")
            .agg(F.countDistinct("user_id").alias("dau")).collect()}
    assert got, "no day was closed by the watermark"
    assert max(got) < max(want)  # the newest days stay open
    assert all(got[k] == want[k] for k in got)
