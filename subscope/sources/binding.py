"""Bind the driver's TPC-H-like parquet tables to the six-table model.

Every column is a deterministic expression of driver columns, the same text as
the oracle's binding CTEs (``subscope.oracle.binding``). All of it is lazy: the
result is six DataFrames whose plans Catalyst prunes and pushes down into the
parquet scans. Every row of the driver tables is bound, whatever its date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope.params import DEFAULT_PERIOD, Period


@dataclass
class Tables:
    users: DataFrame
    subscriptions: DataFrame
    user_sessions: DataFrame
    transactions: DataFrame
    support_tickets: DataFrame
    feature_events: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "users": self.users,
            "subscriptions": self.subscriptions,
            "user_sessions": self.user_sessions,
            "transactions": self.transactions,
            "support_tickets": self.support_tickets,
            "feature_events": self.feature_events,
        }

    def register(self) -> "Tables":
        """Register the six tables as temp views for ``spark.sql``."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(name)
        return self


# Fixed values of the binding (FIXTURES.md section 3).
SEGMENT_TO_CHANNEL = [("AUTOMOBILE", "Organic Search"), ("BUILDING", "Google Ads"),
                      ("FURNITURE", "LinkedIn"), ("HOUSEHOLD", "Referral")]
OTHER_CHANNEL = "Email Campaign"
EVENT_TO_FEATURE = [("view", "Dashboard"), ("click", "Export"), ("purchase", "Reports"),
                    ("signup", "Settings")]
OTHER_FEATURE = "Search"
ORDER_STATUS_TO_TX = [("F", "Success"), ("O", "Failed")]
OTHER_TX_STATUS = "Refunded"
TICKET_CATEGORIES = ["Billing", "Technical", "Account", "FeatureRequest"]  # by orderkey % 4
NO_SESSION_SIGNUP = "1995-01-01"
SECOND_SUB_EVERY = 29
SECOND_SUB_OFFSET = 10000000


def _case(col: F.Column, pairs, other) -> F.Column:
    e = None
    for k, v in pairs:
        e = F.when(col == k, F.lit(v)) if e is None else e.when(col == k, F.lit(v))
    return e.otherwise(F.lit(other))


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind_sessions(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """``parts``: tasks over which both sides are dealt by order before they are joined."""
    li = (read_driver(spark, sf_dir, "lineitem")
          .select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"))
    o = read_driver(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if parts:
        # a merge: the size of a well compressed file would let millions of orders be broadcast
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey").hint("merge")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    outlier = F.when(((F.col("l_orderkey") + F.col("l_linenumber")) % 97) == 0, 120).otherwise(0)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_shipdate").cast("date").alias("session_date"),
        (F.lit(5) + F.col("l_partkey") % 51 + outlier).cast("int").alias("session_duration_minutes"),
    )


def _first_last_session(sessions: DataFrame) -> DataFrame:
    # One pass over sessions gives both ends; partial aggregation collapses
    # each user's rows map-side, so a heavy user does not skew the shuffle.
    return sessions.groupBy("user_id").agg(
        F.min("session_date").alias("first_session"),
        F.max("session_date").alias("last_session"))


def _user_base(spark: SparkSession, sf_dir: str, first_last: DataFrame) -> DataFrame:
    c = read_driver(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_driver(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    stage_k = k % 17
    stage = (F.when(stage_k == 0, "Signup").when(stage_k == 1, "Email Verification")
             .when(stage_k == 2, "First Login").when(stage_k <= 8, "Feature Adoption")
             .when(stage_k <= 13, "Subscription").otherwise("Renewal"))
    base = (c.join(n, c.c_nationkey == n.n_nationkey, "inner")
            .join(first_last, c.c_custkey == first_last.user_id, "left"))
    return base.select(
        k.alias("user_id"),
        F.date_sub(F.coalesce(F.col("first_session"), F.lit(NO_SESSION_SIGNUP).cast("date")),
                   (k % 45).cast("int")).alias("signup_date"),
        _case(F.col("c_mktsegment"), SEGMENT_TO_CHANNEL, OTHER_CHANNEL).alias("signup_channel"),
        (F.lit(18) + k % 47).cast("int").alias("age"),
        F.col("n_name").alias("country"),
        F.when(k % 2 == 0, "A").otherwise("B").alias("experiment_group"),
        stage.alias("funnel_stage"),
        F.col("c_acctbal"),
        F.col("last_session"),
    )


def bind(spark: SparkSession, sf_dir: str, period: Period = DEFAULT_PERIOD,
         sessions: DataFrame | None = None) -> Tables:
    """The six tables; ``sessions``: bound sessions that are written already."""
    if sessions is None:
        sessions = bind_sessions(spark, sf_dir)
    base = _user_base(spark, sf_dir, _first_last_session(sessions))
    users = base.select("user_id", "signup_date", "signup_channel", "age", "country",
                        "experiment_group", "funnel_stage")

    uid = F.col("user_id")
    m7 = uid % 7
    plan = (F.when(F.col("funnel_stage").isin("Subscription", "Renewal"),
                   F.when(F.col("c_acctbal") > 7500, "Enterprise").otherwise("Pro"))
            .otherwise("Free"))
    first_sub = base.select(
        uid.alias("subscription_id"), uid.alias("user_id"), plan.alias("plan_type"),
        F.col("signup_date").alias("start_date"),
        F.when(m7 >= 4, F.lit(None).cast("date")).otherwise(F.col("last_session")).alias("end_date"),
        F.when(m7 <= 2, "Churned").when(m7 == 3, "Expired").otherwise("Active").alias("status"))
    second_sub = (base.where(uid % SECOND_SUB_EVERY == 0).select(
        (uid + SECOND_SUB_OFFSET).alias("subscription_id"), uid.alias("user_id"),
        F.lit("Pro").alias("plan_type"), F.col("signup_date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"), F.lit("Active").alias("status")))
    subscriptions = first_sub.unionByName(second_sub)

    orders = read_driver(spark, sf_dir, "orders")
    transactions = orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("amount"),
        _case(F.col("o_orderstatus"), ORDER_STATUS_TO_TX, OTHER_TX_STATUS).alias("status"))

    ok = F.col("o_orderkey")
    cat = ok % 4
    tickets = orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        ok.alias("ticket_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("ticket_date"),
        (F.when(cat == 0, TICKET_CATEGORIES[0]).when(cat == 1, TICKET_CATEGORIES[1])
         .when(cat == 2, TICKET_CATEGORIES[2]).otherwise(TICKET_CATEGORIES[3])).alias("category"),
        (((ok * 4801) % 7200) / F.lit(100.0)).cast("decimal(5,2)").alias("resolution_time_hours"),
        F.when(ok % 13 == 0, F.lit(None).cast("int"))
        .otherwise((F.lit(1) + ok % 5).cast("int")).alias("satisfaction_score"))

    events = read_driver(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("user_id"),
        _case(F.col("event_type"), EVENT_TO_FEATURE, OTHER_FEATURE).alias("feature_name"),
        F.col("ts").alias("event_time"),
        F.floor(F.col("value")).cast("int").alias("time_spent_seconds"))

    return Tables(users, subscriptions, sessions, transactions, tickets, events)
