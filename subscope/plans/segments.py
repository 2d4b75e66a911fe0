"""Tables behind the dashboard pages (charts are not built, their data is)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subscope import schema as S
from subscope.functions import churned_flag, exact_mean, ticket_segment
from subscope.operators.reshape import one_row
from subscope.params import DEFAULT_PERIOD, Period
from subscope.plans import kpis
from subscope.plans.churn import first_subscription
from subscope.sources.binding import Tables

C = F.col


def _ratio100(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))


def _total_users(t: Tables) -> DataFrame:
    return t.users.agg(F.count(F.lit(1)).alias("total_users"))


def _paying(t: Tables) -> DataFrame:
    return (t.subscriptions.where((C("status") == "Active") & (C("plan_type") != "Free"))
            .agg(F.countDistinct("user_id").alias("paying_users")))


def _churned(t: Tables) -> DataFrame:
    return (t.subscriptions.where(C("status") == "Churned")
            .agg(F.countDistinct("user_id").alias("churned_users")))


def paying_users(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return one_row(_total_users(t), _paying(t))


def lifetime_churn(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return one_row(_total_users(t), _churned(t)).select(
        "total_users", "churned_users", _ratio100(C("churned_users"), C("total_users")).alias("lifetime_churn_rate"))


def overview_kpis(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    # base aggregates only: the scalar subqueries sit on one level and run together
    r = one_row(_total_users(t), _paying(t), _churned(t), kpis.avg_dau(t, p), kpis.avg_mau(t, p),
                kpis.period_revenue(t, p), kpis._month_mau(t, p))
    r = r.select("*", _ratio100(C("churned_users"), C("total_users")).alias("lifetime_churn_rate"),
                 kpis._arpu_expr().alias("arpu"))
    rate = C("lifetime_churn_rate")
    return r.select(
        C("total_users").alias("total_customers"), "paying_users", "mrr",
        C("avg_dau").alias("dau"), C("avg_mau").alias("mau"), kpis._stickiness_expr().alias("stickiness"),
        "arpu", "churned_users", "lifetime_churn_rate",
        F.when(rate > 0, C("arpu") * (F.lit(1.0) / (rate / F.lit(100.0)))).otherwise(F.lit(0.0)).alias("clv"))


def plan_mix(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (first_subscription(t, p).groupBy("plan_type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(C("count").desc(), "plan_type"))


def channel_counts(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (t.users.groupBy("signup_channel").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(C("count").desc(), "signup_channel"))


def country_counts(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (t.users.groupBy("country").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(C("count").desc(), "country"))


def _user_sub_weights(t: Tables, *user_attrs: str) -> DataFrame:
    """(user_id, attrs, rows, churned_rows) of users x subscriptions, without the join rows."""
    un = t.users.groupBy("user_id", *user_attrs).agg(F.count(F.lit(1)).alias("n_u"))
    sn = t.subscriptions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_s"),
                                                 F.sum(churned_flag("status")).alias("n_c"))
    return un.join(sn, "user_id").select("user_id", *user_attrs, (C("n_u") * C("n_s")).alias("rows"),
                                         (C("n_u") * C("n_c")).alias("churned_rows"))


def channel_churn_unrounded(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    g = _user_sub_weights(t, "signup_channel").groupBy("signup_channel").agg(
        F.sum("rows").cast("long").alias("total_customers"),
        F.sum("churned_rows").cast("long").alias("churned_customers"))
    return (g.select("*", (C("churned_customers").cast("double") / C("total_customers").cast("double")
                           * F.lit(100.0)).alias("churn_rate"))
            .orderBy("churn_rate", "signup_channel"))


def _stage_dim(t: Tables) -> DataFrame:
    """The six funnel stages and their order: a fixed six-row frame."""
    spark = t.users.sparkSession
    return spark.createDataFrame([(s, i) for i, s in enumerate(S.FUNNEL_STAGES, start=1)],
                                 "Stage string, stage_order int")


def cumulative_funnel(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    counts = t.users.groupBy(C("funnel_stage").alias("Stage")).agg(F.count(F.lit(1)).alias("n"))
    dim = _stage_dim(t)
    j = dim.join(counts, "Stage", "left")
    # suffix sum over the six stage rows (a fixed, six-row window)
    w = Window.orderBy(C("stage_order").desc()).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.orderBy("stage_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = j.withColumn("Users", F.sum(F.coalesce(C("n"), F.lit(0))).over(w).cast("long"))
    return (r.withColumn("pct_of_initial", F.try_divide(C("Users").cast("double"),
                                                        F.first("Users").over(first).cast("double")) * 100.0)
            .select("Stage", "stage_order", "Users", "pct_of_initial").orderBy("stage_order"))


def funnel_step_rates(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    cf = cumulative_funnel(t, p)
    g = cf.agg(*[F.max(F.when(C("stage_order") == i, C("Users"))).alias(f"u{i}") for i in (1, 3, 5, 6)])

    def rate(a, b):
        return F.try_divide(C(a).cast("double"), C(b).cast("double")) * F.lit(100.0)
    return g.select(rate("u3", "u1").alias("signup_to_first_login_pct"),
                    rate("u5", "u3").alias("login_to_premium_pct"),
                    rate("u6", "u5").alias("subscription_to_renewal_pct"))


def feature_clicks(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (t.feature_events.groupBy(C("feature_name").alias("Feature"))
            .agg(F.count(F.lit(1)).alias("Clicks")).orderBy(C("Clicks").desc(), "Feature"))


def feature_avg_time(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (t.feature_events.groupBy(C("feature_name").alias("Feature"))
            .agg(exact_mean("time_spent_seconds").alias("avg_time_secs")))


def ticket_volume(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (t.support_tickets.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(C("count").desc(), "category"))


def csat_distribution(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (t.support_tickets.where(C("satisfaction_score").isNotNull())
            .groupBy("satisfaction_score").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(C("count").desc(), "satisfaction_score"))


def ticket_segment_churn_unrounded(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """users x subscriptions rows, each with its user's ticket count (missing -> 0)."""
    tn = t.support_tickets.groupBy("user_id").agg(F.count("ticket_id").alias("n_t"))
    w = _user_sub_weights(t).join(tn, "user_id", "left")
    seg = ticket_segment(F.coalesce(C("n_t"), F.lit(0)), S.TICKET_SEGMENTS_DASH)
    g = w.groupBy(seg.alias("ticket_segment")).agg(F.sum("rows").cast("long").alias("total"),
                                                   F.sum("churned_rows").cast("long").alias("churned"))
    return g.select("*", (C("churned").cast("double") / C("total").cast("double") * F.lit(100.0))
                    .alias("churn_rate")).orderBy("ticket_segment")


PLANS = {
    "paying_users": paying_users,
    "lifetime_churn": lifetime_churn,
    "overview_kpis": overview_kpis,
    "plan_mix": plan_mix,
    "channel_counts": channel_counts,
    "country_counts": country_counts,
    "channel_churn_unrounded": channel_churn_unrounded,
    "cumulative_funnel": cumulative_funnel,
    "funnel_step_rates": funnel_step_rates,
    "feature_clicks": feature_clicks,
    "feature_avg_time": feature_avg_time,
    "ticket_volume": ticket_volume,
    "csat_distribution": csat_distribution,
    "ticket_segment_churn_unrounded": ticket_segment_churn_unrounded,
}


def monthly_revenue_trend(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Monthly successful revenue with the month as a DATE (first day), for a time axis."""
    return (t.transactions.where(C("status") == "Success")
            .groupBy(F.trunc("transaction_date", "month").alias("month"))
            .agg(F.sum("amount").cast("double").alias("amount")).orderBy("month"))


def distinct_values(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The values offered for country and channel (distinct, per column)."""
    c = t.users.select(F.lit("country").alias("column_name"), C("country").alias("value")).distinct()
    ch = t.users.select(F.lit("signup_channel").alias("column_name"), C("signup_channel").alias("value")).distinct()
    return c.unionByName(ch).orderBy("column_name", "value")


PLANS.update({
    "monthly_revenue_trend": monthly_revenue_trend,
    "distinct_values": distinct_values,
})
