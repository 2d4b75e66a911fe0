"""Analyses the reference states in its reports without code: inactivity alerts,
first-week Export adoption, ticket friction, plan revenue share, channel value,
session length by age band. All are per-user aggregates joined on user_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.operators.reshape import scalar
from subscope.functions import age_band, churned_flag, half_up, half_up_money, lit_date, pct
from subscope.params import DEFAULT_PERIOD, Period
from subscope.plans.churn import first_subscription
from subscope.sources.binding import Tables

C = F.col
ALERT_DAYS = 10      # no login for this many days -> alert
INACTIVE_DAYS = 14   # "inactive for more than 14 days"
FIRST_WEEK_DAYS = 7
FRICTION_TICKETS = 3  # tickets in one month


def _churned_users(t: Tables) -> DataFrame:
    return t.subscriptions.groupBy("user_id").agg(F.max(churned_flag("status")).alias("churned"))


def _churn_by_flag(users_flag: DataFrame, t: Tables, flag: str) -> DataFrame:
    j = users_flag.join(_churned_users(t), "user_id", "left")
    g = j.groupBy(flag).agg(F.count(F.lit(1)).alias("users"),
                            F.coalesce(F.sum("churned"), F.lit(0)).cast("long").alias("churned_users"))
    return g.select(flag, "users", "churned_users", pct(C("churned_users"), C("users")).alias("churn_rate_pct"))


def _last_session(t: Tables) -> DataFrame:
    return t.user_sessions.groupBy("user_id").agg(F.max("session_date").alias("last_session_date"))


def inactivity_alerts(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Users with no session in the last ALERT_DAYS days before as_of (or none at all)."""
    u = t.users.select("user_id").distinct().join(_last_session(t), "user_id", "left")
    days = F.datediff(lit_date(p.as_of), C("last_session_date")).cast("long")
    return (u.select("user_id", "last_session_date", days.alias("days_inactive"))
            .where(C("days_inactive").isNull() | (C("days_inactive") >= ALERT_DAYS)))


def inactivity_churn(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    u = t.users.select("user_id").distinct().join(_last_session(t), "user_id", "left")
    days = F.datediff(lit_date(p.as_of), C("last_session_date"))
    flag = F.when(days.isNull() | (days > INACTIVE_DAYS), "inactive").otherwise("active")
    return _churn_by_flag(u.select("user_id", flag.alias("activity")), t, "activity")


def export_first_week_churn(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    u = t.users.select("user_id", "signup_date")
    # the window [signup, signup + 7 days) has whole-day bounds, so an event's day decides;
    # distinct (user, day) first: a user with a third of all events is a few rows per day
    ex_days = (t.feature_events.where(C("feature_name") == "Export")
               .select("user_id", F.to_date("event_time").alias("d")).distinct())
    in_week = (C("d") >= C("signup_date")) & (C("d") < F.date_add(C("signup_date"), FIRST_WEEK_DAYS))
    hit = (ex_days.join(u, "user_id").where(in_week)
           .select("user_id").distinct().withColumn("hit", F.lit(1)))
    flag = F.when(C("hit") == 1, "export_first_week").otherwise("no_export_first_week")
    f = t.users.select("user_id").distinct().join(hit, "user_id", "left").select("user_id", flag.alias("adoption"))
    return _churn_by_flag(f, t, "adoption")


def ticket_friction_churn(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    per_month = (t.support_tickets.groupBy("user_id", F.trunc("ticket_date", "month").alias("m"))
                 .agg(F.count(F.lit(1)).alias("n")))
    fr = (per_month.groupBy("user_id").agg(F.max("n").alias("max_month_tickets"))
          .where(C("max_month_tickets") >= FRICTION_TICKETS).select("user_id", F.lit(1).alias("fr")))
    flag = F.when(C("fr") == 1, "friction").otherwise("no_friction")
    f = t.users.select("user_id").distinct().join(fr, "user_id", "left").select("user_id", flag.alias("friction"))
    base = _churn_by_flag(f, t, "friction")
    per_user = t.support_tickets.groupBy("user_id").agg(
        F.sum("resolution_time_hours").alias("h"), F.count("resolution_time_hours").alias("n"))
    hours = (per_user.join(f, "user_id").groupBy("friction")
             .agg(F.sum("h").alias("_h"), F.sum("n").alias("_n")))
    return base.join(hours, "friction", "left").select(
        "friction", "users", "churned_users", "churn_rate_pct",
        half_up_money(C("_h"), C("_n")).alias("avg_resolution_hours"))


def plan_revenue_share(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    rev = (t.transactions.where(C("status") == "Success").groupBy("user_id")
           .agg(F.sum("amount").alias("rev")))
    j = first_subscription(t, p).join(rev, "user_id", "left")
    g = j.groupBy("plan_type").agg(F.count(F.lit(1)).alias("users"),
                                   F.coalesce(F.sum("rev"), F.lit(0)).alias("_rev"))
    tot = g.agg(F.sum("users").alias("_u"), F.sum("_rev").alias("_r"))
    cents = (C("_rev") * 100).cast("long")
    tot_cents = (C("_r") * 100).cast("long")
    g = g.withColumn("_u", scalar(tot, "_u")).withColumn("_r", scalar(tot, "_r"))
    return g.select(
        "plan_type", "users", C("_rev").cast("double").alias("revenue"),
        pct(C("users"), C("_u")).alias("user_share_pct"),
        pct(cents, tot_cents).alias("revenue_share_pct"))


def channel_arpu_tickets(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    rev = (t.transactions.where(C("status") == "Success").groupBy("user_id")
           .agg(F.sum("amount").alias("rev")))
    tk = t.support_tickets.groupBy("user_id").agg(F.count(F.lit(1)).alias("nt"))
    j = t.users.select("user_id", "signup_channel").join(rev, "user_id", "left").join(tk, "user_id", "left")
    g = j.groupBy("signup_channel").agg(F.count(F.lit(1)).alias("users"),
                                        F.sum("rev").alias("_rev"),
                                        F.coalesce(F.sum("nt"), F.lit(0)).alias("tickets"))
    return g.select("signup_channel", "users", half_up_money(C("_rev"), C("users")).alias("revenue_per_user"),
                    half_up(C("tickets"), C("users"), 2).alias("tickets_per_user"))


def session_minutes_by_age_band(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    s = t.user_sessions.groupBy("user_id").agg(F.sum("session_duration_minutes").alias("sm"),
                                               F.count(F.lit(1)).alias("ns"))
    j = t.users.select("user_id", age_band("age").alias("age_group")).join(s, "user_id")
    g = j.groupBy("age_group").agg(F.sum("ns").alias("sessions"), F.sum("sm").alias("_sm"))
    return g.select("age_group", "sessions", half_up(C("_sm"), C("sessions"), 1).alias("avg_session_minutes"))


PLANS = {
    "inactivity_alerts": inactivity_alerts,
    "inactivity_churn": inactivity_churn,
    "export_first_week_churn": export_first_week_churn,
    "ticket_friction_churn": ticket_friction_churn,
    "plan_revenue_share": plan_revenue_share,
    "channel_arpu_tickets": channel_arpu_tickets,
    "session_minutes_by_age_band": session_minutes_by_age_band,
}
