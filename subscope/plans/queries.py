"""The 30 named analysis queries (and corrected variants), written Spark-first.

Grain rule used throughout: facts (sessions, transactions, tickets, events) are
aggregated per user *before* they meet users or subscriptions. An aggregate
combines map-side, so a user holding a third of all rows is one row after it,
and the joins then run on user-grain frames that are already hash-partitioned
by ``user_id``. Where the SQL's join fan-out changes the answer (a user with
two subscriptions, a payment counted once per session), the per-user
aggregates are multiplied by the join multiplicities, which reproduces the
as-written result exactly without materialising the fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subscope import schema as S
from subscope.functions import (age_band, churned_flag, count_when, half_up, half_up_money,
                                in_calendar_month, lit_date, month_key, month_start, pct,
                                stage_order, sum_when, ticket_segment)
from subscope.operators.reshape import scalar
from subscope.operators.topk import ranked_values
from subscope.params import DEFAULT_PERIOD, Period
from subscope.sources.binding import Tables

C = F.col


def _in_month(c, p: Period):
    return C(c).between(lit_date(p.month_start), lit_date(p.month_end))


def _users_n(t: Tables, *attrs: str) -> DataFrame:
    """users rows per (user_id, attrs): the multiplicity an inner join to users carries."""
    return t.users.groupBy("user_id", *attrs).agg(F.count(F.lit(1)).alias("n_u"))


def _subs_per_user(t: Tables, *extra) -> DataFrame:
    return t.subscriptions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_s"),
        F.sum(churned_flag("status")).cast("long").alias("n_churned"), *extra)


# ---------------------------------------------------------------- Q01 - Q04: users, activity

def funnel_distribution(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    g = t.users.groupBy("funnel_stage").agg(F.count("user_id").alias("user_count"))
    # user_id is the key (never NULL), so the stage counts add up to COUNT(*)
    total = g.agg(F.sum("user_count").alias("_total"))
    return (g.select("funnel_stage", "user_count",
                     pct(C("user_count"), scalar(total, "_total")).alias("percentage"))
            .orderBy(C("user_count").desc()))


def monthly_active_users(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    s = t.user_sessions
    # group on the DATE month and format only the grouped rows
    return (s.groupBy(month_start("session_date").alias("_m"))
            .agg(F.countDistinct("user_id").alias("mau"))
            .select(month_key("_m").alias("session_month"), "mau")
            .orderBy("session_month"))


def daily_active_users(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    s = t.user_sessions.where(C("session_date").between(lit_date(p.dau_start), lit_date(p.month_end)))
    return (s.groupBy("session_date").agg(F.countDistinct("user_id").alias("dau"))
            .orderBy("session_date"))


def stickiness_month(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    pairs = t.user_sessions.where(_in_month("session_date", p)).select("session_date", "user_id").distinct()
    # each (day, user) pair counts once in its day's active users
    d = pairs.agg(F.count(F.lit(1)).alias("_sum_dau"), F.countDistinct("session_date").alias("_days"),
                  F.countDistinct("user_id").alias("monthly_active_users"))
    return d.select(
        half_up(C("_sum_dau"), C("_days"), 1).alias("avg_daily_active_users"),
        C("monthly_active_users"),
        half_up(C("_sum_dau"), C("_days") * C("monthly_active_users"), 2, 100)
        .alias("stickiness_percentage"))


# ---------------------------------------------------------------- Q05 - Q08: revenue

def monthly_revenue(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    tx = t.transactions.where(C("status") == "Success")
    return (tx.groupBy(month_start("transaction_date").alias("_m"))
            .agg(F.sum("amount").cast("double").alias("monthly_revenue"),
                 F.count("transaction_id").alias("transaction_count"))
            .select(month_key("_m").alias("billing_month"), "monthly_revenue", "transaction_count")
            .orderBy("billing_month"))


def _month_activity(t: Tables, p: Period) -> DataFrame:
    """Per user active in the month: sessions in month and successful revenue in month."""
    ms = (t.user_sessions.where(_in_month("session_date", p))
          .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sess")))
    mr = (t.transactions.where((C("status") == "Success")
                               & in_calendar_month("transaction_date", p.calendar_month))
          .groupBy("user_id").agg(F.sum("amount").alias("rev")))
    return ms.join(mr, "user_id", "left")


def arpu_by_plan(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """As written: each payment counts once per session of the month (join fan-out)."""
    j = _month_activity(t, p).join(t.subscriptions.select("user_id", "plan_type"), "user_id")
    g = j.groupBy("plan_type").agg(F.sum(C("rev") * C("n_sess")).alias("_rev"),
                                   F.countDistinct("user_id").alias("active_users"))
    return g.select("plan_type", C("_rev").cast("double").alias("total_revenue"), "active_users",
                    half_up_money(C("_rev"), C("active_users")).alias("arpu"))


def arpu_by_plan_dedup(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Corrected: each active user's month revenue once per plan."""
    plans = t.subscriptions.select("user_id", "plan_type").distinct()
    j = _month_activity(t, p).join(plans, "user_id")
    g = j.groupBy("plan_type").agg(F.sum("rev").alias("_rev"), F.count(F.lit(1)).alias("active_users"))
    return g.select("plan_type", C("_rev").cast("double").alias("total_revenue"), "active_users",
                    half_up_money(C("_rev"), C("active_users")).alias("arpu"))


def _clv_select(g: DataFrame) -> DataFrame:
    return g.select(
        "plan_type",
        half_up_money(C("_rev"), C("_total")).alias("monthly_arpu"),
        pct(C("_churned"), C("_total")).alias("monthly_churn_rate_pct"),
        half_up_money(C("_rev"), C("_churned")).alias("clv_estimate"))


def clv_by_plan(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """As written: a churned subscription counts once per transaction of its user."""
    in_month = (C("status") == "Success") & _in_month("transaction_date", p)
    tx = t.transactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.sum(F.when(in_month, C("amount")).otherwise(F.lit(0))).alias("rev"))
    subs = t.subscriptions.where(C("plan_type") != "Free")
    j = subs.join(tx, "user_id", "left")
    rows = F.greatest(F.coalesce(C("n_tx"), F.lit(0)), F.lit(1))
    g = j.groupBy("plan_type").agg(
        F.countDistinct("user_id").alias("_total"),
        F.sum(churned_flag("status") * rows).cast("long").alias("_churned"),
        F.sum(F.coalesce(C("rev"), F.lit(0))).alias("_rev"))
    return _clv_select(g)


def clv_by_plan_dedup(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Corrected: users, churned users and month revenue each counted once per plan."""
    in_month = (C("status") == "Success") & _in_month("transaction_date", p)
    rev = t.transactions.where(in_month).groupBy("user_id").agg(F.sum("amount").alias("rev"))
    subs = (t.subscriptions.where(C("plan_type") != "Free")
            .groupBy("plan_type", "user_id").agg(F.max(churned_flag("status")).alias("churned")))
    g = subs.join(rev, "user_id", "left").groupBy("plan_type").agg(
        F.count(F.lit(1)).alias("_total"),
        F.sum("churned").cast("long").alias("_churned"),
        F.coalesce(F.sum("rev"), F.lit(0)).alias("_rev"))
    return _clv_select(g)


def failed_billing_by_plan(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    failed = C("status") == "Failed"
    tx = t.transactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_tx"),
        count_when(failed).alias("n_failed"),
        F.sum(F.when(failed, C("amount"))).alias("failed_amount"))
    j = tx.join(t.subscriptions.select("user_id", "plan_type"), "user_id")
    g = (j.groupBy("plan_type").agg(F.sum("n_tx").alias("_total"),
                                    F.sum("n_failed").alias("failed_billing_attempts"),
                                    F.sum("failed_amount").alias("_leaked"))
         .where(C("failed_billing_attempts") > 0))
    return g.select("plan_type", "failed_billing_attempts",
                    C("_leaked").cast("double").alias("leaked_revenue_potential"),
                    pct(C("failed_billing_attempts"), C("_total")).alias("failure_percentage"))


# ---------------------------------------------------------------- Q09 - Q14: funnel, A/B

def funnel_ordered(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    g = t.users.groupBy("funnel_stage").agg(F.count(F.lit(1)).alias("users_reached"))
    return g.orderBy(stage_order("funnel_stage"), "funnel_stage")


def funnel_conversion(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    st = C("funnel_stage")
    g = t.users.agg(
        count_when(st.isin(*S.FUNNEL_STAGES)).alias("total_signups"),
        count_when(st.isin(*S.LOGIN_STAGES)).alias("_login"),
        count_when(st.isin(*S.PAID_STAGES)).alias("_paid"),
        count_when(st == "Renewal").alias("_renewal"))
    return g.select("total_signups",
                    pct(C("_login"), C("total_signups")).alias("signup_to_login_conv_pct"),
                    pct(C("_paid"), C("_login")).alias("login_to_paid_conv_pct"),
                    pct(C("_renewal"), C("_paid")).alias("paid_to_renewal_conv_pct"))


def ab_conversion(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    g = t.users.groupBy("experiment_group").agg(
        F.count("user_id").alias("total_users"),
        sum_when(C("funnel_stage").isin(*S.PAID_STAGES)).alias("converted_users"))
    return g.select("experiment_group", "total_users", "converted_users",
                    pct(C("converted_users"), C("total_users")).alias("conversion_rate_pct"))


def _success_revenue_per_user(t: Tables) -> DataFrame:
    return (t.transactions.where(C("status") == "Success")
            .groupBy("user_id").agg(F.sum("amount").alias("rev")))


def ab_lifetime_arpu(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    j = t.users.select("user_id", "experiment_group").join(_success_revenue_per_user(t), "user_id", "left")
    g = j.groupBy("experiment_group").agg(F.sum("rev").alias("_rev"),
                                          F.countDistinct("user_id").alias("_n"))
    return g.select("experiment_group", half_up_money(C("_rev"), C("_n")).alias("lifetime_arpu"))


def ab_session_length(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    s = t.user_sessions.groupBy("user_id").agg(
        F.sum("session_duration_minutes").alias("m"),
        F.count("session_duration_minutes").alias("nm"),
        F.count("session_id").alias("ns"))
    j = t.users.select("user_id", "experiment_group").join(s, "user_id")
    g = j.groupBy("experiment_group").agg(F.sum("m").alias("_m"), F.sum("nm").alias("_nm"),
                                          F.sum("ns").alias("total_sessions"))
    return g.select("experiment_group", half_up(C("_m"), C("_nm"), 1).alias("avg_session_minutes"),
                    "total_sessions")


def ab_clicks_per_user(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    e = t.feature_events.groupBy("user_id").agg(F.count("event_id").alias("ne"))
    j = t.users.select("user_id", "experiment_group").join(e, "user_id", "left")
    g = j.groupBy("experiment_group").agg(F.coalesce(F.sum("ne"), F.lit(0)).alias("_ne"),
                                          F.countDistinct("user_id").alias("_nu"))
    return g.select("experiment_group", half_up(C("_ne"), C("_nu"), 1).alias("avg_clicks_per_user"))


# ---------------------------------------------------------------- Q15 - Q18: churn, geography

def _churn_by_user_attr(t: Tables, attr: str, key_expr=None, key_name: str | None = None) -> DataFrame:
    u = t.users if key_expr is None else t.users.withColumn(key_name, key_expr)
    key = key_name or attr
    j = u.select("user_id", key).join(_subs_per_user(t), "user_id")  # a user's rows carry their own number
    g = j.groupBy(key).agg(F.sum("n_s").cast("long").alias("total_users"),
                           F.sum("n_churned").cast("long").alias("churned_users"))
    return g.select(key, "total_users", "churned_users",
                    pct(C("churned_users"), C("total_users")).alias("churn_rate_pct"))


def churn_by_channel(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return _churn_by_user_attr(t, "signup_channel").orderBy("churn_rate_pct", "signup_channel")


def churn_by_plan(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    un = t.users.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_u"))
    j = t.subscriptions.select("user_id", "plan_type", "status").join(un, "user_id")
    g = j.groupBy("plan_type").agg(F.sum("n_u").cast("long").alias("total_users"),
                                   F.sum(C("n_u") * churned_flag("status")).cast("long").alias("churned_users"))
    return g.select("plan_type", "total_users", "churned_users",
                    pct(C("churned_users"), C("total_users")).alias("churn_rate_pct"))


def revenue_by_country(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    j = t.users.select("user_id", "country").join(_success_revenue_per_user(t), "user_id", "left")
    g = j.groupBy("country").agg(F.countDistinct("user_id").alias("customer_count"),
                                 F.sum("rev").alias("_rev"))
    return (g.select("country", "customer_count", C("_rev").cast("double").alias("total_revenue"),
                     half_up_money(C("_rev"), C("customer_count")).alias("revenue_per_customer"))
            .orderBy(C("total_revenue").desc_nulls_last()))


def signup_cohort_size(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (t.users.groupBy(month_start("signup_date").alias("_m"))
            .agg(F.count("user_id").alias("size"))
            .select(month_key("_m").alias("cohort_month"), "size").orderBy("cohort_month"))


# ---------------------------------------------------------------- Q19 - Q21: features

def feature_usage_share(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    g = t.feature_events.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("total_clicks"),
        F.sum("time_spent_seconds").alias("_s"), F.count("time_spent_seconds").alias("_ns"))
    # the total over the grouped rows: one for each feature, so one task is enough
    total = F.sum("total_clicks").over(Window.partitionBy())
    return (g.withColumn("_all", total)
            .select("feature_name", "total_clicks",
                    half_up(C("_s"), C("_ns"), 1).alias("avg_duration_seconds"),
                    pct(C("total_clicks"), C("_all")).alias("usage_share_pct"))
            .orderBy(C("total_clicks").desc()))


def _events_per_user_feature(t: Tables) -> DataFrame:
    return t.feature_events.groupBy("user_id", "feature_name").agg(
        F.count(F.lit(1)).alias("ne"), F.sum("time_spent_seconds").alias("se"),
        F.count("time_spent_seconds").alias("ce"))


def enterprise_feature_usage(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    ent = (t.subscriptions.where(C("plan_type") == "Enterprise")
           .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_s")))
    j = _events_per_user_feature(t).join(ent, "user_id")
    g = j.groupBy("feature_name").agg(F.sum(C("ne") * C("n_s")).cast("long").alias("enterprise_clicks"),
                                      F.sum(C("se") * C("n_s")).alias("_s"),
                                      F.sum(C("ce") * C("n_s")).alias("_ns"))
    return (g.select("feature_name", "enterprise_clicks",
                     half_up(C("_s"), C("_ns"), 1).alias("avg_duration_seconds"))
            .orderBy(C("enterprise_clicks").desc()))


def export_clicks_by_plan(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    e = (t.feature_events.where(C("feature_name") == "Export")
         .groupBy("user_id").agg(F.count(F.lit(1)).alias("nx")))
    j = t.subscriptions.select("user_id", "plan_type").join(e, "user_id", "left")
    g = j.groupBy("plan_type").agg(F.sum(F.coalesce(C("nx"), F.lit(0))).cast("long").alias("total_export_clicks"),
                                   F.countDistinct("user_id").alias("_nu"))
    return g.select("plan_type", "total_export_clicks",
                    half_up(C("total_export_clicks"), C("_nu"), 2).alias("avg_export_clicks_per_user"))


# ---------------------------------------------------------------- Q22 - Q25: support

def ticket_stats_by_category(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    g = t.support_tickets.groupBy("category").agg(
        F.count(F.lit(1)).alias("ticket_volume"),
        F.sum("resolution_time_hours").alias("_h"), F.count("resolution_time_hours").alias("_nh"),
        F.sum("satisfaction_score").alias("_s"), F.count("satisfaction_score").alias("_ns"))
    return (g.select("category", "ticket_volume",
                     half_up_money(C("_h"), C("_nh")).alias("avg_resolution_hours"),
                     half_up(C("_s"), C("_ns"), 1).alias("avg_csat_score"))
            .orderBy(C("ticket_volume").desc()))


def csat_by_plan(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    tk = (t.support_tickets.where(C("satisfaction_score").isNotNull())
          .groupBy("user_id").agg(F.count("ticket_id").alias("nt"),
                                  F.sum("satisfaction_score").alias("ss")))
    j = tk.join(t.subscriptions.select("user_id", "plan_type"), "user_id")
    g = j.groupBy("plan_type").agg(F.sum("nt").alias("ticket_count"), F.sum("ss").alias("_ss"))
    return g.select("plan_type", "ticket_count",
                    half_up(C("_ss"), C("ticket_count"), 2).alias("avg_satisfaction_rating"))


def ticket_counts_per_user_status(t: Tables) -> DataFrame:
    """(user_id, customer_status, tickets_count) with the SQL's join multiplicities."""
    un = t.users.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_u"))
    sn = (t.subscriptions.groupBy("user_id", C("status").alias("customer_status"))
          .agg(F.count(F.lit(1)).alias("n_s")))
    tn = t.support_tickets.groupBy("user_id").agg(F.count("ticket_id").alias("n_t"))
    j = un.join(sn, "user_id").join(tn, "user_id", "left")
    return j.select("user_id", "customer_status",
                    (C("n_u") * C("n_s") * F.coalesce(C("n_t"), F.lit(0))).alias("tickets_count"))


def ticket_segment_churn(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    tc = ticket_counts_per_user_status(t)
    g = tc.groupBy(ticket_segment("tickets_count").alias("ticket_segment")).agg(
        F.count("user_id").alias("customers"),
        sum_when(C("customer_status") == "Churned").alias("churned_count"))
    return (g.select("ticket_segment", "customers", "churned_count",
                     pct(C("churned_count"), C("customers")).alias("churn_rate_pct"))
            .orderBy("ticket_segment"))


def sla_compliance_by_plan(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    tk = t.support_tickets.groupBy("user_id").agg(
        F.count("ticket_id").alias("nt"),
        count_when(C("resolution_time_hours") <= F.lit(S.SLA_HOURS)).alias("nf"))
    j = tk.join(t.subscriptions.select("user_id", "plan_type"), "user_id")
    g = j.groupBy("plan_type").agg(F.sum("nt").alias("total_tickets"),
                                   F.sum("nf").alias("resolved_under_24h"))
    return g.select("plan_type", "total_tickets", "resolved_under_24h",
                    pct(C("resolved_under_24h"), C("total_tickets")).alias("sla_compliance_pct"))


# ---------------------------------------------------------------- Q26 - Q30: sessions, ranking, segments

def session_stats_by_status(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    m = C("session_duration_minutes")
    s = t.user_sessions.groupBy("user_id").agg(F.sum(m).alias("sm"), F.count(m).alias("cm"),
                                               F.min(m).alias("mn"), F.max(m).alias("mx"))
    j = s.join(t.subscriptions.select("user_id", "status"), "user_id")
    g = j.groupBy(C("status").alias("subscription_status")).agg(
        F.sum("sm").alias("_s"), F.sum("cm").alias("_c"),
        F.min("mn").cast("long").alias("min_session_minutes"),
        F.max("mx").cast("long").alias("max_session_minutes"))
    return g.select("subscription_status", half_up(C("_s"), C("_c"), 1).alias("avg_session_minutes"),
                    "min_session_minutes", "max_session_minutes")


def top3_sessions_by_channel(t: Tables, p: Period = DEFAULT_PERIOD, k: int = 3) -> DataFrame:
    m = "session_duration_minutes"
    uc = t.users.select("user_id", "signup_channel")
    # candidate values: distinct (user, minutes) first, so a heavy user is one row per value
    user_vals = t.user_sessions.select("user_id", m).distinct().join(uc, "user_id")
    top = ranked_values(user_vals, "signup_channel", m, k, "session_rank")
    # only (user, minutes) pairs that reach their own channel's top values meet the sessions, and
    # they meet them on both, so the sessions of a heavy user are spread by their minutes
    rows = t.user_sessions.join(user_vals.join(top, ["signup_channel", m]), ["user_id", m])
    return (rows.select("signup_channel", "user_id", "session_date", m, "session_rank")
            .orderBy("signup_channel", "session_rank", "user_id", "session_date"))


def top10_spenders(t: Tables, p: Period = DEFAULT_PERIOD, k: int = 10) -> DataFrame:
    spend = _success_revenue_per_user(t)
    act = (t.subscriptions.where(C("status") == "Active")
           .groupBy("user_id", "plan_type").agg(F.count(F.lit(1)).alias("n_s")))
    un = _users_n(t, "country", "signup_channel")
    j = spend.join(act, "user_id").join(un, "user_id")
    out = j.select("user_id", "plan_type", "country", "signup_channel",
                   (C("rev") * C("n_s") * C("n_u")).cast("double").alias("total_spend_to_date"))
    return out.orderBy(C("total_spend_to_date").desc(), "user_id", "plan_type",
                       "country", "signup_channel").limit(k)


def churn_by_age_band(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (_churn_by_user_attr(t, "age", age_band("age"), "age_group")
            .orderBy("age_group"))


def _csat_user_pairs(t: Tables) -> DataFrame:
    return (t.support_tickets.where(C("satisfaction_score").isNotNull())
            .groupBy("satisfaction_score", "user_id").agg(F.count(F.lit(1)).alias("n_t")))


def churn_by_csat(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """As written: churned counts tickets, the denominator counts users (may pass 100)."""
    un = t.users.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_u"))
    j = _csat_user_pairs(t).join(un, "user_id").join(_subs_per_user(t), "user_id")
    g = j.groupBy("satisfaction_score").agg(
        F.countDistinct("user_id").alias("customer_count"),
        F.sum(C("n_t") * C("n_u") * C("n_churned")).cast("long").alias("churned_count"))
    return (g.select("satisfaction_score", "customer_count", "churned_count",
                     pct(C("churned_count"), C("customer_count")).alias("churn_rate_pct"))
            .orderBy(C("satisfaction_score").desc()))


def churn_by_csat_users(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Corrected: distinct (score, user) pairs; a user is churned if any subscription churned."""
    users = t.users.select("user_id").distinct()
    subs = t.subscriptions.groupBy("user_id").agg(F.max(churned_flag("status")).alias("churned"))
    j = _csat_user_pairs(t).join(users, "user_id").join(subs, "user_id")
    g = j.groupBy("satisfaction_score").agg(F.count(F.lit(1)).alias("customer_count"),
                                            F.sum("churned").cast("long").alias("churned_count"))
    return (g.select("satisfaction_score", "customer_count", "churned_count",
                     pct(C("churned_count"), C("customer_count")).alias("churn_rate_pct"))
            .orderBy(C("satisfaction_score").desc()))


def subscription_projection(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Projected and renamed scan used by the churn features."""
    return t.subscriptions.select("user_id", "plan_type", C("status").alias("sub_status"))


QUERIES = {
    "funnel_distribution": funnel_distribution,
    "monthly_active_users": monthly_active_users,
    "daily_active_users": daily_active_users,
    "stickiness_month": stickiness_month,
    "monthly_revenue": monthly_revenue,
    "arpu_by_plan": arpu_by_plan,
    "arpu_by_plan_dedup": arpu_by_plan_dedup,
    "clv_by_plan": clv_by_plan,
    "clv_by_plan_dedup": clv_by_plan_dedup,
    "failed_billing_by_plan": failed_billing_by_plan,
    "funnel_ordered": funnel_ordered,
    "funnel_conversion": funnel_conversion,
    "ab_conversion": ab_conversion,
    "ab_lifetime_arpu": ab_lifetime_arpu,
    "ab_session_length": ab_session_length,
    "ab_clicks_per_user": ab_clicks_per_user,
    "churn_by_channel": churn_by_channel,
    "churn_by_plan": churn_by_plan,
    "revenue_by_country": revenue_by_country,
    "signup_cohort_size": signup_cohort_size,
    "feature_usage_share": feature_usage_share,
    "enterprise_feature_usage": enterprise_feature_usage,
    "export_clicks_by_plan": export_clicks_by_plan,
    "ticket_stats_by_category": ticket_stats_by_category,
    "csat_by_plan": csat_by_plan,
    "ticket_segment_churn": ticket_segment_churn,
    "sla_compliance_by_plan": sla_compliance_by_plan,
    "session_stats_by_status": session_stats_by_status,
    "top3_sessions_by_channel": top3_sessions_by_channel,
    "top10_spenders": top10_spenders,
    "churn_by_age_band": churn_by_age_band,
    "churn_by_csat": churn_by_csat,
    "churn_by_csat_users": churn_by_csat_users,
    "subscription_projection": subscription_projection,
}
