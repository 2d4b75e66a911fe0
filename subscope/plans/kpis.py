"""KPI pipeline: DAU/MAU/stickiness, period churn, MRR, ARPU, CLV, funnel rates,
A/B metrics, cohort retention and monthly MRR.

Each KPI is a one-row aggregate; ``kpi_summary`` places the base aggregates side by
side as scalar subqueries (one level, so they run together) and unpivots. The
unrounded values follow the reference's float arithmetic order (a/b*100), with the
same zero guards; sums of money are exact DECIMAL sums cast to DOUBLE once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subscope import schema as S
from subscope.functions import (count_when, in_calendar_month, lit_date, month_key,
                                months_between_keys, month_start)
from subscope.operators.reshape import one_row, scalar, unpivot
from subscope.params import DEFAULT_PERIOD, Period
from subscope.sources.binding import Tables

C = F.col


def _guard(num, den, factor: float | None = None):
    """num/den(*factor) as DOUBLE when den > 0, else 0.0 (the reference's guard)."""
    v = num.cast("double") / den.cast("double")
    if factor is not None:
        v = v * F.lit(factor)
    return F.when(den > 0, v).otherwise(F.lit(0.0))


def _mean_of(groups: DataFrame, col: str, name: str) -> DataFrame:
    return groups.agg(F.try_divide(F.sum(col).cast("double"), F.count(F.lit(1)).cast("double")).alias(name))


def avg_dau(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    daily = t.user_sessions.groupBy("session_date").agg(F.countDistinct("user_id").alias("n"))
    return _mean_of(daily, "n", "avg_dau")


def avg_mau(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    monthly = (t.user_sessions.groupBy(month_start("session_date").alias("m"))
               .agg(F.countDistinct("user_id").alias("n")))
    return _mean_of(monthly, "n", "avg_mau")


def _stickiness_expr():
    return (F.when(C("avg_mau") > 0, C("avg_dau") / C("avg_mau") * F.lit(100.0))
            .otherwise(F.lit(0.0)))


def stickiness(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return one_row(avg_dau(t, p), avg_mau(t, p)).select(
        "avg_dau", "avg_mau", _stickiness_expr().alias("stickiness"))


def _churn_counts(t: Tables, p: Period) -> DataFrame:
    ms = lit_date(p.month_start)
    return t.subscriptions.agg(
        count_when((C("status") == "Churned") & in_calendar_month("end_date", p.calendar_month))
        .alias("churned_in_month"),
        count_when((C("start_date") < ms) & ((C("status") == "Active") | (C("end_date") >= ms)))
        .alias("active_at_start"))


def _churn_rate_expr():
    return _guard(C("churned_in_month"), C("active_at_start"), 100.0)


def monthly_churn_rate(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return _churn_counts(t, p).select("churned_in_month", "active_at_start",
                                      _churn_rate_expr().alias("monthly_churn_rate"))


def period_revenue(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    tx = t.transactions.where((C("status") == "Success")
                              & in_calendar_month("transaction_date", p.calendar_month))
    return tx.agg(F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("mrr"))


def _month_mau(t: Tables, p: Period) -> DataFrame:
    return (t.user_sessions.where(in_calendar_month("session_date", p.calendar_month))
            .agg(F.countDistinct("user_id").alias("month_mau")))


def _arpu_expr():
    return _guard(C("mrr"), C("month_mau"))


def _clv_expr(arpu, rate):
    return F.when(rate > 0, arpu * (F.lit(1.0) / (rate / F.lit(100.0)))).otherwise(F.lit(0.0))


def period_arpu(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return one_row(period_revenue(t, p), _month_mau(t, p)).select(
        "mrr", "month_mau", _arpu_expr().alias("arpu"))


def clv(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    # every input is a base aggregate, so the scalar subqueries sit on one level and run together
    r = one_row(period_revenue(t, p), _month_mau(t, p), _churn_counts(t, p))
    r = r.select(_arpu_expr().alias("arpu"), _churn_rate_expr().alias("monthly_churn_rate"))
    return r.select("arpu", "monthly_churn_rate", _clv_expr(C("arpu"), C("monthly_churn_rate")).alias("clv"))


def funnel_rates(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    st = C("funnel_stage")
    g = t.users.agg(F.count(F.lit(1)).alias("signup_total"),
                    count_when(st.isin(*S.LOGIN_STAGES)).alias("login_total"),
                    count_when(st.isin(*S.PAID_STAGES)).alias("paid_total"),
                    count_when(st == "Renewal").alias("renewal_total"))
    return g.select("*",
                    _guard(C("login_total"), C("signup_total"), 100.0).alias("signup_to_login"),
                    _guard(C("paid_total"), C("login_total"), 100.0).alias("login_to_paid"),
                    _guard(C("renewal_total"), C("paid_total"), 100.0).alias("paid_to_renewal"))


def ab_metrics(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Per experiment group. Group membership is a semi join on the group's user ids."""
    u = t.users
    size = u.groupBy("experiment_group").agg(
        F.count(F.lit(1)).alias("Users"),
        count_when(C("funnel_stage").isin(*S.PAID_STAGES)).alias("_paid"))
    ids = u.select("experiment_group", "user_id").distinct()
    sess = t.user_sessions.groupBy("user_id").agg(
        F.sum("session_duration_minutes").alias("sm"),
        F.count("session_duration_minutes").alias("cm"),
        F.max(F.when(C("session_date") >= lit_date(p.month_start), 1).otherwise(0)).alias("ret"))
    rev = (t.transactions.where(C("status") == "Success")
           .groupBy("user_id").agg(F.sum("amount").alias("rev")))
    per = (ids.join(sess, "user_id", "left").join(rev, "user_id", "left")
           .groupBy("experiment_group").agg(F.sum("sm").alias("_sm"), F.sum("cm").alias("_cm"),
                                            F.coalesce(F.sum("ret"), F.lit(0)).alias("_ret"),
                                            F.coalesce(F.sum("rev"), F.lit(0)).alias("_rev")))
    j = size.join(per, "experiment_group")
    return j.select(
        C("experiment_group").alias("Group"), "Users",
        _guard(C("_paid"), C("Users"), 100.0).alias("Conversion_Rate"),
        _guard(C("_rev").cast("double"), C("Users")).alias("Revenue_Per_User"),
        F.try_divide(C("_sm").cast("double"), C("_cm").cast("double")).alias("Avg_Session_Duration_Mins"),
        _guard(C("_ret"), C("Users"), 100.0).alias("Retention_Rate"))


def _cohort_activity(t: Tables) -> DataFrame:
    """Distinct active users per (signup cohort, months since signup)."""
    act = t.user_sessions.select("user_id", month_start("session_date").alias("am")).distinct()
    coh = t.users.select("user_id", month_start("signup_date").alias("sc")).distinct()
    j = act.join(coh, "user_id")
    g = (j.groupBy(C("sc"), months_between_keys(C("am"), C("sc")).alias("cohort_period"))
         .agg(F.countDistinct("user_id").alias("active_users")))
    return g.select(month_key("sc").alias("signup_cohort"), "cohort_period", "active_users")


def cohort_retention_long(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Denominator as written: a cohort's active users in the first period column
    (period 0 whenever activity never precedes signup), so values can pass 100."""
    a = _cohort_activity(t)
    first = a.agg(F.min("cohort_period").alias("_p0"))
    a = a.withColumn("_p0", scalar(first, "_p0"))
    w = Window.partitionBy("signup_cohort")  # one cohort's periods: months, a small bounded set
    base = F.max(F.when(C("cohort_period") == C("_p0"), C("active_users"))).over(w)
    return a.select("signup_cohort", "cohort_period", "active_users",
                    (C("active_users").cast("double") / base.cast("double") * F.lit(100.0))
                    .alias("retention_pct"))


def cohort_retention_by_size(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Denominator by the dictionary's definition: users who signed up in the cohort month."""
    a = _cohort_activity(t)
    size = (t.users.groupBy(month_start("signup_date").alias("_m"))
            .agg(F.countDistinct("user_id").alias("cohort_size"))
            .select(month_key("_m").alias("signup_cohort"), "cohort_size"))
    return a.join(size, "signup_cohort").select(
        "signup_cohort", "cohort_period", "active_users", "cohort_size",
        (C("active_users").cast("double") / C("cohort_size").cast("double") * F.lit(100.0))
        .alias("retention_pct"))


def cohort_retention_matrix(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Cohort x period matrix of ``cohort_retention_long``; NULL where a cohort had no activity.
    One column for each period the declared months allow; a row outside them is an error."""
    k = C("cohort_period")
    allowed = k.between(p.cohort_periods[0], p.cohort_periods[-1])
    inside = F.when(allowed, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("activity outside the Period's cohort months, period "), k.cast("string"))).cast("boolean"))
    return cohort_retention_long(t, p).where(inside).groupBy("signup_cohort").agg(
        *[F.max(F.when(k == i, C("retention_pct"))).alias(str(i)) for i in p.cohort_periods])


def monthly_mrr(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return (t.transactions.where(C("status") == "Success")
            .groupBy(month_start("transaction_date").alias("_m"))
            .agg(F.sum("amount").cast("double").alias("amount"))
            .select(month_key("_m").alias("month"), "amount").orderBy("month"))


KPI_LABELS = ["DAU", "MAU", "Stickiness (DAU/MAU)", "Monthly Churn Rate", "MRR", "ARPU", "CLV",
              "Signup-to-Login", "Login-to-Paid", "Paid-to-Renewal"]


def kpi_wide(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    f = funnel_rates(t, p).select("signup_to_login", "login_to_paid", "paid_to_renewal")
    base = one_row(avg_dau(t, p), avg_mau(t, p), _churn_counts(t, p), period_revenue(t, p),
                   _month_mau(t, p), f)
    r = base.select("*", _stickiness_expr().alias("_stick"), _churn_rate_expr().alias("_rate"),
                    _arpu_expr().alias("_arpu"))
    return r.select(
        C("avg_dau").alias("DAU"), C("avg_mau").alias("MAU"),
        C("_stick").alias("Stickiness (DAU/MAU)"),
        C("_rate").alias("Monthly Churn Rate"), C("mrr").alias("MRR"),
        C("_arpu").alias("ARPU"), _clv_expr(C("_arpu"), C("_rate")).alias("CLV"),
        C("signup_to_login").alias("Signup-to-Login"), C("login_to_paid").alias("Login-to-Paid"),
        C("paid_to_renewal").alias("Paid-to-Renewal"))


def kpi_summary(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return unpivot(kpi_wide(t, p), [], KPI_LABELS, "KPI", "Value")


PLANS = {
    "avg_dau": avg_dau,
    "avg_mau": avg_mau,
    "stickiness": stickiness,
    "monthly_churn_rate": monthly_churn_rate,
    "period_revenue": period_revenue,
    "period_arpu": period_arpu,
    "clv": clv,
    "funnel_rates": funnel_rates,
    "ab_metrics": ab_metrics,
    "cohort_retention_long": cohort_retention_long,
    "cohort_retention_by_size": cohort_retention_by_size,
    "cohort_retention_matrix": cohort_retention_matrix,
    "monthly_mrr": monthly_mrr,
    "kpi_summary": kpi_summary,
}
