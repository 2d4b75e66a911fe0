"""Oracle SQL for the dashboard tables."""

from __future__ import annotations

from subscope.oracle.binding import with_binding
from subscope.oracle.kpis_sql import kpi_ctes
from subscope.params import DEFAULT_PERIOD, Period


def sql(p: Period = DEFAULT_PERIOD) -> dict[str, str]:
    k = kpi_ctes(p)
    seg = """
SegBase AS (
  SELECT u.user_id, s.status, COALESCE(tk.n, 0) AS tickets
  FROM users u JOIN subscriptions s ON u.user_id = s.user_id
  LEFT JOIN (SELECT user_id, COUNT(ticket_id) AS n FROM support_tickets GROUP BY user_id) tk
    ON tk.user_id = u.user_id),
Stages AS (SELECT * FROM (VALUES ('Signup', 1), ('Email Verification', 2), ('First Login', 3),
                                 ('Feature Adoption', 4), ('Subscription', 5), ('Renewal', 6)) v(Stage, stage_order)),
Cum AS (
  SELECT st.Stage, st.stage_order,
         (SELECT COUNT(*) FROM users u JOIN Stages s2 ON u.funnel_stage = s2.Stage
           WHERE s2.stage_order >= st.stage_order) AS Users
  FROM Stages st)"""
    ctes = k + "," + seg
    q = {}
    q["paying_users"] = with_binding("""
SELECT (SELECT COUNT(*) FROM users) AS total_users,
       (SELECT COUNT(DISTINCT user_id) FROM subscriptions WHERE status = 'Active' AND plan_type <> 'Free')
         AS paying_users""")
    lc = """(SELECT COUNT(*) AS total_users,
        (SELECT COUNT(DISTINCT user_id) FROM subscriptions WHERE status = 'Churned') AS churned_users
       FROM users)"""
    q["lifetime_churn"] = with_binding(f"""
SELECT total_users, churned_users,
       CASE WHEN total_users > 0 THEN CAST(churned_users AS DOUBLE) / total_users * 100.0 ELSE 0.0 END
         AS lifetime_churn_rate
FROM {lc}""")
    q["overview_kpis"] = with_binding(f"""
SELECT l.total_users AS total_customers,
       (SELECT COUNT(DISTINCT user_id) FROM subscriptions WHERE status = 'Active' AND plan_type <> 'Free')
         AS paying_users,
       a.mrr, d.avg_dau AS dau, m.avg_mau AS mau,
       CASE WHEN m.avg_mau > 0 THEN d.avg_dau / m.avg_mau * 100.0 ELSE 0.0 END AS stickiness,
       a.arpu, l.churned_users, l.rate AS lifetime_churn_rate,
       CASE WHEN l.rate > 0 THEN a.arpu * (1.0 / (l.rate / 100.0)) ELSE 0.0 END AS clv
FROM Dau d, Mau m, Arpu a,
     (SELECT total_users, churned_users,
             CASE WHEN total_users > 0 THEN CAST(churned_users AS DOUBLE) / total_users * 100.0 ELSE 0.0 END AS rate
      FROM {lc}) l""", ctes)
    q["plan_mix"] = with_binding("""
SELECT plan_type, COUNT(*) AS count FROM (
  SELECT plan_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY subscription_id) AS rn FROM subscriptions)
WHERE rn = 1 GROUP BY plan_type ORDER BY count DESC, plan_type""")
    q["channel_counts"] = with_binding(
        "SELECT signup_channel, COUNT(*) AS count FROM users GROUP BY 1 ORDER BY count DESC, signup_channel")
    q["country_counts"] = with_binding(
        "SELECT country, COUNT(*) AS count FROM users GROUP BY 1 ORDER BY count DESC, country")
    q["channel_churn_unrounded"] = with_binding("""
SELECT u.signup_channel, COUNT(u.user_id) AS total_customers,
       COUNT(CASE WHEN s.status = 'Churned' THEN 1 END) AS churned_customers,
       CAST(COUNT(CASE WHEN s.status = 'Churned' THEN 1 END) AS DOUBLE) / COUNT(u.user_id) * 100.0 AS churn_rate
FROM users u JOIN subscriptions s ON u.user_id = s.user_id
GROUP BY u.signup_channel ORDER BY churn_rate, u.signup_channel""")
    q["cumulative_funnel"] = with_binding("""
SELECT Stage, CAST(stage_order AS INT) AS stage_order, Users,
       CAST(Users AS DOUBLE) / NULLIF((SELECT Users FROM Cum WHERE stage_order = 1), 0) * 100.0 AS pct_of_initial
FROM Cum ORDER BY stage_order""", ctes)
    q["funnel_step_rates"] = with_binding("""
SELECT CAST(u3 AS DOUBLE) / NULLIF(u1, 0) * 100.0 AS signup_to_first_login_pct,
       CAST(u5 AS DOUBLE) / NULLIF(u3, 0) * 100.0 AS login_to_premium_pct,
       CAST(u6 AS DOUBLE) / NULLIF(u5, 0) * 100.0 AS subscription_to_renewal_pct
FROM (SELECT MAX(CASE WHEN stage_order = 1 THEN Users END) AS u1,
             MAX(CASE WHEN stage_order = 3 THEN Users END) AS u3,
             MAX(CASE WHEN stage_order = 5 THEN Users END) AS u5,
             MAX(CASE WHEN stage_order = 6 THEN Users END) AS u6 FROM Cum)""", ctes)
    q["feature_clicks"] = with_binding(
        "SELECT feature_name AS Feature, COUNT(*) AS Clicks FROM feature_events GROUP BY 1 ORDER BY Clicks DESC, Feature")
    q["feature_avg_time"] = with_binding(
        "SELECT feature_name AS Feature, CAST(SUM(time_spent_seconds) AS DOUBLE) / NULLIF(COUNT(time_spent_seconds), 0) AS avg_time_secs FROM feature_events GROUP BY 1")
    q["ticket_volume"] = with_binding(
        "SELECT category, COUNT(*) AS count FROM support_tickets GROUP BY 1 ORDER BY count DESC, category")
    q["csat_distribution"] = with_binding("""
SELECT satisfaction_score, COUNT(*) AS count FROM support_tickets WHERE satisfaction_score IS NOT NULL
GROUP BY 1 ORDER BY count DESC, satisfaction_score""")
    q["ticket_segment_churn_unrounded"] = with_binding("""
SELECT CASE WHEN tickets = 0 THEN '0 Tickets' WHEN tickets <= 2 THEN '1-2 Tickets'
            WHEN tickets <= 4 THEN '3-4 Tickets' ELSE '5+ Tickets' END AS ticket_segment,
       COUNT(user_id) AS total, COUNT(CASE WHEN status = 'Churned' THEN 1 END) AS churned,
       CAST(COUNT(CASE WHEN status = 'Churned' THEN 1 END) AS DOUBLE) / COUNT(user_id) * 100.0 AS churn_rate
FROM SegBase GROUP BY 1 ORDER BY 1""", ctes)
    q["monthly_revenue_trend"] = with_binding("""
SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, CAST(SUM(amount) AS DOUBLE) AS amount
FROM transactions WHERE status = 'Success' GROUP BY 1 ORDER BY 1""")
    q["distinct_values"] = with_binding("""
SELECT DISTINCT 'country' AS column_name, country AS value FROM users
UNION ALL
SELECT DISTINCT 'signup_channel', signup_channel FROM users""")
    return q
