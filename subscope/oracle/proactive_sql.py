"""Oracle SQL for the report-stated analyses."""

from __future__ import annotations

from subscope.oracle.binding import half_up_sql as hu, money_sql as money, pct_sql as pct, with_binding
from subscope.params import DEFAULT_PERIOD, Period, sql_date

CHURNED = "(SELECT user_id, MAX(CASE WHEN status = 'Churned' THEN 1 ELSE 0 END) AS churned FROM subscriptions GROUP BY user_id)"


def _by_flag(flag_sql: str, flag: str) -> str:
    return f"""
SELECT f.{flag}, COUNT(*) AS users, CAST(COALESCE(SUM(c.churned), 0) AS BIGINT) AS churned_users,
       {pct('COALESCE(SUM(c.churned), 0)', 'COUNT(*)')} AS churn_rate_pct
FROM ({flag_sql}) f LEFT JOIN {CHURNED} c ON c.user_id = f.user_id
GROUP BY f.{flag}"""


def sql(p: Period = DEFAULT_PERIOD) -> dict[str, str]:
    asof = sql_date(p.as_of)
    last = "(SELECT user_id, MAX(session_date) AS last_session_date FROM user_sessions GROUP BY user_id)"
    q = {}
    q["inactivity_alerts"] = with_binding(f"""
SELECT * FROM (
  SELECT u.user_id, l.last_session_date, CAST({asof} - l.last_session_date AS BIGINT) AS days_inactive
  FROM (SELECT DISTINCT user_id FROM users) u LEFT JOIN {last} l ON l.user_id = u.user_id)
WHERE days_inactive IS NULL OR days_inactive >= 10""")
    q["inactivity_churn"] = with_binding(_by_flag(f"""
SELECT u.user_id, CASE WHEN l.last_session_date IS NULL OR {asof} - l.last_session_date > 14
                       THEN 'inactive' ELSE 'active' END AS activity
FROM (SELECT DISTINCT user_id FROM users) u LEFT JOIN {last} l ON l.user_id = u.user_id""", "activity"))
    q["export_first_week_churn"] = with_binding(_by_flag("""
SELECT u.user_id, CASE WHEN EXISTS (
         SELECT 1 FROM feature_events e JOIN users s ON s.user_id = e.user_id
         WHERE e.user_id = u.user_id AND e.feature_name = 'Export'
           AND e.event_time >= CAST(s.signup_date AS TIMESTAMP)
           AND e.event_time < CAST(s.signup_date + 7 AS TIMESTAMP))
       THEN 'export_first_week' ELSE 'no_export_first_week' END AS adoption
FROM (SELECT DISTINCT user_id FROM users) u""", "adoption"))
    fr = """
SELECT u.user_id, CASE WHEN u.user_id IN (
         SELECT user_id FROM (SELECT user_id, strftime(ticket_date, '%Y-%m') AS m, COUNT(*) AS n
                              FROM support_tickets GROUP BY 1, 2) GROUP BY user_id HAVING MAX(n) >= 3)
       THEN 'friction' ELSE 'no_friction' END AS friction
FROM (SELECT DISTINCT user_id FROM users) u"""
    q["ticket_friction_churn"] = with_binding(f"""
SELECT b.*, h.avg_resolution_hours FROM ({_by_flag(fr, 'friction')}) b
LEFT JOIN (SELECT f.friction, {money('SUM(t.resolution_time_hours)', 'COUNT(t.resolution_time_hours)')}
                    AS avg_resolution_hours
           FROM support_tickets t JOIN ({fr}) f ON f.user_id = t.user_id GROUP BY f.friction) h
  ON h.friction = b.friction""")
    q["plan_revenue_share"] = with_binding(f"""
SELECT plan_type, users, CAST(rev AS DOUBLE) AS revenue,
       {pct('users', 'SUM(users) OVER ()')} AS user_share_pct,
       {pct('CAST(rev * 100 AS HUGEINT)', 'CAST(SUM(rev) OVER () * 100 AS HUGEINT)')} AS revenue_share_pct
FROM (SELECT fs.plan_type, COUNT(*) AS users, COALESCE(SUM(r.rev), 0) AS rev
      FROM (SELECT user_id, plan_type FROM (
              SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY subscription_id) AS rn
              FROM subscriptions) WHERE rn = 1) fs
      LEFT JOIN (SELECT user_id, SUM(amount) AS rev FROM transactions WHERE status = 'Success' GROUP BY 1) r
        ON r.user_id = fs.user_id
      GROUP BY fs.plan_type)""")
    q["channel_arpu_tickets"] = with_binding(f"""
SELECT u.signup_channel, COUNT(*) AS users,
       {money('SUM(r.rev)', 'COUNT(*)')} AS revenue_per_user,
       {hu('COALESCE(SUM(k.nt), 0)', 'COUNT(*)', 2)} AS tickets_per_user
FROM users u
LEFT JOIN (SELECT user_id, SUM(amount) AS rev FROM transactions WHERE status = 'Success' GROUP BY 1) r
  ON r.user_id = u.user_id
LEFT JOIN (SELECT user_id, COUNT(*) AS nt FROM support_tickets GROUP BY 1) k ON k.user_id = u.user_id
GROUP BY u.signup_channel""")
    q["session_minutes_by_age_band"] = with_binding(f"""
SELECT CASE WHEN age < 25 THEN 'Under 25' WHEN age BETWEEN 25 AND 35 THEN '25-35'
            WHEN age BETWEEN 36 AND 50 THEN '36-50' ELSE 'Over 50' END AS age_group,
       COUNT(*) AS sessions,
       {hu('SUM(us.session_duration_minutes)', 'COUNT(*)', 1)} AS avg_session_minutes
FROM users u JOIN user_sessions us ON us.user_id = u.user_id GROUP BY 1""")
    return q
