"""Oracle SQL for the KPI pipeline."""

from __future__ import annotations

from subscope.oracle.binding import with_binding
from subscope.params import DEFAULT_PERIOD, Period, sql_date


def kpi_ctes(p: Period) -> str:
    ms = sql_date(p.month_start)
    return f"""
Dau AS (SELECT CAST(SUM(n) AS DOUBLE) / NULLIF(COUNT(*), 0) AS avg_dau
        FROM (SELECT session_date, COUNT(DISTINCT user_id) AS n FROM user_sessions GROUP BY 1)),
Mau AS (SELECT CAST(SUM(n) AS DOUBLE) / NULLIF(COUNT(*), 0) AS avg_mau
        FROM (SELECT strftime(session_date, '%Y-%m') AS m, COUNT(DISTINCT user_id) AS n
              FROM user_sessions GROUP BY 1)),
Churn AS (SELECT churned_in_month, active_at_start,
                 CASE WHEN active_at_start > 0
                      THEN CAST(churned_in_month AS DOUBLE) / active_at_start * 100.0 ELSE 0.0 END
                   AS monthly_churn_rate
          FROM (SELECT COUNT(CASE WHEN status = 'Churned' AND strftime(end_date, '%Y-%m') = '{p.month}' THEN 1 END)
                         AS churned_in_month,
                       COUNT(CASE WHEN start_date < {ms} AND (status = 'Active' OR end_date >= {ms}) THEN 1 END)
                         AS active_at_start
                FROM subscriptions)),
Mrr AS (SELECT COALESCE(CAST(SUM(amount) AS DOUBLE), 0.0) AS mrr FROM transactions
        WHERE status = 'Success' AND strftime(transaction_date, '%Y-%m') = '{p.month}'),
MonthMau AS (SELECT COUNT(DISTINCT user_id) AS month_mau FROM user_sessions
             WHERE strftime(session_date, '%Y-%m') = '{p.month}'),
Arpu AS (SELECT mrr, month_mau,
                CASE WHEN month_mau > 0 THEN mrr / month_mau ELSE 0.0 END AS arpu
         FROM Mrr, MonthMau),
Clv AS (SELECT arpu, monthly_churn_rate,
               CASE WHEN monthly_churn_rate > 0 THEN arpu * (1.0 / (monthly_churn_rate / 100.0)) ELSE 0.0 END
                 AS clv
        FROM Arpu, Churn),
Funnel AS (SELECT signup_total, login_total, paid_total, renewal_total,
                  CASE WHEN signup_total > 0 THEN CAST(login_total AS DOUBLE) / signup_total * 100.0 ELSE 0.0 END
                    AS signup_to_login,
                  CASE WHEN login_total > 0 THEN CAST(paid_total AS DOUBLE) / login_total * 100.0 ELSE 0.0 END
                    AS login_to_paid,
                  CASE WHEN paid_total > 0 THEN CAST(renewal_total AS DOUBLE) / paid_total * 100.0 ELSE 0.0 END
                    AS paid_to_renewal
           FROM (SELECT COUNT(*) AS signup_total,
                        COUNT(CASE WHEN funnel_stage IN ('First Login','Feature Adoption','Subscription','Renewal') THEN 1 END) AS login_total,
                        COUNT(CASE WHEN funnel_stage IN ('Subscription','Renewal') THEN 1 END) AS paid_total,
                        COUNT(CASE WHEN funnel_stage = 'Renewal' THEN 1 END) AS renewal_total
                 FROM users)),
CohortActivity AS (
  SELECT strftime(u.sc, '%Y-%m') AS signup_cohort,
         CAST(12 * (year(a.am) - year(u.sc)) + (month(a.am) - month(u.sc)) AS BIGINT) AS cohort_period,
         COUNT(DISTINCT a.user_id) AS active_users
  FROM (SELECT DISTINCT user_id, date_trunc('month', session_date) AS am FROM user_sessions) a
  JOIN (SELECT DISTINCT user_id, date_trunc('month', signup_date) AS sc FROM users) u
    ON a.user_id = u.user_id
  GROUP BY 1, 2),
CohortLong AS (
  SELECT c.signup_cohort, c.cohort_period, c.active_users,
         CAST(c.active_users AS DOUBLE) / b.active_users * 100.0 AS retention_pct
  FROM CohortActivity c
  LEFT JOIN CohortActivity b ON b.signup_cohort = c.signup_cohort
   AND b.cohort_period = (SELECT MIN(cohort_period) FROM CohortActivity))"""


def sql(p: Period = DEFAULT_PERIOD) -> dict[str, str]:
    ms = sql_date(p.month_start)
    ctes = kpi_ctes(p)
    q = {}
    q["avg_dau"] = with_binding("SELECT avg_dau FROM Dau", ctes)
    q["avg_mau"] = with_binding("SELECT avg_mau FROM Mau", ctes)
    q["stickiness"] = with_binding("""
SELECT avg_dau, avg_mau, CASE WHEN avg_mau > 0 THEN avg_dau / avg_mau * 100.0 ELSE 0.0 END AS stickiness
FROM Dau, Mau""", ctes)
    q["monthly_churn_rate"] = with_binding("SELECT * FROM Churn", ctes)
    q["period_revenue"] = with_binding("SELECT mrr FROM Mrr", ctes)
    q["period_arpu"] = with_binding("SELECT mrr, month_mau, arpu FROM Arpu", ctes)
    q["clv"] = with_binding("SELECT arpu, monthly_churn_rate, clv FROM Clv", ctes)
    q["funnel_rates"] = with_binding("SELECT * FROM Funnel", ctes)
    q["ab_metrics"] = with_binding(f"""
SELECT g.experiment_group AS "Group", g.n AS "Users",
       CASE WHEN g.n > 0 THEN CAST(g.paid AS DOUBLE) / g.n * 100.0 ELSE 0.0 END AS Conversion_Rate,
       CASE WHEN g.n > 0 THEN CAST(COALESCE(r.rev, 0) AS DOUBLE) / g.n ELSE 0.0 END AS Revenue_Per_User,
       CAST(s.sm AS DOUBLE) / NULLIF(s.cm, 0) AS Avg_Session_Duration_Mins,
       CASE WHEN g.n > 0 THEN CAST(COALESCE(k.ret, 0) AS DOUBLE) / g.n * 100.0 ELSE 0.0 END AS Retention_Rate
FROM (SELECT experiment_group, COUNT(*) AS n,
             COUNT(CASE WHEN funnel_stage IN ('Subscription','Renewal') THEN 1 END) AS paid
      FROM users GROUP BY 1) g
LEFT JOIN (SELECT i.experiment_group, SUM(t.amount) AS rev
           FROM (SELECT DISTINCT experiment_group, user_id FROM users) i
           JOIN transactions t ON t.user_id = i.user_id AND t.status = 'Success' GROUP BY 1) r
  ON r.experiment_group = g.experiment_group
LEFT JOIN (SELECT i.experiment_group, SUM(us.session_duration_minutes) AS sm,
                  COUNT(us.session_duration_minutes) AS cm
           FROM (SELECT DISTINCT experiment_group, user_id FROM users) i
           JOIN user_sessions us ON us.user_id = i.user_id GROUP BY 1) s
  ON s.experiment_group = g.experiment_group
LEFT JOIN (SELECT i.experiment_group, COUNT(DISTINCT us.user_id) AS ret
           FROM (SELECT DISTINCT experiment_group, user_id FROM users) i
           JOIN user_sessions us ON us.user_id = i.user_id AND us.session_date >= {ms} GROUP BY 1) k
  ON k.experiment_group = g.experiment_group""")
    q["cohort_retention_long"] = with_binding("SELECT * FROM CohortLong", ctes)
    q["cohort_retention_by_size"] = with_binding("""
SELECT c.signup_cohort, c.cohort_period, c.active_users, z.cohort_size,
       CAST(c.active_users AS DOUBLE) / z.cohort_size * 100.0 AS retention_pct
FROM CohortActivity c
JOIN (SELECT strftime(signup_date, '%Y-%m') AS signup_cohort, COUNT(DISTINCT user_id) AS cohort_size
      FROM users GROUP BY 1) z ON z.signup_cohort = c.signup_cohort""", ctes)
    cells = ", ".join(f'MAX(CASE WHEN cohort_period = {i} THEN retention_pct END) AS "{i}"' for i in p.cohort_periods)
    q["cohort_retention_matrix"] = with_binding(f"SELECT signup_cohort, {cells} FROM CohortLong GROUP BY signup_cohort", ctes)
    q["monthly_mrr"] = with_binding("""
SELECT strftime(transaction_date, '%Y-%m') AS month, CAST(SUM(amount) AS DOUBLE) AS amount
FROM transactions WHERE status = 'Success' GROUP BY 1 ORDER BY 1""")
    q["kpi_summary"] = with_binding("""
SELECT * FROM (
  SELECT 'DAU' AS KPI, avg_dau AS Value FROM Dau
  UNION ALL SELECT 'MAU', avg_mau FROM Mau
  UNION ALL SELECT 'Stickiness (DAU/MAU)', CASE WHEN avg_mau > 0 THEN avg_dau / avg_mau * 100.0 ELSE 0.0 END FROM Dau, Mau
  UNION ALL SELECT 'Monthly Churn Rate', monthly_churn_rate FROM Churn
  UNION ALL SELECT 'MRR', mrr FROM Mrr
  UNION ALL SELECT 'ARPU', arpu FROM Arpu
  UNION ALL SELECT 'CLV', clv FROM Clv
  UNION ALL SELECT 'Signup-to-Login', signup_to_login FROM Funnel
  UNION ALL SELECT 'Login-to-Paid', login_to_paid FROM Funnel
  UNION ALL SELECT 'Paid-to-Renewal', paid_to_renewal FROM Funnel)""", ctes)
    return q
