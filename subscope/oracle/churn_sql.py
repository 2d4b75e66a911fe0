"""Oracle SQL for the churn features (the model entries have none)."""

from __future__ import annotations

from subscope import schema as S
from subscope.oracle.binding import with_binding
from subscope.params import DEFAULT_PERIOD, Period, sql_date


def feature_ctes(p: Period) -> str:
    pivots = ",\n         ".join(
        f"COUNT(CASE WHEN feature_name = '{f}' THEN event_id END) AS feat_{f.lower()}_clicks"
        for f in S.FEATURES)
    return f"""
Activity AS (SELECT user_id, COUNT(session_id) AS total_sessions,
                    CAST(SUM(session_duration_minutes) AS DOUBLE) / NULLIF(COUNT(session_duration_minutes), 0) AS avg_session_duration,
                    CAST({sql_date(p.as_of)} - MAX(session_date) AS BIGINT) AS recency
             FROM user_sessions GROUP BY user_id),
Clicks AS (SELECT user_id,
         {pivots}
           FROM feature_events GROUP BY user_id),
FeatTime AS (SELECT user_id, CAST(SUM(time_spent_seconds) AS BIGINT) AS total_feature_time,
                    CAST(SUM(time_spent_seconds) AS DOUBLE) / NULLIF(COUNT(time_spent_seconds), 0) AS avg_feature_time
             FROM feature_events GROUP BY user_id),
Payments AS (SELECT user_id, CAST(SUM(CASE WHEN status = 'Success' THEN amount END) AS DOUBLE) AS total_spend,
                    COUNT(CASE WHEN status = 'Failed' THEN 1 END) AS failed_payments,
                    COUNT(CASE WHEN status = 'Refunded' THEN 1 END) AS refunded_payments
             FROM transactions GROUP BY user_id),
Support AS (SELECT user_id, COUNT(ticket_id) AS ticket_count,
                   CAST(SUM(resolution_time_hours) AS DOUBLE) / NULLIF(COUNT(resolution_time_hours), 0) AS avg_resolution_time,
                   CAST(SUM(satisfaction_score) AS DOUBLE) / NULLIF(COUNT(satisfaction_score), 0) AS avg_satisfaction
            FROM support_tickets GROUP BY user_id),
FirstSub AS (SELECT user_id, plan_type, status AS sub_status FROM (
               SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY subscription_id) AS rn
               FROM subscriptions) WHERE rn = 1),
Features AS (
  SELECT u.user_id, CAST(u.age AS BIGINT) AS age, u.signup_channel, u.country, u.experiment_group,
         COALESCE(fs.plan_type, 'Free') AS plan_type,
         COALESCE(a.total_sessions, 0) AS total_sessions, COALESCE(a.recency, 0) AS recency,
         COALESCE(ft.total_feature_time, 0) AS total_feature_time,
         COALESCE(pm.failed_payments, 0) AS failed_payments,
         COALESCE(pm.refunded_payments, 0) AS refunded_payments,
         COALESCE(sp.ticket_count, 0) AS ticket_count,
         {", ".join(f"COALESCE(c.feat_{f.lower()}_clicks, 0) AS feat_{f.lower()}_clicks" for f in S.FEATURES)},
         COALESCE(a.avg_session_duration, 0.0) AS avg_session_duration,
         COALESCE(ft.avg_feature_time, 0.0) AS avg_feature_time,
         COALESCE(pm.total_spend, 0.0) AS total_spend,
         COALESCE(sp.avg_resolution_time, 0.0) AS avg_resolution_time,
         COALESCE(sp.avg_satisfaction, 3.0) AS avg_satisfaction,
         CAST(COALESCE(fs.sub_status = 'Churned', false) AS BIGINT) AS target
  FROM users u
  LEFT JOIN FirstSub fs ON fs.user_id = u.user_id
  LEFT JOIN Activity a ON a.user_id = u.user_id
  LEFT JOIN Clicks c ON c.user_id = u.user_id
  LEFT JOIN FeatTime ft ON ft.user_id = u.user_id
  LEFT JOIN Payments pm ON pm.user_id = u.user_id
  LEFT JOIN Support sp ON sp.user_id = u.user_id)"""


def sql(p: Period = DEFAULT_PERIOD) -> dict[str, str]:
    c = feature_ctes(p)
    q = {
        "activity_features": with_binding("SELECT * FROM Activity", c),
        "feature_click_pivot": with_binding("SELECT * FROM Clicks", c),
        "feature_time": with_binding("SELECT * FROM FeatTime", c),
        "payment_features": with_binding("SELECT * FROM Payments", c),
        "support_features": with_binding("SELECT * FROM Support", c),
        "first_subscription": with_binding("SELECT * FROM FirstSub", c),
        "churn_feature_table": with_binding("SELECT * FROM Features", c),
        "train_test_split": with_binding("""
SELECT user_id, target,
       CASE WHEN row_number() OVER (PARTITION BY target ORDER BY md5(CAST(user_id AS VARCHAR)), user_id)
                 <= floor(count(*) OVER (PARTITION BY target) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
FROM Features""", c),
    }
    from subscope.plans.churn import CATEGORICAL, NUMERIC
    stats = ", ".join(f"AVG(CAST({c} AS DOUBLE)) AS m_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}" for c in NUMERIC)
    zs = ", ".join(f"round(CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 0.0 ELSE (CAST(f.{c} AS DOUBLE) - m_{c}) / s_{c} END, 6)"
                   f" AS {c}_z" for c in NUMERIC)
    q["standardized_features"] = with_binding(f"SELECT f.user_id, {zs} FROM Features f, (SELECT {stats} FROM Features) st", c)
    slots = ", ".join(f"CAST(DENSE_RANK() OVER (ORDER BY {c}) - 1 AS BIGINT) AS {c}_slot" for c in CATEGORICAL)
    q["category_indexes"] = with_binding(f"SELECT user_id, {slots} FROM Features", c)
    hot = ", ".join(f"array_to_string(list_transform({c}_levels, lambda x: CASE WHEN x = {c} THEN '1' ELSE '0' END), '') "
                    f"AS {c}_one_hot" for c in CATEGORICAL)
    levels = ", ".join(f"list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)) AS {c}_levels" for c in CATEGORICAL)
    q["one_hot_features"] = with_binding(f"SELECT user_id, {hot} FROM Features, (SELECT {levels} FROM Features)", c)
    points = "(total_sessions * 7 + age * 3 + ticket_count * 11 + user_id * 13) % 100"
    scored = c + f""",
Scored AS (SELECT user_id, target AS actual, CAST({points} >= 50 AS BIGINT) AS predicted, ({points}) / 100.0 AS score FROM Features),
Cells AS (SELECT count(*) FILTER (actual = 1 AND predicted = 1) AS tp, count(*) FILTER (actual = 0 AND predicted = 1) AS fp,
                 count(*) FILTER (actual = 1 AND predicted = 0) AS fn, count(*) FILTER (actual = 0 AND predicted = 0) AS tn
          FROM Scored),
Classes AS (
  SELECT label, support, coalesce(hit / nullif(marked, 0), 0.0) AS precision, coalesce(hit / nullif(support, 0), 0.0) AS recall
  FROM (SELECT '0' AS label, CAST(tn AS DOUBLE) AS hit, tn + fp AS support, tn + fn AS marked FROM Cells
        UNION ALL SELECT '1', CAST(tp AS DOUBLE), tp + fn, tp + fp FROM Cells)
  WHERE support + marked > 0),
Report AS (SELECT label, precision, recall,
                  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1_score, support FROM Classes)"""
    q["fixed_binary_metrics"] = with_binding("""
SELECT CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy, p AS precision, r AS recall,
       coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1, tp, fp, fn, tn
FROM (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS p,
             coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS r FROM Cells)""", scored)
    q["fixed_classification_report"] = with_binding("""
SELECT label, precision, recall, f1_score, CAST(support AS BIGINT) AS support FROM Report
UNION ALL SELECT 'accuracy', NULL, NULL, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), tp + tn + fp + fn FROM Cells
UNION ALL SELECT 'macro avg', sum(precision) / count(*), sum(recall) / count(*), sum(f1_score) / count(*), CAST(sum(support) AS BIGINT) FROM Report
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM Report""", scored)
    q["fixed_confusion_matrix"] = with_binding("""
SELECT actual, count(*) FILTER (predicted = 0) AS predicted_0, count(*) FILTER (predicted = 1) AS predicted_1
FROM Scored GROUP BY actual""", scored)
    q["fixed_risk_band_counts"] = with_binding(f"""
SELECT CASE WHEN score < {S.RISK_LOW_BELOW} THEN '{S.RISK_BANDS[0]}' WHEN score < {S.RISK_MEDIUM_BELOW} THEN '{S.RISK_BANDS[1]}' ELSE '{S.RISK_BANDS[2]}' END AS risk_band, count(*) AS users FROM Scored GROUP BY 1""", scored)
    return q
