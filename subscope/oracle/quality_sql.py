"""Oracle SQL for the data-quality audit."""

from __future__ import annotations

from subscope import schema as S
from subscope.oracle.binding import pct_sql as pct, with_binding
from subscope.params import DEFAULT_PERIOD, Period

TABLES = ["users", "subscriptions", "user_sessions", "transactions", "support_tickets", "feature_events"]


def sql(p: Period = DEFAULT_PERIOD) -> dict[str, str]:
    q = {}
    parts = []
    for t in TABLES:
        for f in S.SCHEMAS[t].fields:
            c = f.name
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"COUNT(*) - COUNT({c}) AS missing_count, "
                         f"{pct(f'COUNT(*) - COUNT({c})', 'COUNT(*)')} AS missing_pct FROM {t}")
    q["missing_values_audit"] = with_binding(
        "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE missing_count > 0")

    q["duplicate_rows_audit"] = with_binding("\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST((SELECT COUNT(*) FROM {t}) - "
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {t})) AS BIGINT) AS duplicate_rows" for t in TABLES))

    q["drop_duplicates"] = with_binding("\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {t}) AS rows_before, "
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {t})) AS rows_after" for t in TABLES))

    parts = []
    for t, c in [("user_sessions", "session_duration_minutes"), ("feature_events", "time_spent_seconds"),
                 ("support_tickets", "resolution_time_hours")]:
        parts.append(f"""
SELECT '{t}' AS table_name, '{c}' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3,
       round(q3 - q1, 6) AS iqr, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
       (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {t}) x
         WHERE CAST(x.{c} AS DOUBLE) > q3 + 1.5 * (q3 - q1)) AS outlier_count,
       {pct(f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {t}) x WHERE CAST(x.{c} AS DOUBLE) > q3 + 1.5 * (q3 - q1))",
            f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {t}))")} AS outlier_pct
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
      FROM (SELECT DISTINCT * FROM {t}))""")
    q["iqr_outliers"] = with_binding("\nUNION ALL ".join(parts))

    parts = []
    for t, c in [("user_sessions", "session_duration_minutes"), ("feature_events", "time_spent_seconds")]:
        parts.append(f"""
SELECT '{t}' AS table_name, '{c}' AS column_name, round(cap, 6) AS cap_value,
       (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {t}) x WHERE CAST(x.{c} AS DOUBLE) > cap) AS rows_capped
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.99) AS cap FROM (SELECT DISTINCT * FROM {t}))""")
    q["cap_at_p99"] = with_binding("\nUNION ALL ".join(parts))

    for key, t, c in [("clean_sessions", "user_sessions", "session_duration_minutes"),
                      ("clean_events", "feature_events", "time_spent_seconds")]:
        q[key] = with_binding(f"""
SELECT d.* REPLACE (CASE WHEN {c} > cap THEN cap ELSE CAST({c} AS DOUBLE) END AS {c})
FROM (SELECT DISTINCT * FROM {t}) d,
     (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.99) AS cap FROM (SELECT DISTINCT * FROM {t}))""")
    q["clean_tickets"] = with_binding("""
SELECT d.* REPLACE (COALESCE(satisfaction_score, fill) AS satisfaction_score)
FROM (SELECT DISTINCT * FROM support_tickets) d,
     (SELECT CAST(trunc(median(CAST(satisfaction_score AS DOUBLE))) AS INTEGER) AS fill
      FROM (SELECT DISTINCT * FROM support_tickets))""")

    q["impute_median"] = with_binding("""
SELECT CAST(trunc(median(CAST(satisfaction_score AS DOUBLE))) AS BIGINT) AS median_csat,
       COUNT(*) - COUNT(satisfaction_score) AS imputed_count
FROM (SELECT DISTINCT * FROM support_tickets)""")

    parts = []
    for t in TABLES:
        pk = S.PRIMARY_KEYS[t]
        nn = " OR ".join(f"{f.name} IS NULL" for f in S.SCHEMAS[t].fields if not f.nullable)
        parts.append(f"SELECT '{t}' AS table_name, 'duplicate_key' AS check_name, "
                     f"CAST(COUNT(*) - COUNT(DISTINCT {pk}) AS BIGINT) AS violations FROM {t}")
        parts.append(f"SELECT '{t}', 'null_in_not_null', COUNT(CASE WHEN {nn} THEN 1 END) FROM {t}")
        if t != "users":
            parts.append(f"SELECT '{t}', 'orphan_user_id', COUNT(*) FROM {t} x "
                         f"WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = x.user_id)")
    q["constraint_audit"] = with_binding("\nUNION ALL ".join(parts))

    parts = []
    for t in TABLES:
        pk = S.PRIMARY_KEYS[t]
        nn = " OR ".join(f"{f.name} IS NULL" for f in S.SCHEMAS[t].fields if not f.nullable)
        one = f"SELECT '{t}' AS table_name, '{{}}' AS check_name, CAST({pk} AS VARCHAR) AS row_key, "
        parts.append(one.format("duplicate_key") + f"CAST(NULL AS BIGINT) AS user_id, count(*) AS row_count FROM {t} "
                     f"WHERE {pk} IS NOT NULL GROUP BY {pk} HAVING count(*) > 1")
        parts.append(one.format("null_in_not_null") + f"user_id, count(*) FROM {t} WHERE {nn} GROUP BY {pk}, user_id")
        if t != "users":
            parts.append(one.format("orphan_user_id") + f"user_id, count(*) FROM {t} x WHERE NOT EXISTS "
                         f"(SELECT 1 FROM users u WHERE u.user_id = x.user_id) GROUP BY {pk}, user_id")
    q["constraint_violations"] = with_binding("\nUNION ALL ".join(parts))

    q["table_row_counts"] = with_binding("\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES))
    return q
