"""The six-table model: fixed schemas and fixed domain values."""

from __future__ import annotations

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("signup_date", T.DateType(), False),
    T.StructField("signup_channel", T.StringType(), False),
    T.StructField("age", T.IntegerType(), False),
    T.StructField("country", T.StringType(), False),
    T.StructField("experiment_group", T.StringType(), False),
    T.StructField("funnel_stage", T.StringType(), False),
])

SUBSCRIPTIONS = T.StructType([
    T.StructField("subscription_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("plan_type", T.StringType(), False),
    T.StructField("start_date", T.DateType(), False),
    T.StructField("end_date", T.DateType(), True),
    T.StructField("status", T.StringType(), False),
])

USER_SESSIONS = T.StructType([
    T.StructField("session_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("session_date", T.DateType(), False),
    T.StructField("session_duration_minutes", T.IntegerType(), False),
])

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("amount", T.DecimalType(10, 2), False),
    T.StructField("status", T.StringType(), False),
])

SUPPORT_TICKETS = T.StructType([
    T.StructField("ticket_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("ticket_date", T.DateType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("resolution_time_hours", T.DecimalType(5, 2), False),
    T.StructField("satisfaction_score", T.IntegerType(), True),
])

FEATURE_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("feature_name", T.StringType(), False),
    T.StructField("event_time", T.TimestampNTZType(), False),
    T.StructField("time_spent_seconds", T.IntegerType(), False),
])

SCHEMAS = {
    "users": USERS,
    "subscriptions": SUBSCRIPTIONS,
    "user_sessions": USER_SESSIONS,
    "transactions": TRANSACTIONS,
    "support_tickets": SUPPORT_TICKETS,
    "feature_events": FEATURE_EVENTS,
}

# Primary keys, as declared by the model's DDL.
PRIMARY_KEYS = {
    "users": "user_id",
    "subscriptions": "subscription_id",
    "user_sessions": "session_id",
    "transactions": "transaction_id",
    "support_tickets": "ticket_id",
    "feature_events": "event_id",
}

# CSV exports carry no surrogate key except users.user_id.
CSV_DROPPED_KEYS = {k: v for k, v in PRIMARY_KEYS.items() if k != "users"}

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (domains and labels).
# ---------------------------------------------------------------------------
FEATURES = ["Dashboard", "Reports", "Export", "Settings", "Search", "Integrations"]
FUNNEL_STAGES = ["Signup", "Email Verification", "First Login", "Feature Adoption",
                 "Subscription", "Renewal"]
LOGIN_STAGES = ["First Login", "Feature Adoption", "Subscription", "Renewal"]
PAID_STAGES = ["Subscription", "Renewal"]
UNKNOWN_STAGE_ORDER = 7
TICKET_SEGMENTS_SQL = ["0 Tickets", "1-2 Tickets", "3-4 Tickets", "5+ Tickets (Friction)"]
TICKET_SEGMENTS_DASH = ["0 Tickets", "1-2 Tickets", "3-4 Tickets", "5+ Tickets"]
AGE_BANDS = ["Under 25", "25-35", "36-50", "Over 50"]
RISK_BANDS = ["Low", "Medium", "High"]
RISK_LOW_BELOW = 0.30
RISK_MEDIUM_BELOW = 0.70
SLA_HOURS = 24.0
IQR_FENCE = 1.5
CAP_QUANTILE = 0.99
CSAT_FILL = 3.0
CHURN_NUMERIC = ["age", "total_sessions", "avg_session_duration", "recency",
                 "total_feature_time", "avg_feature_time", "total_spend",
                 "failed_payments", "refunded_payments", "ticket_count",
                 "avg_resolution_time", "avg_satisfaction"]
CHURN_CATEGORICAL = ["signup_channel", "country", "experiment_group", "plan_type"]
