"""The binding of FIXTURES.md section 3 as DuckDB CTE text.

Each oracle statement is ``WITH <these CTEs>, <its own CTEs> SELECT ...`` over
the driver's pre-registered views, so it stands alone.
"""

from __future__ import annotations

from subscope.params import DEFAULT_PERIOD, Period


def binding_ctes() -> str:
    return """
user_sessions AS (
  SELECT CAST(l.l_orderkey*10 + l.l_linenumber AS BIGINT) AS session_id,
         o.o_custkey AS user_id,
         CAST(l.l_shipdate AS DATE) AS session_date,
         CAST(5 + l.l_partkey%51 + CASE WHEN (l.l_orderkey+l.l_linenumber)%97=0 THEN 120 ELSE 0 END AS INT)
           AS session_duration_minutes
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
users AS (
  SELECT c.c_custkey AS user_id,
         COALESCE(f.d, DATE '1995-01-01') - CAST(c.c_custkey%45 AS INT) AS signup_date,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Organic Search' WHEN 'BUILDING' THEN 'Google Ads'
              WHEN 'FURNITURE' THEN 'LinkedIn' WHEN 'HOUSEHOLD' THEN 'Referral'
              ELSE 'Email Campaign' END AS signup_channel,
         CAST(18 + c.c_custkey%47 AS INT) AS age,
         n.n_name AS country,
         CASE WHEN c.c_custkey%2=0 THEN 'A' ELSE 'B' END AS experiment_group,
         CASE WHEN c.c_custkey%17 = 0 THEN 'Signup'
              WHEN c.c_custkey%17 = 1 THEN 'Email Verification'
              WHEN c.c_custkey%17 = 2 THEN 'First Login'
              WHEN c.c_custkey%17 BETWEEN 3 AND 8 THEN 'Feature Adoption'
              WHEN c.c_custkey%17 BETWEEN 9 AND 13 THEN 'Subscription'
              ELSE 'Renewal' END AS funnel_stage
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (SELECT user_id, MIN(session_date) AS d FROM user_sessions GROUP BY user_id) f
    ON f.user_id = c.c_custkey
),
subscriptions AS (
  SELECT u.user_id AS subscription_id, u.user_id,
         CASE WHEN u.funnel_stage IN ('Subscription','Renewal')
              THEN CASE WHEN c.c_acctbal > 7500 THEN 'Enterprise' ELSE 'Pro' END
              ELSE 'Free' END AS plan_type,
         u.signup_date AS start_date,
         CASE WHEN u.user_id%7 >= 4 THEN NULL ELSE l.d END AS end_date,
         CASE WHEN u.user_id%7 <= 2 THEN 'Churned' WHEN u.user_id%7 = 3 THEN 'Expired'
              ELSE 'Active' END AS status
  FROM users u JOIN customer c ON c.c_custkey = u.user_id
  LEFT JOIN (SELECT user_id, MAX(session_date) AS d FROM user_sessions GROUP BY user_id) l
    ON l.user_id = u.user_id
  UNION ALL
  SELECT u.user_id + 10000000, u.user_id, 'Pro', u.signup_date, CAST(NULL AS DATE), 'Active'
  FROM users u WHERE u.user_id%29 = 0
),
transactions AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS user_id,
         CAST(o_orderdate AS DATE) AS transaction_date,
         CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Failed' ELSE 'Refunded' END AS status
  FROM orders
),
support_tickets AS (
  SELECT o_orderkey AS ticket_id, o_custkey AS user_id,
         CAST(o_orderdate AS DATE) AS ticket_date,
         CASE o_orderkey%4 WHEN 0 THEN 'Billing' WHEN 1 THEN 'Technical' WHEN 2 THEN 'Account'
              ELSE 'FeatureRequest' END AS category,
         CAST(((o_orderkey*4801)%7200)/100.0 AS DECIMAL(5,2)) AS resolution_time_hours,
         CASE WHEN o_orderkey%13=0 THEN NULL ELSE CAST(1+o_orderkey%5 AS INT) END AS satisfaction_score
  FROM orders
  WHERE o_orderpriority = '1-URGENT'
),
feature_events AS (
  SELECT event_id, user_id,
         CASE event_type WHEN 'view' THEN 'Dashboard' WHEN 'click' THEN 'Export'
              WHEN 'purchase' THEN 'Reports' WHEN 'signup' THEN 'Settings' ELSE 'Search' END AS feature_name,
         ts AS event_time,
         CAST(floor(value) AS INT) AS time_spent_seconds
  FROM events
)"""


_BOUND = {"on": True}


class unbound:
    """Within this block, statements omit the binding CTEs: the six model tables
    are expected to exist as tables/views (used for hand-made test fixtures)."""

    def __enter__(self):
        _BOUND["on"] = False

    def __exit__(self, *exc):
        _BOUND["on"] = True


def with_binding(body: str, ctes: str = "", period: Period = DEFAULT_PERIOD) -> str:
    """Stand-alone statement: binding CTEs, then the query's own CTEs, then the body."""
    own = ctes.strip().rstrip(",")
    if not _BOUND["on"]:
        return f"WITH {own}\n{body.strip()}" if own else body.strip()
    own = f",\n{own}" if own else ""
    return f"WITH {binding_ctes().strip()}{own}\n{body.strip()}"


def half_up_sql(num: str, den: str, scale: int = 2, factor: int = 1) -> str:
    """DuckDB text of ``subscope.functions.half_up``."""
    k = 2 * factor * 10 ** scale
    n = f"CAST({num} AS HUGEINT)"
    return (f"(CASE WHEN ({den}) = 0 THEN NULL ELSE "
            f"CAST(sign({n}) * ((abs({n}) * {k} + ({den})) // (2 * CAST({den} AS HUGEINT))) AS DOUBLE)"
            f" / {10 ** scale} END)")


def pct_sql(num: str, den: str, scale: int = 2) -> str:
    return half_up_sql(num, den, scale, 100)


def money_sql(amount_sum: str, den: str) -> str:
    """DuckDB text of ``subscope.functions.half_up_money`` (scale 2)."""
    c = f"CAST(({amount_sum}) * 100 AS HUGEINT)"
    return (f"(CASE WHEN ({den}) = 0 THEN NULL ELSE "
            f"CAST(({c} * 2 + ({den})) // (2 * CAST({den} AS HUGEINT)) AS DOUBLE) / 100 END)")
