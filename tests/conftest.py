import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from subscope import schema as S  # noqa: E402
from subscope.session import build_session  # noqa: E402
from subscope.sources.binding import Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s


D = dt.date


def _ts(y, m, d, h=0, mi=0, s=0):
    return dt.datetime(y, m, d, h, mi, s)


# Hand-made tables that reach the edges the driver data does not: a user with two
# subscriptions of one plan, one with two plans, a user without sessions, a user
# without a subscription, orphan rows, NULL end dates and scores, ties at rank 3,
# a cohort with no period-0 activity, an unknown funnel stage, repeated rows/keys.
FIXTURE_ROWS = {
    "users": [
        (1, D(2001, 4, 10), "Google Ads", 24, "US", "A", "Renewal"),
        (2, D(2001, 5, 3), "Referral", 25, "US", "B", "Subscription"),
        (3, D(2001, 5, 20), "Referral", 50, "CA", "A", "Signup"),
        (4, D(2001, 6, 5), "LinkedIn", 51, "CA", "B", "First Login"),
        (5, D(2001, 3, 1), "Google Ads", 36, "DE", "A", "Feature Adoption"),
        (6, D(2001, 2, 15), "Email Campaign", 18, "DE", "B", "Email Verification"),
        (7, D(2001, 1, 9), "Organic Search", 35, "US", "A", "Legacy"),
    ],
    "subscriptions": [
        (101, 1, "Enterprise", D(2001, 4, 10), D(2001, 6, 15), "Churned"),
        (102, 2, "Pro", D(2001, 5, 3), None, "Active"),
        (202, 2, "Pro", D(2001, 5, 3), None, "Active"),
        (103, 3, "Free", D(2001, 5, 20), None, "Active"),
        (203, 3, "Pro", D(2001, 5, 20), D(2001, 6, 20), "Churned"),
        (104, 4, "Free", D(2001, 6, 5), None, "Expired"),
        (105, 5, "Pro", D(2001, 3, 1), D(2001, 5, 31), "Churned"),
        (106, 6, "Free", D(2001, 2, 15), None, "Active"),
        (108, 8, "Pro", D(2001, 1, 1), None, "Active"),
    ],
    "user_sessions": [
        (1, 1, D(2001, 6, 1), 30), (2, 1, D(2001, 6, 2), 30), (3, 1, D(2001, 6, 20), 45),
        (4, 2, D(2001, 6, 1), 45), (5, 2, D(2001, 6, 17), 60), (6, 2, D(2001, 5, 10), 20),
        (7, 3, D(2001, 6, 30), 60), (8, 3, D(2001, 5, 21), 10),
        (9, 5, D(2001, 3, 5), 5), (10, 5, D(2001, 4, 1), 45),
        (11, 6, D(2001, 4, 2), 50), (12, 7, D(2001, 6, 10), 15),
        (12, 7, D(2001, 6, 10), 15), (13, 9, D(2001, 6, 11), 200),
    ],
    "transactions": [
        (1, 1, D(2001, 6, 5), Decimal("199.00"), "Success"),
        (2, 1, D(2001, 6, 6), Decimal("199.00"), "Failed"),
        (3, 2, D(2001, 6, 10), Decimal("29.00"), "Success"),
        (4, 2, D(2001, 5, 10), Decimal("29.00"), "Success"),
        (5, 2, D(2001, 6, 11), Decimal("29.00"), "Refunded"),
        (6, 3, D(2001, 6, 1), Decimal("29.01"), "Success"),
        (7, 5, D(2001, 4, 1), Decimal("29.00"), "Failed"),
        (8, 9, D(2001, 6, 2), Decimal("10.00"), "Success"),
    ],
    "support_tickets": [
        (1, 1, D(2001, 6, 3), "Billing", Decimal("24.00"), None),
        (2, 1, D(2001, 6, 4), "Technical", Decimal("3.50"), 5),
        (3, 2, D(2001, 6, 1), "Account", Decimal("30.25"), 1),
        (4, 2, D(2001, 6, 8), "Billing", Decimal("12.00"), 2),
        (5, 2, D(2001, 6, 9), "Billing", Decimal("48.00"), 3),
        (6, 2, D(2001, 5, 1), "FeatureRequest", Decimal("1.00"), None),
        (7, 2, D(2001, 4, 1), "Technical", Decimal("5.55"), 4),
        (8, 3, D(2001, 6, 2), "Account", Decimal("30.00"), 5),
    ],
    "feature_events": [
        (1, 1, "Dashboard", _ts(2001, 4, 11, 9), 30), (2, 1, "Dashboard", _ts(2001, 6, 1, 9), 45),
        (3, 1, "Export", _ts(2001, 4, 12, 10), 60), (4, 2, "Export", _ts(2001, 5, 4), 20),
        (5, 2, "Export", _ts(2001, 6, 4), 25), (6, 2, "Export", _ts(2001, 6, 5), 25),
        (7, 2, "Search", _ts(2001, 6, 6), 120), (8, 3, "Reports", _ts(2001, 6, 7), 15),
        (9, 7, "Settings", _ts(2001, 6, 8), 5),
    ],
}


def _hot_rows():
    """The edge tables plus a hot user (2) who holds about a third of all sessions,
    events, transactions and tickets (with repeated values, ties and NULLs)."""
    rows = {k: list(v) for k, v in FIXTURE_ROWS.items()}
    for i in range(300):
        rows["user_sessions"].append((1000 + i, 2, D(2001, 4 + i % 3, 1 + i % 28), 5 + i % 50))
        rows["feature_events"].append((1000 + i, 2, ["Export", "Search", "Dashboard"][i % 3],
                                       _ts(2001, 5, 3 + i % 20, i % 24), 5 + i % 90))
    for i in range(60):
        rows["transactions"].append((1000 + i, 2, D(2001, 5 + i % 2, 1 + i % 28), Decimal("29.00") + i,
                                     ["Success", "Failed", "Refunded"][i % 3]))
        rows["support_tickets"].append((1000 + i, 2, D(2001, 6, 1 + i % 28), ["Billing", "Account"][i % 2],
                                        Decimal(f"{i % 40}.{i % 100:02d}"), None if i % 7 == 0 else 1 + i % 5))
    for i in range(200):
        rows["user_sessions"].append((5000 + i, 10 + i % 40, D(2001, 6, 1 + i % 30), 5 + i % 40))
    return rows


FIXTURES = {"edge": FIXTURE_ROWS, "hot": _hot_rows()}
ORDER = ["users", "subscriptions", "user_sessions", "transactions", "support_tickets", "feature_events"]


@pytest.fixture(scope="session")
def fixture_tables(spark):
    return Tables(*(spark.createDataFrame(FIXTURE_ROWS[n], S.SCHEMAS[n]) for n in ORDER))


@pytest.fixture(scope="session", params=sorted(FIXTURES))
def fixture_pair(request, spark):
    """(Spark tables, DuckDB connection) over the same hand-made rows."""
    import duckdb
    rows = FIXTURES[request.param]
    con = duckdb.connect()
    for name in ORDER:
        fields = S.SCHEMAS[name].fields
        con.execute(f"CREATE TABLE {name} (" + ", ".join(f"{f.name} {_duck_type(f.dataType)}" for f in fields) + ")")
        con.executemany(f"INSERT INTO {name} VALUES (" + ", ".join("?" for _ in fields) + ")", rows[name])
    tables = Tables(*(spark.createDataFrame(rows[n], S.SCHEMAS[n]) for n in ORDER))
    return tables, con


def _duck_type(dt_):
    from pyspark.sql import types as T
    if isinstance(dt_, T.LongType):
        return "BIGINT"
    if isinstance(dt_, T.IntegerType):
        return "INTEGER"
    if isinstance(dt_, T.DecimalType):
        return f"DECIMAL({dt_.precision},{dt_.scale})"
    if isinstance(dt_, T.DateType):
        return "DATE"
    if isinstance(dt_, (T.TimestampNTZType, T.TimestampType)):
        return "TIMESTAMP"
    return "VARCHAR"


@pytest.fixture(scope="session")
def fixture_duck():
    import duckdb
    con = duckdb.connect()
    for name, rows in FIXTURE_ROWS.items():
        fields = S.SCHEMAS[name].fields
        con.execute(f"CREATE TABLE {name} (" + ", ".join(f"{f.name} {_duck_type(f.dataType)}" for f in fields) + ")")
        con.executemany(f"INSERT INTO {name} VALUES (" + ", ".join("?" for _ in fields) + ")", rows)
    return con


@pytest.fixture(scope="session")
def duck_small():
    from subscope.oracle.compare import duck_connection
    return duck_connection(SF_SMALL)
