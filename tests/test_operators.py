"""Operators: exact rounding, exact quantiles, top-k with ties, keep-first, unpivot."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from subscope.functions import half_up, half_up_money
from subscope.operators import exact_quantiles, first_by_key, unpivot
from subscope.operators.dedup import duplicate_count
from subscope.oracle.binding import half_up_sql, money_sql


def _dec_round(num, den, scale, factor):
    q = Decimal(num) * factor / Decimal(den)
    return float(q.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**6)), min_size=1, max_size=20),
       st.integers(0, 3), st.sampled_from([1, 100]))
def test_half_up_is_exact(spark, pairs, scale, factor):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(half_up(F.col("n"), F.col("d"), scale, factor)).collect()]
    want = [_dec_round(n, d, scale, factor) for n, d in pairs]
    assert got == want


def test_half_up_duckdb_text_agrees(spark):
    import duckdb
    pairs = [(1005, 1000), (1, 8), (5, 2000), (-5, 2000), (2, 3), (0, 7)]
    df = spark.createDataFrame(pairs, "n long, d long")
    sp = [r[0] for r in df.select(half_up(F.col("n"), F.col("d"), 2, 1)).collect()]
    con = duckdb.connect()
    dd = [con.execute(f"SELECT {half_up_sql(str(n), str(d), 2, 1)}").fetchone()[0] for n, d in pairs]
    assert sp == dd


def test_money_rounding(spark):
    import duckdb
    df = spark.createDataFrame([(Decimal("10.05"), 2), (Decimal("0.01"), 2), (Decimal("100.00"), 3)],
                               "a decimal(20,2), n long")
    sp = [r[0] for r in df.select(half_up_money(F.col("a"), F.col("n"))).collect()]
    assert sp == [5.03, 0.01, 33.33]
    con = duckdb.connect()
    dd = [con.execute(f"SELECT {money_sql(f'CAST({a} AS DECIMAL(20,2))', str(n))}").fetchone()[0]
          for a, n in [("10.05", 2), ("0.01", 2), ("100.00", 3)]]
    assert dd == sp


def test_exact_quantiles_match_pandas_with_heavy_value(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 500, 5000).astype(float)
    x[:1700] = 42.0  # one value holds a third of the rows
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = [pd.Series(x).quantile(p) for p in probs]
    for buckets in [None, 2, 32]:
        got = exact_quantiles(df, "x", probs, [f"q{i}" for i in range(len(probs))], buckets=buckets).collect()[0]
        assert np.allclose(list(got), want, rtol=0, atol=1e-9), buckets


def test_exact_quantiles_ignore_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (3.0,), (1.0,)], "x double")
    empty = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5], ["m"]).collect()[0]["m"] == 2.0
    assert exact_quantiles(empty, "x", [0.5], ["m"]).collect()[0]["m"] is None


def test_first_by_key_and_duplicates(spark):
    df = spark.createDataFrame([(1, 20, "x"), (1, 10, "y"), (2, 5, "z"), (2, 5, "z")], "k long, o long, v string")
    got = sorted(tuple(r) for r in first_by_key(df, "k", "o", ["v"]).collect())
    assert got == [(1, "y"), (2, "z")]
    assert duplicate_count(df).collect()[0][0] == 1


def test_unpivot(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    got = [tuple(r) for r in unpivot(df, [], ["a", "b"], "k", "v", ["A", "B"]).collect()]
    assert got == [("A", 1.0), ("B", 2.0)]


def test_clean_tables_against_pandas(spark, fixture_tables):
    """Dedup, then p99 caps (DOUBLE) on session minutes and event seconds, then NULL CSAT
    filled with the truncated median: the same steps computed with pandas."""
    from subscope.plans.quality import clean_tables

    c = clean_tables(fixture_tables)
    s = fixture_tables.user_sessions.toPandas().drop_duplicates()
    cap = s["session_duration_minutes"].quantile(0.99)
    want = sorted(min(float(v), cap) for v in s["session_duration_minutes"])
    got = sorted(r[0] for r in c.user_sessions.select("session_duration_minutes").collect())
    assert len(got) == len(s) and np.allclose(got, want)

    e = fixture_tables.feature_events.toPandas().drop_duplicates()
    ecap = e["time_spent_seconds"].quantile(0.99)
    got_e = sorted(r[0] for r in c.feature_events.select("time_spent_seconds").collect())
    assert np.allclose(got_e, sorted(min(float(v), ecap) for v in e["time_spent_seconds"]))

    tk = fixture_tables.support_tickets.toPandas().drop_duplicates()
    med = int(tk["satisfaction_score"].median())
    want_t = sorted(int(v) if v == v and v is not None else med for v in tk["satisfaction_score"])
    got_t = sorted(r[0] for r in c.support_tickets.select("satisfaction_score").collect())
    assert got_t == want_t
