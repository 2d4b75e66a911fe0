"""Oracle SQL for the fitted model's own checks: which slots it has, and a stored model's scores."""

from __future__ import annotations

from subscope import schema as S
from subscope.oracle.binding import with_binding
from subscope.oracle.churn_sql import feature_ctes
from subscope.params import DEFAULT_PERIOD, Period
from subscope.plans.churn import CATEGORICAL, NUMERIC
from subscope.plans.linear_model import INTERCEPT, STORED


def sql(p: Period = DEFAULT_PERIOD) -> dict[str, str]:
    c = feature_ctes(p)
    # a category has a slot for each level that a training row has
    train = c + """,
Train AS (SELECT * FROM Features QUALIFY row_number() OVER (PARTITION BY target ORDER BY md5(CAST(user_id AS VARCHAR)), user_id)
          > floor(count(*) OVER (PARTITION BY target) * 0.2 + 0.5))"""
    slots = "\nUNION ALL ".join(
        [f"SELECT unnest({NUMERIC!r}) AS slot"] + [f"SELECT DISTINCT '{k}_' || {k} FROM Train WHERE {k} IS NOT NULL" for k in CATEGORICAL])
    terms = [repr(STORED.intercept)]
    terms += [f"(CAST({k} AS DOUBLE) - {m}) / {s} * {w}" for k, (m, s, w) in STORED.numeric.items()]
    terms += [f"CASE WHEN {k} = '{level}' THEN {w} ELSE 0.0 END" for k, levels in STORED.levels.items() for level, w in levels.items()]
    low, medium, high = S.RISK_BANDS
    return {
        "fit_certificate": with_binding(f"SELECT slot, true AS optimal FROM ({slots}\nUNION ALL SELECT '{INTERCEPT}')", train),
        "coefficient_file": with_binding(f"SELECT slot, true AS same FROM ({slots})", train),
        "saved_model": with_binding("SELECT count(*) AS users, CAST(0 AS BIGINT) AS differing_scores, "
                                    "CAST(0 AS BIGINT) AS differing_expressions FROM users"),
        "stored_model_scores": with_binding(f"""
SELECT user_id, round(score, 6) AS churn_probability,
       CASE WHEN score < {S.RISK_LOW_BELOW} THEN '{low}' WHEN score < {S.RISK_MEDIUM_BELOW} THEN '{medium}' ELSE '{high}' END AS risk_band
FROM (SELECT user_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-CAST({" + ".join(terms)} AS DOUBLE))) AS score FROM Features)""", c),
    }
