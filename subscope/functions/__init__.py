from subscope.functions.exprs import (  # noqa: F401
    month_key, month_start, in_calendar_month, months_between_keys, half_up, half_up_money, pct,
    cents, exact_mean, count_when, sum_when, churned_flag,
    age_band, ticket_segment, stage_order, feature_column, risk_band, lit_date,
)
