"""Column expressions shared by the plans.

Every expression here is a built-in Spark expression: it stays in the JVM and
inside whole-stage codegen. No Python runs per row.

Rounding: the reference's SQL rounds exact (DECIMAL) ratios half-up. Rounding a
DOUBLE loses that, because the double nearest a decimal tie can sit on either
side of it. ``half_up`` therefore rounds the exact rational num*factor/den with
integer arithmetic, ``div`` on longs: (num*2*factor*10^s + den) div (2*den).
Inputs must be non-negative, which holds for counts and amounts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from subscope import schema as S


def lit_date(d: dt.date) -> Column:
    return F.lit(d).cast("date")


def month_key(c) -> Column:
    """'yyyy-MM' label of a date (the reference's DATE_FORMAT '%Y-%m' / Period('M'))."""
    return F.date_format(c, "yyyy-MM")


def month_start(c) -> Column:
    return F.trunc(c, "month")


def in_calendar_month(c, month: tuple) -> Column:
    """``month_key(c) == 'yyyy-MM'`` for a DATE column, written as a date range so that
    it reaches the Parquet scan as a pushed filter (and row-group statistics apply)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.between(lit_date(month[0]), lit_date(month[1]))


def months_between_keys(later, earlier) -> Column:
    """Whole calendar months from ``earlier`` to ``later`` (12*dy + dm)."""
    return ((F.year(later) - F.year(earlier)) * 12
            + (F.month(later) - F.month(earlier))).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def half_up(num, den, scale: int = 2, factor: int = 1) -> Column:
    """round(num * factor / den, scale), half-up on the exact value; NULL if den is 0 or NULL.

    ``num`` is an integer column, ``den`` a positive integer column.
    """
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    k = 2 * factor * 10 ** scale
    n = num.cast("long")
    q = _div(F.abs(n) * F.lit(k) + den.cast("long"), den.cast("long") * F.lit(2))
    # half away from zero for negative numerators, as SQL ROUND does
    q = F.when(n < 0, -q).otherwise(q)
    return F.when(den != 0, q / F.lit(10 ** scale))


def pct(num, den, scale: int = 2) -> Column:
    """Percentage num*100/den rounded half-up to ``scale`` digits."""
    return half_up(num, den, scale, 100)


def cents(amount_sum) -> Column:
    """Exact DECIMAL money value in whole cents (as a long)."""
    return (amount_sum * F.lit(100)).cast("long")


def half_up_money(amount_sum, den, scale: int = 2) -> Column:
    """round(amount_sum / den, scale) half-up for a DECIMAL(.,2) money sum."""
    c = cents(amount_sum)
    den = F.col(den) if isinstance(den, str) else den
    if scale == 2:
        q = _div(c * F.lit(2) + den.cast("long"), den.cast("long") * F.lit(2))
        return F.when(den != 0, q / F.lit(100))
    return F.when(den != 0, half_up(c, den * 100, scale))


def exact_mean(c) -> Column:
    """Mean as one division of an exact sum (integer or DECIMAL) by the count.

    A DOUBLE running sum depends on the order rows arrive in; an exact sum does
    not, so the mean is the same on every run and engine. NULL over no values.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def count_when(cond: Column) -> Column:
    """COUNT(CASE WHEN cond THEN 1 END) as BIGINT."""
    return F.count(F.when(cond, F.lit(1)))


def sum_when(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as BIGINT; NULL over no rows, like SQL."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def churned_flag(status) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status == "Churned", F.lit(1)).otherwise(F.lit(0))


def age_band(age) -> Column:
    age = F.col(age) if isinstance(age, str) else age
    return (F.when(age < 25, S.AGE_BANDS[0])
            .when(age.between(25, 35), S.AGE_BANDS[1])
            .when(age.between(36, 50), S.AGE_BANDS[2])
            .otherwise(S.AGE_BANDS[3]))


def ticket_segment(n, labels=S.TICKET_SEGMENTS_SQL) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return (F.when(n == 0, labels[0])
            .when(n.between(1, 2), labels[1])
            .when(n.between(3, 4), labels[2])
            .otherwise(labels[3]))


def stage_order(stage) -> Column:
    """Position of a funnel stage (1..6), 7 for anything else."""
    stage = F.col(stage) if isinstance(stage, str) else stage
    e = None
    for i, name in enumerate(S.FUNNEL_STAGES, start=1):
        e = (F.when(stage == name, F.lit(i)) if e is None else e.when(stage == name, F.lit(i)))
    return e.otherwise(F.lit(S.UNKNOWN_STAGE_ORDER))


def feature_column(name: str) -> str:
    return f"feat_{name.lower()}_clicks"


def risk_band(p) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p < S.RISK_LOW_BELOW, S.RISK_BANDS[0])
            .when(p < S.RISK_MEDIUM_BELOW, S.RISK_BANDS[1])
            .otherwise(S.RISK_BANDS[2]))
