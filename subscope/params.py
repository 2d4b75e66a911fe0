"""Query parameters. The reference hard-codes its dates; here they are values."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Period:
    """One reporting month plus the windows the queries need.

    ``month_start``/``month_end``: the month every "this month" metric uses.
    ``dau_start``: first day of the daily-active window (ends at ``month_end``).
    ``as_of``: the day recency is measured from, the last day of the data.
    ``first_month``/``last_month``: months that signups and activity fall in; they name the
    columns of the cohort matrix, from ``first_offset`` months after signup (below 0: activity
    before signup is expected) to the whole span.
    """

    month_start: dt.date = dt.date(2001, 6, 1)
    month_end: dt.date = dt.date(2001, 6, 30)
    dau_start: dt.date = dt.date(2001, 6, 17)
    as_of: dt.date = dt.date(2001, 11, 4)
    first_month: dt.date = dt.date(1994, 11, 1)
    last_month: dt.date = dt.date(2001, 11, 1)
    first_offset: int = 0

    @property
    def month(self) -> str:
        return self.month_start.strftime("%Y-%m")

    @property
    def cohort_periods(self) -> range:
        """Months from a signup to an activity that the declared months allow."""
        span = (self.last_month.year - self.first_month.year) * 12 + self.last_month.month - self.first_month.month
        return range(self.first_offset, span + 1)

    @property
    def calendar_month(self) -> tuple[dt.date, dt.date]:
        """First and last day of the calendar month of ``month_start``."""
        first = self.month_start.replace(day=1)
        last = (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
        return first, last


DEFAULT_PERIOD = Period()


def sql_date(d: dt.date) -> str:
    return f"DATE '{d.isoformat()}'"
