"""Month arithmetic on DATE columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(c: Column | str) -> Column:
    return F.trunc(F.to_date(F.col(c) if isinstance(c, str) else c), "month")


def eom(c: Column | str) -> Column:
    return F.last_day(F.col(c) if isinstance(c, str) else c)


def month_end_of(d: dt.date, add: int = 0) -> dt.date:
    """Python-side: last day of the month ``add`` months after ``d``'s month."""
    m = d.year * 12 + (d.month - 1) + add + 1
    first_next = dt.date(m // 12, m % 12 + 1, 1)
    return first_next - dt.timedelta(days=1)


def add_month_start(d: dt.date, add: int) -> dt.date:
    m = d.year * 12 + (d.month - 1) + add
    return dt.date(m // 12, m % 12 + 1, 1)


def month_diff(later: Column | str, earlier: Column | str) -> Column:
    """Whole calendar months between two dates (not the fractional months_between)."""
    a = F.col(later) if isinstance(later, str) else later
    b = F.col(earlier) if isinstance(earlier, str) else earlier
    return (F.year(a) * 12 + F.month(a)) - (F.year(b) * 12 + F.month(b))


def month_label(c: Column | str) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM")
