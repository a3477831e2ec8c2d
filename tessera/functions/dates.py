"""Dates in running text, expiry and weeks. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, and the days for which a relation stays valid.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
HALF_LIFE_DAYS = {"equity": 365, "license": 365, "supply": 180, "personnel": 180, "compete": 90}
DEFAULT_HALF_LIFE, LEAST_WINDOW = 180, 30


def _all(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    """ISO strings of all matches; order: the groups of year, month and day."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in order]
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "ymd"))), lambda s: F.concat_ws("-", s["y"], F.lpad(s["m"], 2, "0"), F.lpad(s["d"], 2, "0")))


def latest_observed_date(text: Column, as_of: str, first_year: int = 2000) -> Column:
    """The latest valid date in the text that lies at most a day after as_of; null without one."""
    english = F.regexp_extract_all(text, F.lit(rf"(?i)({'|'.join(MONTHS)})\s+(\d{{1,2}}),?\s+(20\d{{2}})"), F.lit(0))

    def named(x: Column) -> Column:
        month = F.lit(None).cast("string")
        for i, name in enumerate(MONTHS, 1):
            month = F.when(F.startswith(F.lower(x), F.lit(name.lower())), f"{i:02d}").otherwise(month)
        return F.concat_ws("-", F.regexp_extract(x, r"(20\d{2})$", 1), month, F.lpad(F.regexp_extract(x, r"\s(\d{1,2})", 1), 2, "0"))

    chinese = _all(text, r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", (1, 2, 3))
    plain = _all(text, r"(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3))
    found = F.transform(F.concat(chinese, plain, F.transform(english, named)), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    now = F.lit(as_of).cast("date")
    return F.array_max(F.filter(found, lambda d: d.isNotNull() & (F.year(d) >= first_year) & (F.year(d) <= F.year(now) + 1) & (d <= F.date_add(now, 1))))


def half_life(relation: Column) -> Column:
    out = F.lit(DEFAULT_HALF_LIFE)
    for name, days in HALF_LIFE_DAYS.items():
        out = F.when(relation == name, days).otherwise(out)
    return out


def valid_until(anchor: Column, relation: Column, as_of: str) -> Column:
    """anchor (as_of where null) plus the relation's half-life; a month from as_of at least."""
    now = F.lit(as_of).cast("date")
    return F.greatest(F.date_add(F.coalesce(anchor, now), half_life(relation)), F.date_add(now, LEAST_WINDOW))


def is_expired(until: Column, as_of: str) -> Column:
    """Whether a date, or a moment, has passed at as_of (either as well). A date counts until the end of its day; blank or unreadable never expires."""
    text = F.trim(until)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd").cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    now = F.lit(as_of).cast("timestamp")
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), day <= now).otherwise(F.try_to_timestamp(text) < now), F.lit(False))


def latest_past_date(text: Column, as_of: str, first_year: int = 1990) -> Column:
    """The latest date in the text that is not after as_of; a year and month alone count as their first day.

    Days that a month does not have run on into the next one. Null without a date.
    """
    found = []
    for pattern, day in ((r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", True), (r"(\d{4})\s*年\s*(\d{1,2})\s*月(?!\s*\d{1,2}\s*日)", False), (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", True)):
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in ((1, 2, 3) if day else (1, 2, 1))]
        rows = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "ymd")))
        number = lambda x: x.try_cast("int")
        ok = F.filter(rows, lambda s: number(s["m"]).between(1, 12) & (F.lit(True) if not day else number(s["d"]).between(1, 31)) & (number(s["y"]) >= first_year))  # noqa: B023
        found.append(F.transform(ok, lambda s: F.date_add(F.make_date(number(s["y"]), number(s["m"]), F.lit(1)), number(s["d"]) - 1 if day else F.lit(0))))  # noqa: B023
    return F.array_max(F.filter(F.concat(*found), lambda d: d <= F.lit(as_of).cast("date")))


def monday_of(ts: Column, hours: int = 8) -> Column:
    """The Monday of a moment's week, `hours` east of UTC."""
    return F.date_trunc("week", ts + F.expr(f"INTERVAL {hours} HOURS")).cast("date")
