"""Numbers: rounding to even, ratios that stay unmeasured, annual figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value.cast("double"), digits)


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, null where the whole is 0 or unmeasured."""
    out = F.try_divide(part.cast("double"), whole.cast("double"))
    return out if digits is None else half_even(out, digits)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded to even; 0 where there is nothing to share."""
    return F.when(whole == 0, F.lit(0)).otherwise(half_even(F.lit(100.0) * part / whole)).cast("int")


def first_number(text: Column) -> Column:
    """The first number of a text, comma or dot as decimal sign; null if there is none."""
    found = F.regexp_extract(text, r"-?\d+(?:[.,]\d+)?", 0)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def small_int(value: Column) -> Column:
    """A whole number from text such as "4" or "4.0"; null for anything else."""
    return value.try_cast("double").try_cast("int")


def annual(value: Column, days: Column) -> Column:
    """A figure over `days` days as a yearly one, null if no day was measured."""
    return half_even(F.try_divide(value.cast("double") * 365.25, days.cast("double")))


def period_days(unit: Column, start: Column, end: Column) -> Column:
    """Days named in a unit ("clicks / 28 d"), else the length of the period, both ends included."""
    named = F.regexp_extract(unit, r"(\d+)\s*(?:d|day|j|jour)", 1).try_cast("int")
    return F.coalesce(named, F.datediff(end, start) + 1)


def target_clicks(impressions: Column, rate_now: Column, rate_target: Column) -> Column:
    return impressions * (rate_target - rate_now)


def revenue_chain(clicks: Column, lead_rate: Column, lead_value: Column) -> tuple[Column, Column]:
    """Leads and revenue; a missing link leaves what follows it unmeasured."""
    leads = clicks * lead_rate
    return leads, leads * lead_value


def thousands(value: Column) -> Column:
    """1234567 -> "1 234 567"."""
    return F.translate(F.format_number(value, 0), ",", " ")
