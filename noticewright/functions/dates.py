"""Date functions. "Today" is always the parameter ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日", "yyyyMMdd", "M/d/yyyy", "d.M.yyyy")


def parsed_date(t: Column, formats=FORMATS) -> Column:
    """The first format that fits; null if none does or the day doesn't exist."""
    return F.coalesce(*[F.try_to_date(t, f) for f in formats])


def completed_date(month: Column, day: Column, published: Column) -> Column:
    """A date without a year takes the publish year, or the next one if it would lie more than 180
    days before publication (J26)."""
    text = lambda shift: F.concat_ws("-", F.year(published) + shift, month, day)
    same, following = F.try_to_date(text(0), "y-M-d"), F.try_to_date(text(1), "y-M-d")
    return F.when(F.datediff(published, same) > 180, F.coalesce(following, same)).otherwise(F.coalesce(same, following))


def days_left(deadline: Column, as_of) -> Column:
    """Whole days from ``as_of``; null without a deadline."""
    return F.datediff(deadline, F.lit(as_of).cast("date"))


def days_left_label(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days < 0, "expired").when(days == 0, "today").otherwise(F.concat(days.cast("string"), F.lit(" days left")))


def days_left_class(days: Column) -> Column:
    """expired, urgent (a week), soon (two weeks) or normal."""
    return F.when(days.isNull() | (days < 0), "expired").when(days <= 7, "urgent").when(days <= 14, "soon").otherwise("normal")


def recency_score(age_days: Column) -> Column:
    """Age of publication: a week 1, a month 0.7, a quarter 0.4, older 0.1, unknown 0.2."""
    return F.when(age_days.isNull(), 0.2).when(age_days <= 7, 1.0).when(age_days <= 30, 0.7).when(age_days <= 90, 0.4).otherwise(0.1)


def deadline_score(days: Column, given: Column) -> Column:
    """No deadline 0.5, unreadable 0.6, past 0, within a week 1.2, a month 1, later 0.5."""
    return F.when(~given, 0.5).when(days.isNull(), 0.6).when(days < 0, 0.0).when(days <= 7, 1.2).when(days <= 30, 1.0).otherwise(0.5)


def ambiguous_iso(t: Column) -> Column:
    """The first ISO date in a text."""
    return F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
