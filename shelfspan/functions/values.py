"""Dates and numbers read from raw text cells.

Nothing is guessed: a cell that does not read as a date or a number becomes null, and
``is_date_artifact`` keeps the destroyed ones countable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspan import params as P


def parse_date(value: Column) -> Column:
    """``YYYYMMDD``, ISO dates and ISO timestamps (with ``Z``), floored to the UTC day."""
    label = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    compact = F.try_to_date(label, "yyyyMMdd")
    stamped = F.to_date(F.try_to_timestamp(label))
    return F.when(label.rlike(r"^\d{8}$"), compact).when(label.rlike(r"^\d{4}-"), stamped)


def is_date_artifact(value: Column) -> Column:
    label = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return label.isin(*P.DATE_ARTIFACTS) | label.rlike("^#+$")


def number(value: Column) -> Column:
    """Blank and unreadable cells are null, never zero."""
    return F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast("double")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column and keep its nulls (greatest/least alone would drop them)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)
