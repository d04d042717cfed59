"""Expressions over the 48-character payment history.

Position 1 is the oldest month and position 48 the newest. ``0`` is current,
``1`` to ``9`` the delinquency level, ``X`` a month that was not reported.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HISTORY_MONTHS = 48
WINDOW_START = 37
WINDOW_MONTHS = 12


def has_history(c: Column) -> Column:
    return c.isNotNull() & (F.length(c) >= HISTORY_MONTHS)


def last_year(c: Column) -> Column:
    return F.substring(c, WINDOW_START, WINDOW_MONTHS)


def count_of(text: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def worst_level(text: Column) -> Column:
    """Highest digit 9..1 that occurs, else 0."""
    return F.coalesce(*[F.when(text.contains(str(level)), level) for level in range(9, 0, -1)], F.lit(0))


def trailing_current(text: Column) -> Column:
    """Length of the run of ``0`` at the end; any other character breaks it."""
    return F.length(text) - F.length(F.rtrim(text, F.lit("0")))


def delinquent_months(text: Column) -> Column:
    """Months with a level of 1 to 9."""
    return F.length(text) - F.length(F.translate(text, "123456789", ""))


def state_label(char: Column) -> Column:
    """Readable bucket of one history character (a digit)."""
    return (
        F.when(char == "0", "Current")
        .when(char == "1", "30_DPD")
        .when(char == "2", "60_DPD")
        .when(char == "3", "90_DPD")
        .otherwise("120_Plus")
    )
