"""Column expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters a text strip removes at both ends.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

NUMBER_PATTERN = r"(?i)^[+-]?(inf(inity)?|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
INTEGER_PATTERN = r"^[+-]?[0-9]+(_[0-9]+)*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int = 0) -> Column:
    """Round half away from zero on the binary double, as SQL engines with a
    double ``ROUND`` do; ``F.round`` works on the printed decimal instead."""
    value = _col(c).cast("double")
    if digits == 0:
        return F.round(value)
    scale = F.lit(float(10**digits))
    return F.round(value * scale) / scale


def settled(c: Column | str) -> Column:
    """A sum or mean of fractions without its last bits, which depend on the
    order of addition; keeps a later rounding from flipping at a tie."""
    return F.round(_col(c).cast("double"), 9)


def rnd_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even, the rule of numeric Python libraries."""
    scale = F.lit(float(10**digits))
    return F.rint(_col(c).cast("double") * scale) / scale


def pct(part: Column, whole: Column, digits: int) -> Column:
    """``part`` in percent of ``whole``; NULL when ``whole`` is zero."""
    whole = whole.cast("double")
    return rnd(F.lit(100.0) * part / F.nullif(whole, F.lit(0.0)), digits)


def pct_even(part: Column, whole: Column, digits: int) -> Column:
    """As ``pct``, rounded half to even."""
    whole = whole.cast("double")
    return rnd_even(F.lit(100.0) * part / F.nullif(whole, F.lit(0.0)), digits)


def one_digit(c: Column | str) -> Column:
    """Text with one decimal, rounded half to even on the exact binary value.

    ``format_string`` rounds the printed decimal instead: 0.15 lies below the
    tie. Ten times the value is the sum of its exact eightfold and double; what
    that sum loses tells on which side of a tie the value lies."""
    x = _col(c).cast("double")
    eight, two = x * 8.0, x * 2.0
    ten = eight + two
    part = ten - eight
    lost = (eight - (ten - part)) + (two - part)
    tie = ten - F.floor(ten) == 0.5
    rounded = F.when(tie & (lost < 0), F.floor(ten)).when(tie & (lost > 0), F.ceil(ten)).otherwise(F.rint(ten))
    return F.format_string("%.1f", rounded.cast("double") / 10.0)


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def sql_text(text: str) -> str:
    """A text literal for SQL expressions."""
    return "'" + "".join(c if c.isalnum() or c in " _-" else f"\\u{ord(c):04x}" for c in text) + "'"


# Wide projections are given as SQL text: building a column object costs a few
# calls into the JVM for each of its parts, a text costs one.
def blank_to_null_sql(name: str) -> str:
    return f"nullif(btrim(`{name}`, {sql_text(WHITESPACE)}), '')"


def to_number_sql(name: str) -> str:
    return f"CASE WHEN `{name}` RLIKE {sql_text(NUMBER_PATTERN)} THEN try_cast(`{name}` AS DOUBLE) END"


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a plain number becomes NULL.

    A bare cast is too generous: it reads ``1d`` as 1.0 and ``nan`` as NaN."""
    text = _col(c)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def integer_text(c: Column | str) -> Column:
    """Canonical digits of an integer literal (no sign plus, no leading zeros,
    no digit separators), NULL for any other text."""
    text = strip(c)
    digits = F.regexp_replace(text, "_", "")
    return F.when(text.rlike(INTEGER_PATTERN), F.regexp_replace(digits, r"^(-?)\+?0*([0-9]+)$", "$1$2"))


def bucketize(c: Column | str, bands: Iterable[Sequence], truncate: bool, default: str = "Unknown") -> Column:
    """First band whose inclusive ``[low, high]`` holds the value.

    ``truncate`` compares the integer part. The limits are shifted when the
    plan is built, so the row-level work is two comparisons per band."""
    value = _col(c)
    out = None
    for low, high, label in bands:
        if truncate:
            above = value > low - 1 if low <= 0 else value >= low
            below = value < high + 1 if high >= 0 else value <= high
        else:
            above, below = value >= low, value <= high
        inside = above & below
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return F.lit(default) if out is None else out.otherwise(default)


def rank_of(c: Column | str, order: Sequence[str], *, rest: int | None = None) -> Column:
    """Sort position of a label in a fixed order; unlisted labels come last."""
    value = _col(c)
    out = None
    for position, label in enumerate(order, 1):
        hit = value == label
        out = F.when(hit, position) if out is None else out.when(hit, position)
    return out.otherwise(len(order) + 1 if rest is None else rest)


def rows(one_row: DataFrame, entries: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a frame of one wide row into one row per entry."""
    structs = [F.struct(*[value.alias(name) for name, value in entry.items()]) for entry in entries]
    return one_row.select(F.inline(F.array(*structs)))
