"""Numbers out of free text, guarded arithmetic and pair keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a share of protein binding, tried in this order: fixed values.
BINDING_WORDS = (("high", 90.0), ("extensively", 90.0), ("moderate", 65.0), ("low", 20.0), ("negligible", 5.0), ("minimal", 5.0))
_NUMBER = r"(\d+(?:\.\d+)?)"
#: Patterns of a half-life, tried in this order, and hours in a unit: fixed values. Two groups are the ends of a range.
HALF_LIFE_PATTERNS = (
    (rf"{_NUMBER}\s*-\s*{_NUMBER}\s*hour", 1.0),
    (rf"{_NUMBER}\s*hour", 1.0),
    (rf"{_NUMBER}\s*-\s*{_NUMBER}\s*day", 24.0),
    (rf"{_NUMBER}\s*day", 24.0),
    (rf"{_NUMBER}\s*-\s*{_NUMBER}\s*min", 1 / 60),
    (rf"{_NUMBER}\s*min", 1 / 60),
    (rf"{_NUMBER}\s*week", 168.0),
)
#: A share or a range of shares in percent: a fixed value.
BINDING_PATTERN = rf"{_NUMBER}\s*(?:to|-)\s*{_NUMBER}?\s*%|{_NUMBER}\s*%"


def _figure(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def half_life_hours(text: Column) -> Column:
    """Hours of a described half-life by the first pattern found, a range's middle, to two places.

    Only a hyphen makes a range: of "2 to 4 hours" the 4 counts.
    """
    low, cases = F.lower(text), []
    for pattern, hours in HALF_LIFE_PATTERNS:
        figure = _figure(low, pattern, 1)
        if pattern.count(_NUMBER) == 2:
            figure = (figure + _figure(low, pattern, 2)) / 2
        cases.append(figure * hours if hours >= 1 else figure / 60)
    return F.round(F.coalesce(*cases), 2)


def protein_binding(text: Column) -> Column:
    """Percent bound: a qualitative word first, even inside another word, else the middle of a range, else a single figure."""
    low = F.lower(text)
    word = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(v)) for w, v in BINDING_WORDS])
    first, second, single = (_figure(low, BINDING_PATTERN, k) for k in (1, 2, 3))
    return F.coalesce(word, (first + second) / 2, single, first)


def gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def ratio(a: Column, b: Column) -> Column:
    """``a`` over ``b``; null where ``b`` is null or zero."""
    return a / F.nullif(b, F.lit(0.0))


def rounded(x: Column, places: int) -> Column:
    """``x`` to so many places as SQL engines do it: the double times a power of ten, to a whole number (halves away from zero), over that power.

    ``F.round`` goes by the decimal text of the double, so that 57 of 800 (0.07125, whose product is 712.4999...) comes
    out as 0.0713 instead of 0.0712. A negative value that comes out as zero is -0.0, as in SQL.
    """
    power = 10.0**places
    return F.signum(x) * (F.round(F.abs(x) * power) / power)


def pair_key(a: Column, b: Column) -> Column:
    """The same key for (a, b) and (b, a), whatever their case; null if either is null."""
    x, y = F.lower(a), F.lower(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("_", F.least(x, y), F.greatest(x, y)))


def squash(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))
