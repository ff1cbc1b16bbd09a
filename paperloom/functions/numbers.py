"""Rounding, clamping, shares and day arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up_half(x: Column, digits: int = 1) -> Column:
    """Round to `digits` decimals; a half goes towards plus infinity, for negative numbers too."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """`x` kept within [low, high]; null stays null."""
    bound = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.greatest(bound(low), F.least(bound(high), x)))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent of `part` in `whole`; 0 where there is no whole."""
    return F.when(whole > 0, F.floor(part * 100 / F.nullif(whole, F.lit(0)) + 0.5)).otherwise(0).cast("long")


def token_cost(prompt: Column, cached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    """Cost of a model call from token counts and prices per million tokens (input, cached input, output)."""
    return (prompt * prices[0] + cached * prices[1] + output * prices[2]) / 1e6


def days_left(deadline: Column, today: Column) -> Column:
    """Signed days from `today` to `deadline`."""
    return F.date_diff(deadline, today)


def is_open(deadline: Column, today: Column) -> Column:
    """An unknown deadline is open; the last day still counts."""
    return F.coalesce(days_left(deadline, today) >= 0, F.lit(True))


def range_end(text: Column) -> Column:
    """Date at the end of "d1 -> d2" (or of a single date), null if it is none."""
    return F.try_to_date(F.trim(F.element_at(F.split(text, "→"), -1)), "yyyy-MM-dd")


def shown_date(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def year_of(label: Column, default: Column) -> Column:
    """First year 20xx in a label, else `default`."""
    found = F.regexp_extract(label, r"\b(20\d{2})\b", 1)
    return F.when(found != "", found.cast("int")).otherwise(default)


def dates(text: Column) -> Column:
    """Dates of "DD.MM.YYYY" and "DD-DD.MM.YYYY" in order, as "start" or "start -> end"; impossible dates are left out."""
    parts = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}(?:\s*-\s*\d{1,2})?\.\d{1,2}\.20\d{2})\b"), 1)

    def one(p: Column) -> Column:
        # Days come before the first dot, month and year after it.
        days, tail = F.split(F.substring_index(p, ".", 1), r"\s*-\s*"), F.substring_index(p, ".", -2)
        day = lambda d: F.to_char(F.try_to_date(F.concat(F.lpad(d, 2, "0"), F.lit("."), F.lpad(F.substring_index(tail, ".", 1), 2, "0"), F.lit("."), F.substring_index(tail, ".", -1)), "dd.MM.yyyy"), F.lit("yyyy-MM-dd"))
        first, last = day(F.get(days, F.lit(0))), day(F.get(days, F.lit(1)))
        return F.when(F.size(days) == 1, first).when(first.isNotNull() & last.isNotNull(), F.concat(first, F.lit(" → "), last))

    return F.array_compact(F.transform(parts, one))
