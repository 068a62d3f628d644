"""Date functions. Publication dates stay text: their months are not checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import trimmed

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def publication_date(raw: Column) -> Column:
    """``struct(date, year)`` of free text: the first form that fits, ``("", null)`` if none does."""
    s = trimmed(F.coalesce(raw, F.lit("")))
    numbers = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))])
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    pair = lambda date, year: F.struct(date.alias("date"), year.cast("int").alias("year"))
    iso, slashed = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{4})/(\d{2})/(\d{2})$"
    name_first, day_first, any_year = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})", r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})", r"(\d{4})"
    month_a, month_b = F.try_element_at(numbers, F.lower(part(name_first, 1))), F.try_element_at(numbers, F.lower(part(day_first, 2)))
    dashed = lambda y, m, d: F.concat_ws("-", y, m, F.lpad(d, 2, "0"))
    return (
        F.when(s.rlike(iso), pair(s, part(iso, 1)))
        .when(s.rlike(slashed), pair(dashed(part(slashed, 1), part(slashed, 2), part(slashed, 3)), part(slashed, 1)))
        .when(s.rlike(name_first) & month_a.isNotNull(), pair(dashed(part(name_first, 3), month_a, part(name_first, 2)), part(name_first, 3)))
        .when(s.rlike(day_first) & month_b.isNotNull(), pair(dashed(part(day_first, 3), month_b, part(day_first, 1)), part(day_first, 3)))
        .when(s.rlike(any_year), pair(F.concat(part(any_year, 1), F.lit("-01-01")), part(any_year, 1)))
        .otherwise(pair(F.lit(""), F.lit(None)))
    )


def creation_date(value: Column) -> Column:
    """Date of a creation stamp in any of its text forms, else null."""
    s = trimmed(value.cast("string"))
    day = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ])"), F.left(s, F.lit(10)))
    rest_fits = s.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(rest_fits, F.try_to_date(day, "yyyy-MM-dd"))


def strict_date(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))


def age_days(updated: Column, today: Column) -> Column:
    return F.datediff(today, updated)


def stale_run(run_at: Column, now: Column, hours: int = 24) -> Column:
    """Older than the limit, or not readable."""
    at = F.try_to_timestamp(run_at.cast("string"))
    return F.coalesce(at < now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))


def created_prefix(value: Column) -> Column:
    s = F.left(value.cast("string"), F.lit(10))
    return F.when(s != "", s)


def year_tag(value: Column) -> Column:
    year = F.regexp_extract(value.cast("string"), "([0-9]{4})", 1)
    return F.when(year != "", F.concat(F.lit("year/"), year))
