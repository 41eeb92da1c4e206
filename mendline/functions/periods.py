"""Monthly periods: deriving them, naming them, and checking requests for one."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIRST_YEAR = 2020


def period_of(ts: Column) -> Column:
    """``yyyy-MM`` of a time without zone, whatever the session's zone."""
    month = F.lpad(F.month(ts).cast("string"), 2, "0")
    return F.concat(F.lpad(F.year(ts).cast("string"), 4, "0"), F.lit("-"), month)


def period_name(year: int, month: int) -> str:
    """``yyyy-MM`` of plain numbers."""
    return f"{year:04d}-{month:02d}"


def instant(moment: str) -> Column:
    """A fixed time without zone; given as text, as a plain literal would pass through one."""
    return F.lit(moment).cast("timestamp_ntz")


def period_from_parts(year: Column, month: Column) -> Column:
    """``yyyy-MM`` of a year and a month column; NULL if one is."""
    both = year.isNotNull() & month.isNotNull()
    return F.when(both, F.format_string("%04d-%02d", year, month))


def request_problem(year: Column, month: Column, current_year: int) -> Column:
    """Why a request for (year, month) is refused, or NULL when it is valid.

    The month is checked before the year. ``current_year`` is an argument so that
    the answer does not depend on the day the query runs.
    """
    return (
        F.when(year.isNull() | month.isNull(), F.lit("a period needs a year and a month"))
        .when(~month.between(1, 12), F.lit("no such month: give 1 to 12"))
        .when(
            ~year.between(FIRST_YEAR, current_year),
            F.lit(f"no data for that year: give {FIRST_YEAR} to {current_year}"),
        )
        .otherwise(F.lit(None).cast("string"))
    )


def check_request(year: int, month: int, current_year: int) -> str:
    """The period of a valid request; raises ``ValueError`` with the reason otherwise."""
    if not 1 <= month <= 12:
        raise ValueError("no such month: give 1 to 12")
    if not FIRST_YEAR <= year <= current_year:
        raise ValueError(f"no data for that year: give {FIRST_YEAR} to {current_year}")
    return period_name(year, month)
