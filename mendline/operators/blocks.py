"""Blocks as parts of a table: fetching, inserting, deleting and replacing them.

These work on any DataFrame with a ``period`` column. On a table partitioned by
``period`` every filter here becomes a static partition filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.periods import instant

#: Ranges of time that a scan is given for a list of blocks.
RANGES = 32
#: Names of blocks that a scan is given, whatever it can make of them; more are left to the join.
NAMES = 1_000


def in_blocks(periods: Iterable[str]) -> Column:
    """Membership of a row in one of the listed blocks.

    NULL and the empty text are the same block: storage keeps both as the default
    partition.
    """
    listed = list(periods)
    named = [p for p in listed if p]
    member = F.col("period").isin(named)
    if len(named) < len(listed):
        member = member | F.col("period").isNull() | (F.col("period") == "")
    return member


def month_range(period: str) -> tuple[str, str | None] | None:
    """First instant of a month and of the next, as text; the last month that has four digits of a
    year is open-ended, and a period that is no month has no range.
    """
    if not (named := re.fullmatch("([0-9]{4})-(0[1-9]|1[0-2])", period)) or period < "0001":
        return None
    year, month = int(named[1]), int(named[2])
    after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01 00:00:00"
    return f"{period}-01 00:00:00", after if len(after) == 19 else None


def _any(conditions: list[Column]) -> Column:
    """Disjunction as a balanced tree, which stays shallow for any number of conditions."""
    while len(conditions) > 1:
        pairs = zip(conditions[::2], conditions[1::2])
        rest = conditions[-1:] if len(conditions) % 2 else []
        conditions = [a | b for a, b in pairs] + rest
    return conditions[0]


def month_spans(periods: Iterable[str], most: int | None = None) -> list[tuple[str, str | None]] | None:
    """The months as ranges of time, adjoining ones as one; None if one of the periods is no month.

    With ``most``, ranges are joined across the narrowest gaps until no more than that are left.
    """
    ranges = [month_range(p or "") for p in set(periods)]
    if not all(ranges):
        return None
    spans: list[tuple[str, str | None]] = []
    for first, after in sorted(ranges):
        if spans and spans[-1][1] == first:
            spans[-1] = (spans[-1][0], after)
        else:
            spans.append((first, after))
    if most and len(spans) > most:
        number = lambda text: int(text[:4]) * 12 + int(text[5:7])
        gaps = [number(b[0]) - number(a[1]) for a, b in zip(spans, spans[1:])]
        kept = sorted(sorted(range(len(gaps)), key=lambda i: -gaps[i])[: most - 1])
        starts, ends = [0, *(i + 1 for i in kept)], [*kept, len(spans) - 1]
        spans = [(spans[i][0], spans[j][1]) for i, j in zip(starts, ends)]
    return spans


def _in_spans(spans: list[tuple[str, str | None]]) -> Column:
    ts = F.col("sale_ts")
    return _any([(ts >= instant(a)) & (ts < instant(b)) if b else ts >= instant(a) for a, b in spans])


def in_months(periods: Iterable[str]) -> Column:
    """Membership of ``sale_ts`` in one of the months, in a form that sources can filter by.

    Adjoining months are one range. True if one of the periods is no month.
    """
    spans = month_spans(periods)
    return F.lit(True) if spans is None else _in_spans(spans)


def fetch_blocks(sales: DataFrame, periods: Iterable[str], derived: bool = False) -> DataFrame:
    """Rows of the listed blocks, in one scan; unknown periods give no rows.

    ``derived`` states that ``period`` is the month of ``sale_ts``. The months then
    also go to the scan as time ranges, which file statistics or a remote database
    can answer.
    """
    listed = list(periods)
    rows = sales.filter(in_blocks(listed))
    return rows.filter(in_months(listed)) if derived and listed else rows


def fetch_block(sales: DataFrame, period: str, derived: bool = False) -> DataFrame:
    """Rows of one block; an unknown period gives no rows."""
    return fetch_blocks(sales, [period], derived)


def mark_named_blocks(sales: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with ``_named``, true or NULL: whether their block is in ``blocks``.

    An outer join rather than a semi or anti join,
    as Spark pushes those below unions, where a branch with a constant period would
    leave no key to join on.
    """
    named = blocks.select(
        F.coalesce("period", F.lit("")).alias("_block"), F.lit(True).alias("_named")
    ).distinct()
    named = named.where("_block >= ''")  # always so: Spark prunes at run time only by a side that has a filter
    same = F.coalesce("period", F.lit("")) == F.col("_block")
    return sales.join(named, same, "left").drop("_block")


def collected_spans(blocks: DataFrame) -> list[tuple[str, str | None]] | None:
    """The months of a stored list of blocks as up to ``RANGES`` ranges of time, exact ones unless there are more; None if one is no month.

    Runs at once, and collects distinct months, of which there are 120,000 at most.
    """
    month = F.when(F.col("period").rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), F.col("period"))
    return month_spans((row[0] for row in blocks.select(month).distinct().toLocalIterator()), RANGES)


def collected_names(blocks: DataFrame) -> list[str] | None:
    """The distinct names in a stored list of blocks, the empty one for NULL; None if there are more than ``NAMES``. Runs at once."""
    found = blocks.select(F.coalesce("period", F.lit(""))).distinct().limit(NAMES + 1).collect()
    return [row[0] for row in found] if len(found) <= NAMES else None


def fetch_named_blocks(
    sales: DataFrame, blocks: DataFrame, derived: bool = False, spans: list[tuple[str, str | None]] | None = None, names: list[str] | None = None
) -> DataFrame:
    """Rows whose block is in ``blocks``, for any number of blocks.

    Given the ``collected_names`` of ``blocks``, other rows go before any join that ``sales`` makes.

    The join prunes the directories of a stored table at run time. ``derived`` states that
    ``period`` is the month of ``sale_ts``; the time from the first to the last of the
    months then also goes to the scan, as scalar subqueries over ``blocks``, or, given the ``collected_spans`` of ``blocks``, the ranges
    of the months alone.
    """
    if names is not None:
        sales = sales.filter(in_blocks(names))
    if derived and spans:  # rows without time are the join's to judge
        sales = sales.filter(_in_spans(spans) | F.col("sale_ts").isNull())
    elif derived:
        month = F.coalesce(F.expr("period RLIKE '^[0-9]{4}-(0[1-9]|1[0-2])$' AND period < '9999-12'"), F.lit(False))
        first = F.when(month, F.to_timestamp_ntz(F.concat("period", F.lit("-01")), F.lit("yyyy-MM-dd")))
        # A block that is no month, or has no next one, leaves both ends open.
        known = F.bool_and(month)
        ends = blocks.agg(
            F.when(known, F.min(first)).otherwise(instant("0001-01-01 00:00:00")).alias("from"),
            F.when(known, F.max(first) + F.expr("INTERVAL '1' MONTH"))
            .otherwise(instant("9999-12-31 23:59:59.999999")).alias("to"),
        )
        # Rows without time are the join's to judge. The bounds come bare, as scans filter by no expression of them.
        for within in (F.col("sale_ts") >= ends.select("from").scalar(), F.col("sale_ts") <= ends.select("to").scalar()):
            sales = sales.filter(within | F.col("sale_ts").isNull())
    return mark_named_blocks(sales, blocks).filter("_named").drop("_named")


def keep_other_blocks(sales: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows whose block is not in ``blocks``."""
    return mark_named_blocks(sales, blocks).filter("_named IS NULL").drop("_named")


def insert_block(sales: DataFrame, rows: DataFrame) -> DataFrame:
    """Append: duplicates are kept, nothing appended leaves the table as it is."""
    return sales.unionByName(rows)


def delete_blocks(sales: DataFrame, periods: Iterable[str]) -> DataFrame:
    """All rows outside the listed blocks; an absent period removes nothing."""
    return sales.filter(~F.coalesce(in_blocks(periods), F.lit(False)))


def delete_block(sales: DataFrame, period: str) -> DataFrame:
    """All rows outside one block."""
    return delete_blocks(sales, [period])


def replace_block(sales: DataFrame, period: str, rows: DataFrame) -> DataFrame:
    """Delete one block and insert ``rows`` in its stead."""
    return insert_block(delete_block(sales, period), rows)


def merge_blocks(source: DataFrame, target: DataFrame, changed: DataFrame, derived: bool = False) -> DataFrame:
    """What the target holds after a sync, without writing it."""
    return insert_block(keep_other_blocks(target, changed), fetch_named_blocks(source, changed, derived))
