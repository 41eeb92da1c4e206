"""A digest of the bag of whole rows of a block, which can be added to and taken from.

Each row gets two numbers of 60 bits from the MD5 of its columns; a bag has their exact sums and its row count. The sums do not depend on order or
partitioning, combine before the shuffle, and those of two bags together are the sums of both: ``add`` and ``subtract`` keep headers
up to date from what came and went alone. All columns count, so a renamed customer and changes of amounts that cancel out are seen. Two sums of
60-bit numbers tell accidents apart, not somebody who sets out to make two blocks alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.digest import content_hash, joined, pieces
from ..schema import AMOUNT_SUM
from .headers import by_block

#: What a row is, in the order in which its text is made; the block is told apart already.
ROW = ("sale_id", "line_no", "sale_ts", "customer", "product", "amount")
BAG = ("row_count", "amount_sum", "high_sum", "low_sum")


def row_mark(columns: Sequence[str] = ROW) -> Column:
    """MD5 of the columns, each with its length before it, so that no two rows have one text; NULL is told apart from the empty text."""
    fields = []
    for name in columns:
        text = F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS") if name == "sale_ts" else F.col(name).cast("string")
        fields.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws("|", *fields).cast("binary"))


def sum_of(number: Column) -> Column:
    """The exact sum of numbers of 64 bits."""
    return joined([F.sum(part) for part in pieces(number)])


def _number(mark: Column, first: int) -> Column:
    return F.conv(F.substring(mark, first, 15), 16, 10).cast("bigint")


def bag_figures(mark: Column) -> tuple[Column, ...]:
    """Aggregates of the bag of rows that have this mark: its digest without the name of the block."""
    return (
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(AMOUNT_SUM).alias("amount_sum"),
        F.coalesce(sum_of(_number(mark, 1)), F.lit(0)).cast("decimal(38,0)").alias("high_sum"),
        F.coalesce(sum_of(_number(mark, 17)), F.lit(0)).cast("decimal(38,0)").alias("low_sum"),
    )


def content_totals(sales: DataFrame, derived: bool = False) -> DataFrame:
    """``(period, row_count, amount_sum, high_sum, low_sum)``, one row per block."""
    marked = sales.withColumn("_mark", row_mark())
    return by_block(marked, *bag_figures(F.col("_mark")), derived=derived)


def content_headers(totals: DataFrame) -> DataFrame:
    """Headers like those of ``block_headers``, whose digest sees every column."""
    return totals.select("period", "row_count", "amount_sum", content_hash(F.col("high_sum"), F.col("low_sum"), F.col("row_count")).alias("block_hash"))


def _combined(totals: DataFrame, changes: DataFrame, sign: int) -> DataFrame:
    signed = changes.select("period", *((F.col(name) * sign).cast(changes.schema[name].dataType).alias(name) for name in BAG))
    kinds = {f.name: f.dataType for f in totals.schema}
    both = totals.select("period", *BAG).unionByName(signed)
    return both.groupBy("period").agg(*(F.sum(name).cast(kinds[name]).alias(name) for name in BAG)).where("row_count <> 0")


def add(totals: DataFrame, new: DataFrame) -> DataFrame:
    """Totals of the rows of both."""
    return _combined(totals, new, 1)


def subtract(totals: DataFrame, gone: DataFrame) -> DataFrame:
    """Totals without those of rows that went; a block of which all went has none."""
    return _combined(totals, gone, -1)
