"""Descriptive statistics of a sales table, its largest blocks and its size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import AMOUNT, AMOUNT_SUM
from .headers import by_block

ROW_ORDER = ("sale_ts", "sale_id", "line_no")
PROFILED = ("period", "amount", "sale_ts")
COUNTED = ("customer", "product")

# A sales table, or a function that gives the named columns of one. The latter lets a
# view over joins leave out the joins that the columns do not need.
Sales = DataFrame | Callable[..., DataFrame]


def narrow(sales: Sales, *columns: str) -> DataFrame:
    """The named columns of a sales table."""
    return sales.select(*columns) if isinstance(sales, DataFrame) else sales(*columns)


def block_profile(sales: Sales, derived: bool = False) -> DataFrame:
    """Count, amounts and dates per block; ``derived`` is as for ``by_block``.

    All buffers are of fixed width, so the aggregation stays in hash form; whole-table
    figures are rolled up from these few rows.
    """
    return by_block(
        narrow(sales, *PROFILED),
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(AMOUNT_SUM).alias("amount_sum"),
        F.min("amount").alias("amount_min"),
        F.max("amount").alias("amount_max"),
        F.min("sale_ts").alias("first_date"),
        F.max("sale_ts").alias("last_date"),
        derived=derived,
    )


def _or_zero(value: Column, kind) -> Column:
    return F.coalesce(value, F.lit(0)).cast(kind)


def first_last(sales: Sales) -> DataFrame:
    """Ids of the first and the last row by (time, id, line); empty texts for no rows.

    There is no grouping key, so the struct buffers cost neither a sort nor a
    shuffle of rows.
    """
    order = F.struct(*ROW_ORDER)
    ends = narrow(sales, *ROW_ORDER).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    return ends.select(
        *(
            F.coalesce(F.col(f"{end}.sale_id").cast("string"), F.lit("")).alias(f"{end}_id")
            for end in ("first", "last")
        )
    )


def distinct_counts(sales: Sales, approximate: bool = False) -> DataFrame:
    """Distinct customers and products; exact unless asked otherwise."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return narrow(sales, *COUNTED).agg(*(count(c).alias(f"distinct_{c}s") for c in COUNTED))


def statistics(
    sales: Sales, approximate: bool = False, profile: DataFrame | None = None
) -> DataFrame:
    """One row of statistics; zeros, empty ids and NULL dates for an empty table.

    Three aggregations, each over the columns it needs. The two small ones come in
    as scalar subqueries, which Spark runs side by side with the main one. A caller
    that also needs the block profile for something else may pass it in.
    """
    ends = first_last(sales)
    distinct = distinct_counts(sales, approximate)
    rows = _or_zero(F.sum("row_count"), "bigint")
    amount = _or_zero(F.sum("amount_sum"), AMOUNT_SUM)
    blocks = block_profile(sales) if profile is None else profile
    totals = blocks.agg(
        rows.alias("total_rows"),
        F.count(F.lit(1)).alias("total_blocks"),
        amount.alias("amount_total"),
        F.when(rows > 0, amount.cast("double") / rows).otherwise(F.lit(0.0)).alias("amount_avg"),
        _or_zero(F.min("amount_min"), AMOUNT).alias("amount_min"),
        _or_zero(F.max("amount_max"), AMOUNT).alias("amount_max"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    return totals.select(
        "*",
        ends.select(F.struct("*")).scalar().alias("ends"),
        distinct.select(F.struct("*")).scalar().alias("distinct"),
    ).select(*totals.columns, "ends.*", "distinct.*")


def top_blocks(headers: DataFrame, count: int = 10) -> DataFrame:
    """The ``count`` blocks with most rows; equal counts go by period."""
    return headers.orderBy(F.desc("row_count"), "period").limit(count)


def table_info(headers: DataFrame) -> DataFrame:
    """Rows, blocks and sorted period list of one side, from its headers."""
    return headers.agg(
        _or_zero(F.sum("row_count"), "bigint").alias("rows"),
        F.count(F.lit(1)).alias("blocks"),
        F.array_sort(F.collect_list("period")).alias("periods"),
    )
