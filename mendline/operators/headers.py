"""Block headers and the pairing of two sides' headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.digest import CONTENT, block_hash
from ..functions.periods import period_of
from ..schema import AMOUNT_SUM


def with_block_hash(totals: DataFrame, digest: str = "md5") -> DataFrame:
    """Headers from ``(period, row_count, amount_sum)``."""
    return totals.select(
        "period",
        "row_count",
        "amount_sum",
        block_hash(F.col("amount_sum"), F.col("row_count"), digest).alias("block_hash"),
    )


def by_block(sales: DataFrame, *figures: Column, derived: bool = False) -> DataFrame:
    """Aggregate per block.

    ``derived`` states that ``period`` is the month of ``sale_ts``. Rows are then grouped
    by the first day of their month, and only the few groups are given their names.
    """
    if not derived:
        return sales.groupBy(F.coalesce("period", F.lit("")).alias("period")).agg(*figures)
    months = sales.groupBy(F.trunc("sale_ts", "month").alias("_month")).agg(*figures)
    period = F.coalesce(period_of(F.col("_month")), F.lit("")).alias("period")
    return months.select(period, "*").drop("_month")


def block_totals(sales: DataFrame, derived: bool = False) -> DataFrame:
    """Row count and amount sum per block.

    Reads two columns. Count and decimal sum keep the aggregation in hash form and
    combine before the shuffle, so a block with most of the rows costs no more
    than one row per task.
    """
    return by_block(
        sales,
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(AMOUNT_SUM).alias("amount_sum"),
        derived=derived,
    )


def block_headers(sales: DataFrame, digest: str = "md5", derived: bool = False) -> DataFrame:
    """``(period, row_count, amount_sum, block_hash)``, one row per block.

    The digest ``content`` reads every column and sees any change of the rows; the others see amounts.
    """
    if digest == CONTENT:
        from .content import content_headers, content_totals

        return content_headers(content_totals(sales, derived))
    return with_block_hash(block_totals(sales, derived), digest)


def _side(headers: DataFrame, name: str) -> DataFrame:
    return headers.select(
        "period",
        F.col("row_count").alias(f"{name}_rows"),
        F.col("amount_sum").alias(f"{name}_amount"),
        F.col("block_hash").alias(f"{name}_hash"),
    )


def pair_headers(source: DataFrame, target: DataFrame, how: str = "left") -> DataFrame:
    """Each source header beside its target header, or beside NULLs.

    Headers of stored tables come out of an aggregation on ``period`` and are already
    partitioned by it, so joining them needs no further shuffle at any size; Spark
    broadcasts one side only when the size it sees at run time is small.
    """
    return _side(source, "source").join(_side(target, "target"), "period", how)


def header_equality(source: DataFrame, target: DataFrame) -> DataFrame:
    """Whether each source header has an equal target header; no partner is unequal."""
    same = F.coalesce(F.col("source_hash") == F.col("target_hash"), F.lit(False))
    return pair_headers(source, target).select(
        "period", "source_hash", "target_hash", same.alias("same")
    )
