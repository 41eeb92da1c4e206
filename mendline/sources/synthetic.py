"""Generated sales: every value is a function of the id and the seed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.periods import instant, period_of
from ..schema import AMOUNT, SALES
from .table import BlockTable

# Fixed values of the generator: seed, number of rows, first date, bounds of the amount in cents.
SEED = 8675309
ROWS = 1_000_000
FIRST_DATE = datetime(2022, 1, 1)
LEAST_CENTS = 1_000
MOST_CENTS = 500_000


def _piece(digits: Column, number: int) -> Column:
    """The n-th group of eight hex digits as a number below 2^32."""
    return F.conv(F.substring(digits, 8 * number + 1, 8), 16, 10).cast("bigint")


def sales_from_ids(
    ids: DataFrame,
    end: datetime,
    start: datetime = FIRST_DATE,
    seed: int = SEED,
    customers: int = 1_000,
    products: int = 200,
) -> DataFrame:
    """One sale per row of ``ids`` (a single column), dated from ``start`` to before ``end``.

    One digest per row feeds all fields, so the result does not depend on how
    the ids are partitioned, and needs no shuffle.
    """
    (id_column,) = ids.columns
    digits = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string")))
    drawn = ids.select(F.col(id_column).cast("bigint").alias("sale_id"), digits.alias("digits"))
    digits = F.col("digits")
    seconds = int((end - start).total_seconds())
    after = (_piece(digits, 0) % seconds).cast("int")
    cents = F.lit(LEAST_CENTS) + _piece(digits, 1) % (MOST_CENTS - LEAST_CENTS + 1)

    def numbered(word: str, piece: int, count: int) -> Column:
        number = (_piece(digits, piece) % count).cast("string")
        return F.concat(F.lit(f"{word} "), F.lpad(number, 6, "0"))

    return drawn.select(
        "sale_id",
        F.lit(1).alias("line_no"),
        (instant(start) + F.make_dt_interval(secs=after.cast("decimal(18,6)"))).alias("sale_ts"),
        numbered("Customer", 2, customers).alias("customer"),
        numbered("Product", 3, products).alias("product"),
        (cents.cast("decimal(18,0)") * F.lit(0.01).cast("decimal(2,2)")).cast(AMOUNT).alias("amount"),
    ).select(*SALES.names[:-1], period_of(F.col("sale_ts")).alias("period"))


def synthetic_sales(spark: SparkSession, end: datetime, rows: int = ROWS, **options) -> DataFrame:
    """``rows`` generated sales."""
    return sales_from_ids(spark.range(rows), end, **options)


def write_synthetic(
    spark: SparkSession, path: str, end: datetime, rows: int = ROWS, **options
) -> BlockTable:
    """Generated sales as a table of blocks."""
    table = BlockTable(spark, path)
    table.append(synthetic_sales(spark, end, rows, **options))
    return table
