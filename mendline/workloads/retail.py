"""Sales tables over the given order tables.

Orders, customers and parts are looked up by their primary keys with left joins, so a
lookup neither drops nor repeats a sale, and each function joins only what the wanted
columns need: a block header over line items reads line items alone. Join strategies are
left to Spark, which goes by the measured sizes and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.periods import period_of
from ..operators.blocks import fetch_block
from ..operators.perturb import perturb_block
from ..schema import AMOUNT, SALES

EXTRA_PERIOD = "1994-12"
COPIED_PERIOD = "1995-01"
PERTURBED_PERIOD = "1997-03"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _look_up(rows: DataFrame, table: DataFrame, left: str, right: str) -> DataFrame:
    return rows.join(table, F.col(left) == F.col(right), "left").drop(right)


def _sales(rows: DataFrame, values: dict[str, Column], wanted: tuple[str, ...]) -> DataFrame:
    # Values are computed after the joins, so that only the stored columns are shuffled.
    return rows.select(*(values[name].alias(name) for name in wanted))


def source_sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One sale per line item."""
    wanted = columns or tuple(SALES.names)
    rows = read(spark, sf_dir, "lineitem")
    if "customer" in wanted:
        orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
        names = _look_up(orders, customers, "o_custkey", "c_custkey")
        rows = _look_up(rows, names, "l_orderkey", "o_orderkey")
    if "product" in wanted:
        parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
        rows = _look_up(rows, parts, "l_partkey", "p_partkey")
    values = {
        "sale_id": F.col("l_orderkey"),
        "line_no": F.col("l_linenumber"),
        "sale_ts": F.col("l_shipdate"),
        "customer": _text("c_name"),
        "product": _text("p_name"),
        "amount": F.col("l_extendedprice").cast(AMOUNT),
        "period": period_of(F.col("l_shipdate")),
    }
    return _sales(rows, values, wanted)


def target_sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The source as an older copy: one kind of change in each of four months.

    April is absent; July has other amounts on every fifth sale id; October lacks
    first lines; February has other customers, which no hash sees. One block
    exists here only.
    """
    wanted = columns or tuple(SALES.names)
    needed = dict.fromkeys((*wanted, "sale_id", "line_no", "sale_ts", "period"))
    source = source_sales(spark, sf_dir, *needed)
    month = F.month("sale_ts")
    first_line = F.coalesce(F.col("line_no") == 1, F.lit(False))
    kept = source.filter((month != 4) & ~((month == 10) & first_line))
    if "amount" in wanted:
        raised = (month == 7) & (F.col("sale_id") % 5 == 0)
        more = (F.col("amount") + 1).cast(AMOUNT)
        kept = kept.withColumn("amount", F.when(raised, more).otherwise(F.col("amount")))
    if "customer" in wanted:
        kept = kept.withColumn("customer", F.when(month == 2, "X").otherwise(F.col("customer")))
    extra = fetch_block(source, COPIED_PERIOD, derived=True).withColumn(
        "period", F.lit(EXTRA_PERIOD)
    )
    return kept.select(*wanted).unionByName(extra.select(*wanted))


def order_sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One sale per order, with a unique id."""
    wanted = columns or tuple(SALES.names)
    rows = read(spark, sf_dir, "orders")
    if "customer" in wanted:
        customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
        rows = _look_up(rows, customers, "o_custkey", "c_custkey")
    values = {
        "sale_id": F.col("o_orderkey"),
        "line_no": F.lit(1),
        "sale_ts": F.col("o_orderdate"),
        "customer": _text("c_name"),
        "product": _text("o_orderpriority"),
        "amount": F.col("o_totalprice").cast(AMOUNT),
        "period": period_of(F.col("o_orderdate")),
    }
    return _sales(rows, values, wanted)


def perturbed_sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The orders' sales with one damaged block."""
    wanted = columns or tuple(SALES.names)
    needed = dict.fromkeys((*wanted, "sale_id", "amount", "period"))
    sales = order_sales(spark, sf_dir, *needed)
    keys = order_sales(spark, sf_dir, "sale_id", "sale_ts", "period")
    return perturb_block(sales, PERTURBED_PERIOD, keys=keys, derived=True).select(*wanted)


def period_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for a period per order, valid or not, some without year or month."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.when(key % 23 != 0, F.year("o_orderdate") + 22).alias("year"),
        F.when(key % 29 != 0, (key % 15).cast("int")).alias("month"),
    )


# The argument that would otherwise come from the clock.
CURRENT_YEAR = 2022
