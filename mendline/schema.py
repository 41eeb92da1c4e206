"""Columns of the sales table and of the block headers, and the fixed words of a plan."""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 2)
AMOUNT_SUM = T.DecimalType(28, 2)


def sales_schema(id_type: T.DataType = T.LongType()) -> T.StructType:
    """Schema of a sales table; ``period`` is its partition column."""
    return T.StructType(
        [
            T.StructField("sale_id", id_type),
            T.StructField("line_no", T.IntegerType()),
            T.StructField("sale_ts", T.TimestampNTZType()),
            T.StructField("customer", T.StringType()),
            T.StructField("product", T.StringType()),
            T.StructField("amount", AMOUNT),
            T.StructField("period", T.StringType()),
        ]
    )


SALES = sales_schema()

# Actions of a plan.
SKIP = "SKIP"
INSERT = "INSERT"
REPAIR = "REPAIR"

# States of one block in a comparison.
BLOCK_IN_SYNC = "IN_SYNC"
BLOCK_MISSING = "MISSING_IN_TARGET"
BLOCK_CORRUPT = "CORRUPT"

# States of the whole system.
NEVER_SYNCED = "NEVER_SYNCED"
OUT_OF_SYNC = "OUT_OF_SYNC"
IN_SYNC = "IN_SYNC"
PARTIALLY_SYNCED = "PARTIALLY_SYNCED"
