"""The plan of a sync: one action per source block."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.texts import block_message
from ..operators.headers import pair_headers
from ..schema import INSERT, REPAIR, SKIP


def sync_plan(source_headers: DataFrame, target_headers: DataFrame) -> DataFrame:
    """Per source block: INSERT when the target lacks it, SKIP when the hashes agree,
    REPAIR when they differ. Blocks that only the target has do not appear.
    """
    action = (
        F.when(F.col("target_hash").isNull(), INSERT)
        .when(F.col("source_hash") == F.col("target_hash"), SKIP)
        .otherwise(REPAIR)
    )
    return pair_headers(source_headers, target_headers).select(
        "period",
        action.alias("action"),
        "source_hash",
        F.col("target_hash").alias("target_hash_before"),
        F.col("source_rows").alias("row_count"),
    )


def changed_blocks(plan: DataFrame) -> DataFrame:
    """Periods to copy."""
    return plan.filter(F.col("action") != SKIP).select("period")


def block_results(plan: DataFrame) -> DataFrame:
    """What a sync does per block: rows processed, rows inserted, and a message.

    A skipped block counts as processed with the rows of its source header.
    """
    inserted = F.when(F.col("action") == SKIP, F.lit(0)).otherwise(F.col("row_count"))
    return plan.select(
        "period",
        "action",
        "source_hash",
        "target_hash_before",
        F.col("row_count").alias("rows_processed"),
        inserted.cast("bigint").alias("rows_inserted"),
        block_message(F.col("action"), F.col("row_count").cast("string")).alias("message"),
        F.lit(False).alias("failed"),
    )
