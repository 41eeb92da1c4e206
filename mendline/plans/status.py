"""The overall state of the two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.headers import pair_headers
from ..schema import IN_SYNC, NEVER_SYNCED, OUT_OF_SYNC, PARTIALLY_SYNCED


def _info(side: str) -> Column:
    present = F.col(f"{side}_hash").isNotNull()
    return F.struct(
        F.coalesce(F.sum(f"{side}_rows"), F.lit(0)).cast("bigint").alias("rows"),
        F.count(f"{side}_hash").alias("blocks"),
        F.array_sort(F.collect_list(F.when(present, F.col("period")))).alias("periods"),
    ).alias(side)


def system_status(source_headers: DataFrame, target_headers: DataFrame) -> DataFrame:
    """Rows, blocks and periods of both sides, and the state.

    An empty target was never synced, even from an empty source. Different numbers of
    blocks are out of sync. With equal numbers it is in sync when every source block
    has an equal partner, and partially synced otherwise.
    """
    same = F.coalesce(F.col("source_hash") == F.col("target_hash"), F.lit(False))
    all_same = F.bool_and(F.when(F.col("source_hash").isNotNull(), same))
    sides = pair_headers(source_headers, target_headers, "full").agg(
        _info("source"),
        _info("target"),
        F.coalesce(all_same, F.lit(True)).alias("all_same"),
    )
    state = (
        F.when(F.col("target.rows") == 0, NEVER_SYNCED)
        .when(F.col("source.blocks") != F.col("target.blocks"), OUT_OF_SYNC)
        .when(F.col("all_same"), IN_SYNC)
        .otherwise(PARTIALLY_SYNCED)
    )
    return sides.select("source", "target", state.alias("state"))
