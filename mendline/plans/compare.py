"""Comparison of the two sides, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.headers import pair_headers
from ..schema import BLOCK_CORRUPT, BLOCK_IN_SYNC, BLOCK_MISSING


def _info(side: str) -> Column:
    return F.struct(
        F.col(f"{side}_hash").alias("hash"),
        F.col(f"{side}_rows").alias("rows"),
        F.col(f"{side}_amount").alias("amount"),
    )


def hash_comparison(source_headers: DataFrame, target_headers: DataFrame) -> DataFrame:
    """Per source block its state and both sides' figures; the target is NULL when missing."""
    state = (
        F.when(F.col("target_hash").isNull(), BLOCK_MISSING)
        .when(F.col("source_hash") == F.col("target_hash"), BLOCK_IN_SYNC)
        .otherwise(BLOCK_CORRUPT)
    )
    return (
        pair_headers(source_headers, target_headers)
        .select(
            "period",
            state.alias("state"),
            _info("source").alias("source"),
            F.when(F.col("target_hash").isNotNull(), _info("target")).alias("target"),
        )
        .orderBy("period")
    )


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """How many blocks are in which state."""
    return comparison.agg(
        F.count(F.lit(1)).alias("total_periods"),
        F.count_if(F.col("state") == BLOCK_IN_SYNC).alias("in_sync"),
        F.count_if(F.col("state") == BLOCK_MISSING).alias("missing_in_target"),
        F.count_if(F.col("state") == BLOCK_CORRUPT).alias("corrupt"),
    )
