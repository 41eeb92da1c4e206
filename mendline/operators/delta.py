"""Which rows of a block differ, where headers only tell that some do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .blocks import keep_other_blocks


def block_delta(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between the sides, with ``copies``: how many the
    target lacks, or, below zero, has too many of.

    Both sides are bags, so no key is needed; NULLs are equal. Copies are added up
    before the one shuffle, which is by whole rows: neither a large block nor a row that
    occurs very often ends in one task. Give it fetched blocks rather than whole tables.
    """
    sides = source.withColumn("_side", F.lit(1)).unionByName(target.withColumn("_side", F.lit(-1)))
    return sides.groupBy(*source.columns).agg(F.sum("_side").alias("copies")).where("copies <> 0")


def apply_delta(target: DataFrame, delta: DataFrame) -> DataFrame:
    """The target with the missing copies of a ``block_delta`` added and the others taken away.

    Blocks that the delta does not name pass without a shuffle, and of the others only the rows that it names are shuffled.
    """
    from .reconcile import patched_blocks

    return keep_other_blocks(target, delta).unionByName(patched_blocks(target, delta))
