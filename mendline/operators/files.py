"""Which stored files a repair has to write anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .blocks import fetch_named_blocks
from .reconcile import with_copies, with_key

_KEY = ("_block", "_high", "_low")


def files_to_rewrite(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """``file``: enough files to take away every row of which ``delta`` says that there are too many (``copies`` below zero).

    ``rows`` are the target's, each with the ``file`` that holds it. Of the files that hold copies of one row, those with most copies are
    taken first, by name among equals, until they hold as many as are to go. Missing rows need no file, nor does a row to go that
    the target does not have. Copies are counted per row and file before any shuffle of the target's rows; NULL and the empty period are one block.
    """
    surplus = delta.where("copies < 0")
    block = F.coalesce("period", F.lit(""))
    named = with_key(surplus).select(block.alias("period"), F.col("_high").alias("high"), F.col("_low").alias("low"), (-F.col("copies")).alias("copies"))
    held = with_key(with_copies(fetch_named_blocks(rows, surplus), named).where("copies IS NOT NULL"))
    counted = held.withColumn("_block", block).groupBy(*_KEY, "copies", "file").agg(F.count("*").alias("held"))
    before = Window.partitionBy(*_KEY).orderBy(F.desc("held"), "file").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("held").over(before), F.lit(0))
    return counted.withColumn("ahead", ahead).where("ahead < copies").select("file").distinct()
