"""Controlled damage to one block, to test detection and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import AMOUNT
from .blocks import fetch_block, in_blocks
from .sample import seeded_mark

SLOT_DIGITS = 4  # 16^4 slots: the histogram of marks has at most 65,536 rows


def scale_factor(mark: Column) -> Column:
    """A factor in [0.500, 1.499], read from digits of the mark that ordering rarely reaches."""
    number = F.conv(F.substring(mark, 25, 8), 16, 10).cast("bigint")
    return F.lit(0.5).cast("decimal(4,3)") + (number % 1000).cast("decimal(4,0)") * F.lit(
        0.001
    ).cast("decimal(4,3)")


def _last_hit(block: DataFrame, divisor: int) -> DataFrame:
    """The (mark, key) of the k-th row in mark order, k = max(1, rows / divisor).

    Ranking the whole block would put it into one task. Instead a histogram over the
    leading digits of the mark, combined before its shuffle, tells in which slot the
    k-th row lies; only that slot, about 1/65,536 of the block, is ranked.
    """
    slot = F.substring("mark", 1, SLOT_DIGITS).alias("slot")
    slots = block.groupBy(slot).agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("slot").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    running = slots.select(
        "slot",
        "n",
        F.sum("n").over(in_order).alias("upto"),
        F.greatest(F.lit(1), F.floor(F.sum("n").over(everything) / divisor)).alias("k"),
    )
    edge = running.filter(
        (F.col("k") > F.col("upto") - F.col("n")) & (F.col("k") <= F.col("upto"))
    ).select("slot", (F.col("k") - F.col("upto") + F.col("n")).alias("need"))
    # ``edge`` is a single row by construction.
    near = (
        block.withColumn("slot", slot)
        .join(F.broadcast(edge), "slot")
        .groupBy("slot", "need", "mark", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = Window.partitionBy("slot").orderBy("mark", "key").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        near.withColumn("upto", F.sum("n").over(rank))
        .filter(F.col("upto") >= F.col("need"))
        .agg(F.min(F.struct("mark", "key")).alias("last"))
    )


def perturb_block(
    sales: DataFrame,
    period: str,
    divisor: int = 5,
    seed: int = 7,
    key: str = "sale_id",
    keys: DataFrame | None = None,
    derived: bool = False,
) -> DataFrame:
    """Scale the amounts of ``max(1, rows / divisor)`` rows of one block.

    The rows are chosen without replacement by a seeded order over ``key``, which
    must be unique within the block. All other rows, and a table without the
    block, come back unchanged. The choice needs only keys and periods; ``keys`` gives
    them where that is cheaper than from ``sales``. ``derived`` is as for ``fetch_blocks``.
    """
    if not 3 <= divisor <= 9:
        raise ValueError("divisor must be between 3 and 9")
    mark = seeded_mark(seed, [key])
    block = (
        fetch_block(sales if keys is None else keys, period, derived)
        .select(mark.alias("mark"), F.col(key).alias("key"))
    )
    last = _last_hit(block, divisor).scalar()
    here = F.struct(mark.alias("mark"), F.col(key).alias("key"))
    # ``last`` is NULL for an absent block, and NULL is not a hit.
    hit = in_blocks([period]) & (here <= last)
    scaled = (F.col("amount") * scale_factor(mark)).cast(AMOUNT)
    return sales.withColumn("amount", F.when(hit, scaled).otherwise(F.col("amount")))
