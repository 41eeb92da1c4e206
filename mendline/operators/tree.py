"""A tree of digests: month, day, and bucket of sale ids. Only nodes that differ are looked into.

A node's digest is its row count and the sums of both halves of its rows' keys (``reconcile``), so a node has the sum of its children's. Each side reads its rows once, for the digests of its leaves, which are
stored; months and days are added up from these. The first level compares months, the second the days of the differing months, and the third the buckets of their differing days. What is left are
the leaves: about ``1 / (30 * buckets)`` of a month each, which is what a repair has to fetch from the source. Shuffled: a row per task and leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.periods import period_of
from ..scratch import materialise
from .blocks import collected_spans, fetch_named_blocks
from .content import sum_of
from .reconcile import with_key

BUCKETS = 16
LEAF = ("period", "day", "bucket")
_DIGEST = ("row_count", "high_sum", "low_sum")


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a sale id, by the first 32 bits of its MD5; rows without id are in the first."""
    number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(F.pmod(number, F.lit(buckets)), F.lit(0)).cast("int")


def with_leaf(sales: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows with the names of their nodes; NULL periods and times are the empty name."""
    return sales.withColumns(
        {
            "_period": F.coalesce("period", F.lit("")),
            "_day": F.coalesce(F.date_format("sale_ts", "yyyy-MM-dd"), F.lit("")),
            "_bucket": bucket_of(F.col("sale_id"), buckets),
        }
    )


def leaf_digests(sales: DataFrame, buckets: int = BUCKETS, derived: bool = False) -> DataFrame:
    """``(period, day, bucket, row_count, high_sum, low_sum)`` of the leaves, by the names that ``with_leaf`` gives; rows are read once.

    Rows are grouped by date and, unless ``derived``, block; only the groups are given their names.
    """
    keys = [F.to_date("sale_ts").alias("_date"), bucket_of(F.col("sale_id"), buckets).alias("bucket")]
    if not derived:
        keys.append(F.coalesce("period", F.lit("")).alias("_block"))
    figures = (F.count(F.lit(1)).alias("row_count"), *(sum_of(F.col(half)).alias(name) for half, name in zip(("_high", "_low"), _DIGEST[1:])))
    leaves = with_key(sales).groupBy(*keys).agg(*figures)
    period = F.coalesce(period_of(F.col("_date")), F.lit("")) if derived else F.col("_block")
    day = F.coalesce(F.date_format("_date", "yyyy-MM-dd"), F.lit(""))
    return leaves.select(period.alias("period"), day.alias("day"), "bucket", *_DIGEST)


def _nodes(leaves: DataFrame, level: int) -> DataFrame:
    kinds = {f.name: f.dataType for f in leaves.schema}
    return leaves.groupBy(*LEAF[:level]).agg(*(F.sum(name).cast(kinds[name]).alias(name) for name in _DIGEST))


def _differing(source: DataFrame, target: DataFrame, level: int) -> DataFrame:
    """Nodes whose digests differ, with both sides' rows. Months that only the target has are not its business."""
    named = lambda nodes, side: nodes.select(*LEAF[:level], *(F.col(name).alias(f"{side}_{name}") for name in _DIGEST))
    pairs = named(_nodes(source, level), "s").join(named(_nodes(target, level), "t"), list(LEAF[:level]), "left" if level == 1 else "full")
    same = F.lit(True)
    for name in _DIGEST:
        same = same & F.col(f"s_{name}").eqNullSafe(F.col(f"t_{name}"))
    rows = (F.coalesce(f"{side}_row_count", F.lit(0)).cast("bigint").alias(name) for side, name in (("s", "source_rows"), ("t", "target_rows")))
    return pairs.where(~same).select(*LEAF[:level], *rows)


def _in_nodes(rows: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Rows with ``_there``, true or NULL: whether one of the nodes holds them."""
    names = nodes.select(*(F.col(name).alias(f"_n_{name}") for name in LEAF[:level]), F.lit(True).alias("_there"))
    same = F.lit(True)
    for name in LEAF[:level]:
        same = same & (F.col(f"_{name}") == F.col(f"_n_{name}"))
    return rows.join(names, same, "left").drop(*(f"_n_{name}" for name in LEAF[:level]))


def differing_leaves(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, derived: bool = False) -> DataFrame:
    """``(period, day, bucket, source_rows, target_rows)`` of the leaves that differ, in months that the source has.

    ``derived`` is as for ``fetch_named_blocks``.
    """
    sides = [materialise(leaf_digests(side, buckets, own), "leaves") for side, own in ((source, derived), (target, False))]
    for level in (1, 2):
        differing = _differing(*sides, level).select(*LEAF[:level])
        sides = [side.join(differing, list(LEAF[:level]), "left_semi") for side in sides]
    return materialise(_differing(*sides, 3), "differing-leaves")


def fetch_leaves(sales: DataFrame, leaves: DataFrame, buckets: int = BUCKETS, derived: bool = False) -> DataFrame:
    """The rows of the leaves; other months are not read."""
    rows = with_leaf(fetch_named_blocks(sales, leaves, derived, collected_spans(leaves) if derived else None), buckets)
    return _in_nodes(rows, leaves, 3).where("_there").select(*sales.columns)


def other_leaves(sales: DataFrame, leaves: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the leaves' months that are in none of the leaves."""
    rows = with_leaf(fetch_named_blocks(sales, leaves), buckets)
    return _in_nodes(rows, leaves, 3).where("_there IS NULL").select(*sales.columns)


def mended_blocks(source: DataFrame, target: DataFrame, leaves: DataFrame, buckets: int = BUCKETS, derived: bool = False) -> DataFrame:
    """What the leaves' months hold after a repair: differing leaves from the source, all else from the target."""
    return other_leaves(target, leaves, buckets).unionByName(fetch_leaves(source, leaves, buckets, derived))
