"""Diagnostics of both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.texts import summary_sentence
from ..operators.headers import with_block_hash
from ..operators.sample import sample_records
from ..operators.stats import Sales, block_profile, statistics, top_blocks
from ..scratch import materialise


def side_statistics(
    source: Sales, target: Sales, approximate: bool = False, derived: bool = False
) -> DataFrame:
    """Statistics of both sides, one row each; ``derived`` is about the source only."""

    def side(name: str, sales: Sales, derived: bool) -> DataFrame:
        stats = statistics(sales, approximate, block_profile(sales, derived))
        return stats.select(F.lit(name).alias("side"), *stats.columns)

    return side("source", source, derived).unionByName(side("target", target, False))


def summary(sides: DataFrame) -> DataFrame:
    """The sentence over both sides' statistics."""

    def of(side: str, name: str):
        return F.max(F.when(F.col("side") == side, F.col(name)))

    return sides.agg(
        summary_sentence(
            of("source", "total_rows"),
            of("source", "total_blocks"),
            of("target", "total_rows"),
            of("source", "distinct_customers"),
            of("source", "distinct_products"),
        ).alias("summary")
    )


def side_top_blocks(
    source_headers: DataFrame, target_headers: DataFrame, count: int = 10
) -> DataFrame:
    """The largest blocks of both sides."""

    def side(name: str, headers: DataFrame) -> DataFrame:
        return top_blocks(headers, count).select(F.lit(name).alias("side"), "*")

    return side("source", source_headers).unionByName(side("target", target_headers))


def diagnostics(
    source: DataFrame,
    target: DataFrame,
    sample: int = 10,
    seed: int = 7,
    key: Sequence[str] = ("sale_id",),
    approximate: bool = False,
    digest: str = "md5",
    derived: bool = False,
) -> DataFrame:
    """One row: both sides' statistics, their largest blocks, a sample and the sentence.

    Nested lists hold at most ten blocks per side and ``sample`` records. The block
    profiles are written out once, as statistics and largest blocks both come from them.
    """

    def side(name: str, sales: DataFrame, derived: bool) -> tuple[DataFrame, Column]:
        profile = materialise(block_profile(sales, derived), "profile")
        stats = statistics(sales, approximate, profile)
        best = top_blocks(with_block_hash(profile, digest))
        ranked = F.struct(-F.col("row_count"), "period", F.struct(*best.columns).alias("block"))
        listed = F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["block"])
        one = stats.select(F.struct(*stats.columns).alias(name))
        return one, best.select(listed).scalar()

    source_stats, source_top = side("source", source, derived)
    target_stats, target_top = side("target", target, False)
    records = sample_records(source, sample, seed=seed, key=key)
    return source_stats.select("source", target_stats.scalar().alias("target")).select(
        "source",
        "target",
        source_top.alias("source_top"),
        target_top.alias("target_top"),
        records.select(F.collect_list(F.struct(*records.columns))).scalar().alias("sample"),
        summary_sentence(
            F.col("source.total_rows"),
            F.col("source.total_blocks"),
            F.col("target.total_rows"),
            F.col("source.distinct_customers"),
            F.col("source.distinct_products"),
        ).alias("summary"),
    )
