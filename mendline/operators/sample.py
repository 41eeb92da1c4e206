"""A seeded sample of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

RECORD = ("customer", "product", "amount", "period")


def seeded_mark(seed: int, key: Sequence[str]) -> Column:
    """Hex text that orders rows at random, but the same way in every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def sample_rows(
    sales: DataFrame,
    count: int = 10,
    seed: int = 7,
    key: Sequence[str] = ("sale_id",),
    keys: DataFrame | None = None,
) -> DataFrame:
    """Up to ``count`` whole rows without replacement, the same for any partitioning.

    Two top-k passes, in which every task keeps at most ``count`` rows. The first reads
    only keys and then the periods they occur in (from ``keys`` where that is cheaper to compute); the
    second joins whole rows with both. Keys may repeat or be NULL: rows with equal
    keys are ordered by all their columns, whatever their period, and NULL equals NULL. Nothing is collected.
    """
    narrow = sales if keys is None else keys
    by_mark = (seeded_mark(seed, key), *key)
    marked = [F.col(name).alias(f"_{name}") for name in key]
    first = narrow.select(*key).orderBy(*by_mark).limit(count).distinct().select(*marked)
    equal = reduce(and_, (F.col(name).eqNullSafe(F.col(f"_{name}")) for name in key))
    block = F.coalesce("period", F.lit(""))
    chosen = narrow.select("period", *key).join(first, equal, "left_semi")
    chosen = chosen.select(block.alias("block"), *marked).distinct()
    rows = sales.join(chosen, equal & (block == F.col("block")), "left_semi")
    return rows.orderBy(*by_mark, *(c for c in sorted(sales.columns) if c not in key)).limit(count)


def as_records(sales: DataFrame) -> DataFrame:
    """Rows in the form of a sample record: the id as text, then the other fields."""
    return sales.select(F.col("sale_id").cast("string").alias("sale_id"), "sale_ts", *RECORD)


def sample_records(sales: DataFrame, count: int = 10, **options) -> DataFrame:
    """Up to ``count`` sample records; options as for ``sample_rows``."""
    return as_records(sample_rows(sales, count, **options))
