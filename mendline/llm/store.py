"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as it is dealt out to the shared scratch folder, and read back.

    Cuts the lineage: what follows survives lost executors without computing ``df`` again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: Column, by: int) -> Column:
    """crc32 of ``key`` as text, modulo ``by``; NULL for a NULL key."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(by))


def count_of(df: DataFrame, *sums: Column) -> tuple:
    """Aggregates over all of ``df``, as plain numbers (0 for an empty table)."""
    return tuple(x or 0 for x in df.agg(*sums).first())
