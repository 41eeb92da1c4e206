"""A sales table on Parquet, one directory per block."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.blocks import fetch_blocks
from ..operators.headers import block_headers
from ..operators.stats import table_info
from ..schema import SALES

KEEP = "keep"
REBALANCE = "rebalance"


class BlockTable:
    """Read, append, replace, delete and clear blocks of a partitioned table.

    Every call reads the current file list, so a DataFrame taken before a write
    should not be used after it.
    """

    #: Whether all files under the path make up the table.
    IN_PLACE = True

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = SALES):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def _fs_path(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._fs_path()
        return fs.exists(path)

    def read(self) -> DataFrame:
        """All rows; a table that was never written is empty."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def fetch(self, *periods: str) -> DataFrame:
        """Rows of the given blocks: only their directories are read."""
        return fetch_blocks(self.read(), periods)

    def headers(self, digest: str = "md5") -> DataFrame:
        """Block headers, from a scan of the amounts."""
        return block_headers(self.read(), digest)

    def info(self) -> DataFrame:
        """Rows, blocks and the sorted list of periods."""
        return table_info(self.headers())

    def _writer(self, rows: DataFrame, layout: str):
        if layout not in (KEEP, REBALANCE):
            raise ValueError(f"layout must be {KEEP!r} or {REBALANCE!r}, not {layout!r}")
        rows = rows.select(*self.schema.names)
        if layout == REBALANCE and self.spark.conf.get("spark.sql.adaptive.enabled") != "true":
            # Nothing would split or join what the hint deals out; a few tasks per block do.
            rows = rows.repartition("period", F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
        elif layout == REBALANCE:
            # One shuffle by block; adaptive execution then splits the partitions of
            # large blocks and joins those of small ones to files of even size.
            rows = rows.hint("rebalance", "period")
        return rows.write.partitionBy("period")

    def append(self, rows: DataFrame, layout: str = REBALANCE) -> None:
        """Add rows as they are; nothing is de-duplicated."""
        self._writer(rows, layout).mode("append").parquet(self.path)

    def replace(self, rows: DataFrame, layout: str = REBALANCE) -> None:
        """Put ``rows`` in the place of every block that occurs in them, in one job.

        New files are staged and swapped in at commit: a failed job leaves the old
        blocks, and running it twice gives the same table. ``layout="keep"`` writes
        without a shuffle, for rows that come from a table partitioned by period.
        """
        (
            self._writer(rows, layout)
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(self.path)
        )

    def delete(self, periods: Iterable[str]) -> None:
        """Drop blocks by removing their directories; absent ones are ignored."""
        naming = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for period in periods:
            fs, path = self._fs_path(naming.getPartitionPathString("period", period))
            fs.delete(path, True)

    def pinned(self) -> BlockTable:
        """A handle for a plan and the writes that follow from it; here the table itself, which has no versions."""
        return self

    def replace_all(self, rows: DataFrame) -> None:
        """Put ``rows``, which must not read this table, in the place of everything.

        The new blocks go first, staged as by ``replace``, and blocks without rows are removed
        last: a write that fails leaves every row.
        """
        self.replace(rows)
        named = lambda df: df.select(F.coalesce("period", F.lit("")).alias("period")).distinct()
        stale = named(self.read()).join(named(rows), "period", "left_anti")
        self.delete([row.period for row in stale.toLocalIterator()])

    def clear(self) -> None:
        """Remove all rows, keeping an empty table."""
        (
            self.spark.createDataFrame([], self.schema)
            .write.partitionBy("period")
            .mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .parquet(self.path)
        )
