"""Headers of a table that only grows, kept by a stream instead of being computed from all rows.

Structured Streaming holds the totals of each block as state: a batch adds up its own rows per block, before any shuffle, and hands on the
new totals of the blocks it met (update mode). These are merged into a small table, one row for each block, of which every batch
writes a version under its number. A batch that is run again after a failure finds the version before its own and writes its own anew, so
it counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.headers import block_totals, with_block_hash
from ..schema import AMOUNT_SUM
from ..scratch import materialise

_TOTALS = f"period string, row_count bigint, amount_sum {AMOUNT_SUM.simpleString()}"


class HeaderStream:
    """Totals of the blocks of a stream of sales, under ``path``: ``totals/batch=<number>`` and the stream's ``checkpoint``.

    Rows are only ever added: a source that takes rows back needs headers computed anew. ``derived`` is as for ``block_headers``.
    """

    def __init__(self, spark: SparkSession, path: str, derived: bool = False):
        self.spark = spark
        self.path = path.rstrip("/")
        self.derived = derived

    def start(self, sales: DataFrame, **trigger) -> StreamingQuery:
        """Follow a streaming DataFrame of sales; ``trigger`` as for a stream writer."""
        writer = block_totals(sales, self.derived).writeStream.outputMode("update").foreachBatch(self._merge)
        return writer.option("checkpointLocation", f"{self.path}/checkpoint").trigger(**trigger).start()

    def catch_up(self, sales: DataFrame) -> None:
        """Take in what there is and has not been counted yet, in as many batches as the source gives."""
        self.start(sales, availableNow=True).awaitTermination()

    def headers(self, digest: str = "md5") -> DataFrame:
        """Headers of all rows so far; none before the first batch."""
        return with_block_hash(self._before(None), digest)

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        """Numbers of the batches whose totals are whole."""
        fs, folder = self._folder()
        names = [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = (name for name in names if name.startswith("batch=") and fs.exists(self._folder(f"/{name}/_SUCCESS")[1]))
        return sorted(int(name[6:]) for name in whole)

    def _before(self, batch: int | None, spark: SparkSession | None = None) -> DataFrame:
        """The totals of the last batch before this one, or of the last of all; in a stream's own session, if given."""
        spark = spark or self.spark
        earlier = [n for n in self._versions() if batch is None or n < batch]
        if not earlier:
            return spark.createDataFrame([], _TOTALS)
        return spark.read.schema(_TOTALS).parquet(f"{self.path}/totals/batch={earlier[-1]}")

    def _merge(self, changes: DataFrame, batch: int) -> None:
        new = materialise(changes, "stream-totals")  # the state is read and written once
        before = self._before(batch, new.sparkSession)
        merged = before.join(new, "period", "left_anti").unionByName(new)
        merged.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        for old in self._versions()[:-2]:  # the one before may be needed again
            fs, folder = self._folder(f"/batch={old}")
            fs.delete(folder, True)
