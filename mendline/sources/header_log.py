"""Headers remembered per exact set of files, so that unchanged blocks are not re-read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.blocks import fetch_named_blocks
from ..operators.headers import block_totals, with_block_hash
from ..schema import AMOUNT_SUM
from ..scratch import materialise
from .table import BlockTable

FILES_PER_TASK = "64g"  # by their lengths; the tasks number at least the cores

_LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("period", T.StringType()),
    ]
)

_LOG = T.StructType(
    [
        T.StructField("period", T.StringType()),
        T.StructField("files_mark", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("amount_sum", AMOUNT_SUM),
    ]
)


def file_marks(table: BlockTable) -> DataFrame:
    """``(period, files_mark)``: names, lengths and times of each block's files, digested.

    No file content is read. The sum of per-file hashes does not depend on the order
    of the listing, so it combines before the shuffle. Spark would give every large
    file a task of its own; the listing has its own session, in which tasks take
    many files each.
    """
    spark = table.spark
    if not table.exists():
        return spark.createDataFrame([], "period string, files_mark string")
    lister = spark.newSession()
    lister.conf.set("spark.sql.files.maxPartitionBytes", FILES_PER_TASK)
    files = (
        lister.read.format("binaryFile")
        .schema(_LISTING)
        .option("pathGlobFilter", "*.parquet")
        .load(table.path)
    )
    mark = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    marks = (
        files.groupBy(F.coalesce("period", F.lit("")).alias("period"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum(mark.cast("decimal(20,0)")).alias("marks"),
            F.sum("length").alias("bytes"),
        )
        .select("period", F.concat_ws("|", "files", "bytes", "marks").alias("files_mark"))
    )
    return materialise(marks, "file-marks", spark)


class HeaderLog:
    """An append-only table of totals keyed by block and file set.

    A remembered total counts only while the block's files are exactly those it was
    computed from; any write to a block, by anyone, brings new files and makes the
    block be read again. Rows are only ever added, so writers do not conflict.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._log = BlockTable(spark, path, _LOG)
        self.spark = spark

    def _known(self) -> DataFrame:
        # The same file set always has the same totals; it may have been logged twice.
        return self._log.read().groupBy("period", "files_mark").agg(
            F.max("row_count").alias("row_count"), F.max("amount_sum").alias("amount_sum")
        )

    def headers(self, table: BlockTable, digest: str = "md5") -> DataFrame:
        """Headers of ``table``; reads only blocks whose files are new to the log."""
        if not table.IN_PLACE:
            raise TypeError("a table with versions has files under its path that are not its own now")
        before = file_marks(table)
        looked_up = materialise(
            before.join(self._known(), ["period", "files_mark"], "left"), "header-log"
        )
        fresh = looked_up.filter(F.col("row_count").isNotNull())
        stale = looked_up.filter(F.col("row_count").isNull()).select("period")
        totals = fresh.select("period", "row_count", "amount_sum")
        if not stale.isEmpty():
            rows = fetch_named_blocks(table.read(), stale)
            computed = materialise(block_totals(rows), "header-log")
            self._remember(computed, looked_up, file_marks(table))
            totals = totals.unionByName(computed)
        return with_block_hash(totals, digest)

    def _remember(self, computed: DataFrame, before: DataFrame, after: DataFrame) -> None:
        # Log a total only if the block's files were the same before and after reading.
        steady = before.select("period", "files_mark").join(
            after, ["period", "files_mark"], "left_semi"
        )
        rows = computed.join(steady, "period").select(*_LOG.names)
        rows.write.mode("append").parquet(self._log.path)
