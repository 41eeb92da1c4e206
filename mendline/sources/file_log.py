"""Figures remembered per file of a table with versions: headers without reading a file twice, and ranges of time without reading a file in vain."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.digest import CONTENT
from ..functions.periods import instant
from ..operators.content import bag_figures, content_headers, row_mark
from ..operators.headers import with_block_hash
from ..schema import AMOUNT_SUM, SALES
from .snapshot import SnapshotTable

_SUMS = {"row_count": T.LongType(), "amount_sum": AMOUNT_SUM, "high_sum": T.DecimalType(38, 0), "low_sum": T.DecimalType(38, 0)}
_TIME = SALES["sale_ts"].dataType
_LOG = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.StringType()),
        *(T.StructField(name, kind) for name, kind in _SUMS.items()),
        T.StructField("least", _TIME),
        T.StructField("greatest", _TIME),
        T.StructField("period", T.StringType()),  # of the log itself, which is one block
    ]
)
_FIGURES = ("block", *_SUMS, "least", "greatest")


class FileLog:
    """Rows, sums, and least and greatest time of each file, kept as a table with versions of its own.

    Files of a ``SnapshotTable`` are never altered and no name comes twice, so a name alone tells whether its figures are known. Headers of a version are the
    sums of its files' figures: files that came are read and added, those that went are left out, and the other files of a changed
    block are not read again. Logging a file twice, as two runs at once may, changes nothing. ``content`` also keeps what
    the digest of whole rows needs, for which every column of a new file is read instead of three. The driver holds the names of a version's
    files, as Spark's own listing of them does. A file without rows is remembered too; rows without a time are in no range.
    """

    def __init__(self, spark: SparkSession, path: str, content: bool = False):
        self.spark = spark
        self.content = content
        self._log = SnapshotTable(spark, path, _LOG)

    def figures(self, table: SnapshotTable) -> DataFrame:
        """``file, block`` and the figures of every file of the table's version; only files new to the log are read."""
        if not isinstance(table, SnapshotTable):
            raise TypeError("only files of a table with versions are never altered")
        table = table.pinned() if table.base is None else table
        names = self.spark.createDataFrame([(name,) for name in table.files()], "file string")
        fresh = [row.file for row in names.join(self._known(), "file", "left_anti").toLocalIterator()]
        if fresh:
            self._log.append(self._read(table, fresh))
        return names.join(self._known(), "file")

    def _known(self) -> DataFrame:
        figures = self._log.read().where(f"high_sum IS NOT NULL OR NOT {self.content}")
        return figures.groupBy("file").agg(*(F.max(name).alias(name) for name in _FIGURES))

    def _read(self, table: SnapshotTable, files: list[str]) -> DataFrame:
        mark = row_mark() if self.content else F.lit(None).cast("string")
        rows = table.read_files(files).select("file", "period", "amount", "sale_ts", mark.alias("mark"))
        count, amount, high, low = bag_figures(F.col("mark"))
        if not self.content:
            high, low = (F.lit(None).cast(_SUMS[name]).alias(name) for name in ("high_sum", "low_sum"))
        block = F.coalesce("period", F.lit("")).alias("block")
        found = rows.groupBy("file", block).agg(count, amount, high, low, F.min("sale_ts").alias("least"), F.max("sale_ts").alias("greatest"))
        empty = {"row_count": F.lit(0).cast("bigint"), **({name: F.lit(0).cast(_SUMS[name]) for name in ("high_sum", "low_sum")} if self.content else {})}
        every = self.spark.createDataFrame([(name,) for name in files], "file string").join(found, "file", "left")
        filled = every.withColumns({name: F.coalesce(F.col(name), value) for name, value in empty.items()})
        return filled.withColumn("period", F.lit("")).select(*_LOG.names)

    def headers(self, table: SnapshotTable, digest: str = "md5") -> DataFrame:
        """Headers of the table's version, as ``block_headers`` computes them from all rows."""
        if digest == CONTENT and not self.content:
            raise ValueError("this log does not keep what the digest of whole rows needs")
        sums = [F.sum(name).cast(kind).alias(name) for name, kind in _SUMS.items()]
        totals = self.figures(table).where("row_count > 0").groupBy(F.col("block").alias("period")).agg(*sums)
        return content_headers(totals) if digest == CONTENT else with_block_hash(totals, digest)

    def between(self, table: SnapshotTable, start: datetime, end: datetime) -> DataFrame:
        """Rows from ``start`` until before ``end``, whatever their block; files that hold none by their least and greatest time are not read."""
        table = table.pinned() if table.base is None else table
        start, end = (instant(at.isoformat(sep=" ")) for at in (start, end))
        near = self.figures(table).where((F.col("least") < end) & (F.col("greatest") >= start))
        rows = table.read_files([row.file for row in near.select("file").toLocalIterator()])
        return rows.where((F.col("sale_ts") >= start) & (F.col("sale_ts") < end)).select(*table.schema.names)

    def compact(self, table: SnapshotTable, minutes: float = 24 * 60) -> None:
        """Write the log anew with what the table's readable versions name, and remove its own old files once they are ``minutes`` old.

        Figures that another run logs in between are computed again when they are next asked for.
        """
        live = {name for version in table.versions() for name in table.files(version)}
        names = self.spark.createDataFrame([(name,) for name in sorted(live)], "file string")
        self._log.replace_all(self._known().join(names, "file", "left_semi").withColumn("period", F.lit("")).select(*_LOG.names))
        self._log.vacuum(minutes=minutes)
