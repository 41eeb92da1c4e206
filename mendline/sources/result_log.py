"""An append-only record of what the runs of a sync did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import SKIP


class ResultLog:
    """Block results of all runs, one directory per run.

    Runs are only ever added; recording one twice is refused, so that a repeated job
    cannot count it double.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def record(self, run: int, results: DataFrame) -> None:
        """Add the results of a run under its number."""
        results.hint("rebalance").write.mode("errorifexists").parquet(f"{self.path}/run={int(run)}")

    def read(self) -> DataFrame:
        """``run`` and the block results of every run recorded so far."""
        rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/run=*")
        return rows.select(F.col("run").cast("bigint").alias("run"), *(c for c in rows.columns if c != "run"))

    def last_copies(self) -> DataFrame:
        """Per block the last run that copied it without failure: ``period, run, rows_inserted``."""
        copied = self.read().where((F.col("action") != SKIP) & ~F.col("failed"))
        last = F.max_by(F.struct("run", "rows_inserted"), "run").alias("last")
        return copied.groupBy("period").agg(last).select("period", "last.*")
