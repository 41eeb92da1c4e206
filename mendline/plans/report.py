"""Reports over block results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.texts import report_line, thousands
from ..schema import INSERT, REPAIR, SKIP


def _done(action: str) -> Column:
    return F.count_if((F.col("action") == action) & ~F.col("failed"))


def sync_report(results: DataFrame) -> DataFrame:
    """One row of counters. Failed blocks are in the total and in no other counter."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)

    return results.agg(
        F.count(F.lit(1)).alias("total_blocks"),
        _done(SKIP).alias("skipped"),
        _done(INSERT).alias("inserted"),
        _done(REPAIR).alias("repaired"),
        total("rows_processed"),
        total("rows_inserted"),
    )


#: Head lines of the report: what a counter is called there.
HEAD = {
    "total_blocks": "blocks compared",
    "skipped": "unchanged",
    "inserted": "new",
    "repaired": "replaced",
    "rows_processed": "rows looked at",
    "rows_inserted": "rows copied",
}


def report_head(results: DataFrame) -> DataFrame:
    """The counters as text with grouped thousands: ``line_no, line``."""
    lines = (
        F.struct(F.lit(i).alias("line_no"), F.concat(F.lit(f"{says}: "), thousands(F.col(name))).alias("line"))
        for i, (name, says) in enumerate(HEAD.items(), 1)
    )
    return sync_report(results).select(F.inline(F.array(*lines)))


def report_lines(results: DataFrame) -> DataFrame:
    """The report as text, one line per block in order."""
    line = report_line(F.col("period"), F.col("action"), F.col("rows_processed"))
    return results.select("period", line.alias("line")).orderBy("period")


def sync_document(results: DataFrame) -> DataFrame:
    """The counters with the block results nested inside, sorted by period.

    One row; its list has one entry per block, not per sale.
    """
    details = F.array_sort(F.collect_list(F.struct(*results.columns))).alias("details")
    counters = sync_report(results)
    return counters.select(*counters.columns, results.select(details).scalar().alias("details"))


def as_json(df: DataFrame, key: str = "period") -> DataFrame:
    """Each row as a JSON document beside its key; missing parts are written as null."""
    document = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(key, document.alias("document"))


def write_json(df: DataFrame, path: str) -> None:
    """Write nested results as JSON lines, from the executors."""
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path)
