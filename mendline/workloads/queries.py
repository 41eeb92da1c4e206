"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import periods, texts
from ..operators import blocks, content, delta, headers, reconcile, sample, stats, tree
from ..plans import apply, compare, plan, report, status
from ..plans import diagnostics as diagnosis
from ..plans.sync import TableSync
from ..schema import REPAIR
from ..scratch import materialise, scratch_path
from ..sources.file_log import FileLog
from ..sources.result_log import ResultLog
from ..sources.snapshot import CommitConflict, SnapshotTable
from ..sources.table import BlockTable
from ..streaming.header_stream import HeaderStream
from . import retail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HEADER_COLUMNS = ("period", "amount")
MONTHLY_COLUMNS = ("sale_ts", "amount")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _source_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = retail.source_sales(spark, sf_dir, *MONTHLY_COLUMNS)
    return headers.block_headers(sales, derived=True)


def _target_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.block_headers(retail.target_sales(spark, sf_dir, *HEADER_COLUMNS))


def _headers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _source_headers(spark, sf_dir), _target_headers(spark, sf_dir)


def written_target(spark: SparkSession, sf_dir: str) -> BlockTable:
    """The target as a stored table, for queries that change it."""
    table = BlockTable(spark, scratch_path(spark, "target"))
    table.append(retail.target_sales(spark, sf_dir))
    return table


def _sync(spark: SparkSession, sf_dir: str) -> TableSync:
    return TableSync(retail.source_sales(spark, sf_dir), written_target(spark, sf_dir), derived=True)


# Scans, fetches and changes of blocks.


@query
def scan_source(spark, sf_dir):
    return retail.source_sales(spark, sf_dir)


@query
def scan_target(spark, sf_dir):
    return retail.target_sales(spark, sf_dir)


@query
def fetch_source_block(spark, sf_dir):
    return blocks.fetch_block(retail.source_sales(spark, sf_dir), "1997-03", derived=True)


@query
def fetch_target_block(spark, sf_dir):
    return blocks.fetch_block(retail.target_sales(spark, sf_dir), "1994-12")


@query
def fetch_changed_blocks(spark, sf_dir):
    changed = materialise(plan.changed_blocks(plan.sync_plan(*_headers(spark, sf_dir))), "changed")
    return blocks.fetch_named_blocks(retail.source_sales(spark, sf_dir), changed, derived=True)


@query
def insert_block(spark, sf_dir):
    source, target = retail.source_sales(spark, sf_dir), retail.target_sales(spark, sf_dir)
    return blocks.insert_block(target, blocks.fetch_block(source, "1997-04", derived=True))


@query
def delete_block(spark, sf_dir):
    return blocks.delete_block(retail.target_sales(spark, sf_dir), "1997-05")


@query
def replace_block(spark, sf_dir):
    source, target = retail.source_sales(spark, sf_dir), retail.target_sales(spark, sf_dir)
    rows = blocks.fetch_block(source, "1997-07", derived=True)
    return blocks.replace_block(target, "1997-07", rows)


@query
def clear_target(spark, sf_dir):
    target = written_target(spark, sf_dir)
    before = materialise(target.read().agg(F.count(F.lit(1)).alias("n")), "before")
    target.clear()
    after = target.read().agg(F.count(F.lit(1)).alias("rows_after"))
    return after.select(before.scalar().alias("rows_before"), "rows_after")


# Periods.


@query
def period_of_sale(spark, sf_dir):
    return retail.source_sales(spark, sf_dir, "sale_id", "line_no", "sale_ts", "period")


@query
def period_requests(spark, sf_dir):
    year, month = F.col("year"), F.col("month")
    return retail.period_requests(spark, sf_dir).select(
        "request_id",
        "year",
        "month",
        periods.period_from_parts(year, month).alias("period"),
        periods.request_problem(year, month, retail.CURRENT_YEAR).alias("problem"),
    )


# Headers and plans.


@query
def headers_source(spark, sf_dir):
    return _source_headers(spark, sf_dir)


@query
def headers_target(spark, sf_dir):
    return _target_headers(spark, sf_dir)


@query
def headers_sha256(spark, sf_dir):
    sales = retail.source_sales(spark, sf_dir, *MONTHLY_COLUMNS)
    return headers.block_headers(sales, "sha256", derived=True)


@query
def headers_streamed(spark, sf_dir):
    """Headers of the source, stored and then read as a stream of several batches, with a restart between."""
    source = BlockTable(spark, scratch_path(spark, "source"))
    source.append(retail.source_sales(spark, sf_dir).where("line_no <= 3"))
    path, stream = scratch_path(spark, "stream"), spark.readStream.schema(source.schema)
    rows = stream.option("maxFilesPerTrigger", 40).parquet(source.path)
    HeaderStream(spark, path).catch_up(rows)
    source.append(retail.source_sales(spark, sf_dir).where("line_no > 3"))
    HeaderStream(spark, path).catch_up(rows)
    return HeaderStream(spark, path).headers()


@query
def headers_content(spark, sf_dir):
    return headers.block_headers(retail.source_sales(spark, sf_dir), "content", derived=True)


@query
def content_plan(spark, sf_dir):
    """The plan by the digest of whole rows: months with other customers are repaired too."""
    sides = retail.source_sales(spark, sf_dir), retail.target_sales(spark, sf_dir)
    return plan.sync_plan(headers.block_headers(sides[0], "content", derived=True), headers.block_headers(sides[1], "content"))


@query
def headers_added(spark, sf_dir):
    """Headers of the source out of those of the target, by adding the rows that came and subtracting those that went."""
    source, target = retail.source_sales(spark, sf_dir), retail.target_sales(spark, sf_dir)
    changes = materialise(delta.block_delta(source, target), "changes")
    copies = lambda way: changes.where(F.col("copies") * way > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("copies")))
    )
    totals = content.add(content.content_totals(target), content.content_totals(copies(1)))
    return content.content_headers(content.subtract(totals, content.content_totals(copies(-1))))


@query
def tree_leaves(spark, sf_dir):
    """Leaves of the digest tree that differ."""
    return tree.differing_leaves(retail.source_sales(spark, sf_dir), retail.target_sales(spark, sf_dir), derived=True)


@query
def tree_mend(spark, sf_dir):
    """A stored target after a repair that fetched only the differing leaves."""
    sync = _sync(spark, sf_dir)
    sync.mend()
    return sync.target.read()


@query
def header_equality(spark, sf_dir):
    return headers.header_equality(*_headers(spark, sf_dir))


@query
def sync_plan(spark, sf_dir):
    return plan.sync_plan(*_headers(spark, sf_dir))


@query
def first_load_plan(spark, sf_dir):
    empty = BlockTable(spark, scratch_path(spark, "empty"))
    return plan.sync_plan(_source_headers(spark, sf_dir), empty.headers())


@query
def block_results(spark, sf_dir):
    return plan.block_results(plan.sync_plan(*_headers(spark, sf_dir)))


@query
def sync_report(spark, sf_dir):
    return report.sync_report(plan.block_results(plan.sync_plan(*_headers(spark, sf_dir))))


@query
def report_head(spark, sf_dir):
    return report.report_head(plan.block_results(plan.sync_plan(*_headers(spark, sf_dir))))


@query
def report_lines(spark, sf_dir):
    return report.report_lines(plan.block_results(plan.sync_plan(*_headers(spark, sf_dir))))


@query
def sync_document(spark, sf_dir):
    results = plan.block_results(plan.sync_plan(*_headers(spark, sf_dir)))
    return report.as_json(report.sync_document(results), "total_blocks")


# Writes: the target is stored, changed, and read back.


@query
def sync_apply(spark, sf_dir):
    sync = _sync(spark, sf_dir)
    sync.synchronize()
    return sync.target.read()


@query
def sync_results(spark, sf_dir):
    return _sync(spark, sf_dir).synchronize()


@query
def sync_history(spark, sf_dir):
    """The recorded results of a sync and of the one after it."""
    sync, log = _sync(spark, sf_dir), ResultLog(spark, scratch_path(spark, "history"))
    for run in (1, 2):
        log.record(run, sync.synchronize())
    return log.read()


@query
def repair_delta(spark, sf_dir):
    """The rows that make the differing blocks differ."""
    actions = plan.sync_plan(*_headers(spark, sf_dir))
    differing = materialise(actions.where(F.col("action") == REPAIR).select("period"), "differing")
    source, target = retail.source_sales(spark, sf_dir), retail.target_sales(spark, sf_dir)
    return delta.block_delta(
        blocks.fetch_named_blocks(source, differing, derived=True), blocks.fetch_named_blocks(target, differing)
    )


@query
def reconciled_delta(spark, sf_dir):
    """The same rows, told from tables of cells that the sides exchange."""
    actions = plan.sync_plan(*_headers(spark, sf_dir))
    differing = materialise(actions.where(F.col("action") == REPAIR).select("period"), "differing")
    source, target = retail.source_sales(spark, sf_dir), retail.target_sales(spark, sf_dir)
    return reconcile.reconciled_delta(source, target, differing, derived=True)


@query
def sync_patch(spark, sf_dir):
    """A stored target after a repair that fetched only the rows that differ."""
    sync = _sync(spark, sf_dir)
    sync.patch()
    return sync.target.read()


def target_by_files(spark: SparkSession, sf_dir: str) -> Iterator[SnapshotTable]:
    """The target with versions and several files a block: once with a part of its rows, and once with all."""
    target, rows = SnapshotTable(spark, scratch_path(spark, "files")), retail.target_sales(spark, sf_dir)
    low = F.coalesce(F.col("line_no") <= 2, F.lit(True))
    for part in (low, ~low):
        target.append(rows.where(part))
        yield target


@query
def headers_of_files(spark, sf_dir):
    """Headers of a target that grew, from figures per file; the second time only the new files are read."""
    log = FileLog(spark, scratch_path(spark, "file-log"))
    for target in target_by_files(spark, sf_dir):
        found = log.headers(target)
    return found


@query
def files_between(spark, sf_dir):
    """Rows of five weeks that begin and end within a month, from the files that may hold any."""
    *_, target = target_by_files(spark, sf_dir)
    log = FileLog(spark, scratch_path(spark, "file-log"))
    return log.between(target, datetime(1995, 1, 20), datetime(1995, 2, 24))


@query
def file_patch(spark, sf_dir):
    """A target with versions, of several files a block, after a repair that wrote only the files with rows to be taken away anew."""
    *_, target = target_by_files(spark, sf_dir)
    TableSync(retail.source_sales(spark, sf_dir), target, derived=True).patch(by_file=True)
    return target.read()


@query
def sync_merge(spark, sf_dir):
    changed = materialise(plan.changed_blocks(plan.sync_plan(*_headers(spark, sf_dir))), "changed")
    return blocks.merge_blocks(
        retail.source_sales(spark, sf_dir), retail.target_sales(spark, sf_dir), changed, derived=True
    )


@query
def resync_plan(spark, sf_dir):
    sync = _sync(spark, sf_dir)
    sync.synchronize()
    return sync.plan()


@query
def reset_then_plan(spark, sf_dir):
    """A stored source loses rows and gets wrong ones, and is put back; the next plan inserts all."""
    baseline = retail.source_sales(spark, sf_dir)
    source = BlockTable(spark, scratch_path(spark, "source"))
    source.append(baseline.where("line_no = 1").withColumn("amount", F.col("amount") * 0 + 1))
    sync = TableSync(source, written_target(spark, sf_dir))
    sync.reset(baseline)
    return sync.plan()


def versioned_target(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    """The target as a stored table with versions."""
    table = SnapshotTable(spark, scratch_path(spark, "versions"))
    table.append(retail.target_sales(spark, sf_dir))
    return table


@query
def snapshot_sync(spark, sf_dir):
    """Figures of each version of a target with versions: as stored, after a sync, cleared, and restored to the synchronised one."""
    target = versioned_target(spark, sf_dir)
    TableSync(retail.source_sales(spark, sf_dir), target, derived=True).synchronize()
    target.clear()
    target.restore(2)
    figures = None
    for made in target.history().collect():  # four versions
        totals = headers.block_headers(target.read(made.version)).agg(
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.count("*").alias("blocks"),
            F.coalesce(F.sum("amount_sum"), F.lit(0)).cast("decimal(28,2)").alias("amount_sum"),
        )
        one = totals.select(F.lit(made.version).cast("bigint").alias("version"), F.lit(made.kind).alias("kind"), "*")
        figures = one if figures is None else figures.unionByName(one)
    return figures


@query
def overlapping_syncs(spark, sf_dir):
    """The target after two syncs that both planned before either had copied; the later one plans anew."""
    target = versioned_target(spark, sf_dir)
    late, early = (TableSync(retail.source_sales(spark, sf_dir), target, derived=True) for _ in range(2))
    planned = target.pinned()
    early.synchronize()
    try:
        late.apply(planned)
    except CommitConflict:
        late.synchronize()
        return target.read()
    raise AssertionError("two syncs have copied the same blocks")


@query
def snapshot_reset(spark, sf_dir):
    """A source with versions loses rows and gets wrong ones, and is put back in one commit; the next plan inserts all."""
    baseline = retail.source_sales(spark, sf_dir)
    source = SnapshotTable(spark, scratch_path(spark, "versions"))
    source.append(baseline.where("line_no = 1").withColumn("amount", F.col("amount") * 0 + 1))
    sync = TableSync(source, versioned_target(spark, sf_dir))
    sync.reset(baseline)
    return sync.plan()


@query
def failed_blocks(spark, sf_dir):
    target = written_target(spark, sf_dir)
    actions = plan.sync_plan(_source_headers(spark, sf_dir), target.headers())
    broken = F.col("period").isin("1998-07")
    source = retail.source_sales(spark, sf_dir)
    failing = source.withColumn(
        "amount",
        F.when(broken, F.raise_error(F.lit("block cannot be read")).cast("decimal(18,2)")).otherwise(
            F.col("amount")
        ),
    )
    results = apply.apply_plan(actions, failing, target, isolate=True, derived=True)
    return results.select("period", "action", "failed", "rows_processed", "rows_inserted")


# Status, comparison, statistics.


@query
def system_info(spark, sf_dir):
    source, target = (stats.table_info(h) for h in _headers(spark, sf_dir))
    both = source.select(F.lit("source").alias("side"), "*").unionByName(
        target.select(F.lit("target").alias("side"), "*")
    )
    return both.withColumn("periods", F.array_join("periods", ","))


@query
def system_status(spark, sf_dir):
    sides = status.system_status(*_headers(spark, sf_dir))
    return sides.select(
        F.col("source.rows").alias("source_rows"),
        F.col("source.blocks").alias("source_blocks"),
        F.array_join("source.periods", ",").alias("source_periods"),
        F.col("target.rows").alias("target_rows"),
        F.col("target.blocks").alias("target_blocks"),
        F.array_join("target.periods", ",").alias("target_periods"),
        "state",
    )


@query
def hash_comparison(spark, sf_dir):
    blocks_compared = compare.hash_comparison(*_headers(spark, sf_dir))
    return blocks_compared.select(
        "period",
        "state",
        *(
            F.col(f"{side}.{name}").alias(f"{side}_{name}")
            for side in ("source", "target")
            for name in ("hash", "rows", "amount")
        ),
    )


@query
def comparison_summary(spark, sf_dir):
    return compare.comparison_summary(compare.hash_comparison(*_headers(spark, sf_dir)))


@query
def comparison_json(spark, sf_dir):
    return report.as_json(compare.hash_comparison(*_headers(spark, sf_dir)))


@query
def stats_source(spark, sf_dir):
    sales = partial(retail.source_sales, spark, sf_dir)
    return stats.statistics(sales, profile=stats.block_profile(sales, derived=True))


@query
def stats_target(spark, sf_dir):
    return stats.statistics(partial(retail.target_sales, spark, sf_dir))


@query
def stats_first_last(spark, sf_dir):
    return stats.first_last(partial(retail.source_sales, spark, sf_dir))


def _both_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.side_statistics(
        partial(retail.source_sales, spark, sf_dir),
        partial(retail.target_sales, spark, sf_dir),
        derived=True,
    )


@query
def stats_empty(spark, sf_dir):
    def none(*columns):
        wanted = dict.fromkeys((*columns, "sale_ts", "period"))
        sales = retail.source_sales(spark, sf_dir, *wanted)
        return blocks.fetch_block(sales, "1890-01", derived=True).select(*columns)

    return stats.statistics(none)


@query
def stats_summary(spark, sf_dir):
    return diagnosis.summary(_both_statistics(spark, sf_dir))


@query
def thousands_per_block(spark, sf_dir):
    return _source_headers(spark, sf_dir).select(
        "period", texts.thousands(F.col("row_count")).alias("row_count_text")
    )


@query
def top_periods(spark, sf_dir):
    return stats.top_blocks(_source_headers(spark, sf_dir))


@query
def top_periods_of_both(spark, sf_dir):
    return diagnosis.side_top_blocks(*_headers(spark, sf_dir))


@query
def diagnostics(spark, sf_dir):
    return _both_statistics(spark, sf_dir)


@query
def diagnostics_document(spark, sf_dir):
    """The whole document, with its lists as texts."""
    listed = lambda name, *fields: F.array_join(
        F.transform(name, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ","
    )
    whole = _sync(spark, sf_dir).diagnostics().withColumn("sample", F.array_sort("sample"))
    sides = (
        F.col(f"{side}.{name}").alias(f"{side}_{name}")
        for side in ("source", "target")
        for name in whole.schema[side].dataType.names
    )
    return whole.select(
        *sides,
        *(listed(f"{side}_top", "period", "row_count", "amount_sum", "block_hash").alias(f"{side}_top") for side in ("source", "target")),
        listed("sample", "sale_id", "customer", "product", "amount", "period").alias("sample"),
        "summary",
    )


@query
def sample_records(spark, sf_dir):
    keys = retail.order_sales(spark, sf_dir, "sale_id", "period")
    return sample.sample_records(retail.order_sales(spark, sf_dir), keys=keys)


@query
def sample_repeated_keys(spark, sf_dir):
    keys = retail.source_sales(spark, sf_dir, "sale_id", "period")
    return sample.sample_rows(retail.source_sales(spark, sf_dir), 12, keys=keys)


# Perturbation.


@query
def perturb_block(spark, sf_dir):
    return retail.perturbed_sales(spark, sf_dir)


def _perturbed_headers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = retail.order_sales(spark, sf_dir, *MONTHLY_COLUMNS)
    target = retail.perturbed_sales(spark, sf_dir, *MONTHLY_COLUMNS)
    return tuple(headers.block_headers(side, derived=True) for side in (source, target))


@query
def perturb_plan(spark, sf_dir):
    return plan.sync_plan(*_perturbed_headers(spark, sf_dir))


@query
def perturb_status(spark, sf_dir):
    return status.system_status(*_perturbed_headers(spark, sf_dir)).select(
        F.col("source.blocks").alias("source_blocks"),
        F.col("target.blocks").alias("target_blocks"),
        "state",
    )


@query
def perturb_repair(spark, sf_dir):
    """Actions before and after the repair of a stored table with one damaged block."""
    source = retail.order_sales(spark, sf_dir)
    target = BlockTable(spark, scratch_path(spark, "damaged"))
    target.append(retail.perturbed_sales(spark, sf_dir))
    sync = TableSync(source, target, derived=True)
    results = sync.synchronize().select("period", F.col("action").alias("action_before"), "rows_inserted", "failed")
    return results.join(sync.plan().select("period", F.col("action").alias("action_after")), "period")
