"""Carrying out a plan: copy the changed blocks into the target, and check them there."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.texts import block_message
from ..operators.blocks import collected_spans, fetch_blocks, fetch_named_blocks
from ..operators.headers import block_headers
from ..schema import SKIP
from ..scratch import materialise
from ..sources.snapshot import CommitConflict
from ..sources.table import REBALANCE, BlockTable
from .plan import block_results, changed_blocks

#: Blocks that are tried together once the copy of all has failed.
TRIED = 1_000
#: Blocks in a row that fail alike, with none copied, after which as many others decide whether to go on.
HOPELESS = 5
_FAILURES = "period string, error string"


def _text_of(error: Exception) -> str:
    return str(error) or type(error).__name__


class _Outcome:
    """What the copies of single blocks have come to so far; ``copy`` puts the listed blocks in place."""

    def __init__(self, copy: Callable[[list[str]], None], periods: list[str]):
        self.copy, self.periods = copy, periods
        self.copied = False
        self.alike: list[str] = []

    def put(self, periods: list[str]) -> None:
        self.copy(periods)
        self.copied = True

    def failed(self, error: Exception) -> None:
        """Counts the error of one block.

        Once ``HOPELESS`` blocks in a row have failed alike and none was copied, as many others are tried, from all over the list; raises
        if these fail in that way too.
        """
        kind = _kind_of(error)
        self.alike = [*self.alike, kind] if kind in self.alike[-1:] else [kind]
        if self.copied or len(self.alike) < HOPELESS:
            return
        for period in self.periods[:: -max(1, len(self.periods) // HOPELESS)][:HOPELESS]:
            try:
                self.put([period])
                return
            except CommitConflict:
                raise
            except Exception as other:
                if _kind_of(other) != kind:
                    return
        raise RuntimeError(f"block after block fails in one way, and none was copied: {_text_of(error)}") from error


def _kind_of(error: Exception) -> str:
    """An error without its numbers, which name tasks, stages and blocks."""
    return re.sub("[0-9]+", "0", _text_of(error).partition("\n")[0])


@contextmanager
def _without_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins of the plans made meanwhile send no table to the driver: jobs that only find out which blocks are bad would send the same ones over and over."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "-1")
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _copy_isolated(spark: SparkSession, periods: list[str], outcome: _Outcome, cause: Exception | None = None) -> Iterator[tuple[str, str]]:
    """Copy the blocks in one job; if it fails, copy each half on its own. ``cause`` is the error of a job that has tried them already.

    One bad block among n costs about 2 log2(n) jobs and copies every good block about
    twice at most, instead of one job per block. Yields the blocks that fail alone,
    with the error; raises once it is clear that no block is to blame.
    """
    try:
        if cause:
            raise cause
        outcome.put(periods)
    except CommitConflict:
        raise  # the plan is out of date, whatever the block
    except Exception as error:
        if spark.sparkContext._jsc.sc().isStopped():
            raise
        if len(periods) == 1:
            outcome.failed(error)
            yield periods[0], _text_of(error)
            return
        half = len(periods) // 2
        yield from _copy_isolated(spark, periods[:half], outcome)
        yield from _copy_isolated(spark, periods[half:], outcome)


def _reachable(source: DataFrame, target: BlockTable) -> None:
    """Raises if not even a row can be read, or nothing can be written: then no block is to blame."""
    source.select(F.lit(1)).limit(1).collect()
    target.append(target.spark.createDataFrame([], target.schema))


def _checked(
    results: DataFrame, target: BlockTable, failures: list[tuple[str, str]], digest: str
) -> DataFrame:
    """The results as they came out: rows are those found in the target, whose headers are
    taken again for the changed blocks only. A block whose header is not the source's has failed.
    """
    found = block_headers(fetch_named_blocks(target.read(), changed_blocks(results)), digest)
    found = found.select("period", F.col("row_count").alias("_rows"), F.col("block_hash").alias("_hash"))
    errors = results.sparkSession.createDataFrame(failures, _FAILURES)
    changed = F.col("action") != SKIP
    wrong = changed & (F.col("error").isNotNull() | ~F.col("_hash").eqNullSafe(F.col("source_hash")))
    rows = F.when(wrong, F.lit(0)).when(changed, F.col("_rows"))
    why = F.coalesce("error", F.lit("the block in the target does not have the header of the source's"))
    new = {
        "rows_processed": F.coalesce(rows, "rows_processed").cast("bigint"),
        "rows_inserted": F.coalesce(rows, "rows_inserted").cast("bigint"),
        "message": F.when(wrong, F.concat(F.lit("Error: "), why)).otherwise(
            block_message(F.col("action"), F.coalesce(rows, "rows_processed").cast("string"))
        ),
        "failed": wrong,
    }
    joined = results.join(found, "period", "left").join(errors, "period", "left")
    return joined.select(*(new.get(name, F.col(name)).alias(name) for name in results.columns))


def apply_plan(
    plan: DataFrame,
    source: DataFrame,
    target: BlockTable,
    layout: str = REBALANCE,
    isolate: bool = False,
    derived: bool = False,
    digest: str = "md5",
) -> DataFrame:
    """Copy every INSERT and REPAIR block from ``source`` and return the block results.

    The plan reads the target that is about to change, so it is written to a scratch
    table first. The changed blocks, however many, are then read in one scan that a join
    with the plan prunes, and put in place by one partition overwrite. New files are staged
    before any block is touched, but the commit swaps block by block. Afterwards the
    changed blocks are counted in the target and their headers compared with the
    source's; ``digest`` is the plan's.

    With ``isolate`` a block that cannot be copied is reported as failed and the
    others are still copied, unless block after block fails alike and none can be copied. ``derived`` is as for ``fetch_blocks``.
    """
    results = materialise(block_results(plan), "plan")
    changed = changed_blocks(results)
    if changed.isEmpty():
        return results
    failures: list[tuple[str, str]] = []
    try:
        spans = collected_spans(changed) if derived else None
        target.replace(fetch_named_blocks(source, changed, derived, spans), layout)
    except CommitConflict:
        raise
    except Exception as error:
        spark = source.sparkSession
        if not isolate or spark.sparkContext._jsc.sc().isStopped():
            raise
        with _without_broadcasts(spark):
            _reachable(source, target)
            periods = (row.period for row in changed.toLocalIterator())
            copy = lambda some: target.replace(fetch_blocks(source, some, derived), layout)
            some, more = list(islice(periods, TRIED)), list(islice(periods, TRIED))
            cause = None if more else error  # all blocks together have failed already
            while some:
                failures.extend(_copy_isolated(spark, some, _Outcome(copy, some), cause))
                some, more = more, list(islice(periods, TRIED))
    return materialise(_checked(results, target, failures, digest), "results")
