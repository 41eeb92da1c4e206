"""The user-level API: a source, a target, and what can be done with the pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.periods import check_request
from ..operators.headers import block_headers, header_equality
from ..operators import reconcile, tree
from ..operators.blocks import collected_spans, fetch_named_blocks
from ..operators.files import files_to_rewrite
from ..operators.perturb import perturb_block
from ..schema import INSERT, REPAIR, SKIP
from ..scratch import materialise, scratch_path
from ..sources.file_log import FileLog
from ..sources.header_log import HeaderLog
from ..sources.snapshot import CommitConflict, SnapshotTable
from ..sources.table import KEEP, REBALANCE, BlockTable
from . import apply, compare, diagnostics, plan, report, status


class TableSync:
    """Keeps a target table in step with a source, block by block.

    The source is a table of blocks or any DataFrame with the sales columns. With a
    ``header_log``, headers of tables are taken from it wherever a block's files are
    unchanged, so a run without changes reads no rows; without one they are
    always computed from the rows. ``derived`` states that the source's period is the
    month of its ``sale_ts``, so that a source which is not partitioned by period can
    group by month and find changed blocks by time.
    """

    def __init__(
        self,
        source: BlockTable | DataFrame,
        target: BlockTable,
        digest: str = "md5",
        header_log: HeaderLog | FileLog | None = None,
        derived: bool = False,
    ):
        self.source = source
        self.target = target
        self.digest = digest
        self.header_log = header_log
        self.derived = derived

    def source_rows(self) -> DataFrame:
        return self.source.read() if isinstance(self.source, BlockTable) else self.source

    def _headers(self, side: BlockTable | DataFrame) -> DataFrame:
        if not isinstance(side, BlockTable):
            return block_headers(side, self.digest, self.derived)
        if self.header_log:
            return self.header_log.headers(side, self.digest)
        return side.headers(self.digest)

    def source_headers(self) -> DataFrame:
        return self._headers(self.source)

    def target_headers(self) -> DataFrame:
        return self._headers(self.target)

    def plan(self) -> DataFrame:
        """Per source block: INSERT, SKIP or REPAIR."""
        return plan.sync_plan(self.source_headers(), self.target_headers())

    def synchronize(self, isolate: bool = False, attempts: int = 10) -> DataFrame:
        """Plan, copy the changed blocks, and return the block results.

        Rows of a source that is itself a table of blocks are written as they are
        laid out there, without a shuffle. A target with versions is planned for and written to as of one version: if
        another sync has changed one of the blocks meanwhile, nothing of this one counts, and it
        plans and copies anew, up to ``attempts`` times in all. Overlapping syncs thus end as if one had run after the other.
        """
        for attempt in range(1, attempts + 1):
            try:
                return self.apply(self.target.pinned(), isolate)
            except CommitConflict:
                if attempt == attempts:
                    raise

    def apply(self, target: BlockTable, isolate: bool = False) -> DataFrame:
        """One attempt of ``synchronize`` on a handle of the target."""
        layout = KEEP if isinstance(self.source, BlockTable) else REBALANCE
        actions = plan.sync_plan(self.source_headers(), self._headers(target))
        return apply.apply_plan(actions, self.source_rows(), target, layout, isolate, self.derived, self.digest)

    def mend(self, buckets: int = tree.BUCKETS, attempts: int = 10) -> DataFrame:
        """Bring the source's months up to date leaf by leaf, and return the leaves that differed.

        Whole rows are compared, whatever ``digest`` says. From the source only the differing leaves are
        fetched; a stored month is still rewritten as a whole, from the target's own rows.
        """
        for attempt in range(1, attempts + 1):
            target = self.target.pinned()
            leaves = tree.differing_leaves(self.source_rows(), target.read(), buckets, self.derived)
            if leaves.isEmpty():
                return leaves
            try:
                rows = tree.mended_blocks(self.source_rows(), target.read(), leaves, buckets, self.derived)
                target.replace(materialise(rows, "mended"))
                return leaves
            except CommitConflict:
                if attempt == attempts:
                    raise

    def patch(self, sizes: Sequence[int] = reconcile.SIZES, attempts: int = 10, by_file: bool = False) -> DataFrame:
        """Bring the target up to date row by row, and return the rows of repaired blocks that differed, with ``copies``.

        Blocks that differ by ``digest`` are reconciled: the sides exchange tables of ``sizes`` cells, and the source is asked for the missing rows only.
        Inserted blocks are copied. A stored block is still rewritten as a whole, from the target's own rows and the missing ones; with ``by_file``,
        which needs a target with versions, only those of its files that hold rows to be taken away are, and missing rows come in new files.
        """
        if by_file and not isinstance(self.target, SnapshotTable):
            raise TypeError("only a target with versions can be repaired by file")
        for attempt in range(1, attempts + 1):
            target = self.target.pinned()
            actions = materialise(plan.sync_plan(self.source_headers(), self._headers(target)), "plan")
            inserted, differing = (actions.where(F.col("action") == action).select("period") for action in (INSERT, REPAIR))
            delta = materialise(reconcile.reconciled_delta(self.source_rows(), target.read(), differing, sizes, self.derived), "delta")
            if actions.where(F.col("action") != SKIP).isEmpty():
                return delta
            new = fetch_named_blocks(self.source_rows(), inserted, self.derived, collected_spans(inserted) if self.derived else None)
            try:
                if by_file:
                    found = files_to_rewrite(target.read_files(), delta)
                    files = [row.file for row in found.toLocalIterator()]
                    old = target.read_files(files).drop("file")
                    target.rewrite(files, reconcile.patched_blocks(old, delta).unionByName(new))
                else:
                    rows = reconcile.patched_blocks(target.read(), delta).unionByName(new)
                    target.replace(materialise(rows, "patched"))
                return delta
            except CommitConflict:
                if attempt == attempts:
                    raise

    def report(self, results: DataFrame) -> DataFrame:
        """Counters over the block results."""
        return report.sync_report(results)

    def status(self) -> DataFrame:
        """Size of both sides and the overall state."""
        return status.system_status(self.source_headers(), self.target_headers())

    def compare(self) -> DataFrame:
        """State of every source block with both sides' figures."""
        return compare.hash_comparison(self.source_headers(), self.target_headers())

    def diagnostics(self, **options) -> DataFrame:
        """Statistics, largest blocks, a sample and a summary."""
        return diagnostics.diagnostics(
            self.source_rows(),
            self.target.read(),
            digest=self.digest,
            derived=self.derived,
            **options,
        )

    def perturb(self, year: int, month: int, current_year: int, **options) -> str:
        """Damage one block of the target; a month without rows is left alone."""
        period = check_request(year, month, current_year)
        block = self.target.fetch(period)
        self.target.replace(perturb_block(block, period, **options))
        return period

    def reset(self, baseline: DataFrame | None = None) -> None:
        """Empty the target, and put the source table back to ``baseline`` if one is given.

        The baseline is first written to a scratch table of its own, so it may read the source, and
        one that fails leaves source and target as they are. The source is then replaced from
        that copy, in one commit if it has versions, and else block by block without ever being emptied, and compared with
        it; the target is emptied last. An error after the copy names where the copy is.
        """
        if baseline is not None:
            if not isinstance(self.source, BlockTable):
                raise TypeError("only a table of blocks can be put back to a baseline")
            staged = BlockTable(self.source.spark, scratch_path(self.source.spark, "baseline"), self.source.schema)
            staged.append(baseline)
            try:
                self.source.replace_all(staged.read())
            except Exception as error:
                raise RuntimeError(f"the source was not put back; its baseline is kept in {staged.path}") from error
            wrong = header_equality(staged.headers(), self.source.headers()).where("NOT same")
            if not wrong.isEmpty():
                raise RuntimeError(f"the source differs from its baseline, which is kept in {staged.path}")
            staged.clear()
        self.target.clear()
