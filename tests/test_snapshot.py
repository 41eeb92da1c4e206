"""Tables with versions: whole commits, conflicts told by block, replay of the loser, reset that survives a failing write."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import files_of, rows_of
from mendline import BlockTable, CommitConflict, HeaderLog, SnapshotTable, TableSync
from mendline.plans.apply import apply_plan
from mendline.sources import snapshot
from mendline.sources.table import KEEP


@pytest.fixture
def versions(spark, tmp_path):
    count = iter(range(100))

    def make(rows=None):
        made = SnapshotTable(spark, str(tmp_path / f"versions-{next(count)}"))
        if rows is not None:
            made.append(rows)
        return made

    return make


def broken(rows, period):
    """Rows of one block raise while they are written."""
    bad = F.raise_error(F.lit("disk full")).cast("decimal(18,2)")
    return rows.withColumn("amount", F.when(F.col("period") == period, bad).otherwise(F.col("amount")))


def test_every_version_stays_as_it_was(versions, sales):
    table = versions()
    assert table.version() == 0 and table.read().count() == 0 and not table.exists()
    first, second = sales((1, "2023-01", 1), (2, "2023-02", 2)), sales((3, "2023-02", 3))
    table.append(first)
    early = table.read()
    table.replace(second)
    table.append(sales((4, "2023-02", 4), (5, None, 5), (6, "a/b:c%", 6)))
    assert rows_of(early) == rows_of(table.read(1)) == rows_of(first)
    assert sorted((r.sale_id, r.period) for r in table.read().collect()) == [(1, "2023-01"), (3, "2023-02"), (4, "2023-02"), (5, None), (6, "a/b:c%")]
    assert [r.row_count for r in table.fetch("2023-02").groupBy().agg(F.count("*").alias("row_count")).collect()] == [2]
    table.delete(["a/b:c%", "none", ""])
    assert sorted(r.sale_id for r in table.read().collect()) == [1, 3, 4]
    table.clear()
    assert table.read().count() == 0 and table.exists()
    table.restore(2)
    assert rows_of(table.read()) == rows_of(table.read(2))
    assert [tuple(r)[:3] for r in table.history().collect()] == [
        (1, "append", 2), (2, "replace", 1), (3, "append", 3), (4, "delete", 3), (5, "clear", 0), (6, "restore", 2),
    ]


def test_a_killed_write_leaves_the_old_version(monkeypatch, versions, sales):
    """Dead in its write stage, before publishing, and while publishing."""
    table = versions(sales((1, "2023-01", 1), (2, "2023-02", 2)))
    before, files = rows_of(table.read()), files_of(table)
    new = sales((3, "2023-01", 3), (4, "2023-02", 4))
    for write in (table.replace, table.append, table.replace_all):
        with pytest.raises(Exception, match="disk full"):
            write(broken(new, "2023-02"))
    for step in ("_commit", "_publish"):
        with monkeypatch.context() as patch:
            patch.setattr(SnapshotTable, step, lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                table.replace(new)
    assert table.version() == 1 and rows_of(table.read()) == before
    assert set(files) <= set(files_of(table))
    assert table.vacuum(minutes=0) == 4  # the folders of the two whole generations that nothing names
    assert rows_of(table.read()) == before and files_of(table) == files


def test_publishing_is_exclusive(versions, sales):
    table = versions(sales((1, "2023-01", 1)))
    manifest = table._manifest(1)
    assert not table._publish(1, manifest | {"kind": "other"})
    assert table._manifest(1) == manifest
    assert not [p for p in Path(table.path, "manifests").iterdir() if "draft" in p.name and not p.name.endswith(".crc")]


def test_conflicts_are_told_by_block(versions, sales):
    table = versions(sales((1, "2023-01", 1), (2, "2023-02", 2), (3, "2023-03", 3)))
    one, two, three = table.pinned(), table.pinned(), table.pinned()
    one.replace(sales((10, "2023-01", 10)))
    two.replace(sales((20, "2023-02", 20)))  # another block: carried over
    with pytest.raises(CommitConflict, match="version 2"):
        three.replace(sales((30, "2023-01", 30), (31, "2023-03", 31)))
    three.append(sales((40, "2023-01", 40)))
    assert sorted(r.sale_id for r in table.read().collect()) == [3, 10, 20, 40]
    assert rows_of(three.read()) == rows_of(table.read())  # a handle goes on to its own commit
    assert sorted(r.sale_id for r in one.read().collect()) == [2, 3, 10]
    late = table.pinned()
    table.clear()
    with pytest.raises(CommitConflict):
        late.delete(["2023-03"])
    gone = table.pinned()
    table.append(sales((50, "2023-05", 50)))
    table.append(sales((51, "2023-06", 51)))
    table.vacuum(minutes=0)
    with pytest.raises(CommitConflict):  # what happened since cannot be told any more
        gone.replace(sales((60, "2023-07", 60)))


def test_many_writers_lose_nothing(versions, sales):
    """Each append is beaten to its version once."""
    table = versions(sales((0, "2023-01", 1)))
    publish, races = SnapshotTable._publish, []

    def raced(self, version, manifest):
        if not races:
            races.append(version)
            SnapshotTable(self.spark, self.path).append(sales((99, "2023-01", 9)))
        return publish(self, version, manifest)

    for i in range(1, 4):
        races.clear()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(SnapshotTable, "_publish", raced)
            table.append(sales((i, f"2023-0{i}", i)))
    assert sorted(r.sale_id for r in table.read().collect()) == [0, 1, 2, 3, 99, 99, 99]
    assert table.version() == 7


@pytest.mark.parametrize("order", [0, 1])
def test_overlapping_syncs_end_as_one_after_the_other(versions, sales, order):
    source = sales(*((i, f"2023-0{1 + i % 5}", i) for i in range(40)))
    newer = source.where("period <> '2023-04'").unionByName(sales((77, "2023-02", 77), (78, "2023-09", 78)))
    old = sales((0, "2023-01", 5), (1, "2023-02", 1))
    pair = [source, newer] if order else [newer, source]
    expected = versions(old)
    for one in pair:
        TableSync(one, expected).synchronize()
    target = versions(old)
    first, second = (TableSync(one, target) for one in pair)
    planned = target.pinned()  # the second has read the target before the first writes
    first.synchronize()
    with pytest.raises(CommitConflict):
        second.apply(planned)
    with pytest.raises(CommitConflict):  # not a failure of blocks
        second.apply(SnapshotTable(target.spark, target.path, base=1), isolate=True)
    second.synchronize()
    assert rows_of(target.read()) == rows_of(expected.read())
    assert {r.action for r in second.plan().collect()} == {"SKIP"}


def test_the_loser_is_replayed(monkeypatch, versions, sales):
    source = sales((1, "2023-01", 1), (2, "2023-02", 2))
    target = versions()
    commit, others = SnapshotTable._commit, []

    def beaten(self, kind, *args, **options):
        if len(others) < 2 and self.base is not None:
            others.append(SnapshotTable(self.spark, self.path))
            others[-1].replace(source)
        return commit(self, kind, *args, **options)

    monkeypatch.setattr(SnapshotTable, "_commit", beaten)
    results = TableSync(source, target).synchronize()
    assert {r.action for r in results.collect()} == {"SKIP"}  # the other had copied the same
    assert rows_of(target.read()) == rows_of(source) and target.version() == 1
    others.clear()
    target.clear()
    with pytest.raises(CommitConflict):
        TableSync(source, target).synchronize(attempts=1)


def test_isolated_failures_on_versions(versions, sales):
    source = sales(*((i, f"2023-0{1 + i}", i + 1) for i in range(5)))
    target = versions(sales((9, "2023-01", 9)))
    actions = TableSync(source, target).plan()
    results = {r.period: r.failed for r in apply_plan(actions, broken(source, "2023-03"), target.pinned(), isolate=True).collect()}
    assert results == {f"2023-0{1 + i}": i == 2 for i in range(5)}
    assert sorted(r.period for r in target.read().collect()) == ["2023-01", "2023-02", "2023-04", "2023-05"]


@pytest.mark.parametrize("kind", ["plain", "versions"])
def test_reset_cannot_empty_a_source(monkeypatch, versions, table, sales, kind):
    """The write stage of the replacement fails, in the layout without a shuffle too."""
    rows = sales(*((i, f"2023-0{1 + i % 4}", i + 1) for i in range(100)), (200, None, 1))
    source = versions(rows) if kind == "versions" else table(rows)
    target = table(rows)
    writer = BlockTable._writer
    for layout in ("rebalance", KEEP):
        def failing(self, df, _, layout=layout):
            return writer(self, broken(df, "2023-02") if self.path == source.path else df, layout)

        with monkeypatch.context() as patch:
            patch.setattr(BlockTable, "_writer", failing)
            with pytest.raises(RuntimeError, match="baseline is kept in"):
                TableSync(source, target).reset(rows.where("sale_id < 50"))
        assert rows_of(source.read()) == rows_of(rows) == rows_of(target.read())
    TableSync(source, target).reset(rows.where("period <> '2023-03'"))
    assert rows_of(source.read()) == rows_of(rows.where("period <> '2023-03'"))
    assert target.read().count() == 0
    TableSync(source, target).reset(source.read().where("period = '2023-01'"))
    assert source.read().count() == 25
    TableSync(source, target).reset(rows.limit(0))
    assert source.read().count() == 0


def test_header_log_refuses_versions(spark, versions, sales, tmp_path):
    with pytest.raises(TypeError):
        HeaderLog(spark, str(tmp_path / "log")).headers(versions(sales((1, "2023-01", 1))))
    assert snapshot._block("generation=x/period=2023-01") == "period=2023-01"
