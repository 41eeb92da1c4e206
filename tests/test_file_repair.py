"""Repair of single files of a table with versions."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import plan_text, rows_of
from mendline import CommitConflict, SnapshotTable, TableSync
from mendline.operators.delta import block_delta
from mendline.operators.files import files_to_rewrite


@pytest.fixture
def versions(spark, tmp_path):
    """A table with one file per block and list of rows."""
    count = iter(range(100))

    def make(*parts):
        made = SnapshotTable(spark, str(tmp_path / f"versions-{next(count)}"))
        for part in parts:
            made.append(part)
        return made

    return make


def times(table, files):
    return {name: (Path(table.path) / "data" / name).stat().st_mtime_ns for name in files}


def holders(table, delta):
    return sorted(r.file for r in files_to_rewrite(table.read_files(), delta).collect())


def test_only_files_with_rows_to_go_are_written(versions, sales):
    """One of three files of a block has a wrong row; another block lacks a row; a third is as it should be."""
    parts = [sales(*((10 * p + i, f"2023-0{1 + i % 3}", i) for i in range(9))) for p in range(3)]
    source = parts[0].unionByName(parts[1]).unionByName(parts[2])
    wrong = parts[1].withColumn("amount", F.when(F.col("sale_id") == 13, 99).otherwise(F.col("amount")).cast("decimal(18,2)"))
    target = versions(parts[0], wrong, parts[2].where("sale_id <> 24"))
    before, old = target.files(), rows_of(target.read())
    stamps = times(target, before)
    delta = TableSync(source, target).patch(by_file=True)
    assert sorted((r.sale_id, r.copies) for r in delta.collect()) == [(13, -1), (13, 1), (24, 1)]
    after = target.files()
    gone = set(before) - set(after)
    assert len(before) == 9 and len(gone) == 1 and "period=2023-01" in gone.pop()
    assert {n: t for n, t in times(target, after).items() if n in stamps} == {n: t for n, t in stamps.items() if n in after}
    assert rows_of(target.read()) == rows_of(source) and rows_of(target.read(3)) == old
    assert TableSync(source, target).patch(by_file=True).isEmpty() and target.version() == 4
    assert [r.kind for r in target.history().collect()][-1] == "rewrite"


def test_missing_rows_come_in_new_files(versions, sales):
    some, more = sales((1, "2023-01", 1), (1, "2023-01", 1), (2, None, 2)), sales((1, "2023-01", 1), (3, "", 3), (4, "2023-09", 4))
    target = versions(some)
    before = target.files()
    TableSync(some.unionByName(more), target).patch(by_file=True)
    assert set(before) < set(target.files())
    assert rows_of(target.read().fillna("", "period")) == rows_of(some.unionByName(more).fillna("", "period"))


def test_copies_are_sought_in_the_fewest_files(versions, sales):
    row = (7, "a/b:c% +", 7)
    target = versions(sales(row), sales(row, row, row, (8, "a/b:c% +", 8)), sales(row, row), sales((9, None, 9)))
    by_size = {sum(1 for r in target.read_files([f]).collect()): f for f in target.files() if "period=a" in f}
    assert sorted(by_size) == [1, 2, 4]
    for copies, sizes in ((1, [4]), (3, [4]), (4, [2, 4]), (5, [2, 4]), (6, [1, 2, 4]), (9, [1, 2, 4])):
        delta = sales(row).withColumn("copies", F.lit(-copies).cast("bigint"))
        assert holders(target, delta) == sorted(by_size[n] for n in sizes)
    for copies in (1, 4):
        wanted = sales(*[row] * (6 - copies), (8, "a/b:c% +", 8), (9, "", 9))
        again = versions(*(target.read_files([f]).drop("file") for f in target.files()))
        sync = TableSync(wanted, again)
        assert [r.copies for r in sync.patch(by_file=True).collect()] == [-copies]
        assert rows_of(again.read().fillna("", "period")) == rows_of(wanted)
    absent = sales((5, "2023-01", 5)).withColumn("copies", F.lit(-1).cast("bigint"))
    assert holders(target, absent) == holders(target, absent.limit(0)) == holders(versions(), absent) == []


def test_equals_the_repair_of_whole_blocks(spark, versions, sales, table):
    rows = sales(*((i, f"2023-0{1 + i % 4}", i % 13, f"c{i % 5}") for i in range(400)))
    source = rows.unionByName(rows.where("sale_id < 9")).withColumn("customer", F.when(F.col("sale_id") == 9, None).otherwise(F.col("customer")))
    stale = rows.where("sale_id % 40 <> 7").unionByName(rows.where("sale_id IN (3, 4)")).unionByName(rows.where("sale_id IN (3, 4)"))
    stale = stale.where("period <> '2023-04'")
    target, whole = versions(*(stale.where(f"sale_id % 5 = {i}") for i in range(5))), table(stale)
    assert rows_of(TableSync(source, target, digest="content").patch(by_file=True)) == rows_of(TableSync(source, whole, digest="content").patch())
    assert rows_of(target.read()) == rows_of(whole.read()) == rows_of(source)
    assert block_delta(source, target.read()).isEmpty()
    with pytest.raises(TypeError, match="versions"):
        TableSync(source, whole).patch(by_file=True)


def test_only_named_files_are_read(versions, sales):
    target = versions(sales((1, "2023-01", 1)), sales((2, "2023-01", 2)))
    (first, second) = target.files()
    one = target.read_files([first])
    assert one.count() == 1 and {r.file for r in one.collect()} == {first} and len(one.inputFiles()) == 1
    assert target.read_files([]).columns == one.columns and target.read_files([]).isEmpty()
    assert "_metadata" not in plan_text(target.read())
    with pytest.raises(ValueError, match="no file"):
        target.read_files([first + "x"])
    with pytest.raises(ValueError, match="no file"):
        target.rewrite(["generation=0/period=2023-01/part"], sales())
    assert target.files() == [first, second]


def test_conflicts_and_replay(monkeypatch, versions, sales):
    rows = sales((1, "2023-01", 1), (2, "2023-02", 2))
    target = versions(rows, sales((3, "2023-01", 3)))
    late = target.pinned()
    (file, *_) = (f for f in late.files() if "2023-01" in f)
    target.replace(sales((9, "2023-02", 9)))
    late.rewrite([file], sales((4, "2023-01", 4)))  # another block was changed: carried over
    assert sorted(r.sale_id for r in target.read().collect()) in ([3, 4, 9], [1, 4, 9])
    late = versions(rows).pinned()
    SnapshotTable(late.spark, late.path).append(sales((5, "2023-01", 5)))
    with pytest.raises(CommitConflict):
        late.rewrite([f for f in late.files() if "2023-01" in f], rows.limit(0))
    other, stage = versions(sales((1, "2023-01", 5), (2, "2023-02", 2))), SnapshotTable._stage

    def meanwhile(self, *args):
        monkeypatch.setattr(SnapshotTable, "_stage", stage)
        SnapshotTable(self.spark, self.path).append(sales((6, "2023-01", 6)))
        return stage(self, *args)

    monkeypatch.setattr(SnapshotTable, "_stage", meanwhile)
    TableSync(rows, other).patch(by_file=True)
    assert rows_of(other.read()) == rows_of(rows)


def test_a_failing_write_and_vacuum(versions, sales):
    """A folder that lives in part loses the files that no kept version names, and no other."""
    rows = sales(*((i, "2023-01", i) for i in range(8)))
    target = versions()
    target._begin()
    target._commit("append", ["period=2023-01"], target._stage(rows.repartition(4), "keep"), False, lambda name: True, alone=False)
    files = target.files()
    assert len(files) == 4 and len(target._manifest(1)["folders"]) == 1
    bad = rows.withColumn("amount", F.raise_error(F.lit("disk full")).cast("decimal(18,2)"))
    with pytest.raises(Exception, match="disk full"):
        target.rewrite(files[:1], bad)
    assert target.files() == files and target.version() == 1
    kept = rows_of(target.read_files(files[2:]).drop("file"))
    target.rewrite(files[:1], rows.limit(0))
    target.rewrite(files[1:2], rows.limit(0))
    assert target.files() == files[2:] and rows_of(target.read()) == kept
    assert target.vacuum(versions=3, minutes=-1) >= 0 and rows_of(target.read(1)) == rows_of(rows)
    assert target.vacuum(minutes=-1) == 2 and target.files() == files[2:] and rows_of(target.read()) == kept
    assert sorted(p.name for p in Path(target.path).rglob("*.parquet")) == sorted(f.rpartition("/")[2] for f in files[2:])
    target.restore(3)
    target.replace(sales((1, "2023-01", 1)))
    assert target.read().count() == 1
