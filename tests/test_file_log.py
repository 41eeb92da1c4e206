"""Figures per file: headers from what came and went, and ranges of time."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from mendline import FileLog, SnapshotTable, TableSync


@pytest.fixture
def target(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "versions"))


@pytest.fixture
def read(monkeypatch):
    """The files whose rows were asked for, call by call."""
    calls, plainly = [], SnapshotTable.read_files

    def noted(self, files=None, version=None):
        calls.append(sorted(files))
        return plainly(self, files, version)

    monkeypatch.setattr(SnapshotTable, "read_files", noted)
    return calls


@pytest.mark.parametrize("content", [False, True])
def test_only_new_files_are_read(spark, target, sales, tmp_path, read, content):
    """After every kind of write, headers equal those of all rows, and no file is read twice."""
    log, digest = FileLog(spark, str(tmp_path / "log"), content), "content" if content else "md5"
    known = set()

    def check():
        read.clear()
        assert rows_of(log.headers(target, digest)) == rows_of(target.headers(digest))
        fresh = sorted(set(target.files()) - known)
        assert read == ([fresh] if fresh else [])
        known.update(fresh)
        return len(fresh)

    assert check() == 0 and log.headers(target, digest).isEmpty()
    target.append(sales((1, "2023-01", 1), (2, "2023-02", 2), (3, None, 3), (4, "a/b:c% +", 4)))
    assert check() == 4
    target.append(sales((5, "2023-01", 5), (1, "2023-01", 1), (6, "", 6)).withColumn("amount", F.expr("nullif(amount, 6)")))
    assert check() == 2
    file = next(f for f in target.files() if "2023-02" in f)
    target.rewrite([file], sales((7, "2023-02", 7)))
    assert check() == 1
    target.replace(sales((8, "2023-01", 8)))
    assert check() == 1
    target.delete(["a/b:c% +"])
    assert check() == 0
    target.restore(2)
    assert check() == 0
    target.clear()
    assert check() == 0
    with pytest.raises(ValueError, match="keep"):
        FileLog(spark, str(tmp_path / "other")).headers(target, "content")


def test_versions_and_other_writers(spark, target, table, sales, tmp_path):
    """A pinned version keeps its headers; figures that two runs log count once."""
    target.append(sales((1, "2023-01", 1)))
    old = target.pinned()
    target.append(sales((2, "2023-01", 2)))
    logs = [FileLog(spark, str(tmp_path / "log")) for _ in range(2)]
    figures = logs[0]._read(target.pinned(), target.files())
    for log in logs:
        log._log.append(figures)
    assert rows_of(logs[0].headers(old)) == rows_of(old.headers())
    assert rows_of(logs[1].headers(target)) == rows_of(target.headers())
    with pytest.raises(TypeError, match="versions"):
        logs[0].headers(table(sales((1, "2023-01", 1))))
    rows = sales((1, "2023-01", 1), (2, "2023-01", 3), (3, "2023-02", 3))
    sync = TableSync(rows, target, header_log=logs[0])
    assert [r.action for r in sync.plan().orderBy("period").collect()] == ["REPAIR", "INSERT"]
    sync.synchronize()
    assert rows_of(target.read()) == rows_of(rows) and {r.action for r in sync.plan().collect()} == {"SKIP"}


def test_a_log_that_lacks_the_digest_of_rows_is_completed(spark, target, sales, tmp_path):
    target.append(sales((1, "2023-01", 1)))
    FileLog(spark, str(tmp_path / "log")).headers(target)
    assert rows_of(FileLog(spark, str(tmp_path / "log"), content=True).headers(target, "content")) == rows_of(target.headers("content"))


def test_ranges_of_time_read_only_files_that_may_hold_them(spark, target, sales, tmp_path, read):
    days = sales(*((i, "2023-01", i) for i in range(28)))  # one day each
    for week in range(4):
        target.append(days.where(F.col("sale_id").between(7 * week, 7 * week + 6)))
    target.append(sales((1, "2023-01", 1)).withColumn("sale_ts", F.lit(None).cast("timestamp_ntz")))
    log, day = FileLog(spark, str(tmp_path / "log")), lambda n, h=0: datetime(2023, 1, n, h)
    log.figures(target)
    for start, end, files, ids in (
        (day(3), day(5), 1, [2, 3]),
        (day(7), day(9), 2, [6, 7]),
        (day(7, 1), day(8), 0, []),
        (day(8), day(8), 0, []),
        (datetime(2020, 1, 1), datetime(2030, 1, 1), 4, list(range(28))),
        (datetime(2030, 1, 1), datetime(2040, 1, 1), 0, []),
    ):
        read.clear()
        got = log.between(target, start, end)
        assert len(read) == 1 and len(read[0]) == files
        assert got.columns == target.read().columns and sorted(r.sale_id for r in got.collect()) == ids
    assert log.between(SnapshotTable(spark, str(tmp_path / "none")), day(1), day(2)).isEmpty()


def test_compaction(spark, target, sales, tmp_path, read):
    log = FileLog(spark, str(tmp_path / "log"))
    for i in range(3):
        target.append(sales((i, "2023-01", i)))
        log.figures(target)
    target.clear()
    target.vacuum(versions=2, minutes=-1)
    assert len(log._log.files()) == 3
    log.compact(target, minutes=-1)
    assert len(log._log.files()) == 1 and log._known().count() == 3 and log._log.versions() == [4]
    target.restore(3)
    read.clear()
    assert rows_of(log.headers(target)) == rows_of(target.headers()) and not read
