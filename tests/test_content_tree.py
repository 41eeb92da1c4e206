"""Digests of whole rows, and the tree that leads to the rows that differ."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from mendline import SALES, SnapshotTable, TableSync
from mendline.operators import content, tree
from mendline.operators.headers import block_headers


def bag(spark, *rows):
    return spark.createDataFrame([(i, 1, datetime(2023, 3, d) if d else None, c, "p", a, p) for i, d, c, a, p in rows], SALES)


@pytest.fixture
def wide(sales):
    return sales(*((i, f"2023-0{1 + i % 3}", i % 17, f"c{i % 5}") for i in range(400)))


def test_what_amounts_hide(table, sales):
    """Renamed customers and cancelling changes are equal by amounts, and differ by content."""
    source = sales((1, "2023-01", 5), (2, "2023-01", 7), (3, "2023-02", 1, "a"), (4, "2023-03", 1))
    target = sales((1, "2023-01", 6), (2, "2023-01", 6), (3, "2023-02", 1, "b"), (4, "2023-03", 1))
    def by(digest):
        return {r.period: r.action for r in TableSync(source, table(target), digest).plan().collect()}

    assert set(by("md5").values()) == {"SKIP"}
    assert by("content") == {"2023-01": "REPAIR", "2023-02": "REPAIR", "2023-03": "SKIP"}
    with pytest.raises(ValueError, match="content"):
        block_headers(source, "crc")


def test_rows_do_not_run_together(spark):
    from decimal import Decimal

    one = Decimal("1.00")
    texts = [("a|1:b", one), ("a", one), ("", one), (None, one), ("-", one), ("1:a", one), ("a", None), ("a", Decimal("10.00"))]
    rows = [bag(spark, (1, 2, c, a, "x")) for c, a in texts] + [bag(spark, (None, 2, "a", one, "x")), bag(spark, (1, None, "a", one, "x"))]
    marks = {r.select(content.row_mark()).first()[0] for r in rows}
    assert len(marks) == len(rows)


def test_sums_of_bags(spark, wide):
    totals = lambda df: content.content_totals(df)
    a, b = wide.where("sale_id % 3 = 0"), wide.where("sale_id % 3 <> 0")
    both = content.add(totals(a), totals(b))
    assert rows_of(both) == rows_of(totals(wide)) == rows_of(totals(wide.repartition(7).orderBy(F.desc("sale_id"))))
    assert rows_of(content.subtract(both, totals(b))) == rows_of(totals(a))
    assert content.subtract(both, totals(wide)).count() == 0
    twice = content.content_headers(totals(wide.unionByName(wide)))
    assert not {r.block_hash for r in twice.collect()} & {r.block_hash for r in content.content_headers(totals(wide)).collect()}
    assert totals(wide.limit(0)).count() == 0


@pytest.mark.parametrize("versions", [False, True])
def test_one_changed_row_is_one_leaf(spark, table, wide, tmp_path, versions):
    target = SnapshotTable(spark, str(tmp_path / "v")) if versions else table()
    target.append(wide.withColumn("customer", F.when(F.col("sale_id") == 100, "other").otherwise(F.col("customer"))))
    target.append(wide.limit(1).withColumn("period", F.lit("1999-01")))  # the target's own
    sync = TableSync(wide, target)
    leaves = sync.mend(buckets=4).collect()
    assert len(leaves) == 1 and leaves[0].period == "2023-02" and leaves[0].source_rows == leaves[0].target_rows < 20
    assert rows_of(target.read().where("period <> '1999-01'")) == rows_of(wide)
    assert sync.mend(buckets=4).count() == 0 and target.fetch("1999-01").count() == 1


def test_a_mend_equals_a_full_copy(spark, table, wide):
    """Rows lost, added, repeated, moved to another day, without time, id or period, in months of either side only."""
    nothing = wide.limit(3).withColumns({"sale_ts": F.lit(None).cast("timestamp_ntz"), "sale_id": F.lit(None).cast("bigint"), "period": F.lit(None).cast("string")})
    source = wide.unionByName(nothing).unionByName(wide.where("sale_id < 9"))
    damaged = source.where("sale_id IS NULL OR sale_id % 50 <> 7").where("period IS NULL OR period <> '2023-03'").unionByName(wide.where("sale_id % 60 = 1"))
    damaged = damaged.withColumn("sale_ts", F.when(F.col("sale_id") == 9, F.expr("sale_ts + INTERVAL '1' DAY")).otherwise(F.col("sale_ts")))
    target = table(damaged.withColumn("product", F.when(F.col("sale_id").isNull(), "q").otherwise(F.col("product"))))
    sync = TableSync(source, target)
    leaves = sync.mend()
    full = table(source)
    assert rows_of(target.read()) == rows_of(full.read())
    months = {r.period for r in leaves.select("period").collect()}
    assert months == {"", "2023-01", "2023-02", "2023-03"}
    empty = table()
    TableSync(source, empty).mend()
    assert rows_of(empty.read()) == rows_of(full.read())
    assert TableSync(wide.limit(0), full).mend().count() == 0


def test_only_differing_months_are_fetched(spark, wide, table):
    leaves = tree.differing_leaves(wide, wide.where("sale_id <> 100"))
    stored = table(wide).read()
    fetched = tree.fetch_leaves(stored, leaves)
    assert {r.period for r in fetched.collect()} == {"2023-02"}
    plan = fetched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dynamicpruning" in plan


def test_rows_are_read_once(monkeypatch, wide):
    """Days and months are added up from stored leaves; the sums are exact for numbers of both signs."""
    monkeypatch.setattr(tree, "fetch_named_blocks", None)
    target = wide.where("sale_id <> 100").unionByName(wide.where("sale_id = 7"))
    found = {(r.period, r.source_rows - r.target_rows) for r in tree.differing_leaves(wide, target).collect()}
    changed = {r.sale_id: r.period for r in wide.where("sale_id IN (7, 100)").collect()}
    assert found == {(changed[100], 1), (changed[7], -1)}
    numbers = [(1 << 63) - 1, -(1 << 63), -1, 0, 5, (1 << 44) - 1, -(1 << 22)] * 3
    rows = wide.sparkSession.createDataFrame([(n,) for n in numbers], "n bigint")
    assert int(rows.agg(content.sum_of(F.col("n"))).first()[0]) == sum(numbers)
