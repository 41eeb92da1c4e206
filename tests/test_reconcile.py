"""Differences told from invertible Bloom tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_text, rows_of
from mendline import SnapshotTable, TableSync
from mendline.operators import reconcile
from mendline.operators.delta import apply_delta, block_delta


@pytest.fixture
def wide(sales):
    return sales(*((i, f"2023-0{1 + i % 3}", i % 17, f"c{i % 5}") for i in range(600)))


def blocks_of(spark, *periods):
    return spark.createDataFrame([(p,) for p in periods], "period string")


def test_places_are_the_same_on_both_sides(spark, sales):
    """What a task computes for a row is what peeling computes for its key."""
    rows = sales((1, "2023-01", 5), (2, "", 7, None))
    keys = {(int(r._high), int(r._low)) for r in reconcile.with_key(rows).collect()}
    table = reconcile.table_difference(rows, rows.limit(0), 30).collect()
    for high, low in keys:
        check, places = reconcile._check_and_places(high, low, 10)
        mine = [r for r in table if int(r.high) == high and int(r.low) == low]
        assert {r.cell for r in mine} == set(places) and {int(r.check_sum) for r in mine} == {check}
    assert reconcile.table_difference(rows, rows, 30).isEmpty()


@pytest.mark.parametrize("seed", range(5))
def test_peeling(seed):
    """Bags of keys with copies of both signs come back; a table that is too small says so, and tells nothing wrong."""
    draw = random.Random(seed)
    keys = {(draw.getrandbits(64) - (1 << 63), draw.getrandbits(64) - (1 << 63)): draw.choice([-3, -1, 1, 1, 2]) for _ in range(150)}

    def table(third):
        cells: dict[int, list[int]] = {}
        for key, copies in keys.items():
            check, places = reconcile._check_and_places(*key, third)
            for place in places:
                cell = cells.setdefault(place, [0, 0, 0, 0])
                for i, number in enumerate((1, *key, check)):
                    cell[i] += number * copies
        return cells

    assert reconcile.peel(table(100), 100) == keys
    assert reconcile.peel(table(40), 40) is None
    assert reconcile.peel({}, 10) == {}
    assert reconcile.peel({3: [1, 5, 5, 9]}, 10) is None  # a wrong check number


@pytest.mark.parametrize("sizes", [(240,), (3, 240), (3,), (3, 6)])
def test_equals_the_comparison_row_by_row(spark, wide, sizes):
    """At once, by a second table, and where no table is large enough."""
    source = wide.unionByName(wide.where("sale_id < 6")).withColumn("customer", F.when(F.col("sale_id") == 9, None).otherwise(F.col("customer")))
    target = wide.where("sale_id % 40 <> 7").unionByName(wide.where("sale_id IN (3, 4)")).unionByName(wide.where("sale_id IN (3, 4)"))
    both = blocks_of(spark, "2023-01", "2023-02", "2023-04")
    mine = lambda df: df.where("period <> '2023-03'")
    delta = reconcile.reconciled_delta(source, target, both, sizes)
    expected = block_delta(mine(source), mine(target))
    assert rows_of(delta) == rows_of(expected) and expected.count() > 10
    assert rows_of(apply_delta(target, delta)) == rows_of(mine(source).unionByName(target.where("period = '2023-03'")))


def test_nulls_and_neighbours_have_keys_of_their_own(spark):
    from datetime import datetime
    from decimal import Decimal

    from mendline import SALES

    day, one = datetime(2023, 1, 1), Decimal("1.00")
    rows = [(1, 1, day, c, p, one, "x") for c, p in [("a", None), (None, "a"), ("a", ""), ("", "a"), (None, None), ("", ""), ("ab", ""), ("a", "b")]]
    rows += [(None, 1, day, "a", "b", one, "x"), (1, None, day, "a", "b", one, "x"), (1, 1, None, "a", "b", one, "x"), (1, 1, day, "a", "b", None, "x")]
    keys = reconcile.with_key(spark.createDataFrame(rows, SALES)).collect()
    assert len({r._high for r in keys}) == len({r._low for r in keys}) == len(rows)
    assert not {r._high for r in keys} & {r._low for r in keys}


def test_empty_sides_and_the_empty_block(spark, sales, wide):
    nothing = wide.limit(0)
    blocks = blocks_of(spark, "2023-01", None)
    assert reconcile.reconciled_delta(nothing, nothing, blocks).isEmpty()
    assert reconcile.reconciled_delta(wide, wide, blocks).isEmpty()
    assert reconcile.reconciled_delta(wide, nothing, blocks.limit(0)).isEmpty()
    some = sales((1, None, 1), (1, None, 1), (2, "", 2))
    there = reconcile.reconciled_delta(some, nothing, blocks).collect()
    assert sorted((r.sale_id, r.period, r.copies) for r in there) == [(1, "", 2), (2, "", 1)]
    gone = reconcile.reconciled_delta(nothing, some, blocks)
    assert sorted(r.copies for r in gone.collect()) == [-2, -1]
    assert apply_delta(some, gone).isEmpty()
    with pytest.raises(ValueError, match="cells"):
        reconcile.table_difference(some, some, 2)


@pytest.mark.parametrize("versions", [False, True])
def test_a_patch_equals_a_full_copy(spark, table, wide, tmp_path, versions):
    target = SnapshotTable(spark, str(tmp_path / "v")) if versions else table()
    target.append(wide.where("sale_id % 50 <> 7 AND period <> '2023-03'"))
    target.append(wide.where("sale_id % 60 = 1").withColumn("amount", F.lit(3).cast("decimal(18,2)")))
    target.append(wide.limit(1).withColumn("period", F.lit("1999-01")))  # the target's own
    sync = TableSync(wide, target)
    delta = sync.patch()
    assert {r.period for r in delta.collect()} <= {"2023-01", "2023-02", "2023-03"} and not delta.isEmpty()
    assert rows_of(target.read().where("period <> '1999-01'")) == rows_of(wide)
    assert sync.patch().isEmpty() and target.fetch("1999-01").count() == 1


def test_what_is_shuffled_does_not_grow_with_the_block(spark, wide):
    """A block of any size sends its cells, and a repair shuffles only the rows that differ."""
    many = wide.withColumn("sale_id", F.explode(F.sequence(F.col("sale_id") * 1000, F.col("sale_id") * 1000 + 99)))
    left = reconcile.table_difference(many, many.where("sale_id <> 5000"), 60)
    assert left.count() == 3
    text = plan_text(left)
    assert text.index("HashAggregate") < text.index("Exchange") and "SortAggregate" not in text
    assert text.count("Exchange") == 1


def test_no_table_is_tried_that_cannot_be_enough(monkeypatch, spark, wide):
    """A block with far too many different rows is compared row by row at once, one with some more gets the table that fits."""
    tried, difference = [], reconcile.table_difference
    monkeypatch.setattr(reconcile, "table_difference", lambda s, t, cells: (tried.append(cells), difference(s, t, cells))[1])
    target = wide.where("sale_id % 2 = 0")
    both = blocks_of(spark, "2023-01", "2023-02")
    delta = reconcile.reconciled_delta(wide, target, both, (30, 45, 60))
    mine = lambda df: df.where("period <> '2023-03'")
    assert rows_of(delta) == rows_of(block_delta(mine(wide), mine(target)))
    assert tried == [30]
    tried.clear()
    delta = reconcile.reconciled_delta(wide, target, both, (30, 45, 1200))
    assert rows_of(delta) == rows_of(block_delta(mine(wide), mine(target)))
    assert tried == [30, 1200]


def test_other_blocks_go_before_joins(spark, sales):
    rows = sales((1, "2023-01", 5), (2, "", 7), (3, None, 1), (4, "2023-02", 2)).repartition(2)
    for periods in (["2023-01"], ["2023-01", ""], [None, "2023-02"], ["no"], []):
        some = spark.createDataFrame([(p,) for p in periods], "period string")
        names = reconcile.collected_names(some)
        assert rows_of(reconcile.fetch_named_blocks(rows, some, names=names)) == rows_of(reconcile.fetch_named_blocks(rows, some))
    named = blocks_of(spark, "2023-01")
    looked_up = rows.join(spark.createDataFrame([(1, "z")], "sale_id bigint, more string"), "sale_id", "left")
    plan = reconcile.fetch_named_blocks(looked_up, named, names=["2023-01"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("= 2023-01)")
