"""Headers, plan, results, report, comparison and status on small tables."""

from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mendline.operators import blocks, stats
from mendline.operators.headers import block_headers, header_equality
from mendline.plans.compare import comparison_summary, hash_comparison
from mendline.plans.plan import block_results, sync_plan
from mendline.plans.report import (
    as_json, report_lines, sync_document, sync_report, write_json,
)
from mendline.plans.status import system_status
from mendline.sources.synthetic import synthetic_sales
from conftest import rows_of


def actions(source, target):
    plan = sync_plan(block_headers(source), block_headers(target))
    return {row.period: row.action for row in plan.collect()}


def test_header_text_and_digests(sales):
    rows = sales((1, "2023-01", "10.5"), (2, "2023-01", "-0.25"), (3, "2023-02", "0"))
    header = {r.period: r for r in block_headers(rows).collect()}
    assert header["2023-01"].block_hash == hashlib.md5(b"10.25|2").hexdigest()
    assert header["2023-02"].block_hash == hashlib.md5(b"0.00|1").hexdigest()
    sha = {r.period: r.block_hash for r in block_headers(rows, "sha256").collect()}
    assert sha["2023-01"] == hashlib.sha256(b"10.25|2").hexdigest()
    with pytest.raises(ValueError):
        block_headers(rows, "crc")


def test_headers_do_not_depend_on_partitions_and_add_up(sales):
    rows = sales(*((i, f"2023-0{i % 3 + 1}", f"{i}.17") for i in range(60)))
    expected = rows_of(block_headers(rows))
    assert rows_of(block_headers(rows.repartition(7))) == expected
    assert rows_of(block_headers(rows.coalesce(1).orderBy("amount"))) == expected
    even = block_headers(rows.filter("sale_id % 2 = 0"))
    odd = block_headers(rows.filter("sale_id % 2 = 1"))
    total = even.unionByName(odd).groupBy("period").sum("row_count", "amount_sum").collect()
    whole = {r.period: (r.row_count, r.amount_sum) for r in block_headers(rows).collect()}
    assert {r[0]: (r[1], r[2]) for r in total} == whole


def test_derived_headers_are_the_same(spark):
    rows = synthetic_sales(spark, datetime(2024, 1, 1), rows=500)
    assert rows_of(block_headers(rows, derived=True)) == rows_of(block_headers(rows))
    profile = stats.block_profile(rows, derived=True)
    assert rows_of(profile) == rows_of(stats.block_profile(rows))
    undated = rows.selectExpr("CAST(NULL AS TIMESTAMP_NTZ) AS sale_ts", "amount")
    assert [r.period for r in block_headers(undated, derived=True).collect()] == [""]


def test_actions(sales):
    source = sales(
        (1, "2023-01", 1), (2, "2023-02", 2), (3, "2023-03", 3), (4, "2023-03", 4),
        (5, "2023-04", 5), (6, "2023-04", 6), (7, "2023-05", 7, "Ann"), (8, "2023-06", "-8"),
    )
    target = sales(
        (1, "2023-01", 1),                        # equal
        (3, "2023-03", 7),                        # same sum, other count
        (5, "2023-04", 4), (6, "2023-04", 7),     # changes that cancel out: not seen
        (7, "2023-05", 7, "Bob"),                 # other customer: not seen
        (8, "2023-06", "8"),                      # sign
        (9, "2022-12", 1),                        # only in the target
    )
    assert actions(source, target) == {
        "2023-01": "SKIP", "2023-02": "INSERT", "2023-03": "REPAIR",
        "2023-04": "SKIP", "2023-05": "SKIP", "2023-06": "REPAIR",
    }
    same = header_equality(block_headers(source), block_headers(target)).collect()
    assert {r.period for r in same if r.same} == {"2023-01", "2023-04", "2023-05"}


def test_results_report_and_lines(sales):
    source = sales((1, "2023-01", 1), (2, "2023-02", 2), (3, "2023-02", 3), (4, "2023-03", 4))
    target = sales((1, "2023-01", 1), (4, "2023-03", 5))
    results = block_results(sync_plan(block_headers(source), block_headers(target)))
    got = {r.period: (r.rows_processed, r.rows_inserted, r.message) for r in results.collect()}
    assert got == {
        "2023-01": (1, 0, "unchanged"),
        "2023-02": (2, 2, "new: 2 rows copied"),
        "2023-03": (1, 1, "differed: replaced by 1 rows"),
    }
    assert sync_report(results).first().asDict() == {
        "total_blocks": 3, "skipped": 1, "inserted": 1, "repaired": 1,
        "rows_processed": 4, "rows_inserted": 3,
    }
    assert [r.line for r in report_lines(results).collect()] == [
        "2023-01 | SKIP   |     1 rows",
        "2023-02 | INSERT |     2 rows",
        "2023-03 | REPAIR |     1 rows",
    ]
    document = sync_document(results).first()
    assert document.inserted == 1
    assert [d.period for d in document.details] == ["2023-01", "2023-02", "2023-03"]


def test_report_of_nothing(sales):
    results = block_results(sync_plan(block_headers(sales()), block_headers(sales())))
    assert set(sync_report(results).first()) == {0}
    assert sync_document(results).first().details == []


def test_comparison(spark, sales, tmp_path):
    source = sales((1, "2023-01", 1), (2, "2023-02", 2), (3, "2023-03", 3))
    target = sales((1, "2023-01", 1), (3, "2023-03", 9), (4, "2022-01", 4))
    comparison = hash_comparison(block_headers(source), block_headers(target))
    rows = comparison.collect()
    assert [(r.period, r.state) for r in rows] == [
        ("2023-01", "IN_SYNC"), ("2023-02", "MISSING_IN_TARGET"), ("2023-03", "CORRUPT"),
    ]
    assert rows[1].target is None and rows[2].target.amount == 9
    assert tuple(comparison_summary(comparison).first()) == (3, 1, 1, 1)
    assert '"target":null' in as_json(comparison).filter("period = '2023-02'").first().document
    path = str(tmp_path / "json")
    write_json(comparison, path)
    assert spark.read.schema(comparison.schema).json(path).count() == 3


@pytest.mark.parametrize(
    "source,target,state",
    [
        ([], [], "NEVER_SYNCED"),
        ([(1, "2023-01", 1)], [], "NEVER_SYNCED"),
        ([], [(1, "2023-01", 1)], "OUT_OF_SYNC"),
        ([(1, "2023-01", 1)], [(1, "2023-01", 1)], "IN_SYNC"),
        ([(1, "2023-01", 1)], [(1, "2023-01", 2)], "PARTIALLY_SYNCED"),
        ([(1, "2023-01", 1)], [(1, "2023-02", 1)], "PARTIALLY_SYNCED"),
        ([(1, "2023-01", 1)], [(1, "2023-01", 1), (2, "2023-02", 1)], "OUT_OF_SYNC"),
    ],
)
def test_status(sales, source, target, state):
    row = system_status(block_headers(sales(*source)), block_headers(sales(*target))).first()
    assert row.state == state
    assert (row.source.rows, row.target.rows) == (len(source), len(target))
    assert row.target.periods == sorted({t[1] for t in target})


def test_view_operators_on_blocks(sales):
    rows = sales((1, "2023-01", 1), (2, "2023-02", 2), (3, None, 3), (4, "", 4))
    assert blocks.fetch_block(rows, "2023-09").count() == 0
    assert blocks.fetch_block(rows, "").count() == 2
    assert blocks.delete_block(rows, "2023-01").count() == 3
    assert blocks.delete_block(rows, "").count() == 2
    assert blocks.delete_block(rows, "2023-09").count() == 4
    assert blocks.insert_block(rows, rows).count() == 8
    assert blocks.insert_block(rows, sales()).count() == 4
    assert blocks.replace_block(rows, "2023-01", sales((9, "2023-01", 1))).count() == 4
    assert blocks.fetch_block(rows, "2023-01", derived=True).count() == 1
    assert [h.row_count for h in block_headers(rows).filter("period = ''").collect()] == [2]


def test_ranges_of_months():
    assert blocks.month_range("2023-12") == ("2023-12-01 00:00:00", "2024-01-01 00:00:00")
    assert blocks.month_range("9999-12") == ("9999-12-01 00:00:00", None)
    assert [blocks.month_range(p) for p in ("", "2023-13", "0000-01", "+10000-01", "x")] == [None] * 5


def test_open_end_dates_and_many_separate_months(sales):
    rows = sales((1, "9999-12", 1), (2, "2023-01", 2)).withColumn(
        "sale_ts", F.when(F.col("period") == "9999-12", F.lit("9999-12-31").cast("timestamp_ntz")).otherwise(F.col("sale_ts"))
    )
    for chosen in (["9999-12"], ["9999-12", "2023-01"]):
        expected = rows_of(rows.where(F.col("period").isin(chosen)))
        named = rows.where(F.col("period").isin(chosen)).select("period")
        assert rows_of(blocks.fetch_blocks(rows, chosen, derived=True)) == expected
        assert rows_of(blocks.fetch_named_blocks(rows, named, derived=True)) == expected
    apart = [f"{1850 + i:04d}-{i % 6 * 2 + 1:02d}" for i in range(70)]
    spread = sales(*((i, p, i) for i, p in enumerate(apart))).withColumn(
        "sale_ts", F.concat("period", F.lit("-05")).cast("timestamp_ntz")
    )
    assert blocks.fetch_blocks(spread, apart, derived=True).count() == 70
    assert blocks.fetch_blocks(spread, apart[:69], derived=True).count() == 69


def test_far_months_are_ranges_of_their_own(spark, sales, tmp_path):
    """Two months seven years apart: nothing between them is read; beyond ``RANGES`` the narrowest gaps are."""
    spans = blocks.month_spans(["1992-03", "1999-05", "1999-06", "1992-03"])
    assert spans == [("1992-03-01 00:00:00", "1992-04-01 00:00:00"), ("1999-05-01 00:00:00", "1999-07-01 00:00:00")]
    assert blocks.month_spans(["2000-01", "2000-03", "2010-01", "2010-04"], 2) == [
        ("2000-01-01 00:00:00", "2000-04-01 00:00:00"), ("2010-01-01 00:00:00", "2010-05-01 00:00:00"),
    ]
    assert blocks.month_spans(["2000-01", "2000-03", "9999-12"], 1) == [("2000-01-01 00:00:00", None)]
    assert blocks.month_spans(["2000-01", "x"]) is None and blocks.month_spans([]) == []
    months = [f"{1992 + i // 12}-{i % 12 + 1:02d}" for i in range(96)]
    rows = sales(*((i, p, i) for i, p in enumerate(months))).withColumn("sale_ts", F.concat("period", F.lit("-05")).cast("timestamp_ntz"))
    rows.drop("period").repartitionByRange(96, "sale_ts").write.parquet(str(tmp_path / "flat"))
    stored = spark.read.parquet(str(tmp_path / "flat")).withColumn("period", F.date_format("sale_ts", "yyyy-MM"))
    named = spark.createDataFrame([("1992-03",), ("1999-05",)], "period string")
    fetched = blocks.fetch_named_blocks(stored, named, True, blocks.collected_spans(named))
    assert sorted(r.period for r in fetched.collect()) == ["1992-03", "1999-05"]
    scan = fetched._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in scan
    for many in (months[::2], months[::-3]):
        wanted = spark.createDataFrame([(p,) for p in many], "period string")
        assert blocks.fetch_named_blocks(stored, wanted, True, blocks.collected_spans(wanted)).count() == len(many)


def test_more_blocks_than_any_list(spark, sales):
    rows = spark.range(30_000).selectExpr("cast(id % 15000 as string) AS period", "id AS n")
    some = spark.range(12_000).selectExpr("cast(id as string) AS period")
    assert blocks.fetch_named_blocks(rows, some).count() == 24_000
    assert blocks.keep_other_blocks(rows, some).count() == 6_000


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_lookup_keys_are_unique(spark, scale):
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey")):
        table = spark.read.parquet(f"/root/testdata/sf{scale}/{name}.parquet")
        row = table.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).first()
        assert row.n == row["keys"]


def test_derived_periods_give_the_same_rows(sales):
    rows = sales(*((i, "2023-01", i) for i in range(5)), (6, "2023-02", 6), (7, "", 7))
    january = rows_of(blocks.fetch_blocks(rows, ["2023-01"]))
    assert rows_of(blocks.fetch_blocks(rows, ["2023-01"], derived=True)) == january
    assert blocks.fetch_blocks(rows, ["2023-01", ""], derived=True).count() == 6
    assert blocks.fetch_blocks(rows, [], derived=True).count() == 0


def test_merge_by_join_equals_merge_by_list(sales):
    rows = sales(*((i, f"2023-{i:02d}", i) for i in range(1, 10)), (10, None, 10))
    chosen = rows.filter("sale_id > 5").select("period")
    target = rows.filter("sale_id > 2").withColumn("amount", rows.amount)
    names = [r.period for r in chosen.collect()]
    listed = blocks.delete_blocks(target, names).unionByName(blocks.fetch_blocks(rows, names))
    assert rows_of(blocks.merge_blocks(rows, target, chosen)) == rows_of(listed)
    assert rows_of(blocks.fetch_named_blocks(rows, chosen)) == rows_of(rows.filter("sale_id > 5"))
    assert blocks.fetch_named_blocks(rows, chosen.limit(0), derived=True).count() == 0


def test_statistics(sales):
    rows = sales(
        (5, "2023-01", "1.50", "a"), (28, "2023-01", "2.50", "b"), (2, "2023-02", "-1", "a"),
    )
    s = stats.statistics(rows).first()
    assert (s.total_rows, s.total_blocks, s.amount_avg) == (3, 2, 1.0)
    assert (float(s.amount_total), float(s.amount_min), float(s.amount_max)) == (3.0, -1.0, 2.5)
    assert (s.first_id, s.last_id) == ("28", "5")
    assert (s.distinct_customers, s.distinct_products) == (2, 1)
    assert stats.statistics(rows, approximate=True).first().distinct_customers == 2
    empty = stats.statistics(sales()).first()
    assert (empty.total_rows, empty.amount_avg, empty.first_id, empty.first_date) == (0, 0.0, "", None)


def test_top_blocks_break_ties_by_period(sales):
    rows = sales(*((i, f"2023-{i % 12 + 1:02d}", 1) for i in range(24)), (99, "2023-12", 1))
    top = [r.period for r in stats.top_blocks(block_headers(rows)).collect()]
    assert top == ["2023-12"] + [f"2023-{m:02d}" for m in range(1, 10)]
