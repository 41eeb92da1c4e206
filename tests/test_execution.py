"""Physical plans and file layout: what is read, shuffled and split."""

from __future__ import annotations

import ast
import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import mendline
from mendline.operators.blocks import fetch_named_blocks
from mendline.operators.headers import block_headers
from mendline.operators.perturb import perturb_block
from mendline.plans.plan import changed_blocks, sync_plan
from mendline.scratch import materialise
from mendline.sources.synthetic import synthetic_sales
from mendline.sources.table import REBALANCE
from mendline.workloads.queries import QUERIES
from conftest import SF_SMALL, files_of, plan_text


@pytest.fixture
def stored(spark, table):
    return table(synthetic_sales(spark, datetime(2023, 1, 1), rows=2_000))


def test_headers_read_one_column_beside_the_partition(stored):
    text = plan_text(stored.headers())
    assert "ReadSchema: struct<amount:decimal(18,2)>" in text
    assert text.count("Exchange") == 1 and "SortAggregate" not in text
    assert "partial_sum" in text


def test_copying_scans_changed_blocks_only(stored, table):
    plan = sync_plan(stored.headers(), table(stored.fetch("2022-01", "2022-02")).headers())
    rows = fetch_named_blocks(stored.read(), changed_blocks(materialise(plan, "plan")))
    text = plan_text(rows)
    pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", text).group(1)
    assert "dynamicpruning" in pruned
    assert "Exchange hashpartitioning(coalesce(period" not in text


def test_header_join_adds_no_shuffle(spark, stored):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan_text(sync_plan(stored.headers(), stored.headers()))
        assert text.count("Exchange hashpartitioning") == 2 and "Broadcast" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_header_queries_read_line_items_only(spark):
    text = plan_text(QUERIES["headers_source"](spark, SF_SMALL))
    assert text.count("FileScan") == 1
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_a_month_reaches_the_scan_as_a_time_range(spark):
    text = plan_text(QUERIES["fetch_source_block"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(l_shipdate,1997-03-01" in text
    assert "LessThan(l_shipdate,1997-04-01" in text


def test_changed_months_reach_the_scan_as_time_ranges(spark):
    text = plan_text(QUERIES["fetch_changed_blocks"](spark, SF_SMALL))
    assert re.search(r"l_shipdate#\d+ >= (Subquery|ReusedSubquery|scalar-subquery)", text)
    assert re.search(r"l_shipdate#\d+ <= (Subquery|ReusedSubquery|scalar-subquery)", text)
    text = plan_text(QUERIES["sync_merge"](spark, SF_SMALL))
    assert re.search(r"l_shipdate#\d+ >= (Subquery|ReusedSubquery|scalar-subquery)", text)
    for name in ("perturb_block", "stats_empty"):
        assert "GreaterThanOrEqual(" in plan_text(QUERIES[name](spark, SF_SMALL))


def test_perturbing_ranks_one_slot_not_the_block(stored):
    text = plan_text(perturb_block(stored.read(), "2022-05"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    ranked = [line for line in text.splitlines() if "Window [" in line]
    assert all("slot" in line for line in ranked)


def test_a_hot_block_is_split_over_several_files(spark, table):
    rows = synthetic_sales(spark, datetime(2023, 1, 1), rows=60_000)
    hot = F.when(F.col("sale_id") % 3 == 0, "2022-07").otherwise(F.col("period"))
    rows = rows.withColumn("period", hot).repartition(16)
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
    }
    old = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        made = table()
        made.replace(rows, REBALANCE)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert len(files_of(made, "2022-07")) >= 3
    assert len(files_of(made)) < 12 * 16
    assert made.read().count() == 60_000


def test_a_stored_block_is_copied_without_an_exchange(stored):
    assert "Exchange" not in plan_text(stored.fetch("2022-02"))


def test_no_local_checkpoints_or_row_functions():
    banned = {"localCheckpoint", "toPandas", "crossJoin", "udf", "pandas_udf"}
    for file in Path(mendline.__file__).parent.rglob("*.py"):
        names = {n.attr for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & banned, file
