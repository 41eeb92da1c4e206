"""Shared session, and small sales tables made of plain tuples."""

from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from mendline import SALES, BlockTable, clear_scratch  # noqa: E402
from mendline.scratch import CHECKPOINT_DIR  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("mendline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    if not session.conf.get(CHECKPOINT_DIR, None):
        session.conf.set(CHECKPOINT_DIR, str(tmp_path_factory.mktemp("scratch")))
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture
def sales(spark):
    """A sales DataFrame from (id, period, amount[, customer]) tuples."""

    def make(*rows):
        full = []
        for sale_id, period, amount, *customer in rows:
            day = datetime(2023, 1, 1 + sale_id % 28)
            full.append((sale_id, 1, day, *(customer or ["c"]), "p", amount, period))
        return spark.createDataFrame(
            [(i, n, t, c, p, _money(a), q) for i, n, t, c, p, a, q in full], SALES
        )

    return make


@pytest.fixture
def table(spark, tmp_path):
    """A new stored table, optionally with rows."""
    count = iter(range(1_000_000))

    def make(rows=None):
        made = BlockTable(spark, str(tmp_path / f"table-{next(count)}"))
        if rows is not None:
            made.append(rows)
        return made

    return make


def _money(text):
    return Decimal(str(text)).quantize(Decimal("0.01"))


def rows_of(df):
    """Rows as sorted texts, for comparison as bags."""
    columns = sorted(df.columns)
    return sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())


def files_of(made, period=None):
    """Names and times of the data files of a table or of one block."""
    root = Path(made.path) if period is None else Path(made.path) / f"period={period}"
    return sorted((p.name, p.stat().st_mtime_ns) for p in root.rglob("*.parquet"))


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
