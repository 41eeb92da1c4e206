"""Texts of results and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import INSERT, REPAIR, SKIP


def thousands(number: Column) -> Column:
    """Integer with grouped thousands."""
    return F.format_number(number, 0)


def block_message(action: Column, rows: Column) -> Column:
    """What happened to a block, in words."""
    return (
        F.when(action == INSERT, F.concat(F.lit("new: "), rows, F.lit(" rows copied")))
        .when(action == SKIP, F.lit("unchanged"))
        .when(action == REPAIR, F.concat(F.lit("differed: replaced by "), rows, F.lit(" rows")))
    )


def report_line(period: Column, action: Column, rows: Column) -> Column:
    """One line of the report: period, action and rows in aligned columns."""
    return F.format_string("%s | %-6s | %5d rows", period, action, rows)


def summary_sentence(
    source_rows: Column,
    source_blocks: Column,
    target_rows: Column,
    customers: Column,
    products: Column,
) -> Column:
    """Both sides in one sentence."""
    return F.concat(
        F.lit("Source holds "), thousands(source_rows),
        F.lit(" rows in "), source_blocks.cast("string"),
        F.lit(" blocks, target holds "), thousands(target_rows),
        F.lit(" rows; source has "), thousands(customers),
        F.lit(" distinct customers and "), thousands(products),
        F.lit(" distinct products."),
    )
