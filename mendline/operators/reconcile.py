"""Which rows of two sides differ, told from a small table per block instead of the rows themselves.

Each row is added to three cells of its block's invertible Bloom table: its copies, the two halves of its key, and a check number are summed up. The tables of both
sides are subtracted cell by cell, so that equal rows cancel out whatever their number, and what is left is peeled: a cell that only copies of one row are
left in names that row, which is then taken out of its other cells. A table of ``n`` cells tells about ``0.8 n`` different rows; what is shuffled is one
row per task and cell, and depends on the size of the table, not of the block. A table that does not peel still tells about how many rows differ, by the squares of its
check numbers: the block gets the first larger table that takes so many, and one that is too different for the largest is compared row by row at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.digest import joined, pieces
from ..schema import AMOUNT
from ..scratch import materialise
from .blocks import collected_names, collected_spans, fetch_named_blocks
from .content import ROW
from .delta import block_delta

#: Cells per block. All blocks begin with the first; each further attempt reads only blocks that it is expected to solve.
SIZES = (240, 3_840, 61_440)
_PLACES = 3
_PLACE_BITS = 20
_HALF = 1 << 63
_FIGURES = ("copies", "high", "low", "check_sum")
#: Different rows per cell that a table is expected to tell, less than it can, as they are estimated.
_LOAD = 0.7
_PEELED = "period string, high bigint, low bigint, copies bigint, solved boolean"


def _row_key(half: int) -> Column:
    """64 bits of a row, its block aside; NULLs are told from other values by where they are, as the hash passes over them."""
    kinds = {"sale_id": "string", "sale_ts": "timestamp_ntz", "line_no": "int", "amount": AMOUNT}
    fields = [F.col(name).cast(kinds[name]) if name in kinds else F.col(name) for name in ROW]
    return F.xxhash64(F.lit(half), *(field.isNull() for field in fields), *fields)


def with_key(sales: DataFrame) -> DataFrame:
    """The rows with ``_high`` and ``_low``, the two halves of their key."""
    return sales.withColumns({"_high": _row_key(1), "_low": _row_key(2)})


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _check_and_places(high: int, low: int, third: int) -> tuple[int, list[int]]:
    """What ``_cells`` computes for a key: Spark's ``xxhash64`` goes on from the hash of one column to that of the next."""
    digest = xxhash.xxh64_intdigest(low.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(high.to_bytes(8, "little", signed=True), 42))
    bits = (1 << _PLACE_BITS) - 1
    return _signed(digest), [(digest >> (_PLACE_BITS * i) & bits) % third + i * third for i in range(_PLACES)]


def _cells(sales: DataFrame, third: int, side: int) -> DataFrame:
    """One row per row and cell that it is in, with the numbers to be summed up."""
    keyed = with_key(sales).select(F.coalesce("period", F.lit("")).alias("period"), "_high", "_low")
    checked = keyed.withColumn("_check", F.xxhash64("_high", "_low"))
    bits = (1 << _PLACE_BITS) - 1
    places = [
        (F.shiftrightunsigned("_check", _PLACE_BITS * i).bitwiseAND(F.lit(bits)) % third + i * third).cast("int") for i in range(_PLACES)
    ]
    # The numbers are made before the rows are repeated.
    numbers = (
        (part * F.lit(side)).alias(f"{alias}_{i}")
        for name, alias in zip(("_high", "_low", "_check"), _FIGURES[1:])
        for i, part in enumerate(pieces(F.col(name)))
    )
    made = checked.select("period", F.lit(side).alias("copies"), *numbers, F.array(*places).alias("places"))
    return made.withColumn("cell", F.explode("places")).drop("places")


def table_difference(source: DataFrame, target: DataFrame, cells: int) -> DataFrame:
    """``(period, cell, copies, high, low, check_sum)``: the source's table less the target's, without cells that cancel out.

    Sums are exact. They are combined in each task before the only shuffle, so a block with most of the rows is no harder than others.
    """
    third = _third(cells)
    both = _cells(source, third, 1).unionByName(_cells(target, third, -1))
    sums = (joined([F.sum(f"{name}_{i}") for i in range(3)]).alias(name) for name in _FIGURES[1:])
    summed = both.groupBy("period", "cell").agg(F.sum("copies").alias("copies"), *sums)
    return summed.where(" OR ".join(f"{name} <> 0" for name in _FIGURES))


def _third(cells: int) -> int:
    if not _PLACES <= cells <= _PLACES << _PLACE_BITS:
        raise ValueError(f"a table has {_PLACES} to {_PLACES << _PLACE_BITS} cells, not {cells}")
    return cells // _PLACES


def peel(cells: dict[int, list[int]], third: int) -> dict[tuple[int, int], int] | None:
    """Copies by key, below zero where the target has too many; None if something is left that no cell tells apart."""
    found: dict[tuple[int, int], int] = {}
    pending, left = list(cells), 4 * len(cells)
    while pending and left:
        at = pending.pop()
        copies, high, low, check = cells[at]
        if not copies or high % copies or low % copies or not all(-_HALF <= number // copies < _HALF for number in (high, low)):
            continue
        key = high // copies, low // copies
        right, places = _check_and_places(*key, third)
        if right * copies != check or at not in places:
            continue
        found[key] = found.get(key, 0) + copies
        for place in places:
            cell = cells.setdefault(place, [0, 0, 0, 0])
            for i, number in enumerate((1, *key, right)):
                cell[i] -= number * copies
            pending.append(place)
        left -= 1
    if any(any(cell) for cell in cells.values()):
        return None
    return {key: copies for key, copies in found.items() if copies}


def estimate(checks: Iterable[int]) -> int:
    """About how many rows differ, by the check numbers of a whole table: the sum of the squares of their copies.

    A check number is as good as random, so the expected square of a cell is the sum of those of its rows, 2^126 / 3 each, and every row is in three cells.
    """
    return round(sum((check / _HALF) ** 2 for check in checks))


def _peel_blocks(third: int):
    def peel_block(rows: pd.DataFrame) -> pd.DataFrame:
        about = min(estimate(int(x) for x in rows["check_sum"]), _HALF - 1)
        cells = {int(cell): [int(x) for x in figures] for cell, *figures in zip(rows["cell"], *(rows[name] for name in _FIGURES))}
        found, period = peel(cells, third), rows["period"].iloc[0]
        told = [(period, None, None, about, False)] if found is None else [(period, *key, copies, True) for key, copies in found.items()]
        return pd.DataFrame(told, columns=["period", "high", "low", "copies", "solved"]).astype({name: "Int64" for name in ("high", "low", "copies")})

    return peel_block


def differing_keys(source: DataFrame, target: DataFrame, cells: int) -> DataFrame:
    """``(period, high, low, copies, solved)``: keys of rows that differ, and one row that is not ``solved`` for each block that did not peel,
    whose ``copies`` are about how many rows differ.

    A group is the cells of one block, of which there are at most ``cells``.
    """
    left = table_difference(source, target, cells)
    return left.groupBy("period").applyInPandas(_peel_blocks(_third(cells)), _PEELED)


def with_copies(sales: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with ``copies`` of their key in their block, NULL where ``keys`` does not have it."""
    named = keys.select(F.col("period").alias("_block"), F.col("high").alias("_h"), F.col("low").alias("_l"), "copies")
    same = (F.coalesce("period", F.lit("")) == F.col("_block")) & (F.col("_high") == F.col("_h")) & (F.col("_low") == F.col("_l"))
    return with_key(sales).join(named, same, "left").select(*sales.columns, "copies")


def reconciled_delta(
    source: DataFrame, target: DataFrame, differing: DataFrame, sizes: Sequence[int] = SIZES, derived: bool = False
) -> DataFrame:
    """What ``block_delta`` gives for the blocks of ``differing``, without a shuffle of their rows.

    The sides exchange tables of ``sizes`` cells, then each is read once more for the rows that the keys name. Both sides are bags; repeated rows, NULLs and
    empty sides are as in ``block_delta``, but that a NULL period comes out as the empty one, as they are one block. Keys have 128 bits and the check 64, both
    against accidents only: nobody can be kept from making two rows with one key on purpose. ``derived`` is as for ``fetch_named_blocks``.
    """
    def named(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        spans, names = collected_spans(blocks) if derived else None, collected_names(blocks)
        return fetch_named_blocks(source, blocks, derived, spans, names), fetch_named_blocks(target, blocks, names=names)

    left, keys = differing.select("period", F.lit(0).alias("about")), None
    for cells in sizes:
        suited = F.col("about") <= F.lit(_LOAD * cells)
        if keys is not None and left.where(suited).isEmpty():
            continue
        told = materialise(differing_keys(*named(left.where(suited)), cells), "keys")
        solved, unsolved = told.where("solved"), told.where("NOT solved").select("period", F.col("copies").alias("about"))
        keys = solved if keys is None else keys.unionByName(solved)
        left = unsolved.unionByName(left.where(~suited))
    blocks, parts = keys.select("period").distinct(), []
    row = [*ROW, F.coalesce("period", F.lit("")).alias("period")]
    if not left.isEmpty():
        parts.append(block_delta(*(side.select(*row) for side in named(left))))
    if not (parts and blocks.isEmpty()):
        parts += [
            with_copies(side, keys.where(way)).where("copies IS NOT NULL").select(*row, "copies").distinct()
            for side, way in zip(named(blocks), ("copies > 0", "copies < 0"))
        ]
    delta = parts[0]
    for part in parts[1:]:
        delta = delta.unionByName(part)
    return delta.select(*ROW, "period", "copies")


def patched_blocks(target: DataFrame, delta: DataFrame) -> DataFrame:
    """What the blocks of a delta hold once it is applied: the target's rows, with missing copies added and the others taken away.

    Only rows that the delta names are shuffled; all others pass as they are.
    """
    named = with_key(delta).select(F.coalesce("period", F.lit("")).alias("period"), F.col("_high").alias("high"), F.col("_low").alias("low"), "copies")
    rows = with_copies(fetch_named_blocks(target, delta), named)
    row = [*ROW, F.coalesce("period", F.lit("")).alias("period")]
    there = rows.where("copies IS NOT NULL").select(*row, F.lit(1).cast("bigint").alias("copies"))
    counted = there.unionByName(delta.select(*row, "copies")).groupBy(*ROW, "period").agg(F.sum("copies").alias("copies"))
    repeated = counted.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return rows.where("copies IS NULL").select(*target.columns).unionByName(repeated.select(*target.columns))
