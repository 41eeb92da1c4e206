"""The canonical text of a block and its digest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from ..schema import AMOUNT_SUM

#: The digest that sees every column, see ``operators/content``.
CONTENT = "content"

DIGESTS: dict[str, Callable[[Column], Column]] = {
    "md5": F.md5,
    "sha256": lambda text: F.sha2(text, 256),
}


def block_text(amount_sum: Column, row_count: Column) -> Column:
    """``sum|count``; the sum always has two decimals, so equal blocks give equal text."""
    return F.concat_ws(
        "|", amount_sum.cast(AMOUNT_SUM).cast("string"), row_count.cast("string")
    )


def block_hash(amount_sum: Column, row_count: Column, digest: str = "md5") -> Column:
    """Lower-case hex digest of the block text; an empty block has the empty hash."""
    if digest not in DIGESTS:
        raise ValueError(f"digest must be one of {sorted([*DIGESTS, CONTENT])}, not {digest!r}")
    text = block_text(amount_sum, row_count)
    return F.when(row_count == 0, F.lit("")).otherwise(DIGESTS[digest](text))


#: Bits of a piece of a number that is summed up: 2^41 rows fit into a sum.
PIECE = 22


def pieces(number: Column) -> tuple[Column, Column, Column]:
    """A number of 64 bits as three small ones, lowest first, of which the highest has the sign: sums of these take a fraction of the time of sums of decimals."""
    low = F.lit((1 << PIECE) - 1)
    return number.bitwiseAND(low), F.shiftright(number, PIECE).bitwiseAND(low), F.shiftright(number, 2 * PIECE)


def joined(sums: Sequence[Column]) -> Column:
    """The exact sum of numbers, from the sums of their pieces."""
    low, middle, high = ((part.cast("decimal(19,0)") * F.lit(1 << (PIECE * i)).cast("decimal(14,0)")) for i, part in enumerate(sums))
    return (low + middle + high).cast("decimal(38,0)")


def content_hash(high_sum: Column, low_sum: Column, row_count: Column) -> Column:
    """MD5 of the figures of a bag of rows; an empty block has the empty hash."""
    text = F.concat_ws("|", *(x.cast("string") for x in (high_sum, low_sum, row_count)))
    return F.when(row_count == 0, F.lit("")).otherwise(F.md5(text))
