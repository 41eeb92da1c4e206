"""Words of whole Arrow string columns, found with array operations instead of a loop per text.

Texts are handled as UTF-8 bytes: ``A-Z`` are lower-cased, a table says which bytes belong to
words, and words never cross from one text into the next. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word that ends at white space: all but space, tab, and the line breaks.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of a word of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 6 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the offsets of each."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text."""
    for batch in batches:
        at, (_, offsets) = 0, utf8(batch.column(batch.schema.get_field_index(text)))
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of several texts.

    ``low``: all bytes, lower-cased; ``start``, ``end``: each word's place in them;
    ``first``: index of each text's first word, and the number of words at last.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.low = LOWER[flat]
        inside = table[self.low]
        edge = np.zeros(len(flat) + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes without anything between them, and their lengths."""
        return self.low[self.inside], self.end - self.start

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' bytes with a space before each, and where each starts and ends there."""
        length = self.end - self.start
        end = np.cumsum(length + 1)
        out = np.full(int(end[-1]) if len(end) else 0, 32, dtype=np.uint8)
        body = np.ones(len(out), dtype=bool)
        body[end - length - 1] = False
        out[body] = self.low[self.inside]
        return out, end - length, end


def encode(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers for words that lie one after another, and the distinct words by number."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    array = pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all 64-bit values, one to one."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
