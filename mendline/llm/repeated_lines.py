"""Repeated lines, dropped from all documents but one: Bloom filters name suspects, only those are shuffled.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at its ends and with ``A-Z`` lower-cased. A key of
``least_chars`` code points or more that at least ``least_docs`` documents hold is repeated: it loses all its lines, except in
the largest id that holds it. The other lines stay, joined by ``\\n``.

1. Every task puts the hashes of its keys, each once a document, into a field of bits, and those it already finds there into a second.
   Fields are joined piece by piece: a key of two tasks has its bits in the intersection of both first fields, and so
   comes into the second. The second thus holds every key that two documents have, and few others.
2. The second field (64 MB at most, whatever the table) goes to all tasks. Lines whose key it has are suspects; the SHA-256 of each
   goes on, once a document. Documents without suspects are done.
3. Suspects are counted by digest, combined before the shuffle: the true number of documents and the largest id.
4. Documents with repeated lines elsewhere lose them.

The size of the field follows the bytes of all texts, as a key has 40 bytes at least. Beyond about 20 GB of text it is full-sized and
more and more lines that occur once become suspects too: that costs their digests in the shuffle, and never changes a result.
Shuffled: compressed bits (about one or two bytes a line), digests of suspects, and texts of documents with suspects, each once.

Edge cases: a NULL or empty text is one empty line. A document is a row, so repeated rows count each; a NULL id is smaller than all others,
and a key that only rows without id hold keeps its lines. A very long text is worked on alone. Columns may have any names.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import MOST_BITS, column_of, field_bits, has, joined_field, pieces_of, places, positional, put, restored
from .store import count_of, stored
from .words import slices

WHITE = b" \t\n\v\f\r"


def keys_of(text: str, least_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the key of each that is long enough."""
    lines = text.encode().split(b"\n")
    keys = []
    for line in lines:
        key = line.strip(WHITE)
        enough = len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars)
        keys.append(key.lower() if enough else None)
    return lines, keys


def _once_and_twice(rows: Iterator[pa.RecordBatch], bits: int, least_chars: int) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for part in slices(rows):
        found = [xxhash.xxh3_64_intdigest(k) for t in part.column("text").to_pylist() for k in {*keys_of(t, least_chars)[1]} - {None}]
        hashes, counts = np.unique(np.array(found, dtype=np.uint64), return_counts=True)
        put(twice, places(hashes[(counts > 1) | has(once, hashes)], bits))
        put(once, places(hashes, bits))
    yield from pieces_of(once, twice)


def _suspects(rows: Iterator[pa.RecordBatch], field, least_chars: int) -> Iterator[pa.RecordBatch]:
    twice = field.value
    for part in slices(rows):
        texts, sizes, digests = part.column("text").to_pylist(), [], []
        per_text = []
        for t in texts:
            lines, keys = keys_of(t, least_chars)
            sizes.append(len(lines))
            per_text.append(list({*keys} - {None}))
        flat = [k for keys in per_text for k in keys]
        known = has(twice, np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))).tolist()
        at = 0
        for keys in per_text:
            digests.append([sha256(k).digest() for k, yes in zip(keys, known[at : at + len(keys)]) if yes])
            at += len(keys)
        columns = [part.column("row"), part.column("nr"), part.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "nr", "id", "n_lines", "suspects"])


def _without(rows: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    for part in slices(rows):
        kept, dropped = [], []
        for text, drop in zip(part.column("text").to_pylist(), part.column("drops").to_pylist()):
            if not drop:
                kept.append(text)
                dropped.append(0)
                continue
            lines, keys = keys_of(text, least_chars)
            gone = {*drop}
            stay = [x for x, k in zip(lines, keys) if k is None or sha256(k).digest() not in gone]
            kept.append(b"\n".join(stay).decode())
            dropped.append(len(lines) - len(stay))
        columns = [part.column("row"), part.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_lines", "n_dropped", "kept"])


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5, most_bits: int = MOST_BITS
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_lines`` (before dropping), ``n_dropped`` and ``kept`` (the text without repeated lines)."""
    plain, row = positional(docs)
    of_text = F.coalesce(column_of(docs, text), F.lit(""))
    texts = plain.select(row.alias("row"), F.monotonically_increasing_id().alias("nr"), column_of(docs, key).alias("id"), of_text.alias("text"))
    (size,) = count_of(plain.select(of_text.alias("text")), F.sum(F.octet_length("text")))
    bits = min(most_bits, field_bits(size // (least_chars + 1) + 1, 8))
    pieces = texts.select("text").mapInArrow(
        partial(_once_and_twice, bits=bits, least_chars=least_chars), "piece int, f0 binary, f1 binary"
    )
    field = plain.sparkSession.sparkContext.broadcast(joined_field(pieces, bits, twice=True))
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    marked = texts.mapInArrow(
        partial(_suspects, field=field, least_chars=least_chars),
        f"row {kinds['row']}, nr bigint, id {kinds['id']}, n_lines bigint, suspects array<binary>",
    )
    marked = stored(marked, "suspects")  # fixes the numbers
    held = marked.select("nr", "id", F.explode("suspects").alias("digest"))
    repeated = held.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    repeated = stored(repeated.where(F.col("n") >= least_docs).select("digest", "last"), "repeated")
    drops = held.join(repeated, "digest").where(~F.col("id").eqNullSafe(F.col("last")))
    drops = drops.groupBy("nr").agg(F.collect_list("digest").alias("drops"))
    own = F.coalesce(F.col("row").getField(f"c{docs.columns.index(text)}"), F.lit("")).alias("text")
    some = marked.where(F.size("suspects") > 0).select("nr", "row", "n_lines").join(drops, "nr", "left")
    some = some.select("row", "n_lines", own, "drops").mapInArrow(
        partial(_without, least_chars=least_chars), f"row {kinds['row']}, n_lines bigint, n_dropped bigint, kept string"
    )
    none = marked.where(F.size("suspects") == 0).select("row", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"), own.alias("kept"))
    return restored(some.unionByName(none), docs.columns, "n_lines", "n_dropped", "kept")
