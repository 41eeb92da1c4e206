"""SimHash near-duplicates, with candidate pairs and discards from pivot distance tables.

Fingerprints have 64 bits; two link at ``radius`` (2) or fewer differing bits. Every distinct
fingerprint gets a row in a distance table: its Hamming distances to a fixed set of reference
fingerprints (pivots), kept apart by block of bits.

1. The bits are cut into ``BLOCKS`` blocks. Two differing bits leave at least ``BLOCKS - 2`` blocks
   untouched, and there all distances to all pivots are equal. So for each choice of ``BLOCKS - 2``
   blocks the distances on them are a join key (pivots of a block are chosen so that the
   distances fix its bits, which makes keys as selective as can be).
2. Of two fingerprints with equal keys, whole distances (sums over the blocks) to every pivot must differ by 2 at
   most, by the triangle inequality; others are discarded by the largest coordinate difference.
3. Survivors are verified by their differing bits.

A key shared by more than ``MOST_PER_KEY`` fingerprints is not joined with itself. Its members
meet at midpoints instead, exactly: two fingerprints are within 2 bits if and only if some
fingerprint is within 1 bit of both. Each member names itself and its 64 neighbours, and all that name the same
one link to the smallest of them; at most 65 can.

Components come from alternating large-star and small-star steps over these links, each written to the
shared scratch folder. Copies share a fingerprint and are never expanded into pairs.

Edge cases: a text without words has fingerprint zero, linked like any other; a text of one or
two words is one shingle. A NULL id keeps its row, but does not name a component unless nobody
else is in it. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import count_of, stored
from .words import NOT_SPACE, Words, slices, utf8

SHINGLE = 3
RADIUS = 2
BLOCKS = 5
MOST_PER_KEY = 48
SEED = 42


def fingerprints(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of ``carry``) and ``bits`` (the fingerprint as a signed 64-bit integer)."""
    texts = docs.select(F.struct(*carry).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_fingerprints, f"row {texts.schema['row'].dataType.simpleString()}, bits bigint")


def _fingerprints(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(rows):
        bits = simhash(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(bits.view(np.int64))], names=["row", "bits"])


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``size`` words of an Arrow column, text by text, and how many each text has."""
    words = Words(*utf8(texts), NOT_SPACE)
    n_words = np.diff(words.first)
    n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    joined, start, end = words.spaced()
    text = np.repeat(np.arange(len(texts)), n)
    ends = np.cumsum(n)
    head = words.first[:-1][text] + np.arange(len(text)) - (ends - n)[text]
    tail = np.minimum(head + size, words.first[1:][text]) - 1
    data = joined.tobytes()
    cut = map(data.__getitem__, map(slice, start[head].tolist(), end[tail].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(text)), n


def simhash(texts: pa.Array) -> np.ndarray:
    """The fingerprints of an Arrow column of texts, unsigned."""
    hashes, n = shingle_hashes(texts, SHINGLE)
    ends = np.cumsum(n)
    out = np.zeros(len(texts), dtype=np.uint64)
    filled = np.flatnonzero(n)
    if len(filled):
        votes = np.empty((len(filled), 64), dtype=np.int64)
        first = (ends - n)[filled]
        for byte in range(8):  # eight columns of bits at a time keep this small
            ones = np.unpackbits(((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            votes[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(ones, first, axis=0, dtype=np.int32)
        major = np.packbits(2 * votes > n[filled][:, None], axis=1, bitorder="little")
        out[filled] = np.ascontiguousarray(major).view(np.uint64).reshape(-1)
    return out


def _blocks() -> list[int]:
    """The masks of the blocks of bits."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def pivots() -> list[int]:
    """The reference fingerprints: zero, and for each place in a block the one with just that bit in every block.

    On a block the distance to a one-bit pivot less that to zero is 1 or -1 by the value of the bit,
    so the distances on a block tell its bits; random further pivots spread the whole distances.
    """
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    longest = max(b - a for a, b in zip(edges, edges[1:]))
    places = [sum(1 << (a + i) for a, b in zip(edges, edges[1:]) if a + i < b) for i in range(longest)]
    spread = [int.from_bytes(xxhash.xxh3_64_digest(f"pivot {i}"), "big") for i in range(8)]
    return [0, *places, *spread]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance_table(prints: DataFrame) -> DataFrame:
    """``bits``, and ``near``: for each block the distances on it to all pivots, a byte each."""
    near = [
        F.concat(*(_byte(F.bit_count(F.col("bits").bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask))))) for p in pivots()))
        for mask in _blocks()
    ]
    return prints.select("bits", F.array(*near).alias("near"))


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2, "0"))


def _coordinates_apart(a: str, b: str) -> Column:
    """Largest difference between the whole distances of two rows to any pivot."""
    whole = lambda side, p: F.bit_count(F.col(side).bitwiseXOR(F.lit(_signed(p))))
    return F.greatest(*(F.abs(whole(a, p) - whole(b, p)) for p in pivots()))


def links(prints: DataFrame) -> DataFrame:
    """Links ``a < b`` that connect all distinct fingerprints (column ``bits``) within ``RADIUS`` bits.

    Every link is a true one. Among members of an oversized key some true links are left out, but
    no connection is.
    """
    table = distance_table(prints)
    keys = table.select(
        "bits",
        F.explode(F.array(*(F.xxhash64(F.lit(i), *(F.col("near")[k] for k in c)) for i, c in enumerate(_choices())))).alias("key"),
    )
    keys = stored(keys, "pivot-keys")
    shared = keys.groupBy("key").count().where("count > 1")
    held = stored(keys.join(shared, "key"), "pivot-shared")
    few, many = held.where(F.col("count") <= MOST_PER_KEY), held.where(F.col("count") > MOST_PER_KEY)
    pairs = few.select("key", F.col("bits").alias("a")).join(few.select("key", F.col("bits").alias("b")), "key").where("a < b")
    close = (
        pairs.select("a", "b").distinct()
        .where(_coordinates_apart("a", "b") <= RADIUS)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    )
    flips = F.array(F.col("bits"), *(F.col("bits").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    middle = many.select("bits").distinct().select("bits", F.explode(flips).alias("middle"))
    least = middle.groupBy("middle").agg(F.min("bits").alias("a"), F.count("*").alias("n")).where("n > 1")
    through = middle.join(least, "middle").where("bits > a").select("a", F.col("bits").alias("b"))
    return close.unionByName(through).distinct()


def _choices() -> list[tuple[int, ...]]:
    return list(combinations(range(BLOCKS), BLOCKS - RADIUS))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge (``a``, ``b``); the root is the smallest node reachable."""
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "star")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.least("a", "low").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(least, "b")
        small = small.select(F.col("low").alias("a"), "b").unionAll(small.where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b")))
        edges = stored(small.distinct(), "star")
        now = count_of(edges, F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if now == before:
            roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionAll(edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))
        before = now


def near_duplicates(docs: DataFrame, carry: Sequence[str] = ("doc_id",), key: str = "doc_id") -> DataFrame:
    """``row`` (struct of ``carry``, which has ``key``), ``fingerprint`` (hex), ``component_id``, ``n_copies``
    (rows with the same fingerprint).
    """
    prints = stored(fingerprints(docs, carry), "fingerprints")
    classes = stored(prints.groupBy("bits").agg(F.min(f"row.{key}").alias("id"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("bits")))
    held = classes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    named = held.groupBy("root").agg(F.min("id").alias("component_id"))
    named = held.join(named, "root").select("bits", "component_id", F.col("n").alias("n_copies"))
    return prints.join(named, "bits").select(
        "row", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "n_copies"
    )


def deduplicate(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Rows without id come after those with one; of rows that are equal in that, one stays.
    """
    numbered = docs.withColumn("__nr", F.monotonically_increasing_id())
    prints = stored(fingerprints(numbered, numbered.columns), "fingerprints")  # fixes the numbers
    own = F.struct(F.col(f"row.{key}").isNull().alias("none"), F.col(f"row.{key}").alias("id"), F.col("row.__nr").alias("nr"))
    classes = stored(prints.groupBy("bits").agg(F.min(own).alias("least")), "classes")
    return least_rows(prints, classes, links(classes.select("bits")), docs.columns)


def least_rows(prints: DataFrame, classes: DataFrame, linked: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns ``names`` of the row ``least`` of each component of ``classes`` (``bits, least``) under links ``a, b``."""
    roots = components(linked)
    held = classes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    stay = held.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.nr").alias("nr"))
    kept = prints.withColumn("nr", F.col("row.__nr")).join(stay, "nr", "left_semi")
    return kept.select(*(F.col("row")[c].alias(c) for c in names))
