"""Near-duplicates by the Jaccard similarity of word shingles: SimHash finds crowds, the shingles decide within them.

Two texts are alike if their sets of ``SHINGLE`` (5) words in a row have a Jaccard similarity of ``LEAST`` (0.8) or more. What is sought is
membership in a component of alike texts, so pairs are never written: every step hands on a spanning forest of what it found.

1. Texts with equal sets are one class, named by a hash of the set.
2. Each class gets ``WIDTH`` SimHash fingerprints of 64 bits over its set, cut into blocks of ``KEY_BITS`` bits. A table holds the distances of every block of bits to
   ``PIVOTS`` reference blocks (pivots); the tuple of these distances is the join key of the block. Equal blocks have equal distances, so no pair that agrees on a block is lost;
   these twelve pivots tell all blocks apart, so a key holds no others. At similarity 0.8 the sets have a cosine of 0.889, a bit is equal with probability 0.848, and one
   of the 64 blocks with probability 0.992; at 0.85 it is 0.9994.
3. Within a key, pairs are first discarded by their distances to the pivots: on a block two classes differ in at least as many bits as their distances to any pivot do, so
   the largest such differences, summed over the blocks, may not pass ``RADIUS``. Of what is left, classes within ``RADIUS`` of the first 192 bits are near (the expected number is 29 with a deviation of 5 at similarity 0.8, and
   96 with 7 for unrelated texts). A key of few classes gives all such pairs; in a larger one a search grows each group from one member, compares only with those
   that no group has yet, and gives one link for each member. The first ``FIRST`` blocks go before: what they join counts as one afterwards.
4. Components of these links are crowds. Every two classes of a crowd are compared by their sets, whether or not they share a key:
   common shingles are counted by products of matrices for frequent ones and by runs of the sorted rest. A crowd beyond ``BLOCK_SETS`` classes or ``BLOCK_HASHES`` hashes
   is dealt out to blocks, and each pair of blocks is one group of rows. Only links of a spanning forest leave it.
5. Components of those links are the groups of alike texts.

Nothing is capped: how many classes a key or a crowd has decides how it is worked on, never what is found. Shuffled: a row of five numbers for each class and block
of bits, and the sets of classes in crowds, once for each block of their crowd. A component is joined by links, so its ends may be less alike than ``LEAST``. Growth:
pairs within a key that are looked at grow with the square of the number of unrelated classes over 2^``KEY_BITS``; the sets of a crowd are sent once for every ``BLOCK_SETS`` classes in it.

Edge cases: a text of fewer words than a shingle is one shingle; texts without words (NULL too) are equal. Very long texts are one set in a batch of their own. Rows without id
come after those with one; of rows that are equal in that, one stays. Repeated rows are equal texts. Columns may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import column_of, positional
from .pivots import components, shingle_hashes
from .store import stored
from .words import mixed, slices

SHINGLE = 5
LEAST = 0.8
WIDTH = 16
KEY_BITS = 16
#: Fingerprints that tell what is near, and the differing bits of theirs that are near.
SEEN = 3
RADIUS = 50
#: Blocks of bits that are joined before the others.
FIRST = 8
#: Reference blocks of bits, to which distances are kept.
PIVOTS = 12
#: A key of so many classes is compared pair by pair.
FEW = 32
#: Classes and hashes in a block of a crowd.
BLOCK_SETS = 4096
BLOCK_HASHES = 2 << 20
#: Shingles of more sets than this are counted by a product of matrices, so many at once.
FREQUENT = 64
SLAB = 2048
#: So many links (32 MB) are joined in one task.
LOCAL = 2_000_000

#: For each byte, its bits as eight bytes of one number: sums of up to 255 of them count all eight bits.
_SPREAD = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).reshape(-1)


def _pivot_table() -> tuple[np.ndarray, np.ndarray]:
    """For each block of bits, its distances to the pivots, and a number for the tuple of these."""
    drawn = [xxhash.xxh3_64_intdigest(f"pivot block {i}") & ((1 << KEY_BITS) - 1) for i in range(PIVOTS)]
    blocks = np.arange(1 << KEY_BITS, dtype=np.uint16)
    distances = np.bitwise_count(blocks[:, None] ^ np.array(drawn, dtype=np.uint16))
    packed = (distances.astype(np.uint64) << (np.uint64(5) * np.arange(PIVOTS, dtype=np.uint64))).sum(axis=1)
    return distances.astype(np.int8), np.unique(packed, return_inverse=True)[1].astype(np.int32)


DISTANCES, CELLS = _pivot_table()


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, n = shingle_hashes(texts, size)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(n)[:-1])] if len(n) else []


def prints_of(sets: list[np.ndarray], width: int) -> np.ndarray:
    """``width`` fingerprints of each set, a row each; zero for an empty set."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    out = np.zeros((len(sets), width), dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    hashes, sizes = np.concatenate(sets), sizes[filled]
    parts = -(-sizes // 255)
    first_part = np.cumsum(parts) - parts
    nth = np.arange(parts.sum()) - np.repeat(first_part, parts)
    start = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * nth
    votes = np.empty((len(filled), 64), dtype=np.int64)
    for j in range(width):
        each = mixed(hashes + np.uint64((0x9E3779B97F4A7C15 * j) % (1 << 64))).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            sums = np.add.reduceat(_SPREAD[each[:, byte]], start).view(np.uint8).reshape(-1, 8)
            votes[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(sums, first_part, axis=0, dtype=np.int64)
        major = np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little")
        out[filled, j] = np.ascontiguousarray(major).view(np.uint64).reshape(-1)
    return out


def _printed(rows: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[pa.RecordBatch]:
    for part in slices(rows):
        sets = shingle_sets(part.column("text"), size)
        name = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets))
        prints = [x.tobytes() for x in prints_of(sets, width)]
        columns = [part.column("row"), pa.array(name.view(np.int64)), pa.array(prints, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "bits", "prints"])


def _keys(rows: Iterator[pa.RecordBatch], width: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """A row for each of some blocks of each class: number of the block and of its distances to the pivots, the class's label, its first fingerprints."""
    for batch in rows:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            prints = np.frombuffer(b"".join(part.column("prints").to_pylist()), np.uint64).reshape(-1, width)
            blocks = CELLS[prints.view(np.uint16)[:, first:last]]
            key = blocks + (np.arange(first, min(last, first + blocks.shape[1]), dtype=np.int32) << KEY_BITS)
            label = part.column("label").to_numpy(zero_copy_only=False)
            again = lambda x: pa.array(np.repeat(x, blocks.shape[1]))  # noqa: B023, E731
            seen = [again(prints[:, i].view(np.int64)) for i in range(SEEN)]
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), again(label), *seen], names=["key", "label", "p", "q", "r"])


def _runs(rows: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Sorted rows as arrays that no key runs across."""
    held: list[list[np.ndarray]] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        now = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if held and cut == 0 and held[0][0][0] == now[0][0]:
            held.append(now)
            continue
        yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now])]
        held = [[x[cut:] for x in now]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _apart(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[i] ^ prints[j]).sum(axis=-1, dtype=np.int16)


def _may_be_near(near: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Whether the distances to the pivots (``near``: row, block, pivot) leave it open that two rows are within ``radius``; by the triangle inequality on each block."""
    return np.abs(near[i] - near[j]).max(axis=-1).sum(axis=-1, dtype=np.int16) <= radius


def _kept(prints: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within ``radius``: those that the pivots do not discard are compared bit by bit."""
    i, j = np.broadcast_arrays(i, j)
    kept = np.flatnonzero(_may_be_near(near, i, j, radius))
    return kept[_apart(prints, i[kept], j[kept]) <= radius]


def _near(rows: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links between labels that connect what is near within a key."""
    for key, labels, *seen in _runs(rows):
        prints = np.stack(seen, axis=1).view(np.uint64)
        near = DISTANCES[prints.view(np.uint16)]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(first, append=len(key))
        found = []
        few = np.repeat(sizes <= FEW, sizes)
        for d in range(1, int(sizes[sizes <= FEW].max(initial=0))):
            i = np.flatnonzero((key[d:] == key[:-d]) & few[d:] & (labels[d:] != labels[:-d]))
            i = i[_kept(prints, near, i, i + d, radius)]
            found.append((i, i + d))
        for at, n in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            found += [(at + i, at + j) for i, j in _grown(prints[at : at + n], near[at : at + n], radius)]
        if found:
            i, j = (np.concatenate(x) for x in zip(*found))
            low, high = np.minimum(labels[i], labels[j]), np.maximum(labels[i], labels[j])
            pairs = np.unique(np.stack([low, high], axis=1)[low < high], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _grown(prints: np.ndarray, coordinates: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the near pairs: each group grows from a member, and who has joined is not looked at again."""
    found, rest, waiting = [], np.arange(len(prints)), []
    while len(rest):
        if not waiting:
            waiting, rest = [int(rest[0])], rest[1:]
        some = np.array(waiting[-1:])
        waiting.pop()
        near = np.zeros(len(rest), dtype=bool)
        near[_kept(prints, coordinates, rest, some, radius)] = True
        if near.any():
            joined, rest = rest[near], rest[~near]
            found.append((np.repeat(some, len(joined)), joined))
            waiting += joined.tolist()
    return found


def _sets(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part in slices(rows):
        sets = [x.tobytes() for x in shingle_sets(part.column("text"), size)]
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.binary())], names=["row", "hashes"])


class _Forest:
    """Labels of things that get joined, and the joins that mattered."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, one: int, others: np.ndarray) -> None:
        own = self.label[one]
        met, example = np.unique(self.label[others], return_index=True)
        new = met != own
        if new.any():
            self.links += [(one, int(x)) for x in others[example[new]]]
            self.label[np.isin(self.label, met)] = own


def common(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many hashes each of the first ``left`` sets has in common with each of the others; with ``left`` 0, all with all."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, columns, off = (len(sets), len(sets), 0) if not left else (left, len(sets) - left, left)
    out = np.zeros((rows, columns), dtype=np.float32)
    often = np.flatnonzero(times > FREQUENT)
    nth = np.full(len(times), -1)
    nth[often] = np.arange(len(often))
    for at in range(0, len(often), SLAB):
        column = nth[code] - at
        here = (nth[code] >= at) & (column < SLAB)
        marks = np.zeros((len(sets), min(SLAB, len(often) - at)), dtype=np.float32)
        marks[owner[here], column[here]] = 1
        out += marks[:rows] @ marks[off:].T
    rare = (times[code] > 1) & (times[code] <= FREQUENT)
    order = np.argsort(code[rare], kind="stable")
    shingle, owner = code[rare][order], owner[rare][order]
    flat = out.reshape(-1)
    for d in range(1, int(times[times <= FREQUENT].max(initial=1))):
        i = np.flatnonzero(shingle[d:] == shingle[:-d])
        a, b = owner[i], owner[i + d]  # a < b, as owners of a shingle come in order
        if left:
            across = (a < left) & (b >= left)
            a, b = a[across], b[across] - left
        np.add.at(flat, a * columns + b, 1)
        if not left:
            np.add.at(flat, b * columns + a, 1)
    return out


def alike(sets: list[np.ndarray], left: int, least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets that are alike; with ``left``, of pairs of one of the first ``left`` and one of the others."""
    both = common(sets, left)
    sizes = np.array([len(x) for x in sets], dtype=np.float64)
    forest, off = _Forest(len(sets)), left
    for i in range(len(both)):
        shared = both[i].astype(np.float64)
        near = np.flatnonzero(shared >= least * (sizes[i] + sizes[off:] - shared)) + off
        near = near[near != i]
        if len(near):
            forest.join(i, near)
    return forest.links


def _linked(rows: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of each group of rows: the classes of one block of a crowd, or of two."""

    def each():
        for batch in rows:
            columns = [batch.column(name).to_pylist() for name in ("crowd", "i", "j", "block", "bits")]
            yield from zip(*columns, batch.column("hashes"))

    for (_, i, j), members in groupby(each(), lambda r: r[:3]):
        members = sorted(((b, bits, x) for *_, b, bits, x in members), key=lambda m: m[:2])
        left = sum(b == i for b, *_ in members) if i != j else 0
        if len(members) < 2 or (i != j and left in (0, len(members))):
            continue
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for *_, x in members]
        if found := alike(sets, left, least):
            a, b = (np.array([members[k][1] for k in side]) for side in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _united(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of few links: labels go down to the smallest reachable, halving the way each time."""
    whole = pa.Table.from_batches(list(rows), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    a, b = (whole.column(name).to_numpy() for name in ("a", "b"))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while (low := np.minimum(label[a], label[b])).tobytes() != np.maximum(label[a], label[b]).tobytes():
        for end in (a, b):
            np.minimum.at(label, label[end], low)
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def united(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge (``a``, ``b``), as by ``components``.

    ``LOCAL`` links at most, counted before, are joined in one task, as they take fewer bytes than a partition; more go through rounds of joins.
    """
    edges = stored(edges, "links")
    if edges.count() > LOCAL:
        return components(edges)
    return edges.repartition(1).mapInArrow(_united, "node bigint, root bigint")


def crowds(classes: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``bits, crowd`` of the classes (``bits, prints``) that are near others."""
    blocks = 64 * width // KEY_BITS

    def near(labelled, first, last):
        keys = labelled.mapInArrow(partial(_keys, width=width, first=first, last=last), "key int, label bigint, p bigint, q bigint, r bigint")
        found = keys.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_near, radius=radius), "a bigint, b bigint")
        return found.distinct()

    first = near(classes.select(F.col("bits").alias("label"), "prints"), 0, FIRST)
    joined = stored(united(first), "joined")
    labelled = classes.join(joined.withColumnRenamed("node", "bits"), "bits", "left")
    rest = near(labelled.select(F.coalesce("root", "bits").alias("label"), "prints"), FIRST, blocks)
    both = joined.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(rest)
    return united(both).select(F.col("node").alias("bits"), F.col("root").alias("crowd"))


def links(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Links ``a < b`` that connect what is alike among the classes (``bits, crowd, hashes``) of each crowd."""
    n_hashes = F.octet_length("hashes") / 8
    size = sets.groupBy("crowd").agg(F.greatest(F.ceil(F.sum(n_hashes) / BLOCK_HASHES), F.ceil(F.count("*") / BLOCK_SETS), F.lit(1)).cast("int").alias("blocks"))
    dealt = sets.join(size, "crowd").withColumn("block", F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "bits", "hashes")
    group = dealt.repartition("crowd", "i", "j").sortWithinPartitions("crowd", "i", "j")
    return group.mapInArrow(partial(_linked, least=least), "a bigint, b bigint")


def deduplicate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, width: int = WIDTH, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` without texts that are alike: of each component the row with the smallest id stays."""
    plain, row = positional(docs)
    texts = plain.select(
        F.struct(row.alias("own"), F.monotonically_increasing_id().alias("nr")).alias("row"), F.coalesce(column_of(docs, text), F.lit("")).alias("text")
    )
    kind = f"row {texts.schema['row'].dataType.simpleString()}, bits bigint, prints binary"
    prints = stored(texts.mapInArrow(partial(_printed, size=shingle, width=width), kind), "fingerprints")  # fixes the numbers
    own_key = F.col("row.own").getField(f"c{docs.columns.index(key)}")
    own = F.struct(own_key.isNull().alias("none"), own_key.alias("id"), F.col("row.nr").alias("nr"))
    classes = stored(prints.groupBy("bits").agg(F.min(own).alias("least"), F.min("prints").alias("prints")), "classes")
    members = stored(crowds(classes.select("bits", "prints"), width, radius), "crowds")
    chosen = classes.join(members, "bits").select(F.col("least.nr").alias("nr"), "crowd")
    own_text = F.coalesce(F.col("row.own").getField(f"c{docs.columns.index(text)}"), F.lit("")).alias("text")
    texts = prints.select(F.col("row.nr").alias("nr"), "bits", own_text).join(chosen, "nr").select(F.struct("bits", "crowd").alias("row"), "text")
    sets = texts.mapInArrow(partial(_sets, size=shingle), "row struct<bits: bigint, crowd: bigint>, hashes binary")
    sets = stored(sets.select("row.*", "hashes"), "shingles")
    roots = united(links(sets, least))
    held = classes.select("bits", "least").join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    stay = held.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.nr").alias("nr"))
    kept = prints.select(F.col("row.nr").alias("nr"), F.col("row.own").alias("own")).join(stay, "nr", "left_semi")
    return kept.select(*(F.col("own").getField(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))
