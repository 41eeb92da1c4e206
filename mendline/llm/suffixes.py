"""Benchmark decontamination with suffix arrays over the training texts.

The texts are cut into shards of a few megabytes, each inside one task. A shard numbers its
words by the words of the test items (0 for a word that no item has), drops stretches of known
words too short for a window (``longest_matches`` keeps them), and sorts all remaining suffixes by prefix doubling. Every suffix of
every test item is then looked up by binary search, which gives its longest verbatim match in the
shard and where that is; suffixes that match a whole window give all their occurrences as one
range of the suffix array.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window is
``window`` consecutive words of an item; a shorter item is one window. Words are compared
exactly, not by hash. Nothing is shuffled.

Test items come in blocks of at most ``BLOCK_WORDS`` words (or one longer item), each searched in a
pass of its own over the texts, so what is broadcast has a fixed bound. The usual test set is one block; with more
blocks the matches of a row are brought together by a row number, contaminated rows only.

Edge cases: NULL and empty texts have no words and are never hit; items without words have no
windows; a NULL item id is listed as an empty text, repeated item ids are listed once. Repeated
rows give repeated rows. Columns of the texts are carried in a struct, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import ALNUM, Words, encode, slices, utf8

BLOCK_WORDS = 400_000

_FOUND = "n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def match_items(docs: DataFrame, items: DataFrame, carry: Sequence[str] = ("doc_id",), window: int = 10) -> DataFrame:
    """Per text: ``row`` (struct of ``carry``), ``n_words, n_hit, n_items, items_sha256, contaminated``
    and the hit stretches of words (``starts``, ``ends``, ends exclusive).
    """
    texts = docs.select(F.struct(*carry).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = _blocks(items, window)
    kind = f"row {texts.schema['row'].dataType.simpleString()}"
    final = f"{kind}, {_FOUND}, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    first = next(blocks, TestBlock([], window))
    second = next(blocks, None)
    spark = docs.sparkSession
    if second is None:
        block = spark.sparkContext.broadcast(first)
        return texts.mapInArrow(partial(_search, block=block, finish=True), final)
    rows = stored(texts.withColumn("nr", F.monotonically_increasing_id()), "items-texts")
    found = []
    for block in _chain(first, second, blocks):
        one = rows.select(F.struct("nr").alias("row"), "text")
        shared = spark.sparkContext.broadcast(block)
        found.append(stored(one.mapInArrow(partial(_search, block=shared, finish=False), f"row struct<nr:bigint>, {_FOUND}"), "items-found"))
        shared.destroy()
    every = reduce(DataFrame.unionAll, found).groupBy(F.col("row.nr").alias("nr"))
    merged = every.agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return rows.select("nr", "row").join(merged, "nr").drop("nr").mapInArrow(_finish_all, final)


def longest_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", window: int = 10) -> DataFrame:
    """The longest verbatim match of every suffix of every item, and a place where it is:
    ``item_id, item_word, length, doc_id, word`` (of equal matches that with the smallest id and word; NULL is the least id).

    Matches of any length count, down to one word; ``window`` decides nothing here. Of repeated item ids the longest match of any is told.
    Items and texts without words give no rows.
    """
    texts = docs.select(F.struct(F.col(key).alias("id")).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = texts.schema["row"].dataType["id"].dataType.simpleString()
    out = f"item_id string, item_word bigint, length bigint, doc_id {kind}, word bigint"
    parts = []
    for block in _blocks(items, window):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        parts.append(texts.mapInArrow(partial(_longest, block=shared), out))
    if not parts:
        return docs.sparkSession.createDataFrame([], out)
    every = reduce(DataFrame.unionAll, parts)
    best = F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "word")).alias("best")
    return (
        every.groupBy("item_id", "item_word").agg(best)
        .select("item_id", "item_word", (-F.col("best.less")).alias("length"), "best.doc_id", "best.word")
    )


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def _blocks(items: DataFrame, window: int) -> Iterator[TestBlock]:
    """Blocks of items with words, of bounded size, one at a time on the driver."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        words = words_of(row[1])
        if not words:
            continue
        if held and size + len(words) > BLOCK_WORDS:
            yield TestBlock(held, window)
            held, size = [], 0
        held.append((row[0], words))
        size += len(words)
    if held:
        yield TestBlock(held, window)


def words_of(text: str | None) -> list[bytes]:
    words = Words(*utf8(pa.array([text], pa.string())), ALNUM)
    return [bytes(words.low[a:b]) for a, b in zip(words.start, words.end)]


class TestBlock:
    """Test items as one array of word numbers (from 1; 0 ends an item), and their suffixes."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        numbers: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        lengths = [len(words) for _, words in items]
        self.words = np.zeros(sum(lengths) + len(items) + 1, dtype=np.int64)
        starts = []
        at = 0
        for _, words in items:
            starts.append(at)
            self.words[at : at + len(words)] = [numbers.setdefault(w, len(numbers) + 1) for w in words]
            at += len(words) + 1
        self.vocabulary = pa.array(list(numbers), pa.large_binary())
        self.suffix = np.flatnonzero(self.words)
        self.item = np.repeat(np.arange(len(items)), lengths)
        self.offset = self.suffix - np.array(starts, dtype=np.int64)[self.item] if items else self.suffix
        whole = np.array(lengths, dtype=np.int64)[self.item] if items else self.suffix
        self.window = np.minimum(window, whole)
        self.is_window = self.offset + self.window <= whole
        self.shortest = int(self.window.min()) if items else 1
        self.longest = max(lengths, default=0)


class Shard:
    """The suffix array of the texts of one batch, but for stretches of known words under ``shortest``."""

    def __init__(self, texts: pa.Array, block: TestBlock, shortest: int = 1):
        words = Words(*utf8(texts), ALNUM)
        self.n_words = np.diff(words.first)
        self.first = words.first[:-1] + np.arange(len(texts))  # of each text, with a gap after each
        self.words = np.zeros(len(words) + len(texts) + block.longest + 1, dtype=np.int64)
        if len(words) and len(block.vocabulary):
            number, distinct = encode(*words.packed())
            known = pc.fill_null(pc.index_in(distinct, value_set=block.vocabulary), -1).to_numpy() + 1
            self.words[np.arange(len(words)) + np.repeat(np.arange(len(texts)), self.n_words)] = known[number]
            self._drop_short(shortest)
        self.order = self._sorted(block.longest)

    def _drop_short(self, shortest: int) -> None:
        """Sets words to 0 that stand in stretches of known words too short for any window."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (self.words > 0).astype(np.int8), [0]])))
        start, end = edge[::2], edge[1::2]
        short = end - start < shortest
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        change[start[short]] += 1
        change[end[short]] -= 1
        self.words[np.cumsum(change)[:-1] > 0] = 0

    def _sorted(self, depth: int) -> np.ndarray:
        """Places of all suffixes by their first ``depth`` words, by prefix doubling."""
        place = np.flatnonzero(self.words)
        rank = np.zeros(len(self.words) + depth + 1, dtype=np.int64)
        rank[: len(self.words)] = self.words
        reach = 1
        while reach < depth and len(place):
            key = rank[place] * (rank.max() + 1) + rank[place + reach]
            distinct, new = np.unique(key, return_inverse=True)
            rank[place] = new + 1
            reach *= 2
            if len(distinct) == len(place):
                break
        return place[np.argsort(rank[place], kind="stable")]

    def _compare(self, block: TestBlock, suffix: np.ndarray, place: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in common (``limit`` at most), and whether the shard's suffix sorts before the item's."""
        common, before = np.zeros(len(suffix), dtype=np.int64), np.zeros(len(suffix), dtype=bool)
        left = np.arange(len(suffix))
        depth = 0
        while len(left := left[depth < limit[left]]):
            a, b = self.words[place[left] + depth], block.words[suffix[left] + depth]
            before[left] = a < b
            left = left[(a == b) & (a > 0)]
            depth += 1
            common[left] = depth
        before[common >= limit] = False
        return common, before

    def _bisect(self, block: TestBlock, suffix: np.ndarray, limit: np.ndarray, right: bool = False) -> np.ndarray:
        """Where each suffix, cut to ``limit`` words, stands in the suffix array; behind equals if ``right``."""
        low, high = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(self.order))
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            common, before = self._compare(block, suffix[open_], self.order[middle], limit[open_])
            if right:
                before |= common >= limit[open_]
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
        return low

    def longest(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """Of every suffix of the items: words of the longest match, and its place (-1: none)."""
        length, place = np.zeros(len(block.suffix), dtype=np.int64), np.full(len(block.suffix), -1)
        if not len(self.order):
            return length, place
        limit = np.full(len(block.suffix), block.longest)
        at = self._bisect(block, block.suffix, limit)
        for side in (at - 1, at):
            fits = np.flatnonzero((side >= 0) & (side < len(self.order)))
            common, _ = self._compare(block, block.suffix[fits], self.order[side[fits]], limit[fits])
            better = common > length[fits]
            length[fits[better]] = common[better]
            place[fits[better]] = self.order[side[fits[better]]]
        return length, place

    def windows(self, block: TestBlock, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that start with a window found here, and the range of its occurrences."""
        hit = np.flatnonzero(block.is_window & (length >= block.window))
        suffix, limit = block.suffix[hit], block.window[hit]
        return hit, self._bisect(block, suffix, limit), self._bisect(block, suffix, limit, right=True)

    def first_places(self, block: TestBlock, found: np.ndarray, length: np.ndarray, ids: pa.Array) -> np.ndarray:
        """Of the item suffixes ``found``, that place of their first ``length`` words which has the least id, then the least word.

        Suffixes with equal ranges of the suffix array share one look at it.
        """
        suffix, limit = block.suffix[found], length[found]
        ends = np.stack([self._bisect(block, suffix, limit), self._bisect(block, suffix, limit, right=True)], axis=1)
        ranges, which = np.unique(ends, axis=0, return_inverse=True)
        if not len(ranges):
            return np.zeros(0, dtype=np.int64)
        text = self.text_of(self.order)
        rank = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        word = self.order - self.first[text]
        by_id = np.lexsort([word, rank[text]])
        standing = np.empty(len(by_id) + 1, dtype=np.int64)
        standing[by_id], standing[-1] = np.arange(len(by_id)), len(by_id)
        least = np.minimum.reduceat(standing, ranges.ravel())[::2]
        return self.order[by_id[least]][which.ravel()]

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


def _search(rows: Iterator[pa.RecordBatch], block, finish: bool) -> Iterator[pa.RecordBatch]:
    block = block.value
    for part in slices(rows):
        found = _matches(Shard(part.column("text"), block, block.shortest), block)
        columns = [part.column("row"), *(pa.array(x, t) for x, t in zip(found, _TYPES))]
        yield _finished(columns) if finish else pa.RecordBatch.from_arrays(columns, names=_NAMES)


_NAMES = ["row", "n_words", "starts", "ends", "items"]
_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]


def _matches(shard: Shard, block: TestBlock) -> tuple[list, ...]:
    """Per text: words, starts and ends of hit stretches, and items."""
    size = len(shard.n_words)
    length, _ = shard.longest(block)
    hit, low, high = shard.windows(block, length)
    change = np.zeros(len(shard.words) + 1, dtype=np.int64)
    items: list[set] = [set() for _ in range(size)]
    same: dict[tuple[int, int, int], set[str]] = {}
    for j, a, b in zip(hit, low, high):  # equal windows of several items have one range
        same.setdefault((int(a), int(b), int(block.window[j])), set()).add(block.names[block.item[j]])
    for (a, b, words), names in same.items():
        place = shard.order[a:b]
        np.add.at(change, place, 1)
        np.add.at(change, place + words, -1)
        for text in np.unique(shard.text_of(place)):
            items[text] |= names
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    text = shard.text_of(start)
    cut = np.searchsorted(text, np.arange(size + 1))
    spans = [(start[a:b] - shard.first[i], end[a:b] - shard.first[i]) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
    return shard.n_words, [a for a, _ in spans], [b for _, b in spans], [sorted(x) for x in items]


def _finished(columns: list[pa.Array]) -> pa.RecordBatch:
    """Adds what is derived from the matches."""
    n_hit = [sum(b) - sum(a) for a, b in zip(columns[2].to_pylist(), columns[3].to_pylist())]
    items = columns[4].to_pylist()
    derived = [
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
        pa.array([x > 0 for x in n_hit], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays([*columns, *derived], names=[*_NAMES, "n_hit", "n_items", "items_sha256", "contaminated"])


def _finish_all(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins stretches that several blocks have found."""
    for part in rows:
        starts, ends = [], []
        for a, b in zip(part.column("starts").to_pylist(), part.column("ends").to_pylist()):
            spans: list[list[int]] = []
            for start, end in sorted(zip(a, b)):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            starts.append([x for x, _ in spans])
            ends.append([x for _, x in spans])
        columns = [part.column(name) for name in _NAMES]
        columns[2:4] = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
        yield _finished(columns)


def _longest(rows: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    block = block.value
    for part in slices(rows):
        shard = Shard(part.column("text"), block)
        length, _ = shard.longest(block)
        found = np.flatnonzero(length)
        ids = part.column("row").field(0)
        place = shard.first_places(block, found, length, ids)
        text = shard.text_of(place)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block.names[i] for i in block.item[found]], pa.string()),
                pa.array(block.offset[found]),
                pa.array(length[found]),
                ids.take(pa.array(text)),
                pa.array(place - shard.first[text]),
            ],
            names=["item_id", "item_word", "length", "doc_id", "word"],
        )
