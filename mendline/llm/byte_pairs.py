"""Byte-level BPE: ids of whole texts by ranked merges, and the bytes that ids stand for.

Texts are split by a pattern; each piece starts as single bytes and the adjacent pair with the lowest
rank is merged, the leftmost first, until no pair has a rank.

``fold_column`` is the operator as an expression of Spark's higher-order functions: a fold over an array of
binary pieces with a literal rank map. Ranks lie in a literal array of small maps by hash, because Spark searches
a map from front to back. It is right, but too slow for whole tables (see the README for
figures), so ``encode_texts`` runs the same merges in Arrow batches: the distinct words of a batch are encoded once and
kept by the worker (up to ``MOST_WORDS``, a cache), and a text's ids are joined from its words'.

Edge cases: NULL and empty texts have no ids. Special tokens in texts are ordinary text. Columns
are carried in a struct; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices

MOST_WORDS = 400_000
MAPS = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word. Long words use a heap, so the time is about linear in the length."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    scored = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while scored:
        best = min(scored)
        if best == _NONE:
            break
        at = scored.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scored[at]
        if at:
            scored[at - 1] = ranks.get(parts[at - 1] + parts[at], _NONE)
        if at < len(scored):
            scored[at] = ranks.get(parts[at] + parts[at + 1], _NONE)
    return [ranks[part] for part in parts]


_NONE = 1 << 40


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    from heapq import heapify, heappop, heappush

    end = list(range(1, len(word) + 1))  # of the part that starts at an index; 0 if none does
    before = list(range(-1, len(word) - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapify(heap)
    while heap:
        _, at, to = heappop(heap)
        middle = end[at]
        if not middle or middle >= len(word) or end[middle] != to:
            continue  # one of its two parts has been merged since
        end[at], end[middle] = to, 0
        if to < len(word):
            before[to] = at
            if (rank := ranks.get(word[at : end[to]])) is not None:
                heappush(heap, (rank, at, end[to]))
        if (left := before[at]) >= 0 and (rank := ranks.get(word[left:to])) is not None:
            heappush(heap, (rank, left, to))
    return [ranks[word[i : end[i]]] for i in range(len(word)) if end[i]]


class Coder:
    """Encodes and decodes texts, keeping the ids of words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.known: dict[str, bytes] = {}

    def __missing(self, word: str) -> bytes:
        ids = np.array(merge(word.encode(), self.ranks), dtype="<u4").tobytes()
        if len(self.known) >= MOST_WORDS:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        known = self.known
        try:
            return b"".join([known[word] for word in words])
        except KeyError:
            return b"".join([known.get(word) or self.__missing(word) for word in words])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[tuple[str, str], Coder] = {}


def encode_texts(docs: DataFrame, ranks: str, pattern: str, carry: Sequence[str] = ("doc_id",), ids: bool = False) -> DataFrame:
    """``row`` (struct of ``carry``), ``n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for.

    ``ranks`` is the place of a file of ranks, which every machine has; ``pattern`` splits texts.
    ``ids_sha256`` digests the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` the bytes
    that decoding them gives.
    """
    texts = docs.select(F.struct(*carry).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = f"row {texts.schema['row'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return texts.mapInArrow(partial(_encode, ranks=ranks, pattern=pattern, ids=ids), kind + ", ids array<int>" * ids)


def _encode(rows: Iterator[pa.RecordBatch], ranks: str, pattern: str, ids: bool) -> Iterator[pa.RecordBatch]:
    if (ranks, pattern) not in _CODERS:
        _CODERS[ranks, pattern] = Coder(read_ranks(ranks), pattern)
    coder = _CODERS[ranks, pattern]
    for part in slices(rows):
        n, coded, decoded, lists = [], [], [], []
        for text in part.column("text"):
            got = coder.encode(text.as_py())
            n.append(len(got) // 4)
            coded.append(hashlib.sha256(got).hexdigest())
            decoded.append(hashlib.sha256(coder.decode(got)).hexdigest())
            if ids:
                lists.append(np.frombuffer(got, "<u4").astype(np.int32))
        columns = [part.column("row"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            columns.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def fold_column(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word (binary) by Spark's higher-order functions alone."""
    maps: list[dict[bytes, int]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks.items():
        maps[zlib.crc32(piece) % MAPS][piece] = rank
    entry = lambda m: "map(" + ",".join(f"X'{k.hex()}',{v}" for k, v in m.items()) + ")" if m else "cast(map() as map<binary,int>)"
    table = F.expr("array(" + ",".join(map(entry, maps)) + ")")
    rank = lambda piece: F.element_at(F.element_at(table, (F.crc32(piece) % MAPS + 1).cast("int")), piece)
    single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def step(parts: Column, _: Column) -> Column:
        pair = F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.struct(rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))).alias("rank"), i.alias("at")),
        )
        best = F.array_min(F.filter(pair, lambda x: x["rank"].isNotNull()))
        joined = lambda at: F.concat(
            F.slice(parts, F.lit(1), at - 1),
            F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))),
            F.slice(parts, at + 2, F.size(parts)),
        )
        return F.when((F.size(parts) > 1) & best.isNotNull(), joined(best["at"])).otherwise(parts)

    merged = F.aggregate(F.sequence(F.lit(2), F.length(word)), single, step)
    parts = F.when(F.length(word) > 1, merged).when(F.length(word) == 1, F.array(word)).otherwise(F.array().cast("array<binary>"))
    return F.transform(parts, rank)


def decode_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: binary pieces from a literal array, put together."""
    pieces = {rank: piece for piece, rank in ranks.items()}
    table = F.expr("array(" + ",".join(f"X'{pieces.get(i, b'').hex()}'" for i in range(max(pieces, default=-1) + 1)) + ")")
    return F.aggregate(ids, F.lit(b""), lambda whole, i: F.concat(whole, F.element_at(table, (i + 1).cast("int"))))
