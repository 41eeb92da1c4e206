"""The trie of all prefixes of conversations, from matrices of turn ids sorted shard by shard.

``rebuilt`` makes each conversation a list of turn ids (the first 16 bytes of a SHA-256 of role and text) and the code points of each text.
``prefix_nodes`` finds all distinct prefixes:

1. Conversations are dealt to shards by ranges of (list of ids, conversation), so a shard holds neighbours, and a list that very many
   share is spread over shards.
2. A shard numbers its ids in order and fills padded matrices, ``COLUMNS`` at a time for conversations that are that long. ``numpy.lexsort`` orders the rows. A
   cell that differs from the one above marks a change, changes are OR-accumulated along the row, and what they mark at a depth are the starts of
   that depth's nodes. ``reduceat`` over the starts gives members and smallest ids; sums over subtrees go up depth by depth.
3. Only nodes of a shard's first and last conversation can go on in other shards. Their figures for the shard, two paths of a shard, are
   recombined by the same masks over a matrix of all paths in the order of the shards.
4. Ids of conversations that end in such a node are hashed as a stream of pieces, shard by shard.

Shuffled: ids and sizes of turns, never texts. In one task: all turns of one conversation, 24 bytes each; a shard; two paths of every shard. SHA-256
takes its input in order, so the decimal ids that end in one node go through one task, as a stream.

Edge cases: a NULL role or text is empty; rows without conversation id belong to no conversation. A NULL turn comes first;
turns with equal numbers go by the digest of role and text, so repeated rows follow each other. A conversation may be left without turns, and is then a
member of the root only. Very long texts are read once, for their digest. Other columns are not read, whatever their names. An empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import column_of, larger, positional
from .store import count_of, stored

#: Columns of a matrix.
COLUMNS = 64
#: Turns in a shard, about.
SHARD_TURNS = 1_000_000
#: Ids in one piece of a stream.
PIECE_IDS = 100_000
#: Rows of a batch that is sent back.
SENT = 50_000


def rebuilt(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 100, heads: int = 6
) -> DataFrame:
    """``conv_id, turns, points``: the ids and code points of the turns of every conversation after rebuilding.

    A conversation ``c`` gets the first ``h`` turns of ``c - c % group``, ``h`` being crc32 of its decimal id modulo ``heads``,
    instead of its own first ``h``.
    """
    plain, _ = positional(conversations)
    col = partial(column_of, conversations)
    who, what = (F.coalesce(col(name), F.lit("")) for name in (role, text))
    digest = F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256)
    turns = plain.select(
        col(conv).alias("conv_id"), F.struct(col(turn).alias("turn"), F.substring(F.unhex(digest), 1, 16).alias("id"), F.char_length(what).alias("points")).alias("t")
    ).where("conv_id IS NOT NULL")
    own = stored(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")), "own-turns")
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("first"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    joined = joined.select("conv_id", "own", F.coalesce("first", F.array().cast(own.schema["own"].dataType)).alias("first"), h.alias("h"))
    whole = joined.select("conv_id", F.expr("concat(slice(first, 1, h), slice(own, h + 1, greatest(size(own) - h, 0)))").alias("t"))
    return whole.select("conv_id", F.col("t.id").alias("turns"), F.col("t.points").alias("points"))


class Rows:
    """Lists of ids (numbers above 0, in ``ids`` one after another), and matrices of them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes.astype(np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.longest = int(sizes.max(initial=0))

    def matrix(self, rows: np.ndarray, at: int) -> np.ndarray:
        """Columns from ``at`` of the rows; 0 beyond the end of a row."""
        width = min(COLUMNS, self.longest - at)
        there = np.clip(self.sizes[rows] - at, 0, width)
        row = np.repeat(np.arange(len(rows)), there)
        column = np.arange(len(row)) - np.repeat(np.cumsum(there) - there, there)
        out = np.zeros((len(rows), width), dtype=np.int64)
        out[row, column] = self.ids[self.start[rows][row] + at + column]
        return out

    def order(self) -> np.ndarray:
        """The rows in order of their lists, equal ones as they come: the last columns are sorted first."""
        order = np.zeros(0, dtype=np.int64)
        for at in reversed(range(0, max(self.longest, 1), COLUMNS)):
            shorter = np.flatnonzero((self.sizes <= at + COLUMNS) & ((self.sizes > at) | (at == 0)))
            order = np.concatenate([shorter, order])
            if self.longest:
                order = order[np.lexsort(self.matrix(order, at).T[::-1])]
        return order

    def depths(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of ordered rows, for each depth from 1: the rows that reach it, and where among them nodes start."""
        changed = np.zeros(len(self.sizes), dtype=bool)
        for at in range(0, self.longest, COLUMNS):
            rows = np.flatnonzero(self.sizes > at)
            cells = self.matrix(rows, at)
            change = np.ones(cells.shape, dtype=bool)
            change[1:] = cells[1:] != cells[:-1]
            change[1:, 0] |= changed[rows[1:]] | (np.diff(rows) > 1)  # a shorter row between two: they part before
            np.logical_or.accumulate(change, axis=1, out=change)
            changed[rows] = change[:, -1]
            for j in range(cells.shape[1]):
                there = cells[:, j] > 0
                yield rows[there], np.flatnonzero(change[there, j])


def _walk(rows: Rows, merge) -> list[dict]:
    """The nodes of each depth from 0: ``rows``, ``starts``, ``above`` (the parent's number at its depth), and what ``merge(depth, rows, starts)`` adds."""
    n = len(rows.sizes)
    node = np.zeros(n, dtype=np.int64)
    found = [{"rows": np.arange(n), "starts": np.zeros(1, np.int64), "above": np.zeros(1, np.int64)}]
    for reach, starts in rows.depths():
        above = node[reach[starts]]
        node[reach] = np.cumsum(np.isin(np.arange(len(reach)), starts)) - 1
        found.append({"rows": reach, "starts": starts, "above": above})
    for depth, x in enumerate(found):
        x |= merge(depth, x["rows"], x["starts"])
    return found


_PATH = ("turns", "points", "n_convs", "least", "children", "leaves", "saved")
_KIND = (
    "kind int, conv_id bigint, depth bigint, parent_conv_id bigint, shard int, side int, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, key binary, piece int, path struct<turns: array<binary>, points: array<bigint>, n_convs: array<bigint>, "
    "least: array<bigint>, children: array<bigint>, leaves: array<bigint>, saved: array<bigint>>"
)
_NAMES = ["kind", "conv_id", "depth", "parent_conv_id", "shard", "side", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key", "piece", "path"]
_TYPES = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.int32()]
_PATH_TYPE = pa.struct([("turns", pa.list_(pa.binary())), *((name, pa.list_(pa.int64())) for name in _PATH[1:])])
NODE, PATH, PIECE = 0, 1, 2


def _batch(n: int, **columns) -> pa.RecordBatch:
    made = []
    for name, kind in zip(_NAMES, [*_TYPES, _PATH_TYPE]):
        x = columns.get(name)
        if x is None:
            made.append(pa.nulls(n, kind))
        elif isinstance(x, int):
            made.append(pa.array(np.full(n, x), kind))
        else:
            made.append(x if isinstance(x, pa.Array) else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(made, names=_NAMES)


def _listed(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes; two paths of nodes that may go on elsewhere; ids that end in those."""
    whole = list(larger(batches, 1 << 62))
    if not whole or not whole[0].num_rows:
        return
    shard, data = TaskContext.get().partitionId(), whole[0]
    conv = data.column("conv_id").to_numpy(zero_copy_only=False)
    sizes = np.diff(data.column("turns").offsets.to_numpy())
    digests = np.frombuffer(b"".join(data.column("turns").flatten().to_pylist()), "S16")
    points = data.column("points").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    distinct, ids = np.unique(digests, return_inverse=True)
    by_conv = np.argsort(conv, kind="stable")
    unsorted = Rows(ids + 1, sizes)
    starts = unsorted.start
    first = Rows(*_taken(ids + 1, starts, sizes, by_conv))
    order = by_conv[first.order()]
    conv, sizes = conv[order], sizes[order]
    place = starts[order]
    rows = Rows(*_taken(ids + 1, starts, unsorted.sizes, order))

    def merge(depth, reach, starts_at):
        some = reach[starts_at]
        return {
            "n": np.diff(starts_at, append=len(reach)),
            "least": np.minimum.reduceat(conv[reach], starts_at),
            "ends": np.add.reduceat((sizes[reach] == depth).astype(np.int64), starts_at),
            "points": points[place[some] + depth - 1] if depth else np.zeros(1, np.int64),
        }

    found = _walk(rows, merge)
    last_row, below = len(conv) - 1, None
    for depth in range(len(found) - 1, -1, -1):
        x = found[depth]
        n = len(x["starts"])
        x |= {name: np.zeros(n, dtype=np.int64) for name in ("children", "leaves", "saved")}
        x["edge"] = np.zeros(n, dtype=bool)
        x["edge"][[i for i, row in ((0, 0), (-1, last_row)) if x["rows"][i] == row]] = True
        if below is not None:
            inner = ~below["edge"]
            for name, values in (("children", np.ones(len(inner), np.int64)), ("leaves", below["leaves"]), ("saved", below["saved"])):
                np.add.at(x[name], below["above"][inner], values[inner])
        inner = ~x["edge"]
        x["saved"][inner] += ((x["n"] - 1) * x["points"])[inner]
        x["leaves"][inner & (x["children"] == 0)] = 1
        below = x
    # An edge node is on the path of the first row, or else of the last.
    paths = [{name: [] for name in _PATH} for _ in range(2)]
    keys = [sha256(), sha256()]
    shared = True
    for depth, x in enumerate(found):
        here = [bool(len(x["rows"])) and x["rows"][i] == row for i, row in ((0, 0), (-1, last_row))]
        shared = shared and all(here) and len(x["starts"]) == 1
        x["side"] = np.where(np.arange(len(x["starts"])) == 0, 0, 1) if here[0] else np.ones(len(x["starts"]), np.int64)
        for side, (i, row) in enumerate(((0, 0), (-1, last_row))):
            if not here[side]:
                continue
            path, turn = paths[side], digests_at(digests, place[row] + depth - 1) if depth else b""
            keys[side].update(turn)
            own = side == 0 or not shared  # what both paths have counts for the first
            path["turns"].append(turn)
            path["points"].append(int(x["points"][i]))
            path["least"].append(int(x["least"][i]))
            for name, of in (("n_convs", "n"), ("children", "children"), ("leaves", "leaves"), ("saved", "saved")):
                path[name].append(int(x[of][i]) if own else 0)
            if own and x["ends"][i]:
                start = int(x["starts"][i])
                ending = conv[x["rows"][start : start + int(x["ends"][i])]]
                for k, at in enumerate(range(0, len(ending), PIECE_IDS)):
                    text = _listed(ending[at : at + PIECE_IDS])
                    yield _batch(1, kind=PIECE, shard=shard, key=[keys[side].digest()], piece=k, ends_sha256=[text])
    yield _batch(2, kind=PATH, shard=shard, side=[0, 1], path=pa.array(paths, _PATH_TYPE))
    for depth in range(1, len(found)):
        x, up = found[depth], found[depth - 1]
        inner = np.flatnonzero(~x["edge"])
        for at in range(0, len(inner), SENT):
            some = inner[at : at + SENT]
            begin, ends = x["starts"][some], x["ends"][some]
            hashed = [sha256(_listed(conv[x["rows"][a : a + n]]).encode()).hexdigest() for a, n in zip(begin.tolist(), ends.tolist())]
            above = x["above"][some]
            open_above = up["edge"][above]
            yield _batch(
                len(some), kind=NODE, conv_id=x["least"][some], depth=depth, n_convs=x["n"][some], n_children=x["children"][some],
                n_leaves=x["leaves"][some], saved_tokens=x["saved"][some], ends_sha256=hashed, shard=shard,
                parent_conv_id=pa.array(up["least"][above], pa.int64(), mask=open_above),
                side=pa.array(up["side"][above], pa.int32(), mask=~open_above),
            )


def digests_at(digests: np.ndarray, i: int) -> bytes:
    return digests[i : i + 1].tobytes()


def _taken(ids: np.ndarray, start: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ids in another order."""
    some = sizes[order]
    at = np.arange(some.sum()) + np.repeat(start[order] - (np.cumsum(some) - some), some)
    return ids[at], some


def _recombined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all paths, and for each place of a path (``PATH``) the smallest id of its node."""
    whole = list(larger(batches, 1 << 62))
    if not whole or not whole[0].num_rows:
        return
    records = sorted(whole[0].to_pylist(), key=lambda r: (r["shard"], r["side"]))
    paths = [r["path"] for r in records]
    digests = np.array([t for p in paths for t in p["turns"][1:]], dtype="S16")
    _, ids = np.unique(digests, return_inverse=True)
    sizes = np.array([len(p["turns"]) - 1 for p in paths])
    flat = {name: np.array([v for p in paths for v in p[name]], dtype=np.int64) for name in _PATH[1:]}
    start = np.cumsum(sizes + 1) - sizes - 1

    def merge(depth, reach, starts_at):
        at = start[reach] + depth
        sums = {name: np.add.reduceat(flat[name][at], starts_at) for name in ("n_convs", "children", "leaves", "saved")}
        return sums | {"least": np.minimum.reduceat(flat["least"][at], starts_at), "points": flat["points"][at][starts_at]}

    found = _walk(Rows(ids + 1, sizes), merge)
    below = None
    for x in reversed(found):
        if below is not None:
            for name, values in (("children", np.ones(len(below["starts"]), np.int64)), ("leaves", below["leaves"]), ("saved", below["saved"])):
                np.add.at(x[name], below["above"], values)
        x["saved"] += (x["n_convs"] - 1) * x["points"]
        x["leaves"][x["children"] == 0] = 1
        below = x
    keys = [sha256() for _ in paths]
    for depth, x in enumerate(found):
        heads = x["rows"][x["starts"]]
        node = np.repeat(np.arange(len(heads)), np.diff(x["starts"], append=len(x["rows"])))
        names = []
        for row in x["rows"].tolist():
            keys[row].update(paths[row]["turns"][depth])
        for row in heads.tolist():
            names.append(keys[row].digest())
        parents = pa.nulls(len(heads), pa.int64()) if not depth else pa.array(found[depth - 1]["least"][x["above"]])
        yield _batch(
            len(heads), kind=NODE, conv_id=x["least"], depth=depth, parent_conv_id=parents, n_convs=x["n_convs"], n_children=x["children"],
            n_leaves=x["leaves"], saved_tokens=x["saved"], key=names,
        )
        of = [records[row] for row in x["rows"].tolist()]
        yield _batch(len(of), kind=PATH, conv_id=x["least"][node], depth=depth, shard=[r["shard"] for r in of], side=[r["side"] for r in of])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 of the sorted pieces of each key, joined by commas."""
    now, state = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            if key == now:
                state.update(b",")
            else:
                if state:
                    yield out()
                now, state = key, sha256()
            state.update(text.as_py().encode())
    if state:
        yield out()


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations`` (``conv_id, turns, points``, ids distinct).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    spark = conversations.sparkSession
    held = stored(conversations, "conversations")
    (turns,) = count_of(held, F.sum(F.size("turns") + 1))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // SHARD_TURNS + 1)
    parts = stored(held.repartitionByRange(n, "turns", "conv_id").mapInArrow(_shard, _KIND), "shards")
    paths = parts.where(F.col("kind") == PATH).select("shard", "side", "path").repartition(1)
    edges = stored(paths.mapInArrow(_recombined, _KIND), "edges")
    pieces = parts.where(F.col("kind") == PIECE).select("key", "shard", "piece", F.col("ends_sha256").alias("text"))
    pieces = pieces.repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "text")
    ends = pieces.mapInArrow(_streamed, "key binary, ends string")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = parts.where(F.col("kind") == NODE)
    known = inner.where("side IS NULL").select(names)
    places = edges.where(F.col("kind") == PATH).select("shard", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up"))
    under = inner.where("side IS NOT NULL").drop("parent_conv_id").join(places, ["shard", "side", "depth"])
    under = under.withColumnRenamed("up", "parent_conv_id").select(names)
    at_edges = edges.where(F.col("kind") == NODE).drop("ends_sha256").join(ends, "key", "left")
    at_edges = at_edges.withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256))).select(names)
    return known.unionByName(under).unionByName(at_edges)
