"""Deleted interpolation: a bigram model whose mixture weights come from held-out counts.

The probability of a token is a mixture of three maximum-likelihood estimates,

    P(w | h) = a0(h) / (V + 1) + a1(h) * c(w) / N + a2(h) * c(h w) / c(h),

whose weights depend on how often the context ``h`` was seen: contexts fall in buckets by the
power of two of ``c(h)``. A seventh of the training texts is deleted from the counts, and
expectation-maximisation over its n-grams learns the weights; the final counts are those of all
training texts.

How the work is dealt out. Texts are packed into batches of about ``BATCH_TOKENS`` tokens, and
each batch becomes one row of token numbers with a list of distinct words. A batch then asks
once for each distinct unigram and bigram it holds, sending along its own counts: requests are
sorted by a 64-bit hash and cut into slots by hash range, so that no slot depends on how
frequent an n-gram is. A slot adds up the counts of all batches and answers each batch in the order asked.
Shuffled are thus 6 to 8 bytes per distinct n-gram of a batch, rather than a row per token, and
answers without keys. No model is broadcast or gathered on the driver; what reaches the driver
is the totals N and V and one histogram of a fixed number of cells for expectation-maximisation.

N-grams are told apart by 64-bit hashes (XXH3 for words). Among ten million words the odds of any
collision are about 3 in a million, and one would add up two counts.

Edge cases: a NULL or empty text is one end token. Without training texts every probability is
the uniform 1 / (V + 1) = 1. Rows are scored one by one, so repeated rows and NULL ids are kept;
other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import count_of, stored
from .words import NOT_SPACE, Words, encode, mixed, slices, utf8

BATCH_TOKENS = 1_400_000
#: Tokens whose probabilities are worked out at once.
STRETCH = 400_000
SLOT_KEYS = 1_200_000
BUCKETS = 48
#: Log probabilities fall into this many cells per unit (natural) for expectation-maximisation.
CELLS = 8
MOST_CELLS = 400

_END = xxhash.xxh3_64_intdigest(b" ")

_BATCH = (
    "batch string, tune boolean, ids array<bigint>, train array<boolean>, held array<boolean>, "
    "lengths binary, tokens binary, words binary, n_tokens bigint"
)
_REQUEST = "slot bigint, batch string, tune boolean, kind int, keys binary, width int, counts binary, n bigint"
_ANSWER = "batch string, tune boolean, slot bigint, kind int, base binary, full binary, totals array<bigint>"


def score_texts(docs: DataFrame, train: Column, tune: Column, text: str = "text", key: str = "doc_id", held: Column | None = None) -> DataFrame:
    """Base score and model score (log10) of every text.

    ``train`` tells the texts to learn from, ``tune`` those among them that are deleted from the
    counts while the weights are learned. ``held`` is handed through. Returns ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``.
    """
    learnt = F.coalesce(train, F.lit(False))
    packed = docs.select(
        F.col(key).cast("bigint").alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        learnt.alias("train"),
        (learnt & F.coalesce(tune, F.lit(False))).alias("tune"),
        F.coalesce(held if held is not None else ~learnt, F.lit(False)).alias("held"),
    )
    batches = stored(packed.mapInArrow(_pack, _BATCH), "lm-batches")
    (tokens,) = count_of(batches, F.sum("n_tokens"))
    slots = max(1, -(-int(tokens) // SLOT_KEYS))
    spread = max(slots, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = batches.mapInArrow(partial(_ask, slots=slots), _REQUEST)
    answers = stored(
        asked.repartition(spread, "slot", "kind").groupBy("slot", "kind").applyInArrow(_answer, _ANSWER), "lm-counts"
    )
    totals = answers.where("totals is not null and kind = 1")
    n, v, n_base, v_base = (int(x) for x in count_of(totals, *(F.sum(F.col("totals")[i]) for i in range(4))))
    weights = _learn(_met(batches, answers, True), n_base, v_base)
    rest = _met(batches, answers, None)
    return rest.mapInArrow(
        partial(_score, n=n, v=v, weights=weights),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def _met(batches: DataFrame, answers: DataFrame, tune: bool | None) -> DataFrame:
    """Batches with the answers to what they asked."""
    if tune:
        batches, answers = batches.where("tune"), answers.where("tune")
    folded = (
        answers.where("batch is not null")
        .groupBy("batch")
        .agg(F.collect_list(F.struct("kind", "slot", "base", "full")).alias("answers"))
    )
    return batches.join(folded, "batch")


def _pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts as token numbers; -1 stands for the end of a text."""
    place, made = TaskContext.get().partitionId(), 0
    heaps: dict[bool, list] = {False: [], True: []}
    sizes = {False: 0, True: 0}

    def flush(tune: bool) -> pa.RecordBatch:
        nonlocal made
        heap, heaps[tune], sizes[tune] = heaps[tune], [], 0
        tokens, words = encode(np.concatenate([x[0] for x in heap]), np.concatenate([x[1] for x in heap]))
        counts = np.concatenate([x[2] for x in heap])
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
        ends = np.cumsum(counts)
        tokens = np.insert(tokens.astype(np.int32), ends, -1)
        made += 1
        return pa.RecordBatch.from_pylist(
            [
                {
                    "batch": f"{place}-{made}",
                    "tune": tune,
                    "ids": [i for x in heap for i in x[3]],
                    "train": [i for x in heap for i in x[4]],
                    "held": [i for x in heap for i in x[5]],
                    "lengths": (counts + 1).astype(np.uint32).tobytes(),
                    "tokens": pa.compress(tokens.tobytes(), codec="zstd", asbytes=True),
                    "words": hashes.tobytes(),
                    "n_tokens": len(tokens),
                }
            ],
            schema=_BATCH_ARROW,
        )

    for part in slices(rows):
        tuned = part.column("tune").to_numpy(zero_copy_only=False)
        for tune in (False, True):
            chosen = part.filter(pa.array(tuned == tune))
            if not chosen.num_rows:
                continue
            words = Words(*utf8(chosen.column("text")), NOT_SPACE)
            columns = (chosen.column(c).to_pylist() for c in ("id", "train", "held"))
            heaps[tune].append((*words.packed(), np.diff(words.first), *columns))
            sizes[tune] += len(words) + chosen.num_rows
            if sizes[tune] >= BATCH_TOKENS:
                yield flush(tune)
    for tune in (False, True):
        if heaps[tune]:
            yield flush(tune)


_BATCH_ARROW = pa.schema(
    [
        ("batch", pa.string()),
        ("tune", pa.bool_()),
        ("ids", pa.list_(pa.int64())),
        ("train", pa.list_(pa.bool_())),
        ("held", pa.list_(pa.bool_())),
        ("lengths", pa.binary()),
        ("tokens", pa.binary()),
        ("words", pa.binary()),
        ("n_tokens", pa.int64()),
    ]
)


class _Grams:
    """The distinct unigrams and bigrams of a batch, in the order in which it asks for them."""

    def __init__(self, row: dict):
        lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        tokens = np.frombuffer(pa.decompress(row["tokens"], int(row["n_tokens"]) * 4, codec="zstd"), np.int32)
        hashes = np.append(np.frombuffer(row["words"], np.uint64), np.uint64(_END))
        self.width = len(hashes)
        token = np.where(tokens < 0, np.int32(self.width - 1), tokens)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        if len(before):
            before[0] = self.width - 1  # the end of a text is the context of the next one's first word
        pairs, pair_of = np.unique(before * np.int64(self.width) + token, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        with np.errstate(over="ignore"):
            mix = mixed(hashes[pairs // self.width] * np.uint64(3) + np.uint64(1)) + hashes[pairs % self.width]
        self.pair_keys, self.pair_order = self._sorted(mixed(mix))
        self.word_keys, self.word_order = self._sorted(hashes)
        self.token, self.before, self.lengths = token, before, lengths
        self.text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)

    @staticmethod
    def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def parts(self, kind: int, slots: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Keys in order, the order, and the slots that have a share, with its start and end."""
        keys, order = (self.word_keys, self.word_order) if kind == 1 else (self.pair_keys, self.pair_order)
        slot = ((keys >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        first = np.ones(len(slot), dtype=bool)
        first[1:] = slot[1:] != slot[:-1]
        start = np.flatnonzero(first)
        return keys, order, list(zip(slot[start].tolist(), start.tolist(), [*start[1:].tolist(), len(slot)]))

    def answers(self, row: dict, which: str) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the unigrams by token number, and of the bigrams by pair number."""
        out = []
        for kind, order in ((1, self.word_order), (2, self.pair_order)):
            got = sorted((x for x in row["answers"] if x["kind"] == kind), key=lambda x: x["slot"])
            counts = np.empty(len(order), dtype=np.int64)
            counts[order] = np.concatenate([np.frombuffer(_plain(x[which]), np.int64) for x in got])
            out.append(counts)
        return out[0], out[1]


def _small(counts: np.ndarray) -> bytes:
    return pa.compress(len(counts).to_bytes(8, "little") + counts.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def _plain(data: bytes) -> memoryview:
    reader = pa.CompressedInputStream(pa.BufferReader(data), "zstd")
    return memoryview(reader.read())[8:]


def _ask(rows: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    for part in rows:
        for i in range(part.num_rows):
            row = part.slice(i, 1).to_pylist()[0]
            grams = _Grams(row)
            weight = np.array(row["train"], dtype=bool)[grams.text]
            for kind, number, n in ((1, grams.token, grams.width), (2, grams.pair_of, len(grams.pair_keys))):
                counts = np.bincount(number[weight], minlength=n)
                keys, order, shares = grams.parts(kind, slots)
                counts, out = counts[order], []
                for slot, start, end in shares:
                    data, width = _narrow(keys[start:end])
                    out.append((slot, row["batch"], row["tune"], kind, data, width, _small(counts[start:end]), end - start))
                for at in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out[at : at + 64]), _REQUEST_TYPES)], names=_REQUEST_NAMES
                    )


_REQUEST_NAMES = ["slot", "batch", "tune", "kind", "keys", "width", "counts", "n"]
_REQUEST_TYPES = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]


def _narrow(keys: np.ndarray) -> tuple[bytes, int]:
    """Sorted keys as differences, in as few bytes each as the largest but the first needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def _wide(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    steps = np.zeros(((len(raw) - 8) // width, 8), dtype=np.uint8)
    steps[:, :width] = raw[8:].reshape(-1, width)
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate([raw[:8].view(np.uint64), steps.reshape(-1).view(np.uint64)]), dtype=np.uint64)


def _answer(table: pa.Table) -> pa.Table:
    """One slot: totals over all batches, in each batch's own order."""
    keys, counts, ends = [], [], [0]
    for data, width, own in zip(*(table.column(c).to_pylist() for c in ("keys", "width", "counts"))):
        keys.append(_wide(data, width))
        counts.append(np.frombuffer(_plain(own), np.int64))
        ends.append(ends[-1] + len(keys[-1]))
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    counted, tuned = np.concatenate(counts), np.repeat(table.column("tune").to_numpy(), np.diff(ends))
    full = np.bincount(place, weights=counted).astype(np.int64)
    base = np.bincount(place, weights=counted * ~tuned).astype(np.int64)
    batch, tune = table.column("batch").to_pylist(), table.column("tune").to_pylist()
    slot, kind = table.column("slot")[0].as_py(), table.column("kind")[0].as_py()
    out = []
    for i, name in enumerate(batch):
        own = place[ends[i] : ends[i + 1]]
        out.append((name, tune[i], slot, kind, _small(base[own]) if tune[i] else None, _small(full[own]), None))
    totals = [int(full.sum()), int((full > 0).sum()), int(base.sum()), int((base > 0).sum())]
    out.append((None, None, slot, kind, None, None, totals))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), _ANSWER_TYPES)], names=_ANSWER_NAMES)


_ANSWER_NAMES = ["batch", "tune", "slot", "kind", "base", "full", "totals"]
_ANSWER_TYPES = [pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _parts(grams: _Grams, row: dict, which: str, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretch by stretch, of every token: text, bucket of its context, count, unigram and bigram estimates."""
    word, pair = grams.answers(row, which)
    for at in range(0, len(grams.token), STRETCH):
        to = slice(at, at + STRETCH)
        context, count = word[grams.before[to]], word[grams.token[to]]
        two = np.divide(pair[grams.pair_of[to]], context, out=np.zeros(len(context)), where=context > 0)
        yield grams.text[to], bucket_of(context), count, count / max(n, 1), two


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two below its count."""
    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype(float))[1], 0).clip(0, BUCKETS - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    cell = np.zeros(len(p), dtype=np.int64)
    seen = p > 0
    cell[seen] = 1 + np.rint(-np.log(p[seen]) * CELLS).astype(np.int64)
    return cell.clip(0, MOST_CELLS - 1)


def _tally(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """How many tokens of the deleted part have which bucket and which two estimates."""
    tally = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for part in rows:
        for i in range(part.num_rows):
            row = part.slice(i, 1).to_pylist()[0]
            for _, bucket, _, one, two in _parts(_Grams(row), row, "base", n):
                code = (bucket * MOST_CELLS + _cell(one)) * MOST_CELLS + _cell(two)
                code, times = np.unique(code, return_counts=True)
                code, place = np.unique(np.concatenate([tally[0], code]), return_inverse=True)
                tally = code, np.bincount(place, weights=np.concatenate([tally[1], times])).astype(np.int64)
    if len(tally[0]):
        yield pa.RecordBatch.from_arrays([pa.array(tally[0]), pa.array(tally[1])], names=["code", "times"])


def _learn(tuned: DataFrame, n: int, v: int) -> np.ndarray:
    """The weights of each bucket of contexts."""
    cells = (
        tuned.mapInArrow(partial(_tally, n=n), "code bigint, times bigint")
        .groupBy("code")
        .agg(F.sum("times").alias("times"))
        .toArrow()
    )
    code, times = cells.column("code").to_numpy(), cells.column("times").to_numpy().astype(float)
    return maximise(code // MOST_CELLS**2, _of(code // MOST_CELLS % MOST_CELLS), _of(code % MOST_CELLS), times, v)


def _of(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, np.exp(-(cell - 1) / CELLS), 0.0)


def maximise(bucket: np.ndarray, one: np.ndarray, two: np.ndarray, times: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation of the weights; a bucket without n-grams has those of all."""
    p = np.stack([np.full(len(one), 1 / (v + 1)), one, two])

    def climb(of: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(rounds if of.any() else 0):
            share = weights[:, None] * p[:, of]
            share *= times[of] / share.sum(0)
            weights = share.sum(1) + 1e-3  # keeps every weight above zero
            weights /= weights.sum()
        return weights

    whole = climb(np.ones(len(one), dtype=bool))
    out = np.stack([climb(bucket == b) if (bucket == b).any() else whole for b in range(BUCKETS)])
    out[0] = [*(out[0][:2] / out[0][:2].sum()), 0]  # no bigram estimate for an unseen context
    return out


def _score(rows: Iterator[pa.RecordBatch], n: int, v: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in rows:
        for i in range(part.num_rows):
            row = part.slice(i, 1).to_pylist()[0]
            grams = _Grams(row)
            size = len(grams.lengths)
            known, base, model = np.zeros(size), np.zeros(size), np.zeros(size)
            for text, bucket, count, one, two in _parts(grams, row, "full", n):
                share = weights[bucket]
                p = share[:, 0] / (v + 1) + share[:, 1] * one + share[:, 2] * two
                if not n:
                    p = np.ones(len(count))  # nothing learnt: the only estimate is the uniform one
                known += np.bincount(text, weights=count > 0, minlength=size)
                base += np.bincount(text, weights=np.log10((count + 1) / (n + v + 1)), minlength=size)
                model += np.bincount(text, weights=np.log10(p), minlength=size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(row["held"], pa.bool_()),
                    pa.array(grams.lengths),
                    pa.array(known.astype(np.int64)),
                    pa.array(np.full(size, n, dtype=np.int64)),
                    pa.array(base),
                    pa.array(model),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
