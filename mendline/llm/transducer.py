"""Token counts by a deterministic transducer compiled from a merge-by-score vocabulary.

The vocabulary's segmentation merges the best-scored adjacent pair until none is left. A sequence
of tokens is the result for its text exactly if every two neighbours are the result for theirs,
so the last token of every prefix is fixed by those of shorter prefixes: it is the one token that
ends there and agrees with the last token before it. That makes a finite-state machine over
characters:

* a state holds each place where a token may still begin: its node in the vocabulary's trie, the
  last token before it, and the count there, relative to the count here;
* a transition is annotated with the change of the count of emitted tokens.

States and transitions are compiled as texts need them, by subset construction, and kept by each
Python worker up to ``MOST_STATES`` (a cache: beyond it compilation starts anew, with equal results).

A text is cut into chunks where two bytes follow each other that no token has side by side. Behind such
a cut every state is the start state, so the state map of a chunk is constant and carries a
count; equal chunks are walked once per batch, and the maps compose by a prefix sum
over all chunks of a batch. Texts without such cuts are walked in linear time.

Characters outside the vocabulary count as many tokens as they have bytes. Spaces are written as
``U+2581`` in the vocabulary, and one is put before a text. NULL and empty texts have 0 tokens.
Columns are carried in a struct; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import encode, slices, utf8

MOST_STATES = 300_000
MOST_CHUNKS = 400_000
SPACE = "▁"


class Transducer:
    """Counts of tokens for chunks of text, from tokens and their scores (higher merges first)."""

    def __init__(self, scores: dict[str, float]):
        self.scores = {token.replace(SPACE, " "): score for token, score in scores.items()}
        self.tokens = list(self.scores)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for number, token in enumerate(self.tokens):
            node = 0
            for char in token:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][char]
            self.ends[node] = number
        self.agreed: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}

    def cuts(self) -> np.ndarray:
        """For each two bytes, whether no token has them side by side (never inside a character)."""
        cut = np.ones((256, 256), dtype=bool)
        cut[:, 0x80:0xC0] = False
        for token in self.tokens:
            data = np.frombuffer(token.encode(), np.uint8)
            cut[data[:-1], data[1:]] = False
        return cut

    def segment(self, text: str) -> list[str]:
        """The definition, for short texts: merges the best pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(self.scores.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = max((x for x in scored if x[0] is not None), default=None)
            if best is None:
                break
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _agree(self, before: int, token: int) -> bool:
        key = before, token
        if key not in self.agreed:
            first = [self.tokens[before]] if before >= 0 else []
            self.agreed[key] = self.segment("".join(first) + self.tokens[token]) == [*first, self.tokens[token]]
        return self.agreed[key]

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from a state: the next one, and the change of the count."""
        places, last, count = [], -1, None
        for node, before, so_far in self.states[state]:
            child = self.children[node].get(char)
            if child is None:
                continue
            if self.children[child]:
                places.append((child, before, so_far))
            token = self.ends[child]
            if token >= 0 and self._agree(before, token):
                last, count = token, so_far + 1
        if count is None:  # a character without a token, of as many tokens as bytes
            last, count = -1, len(char.encode())
            places = []
        new = tuple(sorted([(0, last, 0), *((n, b, c - count) for n, b, c in places)]))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        self.moves[state, char] = number, count
        return number, count

    def count(self, chunk: str) -> int:
        """Tokens of a chunk, from the start state."""
        if len(self.states) > MOST_STATES:
            self._reset()
        state = total = 0
        moves = self.moves
        for char in chunk:
            move = moves.get((state, char))
            if move is None:
                move = self._compile(state, char)
            state = move[0]
            total += move[1]
        return total

    def count_texts(self, texts: pa.Array, cut: np.ndarray) -> np.ndarray:
        """Tokens of every text of a column."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        flat, offsets = utf8(texts)
        filled = np.diff(offsets) > 0
        flat = np.insert(flat, offsets[:-1][filled], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        begin = np.zeros(len(flat), dtype=bool)
        begin[1:] = cut[flat[:-1], flat[1:]]
        begin[offsets[:-1][filled]] = True
        start = np.flatnonzero(begin)
        number, distinct = encode(flat, np.diff(np.append(start, len(flat))))
        own = np.fromiter(map(self._known, distinct.to_pylist()), np.int64, len(distinct))
        total = np.concatenate([[0], np.cumsum(own[number])])
        return np.diff(total[np.searchsorted(start, offsets)])

    def _known(self, chunk: bytes) -> int:
        got = self.known.get(chunk)
        if got is None:
            got = self.count(chunk.decode())
            if len(chunk) <= 64:
                if len(self.known) >= MOST_CHUNKS:
                    self.known.clear()
                self.known[chunk] = got
        return got


_COMPILED: dict[str, tuple[Transducer, np.ndarray]] = {}


def compiled(model: bytes) -> Transducer:
    """The transducer of a sentencepiece model that merges by score and falls back to bytes."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = [i for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_unused(i) or pieces.is_byte(i))]
    return Transducer({pieces.id_to_piece(i): pieces.get_score(i) for i in plain})


def count_tokens(docs: DataFrame, model: str, most: int = 4096, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of ``carry``), ``n_bytes, n_tokens, over_limit`` (more than ``most`` tokens).

    ``model`` is the place of a vocabulary file, which every machine has.
    """
    texts = docs.select(F.struct(*carry).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = f"row {texts.schema['row'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return texts.mapInArrow(partial(_count, model=model, most=most), kind)


def _count(rows: Iterator[pa.RecordBatch], model: str, most: int) -> Iterator[pa.RecordBatch]:
    if model not in _COMPILED:
        with open(model, "rb") as file:
            made = compiled(file.read())
        _COMPILED[model] = made, made.cuts()
    machine, cut = _COMPILED[model]
    for part in slices(rows):
        texts = part.column("text")
        tokens = machine.count_texts(texts, cut)
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens), pa.array(tokens > most)],
            names=["row", "n_bytes", "n_tokens", "over_limit"],
        )
