"""Language identification by the nearest of several centroids per language.

A text is a vector of byte trigrams inside and at the edges of words (white space, digits and ASCII signs count
as one blank), hashed to ``DIMS`` places, with counts damped by the square root and weighted by
inverse document frequency, of length one. Each language has up to ``CENTROIDS`` centroids from spherical k-means; a text
gets the language of the most similar one by cosine.

Rejection is by distance: similarity depends on how much text there is, so the training texts
give for each power of two of trigrams the similarity that nearly all of them reach; a text that
stays below ``SLACK`` of it is rejected.

The classifier is fitted on the driver from a sample of ``PER_LANGUAGE`` training texts per language (all, if there are
fewer): those with the smallest hashes of id and text, so ids may be NULL or repeated, and repeated rows count once.
That bound is the documented parameter, and holds for each task too. Prediction covers every text, whole, without a shuffle; what is broadcast is the
centroids.

Edge cases: NULL texts and texts without any letter are ``und`` with score 0 and rejected. With no
training rows every text is. Ties go to the language first in order. Columns are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import LOWER, slices, utf8

DIMS = 1 << 13
CENTROIDS = 6
PER_LANGUAGE = 500
SLACK = 0.35
UNKNOWN = "und"

#: Each byte of a lower-cased text, and a blank for what is no letter in ASCII.
_FOLD = LOWER.copy()
_FOLD[: ord("a")] = np.where(np.isin(LOWER[: ord("a")], np.arange(97, 123)), LOWER[: ord("a")], 32)
_FOLD[123:128] = 32


#: Found in texts that have trigrams.
_USABLE = r"[A-Za-z]|[^\x00-\x7F]"


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # similarity by power of two of trigrams


def fit(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model from texts and languages of the rows for which ``train`` holds."""
    usable = F.col(text).rlike(_USABLE) & F.col(lang).isNotNull()
    mark = F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("centroids"))
    rows = docs.where(train).where(usable).select(F.col(lang).alias("lang"), F.col(text).alias("text"), mark.alias("mark"))
    last = _last_marks(rows.select("lang", "mark"), per_language)
    if not last:
        return Model([], np.ones(DIMS), np.zeros((0, DIMS), np.float32), np.zeros(64))
    limit = F.create_map(*(F.lit(x) for pair in last.items() for x in pair))
    sample = rows.where(F.col("mark") <= limit[F.col("lang")]).mapInArrow(_features, "lang string, mark bigint, places binary, counts binary")
    got = sample.groupBy("lang", "mark").agg(F.min("places").alias("places"), F.min("counts").alias("counts")).toArrow().to_pylist()
    got = [x for x in got if x["places"]]
    got.sort(key=lambda x: (x["lang"], x["places"], x["counts"]))
    grid = np.zeros((len(got), DIMS), dtype=np.float32)
    for i, x in enumerate(got):
        grid[i, np.frombuffer(x["places"], np.uint16)] = np.frombuffer(x["counts"], np.uint32)
    amount = grid.sum(1)
    idf = np.log((1 + len(grid)) / (1 + (grid > 0).sum(0))).astype(np.float32) + 1
    unit = _unit(np.sqrt(grid) * idf)
    langs, centres = [], []
    for name in sorted({x["lang"] for x in got}):
        own = unit[[x["lang"] == name for x in got]]
        made = _cluster(own, min(CENTROIDS, len(own)))
        langs += [name] * len(made)
        centres.append(made)
    if not centres:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(64))
    centroids = np.concatenate(centres)
    return Model(langs, idf, centroids, _reach((unit @ centroids.T).max(1), _size(amount)))


def _last_marks(rows: DataFrame, n: int) -> dict[str, int]:
    """For each language (``lang``) the ``n``-th smallest distinct ``mark``, or the largest of fewer: first per task, then overall."""
    kind = "lang string, mark bigint"
    few = rows.mapInArrow(partial(_least_marks, n=n), kind).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    least = few.withColumn("place", place).where(F.col("place") <= n)
    return dict(least.groupBy("lang").agg(F.max("mark")).toLocalIterator())


def _least_marks(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    least: dict[str, np.ndarray] = {}
    for batch in rows:
        names = batch.column("lang").dictionary_encode()
        number = names.indices.to_numpy(zero_copy_only=False)
        marks = batch.column("mark").to_numpy(zero_copy_only=False)
        for i, name in enumerate(names.dictionary.to_pylist()):
            own = marks[number == i]
            least[name] = np.unique(np.concatenate([least[name], own]) if name in least else own)[:n]
    for name, marks in least.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(marks), pa.string()), pa.array(marks)], names=["lang", "mark"])


def predict(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of ``carry``), ``lang_pred, score, rejected``."""
    texts = docs.select(F.struct(*carry).alias("row"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = f"row {texts.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return texts.mapInArrow(partial(_predict, model=shared), kind)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _size(amount: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(amount, 1))[1].clip(0, 63)


def _cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; the first centres are spread out, each far from those before."""
    chosen = [int((x @ x.mean(0)).argmax())]
    near = x @ x[chosen[0]]
    for _ in range(k - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = _unit(np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)]))
    return centres


def _reach(similar: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The similarity that all but a hundredth of the texts of a size reach, growing with size."""
    least = np.zeros(64)
    for s in range(64):
        own = similar[size == s]
        least[s] = np.quantile(own, 0.01) if len(own) >= 10 else (least[s - 1] if s else 0)
    return np.maximum.accumulate(least)


def _grams(flat: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Per text, the places of its trigrams."""
    for a, b in zip(offsets[:-1], offsets[1:]):
        code = np.full(b - a + 2, 32, dtype=np.uint32)  # a blank before and behind
        code[1:-1] = _FOLD[flat[a:b]]
        three = code[:-2] | code[1:-1] << np.uint32(8) | code[2:] << np.uint32(16)
        three = three[(code[1:-1] != 32) | (code[:-2] != 32)]
        yield ((three * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def _features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(rows):
        places, counts = [], []
        for grams in _grams(*utf8(part.column("text"))):
            place, count = np.unique(grams, return_counts=True)
            places.append(place.astype(np.uint16).tobytes())
            counts.append(count.astype(np.uint32).tobytes())
        columns = [part.column("lang"), part.column("mark"), pa.array(places, pa.binary()), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "mark", "places", "counts"])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predict(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for part in slices(rows):
        texts = part.column("text")
        flat, offsets = utf8(texts)
        low = LOWER[flat]
        ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
        letters = np.diff(ascii_letters[offsets]) > 0
        for i in np.flatnonzero(~letters):
            letters[i] = has_letter(texts[i].as_py() or "")
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        grams = _grams(flat, offsets)
        for at in range(0, len(texts), 512):
            grid = np.stack([np.bincount(g, minlength=DIMS) for _, g in zip(range(at, min(at + 512, len(texts))), grams)]).astype(np.float32)
            own = np.flatnonzero(letters[at : at + 512])
            if not len(own) or not model.langs:
                continue
            similar = _unit(np.sqrt(grid[own]) * model.idf) @ model.centroids.T
            best = similar.argmax(1)
            got = similar[np.arange(len(own)), best]
            score[at + own] = got.clip(0, 1)
            rejected[at + own] = got < SLACK * model.least[_size(grid[own].sum(1))]
            for i, b in zip(own, best):
                lang[at + i] = model.langs[b]
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
            names=["row", "lang_pred", "score", "rejected"],
        )
