"""Phrases whose words go together, counted in a prefix-free parsing of the corpus.

Texts are lower-cased (``A-Z``), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words ``[^\\x20\\x09]+``; phrases lie within a piece.

1. Parsing. A window of two words is a trigger if its hash, which also sees whether a piece ends between them, is 0 modulo
   ``TRIGGER``. A chunk runs from one trigger to the end of the next, so neighbours overlap by a window, and equal
   passages give equal chunks wherever they stand. The dictionary has each distinct chunk of a language once, with its number of occurrences.
2. Counting. A phrase belongs to the chunk in which it starts before the last window (in the last chunk of a text, anywhere), which
   holds it whole: overlaps count once. Phrases are counted inside distinct chunks only, each with the weight of its chunk.
3. Longer phrases. Words are counted first, then pairs of frequent words, then triples of frequent pairs; a Bloom filter
   of the frequent ones goes to all tasks. It never misses one, and what it lets through too much is counted and found rare. So counts are
   exact for every phrase that occurs ``least`` times.
4. Scores, drops and ranks are joins and one top-k of the frequent phrases, in exact decimals.

Shuffled: the chunks (about the size of the texts, copies once a task), and pairs of frequent words once for each distinct pair of a batch.
Collected: bits of the filter, 64 MB at most; a filter that is full lets more through, which changes no result. A chunk is as
long as its text if nothing triggers, so a batch is cut by bytes.

Edge cases: a NULL language is ``und``; NULL and empty texts have no words. Ties in score go by occurrences, then by
phrase in the order of its UTF-8 bytes; of equal scores of one phrase the earliest cut counts. Repeated rows count each. Columns may have any
names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import column_of, field_bits, gather, has, joined_field, larger, pieces_of, places, positional, put
from .store import stored
from .words import Words, encode, mixed, slices, utf8

#: One window in so many is a trigger.
TRIGGER = 24
#: Bytes of chunks that are counted at once.
BATCH_BYTES = 12 << 20
NEWLINE, SPACE = 10, 32

#: Bytes that end a piece, and bytes of words in a text and in a chunk.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
WORD = ~ENDS
WORD[[9, 32]] = False
IN_CHUNK = np.ones(256, dtype=bool)
IN_CHUNK[[NEWLINE, SPACE]] = False

_ODD = np.uint64(0x9E3779B97F4A7C15)


def hash_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words, and the hash of its bytes."""
    codes, distinct = encode(*words.packed())
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    return codes.astype(np.int64), hashes[codes] if len(codes) else np.zeros(0, np.uint64)


def longer(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of phrases with one word more."""
    with np.errstate(over="ignore"):
        return mixed(keys * _ODD + hashes)


def _chunks(rows: Iterator[pa.RecordBatch], trigger: int, longest: int) -> Iterator[pa.RecordBatch]:
    """``lang, chunk, whole``: words with a space before each, or a line break where a piece ends; ``whole`` if it ends its text."""
    window = longest - 1
    for part in slices(rows):
        flat, offsets = utf8(part.column("text"))
        words = Words(flat, offsets, WORD)
        n = len(words)
        if not n:
            continue
        ends = np.zeros(len(flat) + 1, dtype=np.int64)
        np.cumsum(ENDS[flat], out=ends[1:])
        cut = np.zeros(n, dtype=bool)
        cut[1:] = ends[words.start[1:]] > ends[words.end[:-1]]
        text = np.repeat(np.arange(len(part)), np.diff(words.first))
        _, hashes = hash_words(words)
        key = np.zeros(n, dtype=np.uint64)
        for back in range(window - 1, -1, -1):  # the words of the window that ends at each place
            with np.errstate(over="ignore"):
                seen = hashes + cut.astype(np.uint64) * _ODD if back < window - 1 else hashes
            shifted = np.zeros(n, dtype=np.uint64)
            shifted[back:] = seen[: n - back]
            key = longer(key, shifted)
        end = np.flatnonzero(key % np.uint64(trigger) == 0)
        begin = end - window + 1
        end = end[(begin >= 0) & (text[np.maximum(begin, 0)] == text[end])]
        begin = end - window + 1
        heads = words.first[:-1][np.diff(words.first) > 0]
        first = np.unique(np.concatenate([heads, begin]))  # a chunk starts at each head and trigger
        last = np.append(first[1:], n) - 1
        whole = np.append(text[first[1:]] != text[first[:-1]], True)
        last[~whole] += window
        data, start, stop = words.spaced()
        data[start[cut] - 1] = NEWLINE
        chunks = gather(data, start[first], stop[last], pa.large_string()).cast(pa.string())
        lang = part.column("lang").take(pa.array(text[first]))
        yield pa.RecordBatch.from_arrays([lang, chunks, pa.array(whole)], names=["lang", "chunk", "whole"])


def _counts(rows: Iterator[pa.RecordBatch], size: int, field, longest: int) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, f``: weighted occurrences of the phrases of ``size`` words in each batch of distinct chunks.

    With ``field`` only those both of whose phrases of one word less are in it. For single words, the phrase
    ``''`` gets the number of all words.
    """
    for part in slices(larger(rows, BATCH_BYTES), "chunk", BATCH_BYTES):
        words = Words(*utf8(part.column("chunk")), IN_CHUNK)
        n = len(words)
        codes, hashes = hash_words(words)
        text = np.repeat(np.arange(len(part)), np.diff(words.first))
        langs = part.column("lang").dictionary_encode()
        lang_of = langs.indices.to_numpy(zero_copy_only=False)
        lang = lang_of[text]
        weight = part.column("weight").to_numpy(zero_copy_only=False)[text]
        cut = np.zeros(n, dtype=bool)
        inner = words.start > 0
        cut[inner] = words.low[words.start[inner] - 1] == NEWLINE
        # Phrases that start in the last window belong to the next chunk.
        own = np.arange(n) < (words.first[1:] - np.where(part.column("whole").to_numpy(zero_copy_only=False), 0, longest - 1))[text]
        at = np.flatnonzero(own[: n - size + 1]) if n >= size else np.zeros(0, np.int64)
        for j in range(1, size):
            at = at[(text[at + j] == text[at]) & ~cut[at + j]]
        if field is not None:
            seeds = np.fromiter((xxhash.xxh3_64_intdigest(x or "", 1) for x in langs.dictionary.to_pylist()), np.uint64)
            at = at[has(field.value, keys_at(hashes, seeds[lang], at, size - 1))]
            at = at[has(field.value, keys_at(hashes, seeds[lang], at + 1, size - 1))]
        ids = codes[at] * len(langs.dictionary) + lang[at]
        for j in range(size):
            if j:
                ids = (ids << 32) | codes[at + j]
            _, example, ids = np.unique(ids, return_index=True, return_inverse=True)
        if len(at):
            f = np.zeros(len(example), dtype=np.int64)
            np.add.at(f, ids, weight[at])
            phrase = gather(words.low, words.start[at[example]], words.end[at[example] + size - 1], pa.large_string()).cast(pa.string())
            own_lang = langs.dictionary.take(pa.array(lang[at[example]]))
            yield pa.RecordBatch.from_arrays([own_lang, phrase, pa.array(f)], names=["lang", "phrase", "f"])
        if size == 1:
            total = np.zeros(len(langs.dictionary), dtype=np.int64)
            np.add.at(total, lang[at], weight[at])
            yield pa.RecordBatch.from_arrays([langs.dictionary, pa.array([""] * len(total), pa.string()), pa.array(total)], names=["lang", "phrase", "f"])


def keys_at(hashes: np.ndarray, seeds: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Keys of the phrases of ``size`` words that start at ``at``; ``seeds`` has a number of the language for each word."""
    key = seeds[at]
    for j in range(size):
        key = longer(key, hashes[at + j])
    return key


def _filtered(rows: Iterator[pa.RecordBatch], bits: int, size: int) -> Iterator[pa.RecordBatch]:
    field = np.zeros(bits // 8, np.uint8)
    for part in slices(rows, "phrase"):
        words = Words(*utf8(part.column("phrase")), IN_CHUNK)
        _, hashes = hash_words(words)
        seeds = np.fromiter((xxhash.xxh3_64_intdigest(x or "", 1) for x in part.column("lang").to_pylist()), np.uint64, len(part))
        put(field, places(keys_at(hashes, np.repeat(seeds, size), words.first[:-1], size), bits))
    yield from pieces_of(field)


def parse(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, trigger: int = TRIGGER) -> DataFrame:
    """The dictionary: ``lang, chunk, whole`` (whether it ends a text) and ``weight``, its number of occurrences."""
    plain, _ = positional(docs)
    of_lang = F.coalesce(column_of(docs, lang).cast("string"), F.lit("und"))
    texts = plain.select(of_lang.alias("lang"), F.coalesce(column_of(docs, text), F.lit("")).alias("text"))
    chunks = texts.mapInArrow(partial(_chunks, trigger=trigger, longest=longest), "lang string, chunk string, whole boolean")
    return chunks.groupBy("lang", "chunk", "whole").agg(F.count("*").alias("weight"))


def frequent_phrases(dictionary: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of up to ``longest`` words with ``f >= least``; the phrase ``''`` (size 0) has the number of words.

    ``longest`` is that of the parsing.
    """
    found, field = [], None
    for size in range(1, longest + 1):
        counted = dictionary.mapInArrow(partial(_counts, size=size, field=field, longest=longest), "lang string, phrase string, f bigint")
        counted = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        counted = counted.where((F.col("f") >= least) | (F.col("phrase") == ""))
        kept = stored(counted.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(size).alias("size"), "f"), f"phrases-{size}")
        found.append(kept)
        if size < longest:
            bits = field_bits(kept.count())
            of_size = kept.where(F.col("size") == size).select("lang", "phrase")
            pieces = of_size.mapInArrow(partial(_filtered, bits=bits, size=size), "piece int, f0 binary")
            field = dictionary.sparkSession.sparkContext.broadcast(joined_field(pieces, bits))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), first, count), " ")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, trigger: int = TRIGGER
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of each language.

    ``a`` is the number of occurrences. Cut after its first ``k`` words a phrase has the score ``floor(1000000 a² / (l r))``, where
    ``l`` and ``r`` are those of its parts; the lowest-scoring cut counts. A phrase inside a longer candidate that has at least ``share``
    hundredths of its occurrences is left out.
    """
    dictionary = stored(parse(docs, lang, text, longest, trigger), "dictionary")
    known = frequent_phrases(dictionary, longest, least)
    candidates = known.where("size > 1").withColumn("words", F.split("phrase", " "))
    # Phrases inside a longer candidate, with the most occurrences of one that holds them.
    spans = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))"
    )
    inside = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("f").alias("held"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = candidates.join(inside, ["lang", "phrase"], "left")
    kept = kept.where(F.col("held").isNull() | (F.col("held") * 100 < F.col("f") * share))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail")
    )
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    # A score is 1000000 at most, as no part is rarer than the phrase.
    big = lambda name: F.col(name).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", big("a") * big("a") * F.lit(1_000_000)).withColumn("below", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = known.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

