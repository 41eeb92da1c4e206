"""The near-duplicate stage on planted copies, against plain Python."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from mendline.llm import similar  # noqa: E402


def shingles(text):
    w = plain.words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def kept_of(rows):
    """The smallest id of each group of texts linked by a similarity of 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values())


def as_rows(texts):
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def kept_by_stage(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").select("doc_id").collect())


@pytest.mark.parametrize("few,sets,frequent,local", [(32, 4096, 64, 0), (2, 7, 2, 2_000_000)])
def test_near_copies(monkeypatch, spark, few, sets, frequent, local):
    for name, value in (("FEW", few), ("BLOCK_SETS", sets), ("FREQUENT", frequent), ("LOCAL", local)):
        monkeypatch.setattr(similar, name, value)
    rnd, rows = random.Random(8), []
    words = [f"w{i}" for i in range(3000)]
    for _ in range(40):
        text = [rnd.choice(words) for _ in range(400)]
        rows.append(text)
        for changes in (1, 4, 7, 12, 30):  # similarities of about 0.98, 0.9, 0.84, 0.74 and 0.5
            copy = list(text)
            for at in rnd.sample(range(400), changes):
                copy[at] = "new"
            rows.append(copy)
    rows += [["one", "two"], ["one", "two"], ["one", "three"], [], []]
    rows = as_rows(rows)
    assert kept_by_stage(spark, rows) == kept_of(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert similar.deduplicate(df.limit(0)).count() == 0
    odd = df.limit(9).union(spark.createDataFrame([(None, None), (None, None), (3, rows[3][1])], df.schema))
    names = ["__nr", "a.b", "row", "nr"]
    for i, name in enumerate(names):
        odd = odd.withColumn(name, F.lit(70 + i))
    found = similar.deduplicate(odd)
    assert found.columns == odd.columns
    assert {tuple(r)[2:] for r in found.collect()} == {(70, 71, 72, 73)}


def around(n, length, least, most, seed):
    """Texts around one, each with words changed at between ``least`` and ``most`` places."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    texts = []
    for i in range(n):
        text = list(base)
        for k, at in enumerate(rnd.sample(range(length), rnd.randint(least, most))):
            text[at] = f"x{i}_{k}"
        texts.append(text)
    return texts


@pytest.mark.parametrize("n,length,least,most", [(1500, 200, 2, 6), (700, 600, 10, 16)])
def test_crowds_of_dense_and_of_sparse_links(monkeypatch, spark, n, length, least, most):
    """One large group around similarity 0.8: whoever the links of all pairs leave apart stays, and no one else."""
    monkeypatch.setattr(similar, "BLOCK_SETS", 400)
    rows = as_rows(around(n, length, least, most, 5))
    assert kept_by_stage(spark, rows) == kept_of_many(rows)


def kept_of_many(rows):
    """``kept_of`` by counting common shingles with matrices, as sets of all pairs take too long."""
    sets = [shingles(t) for _, t in rows]
    codes = {}
    for x in sets:
        for y in x:
            codes.setdefault(y, len(codes))
    marks = np.zeros((len(sets), len(codes)), dtype=np.float32)
    for i, x in enumerate(sets):
        marks[i, [codes[y] for y in x]] = 1
    both = (marks @ marks.T).astype(float)
    sizes = marks.sum(1).astype(float)
    alike = both >= 0.8 * (sizes[:, None] + sizes[None] - both)
    label = np.arange(len(sets))
    while True:
        new = np.array([label[alike[i]].min() for i in range(len(sets))])
        if (new == label).all():
            return sorted(set(label.tolist()))
        label = new


def test_columns_of_any_name_pass_through(spark):
    """Stages that return the columns of the documents leave values of other columns as they are."""
    rows = [(i, f"The weather of day {i} was good, and they all went to the sea with the dog.", "en", "s", 60) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for i, name in enumerate(("__nr", "__none", "a.b", "row", "no_text", "c0")):
        docs = docs.withColumn(name, F.lit(70 + i))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        found = stage(spark, docs, "/root/testdata/sf0.001")
        assert found.columns == docs.columns, name
        assert {tuple(r)[5:] for r in found.collect()} == {(70, 71, 72, 73, 74, 75)}, name


def test_pivots_give_keys_and_discard_but_lose_nothing():
    """Distances to the pivots are kept by block: what differs by no more than the radius is never discarded, most of the rest is."""
    draw = np.random.default_rng(3)
    prints = draw.integers(0, 1 << 63, (4000, similar.SEEN), dtype=np.uint64) << np.uint64(1)
    for row in range(2000, 4000):  # copies with 0 to 60 bits turned
        bits = np.unpackbits(prints[row - 2000].view(np.uint8), bitorder="little")
        bits[draw.choice(192, int(draw.integers(0, 61)), replace=False)] ^= 1
        prints[row] = np.packbits(bits, bitorder="little").view(np.uint64)
    near = similar.DISTANCES[prints.view(np.uint16)]
    pivots = [next(b for b in range(1 << 16) if similar.DISTANCES[b, p] == 0) for p in range(similar.PIVOTS)]
    plain = [[[bin(int(x) ^ p).count("1") for p in pivots] for x in row.view(np.uint16)] for row in prints[:5]]
    assert near[:5].tolist() == plain
    i, j = np.arange(2000), np.arange(2000, 4000)
    for a, b in ((i, j), (i, i[::-1])):
        apart = similar._apart(prints, a, b)
        open_ = similar._may_be_near(near, a, b, similar.RADIUS)
        assert open_[apart <= similar.RADIUS].all()
        assert similar._kept(prints, near, a, b, similar.RADIUS).tolist() == np.flatnonzero(apart <= similar.RADIUS).tolist()
    assert open_.mean() < 0.5
    assert similar._kept(prints, near, i[:1], j[-1:], similar.RADIUS).size == 0
    keys = {tuple(d): c for d, c in zip(similar.DISTANCES.tolist(), similar.CELLS.tolist())}
    assert len(set(keys.values())) == len(keys) and all(keys[tuple(d)] == c for d, c in zip(similar.DISTANCES.tolist(), similar.CELLS.tolist()))
