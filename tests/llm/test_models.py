"""What models learn and tell, against plain versions of their definitions."""

from __future__ import annotations

import collections
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import plain  # noqa: E402
from mendline.llm import centroids, private_spans  # noqa: E402
from mendline.llm.interpolation import score_texts  # noqa: E402
from mendline.llm.store import remainder  # noqa: E402

SF = "/root/testdata/sf0.001"
END = " "
#: An id that is held out.
UNSEEN = next(i for i in range(-99, -9) if zlib.crc32(str(i).encode()) % 3 == 1)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def few(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("a b c d e ee".split()) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    return spark.createDataFrame([*rows, (3, None), (None, "a b a b"), (None, "zz"), (3, ""), (3, "c " * 3000)], "doc_id bigint, text string")


# Deleted interpolation.


class Counts:
    """Counts of tokens and of pairs; the context of a first word is the end of a text."""

    def __init__(self, texts):
        self.words, self.pairs = collections.Counter(), collections.Counter()
        for text in texts:
            self.words.update(text)
            self.pairs.update(zip([END, *text], text))
        self.n, self.v = sum(self.words.values()), len(self.words)

    def estimates(self, context, word):
        """Bucket of the context, and the estimates of order zero, one and two."""
        seen = self.words[context]
        two = self.pairs[context, word] / seen if seen else 0.0
        return seen.bit_length(), (1 / (self.v + 1), self.words[word] / max(self.n, 1), two)


def stepped(p):
    """Rounded to an eighth of a natural logarithm, as documented."""
    return math.exp(-round(-math.log(p) * 8) / 8) if p else 0.0


def plain_weights(observed):
    """Expectation-maximisation for a list of estimates, each with how often it occurs."""
    weights = [1 / 3] * 3
    for _ in range(60 if observed else 0):
        sums = [1e-3] * 3
        for p, times in observed.items():
            shares = [w * x for w, x in zip(weights, p)]
            for i in range(3):
                sums[i] += times * shares[i] / sum(shares)
        weights = [x / sum(sums) for x in sums]
    return weights


def plain_scores(rows, rounded):
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    texts = [(fold(i), [*plain.words(t), END]) for i, t in rows]
    base, full = Counts(t for f, t in texts if f not in (2, 3)), Counts(t for f, t in texts if f != 2)
    observed = collections.defaultdict(collections.Counter)
    for _, text in (x for x in texts if x[0] == 3):
        for context, word in zip([END, *text], text):
            bucket, (zero, one, two) = base.estimates(context, word)
            observed[bucket][(zero, stepped(one), stepped(two)) if rounded else (zero, one, two)] += 1
    weights = {bucket: plain_weights(own) for bucket, own in observed.items()}
    whole = plain_weights(sum(observed.values(), collections.Counter()))
    first = weights.get(0, whole)
    weights[0] = [first[0] / sum(first[:2]), first[1] / sum(first[:2]), 0.0]
    for (i, _), (_, text) in zip(rows, texts):
        score = 0.0
        for context, word in zip([END, *text], text):
            bucket, p = full.estimates(context, word)
            score += math.log10(sum(w * x for w, x in zip(weights.get(bucket, whole), p)))
        yield str(i), len(text), score


@pytest.mark.parametrize("table", ["docs", "few"])
def test_scores_of_deleted_interpolation(request, spark, table):
    """Counts, buckets, weights by expectation-maximisation and mixture, all once more in plain Python."""
    df = request.getfixturevalue(table)
    fold = remainder(F.col("doc_id"), 7)
    got = score_texts(df, ~F.coalesce(fold == 2, F.lit(False)), fold == 3, held=fold == 2).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    expected = sorted(plain_scores(rows, rounded=True))
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert np.allclose([r[2] for r in got], [r[2] for r in expected], rtol=1e-6)
    exact = sorted(plain_scores(rows, rounded=False))
    assert math.isclose(sum(r[2] for r in got), sum(r[2] for r in exact), rel_tol=2e-3)  # what the rounding costs


# Nearest centroids.


def trigrams(text):
    """Places of the trigrams of bytes that begin or are centred in a word, with how often each occurs."""
    folded = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (text or "").encode())
    padded, places = b" " + folded + b" ", collections.Counter()
    for i in range(len(folded)):
        if padded[i] != 32 or padded[i + 1] != 32:
            code = int.from_bytes(padded[i : i + 3], "little")
            places[(code * 2654435761) % 2**32 >> 19] += 1
    return places


def direction(places, idf):
    vector = {p: math.sqrt(n) * idf[p] for p, n in places.items()}
    length = math.sqrt(sum(x * x for x in vector.values()))
    return {p: x / length for p, x in vector.items()}


def cosines(vector, model):
    return [sum(x * float(c[p]) for p, x in vector.items()) for c in model.centroids]


def test_predictions_of_nearest_centroids(spark, docs):
    """Inverse document frequencies and thresholds of a fit, and language, score and rejection of every text."""
    odd = [(-1, None, "en"), (-2, "", "de"), (-3, "12 .,", "en"), (-4, "é", "fr"), (-5, "A", None), (-6, "word " * 30_000, "en"), (UNSEEN, "quxzj vvkq", "en")]
    df = docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(odd, "doc_id bigint, text string, lang string"))
    model = centroids.fit(df, remainder(F.col("doc_id"), 3) != 1)
    rows = df.collect()
    letters = lambda text: any(c.isascii() and c.isalpha() or ord(c) > 127 for c in text or "")
    learnt = {(r.doc_id, r.text): r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and letters(r.text)}
    assert max(collections.Counter(r.lang for r in learnt.values()).values()) < centroids.PER_LANGUAGE  # so the sample is everything
    known = [trigrams(r.text) for r in learnt.values()]
    frequency = collections.Counter(p for places in known for p in places)
    idf = [math.log((1 + len(known)) / (1 + frequency[p])) + 1 for p in range(centroids.DIMS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert set(model.langs) == {r.lang for r in learnt.values()} and model.langs == sorted(model.langs)
    assert max(collections.Counter(model.langs).values()) <= centroids.CENTROIDS
    assert np.allclose((model.centroids**2).sum(1), 1, atol=1e-5)
    reached = collections.defaultdict(list)
    for places in known:
        reached[sum(places.values()).bit_length()].append(max(cosines(direction(places, idf), model)))
    least, level = [], 0.0
    for size in range(64):
        own = sorted(reached[size])
        if len(own) >= 10:
            at = (len(own) - 1) * 0.01
            level = max(level, own[int(at)] + (at - int(at)) * (own[int(at) + 1] - own[int(at)]))
        least.append(level)
    assert np.allclose(model.least, least, atol=1e-4)
    got = {r.row.doc_id: r for r in centroids.predict(df, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        told = got[r.doc_id]
        if not any(map(str.isalpha, r.text or "")):
            assert (told.lang_pred, told.score, told.rejected) == ("und", 0.0, True)
            continue
        places = trigrams(r.text)
        near = cosines(direction(places, idf), model)
        assert math.isclose(told.score, min(max(near), 1), abs_tol=1e-4)
        assert near[model.langs.index(told.lang_pred)] <= max(near)
        assert max(c for c, lang in zip(near, model.langs) if lang == told.lang_pred) > max(near) - 1e-4
        limit = centroids.SLACK * least[sum(places.values()).bit_length()]
        assert told.rejected == (max(near) < limit) or abs(max(near) - limit) < 1e-4
    assert got[UNSEEN].score < got[-6].score


# Weak supervision.


def plain_reliabilities(counts, rounds=50):
    """Expectation-maximisation over vote patterns with loops alone: rates of yes by class, priors, likelihoods."""
    labelers, kinds = range(private_spans.LABELERS), range(len(private_spans.KINDS))
    right, prior = [[0.3 for _ in labelers], [0.8 for _ in labelers]], [0.5 for _ in kinds]

    def likelihood(kind, pattern):
        of = []
        for y, p in ((0, 1 - prior[kind]), (1, prior[kind])):
            for i in labelers:
                p *= 1 if pattern[i] == "-" else right[y][i] if pattern[i] == "1" else 1 - right[y][i]
            of.append(p)
        return of[1] / sum(of)

    for _ in range(rounds):
        p = [likelihood(k, v) for k, v, _ in counts]
        for y in (0, 1):
            share = [n * (x if y else 1 - x) for x, (_, _, n) in zip(p, counts)]
            for i in labelers:
                yes = sum(s for s, (_, v, _) in zip(share, counts) if v[i] == "1")
                voted = sum(s for s, (_, v, _) in zip(share, counts) if v[i] != "-")
                right[y][i] = (yes + (4 if y else 1)) / (voted + 5)
        for kind in kinds:
            own = [(x * n, n) for x, (k, _, n) in zip(p, counts) if k == kind]
            prior[kind] = (sum(x for x, _ in own) + 2) / (sum(n for _, n in own) + 4)
    return right, prior, [likelihood(k, v) for k, v, _ in counts]


def test_reliabilities_and_classifier():
    """The rates are those of plain loops, and the classifier is the one minimum of its penalised loss."""
    rnd, tally = random.Random(8), collections.Counter()
    for _ in range(3000):
        kind, true = rnd.randrange(4), rnd.random() < 0.7
        good = (0.95, 0.9, 0.7, 0.6, 0.85, 0.8)
        vote = "".join("-" if rnd.random() < 0.2 else "01"[true if rnd.random() < g else not true] for g in good)
        tally[kind, vote + str(rnd.randrange(10))] += 1
    counts = sorted((k, v, n) for (k, v), n in tally.items())
    assert len(counts[0][1]) == private_spans.LABELERS + 1
    model = private_spans.learn(counts)
    right, prior, likely = plain_reliabilities(counts)
    assert np.allclose(model.right, right, atol=1e-8) and np.allclose(model.prior, prior, atol=1e-8)
    assert right[1][0] > right[1][3] and right[0][0] < right[0][3]  # the better labeler is found to be better
    slope = np.array(model.weights)
    for (kind, vote, n), y in zip(counts, likely):
        x = private_spans._features(kind, vote)
        assert x.sum() == 3 + sum(v != "-" for v in vote[:-1])  # constant, kind, votes, length
        p = 1 / (1 + math.exp(-float(x @ model.weights)))
        slope += n * (p - y) * x
        assert model.accepts(kind, vote) == (p >= private_spans.ACCEPT)
    assert np.abs(slope).max() < 1e-6


def test_patterns_are_counted_over_all_texts(spark):
    """The model of a table is that of its candidates' patterns, texts repeated and NULL included."""
    texts = ["mail a.b@example.org now", "call +1 555 123 4567, host 10.0.0.1", None, "", "mail a.b@example.org now", "x (555) 123-4567 y", "4111 1111 1111 1111"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tally = collections.Counter((k, v) for t in texts for k, _, _, _, v in private_spans.candidates(t or ""))
    expected = private_spans.learn(sorted((k, v, n) for (k, v), n in tally.items()))
    got = private_spans.fit(df)
    assert np.allclose(got.right, expected.right) and np.allclose(got.weights, expected.weights) and sum(tally.values()) == 6
