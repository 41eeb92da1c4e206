"""Operators over documents, against plain Python and the public libraries."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import plain  # noqa: E402
from mendline.llm import byte_pairs, centroids, pivots, private_spans, suffixes, transducer  # noqa: E402
from mendline.llm.interpolation import maximise, score_texts  # noqa: E402
from mendline.llm.queries import QUERIES  # noqa: E402
from mendline.llm.store import remainder  # noqa: E402
from mendline.llm.words import NOT_SPACE, Words, slices, utf8  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, row string"
ODD = ["Ab  c", None, "", "  \t ", "Éa\tb\nfoo Ab", "x", "one two", "A b C d e f g h i j k", "A b C d e f g h i j k", "é" * 50, "<s> 3.4 \x00"]


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and very long texts, repeated rows, columns with names of results."""
    rows = [(i % 9 if i != 3 else None, t, "en", None, None, "n", "r") for i, t in enumerate(ODD)]
    rows.append((50, "word " * 40_000 + "é" * 200_000, None, "s", 1, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(rows, expected):
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, expected))


def test_words_of_columns():
    words = Words(*utf8(pa.array(ODD)), NOT_SPACE)
    got = [bytes(words.low[a:b]).decode() for a, b in zip(words.start, words.end)]
    assert got == [w for t in ODD for w in plain.words(t)]
    assert np.diff(words.first).tolist() == [len(plain.words(t)) for t in ODD]
    parts = list(slices([pa.record_batch({"text": pa.array(ODD)})], most=8))
    assert [t for p in parts for t in p.column("text").to_pylist()] == ODD and len(parts) > 3


def lm(rows):
    tokens = [(i, [*plain.words(t), " "]) for i, t in rows]
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 7
    seen = collections.Counter(w for i, t in tokens if fold(i) != 2 for w in t)
    n, v = sum(seen.values()), len(seen)
    for i, t in tokens:
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in t)
        yield i, fold(i) == 2, len(t), sum(seen[w] > 0 for w in t), n, round(base, 6)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_base_scores(request, spark, table):
    df = request.getfixturevalue(table)
    fold = remainder(F.col("doc_id"), 7)
    got = score_texts(df, ~F.coalesce(fold == 2, F.lit(False)), fold == 3, held=fold == 2).collect()
    same([(*r[:5], round(r[5], 6)) for r in got], lm(texts_of(df)))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_mixing_beats_the_base_on_held_out_texts(spark, docs):
    rows = QUERIES["op1_deleted_interpolation"](spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
    assert score_texts(docs.limit(0), F.lit(True), F.lit(True)).count() == 0
    assert {r.score for r in score_texts(docs.limit(5), F.lit(False), F.lit(True)).collect()} == {0.0}


def test_weights_follow_the_better_estimate():
    weights = maximise(np.array([3, 3, 5]), np.array([0.1, 0.2, 0.001]), np.array([0.001, 0.0, 0.5]), np.array([50.0, 50, 100]), 1000)
    assert weights[3].argmax() == 1 and weights[5].argmax() == 2
    assert np.allclose(weights.sum(1), 1) and weights[0][2] == 0 and (weights[:, 0] > 0).all()


@pytest.mark.parametrize("block_words", [400_000, 6])
def test_windows_of_items(monkeypatch, spark, odd, block_words):
    monkeypatch.setattr(suffixes, "BLOCK_WORDS", block_words)
    items = [(1, "a b c d e f g h i j k"), (2, "ONE two"), (None, "x"), (3, None), (4, "..."), (2, "one-two"), (7, "foo ab"), (8, "c d e f g h i j k l")]
    found = plain.windows(items)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = suffixes.match_items(odd, table).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    expected = []
    for i, text in texts_of(odd):
        n, hit, names = plain.hits(text, found)
        expected.append((i, n, hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0))
    same(got, expected)
    assert suffixes.match_items(odd, table.limit(0)).where("contaminated").count() == 0
    assert suffixes.match_items(odd.limit(0), table).count() == 0


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "p q a b c z"), (2, "a b c d x"), (3, "b c d")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, "a b c d e")], "item_id bigint, text string")
    got = suffixes.longest_matches(docs, items, window=2).collect()
    same(got, [("5", 0, 4, 2, 0), ("5", 1, 3, 2, 1), ("5", 2, 2, 2, 2), ("5", 3, 1, 2, 3)])


def test_longest_matches_of_any_length(spark):
    """Nine of twelve words, ties by id and word in one shard and over several, NULL and text ids, repeated rows."""
    nine = " ".join(f"w{i}" for i in range(9))
    docs = spark.createDataFrame([(7, f"x {nine} y"), (4, f"y y {nine}"), (None, "w1 w2"), (4, f"z {nine} {nine}")], "doc_id bigint, text string")
    items = spark.createDataFrame([("t", f"{nine} other words here"), ("none", None), ("", "unknown")], "item_id string, text string")
    got = {r.item_word: (r.length, r.doc_id, r.word) for r in suffixes.longest_matches(docs.coalesce(1), items).collect()}
    assert got == {i: (9 - i, 4, 1 + i) for i in range(9)}  # w8 alone stands first in row four, too
    rnd = random.Random(11)
    said = lambda most: " ".join(rnd.choices("abcd", k=rnd.randrange(most)))
    rows = [(rnd.choice([None, "9", "10", "k", "é"]), said(40)) for _ in range(60)] + [("10", None), ("k", "")]
    tests = [(str(i), said(15)) for i in range(12)]

    def plain(word, words):
        best = None
        for doc, text in rows:
            held = (text or "").split()
            for at in range(len(held)):
                n = 0
                while at + n < len(held) and word + n < len(words) and held[at + n] == words[word + n]:
                    n += 1
                told = (-n, doc is not None, (doc or "").encode(), at)
                if n and (best is None or told < best[0]):
                    best = told, (n, doc, at)
        return best and best[1]

    expected = {(i, w): found for i, text in tests for w in range(len(text.split())) if (found := plain(w, text.split()))}
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id string, text string").repartition(parts)
        got = suffixes.longest_matches(df, spark.createDataFrame(tests, "item_id string, text string"))
        assert {(r.item_id, r.item_word): (r.length, r.doc_id, r.word) for r in got.collect()} == expected
    assert suffixes.longest_matches(docs.limit(0), items).isEmpty() and suffixes.longest_matches(docs, items.limit(0)).isEmpty()


def brute_spans(text):
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (
                True,
                kind == 1 and all(int(x) <= 255 for x in m[0].split(".")),
                14 <= len(digits) <= 19 and private_spans.luhn(digits or "0"),
                10 <= len(digits) <= 15,
            )
            if fine[kind]:
                yield kind, *m.span()


def test_base_spans():
    rnd = random.Random(2)
    parts = ["1", "25", ".", "@", "a", "b.c", "-", " ", "+1", "(", ")", "é", "4111111111111111", "1.2.3.4", "@x.y"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert sorted(private_spans.base_spans(text)) == sorted(brute_spans(text))
    for part in ("a", "1", "1.", "@", "+1", "a@", "1 ", "(at)", "a:", "0", "(123"):
        private_spans.candidates(part * 100_000)
    assert len(private_spans.candidates("555-555-1234, 1.2.3.4 " * 50_000)) == 100_000
    for text in ("bob [at] mail.example.com. Please", "bob (at) mail [dot] example.com , x", "to bob [at] b. Then"):
        for _, a, b in private_spans.loose_spans(text):
            assert text[a:b].startswith("bob") and text[a:b].endswith("com")


def test_spans_of_tables(spark, docs, odd):
    added = "write to bob [at] mail [dot] example [dot] org or phone (687) 555-2224 now, v 1.2.3.4 é x@y.com"
    more = spark.createDataFrame([(900, added)], "doc_id bigint, text string")
    model = private_spans.fit(docs.select("doc_id", "text").unionAll(more))
    for df in (docs, odd, more, odd.limit(0)):
        texts = dict(texts_of(df))
        for r in private_spans.find_spans(df, model, redact=True).collect():
            if r.row.doc_id is None or list(texts).count(r.row.doc_id) != 1 or df is odd:
                continue
            base = sorted(brute_spans(texts[r.row.doc_id] or ""), key=lambda s: (s[1], s[0]))
            written = ",".join(f"{private_spans.KINDS[k]}:{a}:{b}" for k, a, b in base)
            assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
            assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
            assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)
    assert private_spans.find_spans(odd, model).count() == odd.count()
    got = private_spans.find_spans(more, model, redact=True).first()
    assert "x@y.com" not in got.redacted and got.n_email == 1
    assert private_spans.learn([]).prior.shape == (4,)


def simhash(text):
    w = plain.words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints_and_components(spark, docs, odd):
    for df in (docs, odd):
        rows = texts_of(df)
        prints = [simhash(t) for _, t in rows]
        roots = plain.components([(i, p) for (i, _), p in zip(rows, prints)])
        got = pivots.near_duplicates(df).select("row.doc_id", "fingerprint", "component_id").collect()
        same(got, [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, roots)])
        kept = [r.doc_id for r in pivots.deduplicate(df).collect()]
        assert len(kept) == len(set(plain.components(list(enumerate(prints)))))  # ids repeat in one table
        assert set(kept) <= set(roots)
    assert pivots.near_duplicates(odd.limit(0)).count() == pivots.deduplicate(odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [48, 2])
def test_links_of_fingerprints(monkeypatch, spark, most):
    monkeypatch.setattr(pivots, "MOST_PER_KEY", most)
    rnd = random.Random(4)
    values = {rnd.getrandbits(64) for _ in range(30)} | {0, 1, 2**63, 2**64 - 1}
    for v in list(values)[:12]:  # chains and crowds around some of them
        for _ in range(12):
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                v ^= 1 << b
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "bits bigint")
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    edges = pivots.links(df)
    assert all(near(r.a, r.b) for r in edges.collect())
    roots = {r.node: r.root for r in pivots.components(edges).collect()}
    expected = plain.components([(v, v & (2**64 - 1)) for v in signed])
    assert [roots.get(v, v) for v in signed] == expected


def test_languages(spark, odd):
    rows = QUERIES["op7_nearest_centroid"](spark, SF.replace("0.001", "0.01")).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.01 * len(rows)
    model = centroids.fit(odd, F.lit(True))
    got = centroids.predict(odd, model, ["doc_id", "text", "n_words"]).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.row.text or "")))
    nothing = centroids.fit(odd, F.lit(False))
    assert {r.lang_pred for r in centroids.predict(odd, nothing).collect()} == {"und"}
    assert centroids.predict(odd.limit(0), model).count() == 0


ALPHABET = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "ß", "中", "▁", "😀", ".", "...", "1", "<s>", "<|endoftext|>", "the ", "und ", "\x00", "\r\n", "A", "'s", "_", "​"]


def fuzz(n, seed=1):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return [*made, "", " ", "a" * 5000, " " * 1000, "é" * 700]


def test_transducer_counts(spark, docs, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = transducer.compiled(Path(path).read_bytes())
    texts = fuzz(3000)
    assert machine.count_texts(pa.array(texts), machine.cuts()).tolist() == [len(x) for x in library.encode(texts)]
    for df in (docs, odd, odd.limit(0)):
        got = transducer.count_tokens(df, path, most=100).select("row.doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        expected = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in texts_of(df)]
        same(got, [(*e, e[2] > 100) for e in expected])


def test_transducer_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(transducer, "MOST_STATES", 20)
    machine = transducer.Transducer({"a": -1.0, "b": -2.0, "ab": -3.0, "aba": -4.0, "▁": -5.0, "▁a": -6.0})
    for text in ("ababab", "aabb", " ab", "bab", "zé"):
        assert machine.count(text) == sum(len(p.encode()) if p not in machine.scores else 1 for p in machine.segment(text))


def test_byte_pairs(spark, docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_pairs.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_pairs.Coder(ranks, public_tokenizers.PATTERN)
    for text in fuzz(2000):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    for df in (docs, odd, odd.limit(0)):
        got = byte_pairs.encode_texts(df, path, public_tokenizers.PATTERN, ids=True)
        expected = []
        for i, t in texts_of(df):
            ids = library.encode_ordinary(t or "")
            digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            expected.append((i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest(), ids))
        same(got.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect(), expected)


def test_fold_of_higher_order_functions(spark):
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, "é".encode(): 260}
    words = [b"", b"a", b"abc", b"aaabcc", b"bcbc", "xéé".encode(), b"aaaaa"]
    df = spark.createDataFrame([(w,) for w in words], "w binary").withColumn("ids", byte_pairs.fold_column(F.col("w"), ranks))
    for r in df.withColumn("back", byte_pairs.decode_column(F.col("ids"), ranks)).collect():
        assert r.ids == (byte_pairs.merge(bytes(r.w), ranks) if r.w else []) and r.back == r.w


@pytest.mark.parametrize("ids", ["CAST(NULL AS bigint)", "7"])
def test_languages_of_rows_with_one_id(spark, ids):
    """More texts than are sampled, all with the same id or none."""
    texts = {"en": "the quick brown fox jumps over number", "de": "der schnelle braune Fuchs springt weit"}
    rows = spark.createDataFrame([(f"{t} {i}x{'abcdefghij'[i % 10]}", k) for k, t in texts.items() for i in range(60)], "text string, lang string")
    model = centroids.fit(rows.selectExpr(f"{ids} AS doc_id", "*").union(rows.selectExpr(f"{ids} AS doc_id", "*")), F.lit(True), per_language=20)
    assert set(model.langs) == set(texts)
    some = rows.selectExpr("lang", "xxhash64(text) AS mark")
    last = centroids._last_marks(some.union(some), 20)
    assert {k: sum(r.mark <= last[k] for r in some.collect() if r.lang == k) for k in texts} == {"en": 20, "de": 20}
