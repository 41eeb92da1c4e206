"""Lines, phrases and prefix tries of whole tables and of made-up ones, against SQL and plain Python."""

from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mendline.llm import collocations, prefix_trie, repeated_lines
from mendline.llm.arrays import field_bits, has, places, put
from mendline.llm.oracle import ORACLE
from mendline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, lang string, text string"


def rows_of_sql(name, **tables):
    connection = duckdb.connect()
    for table, rows in tables.items():
        connection.register(table, rows)
    result = connection.execute(ORACLE[name])
    return [c[0] for c in result.description], sorted(map(repr, result.fetchall()))


def frame(rows, names, **kinds):
    return pd.DataFrame(rows, columns=names).astype(kinds)


@pytest.mark.parametrize("name,table", [("op11_prefix_trie", "conversations"), ("op12_prefix_free_phrases", "documents"), ("op13_twice_seen_lines", "documents")])
def test_whole_tables(spark, name, table):
    df = QUERIES[name](spark, SF)
    names, expected = rows_of_sql(name, **{table: pd.read_parquet(f"{SF}/{table}.parquet")})
    assert names == df.columns
    assert sorted(repr(tuple(r)) for r in df.collect()) == expected


def test_bit_fields():
    rnd = np.random.default_rng(1)
    hashes = rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    field = np.zeros(field_bits(5000) // 8, np.uint8)
    put(field, places(hashes, len(field) * 8))
    assert has(field, hashes).all()
    assert has(field, rnd.integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.01


# Lines.


def lines_of(rows):
    """Plain version: documents are rows."""
    white, upper = " \t\n\v\f\r", {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(white).translate(upper)
    held = {}
    for i, (doc, _, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, []).append((doc is not None, doc or 0))
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    for doc, _, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in gone or gone[key(x)] == (doc is not None, doc or 0)]
        yield doc, len(lines), len(lines) - len(stay), "\n".join(stay)


def made_up_documents():
    rnd, rows = random.Random(4), []
    common = ["É" * 39, "é" * 40, "A line of exactly forty code points, yes!", "x" * 41, "  \t" + "Trim Me " * 9 + "\r", "short", "", " " * 40]
    for i in range(60):
        lines = [rnd.choice(common) if rnd.random() < 0.6 else f"only in document {i} " + "z" * rnd.randint(0, 40) for _ in range(rnd.randint(0, 9))]
        rows.append((i if rnd.random() < 0.9 else None, rnd.choice(["en", None]), "\n".join(x.upper() if rnd.random() < 0.3 else x for x in lines)))
    rows += [rows[3]] * 3 + [(59, "en", None), (61, "en", ""), (62, "de", "\n" * 5), (63, "en", "w" * 2_000_000), (64, "en", "w" * 2_000_000)]
    return rows + [(None, None, "seen only without an id, but five times over")] * 6 + [(65 + i, "en", "four documents hold this line, so it remains") for i in range(4)]


@pytest.mark.parametrize("bits", [1 << 29, 1 << 20])
def test_lines(spark, bits):
    rows = made_up_documents()
    df = spark.createDataFrame(rows, DOCS).repartition(7).withColumn("n_lines", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("nr", F.lit(2))
    got = repeated_lines.drop_repeated_lines(df, most_bits=bits)
    assert got.select("row.*").columns == df.columns
    found = got.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, lines_of(rows)))
    assert repeated_lines.drop_repeated_lines(df.limit(0)).count() == 0


def test_lines_when_the_field_is_full(monkeypatch, spark):
    """Every line is a suspect then, and the result is the same."""
    monkeypatch.setattr(repeated_lines, "has", lambda field, hashes: np.ones(len(hashes), dtype=bool))
    rows = made_up_documents()
    found = repeated_lines.drop_repeated_lines(spark.createDataFrame(rows, DOCS)).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, lines_of(rows)))


# Phrases.


@pytest.mark.parametrize("trigger", [1, 3, 1 << 40])
def test_phrases(spark, trigger):
    rnd, rows = random.Random(trigger), []
    words = ["a", "B", "ça", "über", "New", "York", "x" * 50, "1", " ", "\x00"]
    ends = [" ", " ", " ", " ", "\t", " , ", ".", "\n", "!? ", "\r\n", ";;"]
    for i in range(120):
        text = "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(0, 60)))
        rows.append((i, rnd.choice(["en", "de", None, ""]), rnd.choice([text, " " + text, "New York is ;" * 3 + text])))
    rows += [rows[5]] * 20 + [(None, None, None), (7, "fr", ""), (8, "en", " . , ")] + [(9, "en", "Lang " * 30_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("chunk", F.lit("k")).withColumn("a.b", F.lit(1))
    got = collocations.collocations(df.repartition(5), trigger=trigger)
    names, expected = rows_of_sql("op12_prefix_free_phrases", documents=frame(rows, ["doc_id", "lang", "text"], doc_id="Int64"))
    assert got.columns == names
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected
    assert len(expected) > 5
    assert collocations.collocations(df.limit(0)).count() == 0


def test_longer_phrases(spark):
    """Up to four words, against plain counts."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("a b c d e".split()) for _ in range(rnd.randint(0, 40))) for _ in range(80)]
    counts = {}
    for t in texts:
        w = t.split()
        for n in range(1, 5):
            for i in range(len(w) - n + 1):
                counts[tuple(w[i : i + n])] = counts.get(tuple(w[i : i + n]), 0) + 1
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], DOCS)
    known = collocations.frequent_phrases(collocations.parse(df, longest=4, trigger=3), 4, 10)
    found = {tuple(r.phrase.split()): r.f for r in known.where("size > 0").collect()}
    assert found == {k: f for k, f in counts.items() if f >= 10}
    best = collocations.collocations(df, longest=4, trigger=3).collect()
    held = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    frequent = [p for p in found if len(p) > 1]
    stay = {p for p in frequent if not any(len(q) > len(p) and held(p, q) and 100 * found[q] >= 50 * found[p] for q in frequent)}
    assert {tuple(r.phrase.split()) for r in best} == stay
    for r in best:
        p = tuple(r.phrase.split())
        assert r.score == min(1_000_000 * r.a**2 // (found[p[:k]] * found[p[k:]]) for k in range(1, len(p)))


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the score of a whole dictionary, given its weights."""
    chunks = [("en", "new york", True, 3_000_000_019), ("en", "new", True, 1_000_000_007), ("en", "york\nnew", True, 5)]
    dictionary = spark.createDataFrame(chunks, "lang string, chunk string, whole boolean, weight bigint")
    known = {r.phrase: r.f for r in collocations.frequent_phrases(dictionary).collect()}
    assert known == {"": 7_000_000_055, "new york": 3_000_000_019, "new": 4_000_000_031, "york": 3_000_000_024}


# Prefix tries.

TALKS = "conv_id bigint, turn bigint, role string, text string"


def made_up_talks(n=40, hot=0):
    rnd, rows = random.Random(n + hot), []
    for c in [*range(-150, -140), *range(95, 95 + n), *range(200, 210), 100, 1 << 40]:
        for t in range(rnd.choice([0, 1, 1, 2, 3, 5, 9, 14])):
            turn = rnd.choice([t, t, None]) if c % 7 == 0 else t
            rows.append((c, turn, rnd.choice(["user", None, ""]), rnd.choice(["hi", "ho", "é\n", None, ""])))
    for c in range(1000, 1000 + hot):  # one conversation that many hold
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    return rows + rows[:15] + [(None, 1, "user", "of nobody"), (150, 1, None, "long " * 200_000)]


@pytest.mark.parametrize("columns,hot", [(64, 0), (3, 700)])
def test_tries(monkeypatch, spark, columns, hot):
    monkeypatch.setattr(prefix_trie, "COLUMNS", columns)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 10)
    monkeypatch.setattr(prefix_trie, "SENT", 7)
    rows = made_up_talks(hot=hot)
    df = spark.createDataFrame(rows, TALKS).withColumn("turns", F.lit("x")).withColumn("a.b", F.lit(1))
    got = prefix_trie.prefix_nodes(prefix_trie.rebuilt(df))
    names = ["conv_id", "turn", "role", "text"]
    columns, expected = rows_of_sql("op11_prefix_trie", conversations=frame(rows, names, conv_id="Int64", turn="Int64"))
    assert got.columns == columns
    found = got.collect()
    assert sorted(repr(tuple(r)) for r in found) == expected
    assert max(r.depth for r in found) > 8
    assert prefix_trie.prefix_nodes(prefix_trie.rebuilt(df.limit(0))).count() == 0


def test_a_conversation_without_turns(spark):
    """Conversation 101 takes no more turns than it has from 100, which is absent: it ends at the root."""
    bare = next(c for c in range(101, 200) if crc32(str(c).encode()) % 6 > 0)
    one = prefix_trie.prefix_nodes(prefix_trie.rebuilt(spark.createDataFrame([(bare, 0, "user", "x")], TALKS))).collect()
    assert [tuple(r) for r in one] == [(bare, 0, None, 1, 0, 1, 0, sha256(str(bare).encode()).hexdigest())]


def test_long_conversations(spark):
    """A chain of 1,000 turns beside a thousand short ones stays a chain."""
    rows = [(100, t, "user", str(t)) for t in range(1000)] + [(c, 0, "user", f"t{c % 9}") for c in range(1000, 2000)]
    nodes = prefix_trie.prefix_nodes(prefix_trie.rebuilt(spark.createDataFrame(rows, TALKS)))
    assert nodes.agg(F.max("depth"), F.count("*")).first()[0] == 1000
    names, expected = rows_of_sql("op11_prefix_trie", conversations=frame(rows[990:], ["conv_id", "turn", "role", "text"]))
    short = prefix_trie.prefix_nodes(prefix_trie.rebuilt(spark.createDataFrame(rows[990:], TALKS)))
    assert sorted(repr(tuple(r)) for r in short.collect()) == expected
