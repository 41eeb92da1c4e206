"""Operators over messages, pages and vectors, and the pipeline, against plain Python and SQL."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mendline.llm import captures, pivots, quotes, vantage
from mendline.llm.oracle import ORACLE
from mendline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def held_against_sql(df, connection):
    result = connection.execute(ORACLE["op4_quotation_links"])
    assert [c[0] for c in result.description] == df.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, result.fetchall()))


def test_quotes_of_the_table(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = QUERIES["op4_quotation_links"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    held_against_sql(df, connection)


def test_made_up_quotes(spark):
    rnd, rows = random.Random(3), []
    passages = ["Hello there\nfriend", "What  is\tit?", "Écrit ça", "I AGREE", "x", "On Monday B wrote:", "", "   ", " lead"]
    for c in range(40):
        texts = []
        for t in range(rnd.randint(1, 9)):
            parts = []
            for _ in range(rnd.randint(0, 5)):
                p, level = rnd.choice(passages), rnd.randint(0, 3) if rnd.random() < 0.6 else 0
                if texts and rnd.random() < 0.4:
                    p, level = rnd.choice(texts), 1
                parts.append("\n".join(rnd.choice(["> ", ">", " > "]) * level + x for x in p.split("\n")))
            texts.append(rnd.choice(["\n", "\n\n", "\r\n"]).join(parts))
            some = lambda x: x if rnd.random() < 0.97 else None
            rows.append((some(c), some(t), rnd.choice(["user", None]), some(texts[-1])))
    rows += rows[:20]
    names = ["conv_id", "turn", "role", "text"]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    connection = duckdb.connect()
    connection.register("conversations", pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64", "turn": "Int64"}))
    got = quotes.reply_order(df.withColumn("body", F.lit(1)).withColumn("depth", F.lit("x")))
    held_against_sql(got, connection)
    assert got.agg(F.max("depth")).first()[0] >= 2
    assert quotes.reply_order(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 1, "u", "> a b c\nfoo\n\n" * 5000)], df.schema)
    assert quotes.reply_order(long).first().n_quotes == 5000
    deep = spark.createDataFrame([(1, 1, "u", "> " * 50_000 + "a")], df.schema)
    assert quotes.reply_order(deep).first().max_level == 50_000


@pytest.mark.parametrize("name,table", [("op2_suffix_decontamination", "documents benchmark"), ("op6_capture_index", "pages")])
def test_sql_of_whole_tables(spark, name, table):
    connection = duckdb.connect()
    for one in table.split():
        connection.execute(f"CREATE VIEW {one} AS SELECT * FROM '{SF}/{one}.parquet'")
    result, df = connection.execute(ORACLE[name]), QUERIES[name](spark, SF)
    assert [c[0] for c in result.description] == df.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, result.fetchall()))


def plain_captures(rows):
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    for r in rows:
        data, f = (r.html or "").encode(), first.get(r.html or "")
        again = f is not None and f != r.page_id
        yield r.page_id, len(data), captures.base32_sha1(data), "revisit" if again else "response", f if again else None


@pytest.mark.parametrize("lines", [256, 2])
def test_captures(monkeypatch, spark, lines):
    monkeypatch.setattr(captures, "SHARD_LINES", 10 * lines)
    rows = [
        (1, "http://a.com/x", "<p>"), (2, "http://A.com/x", "<p>"), (3, None, None), (None, "u", ""), (4, "https://b.c:8080/?q=1#z", "é" * 100_000),
        (4, "https://b.c:8080/?q=1#z", "other"), (1, "http://a.com/x", "<p>"), (5, "", ""), (None, None, "zz"), (6, "x\ty\nz", "\r\n\r\n"),
    ]
    small = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for df in (small, spark.read.parquet(f"{SF}/pages.parquet"), small.limit(0)):
        got = captures.archive_and_read(df.withColumn("key", F.lit("k")))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_captures(df.collect())))


def test_small_payloads_are_never_revisits(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.b/1", "xy"), (2, "a.b/2", "xy"), (3, "a.b/3", "long one"), (4, "a.b/4", "long one")], "page_id bigint, url string, html string")
    made = captures.write_archives(df, f"{tmp_path}/warc", least_bytes=3)
    shards = captures.build_index(made, f"{tmp_path}/index")
    got = captures.look_up(df, shards, f"{tmp_path}/index", f"{tmp_path}/warc").collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: None, 4: 3}
    none = captures.look_up(df.selectExpr("page_id", "'no.where' AS url"), shards, f"{tmp_path}/index", f"{tmp_path}/warc")
    assert none.count() == 0


def nearest_of(rows, k, queries):
    fine = [(i, np.array(x, dtype=float)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    for q in sorted({i for i, _ in fine if queries(i)}):
        x = next(x for i, x in fine if i == q)
        found = sorted((float(np.sqrt(np.square(x - y).sum())), i) for i, y in fine if i != q and len(y) == len(x))[:k]
        yield from ((q, r + 1, i, pytest.approx(d)) for r, (d, i) in enumerate(found))


@pytest.mark.parametrize("shard,leaf", [(20_000, 128), (60, 4)])
def test_nearest(monkeypatch, spark, shard, leaf):
    monkeypatch.setattr(vantage, "SHARD", shard)
    monkeypatch.setattr(vantage, "LEAF", leaf)
    monkeypatch.setattr(vantage, "QUERY_BLOCK", 3 if leaf == 4 else 20_000)
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=6).round(1).tolist()) for i in range(150)] + [(200 + i, [1.0] * 6) for i in range(60)]
    rows += [(300, None), (310, []), (320, [0.0] * 6), (330, [1.0, None]), (340, [float("nan")] * 6), (350, [float("inf")] * 6), (360, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = vantage.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == list(nearest_of(rows, 10, lambda i: i % 10 == 0))
    assert vantage.nearest(df.limit(0), F.lit(True)).count() == 0
    assert vantage.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_tied_distances(monkeypatch):
    """Pairs of equal unit vectors, all others equally far: no split halves them, and leaves stay large."""
    monkeypatch.setattr(vantage, "LEAF", 2)
    monkeypatch.setattr(vantage, "PAIRS", 500)
    vectors = np.repeat(np.eye(300), 2, axis=0)
    vectors = np.concatenate([vectors, np.tile(vectors[:1], (400, 1))])
    ids = np.arange(len(vectors))
    best = vantage.Best(ids[::7], vectors[::7], 5)
    best.search(vantage.Tree(ids, vectors), 1.0)
    away = np.sqrt(np.square(vectors[::7, None] - vectors[None]).sum(2))
    away[np.arange(len(away)), ids[::7]] = np.inf
    expected = np.lexsort((np.broadcast_to(ids, away.shape), away), axis=-1)[:, :5]
    assert (best.ids == expected).all()


def test_recall_of_a_relaxed_search(spark):
    df = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    found = {f: {(r.query_id, r.vec_id) for r in vantage.nearest(df, F.col("vec_id") % 100 == 0, factor=f).collect()} for f in (1.0, 3.0)}
    assert len(found[1.0] & found[3.0]) >= 0.9 * len(found[1.0])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, stage(spark, step, SF).cache()
        assert step.columns == docs.columns, name
        assert {r.doc_id for r in step.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert kept == {r.doc_id for r in step.select("doc_id").collect()}
    assert docs.count() * 0.75 <= len(kept) < docs.count()
    hit = QUERIES["op2_suffix_decontamination"](spark, SF).where("contaminated")
    assert not kept & {r.doc_id for r in hit.collect()}
    assert step.where(r"text RLIKE '[A-Za-z0-9]@[a-z0-9]+[.]example'").count() == 0
    prints = [r.bits for r in pivots.fingerprints(step).collect()]
    assert len(prints) == len(set(prints))


def test_pipeline_of_odd_rows(spark):
    rows = [(1, None, None, None, None, 1), (None, "", "en", "s", 0, 2), (2, "The of and thing", "en", None, 5, 3), (2, "The of and thing", "en", None, 5, 3), (3, "a" * 300_000, "en", "s", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __text string")
    for some in (docs, docs.limit(0)):
        step = some
        for name, stage in corpus_pipeline.STAGES:
            alone = stage(spark, some, SF)
            step = stage(spark, step, SF)
            assert alone.count() <= some.count() and step.count() <= some.count(), name
