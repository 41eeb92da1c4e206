"""From raw documents to token ids: five stages, each written as Parquet and read again.

1. ``language``: nearest-centroid identification; documents that it rejects go.
2. ``near_duplicates``: SimHash keys, verified by Jaccard similarity of five-word shingles; one document of each group stays.
3. ``decontaminate``: suffix arrays; documents that hold a window of a benchmark item go.
4. ``personal_data``: weak supervision; spans are replaced by the name of their kind.
5. ``byte_pairs``: byte-level BPE; ids of each text, and digests of the ids and of what they decode to.

A NULL or letterless text goes in the first stage; given to a later one, it is handled as that
stage's operator says. Further columns are kept up to the last stage, which returns ``doc_id, lang, source, n_tokens,
ids, ids_sha256, decoded_sha256``. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendline.llm.byte_pairs import encode_texts
from mendline.llm.centroids import fit as fit_languages
from mendline.llm.centroids import predict
from mendline.llm.private_spans import find_spans
from mendline.llm.private_spans import fit as fit_spans
from mendline.llm.similar import deduplicate
from mendline.llm.store import remainder, stored
from mendline.llm.suffixes import match_items


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _safe(docs: DataFrame) -> DataFrame:
    """``docs`` with every column that no stage reads named by its place, so that no name of a user's meets one of an operator's."""
    return docs.toDF(*(name if name in OWN else f"c{i}" for i, name in enumerate(docs.columns)))


def _columns(frame: DataFrame, safe: list[str], names: list[str]) -> DataFrame:
    return frame.select(*(F.col("row")[mine].alias(name) for mine, name in zip(safe, names)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnt, safe = F.coalesce(remainder(F.col("doc_id"), 3) != 1, F.lit(True)), _safe(docs)
    return _columns(predict(safe, fit_languages(safe, learnt), safe.columns).where("not rejected"), safe.columns, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe = _safe(docs)
    found = match_items(safe, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), safe.columns)
    return _columns(found.where("not contaminated"), safe.columns, docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe = _safe(docs)
    rest = [name for name in safe.columns if name != "text"]
    marked = safe.withColumn("no_text", F.col("text").isNull())
    found = find_spans(marked, fit_spans(safe), [*rest, "no_text"], redact=True)
    text = F.when(~F.col("row.no_text"), F.col("redacted"))
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return found.select(*(new.get(mine, F.col("row")[mine]).alias(name) for mine, name in zip(safe.columns, docs.columns)))


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_texts(_safe(docs), ranks, public_tokenizers.PATTERN, ["doc_id", "lang", "source"], ids=True)
    return coded.select("row.*", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("byte_pairs", byte_pairs),
]

#: SQL can express neither trained models nor merges; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
