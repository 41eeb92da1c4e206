"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_pairs import encode_texts
from .captures import archive_and_read
from .centroids import fit, predict
from .collocations import collocations
from .interpolation import score_texts
from .pivots import near_duplicates
from .prefix_trie import prefix_nodes, rebuilt
from .private_spans import find_spans
from .private_spans import fit as fit_spans
from .quotes import reply_order
from .repeated_lines import drop_repeated_lines
from .store import remainder
from .suffixes import match_items
from .transducer import count_tokens
from .vantage import nearest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from remainders other than 2; remainder 3 is deleted while weights are learned."""
    fold = remainder(F.col("doc_id"), 7)
    held = fold == 2
    return score_texts(_table(spark, sf_dir, "documents"), train=~F.coalesce(held, F.lit(False)), tune=fold == 3, held=held)


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of every benchmark item, looked up in every document."""
    found = match_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the labelers' reliabilities come from all documents."""
    docs = _table(spark, sf_dir, "documents")
    found = find_spans(docs, fit_spans(docs))
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, with what they answer."""
    return reply_order(_table(spark, sf_dir, "conversations"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and the components of those within two bits."""
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "fingerprint", "component_id", "n_copies")


def op6_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, and read back through the two-level index."""
    return archive_and_read(_table(spark, sf_dir, "pages"))


def op7_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from remainders other than 1, and names the language of every document."""
    docs = _table(spark, sf_dir, "documents")
    fold = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs, ~fold)
    found = predict(docs.withColumn("held_out", fold), model, ["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")


def op8_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all others, exactly."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in the vocabulary of 32,000 pieces."""
    found = count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by 50,256 ranks, and what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = encode_texts(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return prefix_nodes(rebuilt(_table(spark, sf_dir, "conversations")))


def op12_prefix_free_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language whose words go together most."""
    return collocations(_table(spark, sf_dir, "documents"))


def op13_twice_seen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five documents share, except where the largest id holds them."""
    found = drop_repeated_lines(_table(spark, sf_dir, "documents"))
    kept = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return found.select("row.doc_id", "n_lines", "n_dropped", kept)


QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_suffix_decontamination": op2_suffix_decontamination,
    "op3_weak_supervision": op3_weak_supervision,
    "op4_quotation_links": op4_quotation_links,
    "op5_simhash_pivots": op5_simhash_pivots,
    "op6_capture_index": op6_capture_index,
    "op7_nearest_centroid": op7_nearest_centroid,
    "op8_vantage_trees": op8_vantage_trees,
    "op9_transducer_counts": op9_transducer_counts,
    "op10_byte_pairs": op10_byte_pairs,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_prefix_free_phrases": op12_prefix_free_phrases,
    "op13_twice_seen_lines": op13_twice_seen_lines,
}
