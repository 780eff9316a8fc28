"""Queries of this subpackage: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat_format, decontaminate, hash_forest, html_main, idpack, katz, packing, prefix_trie, quality, simhash_bk, token_counts, topk_pivot
from .common import table, vocabulary_path

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of two turns that hold the template's own marks."""
    hard = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    vocabulary = vocabulary_path(BPE)
    return chat_format.read_conversations(chat_format.format_conversations(turns, vocabulary), vocabulary)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, weights).select(
        "doc_id", (quality.doc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_id_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import scratch_path

    path = scratch_path(spark, "ids")
    idpack.write_ids(table(spark, sf_dir, "documents"), path, vocabulary_path(BPE))
    return idpack.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(PIECES))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_topk_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_pivot.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf_dir, "pages"))


def op11_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_report(table(spark, sf_dir, "documents"), vocabulary_path(BPE), vocabulary_path(PIECES))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


TOPK_SQL = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES: dict[str, tuple] = {
    "op1_chat_format": (op1_chat_format, None),
    "op2_packing": (op2_packing, None),
    "op3_katz": (op3_katz, None),
    "op4_decontaminate": (op4_decontaminate, None),
    "op5_quality": (op5_quality, None),
    "op6_id_pack": (op6_id_pack, None),
    "op7_simhash_bk": (op7_simhash_bk, None),
    "op8_token_counts": (op8_token_counts, None),
    "op9_topk_pivot": (op9_topk_pivot, TOPK_SQL),
    "op10_html_main": (op10_html_main, None),
    "op11_hash_forest": (op11_hash_forest, None),
    "op12_align": (op12_align, None),
    "op13_prefix_trie": (op13_prefix_trie, None),
}
