"""The corpus pipeline: quality filter, near-duplicate removal, benchmark
decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import saved, table, vocabulary_path
from parlance.llm.decontaminate import without_contaminated
from parlance.llm.packing import pack_documents
from parlance.llm.quality import score_quality, train_quality
from parlance.llm.simhash_bk import near_groups
from parlance.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier scores 0.5 or more."""
    ship_package(spark)
    weights = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), weights).filter("score >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every SimHash component, with or without ids: of its smallest
    id (of those without one, if it has none) the text of smallest MD5, once.
    Rows are told apart by id and text, so rows without an id, and different texts
    of one id, stay or go by their own component, alike on a rerun."""
    ship_package(spark)
    rows = docs.select(*COLUMNS, F.concat_ws(":", F.md5("text"), F.col("doc_id").cast("string")).alias("key"))     # never null
    groups = near_groups(rows, keep=("key",))
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("key").alias("key")).select("key")
    # rows of one key meet as the join deals them: texts are shuffled once
    one = rows.join(kept, "key").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return one.select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose own text holds a benchmark item within its edit budget."""
    ship_package(spark)
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 2048 ids."""
    ship_package(spark)
    pieces = pack_documents(docs, vocabulary_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No stage's decisions can be said in SQL: a trained model, XXH64 fingerprints,
#: edit distances to any passage, a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
