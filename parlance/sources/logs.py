"""Request / view logs and packed-weight stores as partitioned tables.

Writers append partitioned files below a shared folder; readers pass an
explicit schema (no inference) so key lookups prune partitions and push
filters into the scan instead of opening one file per record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UID_BUCKETS = 64

REQUEST_SCHEMA = ("uid bigint, short_id string, prompt string, output string, max_tokens int, "
                  "temperature double, top_p double, uid_bucket int")
VIEW_SCHEMA = ("message_id bigint, uid bigint, short_id_parent string, prompt string, "
               "prompt_input_element_custom_id string, time bigint, "
               "items array<struct<label:string,custom_id:string,row:int>>")
PACKED_SCHEMA = "matrix_id int, bits int, row bigint, word_idx int, word bigint"


def write_request_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON record per (uid, short_id), partitioned by a uid bucket."""
    (df.withColumn("uid_bucket", F.pmod(F.col("uid"), F.lit(UID_BUCKETS)).cast("int"))
       .select("uid", "short_id", "prompt", "output", "max_tokens", "temperature", "top_p", "uid_bucket")
       .write.mode(mode).partitionBy("uid_bucket").json(path))


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def lookup_request(log: DataFrame, uid: int, short_id: str) -> DataFrame:
    """Point lookup: the uid bucket prunes partitions, the rest is a pushed filter."""
    return log.filter((F.col("uid_bucket") == uid % UID_BUCKETS) & (F.col("uid") == uid)
                      & (F.col("short_id") == short_id))


def write_view_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append-only view store (nested items kept as array<struct>)."""
    df.write.mode(mode).parquet(path)


def read_view_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIEW_SCHEMA).parquet(path)


def write_packed(df: DataFrame, path: str, mode: str = "append") -> None:
    """Packed words, one row per word, partitioned by matrix and bit width."""
    df.select("matrix_id", "bits", "row", "word_idx", "word").write.mode(mode).partitionBy("matrix_id", "bits").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKED_SCHEMA).parquet(path)
