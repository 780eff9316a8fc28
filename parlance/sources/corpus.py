"""Corpus readers: Parquet, JSON lines (gzip-compressed or not) and plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", text: str = "text",
                key: str | None = "doc_id", schema: str | None = None) -> DataFrame:
    """Read a corpus as (doc_id, text, ...).

    ``fmt``: ``parquet``, ``json`` (one object per line; ``.gz`` files are
    decompressed transparently) or ``text`` (one document per line). When the
    source has no ``key`` column, ids are derived from the file name and the
    position inside the file, so reruns and retried tasks produce the same ids.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    elif fmt == "text":
        df = spark.read.text(path).withColumnRenamed("value", text)
    else:
        raise ValueError(f"unsupported corpus format {fmt}")
    if key and key not in df.columns:
        df = (df.withColumn("_file", F.input_file_name())
              .withColumn("_pos", F.monotonically_increasing_id()))
        # position inside each file, then files in name order: a dense, stable id
        w = Window.partitionBy("_file").orderBy("_pos")
        df = df.withColumn("_row", F.row_number().over(w) - 1)
        sizes = df.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
        offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        df = (df.join(offs, on="_file").withColumn(key, (F.col("_off") + F.col("_row")).cast("bigint"))
              .drop("_file", "_pos", "_row", "_off"))
    return df
