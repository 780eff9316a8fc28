"""Row-multiplying text operators (DataFrame -> DataFrame)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def chunk_text(df: DataFrame, col: str, n: int = K.EMBED_MAX_LENGTH) -> DataFrame:
    """Split text into pieces of at most n characters, one row each; the first
    is titled 'Output', the rest 'Continued Output'. Empty text gives no row.
    (The stripped text itself is chunked.)"""
    s = F.col(col)
    k = F.floor((F.length(s) + (n - 1)) / n).cast("int")
    idx = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(idx, lambda i: F.substr(s, i * n + 1, F.lit(n)))
    return (df.select("*", F.posexplode(pieces).alias("chunk_idx", "chunk"))
            .withColumn("title", F.when(F.col("chunk_idx") == 0, F.lit(K.OUTPUT_TITLE)).otherwise(F.lit(K.CONTINUED_TITLE))))
