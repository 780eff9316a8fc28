"""Streaming queries: the driver tables read as file streams, run to completion
(available-now trigger), and returned as the sink table. Oracles are the
batch forms' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs as J
from ..session import scratch_path
from . import fixtures as X
from . import q_gram, q_moderation, q_quant, q_requests  # noqa: F401  (registers the batch oracles reused below)
from .registry import QUERIES, query

HOUR_US = 3600 * 1_000_000


def _stream_table(spark, sf_dir, name):
    schema = X.table(spark, sf_dir, name).schema
    # A file stream source watches a directory or a glob; this glob names the one table file.
    return J.read_stream(spark, f"{sf_dir}/{name}.parq[u]et", schema)


@query("moderate_stream", QUERIES["moderate"][1])
def q_moderate_stream(spark, sf_dir):
    docs = _stream_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = X.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    did = F.col("doc_id")
    scored = docs.join(lab, on="doc_id", how="left").select(
        "doc_id", "text",
        ((did % 100).cast("double") / 900.0).alias("sexual_explicit"),
        (((did * 7) % 100).cast("double") / 190.0).alias("obscene"),
        F.when(F.col("toxic") == 1, F.lit(0.9)).otherwise(F.lit(0.1)).alias("toxicity"),
        (((did * 13) % 100).cast("double") / 190.0).alias("severe_toxicity"),
        (((did * 29) % 100).cast("double") / 180.0).alias("identity_attack"))
    out = J.moderate_stream(scored, q_moderation.fx_rules(spark), "text").select("doc_id", "reason", "flagged")
    return spark.read.parquet(J.run_available(out, "moderate_stream"))


@query("timeout_stream", QUERIES["request_timeout"][1])
def q_timeout_stream(spark, sf_dir):
    def side(kind):
        ev = _stream_table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
        return ev.select(F.col("event_id").alias("request_id"), "user_id", "ts", X.epoch_us(F.col("ts")).alias("ts_us"))
    # a clock a day past the last event and its limit closes the stream
    path = scratch_path(spark, "clock")
    last = X.table(spark, sf_dir, "events").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY 6 HOURS")).alias("ts"))
    last.write.parquet(path)
    answers = J.timeout_stream(side("click"), side("purchase"), 6 * HOUR_US, clock=J.read_stream(spark, path, last.schema))
    return spark.read.parquet(J.run_available(answers, "timeout_stream")).select("request_id", "finish_id", "finished")


@query("gram_stream", QUERIES["gram_matrix"][1])
def q_gram_stream(spark, sf_dir):
    emb = _stream_table(spark, sf_dir, "embeddings")
    mat = emb.select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    state = scratch_path(spark, "gram_state")
    J.run_available(mat, "gram_stream", foreach=J.gram_stream(mat, "vec", q_quant.D, state))
    g = J.merged_gram(spark, state)
    return g.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("h", 9).alias("h"))


@query("admission_stream", QUERIES["admission_control"][1])
def q_admission_stream(spark, sf_dir):
    ev = _stream_table(spark, sf_dir, "events")
    req = ev.select(F.col("event_id").alias("request_id"), "user_id", X.epoch_us(F.col("ts")).alias("ts_us"))
    req = req.withColumn("end_us", F.col("ts_us") + 6 * HOUR_US)
    out = J.admission_stream(req)
    return spark.read.parquet(J.run_available(out, "admission_stream")).select("request_id", "user_id", "admitted")

