"""Structured Streaming forms of moderation, timeouts, Gram accumulation and
admission control. Each is checked against its batch form.

Sinks and checkpoints live below the shared checkpoint folder
(``spark.checkpoint.dir``) so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission as A
from ..operators import gram as G
from ..operators import moderation as M
from ..session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **opts) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    for k, v in opts.items():
        r = r.option(k, v)
    return r.load(path)


def run_available(stream: DataFrame, name: str, mode: str = "append", foreach=None, base: str | None = None) -> str:
    """Run a streaming query over everything available, then stop; returns the
    sink folder (parquet) below the shared checkpoint folder. With ``base``, a folder of
    an earlier run, the query goes on where that one stopped."""
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    w = stream.writeStream.option("checkpointLocation", os.path.join(base, "_checkpoint")).outputMode(mode)
    if foreach is not None:
        q = w.foreachBatch(foreach).trigger(availableNow=True).start()
    else:
        q = w.format("parquet").option("path", os.path.join(base, "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return os.path.join(base, "out")


def moderate_stream(stream: DataFrame, rules: DataFrame, text: str = "text", scores=None) -> DataFrame:
    """Moderation is stateless: the batch expression applies to each micro-batch;
    the (size-checked) rules are fixed when the query is planned."""
    return M.moderate(stream, rules, text, scores) if scores is not None else M.moderate(stream, rules, text)


def timeout_stream(starts: DataFrame, finishes: DataFrame, limit_us: int, key: str = "user_id",
                   ts: str = "ts", ts_us: str = "ts_us", rid: str = "request_id",
                   watermark: str = "1 hour", clock: DataFrame | None = None) -> DataFrame:
    """One row per start, ``request_id, finish_id, finished``: its first finish of the same key
    in (start, start + limit], or a failure, told by the stream itself.

    The three inputs share one watermark, and a key's state holds its starts without an
    answer and the finishes that may still be one. A start is answered when the
    watermark has passed its first finish (no earlier one can come) or its limit; an
    event-time timer wakes a key that gets no more rows. Starts that are still open
    when a run ends stay in the state for the next run. ``clock`` (``ts``) tells the time
    without belonging to a key, to close what is open when no more events come. Ties in
    time go to the smaller finish id; rows behind the watermark are dropped by Spark.
    """
    def side(df, kind):
        return df.select(F.col(key).cast("long").alias("_key"), F.col(rid).cast("long").alias("_id"), F.col(ts_us).cast("long").alias("_us"),
                         F.col(ts).cast("timestamp").alias("_ets"), F.lit(kind).alias("_kind"))

    rows = side(starts, 0).unionByName(side(finishes, 1))
    if clock is not None:
        rows = rows.unionByName(clock.select(F.lit(None).cast("long").alias("_key"), F.lit(None).cast("long").alias("_id"),
                                             F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(ts).cast("timestamp").alias("_ets"), F.lit(2).alias("_kind")))

    def answer(_key, pdfs, state):
        from bisect import bisect_right

        import pandas as pd

        open_at, open_id, done_at, done_id = state.get if state.exists else ((), (), (), ())
        pending, done = list(zip(open_at, open_id)), list(zip(done_at, done_id))
        for pdf in pdfs:
            for us, i, kind in zip(pdf["_us"].tolist(), pdf["_id"], pdf["_kind"].tolist()):
                if kind < 2:
                    (done if kind else pending).append((int(us), int(i)))
        now = state.getCurrentWatermarkMs() * 1000
        pending.sort()
        done.sort()
        out, left, wake = [], [], None
        for at, i in pending:
            place = bisect_right(done, (at, float("inf")))
            found = done[place] if place < len(done) and done[place][0] <= at + limit_us else None
            known = found[0] if found else at + limit_us
            if known < now:
                out.append((i, found[1] if found else None, found is not None))
            else:
                left.append((at, i))
                wake = known if wake is None else min(wake, known)
        least = min(left[0][0], now) if left else now           # a start to come lies at the watermark or later
        done = [f for f in done if f[0] > least]
        if not left and not done:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(list(c) for c in (zip(*left) if left else ((), ()))) + tuple(list(c) for c in (zip(*done) if done else ((), ()))))
            wake = done[-1][0] if wake is None else wake
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            ids, finish, ok = zip(*out)
            yield pd.DataFrame({rid: list(ids), "finish_id": pd.array(finish, "Int64"), "finished": list(ok)})

    return (rows.withWatermark("_ets", watermark).groupBy("_key")
            .applyInPandasWithState(answer, f"{rid} long, finish_id long, finished boolean",
                                    "open_at array<bigint>, open_id array<bigint>, done_at array<bigint>, done_id array<bigint>", "append", "EventTimeTimeout"))


def gram_stream(stream: DataFrame, vec: str, d: int, state_path: str):
    """Accumulate a Gram matrix over micro-batches with ``foreachBatch``. Each
    batch's delta (i, j, s, m) is written to ``state_path/batch_id=<id>`` with
    overwrite, so a retried batch replaces itself (idempotent). Returns the
    foreachBatch function."""
    def per_batch(batch: DataFrame, batch_id: int):
        delta = G.gram_delta(batch, vec, d)
        delta.write.mode("overwrite").parquet(os.path.join(state_path, f"batch_id={batch_id}"))
    return per_batch


def merged_gram(spark: SparkSession, state_path: str) -> DataFrame:
    """The Gram matrix (i, j, h, n) of all stored deltas: what folding ``gram_merge`` over
    them comes to, 2 / n times their sum, in one aggregation."""
    cell = spark.read.parquet(state_path).groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("m").alias("n"))
    return cell.select("i", "j", (F.lit(2.0) / F.col("n").cast("double") * F.col("s")).alias("h"), "n")


def admission_stream(events: DataFrame, key: str = "user_id", ts: str = "ts_us", end: str = "end_us",
                     rid: str = "request_id", allow_queue: bool = False, max_queue: int | None = None,
                     watermark: str = "1 hour") -> DataFrame:
    """Per-user admission over a stream with ``applyInPandasWithState``; the state
    is the user's in-flight end times, the transition the batch one. Event time
    comes from the integer microseconds (time-zone free) and is watermarked;
    a user's state expires (event-time timeout) once its last in-flight request
    has ended, so the state store holds only users with work in flight."""
    cap = A.capacity(allow_queue, max_queue)
    fn = A.admission_state_fn(key, ts, end, rid, cap)
    ev = events.withColumn("_ets", F.timestamp_micros(F.col(ts))).withWatermark("_ets", watermark)
    return ev.groupBy(key).applyInPandasWithState(
        fn, f"{rid} long, {key} long, admitted boolean", "inflight array<bigint>", "append", "EventTimeTimeout")
