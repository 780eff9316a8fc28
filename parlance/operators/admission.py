"""Per-user admission control and request timeouts.

Admission is order dependent: whether a request is admitted depends on which
earlier ones were, a fold per user over events in time order. The batch job cuts
the order (user, time) into ranges and folds all of them at once, each from a guess:
nothing in flight. A range that goes on with a user whose earlier range leaves
requests in flight is folded again from those, and so on until no range's carry-in
changes. Busy users spread over as many ranges as their events fill. State is the
user's in-flight end times (at most ``max_queue`` of them). The streaming job runs the
same transition inside ``applyInPandasWithState``.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpointed, scratch_path

DEFAULT_MAX_QUEUE = 9999


def capacity(allow_queue: bool, max_queue: int | None) -> int:
    """Single mode admits one in-flight request; queue mode up to max_queue."""
    if not allow_queue:
        return 1
    return DEFAULT_MAX_QUEUE if max_queue is None else int(max_queue)


def transition(inflight: list, ts: int, end: int, cap: int) -> tuple[bool, list]:
    """One event: completions at or before ``ts`` leave first; then admit when
    fewer than ``cap`` requests remain in flight."""
    live = [e for e in inflight if e > ts]
    if len(live) < cap:
        live.append(end)
        return True, live
    return False, live


def _fold_ranges(cap: int, kind):
    """A mapInArrow function over ranges (``_range, _step, _key, _ts, _end, _carry, _row``, sorted):
    rows of step 0 bring in what is in flight, rows of step 1 are events. Gives
    every event with its decision, and a row for each range (step 2): its first key
    and time, its last key and what that one leaves in flight."""
    def run(batches):
        from heapq import heapify, heappop, heappush

        import pyarrow as pa

        at, first, key, live, brought = None, None, None, [], []

        def trailer(rows):
            return pa.RecordBatch.from_arrays([
                pa.array([at], pa.int32()), pa.array([2], pa.int32()), pa.nulls(1, rows), pa.nulls(1, pa.bool_()),
                pa.array([first[0]], kind), pa.array([first[1]], pa.int64()), pa.array([key], kind), pa.array([sorted(live)], pa.list_(pa.int64()))],
                names=names)

        names, rows = ["_range", "_step", "_row", "_admitted", "_first", "_first_ts", "_last", "_live"], None
        for b in batches:
            rows = b.schema.field(6).type
            admitted = []
            ranges, steps, keys, times, ends = (b.column(i).to_pylist() for i in range(5))
            for i, (r, step, k, ts, end) in enumerate(zip(ranges, steps, keys, times, ends, strict=True)):
                if r != at:
                    if first is not None:
                        yield trailer(rows)
                    at, first, brought = r, None, []
                if step == 0:
                    brought = b.column(5)[i].as_py()
                    admitted.append(None)
                    continue
                if first is None:
                    first, key, live = (k, ts), k, list(brought)
                    heapify(live)
                elif k != key:
                    key, live = k, []
                while live and live[0] <= ts:           # completions leave first
                    heappop(live)
                ok = len(live) < cap
                if ok:
                    heappush(live, end)
                admitted.append(ok)
            n = b.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(6), pa.array(admitted, pa.bool_()), pa.nulls(n, kind),
                                                  pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        if first is not None:
            yield trailer(rows)

    return run


def admission_control(events: DataFrame, key: str = "user_id", ts: str = "ts_us", end: str = "end_us",
                      allow_queue: bool = False, max_queue: int | None = DEFAULT_MAX_QUEUE,
                      tiebreak: str = "request_id", out: str = "admitted", method: str = "fold") -> DataFrame:
    """Adds ``admitted`` per event (events must carry ``end``, when an admitted
    request would leave the queue; at or before ``ts``: it leaves nothing behind).

    Speculative folds over ranges of (key, ts, tiebreak), see the module; one way for
    single and queue mode and for keys of any size. A repair folds again only the
    ranges whose carry-in differs from the one they were folded with; the driver
    sees a hash a range. A null key is a key of its own. ``method="jump"`` takes
    ``admission_single_jump`` for single mode instead."""
    cap = capacity(allow_queue, max_queue)
    if method == "jump" and cap == 1:
        return admission_single_jump(events, key, ts, end, tiebreak, out)
    spark = events.sparkSession
    kind = events.schema[key].dataType
    row = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_step", T.IntegerType()),
                        T.StructField("_row", T.StructType(events.schema.fields)), T.StructField("_admitted", T.BooleanType()),
                        T.StructField("_first", kind), T.StructField("_first_ts", T.LongType()), T.StructField("_last", kind),
                        T.StructField("_live", T.ArrayType(T.LongType()))])
    fold = _fold_ranges(cap, to_arrow_type(kind))

    def folded(ranges: DataFrame) -> DataFrame:
        path = scratch_path(spark, "admission")
        ranges.mapInArrow(fold, row).write.option("compression", "zstd").parquet(path)
        return spark.read.schema(row).parquet(path)

    whole = F.struct(*events.columns)
    none = F.array().cast("array<bigint>")
    sliced = (events.select(F.lit(1).alias("_step"), F.col(key).alias("_key"), F.col(ts).cast("long").alias("_ts"), F.col(end).cast("long").alias("_end"),
                            none.alias("_carry"), whole.alias("_row"), F.col(tiebreak).alias("_tie"))
              .repartitionByRange("_key", "_ts", "_tie").sortWithinPartitions("_key", "_ts", "_tie").withColumn("_range", F.spark_partition_id()))
    order = ["_range", "_step", "_key", "_ts", "_end", "_carry", "_row"]
    versions = [folded(sliced.select(*order))]
    latest: dict[int, int] = {}                         # range -> the fold that holds its last word
    used: dict[int, int | None] = {}
    while True:
        trailers = versions[-1].filter("_step = 2").select("_range", "_first", "_first_ts", "_last", "_live")
        ends = _saved_trailers(trailers if len(versions) == 1 else trailers.unionByName(
            ends.join(trailers.select("_range"), "_range", "left_anti")))
        follows = Window.orderBy("_range")              # a row a range
        carries = (ends.withColumns({"_before": F.lag("_last").over(follows), "_carry": F.lag("_live").over(follows), "_at": F.lag("_range").over(follows)})
                   .filter(F.col("_at").isNotNull() & F.col("_before").eqNullSafe(F.col("_first")))
                   .select("_range", F.col("_first").alias("_key"), F.array_sort(F.filter("_carry", lambda e: e > F.col("_first_ts"))).alias("_carry")))
        now = {r["_range"]: r["h"] for r in carries.select("_range", F.when(F.size("_carry") > 0, F.xxhash64("_carry")).alias("h")).collect()}
        changed = [r for r, h in now.items() if used.get(r) != h]
        if not changed:
            break
        used |= {r: now[r] for r in changed}
        events_of = versions[0].filter("_step = 1").filter(F.col("_range").isin(changed))
        cells = events_of.select("_range", "_step", F.col(f"_row.{key}").alias("_key"), F.col(f"_row.{ts}").cast("long").alias("_ts"), F.col(f"_row.{end}").cast("long").alias("_end"),
                                 none.alias("_carry"), "_row", F.col(f"_row.{tiebreak}").alias("_tie"))
        heads = carries.filter(F.col("_range").isin(changed)).select(
            "_range", F.lit(0).alias("_step"), "_key", F.lit(None).cast("long").alias("_ts"), F.lit(None).cast("long").alias("_end"), "_carry",
            F.lit(None).cast(row["_row"].dataType).alias("_row"), F.lit(None).cast(events.schema[tiebreak].dataType).alias("_tie"))
        again = cells.unionByName(heads).repartition("_range").sortWithinPartitions("_range", "_step", "_key", "_ts", "_tie")
        latest |= dict.fromkeys(changed, len(versions))
        versions.append(folded(again.select(*order)))

    parts = []
    for i, v in enumerate(versions):
        mine = [r for r, at in latest.items() if at == i]
        events_of = v.filter("_step = 1")
        parts.append(events_of.filter(~F.col("_range").isin(list(latest))) if i == 0 and latest else events_of if i == 0 else events_of.filter(F.col("_range").isin(mine)))
    return reduce(DataFrame.unionByName, parts).select("_row.*", F.col("_admitted").alias(out))


def _saved_trailers(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "ranges")
    df.coalesce(1).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def admission_state_fn(key_col: str, ts: str, end: str, id_col: str, cap: int):
    """``applyInPandasWithState`` function: same transition, state = in-flight ends.
    Events of a micro-batch are applied in time order; an event older than the
    user's last applied event is applied on arrival (no reordering across
    batches). The state times out at the user's last in-flight end (event
    time), so idle users leave the state store once the watermark passes it."""
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        inflight = list(state.get[0]) if state.exists else []
        parts = [pdf for pdf in pdfs]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values([ts, id_col], kind="stable")
        adm = []
        for t, e in zip(pdf[ts].to_numpy(), pdf[end].to_numpy()):
            a, inflight = transition(inflight, int(t), int(e), cap)
            adm.append(a)
        state.update((inflight,))
        if inflight:
            state.setTimeoutTimestamp(int(max(inflight)) // 1000)   # ms, same epoch as the watermark
        yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), key_col: pdf[key_col].to_numpy(), "admitted": adm})
    return fn


def first_after(left: DataFrame, right: DataFrame, key: str, ts: str, rid: str, within: int,
                out_ts: str = "next_ts", out_id: str = "next_id") -> DataFrame:
    """As-of join: for each left row, the first right row of the same key with a
    strictly later ``ts`` if it lies within ``within`` (same units as ts).

    Time is cut into buckets of width ``within``; a match lies in the left row's
    bucket or the next one. Inside a (key, bucket) window a descending running
    min finds the next right row; the next bucket's first right row comes from
    a per-bucket aggregate joined on (key, bucket + 1). No pairs are formed, and
    a hot key is split over its time buckets.
    """
    lcols = left.columns
    l2 = left.select(*lcols, F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_rid"))
    r2 = right.select(*[F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in (key, ts) else F.col(c)
                        for c in lcols], F.lit(1).alias("_kind"), F.col(rid).cast("bigint").alias("_rid"))
    u = l2.unionByName(r2).withColumn("_b", F.floor(F.col(ts) / within))
    w = (Window.partitionBy(key, "_b").orderBy(F.col(ts).desc())
         .rangeBetween(Window.unboundedPreceding, -1))
    nxt = F.min(F.when(F.col("_kind") == 1, F.struct(F.col(ts).alias("t"), F.col("_rid").alias("i")))).over(w)
    same = u.withColumn("_n1", nxt).filter(F.col("_kind") == 0)
    heads = (right.withColumn("_b", F.floor(F.col(ts) / within) - 1)
             .groupBy(key, "_b").agg(F.min(F.struct(F.col(ts).alias("t"), F.col(rid).cast("bigint").alias("i"))).alias("_n2")))
    j = same.join(heads, on=[key, "_b"], how="left")
    cand = F.coalesce(F.col("_n1"), F.col("_n2"))
    ok = cand.isNotNull() & (cand["t"] <= F.col(ts) + within)
    return (j.withColumn(out_ts, F.when(ok, cand["t"])).withColumn(out_id, F.when(ok, cand["i"]))
            .select(*lcols, out_ts, out_id))


def request_timeout(starts: DataFrame, finishes: DataFrame, limit: int, key: str = "user_id",
                    ts: str = "ts_us", rid: str = "request_id") -> DataFrame:
    """A request must finish within ``limit`` of starting: match each start with
    the first later finish of the same key; unmatched or late starts fail."""
    m = first_after(starts, finishes, key, ts, rid, limit, "finish_ts", "finish_id")
    return m.withColumn("finished", F.col("finish_id").isNotNull())


# ------------------------------------------------------------------ pointer jumping (single mode)

def first_at_or_after(queries: DataFrame, events: DataFrame, key: str, qcol: str, ts: str, rid: str,
                      width: int, out: str = "nxt") -> DataFrame:
    """As-of lookup with no distance limit: for each query row (key, qcol), the
    first event (by ts, then rid) of the same key with ``ts >= qcol``; where the query
    row has an ``_after``, of those at ``qcol`` only ids above it.

    Time is cut into buckets of ``width``. Inside a (key, bucket) window a
    descending running min finds the answer when it lies in the query's bucket;
    otherwise it is the first event of the next bucket that has one, read from
    a running min over the (much smaller) per-bucket table. Adds ``out``
    (struct<t, i> or null)."""
    q = queries.withColumn("_b", F.floor(F.col(qcol) / width))
    e = events.select(key, F.col(ts).alias("_t"), F.col(rid).cast("bigint").alias("_i")).withColumn("_b", F.floor(F.col("_t") / width))
    qc = q.columns
    u = (q.withColumn("_kind", F.lit(0)).withColumn("_t", F.col(qcol)).withColumn("_i", F.col("_after") if "_after" in qc else F.lit(None).cast("bigint"))
         .unionByName(e.withColumn("_kind", F.lit(1)), allowMissingColumns=True))
    w = (Window.partitionBy(key, "_b").orderBy(F.col("_t").desc(), F.col("_i").desc_nulls_last(), F.col("_kind"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ev = F.when(F.col("_kind") == 1, F.struct(F.col("_t").alias("t"), F.col("_i").alias("i")))
    inb = u.withColumn("_in", F.min(ev).over(w)).filter(F.col("_kind") == 0)
    heads = e.groupBy(key, "_b").agg(F.min(F.struct(F.col("_t").alias("t"), F.col("_i").alias("i"))).alias("_h"))
    qb = q.select(key, "_b").distinct().withColumn("_h", F.lit(None).cast(heads.schema["_h"].dataType))
    bt = heads.unionByName(qb).groupBy(key, "_b").agg(F.min("_h").alias("_h"))   # one row per bucket
    wb = Window.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = bt.withColumn("_later", F.min("_h").over(wb)).select(key, "_b", "_later")
    j = inb.join(later, on=[key, "_b"], how="left")
    return j.withColumn(out, F.coalesce(F.col("_in"), F.col("_later"))).select(*[c for c in qc if c != "_b"], out)


def admission_single_jump(events: DataFrame, key: str = "user_id", ts: str = "ts_us", end: str = "end_us",
                          rid: str = "request_id", out: str = "admitted") -> DataFrame:
    """Single mode (one request in flight) without a per-key fold.

    With nothing else in flight, an admitted request at ts blocks until its end;
    the next admitted one is the first later event at or after that end. So the
    admitted set is the chain ``root, nxt(root), nxt(nxt(root)), ...`` from each
    key's first event. ``nxt`` is an as-of lookup; the chain is found by
    pointer jumping: P_{k+1} = P_k ∘ P_k (log2(chain length) self-joins on the
    event id), then the set {nxt^m(root) : m < 2^K} is assembled from the
    roots with one join per level. Every join is keyed by event id, so a hot
    key is spread over all tasks. A request that ends by its own ``ts`` leaves
    nothing in flight: the next admitted one is the next event."""
    dmax = events.select(F.max(F.col(end) - F.col(ts))).first()[0]
    width = max(int(dmax or 1), 1)
    asked = events.select(key, rid, F.greatest(end, ts).alias("_free"), F.when(F.col(end) <= F.col(ts), F.col(rid).cast("bigint")).alias("_after"))
    nodes = first_at_or_after(asked, events, key, "_free", ts, rid, width, "nxt")
    p = checkpointed(nodes.select(F.col(rid).cast("bigint").alias("node"), F.col("nxt.i").alias("to")))
    levels = [p]
    while p.filter(F.col("to").isNotNull()).limit(1).count() > 0:
        if len(levels) > 64:
            raise ValueError("successor chain does not end: ids repeat within a key")
        r = p.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        p = checkpointed(p.join(r, on="to", how="left").select("node", F.col("to2").alias("to")))
        levels.append(p)
    roots = events.groupBy(key).agg(F.min(F.struct(F.col(ts), F.col(rid).cast("bigint").alias("i"))).alias("_r"))
    chain = checkpointed(roots.select(F.col("_r.i").alias("node")))
    for lv in reversed(levels):
        step = chain.join(lv, on="node").filter(F.col("to").isNotNull()).select(F.col("to").alias("node"))
        chain = checkpointed(chain.unionByName(step).distinct())
    flag = chain.select(F.col("node").alias("_n"), F.lit(True).alias("_adm"))
    return (events.join(flag, events[rid].cast("bigint") == flag["_n"], "left")
            .withColumn(out, F.coalesce(F.col("_adm"), F.lit(False))).drop("_n", "_adm"))
