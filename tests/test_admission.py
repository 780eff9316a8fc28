"""Admission control: transition rule, batch vs brute force, stream vs batch;
timeouts vs brute force; running sums with a hot key."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.operators import admission as A
from parlance.operators.scan import running_sums


def brute(events, cap):
    out, inflight = {}, {}
    for rid, user, ts, end in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        live = [e for e in inflight.get(user, []) if e > ts]
        ok = len(live) < cap
        if ok:
            live.append(end)
        inflight[user] = live
        out[rid] = ok
    return out


def sample_events(n=400, users=4, seed=0):
    rnd = random.Random(seed)
    ev = []
    for i in range(n):
        u = 0 if rnd.random() < 0.5 else rnd.randrange(1, users)   # user 0 is hot
        ts = rnd.randrange(0, 10_000)
        ev.append((i, u, ts, ts + rnd.randrange(1, 300)))
    return ev


def test_transition_completion_before_arrival():
    ok, st = A.transition([10], 10, 20, 1)     # completion at exactly ts frees the slot
    assert ok and st == [20]
    ok, st = A.transition([11], 10, 20, 1)
    assert not ok and st == [11]


def test_batch_matches_brute_force(spark):
    ev = sample_events()
    df = spark.createDataFrame(ev, "request_id long, user_id long, ts_us long, end_us long").repartition(3)
    for allow, mq, cap in ((False, None, 1), (True, 2, 2), (True, 5, 5)):
        got = {r.request_id: r.admitted for r in A.admission_control(df, allow_queue=allow, max_queue=mq).collect()}
        assert got == brute(ev, cap)


def test_stream_matches_batch(spark, tmp_path):
    from parlance.streaming import jobs as J
    ev = sample_events(200, seed=1)
    pdf = pd.DataFrame(ev, columns=["request_id", "user_id", "ts_us", "end_us"])
    src = tmp_path / "src"
    spark.createDataFrame(pdf).coalesce(1).write.parquet(str(src))
    schema = "request_id long, user_id long, ts_us long, end_us long"
    stream = spark.readStream.schema(schema).parquet(str(src))
    out = J.admission_stream(stream, allow_queue=True, max_queue=2)
    got = {r.request_id: r.admitted for r in spark.read.parquet(J.run_available(out, "t_adm")).collect()}
    assert got == brute(ev, 2)


def test_first_after_matches_brute_force(spark):
    rnd = random.Random(3)
    starts = [(i, rnd.randrange(3), rnd.randrange(0, 5000)) for i in range(150)]
    fins = [(1000 + i, rnd.randrange(3), rnd.randrange(0, 5000)) for i in range(150)]
    within = 300
    s = spark.createDataFrame(starts, "request_id long, user_id long, ts_us long")
    f = spark.createDataFrame(fins, "request_id long, user_id long, ts_us long")
    got = {r.request_id: r.finish_id for r in A.request_timeout(s, f, within).collect()}
    for rid, u, t in starts:
        later = sorted((ft, fid) for fid, fu, ft in fins if fu == u and ft > t)
        want = later[0][1] if later and later[0][0] <= t + within else None
        if later and later[0][0] <= t + within:
            # ties on time pick the smaller id
            want = min(fid for ft, fid in later if ft == later[0][0])
        assert got[rid] == want, rid


def test_running_sum_hot_key(spark):
    rnd = random.Random(4)
    rows = [(("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}"), i, rnd.randrange(10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): (r.cum, r.cnt) for r in running_sums(df.withColumn("one", F.lit(1)), ["k"], ["o"], {"cum": "v", "cnt": "one"}, inclusive=False).collect()}
    run, cnt = {}, {}
    for k, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        assert got[(k, o)] == (run.get(k, 0), cnt.get(k, 0))
        run[k], cnt[k] = run.get(k, 0) + v, cnt.get(k, 0) + 1


def test_single_mode_pointer_jumping_matches_brute_force(spark):
    for seed in (0, 5):
        ev = sample_events(300, seed=seed)
        df = spark.createDataFrame(ev, "request_id long, user_id long, ts_us long, end_us long")
        got = {r.request_id: r.admitted for r in A.admission_single_jump(df).collect()}
        assert got == brute(ev, 1)


@pytest.fixture
def many_ranges(spark):
    """Small tables would otherwise be coalesced to one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("cap", [1, 2, 7])
def test_one_user_without_a_gap_over_many_ranges(spark, many_ranges, cap):
    """Long overlapping requests of one user: what a range leaves in flight decides the
    next one's admissions, over all ranges."""
    rnd = random.Random(cap)
    ev = [(i, 0, ts := rnd.randrange(0, 3000), ts + rnd.choice([0, 1, 40, 700])) for i in range(900)]
    ev += [(1000 + i, rnd.randrange(1, 30), ts := rnd.randrange(0, 3000), ts + rnd.randrange(0, 900)) for i in range(300)]
    df = spark.createDataFrame(ev, "request_id long, user_id long, ts_us long, end_us long").repartition(4)
    got = A.admission_control(df, allow_queue=cap > 1, max_queue=cap)
    assert {r.request_id: r.admitted for r in got.collect()} == brute(ev, cap)
    assert got.columns == ["request_id", "user_id", "ts_us", "end_us", "admitted"]


def test_requests_that_end_when_they_start(spark, many_ranges):
    """end == ts, ties in time and a null user: both methods agree with the plain fold."""
    rnd = random.Random(6)
    ev = [(i, rnd.choice([0, 0, 1, None]), ts := rnd.randrange(0, 60), ts + rnd.choice([0, 0, 0, 5, 20])) for i in range(300)]
    df = spark.createDataFrame(ev, "request_id long, user_id long, ts_us long, end_us long").repartition(3)
    fixed = [(r, -1 if u is None else u, t, e) for r, u, t, e in ev]
    assert {r.request_id: r.admitted for r in A.admission_control(df).collect()} == brute(fixed, 1)
    some = df.filter("user_id is not null")
    want = {r: a for r, a in brute(fixed, 1).items() if ev[r][1] is not None}
    assert {r.request_id: r.admitted for r in A.admission_single_jump(some).collect()} == want


def test_admission_of_no_events(spark):
    assert A.admission_control(spark.createDataFrame([], "request_id long, user_id long, ts_us long, end_us long")).collect() == []


def test_running_sums_up_to_and_including(spark):
    rnd = random.Random(9)
    rows = [(("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(3)}"), i, rnd.randrange(10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long").withColumn("one", F.lit(1))
    got = {(r.k, r.o): (r.cum, r.cnt) for r in running_sums(df, ["k"], ["o"], {"cum": "v", "cnt": "one"}).collect()}
    run, cnt = {}, {}
    for k, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        run[k] = run.get(k, 0) + v
        cnt[k] = cnt.get(k, 0) + 1
        assert got[(k, o)] == (run[k], cnt[k])


def test_stream_state_expiry_across_batches(spark, tmp_path):
    from parlance.streaming import jobs as J
    minute = 60_000_000
    ev = [(rid, u, ts * minute, end * minute) for rid, u, ts, end in sample_events(300, seed=4)]
    ev.sort(key=lambda e: e[2])
    src = tmp_path / "src"
    schema = "request_id long, user_id long, ts_us long, end_us long"
    for part in range(3):                       # time-ordered files: nothing arrives behind the watermark
        chunk = ev[part * 100:(part + 1) * 100]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = J.admission_stream(stream, allow_queue=True, max_queue=2)
    got = {r.request_id: r.admitted for r in spark.read.parquet(J.run_available(out, "t_adm_multi")).collect()}
    assert got == brute(ev, 2)
