"""Branching threads against a recursive fold; the timeout stream over several runs."""
import random

import pytest
from pyspark.sql import functions as F

from parlance import constants as K
from parlance.operators import admission as A
from parlance.operators import threads as TH
from parlance.streaming import jobs as J

SCHEMA = "uid long, short_id string, short_id_parent string, prompt string, output string"


def sample_turns():
    draw = random.Random(2)
    rows = []
    for u in range(3):
        for i in range(60):
            parent = None if i == 0 or draw.random() < 0.03 else f"s{draw.randrange(i) if draw.random() < 0.4 else i - 1}"
            prompt = draw.choice(["ask", "say more", "why\nso"]) + str(i)
            rows.append((u, f"s{i}", parent, prompt, draw.choice([prompt + " echoed answer.", "plain answer.", None if draw.random() < 0.2 else "x"])))
    rows.append((0, "a", "gone", "p", "o"))
    rows.append((0, "b", "a", "p2", "o2"))
    rows += [(1, "c1", "c3", "p", "o"), (1, "c2", "c1", "p", "o"), (1, "c3", "c2", "p", "o"), (1, "c4", "c3", "p", "o")]
    return rows


def test_thread_forest_matches_recursion(spark):
    rows = sample_turns()
    by = {(r[0], r[1]): r for r in rows}

    def fold(u, s, seen=()):
        if s in seen or (u, s) not in by:
            return None
        _, _, parent, prompt, _ = by[u, s]
        if parent is None:
            return 0, prompt
        above = fold(u, parent, (*seen, s))
        if above is None:
            return None
        out, pp = by[u, parent][4], by[u, parent][3]
        if out is None:
            return above[0] + 1, above[1] + prompt
        out = out[len(pp):] if pp in out else out
        return above[0] + 1, f"{above[1]} {out}\n{prompt}"

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.uid, r.short_id): r for r in TH.thread_forest(df).collect()}
    assert len(got) == len(rows)
    for at, r in got.items():
        want = fold(*at)
        assert (r.depth, r.context) == (want or (None, None)) and r.orphan == (want is None)
    assert {s for (_, s), r in got.items() if r.orphan} >= {"a", "b", "c1", "c2", "c3", "c4"}
    assert max(r.depth or 0 for r in got.values()) > 12


def test_forest_agrees_with_the_window_on_linear_threads(spark):
    rows = [(u, f"{u}-{t}", f"{u}-{t - 1}" if t else None, f"do {t}" + ("\n### Input:" if u == 1 and t == 0 else ""), f" answer {t}.") for u in range(4) for t in range(u + 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("turn", F.split("short_id", "-")[1].cast("int"))
    for template in (False, True):
        want = {r.short_id: r.context for r in TH.thread_context(df, template=template).collect()}
        got = {r.short_id: r.context for r in TH.thread_forest(df, template=template).collect()}
        assert got == want and (not template or K.ANSWER in got["3-2"])


def test_forest_of_no_turns(spark):
    assert TH.thread_forest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("files", [1, 3])
def test_timeout_stream_tells_failures_over_runs(spark, tmp_path, files):
    """Several micro-batches and a restart from the checkpoint: each start answered once, by
    its first finish or as failed, like the batch form; nothing is read twice."""
    minute = 60_000_000
    draw = random.Random(7)
    starts = [(i, draw.randrange(4), draw.randrange(0, 3000) * minute) for i in range(200)]
    fins = [(1000 + i, draw.randrange(5), draw.randrange(0, 3000) * minute) for i in range(120)]
    limit = 60 * minute
    schema = "request_id long, user_id long, ts_us long, ts timestamp"

    def write(name, rows, part):
        lo, hi = part * 1000 * minute, (part + 1) * 1000 * minute
        df = spark.createDataFrame([r for r in rows if lo <= r[2] < hi], "request_id long, user_id long, ts_us long").withColumn("ts", F.timestamp_micros("ts_us"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run(base):
        read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / name))
        answers = J.timeout_stream(read("s"), read("f"), limit, watermark="2 hours")
        return J.run_available(answers, "timeouts", base=base)

    for part in (0, 1):
        write("s", starts, part)
        write("f", fins, part)
    base = str(tmp_path / "run")
    run(base)
    early = spark.read.parquet(f"{base}/out").count()
    assert 0 < early < len(starts)
    write("s", starts, 2)
    write("f", fins, 2)
    spark.createDataFrame([(9999, 77, 9000 * minute)], "request_id long, user_id long, ts_us long").withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    run(base)
    got = spark.read.parquet(f"{base}/out").collect()
    assert len(got) == len({r.request_id for r in got}) == len(starts)
    s = spark.createDataFrame(starts, "request_id long, user_id long, ts_us long")
    f = spark.createDataFrame(fins, "request_id long, user_id long, ts_us long")
    want = {r.request_id: (r.finish_id, r.finished) for r in A.request_timeout(s, f, limit).collect()}
    assert {r.request_id: (r.finish_id, r.finished) for r in got} == want and not all(x[1] for x in want.values())
