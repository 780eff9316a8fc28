"""Top-k where a row could be lost or a score wrap: the operator against its SQL."""
import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import plans, topk_pivot

SCHEMA = "vec_id long, embedding array<double>"


def by_sql(rows):
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64()))}))
    return sorted(con.sql(plans.TOPK_SQL).fetchall())


def by_spark(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = topk_pivot.exact_top_k(df, F.col("vec_id") % 50 == 0, k=5).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_repeated_ids_and_rows(spark):
    rows = [(50, [1.0, 0.5]), (7, [0.9, 0.1]), (7, [0.2, 0.9]), (7, [0.2, 0.9]), (8, [0.5, 0.5]), (9, [-1.0, 0.0])]
    assert by_spark(spark, rows) == by_sql(rows)
    many = [(50, [1.0, 1.0])] * 9 + [(i, [1.0, 1.0]) for i in range(60, 70)] + [(100, [0.0, 1.0]), (100, [1.0, 0.0])]
    got, want = by_spark(spark, many), by_sql(many)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]         # equal rows of one id: any of them
    assert [g for g in got if g[0] == 50] == [w for w in want if w[0] == 50]


def test_large_finite_components(spark):
    rows = [(50, [2.0**44 + 0.25, 1.0]), (1, [3.0, 2.0]), (2, [-2.0, 5.0]), (3, [0.75, 2.0**40 + 0.25]), (100, [0.5, 0.5]), (4, [float("inf"), 0.0]), (5, [None, 1.0]), (6, None)]
    floors = [(i, [int(c * 256 // 1) for c in v]) for i, v in rows if v and None not in v and float("inf") not in v]
    want = []
    for q, v in floors:
        if q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in floors if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    assert all(abs(w[3]) < 2**63 for w in want)
    assert by_spark(spark, rows) == sorted(want)


def test_scores_beyond_doubles_are_exact_and_beyond_longs_an_error(spark):
    """64 components of 2^19 + 1: sums of over 2^60 that doubles round."""
    big = float(2**19 + 1)
    rows = [(50, [big] * 64), (1, [big] * 64), (2, [big] * 63 + [big - 2**-8]), (3, [1.0] * 64)]
    got = {(r[0], r[2]): r[3] for r in by_spark(spark, rows)}
    n = (2**19 + 1) * 256
    assert got == {(50, 1): 64 * n * n, (50, 2): 64 * n * n - n, (50, 3): 64 * n * 256}
    with pytest.raises(Exception, match="does not fit"):
        by_spark(spark, [(50, [2.0**25] * 64), (1, [2.0**25] * 64)])
