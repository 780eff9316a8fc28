"""The forest's answers against brute force."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import hash_forest

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    """(query, rank) -> (id, score) over different rows that take part."""
    dim = max((len(v) for _, v in rows if v is not None), default=0)
    fine = {(i, tuple(v) + (0.0,) * (dim - len(v)), tuple(v)) for i, v in rows
            if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = []
    for q, x, raw in fine:
        if asked(q):
            near = sorted((-math.fsum(a * b for a, b in zip(x, y, strict=True)), i) for i, y, other in fine if (i, other) != (q, raw))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def run(df, k=20, **more):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in hash_forest.nearest(df, F.col("vec_id") % 20 == 0, k, **more).collect())


def test_odd_rows(spark):
    """All rows are candidates where there are few, so the answers are exact."""
    draw = random.Random(1)
    one = [0.6, -0.8, 0.25]
    rows = [(i, [draw.uniform(-1, 1) for _ in range(3)]) for i in range(14)]
    rows += [(20, one), (40, one), (60, one), (61, one), (20, one), (0, [5.0, 5.0, 5.0]), (62, [0.5]), (63, [1e30, -1e30, 0.0]), (64, [0.0, 0.0, 0.0]), (65, None), (66, []),
             (67, [1.0, None, 2.0]), (80, [float("nan"), 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0]), (None, one)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"vk": F.lit(1), "data": F.lit("x"), "level": F.lit(2), "label": F.lit(3)})
    assert run(df, 30) == brute(rows, lambda i: i % 20 == 0, 30)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(200)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows, lambda i: i % 20 == 0, 20)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)) == []          # no query


@pytest.mark.parametrize("shape", ["even", "groups", "lengths"])
def test_recall(spark, monkeypatch, shape):
    """0.9 of the true neighbours and more, on even directions, near copies and vectors of
    very different length; every returned score is the true one; small blocks."""
    monkeypatch.setattr(hash_forest, "BLOCK", 200)
    monkeypatch.setattr(hash_forest, "QUERY_BLOCK", 7)
    draw = np.random.default_rng(3)
    x = draw.standard_normal((1500, 16))
    if shape == "groups":
        x[300:900] = x[0] + 0.01 * draw.standard_normal((600, 16))
    if shape == "lengths":
        x *= np.exp(draw.standard_normal((1500, 1)))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got, want = run(spark.createDataFrame(rows, SCHEMA).repartition(4)), brute(rows, lambda i: i % 20 == 0, 20)
    assert len(got) == len(want) and [g[:2] for g in got] == [w[:2] for w in want]
    true = {(q, i): s for q, _, i, s in brute(rows, lambda i: i % 20 == 0, 1500)}
    assert all(s == true[q, i] for q, _, i, s in got)
    recall = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)
    assert recall >= 0.9
    # not by reading everything: the fitted ascent stops below the root
    assert shape == "lengths" or recall < 1.0


def test_shared_bits():
    a = np.array([0, -1, 5, 5], np.int64)
    assert hash_forest._shared_bits(a, np.array([0, 0, 4, 5 ^ (1 << 40)], np.int64)).tolist() == [64, 0, 63, 23]


def test_counts_equal_the_strings(spark):
    draw = random.Random(6)
    strings = [[draw.choice([3, -3, draw.randrange(-2**63, 2**63)]) for _ in range(2)] for _ in range(80)]
    df = spark.createDataFrame([(s,) for s in strings], "strings array<long>").repartition(3)
    got = {(r.tree, r.level, r.prefix): r.n for r in hash_forest.node_counts(df, 5).collect()}
    want: dict = {}
    for s in strings:
        for t in (0, 1):
            for level in range(65):
                at = (t, level, s[t] >> (64 - level) if level else 0)
                want[at] = want.get(at, 0) + 1
    assert got == {k: n for k, n in want.items() if n >= 5}
