"""Running sums over ranges, against plain folds."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators.scan import positions, running_sums


@pytest.fixture(autouse=True)
def all_ranges(spark):
    """Small tables would otherwise be coalesced to one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "j"]])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sums(spark, keys, inclusive):
    draw = random.Random(3)
    # a key of over half the rows, null keys, ids spread over 64 bits
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([1, 2, None]), draw.randrange(-2**62, 2**62), draw.choice([None, 1, 5, -3]), draw.random()) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, j int, id long, n int, x double").repartition(5)
    got = {r.id: r for r in running_sums(df, keys, ["id"], {"s": "n", "t": "x"}, inclusive).collect()}
    assert len(got) == 900
    at = {"k": 0, "j": 1}
    group = lambda r: tuple((r[at[k]] is not None, r[at[k]] or 0) if k == "j" else (r[at[k]] is not None, r[at[k]] or "") for k in keys)
    for _, mine in itertools.groupby(sorted(rows, key=lambda r: (group(r), r[2])), group):
        s, t = 0, 0.0
        for r in mine:
            before = (s, t)
            s, t = s + (r[3] or 0), t + r[4]
            want = (s, t) if inclusive else before
            assert got[r[2]].s == want[0] and got[r[2]].t == pytest.approx(want[1])


def test_one_key_spreads_over_ranges(spark):
    df = spark.range(0, 40_000, 1, 4).select(F.xxhash64("id").alias("id"), F.lit("one").alias("k"))
    got = positions(df, ["k"], ["id"], "place")
    ranks = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: r.id))}
    assert {r.id: r.place for r in got.collect()} == ranks
    held = got.groupBy(F.input_file_name()).count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 30_000


def test_empty(spark):
    assert positions(spark.createDataFrame([], "k string, id long"), ["k"], ["id"], "p").collect() == []
