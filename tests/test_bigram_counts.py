"""Bigram counts: contexts from the unigram pass, streams of one split alone, sums side by side."""

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import scan
from parlance.operators import scoring as S
from parlance.plans import fixtures as X


def test_contexts_come_with_the_unigrams(spark):
    docs = spark.createDataFrame([("x", ["a", "b", "a"]), ("x", ["b"]), ("y", []), (None, ["a", "c"]), ("y", None)], "dataset string, tokens array<string>")
    uni, big, ctx, stats = S.bigram_model(docs)
    assert {(r[0], r[1]): r[2] for r in uni.collect()} == {("x", "a"): 2, ("x", "b"): 2, (None, "a"): 1, (None, "c"): 1}
    assert {(r[0], r[1]): r[2] for r in ctx.collect()} == {("x", "a"): 1, ("x", "b"): 1, (None, "a"): 1}
    assert {tuple(r) for r in big.collect()} == {("x", "a", "b", 1), ("x", "b", "a", 1), (None, "a", "c", 1)}
    assert {tuple(r) for r in stats.collect()} == {("x", 4, 2), (None, 2, 2)}
    assert "Generate" not in ctx._jdf.queryExecution().optimizedPlan().toString()


def test_temperature_renormalises_without_a_second_table(spark):
    c = spark.createDataFrame([("x", "a", "p", 3, 4), ("x", "a", "q", 1, 4), ("x", "b", "p", 2, 2), (None, "b", "p", 2, 2)],
                              "dataset string, ctx string, token string, cnt long, total long")
    t = S.temperature_scale(c, 0.5)
    assert "Join" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["ctx"], r["token"]): round(r["q"], 9) for r in t.collect()} == {("a", "p"): 0.9, ("a", "q"): 0.1, ("b", "p"): 1.0}


def test_only_eval_documents_go_through_the_eval_stream(spark, tmp_path, monkeypatch):
    (spark.range(40).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.repeat(F.lit("w "), 200), F.col("id").cast("string")).alias("text"))
     .write.parquet(str(tmp_path / "documents.parquet")))
    from parlance.operators import corpus
    seen = []
    old = corpus.running_sums
    monkeypatch.setattr(corpus, "running_sums", lambda df, *a, **k: (seen.append(df.count()), old(df, *a, **k))[1])
    rows = X.fx_evalseg(spark, str(tmp_path)).count()
    assert seen == [8] and rows == 8 * 201 // X.L_WINDOW * X.L_WINDOW


def test_sums_by_group_are_those_of_a_loop():
    rng = np.random.default_rng(3)
    for x in (rng.random(900), rng.integers(0, 9, 900)):
        cuts = np.unique(np.r_[0, rng.choice(900, 200), 400, 480])
        starts, ends = cuts, np.r_[cuts[1:], 900]
        total, before = scan._sums_by_group(x, starts, ends, 7)
        for a, b in zip(starts, ends, strict=True):
            want = np.cumsum(x[a:b]) + (7 if a == 0 else 0)
            assert (total[a:b] == want).all() and before[a] == (7 if a == 0 else 0) and (before[a + 1:b] == want[:-1]).all()
