"""Results that were wrong outside the driver's data."""
from pyspark.sql import functions as F

from parlance.operators import corpus, gates, moderation, quant, scoring


def test_split_takes_any_percentage(spark):
    for pct in (5, 80, 85, 100):
        got = corpus.corpus_split(spark.range(1000).withColumnRenamed("id", "doc_id"), train_pct=pct)
        assert got.filter("split = 'train'").count() == 10 * pct


def test_tenure_of_part_of_an_hour(spark):
    hour = 3_600_000_000
    df = spark.createDataFrame([(0, hour * 5 // 4), (0, hour * 2), (0, hour // 4)], "j long, n long")
    assert [r[0] for r in df.select(gates.gate_tenure("j", "n", 1.5)).collect()] == [False, True, False]
    assert [r[0] for r in df.select(gates.gate_tenure("j", "n", 0.5)).collect()] == [True, True, False]


def test_views_without_time_are_skipped(spark):
    v = spark.createDataFrame([(1, None, [("a",)]), (2, 100, [("a",)]), (3, 1, [("a",)])], "message_id int, time long, items array<struct<label:string>>")
    kept, skipped = gates.restore_views(v, 100, 50, ["a"])
    assert [r.message_id for r in kept.collect()] == [2] and [r.message_id for r in skipped.collect()] == [1]


def _model(name):
    def factory():
        return lambda pdf: pdf.assign(model=name)
    return factory


def test_predictors_of_one_function_do_not_mix(spark):
    for name in ("a", "b", "a"):
        got = scoring.batch_predict(spark.range(4).repartition(1), _model(name), "id long, model string").collect()
        assert {r.model for r in got} == {name}


def test_mean_of_short_steps(spark):
    t = spark.createDataFrame([("r", x, 1) for x in (0.00004, 0.00003, 0.00002)], "run string, seconds double, mem_mib int")
    assert abs(scoring.latency_summary(t).first().mean_s - 0.00003) < 1e-9


def test_verify_sees_missing_values(spark):
    def ok(rows):
        return quant.verify_packed(spark.createDataFrame(rows, "w array<double>, deq array<double>")).first().ok

    assert ok([([1.0, 2.0], [1.0, 2.0]), ([], [])])
    assert not ok([([1.0, 2.0], [1.0, 2.0, 3.0])])
    assert not ok([([1.0, None], [1.0, 2.0])]) and not ok([(None, [1.0])]) and not ok([])


def test_sampled_generation_of_null_and_large_keys(spark, monkeypatch):
    from parlance.operators import sizing

    cdf = spark.createDataFrame([(c, w, lo, 1.0, 3.0) for c in "abc" for w, lo in zip("abc", (0.0, 1.0, 2.0), strict=True)],
                                "ctx string, token string, lo double, w double, z double")
    prompts = spark.createDataFrame([(1, 0, ["a"]), (None, 0, ["b"]), (2**53 + 1, 1, ["c"])], "conv_id long, turn int, tokens array<string>")
    found = []
    for bound in (1_000, 0):
        monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", bound)
        rows = scoring.batch_generate_sampled(prompts, cdf, F.lit("a"), 5, 7).collect()
        found.append({r.conv_id: r.generated for r in rows})
    assert found[0] == found[1] and found[0].keys() == {1, None, 2**53 + 1}
    assert all(len(g) == 5 for g in found[0].values())


def test_hundreds_of_rules_stay_flat(spark):
    df = spark.createDataFrame([(0, "has W450x and w7x"), (1, "clean"), (2, None), (3, ""), (4, "p599 first")], "id long, text string")
    words = [f"w{i}x" for i in range(512)]
    patterns = [f"p{i}\\b" for i in range(600)]
    got = df.select("id", moderation.word_hit("text", words).alias("w"), moderation.regex_hit("text", patterns).alias("r")).orderBy("id").collect()
    assert [r.w for r in got] == ["w7x", None, None, None, None]
    assert [r.r for r in got] == [None, None, None, None, "p599\\b"]
    none = df.select(moderation.word_hit("text", []).alias("w"), moderation.regex_hit("text", []).alias("r")).collect()
    assert all(r.w is None and r.r is None for r in none)
