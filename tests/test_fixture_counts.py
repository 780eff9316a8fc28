"""The derived fixtures reproduce the outcome counts FIXTURES.md reports for
sf0.001 (computed there independently), through the Spark queries."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL


def run(spark, name):
    return E.queries()[name](spark, SF_SMALL)


def test_request_gate_counts(spark):
    assert run(spark, "validate_request").filter("valid").count() == 699
    assert run(spark, "gate_tenure").filter(~F.col("tenure_ok")).count() == 87
    assert run(spark, "admission_control").filter(~F.col("admitted")).count() == 355
    assert run(spark, "admission_control_queue").filter(~F.col("admitted")).count() == 85
    t = run(spark, "request_timeout")
    assert (t.filter("finished").count(), t.count()) == (25, 210)
    v = {r.status: r.n for r in run(spark, "restore_views").groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert v == {"kept": 134, "skipped": 11}


def test_text_fixture_counts(spark):
    assert run(spark, "moderate_words").filter(F.col("word_hit").isNotNull()).count() == 9
    p = run(spark, "request_log")
    assert p.count() == 34
    assert p.filter(F.length("output") > 1024).count() == 10
    assert p.filter(F.length("prompt") > 256).count() == 9
    f = run(spark, "first_valid_attempt").filter(F.col("chosen_attempt").isNull())
    assert f.select("uid").distinct().count() == 2


def test_segment_counts(spark):
    seg = {r.dataset: r.n for r in run(spark, "eval_segments").groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    assert seg == {"de": 15, "en": 104, "es": 6, "fr": 10}
