"""Logs round-trip through partitioned files; key lookups prune and push down."""

from pyspark.sql import functions as F

from parlance.session import scratch_path
from parlance.sources import logs


def test_request_log_lookup_prunes_partitions(spark):
    rows = [(uid, f"s{uid}_{k}", "p", "o", 256, 0.8, 0.95) for uid in range(200) for k in range(3)]
    df = spark.createDataFrame(rows, "uid long, short_id string, prompt string, output string, "
                                     "max_tokens int, temperature double, top_p double")
    path = scratch_path(spark, "t_reqlog")
    logs.write_request_log(df, path)
    log = logs.read_request_log(spark, path)
    hit = logs.lookup_request(log, 77, "s77_1")
    assert [(r.uid, r.short_id) for r in hit.collect()] == [(77, "s77_1")]
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(uid_bucket" in plan and "(uid_bucket" in plan
    assert "PushedFilters: [IsNotNull(uid), IsNotNull(short_id), EqualTo(uid,77), EqualTo(short_id,s77_1)]" in plan
    assert log.count() == 600


def test_view_log_appends_nested_items(spark):
    items = "array<struct<label:string,custom_id:string,row:int>>"
    schema = (f"message_id long, uid long, short_id_parent string, prompt string, "
              f"prompt_input_element_custom_id string, time long, items {items}")
    path = scratch_path(spark, "t_viewlog")
    for m in (1, 2):
        df = spark.createDataFrame([(m, 9, "sid", "", "cid", 100 + m, [("Continue", f"c{m}", 0)])], schema)
        logs.write_view_log(df, path)
    got = logs.read_view_log(spark, path).select("message_id", F.col("items")[0]["custom_id"].alias("c")).collect()
    assert sorted((r.message_id, r.c) for r in got) == [(1, "c1"), (2, "c2")]


def test_read_corpus_formats(spark, tmp_path):
    import gzip
    import json

    from parlance.operators.corpus import corpus_split
    from parlance.sources.corpus import read_corpus
    docs = [{"text": f"doc number {i}"} for i in range(25)]
    jdir = tmp_path / "json"
    jdir.mkdir()
    for part in range(2):
        with gzip.open(jdir / f"part-{part}.json.gz", "wt") as fh:
            for d in docs[part * 13:(part + 1) * 13]:
                fh.write(json.dumps(d) + "\n")
    j = read_corpus(spark, str(jdir), "json", schema="text string")
    rows = sorted((r.doc_id, r.text) for r in j.collect())
    assert [r[0] for r in rows] == list(range(25))
    assert sorted(r[1] for r in rows) == sorted(d["text"] for d in docs)
    again = sorted((r.doc_id, r.text) for r in read_corpus(spark, str(jdir), "json", schema="text string").collect())
    assert again == rows                                   # stable ids on rerun
    tdir = tmp_path / "text"
    tdir.mkdir()
    (tdir / "a.txt").write_text("first line\nsecond line\n")
    t = read_corpus(spark, str(tdir), "text")
    assert sorted((r.doc_id, r.text) for r in t.collect()) == [(0, "first line"), (1, "second line")]
    assert corpus_split(t).filter("split = 'train'").count() == 2


def test_read_wordlist(spark, tmp_path):
    from parlance.operators import moderation as M
    from parlance.sources.rules import read_wordlist
    (tmp_path / "w.txt").write_text("Bad\n\nr/^Start/\nbad\n")
    rules = read_wordlist(spark, str(tmp_path / "w.txt"))
    assert sorted((r.rule_id, r.kind, r.pattern) for r in rules.collect()) == [
        (0, "word", "bad"), (2, "regex", "^Start"), (3, "word", "bad")]
    df = spark.createDataFrame([(1, "Start here"), (2, "so BAD")], "id int, text string")
    got = {r.id: r.reason for r in M.moderate(df, rules, "text", scores=None).collect()}
    assert got == {1: "regex:^Start", 2: "word:bad"}


def test_queries_ship_package_once(spark):
    import __spark_entry__ as E
    from parlance import session as S
    qs = E.queries()
    assert all(hasattr(fn, "__wrapped__") for fn in qs.values())
    S.ship_package(spark)
    n = len(S._SHIPPED)
    S.ship_package(spark)
    assert len(S._SHIPPED) == n and spark.sparkContext.applicationId in S._SHIPPED
