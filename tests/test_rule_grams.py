"""Only grams that rules are filed under become rows; every hit is kept."""

from pyspark.sql import functions as F

from parlance.operators import rule_index as RI


def test_filed_grams_are_the_only_rows(spark):
    df = spark.createDataFrame([("word", "an alphabet of plain letters"), ("regex", "an alphabet"), ("word", "nothing here")], "kind string, seen string")
    filed = {"word": {"lphab": ["alphabet"], "lain ": ["explain it"]}, "regex": {"": [""], "nothi": ["nothing"]}}
    got = [sorted(r["g"]) for r in df.select(RI._filed_grams(F.col("kind"), F.col("seen"), filed).alias("g")).collect()]
    assert got == [["lphab"], [""], []]


def test_hits_are_the_same_on_either_way(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The Trash \U0001f600bin, a clown"), (2, "Abc def ghi, x"), (3, None), (4, ""), (5, "ab")], "doc_id long, text string")
    rules = spark.createDataFrame([(0, "word", "clown"), (1, "word", "trash"), (2, "regex", r"Abc \S+ ghi( |,)"), (3, "regex", r"\S+b$"),
                                   (4, "word", "\U0001f600b"), (5, "word", "ab")], "rule_id long, kind string, pattern string")
    hits = lambda: {r["doc_id"]: (r["word_hit"], r["regex_hit"]) for r in RI.rule_hits(texts, rules, "doc_id").collect()}
    few = hits()
    assert few == {1: ("clown", None), 2: ("ab", r"Abc \S+ ghi( |,)"), 3: (None, None), 4: (None, None), 5: ("ab", r"\S+b$")}
    monkeypatch.setattr(RI, "MAX_TASK_GRAMS", 0)
    assert hits() == few
