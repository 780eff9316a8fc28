"""The rare-gram index against looking at every rule."""
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.operators import rule_index as RI


@pytest.mark.parametrize("pattern,need", [
    ("Thi", "Thi"), ("(?:En|In) /", " /"), ("[A-Z]ió", "ió"), ("a+bcd", "bcd"), ("(abc)+", "abc"), ("(abc)?x", "x"), ("abc*d", "ab"), ("(?i)abc", ""),
    ("[a-z&&[^b]]xyz", ""), (r"\Qa.b\E", ""), ("[", ""), ("", ""), ("x|yy", ""), (r"foo\.bar\d+baz!", "foo.bar"), ("a{0,3}", ""), ("(?=abc)d", "")])
def test_required_literal(pattern, need):
    assert RI.required_literal(pattern) == need


def test_grams(spark):
    texts = ["", "a", "ab", "abcab\n c", "né\U0001f600xy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1:] for r in df.select("t", *[RI.grams(F.col("t"), n) for n in (1, 2, 3)]).collect()}
    for text in texts:
        for n, found in enumerate(got[text], 1):
            want = {text[i:i + n] for i in range(len(text) - n + 1)}
            assert want <= set(found) and ("\U0001f600" in text or want == set(found))


@pytest.mark.parametrize("most", [RI.MAX_BROADCAST_ROWS, 3])
def test_hits_match_brute_force(spark, monkeypatch, most):
    """Also with more rules than are broadcast."""
    monkeypatch.setattr(RI, "MAX_BROADCAST_ROWS", most)
    draw = random.Random(3)
    letters = "abcdE é.\n"
    texts = [None, ""] + ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(150)]
    words = sorted({"".join(draw.choices("abcdeé. ", k=draw.randint(1, 5))) for _ in range(400)})
    regexes = ["a[bc]d", "E+", "(?:ab|ba)c", "(?i)ABc", "..b", "", "b\\.", "(a|b)+é", "[a-z&&[^b]]c"]
    rules = [(i, "word", w) for i, w in enumerate(draw.sample(words, len(words)))] + [(1000 + i, "regex", p) for i, p in enumerate(regexes)]
    rules += [(5000, "word", rules[0][2]), (-1, "regex", "never matches")]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r.id: (r.word_hit, r.regex_hit) for r in RI.rule_hits(df, spark.createDataFrame(rules, "rule_id long, kind string, pattern string"), "id").collect()}
    for i, t in enumerate(texts):
        word = next((w for _, k, w in sorted(rules) if t is not None and k == "word" and w in t.lower()), None)
        regex = next((p for _, k, p in sorted(rules) if t is not None and k == "regex" and re.match(p.replace("[a-z&&[^b]]", "[ac-z]"), t)), None)
        assert got[i] == (word, regex), (t, got[i])


def test_no_rules_no_texts(spark):
    rules = spark.createDataFrame([], "rule_id long, kind string, pattern string")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert sorted(map(tuple, RI.rule_hits(df, rules, "id").collect())) == [(1, None, None), (2, None, None)]
    some = spark.createDataFrame([(1, "word", "a")], "rule_id long, kind string, pattern string")
    assert RI.rule_hits(df.limit(0), some, "id").count() == 0


def test_moderation_by_index_and_by_expression_agree(spark):
    from parlance.operators import moderation as M
    from parlance.plans import q_moderation

    rows = [(i, t, 0.9 if i == 3 else 0.1) for i, t in enumerate([None, "you Clown", "This one", "plain", "trash and clown", "In /x", "und R/UND/ so"])]
    df = spark.createDataFrame(rows, "id long, text string, toxicity double")
    rules = q_moderation.fx_rules(spark)
    for fn in (M.moderate_words, M.moderate_regex, lambda *a, **k: M.moderate(*a, scores={"toxicity": 0.8}, **k)):
        assert sorted(fn(df, rules, key="id").collect()) == sorted(fn(df, rules).select(*fn(df, rules, key="id").columns).collect())
