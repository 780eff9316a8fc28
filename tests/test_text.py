"""Quirk-table and edge cases as small literal frames."""

from pyspark.sql import functions as F

from parlance import constants as K
from parlance.functions import text as T
from parlance.operators import moderation as M
from parlance.operators import scoring as S
from parlance.operators.text_ops import chunk_text


def one(spark, col, schema="s string", rows=(("x",),)):
    return spark.createDataFrame(list(rows), schema).select(col.alias("o")).collect()[0]["o"]


def test_empty_output_gives_no_chunk(spark):
    df = spark.createDataFrame([(1, ""), (2, "a" * 2050)], "id int, out string")
    rows = chunk_text(df, "out").select("id", "chunk_idx", "title", F.length("chunk").alias("n")).collect()
    assert [(r.id, r.chunk_idx, r.title, r.n) for r in sorted(rows)] == [
        (2, 0, "Output", 1024), (2, 1, "Continued Output", 1024), (2, 2, "Continued Output", 2)]


def test_long_prompt_display_discards_cleanup(spark):
    long = K.PREFIX_NO_INPUT + K.INSTRUCT + "q" * 300 + K.ANSWER
    got = one(spark, T.display_prompt(F.lit(long), None, True), rows=(("x",),))
    assert got == "..." + long[-256:]
    short = K.PREFIX_NO_INPUT + K.INSTRUCT + "hello" + K.ANSWER
    assert one(spark, T.display_prompt(F.lit(short), None, True)) == "hello"


def test_strip_echo_prompt_in_middle(spark):
    # contains the prompt in the middle: the first len(prompt) chars go anyway
    assert one(spark, T.strip_echo(F.lit("xxabcyy"), F.lit("abc"))) == "xxabcyy"[3:]
    assert one(spark, T.strip_echo(F.lit("no echo"), F.lit("abc"))) == "no echo"


def test_continue_prompt_template_and_missing_marker(spark):
    text_p = K.PREFIX_NO_INPUT + K.INSTRUCT + "q" + K.ANSWER
    out = text_p + "answer!"
    got = one(spark, T.continue_prompt(F.lit(text_p), F.lit(out), F.lit("next"), template=True))
    full = text_p + " " + out
    head = full[:full.find(K.ANSWER) + len(K.ANSWER)]
    ans = full[full.rfind(K.ANSWER) + len(K.ANSWER):][:-1]
    assert got == head + "\n" + ans + "\n" + K.PREFIX_NO_INPUT + K.INSTRUCT + "next" + K.ANSWER
    # no marker anywhere: whole text is the prompt, answer empty
    got2 = one(spark, T.continue_prompt(F.lit("plain"), F.lit("text"), None, template=True))
    assert got2 == "plain text\n"
    assert one(spark, T.continue_prompt(F.lit("a"), F.lit("b"), F.lit(""), template=False)) == "a b"


def test_format_instruction_respects_existing_input_marker(spark):
    p = "already ### Input: here"
    assert one(spark, T.format_instruction(F.lit(p), None, True, False)) == p
    assert one(spark, T.format_instruction(F.lit("hi"), None, True, True)) == "hi"
    assert one(spark, T.format_instruction(F.lit("hi"), F.lit("ctx"), True, False)) == (
        K.PREFIX_INPUT + K.INSTRUCT + "hi" + K.INPUT + "ctx" + K.ANSWER)


def test_trim_stop_list_order(spark):
    stops = [["a"], ["b", "c"], ["d"]]
    arr = F.array(*[F.lit(x) for x in ["x", "d", "b", "c"]])
    # 'a' no; 'b c' yes -> [x, d]; 'd' yes -> [x]
    assert one(spark, T.trim_stop(arr, stops)) == ["x"]
    arr2 = F.array(*[F.lit(x) for x in ["x", "b", "c", "a"]])
    # 'a' yes -> [x, b, c]; 'b c' yes -> [x]; 'd' no
    assert one(spark, T.trim_stop(arr2, stops)) == ["x"]
    arr3 = F.array(*[F.lit(x) for x in ["x", "a", "d"]])
    # 'a' no (ends with d); 'b c' no; 'd' yes -> [x, a]  (a is not revisited)
    assert one(spark, T.trim_stop(arr3, stops)) == ["x", "a"]


def test_null_prompt_not_flagged(spark):
    rules = M.rule_table(spark.createDataFrame([(0, "bad"), (1, "r/.*/")], "rule_id int, line string"))
    df = spark.createDataFrame([(1, None), (2, "so BAD"), (3, "fine")], "id int, text string")
    got = {r.id: (r.flagged, r.reason) for r in M.moderate(df, rules, "text", scores=None).collect()}
    assert got[1] == (False, None)
    assert got[2] == (True, "regex:.*")


def test_rule_table_lines(spark):
    lines = spark.createDataFrame([(0, "  Word "), (1, ""), (2, "r/Ab+/"), (3, "R/X/"), (4, "r//")],
                                  "rule_id int, line string")
    got = sorted((r.rule_id, r.kind, r.pattern) for r in M.rule_table(lines).collect())
    assert got == [(0, "word", "word"), (2, "regex", "Ab+"), (3, "word", "r/x/"), (4, "word", "r//")]


def test_word_hit_automaton_matches_expression(spark):
    words = [f"w{i:03d}" for i in range(600)] + ["needle"]
    df = spark.createDataFrame([(1, "hay NEEDLE w599 hay"), (2, "nothing")], "id int, text string")
    expr_hit = {r.id: r.h for r in df.select("id", M.word_hit("text", words[-5:]).alias("h")).collect()}
    ac_hit = {r.id: r.h for r in df.select("id", M.word_hit("text", words).alias("h")).collect()}
    assert ac_hit == {1: "w599", 2: None}
    assert expr_hit == {1: "w599", 2: None}


def test_top_p_at_least_one_keeps_all(spark):
    c = spark.createDataFrame([("d", "a", "x", 3, 6), ("d", "a", "y", 2, 6), ("d", "a", "z", 1, 6)],
                              "dataset string, ctx string, token string, cnt long, total long")
    assert S.top_p_filter(c, 1.0).count() == 3
    assert S.top_p_filter(c, 10.0).count() == 3
    # 0.5: keep x (prev mass 0 < 3), stop at y (prev mass 3 >= 3)
    assert [r.token for r in S.top_p_filter(c, 0.5).collect()] == ["x"]


def test_template_thread_equals_sequential_fold(spark):
    from parlance.operators.threads import thread_context
    turns = [(1, 0, "first question", "answer one"), (1, 2, "second", "answer ### two"),
             (1, 4, "third", "a3\n### Response:\nlast bit"), (1, 6, "", "z")]
    df = spark.createDataFrame(turns, "uid long, turn long, prompt string, output string")
    got = {r.turn: r.context for r in thread_context(df, template=True).collect()}
    # sequential fold of continue_prompt in template mode
    prompts = {}
    prev_prompt = None
    for uid, turn, p, o in turns:
        if prev_prompt is None:
            cur = one(spark, T.format_instruction(F.lit(p), None, True, False))
        else:
            po = prev_o[len(prev_p):] if prev_p in prev_o else prev_o
            cur = one(spark, T.continue_prompt(F.lit(prev_prompt), F.lit(po), F.lit(p), template=True))
        prompts[turn] = cur
        prev_prompt, prev_p, prev_o = cur, p, o
    assert got == prompts
