"""Request-side queries: validation, gates, moderation, text transforms,
threads, admission, timeouts, logs. Spark plan + DuckDB oracle each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import admission as A
from ..operators import gates as G
from ..operators import moderation as M
from ..operators import threads as TH
from ..session import scratch_path
from ..sources import logs
from . import fixtures as X
from .registry import query, with_ctes

HOUR_US = 3600 * 1_000_000


def sql_str(s: str) -> str:
    """A SQL string literal (newlines via chr(10) so the text stays exact)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]


def short_id_sql(key: str) -> str:
    h = f"md5({key})"
    return " || ".join(f"substr('{K.ID_ALPHABET}', (('0x' || substr({h}, {2 * i + 1}, 2))::INTEGER % 62) + 1, 1)"
                       for i in range(K.ID_LENGTH))


# ------------------------------------------------------------------ requests

def fx_requests(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("request_id"), "user_id", F.col("event_type").alias("channel"),
        X.epoch_us(F.col("ts")).alias("ts_us"),
        F.when(eid % 10 == 0, F.lit(None)).otherwise((eid % 2500).cast("int")).alias("max_tokens"),
        ((eid % 130).cast("double") / 100.0).alias("temperature"),
        ((eid % 1100).cast("double") / 100.0).alias("top_p"),
        F.when(eid % 7 == 0, F.lit("x")).alias("instruction_input"),
        F.when(F.col("user_id") % 5 == 0, F.lit("view")).alias("slash_restrict"),
        F.when(F.col("user_id") % 7 == 0, F.lit("click")).alias("all_restrict"),
        (F.col("value") / 400.0).alias("toxicity"))


CTE_REQ = ("fx_requests", """
SELECT event_id AS request_id, user_id, event_type AS channel, epoch_us(ts) AS ts_us,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 2500 AS INTEGER) END AS max_tokens,
       CAST(event_id % 130 AS DOUBLE) / 100.0 AS temperature,
       CAST(event_id % 1100 AS DOUBLE) / 100.0 AS top_p,
       CASE WHEN event_id % 7 = 0 THEN 'x' END AS instruction_input,
       CASE WHEN user_id % 5 = 0 THEN 'view' END AS slash_restrict,
       CASE WHEN user_id % 7 = 0 THEN 'click' END AS all_restrict,
       value / 400.0 AS toxicity
FROM events""")


@query("validate_request", with_ctes(CTE_REQ) + """
SELECT request_id, max_tokens, temperature, top_p, reason, reason IS NULL AS valid FROM (
  SELECT request_id, mt AS max_tokens, temperature, top_p,
         CASE WHEN mt NOT BETWEEN 128 AND 2048 THEN 'max_tokens'
              WHEN temperature NOT BETWEEN 0.01 AND 1.0 THEN 'temperature'
              WHEN top_p NOT BETWEEN 0.01 AND 10.0 THEN 'top_p' END AS reason
  FROM (SELECT *, COALESCE(max_tokens, 256) AS mt FROM fx_requests))""")
def q_validate_request(spark, sf_dir):
    r = fx_requests(spark, sf_dir).select("request_id", "max_tokens", "temperature", "top_p")
    return G.validate_request(r).select("request_id", "max_tokens", "temperature", "top_p", "reason", "valid")


@query("gate_channel", with_ctes(CTE_REQ) + """
SELECT request_id, slash_restrict IS NULL OR channel = slash_restrict AS slash_ok,
       channel = 'view' AS view_only_ok, true AS unrestricted_ok FROM fx_requests""")
def q_gate_channel(spark, sf_dir):
    r = fx_requests(spark, sf_dir)
    return r.select("request_id", G.gate_channel("channel", F.col("slash_restrict")).alias("slash_ok"),
                    G.gate_channel("channel", "view").alias("view_only_ok"),
                    G.gate_channel("channel", None).alias("unrestricted_ok"))


@query("gate_instruction_input", with_ctes(CTE_REQ) + """
SELECT request_id, instruction_input IS NOT NULL AS has_input, instruction_input IS NULL AS ok_template_off,
       true AS ok_template_on FROM fx_requests""")
def q_gate_instruction_input(spark, sf_dir):
    r = fx_requests(spark, sf_dir)
    return r.select("request_id", F.col("instruction_input").isNotNull().alias("has_input"),
                    G.gate_instruction_input("instruction_input", False).alias("ok_template_off"),
                    G.gate_instruction_input("instruction_input", True).alias("ok_template_on"))


def fx_joined(spark, sf_dir):
    r = fx_requests(spark, sf_dir)
    users = r.groupBy("user_id").agg(F.min("ts_us").alias("joined_us"))
    return r.join(users, on="user_id")


CTE_USERS = ("fx_joined", """
SELECT r.*, u.joined_us FROM fx_requests r
JOIN (SELECT user_id, min(ts_us) AS joined_us FROM fx_requests GROUP BY user_id) u ON u.user_id = r.user_id""")


@query("gate_tenure", with_ctes(CTE_REQ, CTE_USERS) + f"""
SELECT request_id, CAST(((ts_us - joined_us) // 1000000) // 3600 AS BIGINT) AS hours_held,
       (ts_us - joined_us) >= 48 * {HOUR_US} AS tenure_ok FROM fx_joined""")
def q_gate_tenure(spark, sf_dir):
    j = fx_joined(spark, sf_dir)
    return j.select("request_id", G.tenure_hours("joined_us", "ts_us").alias("hours_held"),
                    G.gate_tenure("joined_us", "ts_us", 48).alias("tenure_ok"))


def admission_sql(src: str, cap: int, name: str) -> list:
    """Recursive-CTE oracle for admission: per user, events in time order, the
    state a list of in-flight end times."""
    return [(f"{name}_ev", f"""
SELECT request_id, user_id, ts_us, ts_us + 6 * {HOUR_US} AS end_us,
       row_number() OVER (PARTITION BY user_id ORDER BY ts_us, request_id) AS rn FROM {src}"""),
            (name, f"""
SELECT * FROM (WITH RECURSIVE st(user_id, rn, request_id, admitted, inflight) AS (
  SELECT user_id, rn, request_id, true, [end_us] FROM {name}_ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.request_id,
         len(list_filter(s.inflight, lambda x: x > e.ts_us)) < {cap},
         CASE WHEN len(list_filter(s.inflight, lambda x: x > e.ts_us)) < {cap}
              THEN list_append(list_filter(s.inflight, lambda x: x > e.ts_us), e.end_us)
              ELSE list_filter(s.inflight, lambda x: x > e.ts_us) END
  FROM st s JOIN {name}_ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT request_id, user_id, admitted FROM st)""")]


def _admission(spark, sf_dir, allow_queue, max_queue):
    r = fx_requests(spark, sf_dir).select("request_id", "user_id", "ts_us")
    r = r.withColumn("end_us", F.col("ts_us") + 6 * HOUR_US)
    return A.admission_control(r, allow_queue=allow_queue, max_queue=max_queue)


@query("admission_control", with_ctes(CTE_REQ, *admission_sql("fx_requests", 1, "adm")) + """
SELECT request_id, user_id, admitted FROM adm""")
def q_admission_control(spark, sf_dir):
    return _admission(spark, sf_dir, False, None).select("request_id", "user_id", "admitted")


@query("admission_control_jump", with_ctes(CTE_REQ, *admission_sql("fx_requests", 1, "admj")) + """
SELECT request_id, user_id, admitted FROM admj""")
def q_admission_control_jump(spark, sf_dir):
    r = fx_requests(spark, sf_dir).select("request_id", "user_id", "ts_us")
    r = r.withColumn("end_us", F.col("ts_us") + 6 * HOUR_US)
    return A.admission_control(r, method="jump").select("request_id", "user_id", "admitted")


@query("admission_control_queue", with_ctes(CTE_REQ, *admission_sql("fx_requests", 2, "admq")) + """
SELECT request_id, user_id, admitted FROM admq""")
def q_admission_control_queue(spark, sf_dir):
    return _admission(spark, sf_dir, True, 2).select("request_id", "user_id", "admitted")


_CHAIN_CTE = [CTE_REQ, CTE_USERS, ("chain0", f"""
SELECT request_id, user_id, ts_us,
       CASE WHEN NOT (slash_restrict IS NULL OR channel = slash_restrict) THEN 'slash_channel'
            WHEN instruction_input IS NOT NULL THEN 'instruction_input'
            WHEN NOT (all_restrict IS NULL OR channel = all_restrict) THEN 'channel'
            WHEN toxicity > 0.8 THEN 'moderation'
            WHEN (ts_us - joined_us) < 48 * {HOUR_US} THEN 'tenure' END AS pre_reason
FROM fx_joined"""), ("chain_pass", "SELECT request_id, user_id, ts_us FROM chain0 WHERE pre_reason IS NULL"),
    *admission_sql("chain_pass", 1, "chain_adm")]


@query("gate_chain", with_ctes(*_CHAIN_CTE) + """
SELECT c.request_id, COALESCE(c.pre_reason, CASE WHEN NOT a.admitted THEN 'queue' END) AS reason,
       COALESCE(c.pre_reason, CASE WHEN NOT a.admitted THEN 'queue' END) IS NULL AS admitted
FROM chain0 c LEFT JOIN chain_adm a ON a.request_id = c.request_id""")
def q_gate_chain(spark, sf_dir):
    j = fx_joined(spark, sf_dir)
    pre = G.gate_chain(j, [
        ("slash_channel", G.gate_channel("channel", F.col("slash_restrict"))),
        ("instruction_input", G.gate_instruction_input("instruction_input", False)),
        ("channel", G.gate_channel("channel", F.col("all_restrict"))),
        ("moderation", ~M.moderate_scores({"toxicity": K.THRESHOLDS["toxicity"]})),
        ("tenure", G.gate_tenure("joined_us", "ts_us", 48)),
    ])
    passed = (pre.filter(F.col("admitted")).select("request_id", "user_id", "ts_us")
              .withColumn("end_us", F.col("ts_us") + 6 * HOUR_US))
    adm = A.admission_control(passed).select("request_id", F.col("admitted").alias("queue_ok"))
    out = pre.select("request_id", F.col("reason").alias("pre_reason")).join(adm, on="request_id", how="left")
    reason = F.coalesce(F.col("pre_reason"), F.when(~F.col("queue_ok"), F.lit("queue")))
    return out.select("request_id", reason.alias("reason"), reason.isNull().alias("admitted"))


@query("request_timeout", """
WITH s AS (SELECT event_id AS request_id, user_id, epoch_us(ts) AS ts_us FROM events WHERE event_type = 'click'),
f AS (SELECT event_id AS request_id, user_id, epoch_us(ts) AS ts_us FROM events WHERE event_type = 'purchase'),
m AS (SELECT s.request_id, s.ts_us, min(f.ts_us) AS fts, arg_min(f.request_id, f.ts_us) AS fid
      FROM s LEFT JOIN f ON f.user_id = s.user_id AND f.ts_us > s.ts_us GROUP BY s.request_id, s.ts_us)
SELECT request_id, CASE WHEN fts <= ts_us + """ + str(6 * HOUR_US) + """ THEN fid END AS finish_id,
       COALESCE(fts <= ts_us + """ + str(6 * HOUR_US) + """, false) AS finished FROM m""")
def q_request_timeout(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "user_id",
                                                 X.epoch_us(F.col("ts")).alias("ts_us"), "event_type")
    starts = ev.filter(F.col("event_type") == "click").drop("event_type")
    fins = ev.filter(F.col("event_type") == "purchase").drop("event_type")
    return A.request_timeout(starts, fins, 6 * HOUR_US).select("request_id", "finish_id", "finished")


# ------------------------------------------------------------------ views

VIEW_LABELS = ["Write Next Prompt", "Continue"]


def fx_views(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    items = F.array(
        F.struct(F.lit("Write Next Prompt").alias("label"), F.concat(eid.cast("string"), F.lit("-prompt-modal")).alias("custom_id"), F.lit(0).alias("row")),
        F.struct(F.when(eid % 13 == 0, F.lit("Regenerate")).otherwise(F.lit("Continue")).alias("label"),
                 F.concat(eid.cast("string"), F.lit("-continue")).alias("custom_id"), F.lit(0).alias("row")))
    return ev.select(eid.alias("message_id"), F.col("user_id").alias("uid"),
                     T.short_id(eid).alias("short_id_parent"), F.lit("").alias("prompt"),
                     F.concat(eid.cast("string"), F.lit("-prompt-entry")).alias("prompt_input_element_custom_id"),
                     F.floor(X.epoch_us(F.col("ts")) / 1_000_000).cast("bigint").alias("time"), items.alias("items"))


CTE_VIEWS = ("fx_views", f"""
SELECT event_id AS message_id, user_id AS uid, {short_id_sql('CAST(event_id AS VARCHAR)')} AS short_id_parent,
       '' AS prompt, CAST(event_id AS VARCHAR) || '-prompt-entry' AS prompt_input_element_custom_id,
       CAST(epoch_us(ts) // 1000000 AS BIGINT) AS time,
       [{{'label': 'Write Next Prompt', 'custom_id': CAST(event_id AS VARCHAR) || '-prompt-modal', 'row': 0}},
        {{'label': CASE WHEN event_id % 13 = 0 THEN 'Regenerate' ELSE 'Continue' END,
          'custom_id': CAST(event_id AS VARCHAR) || '-continue', 'row': 0}}] AS items
FROM events""")


@query("restore_views", with_ctes(CTE_VIEWS) + """
SELECT message_id, CASE WHEN list_bool_and(list_transform(items, lambda x: x.label IN ('Write Next Prompt', 'Continue')))
                        THEN 'kept' ELSE 'skipped' END AS status
FROM fx_views WHERE time >= (SELECT max(time) FROM fx_views) - 432000""")
def q_restore_views(spark, sf_dir):
    v = fx_views(spark, sf_dir)
    now = v.select(F.max("time")).scalar()
    kept, skipped = G.restore_views(v, now, 5 * 86400, VIEW_LABELS)
    return (kept.select("message_id", F.lit("kept").alias("status"))
            .unionByName(skipped.select("message_id", F.lit("skipped").alias("status"))))


@query("view_log", with_ctes(CTE_VIEWS) + """
SELECT message_id, uid, short_id_parent, time, CAST(len(items) AS INTEGER) AS n_items,
       array_to_string(list_transform(items, lambda x: x.label || '|' || x.custom_id), ',') AS item_desc
FROM fx_views""")
def q_view_log(spark, sf_dir):
    path = scratch_path(spark, "view_log")
    logs.write_view_log(fx_views(spark, sf_dir), path)
    v = logs.read_view_log(spark, path)
    return v.select("message_id", "uid", "short_id_parent", "time", F.size("items").alias("n_items"),
                    F.array_join(F.transform("items", lambda x: F.concat(x["label"], F.lit("|"), x["custom_id"])), ",").alias("item_desc"))


# ------------------------------------------------------------------ pairs

def fx_pairs(spark, sf_dir):
    conv = X.table(spark, sf_dir, "conversations")
    users = conv.filter(F.col("role") == "user").select(F.col("conv_id").alias("uid"), "turn", F.col("text").alias("prompt"))
    asst = conv.filter(F.col("role") == "assistant").select(F.col("conv_id").alias("uid"), (F.col("turn") - 1).alias("turn"),
                                                            F.col("text").alias("output"))
    p = users.join(asst, on=["uid", "turn"])
    p = p.withColumn("short_id", T.short_id(F.concat_ws(":", F.col("uid").cast("string"), F.col("turn").cast("string"))))
    w = Window.partitionBy("uid").orderBy("turn")
    return p.select("uid", "turn", "short_id", F.lag("short_id").over(w).alias("short_id_parent"), "prompt", "output",
                    (F.lit(128) + F.lit(64) * (F.col("turn") % 8)).cast("int").alias("max_tokens"),
                    ((F.lit(50) + F.col("uid") % 50).cast("double") / 100.0).alias("temperature"),
                    F.lit(0.95).alias("top_p"))


CTE_PAIRS = ("fx_pairs", f"""
SELECT uid, turn, short_id, lag(short_id) OVER (PARTITION BY uid ORDER BY turn) AS short_id_parent, prompt, output,
       CAST(128 + 64 * (turn % 8) AS INTEGER) AS max_tokens, CAST(50 + uid % 50 AS DOUBLE) / 100.0 AS temperature,
       0.95::DOUBLE AS top_p
FROM (SELECT u.conv_id AS uid, u.turn, u.text AS prompt, a.text AS output,
             {short_id_sql("CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR)")} AS short_id
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant')""")


@query("short_id", f"""
SELECT event_id, {short_id_sql('CAST(event_id AS VARCHAR)')} AS sid FROM events""")
def q_short_id(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", T.short_id(F.col("event_id")).alias("sid"))


@query("request_log", with_ctes(CTE_PAIRS) + """
SELECT uid, short_id, prompt, output, max_tokens, temperature, top_p FROM fx_pairs""")
def q_request_log(spark, sf_dir):
    path = scratch_path(spark, "request_log")
    logs.write_request_log(fx_pairs(spark, sf_dir), path)
    return logs.read_request_log(spark, path).select("uid", "short_id", "prompt", "output", "max_tokens", "temperature", "top_p")


@query("attach_parent", with_ctes(CTE_PAIRS) + """
SELECT c.uid, c.short_id, c.short_id_parent, p.prompt AS parent_prompt, p.output AS parent_output,
       p.max_tokens AS parent_max_tokens, p.temperature AS parent_temperature, p.top_p AS parent_top_p
FROM fx_pairs c JOIN fx_pairs p ON p.uid = c.uid AND p.short_id = c.short_id_parent""")
def q_attach_parent(spark, sf_dir):
    joined, _orphans = TH.attach_parent(fx_pairs(spark, sf_dir))
    return joined.select("uid", "short_id", "short_id_parent", "parent_prompt", "parent_output",
                         "parent_max_tokens", "parent_temperature", "parent_top_p")


def _input_col():
    return F.when(F.col("uid") % 2 == 1, F.concat(F.lit("Context "), F.col("uid").cast("string")))


_INPUT_SQL = "CASE WHEN uid % 2 = 1 THEN 'Context ' || CAST(uid AS VARCHAR) END"
_PNI = sql_str(K.PREFIX_NO_INPUT + K.INSTRUCT)
_PI = sql_str(K.PREFIX_INPUT + K.INSTRUCT)
_IN = sql_str(K.INPUT)
_ANS = sql_str(K.ANSWER)


def format_sql(p: str, inp: str) -> str:
    return (f"CASE WHEN contains({p}, '### Input:') THEN {p} WHEN {inp} IS NULL THEN {_PNI} || {p} || {_ANS} "
            f"ELSE {_PI} || {p} || {_IN} || {inp} || {_ANS} END")


@query("format_instruction", with_ctes(CTE_PAIRS) + f"""
SELECT uid, short_id, {format_sql('prompt', _INPUT_SQL)} AS formatted FROM fx_pairs""")
def q_format_instruction(spark, sf_dir):
    p = fx_pairs(spark, sf_dir)
    return p.select("uid", "short_id", T.format_instruction("prompt", _input_col(), True, False).alias("formatted"))


@query("extract_response", with_ctes(CTE_PAIRS) + f"""
SELECT uid, short_id, split_part(full_text, {_ANS}, -1) AS answer FROM (
  SELECT uid, short_id, CASE WHEN turn % 4 = 0 THEN output
                             ELSE {format_sql('prompt', _INPUT_SQL)} || output END AS full_text FROM fx_pairs)""")
def q_extract_response(spark, sf_dir):
    p = fx_pairs(spark, sf_dir)
    full = F.when(F.col("turn") % 4 == 0, F.col("output")).otherwise(
        F.concat(T.format_instruction("prompt", _input_col(), True, False), F.col("output")))
    return p.select("uid", "short_id", T.extract_response(full).alias("answer"))


@query("strip_echo", with_ctes(CTE_PAIRS) + """
SELECT uid, short_id, CASE WHEN position(prompt IN o) > 0 THEN substr(o, length(prompt) + 1) ELSE o END AS stripped
FROM (SELECT uid, short_id, prompt,
             CASE WHEN turn % 3 = 0 THEN prompt || output
                  WHEN turn % 3 = 1 THEN left(output, 7) || prompt || output ELSE output END AS o FROM fx_pairs)""")
def q_strip_echo(spark, sf_dir):
    p = fx_pairs(spark, sf_dir)
    o = (F.when(F.col("turn") % 3 == 0, F.concat("prompt", "output"))
         .when(F.col("turn") % 3 == 1, F.concat(F.left("output", F.lit(7)), "prompt", "output")).otherwise(F.col("output")))
    return p.select("uid", "short_id", T.strip_echo(o, F.col("prompt")).alias("stripped"))


def display_sql(p: str, inp: str) -> str:
    extra, pni, pi = sql_str(K.EXTRA_MYSTERY_LINE), sql_str(K.PREFIX_NO_INPUT), sql_str(K.PREFIX_INPUT)
    ins, inpm, ans = sql_str(K.INSTRUCT), sql_str(K.INPUT), sql_str(K.ANSWER)
    t = f"replace({p}, {extra}, '')"
    no_in = f"replace(replace(replace({t}, {pni}, ''), {ins}, ''), {ans}, '')"
    with_in = f"replace(replace(replace(replace({t}, {pi}, ''), {inpm}, chr(10) || chr(10)), {ins}, ''), {ans}, '')"
    return (f"CASE WHEN length({p}) > 256 THEN '...' || right({p}, 256) "
            f"WHEN {inp} IS NULL THEN {no_in} ELSE {with_in} END")


@query("display_prompt", with_ctes(CTE_PAIRS) + f"""
SELECT uid, short_id, {display_sql('fp', 'inp')} AS shown FROM (
  SELECT uid, short_id, {_INPUT_SQL} AS inp, {format_sql('prompt', _INPUT_SQL)} AS fp FROM fx_pairs)""")
def q_display_prompt(spark, sf_dir):
    p = fx_pairs(spark, sf_dir).withColumn("inp", _input_col())
    p = p.withColumn("fp", T.format_instruction("prompt", F.col("inp"), True, False))
    return p.select("uid", "short_id", T.display_prompt("fp", F.col("inp"), True).alias("shown"))


@query("chunk_text", with_ctes(CTE_PAIRS) + """
SELECT uid, short_id, CAST(i AS INTEGER) AS chunk_idx, CASE WHEN i = 0 THEN 'Output' ELSE 'Continued Output' END AS title,
       substr(output, CAST(i * 1024 + 1 AS INTEGER), 1024) AS chunk
FROM (SELECT uid, short_id, output, unnest(range(0, (length(output) + 1023) // 1024)) AS i FROM fx_pairs)""")
def q_chunk_text(spark, sf_dir):
    from ..operators.text_ops import chunk_text
    p = fx_pairs(spark, sf_dir).select("uid", "short_id", "output")
    return chunk_text(p, "output").select("uid", "short_id", "chunk_idx", "title", "chunk")


@query("tail_text", """SELECT doc_id, right(text, 1900) AS tail FROM documents""")
def q_tail_text(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.tail_text("text").alias("tail"))


@query("completion_link", """
SELECT event_id, 'https://discord.com/channels/' || COALESCE(CAST(NULLIF(user_id % 10, 0) AS VARCHAR), '@me') || '/'
       || CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) AS link FROM events""")
def q_completion_link(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events")
    guild = F.when(F.col("user_id") % 10 != 0, F.col("user_id") % 10)
    return ev.select("event_id", T.completion_link(guild, F.col("user_id"), F.col("event_id")).alias("link"))


def cont_sql(prompt: str, output: str, new: str, template: bool) -> str:
    text = f"({prompt} || ' ' || {output})"
    if not template:
        return f"CASE WHEN {new} IS NOT NULL AND length({new}) > 0 THEN {text} || chr(10) || {new} ELSE {text} END"
    ans = _ANS
    at = f"position({ans} IN {text})"
    head = f"CASE WHEN {at} > 0 THEN substr({text}, 1, {at} - 1 + {len(K.ANSWER)}) ELSE {text} END"
    answer = f"CASE WHEN {at} > 0 THEN split_part({text}, {ans}, -1) ELSE '' END"
    cut = f"CASE WHEN length({answer}) > 0 THEN substr({answer}, 1, length({answer}) - 1) ELSE '' END"
    base = f"({head} || chr(10) || {cut})"
    tn = f"({_PNI} || {new} || {_ANS})"
    return f"CASE WHEN {new} IS NOT NULL AND length({new}) > 0 THEN {base} || chr(10) || {tn} ELSE {base} END"


@query("continue_prompt", with_ctes(CTE_PAIRS) + f"""
SELECT c.uid, c.short_id, {cont_sql('p.prompt', 'p.output', 'c.prompt', False)} AS plain_prompt,
       {cont_sql('p.tp', 'p.tout', 'c.prompt', True)} AS template_prompt
FROM fx_pairs c JOIN (SELECT *, {format_sql('prompt', 'NULL')} AS tp,
                             {format_sql('prompt', 'NULL')} || output AS tout FROM fx_pairs) p
  ON p.uid = c.uid AND p.short_id = c.short_id_parent""")
def q_continue_prompt(spark, sf_dir):
    joined, _ = TH.attach_parent(fx_pairs(spark, sf_dir))
    tp = T.format_instruction("parent_prompt", None, True, False)
    j = joined.withColumn("tp", tp).withColumn("tout", F.concat(tp, F.col("parent_output")))
    return j.select("uid", "short_id",
                    T.continue_prompt("parent_prompt", "parent_output", F.col("prompt"), template=False).alias("plain_prompt"),
                    T.continue_prompt("tp", "tout", F.col("prompt"), template=True).alias("template_prompt"))


@query("thread_context", with_ctes(CTE_PAIRS) + """
SELECT uid, short_id, array_to_string(list_transform(list_sort(acc), lambda x: x.p), '') AS context FROM (
  SELECT uid, short_id, list({'o': turn, 'p': piece}) OVER (PARTITION BY uid ORDER BY turn
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc
  FROM (SELECT uid, short_id, turn,
               CASE WHEN po IS NULL THEN prompt ELSE ' ' || po || chr(10) || prompt END AS piece
        FROM (SELECT *, lag(CASE WHEN position(prompt IN output) > 0 THEN substr(output, length(prompt) + 1) ELSE output END)
                        OVER (PARTITION BY uid ORDER BY turn) AS po FROM fx_pairs)))""")
def q_thread_context(spark, sf_dir):
    return TH.thread_context(fx_pairs(spark, sf_dir)).select("uid", "short_id", "context")


def fx_attempts(spark, sf_dir):
    p = fx_pairs(spark, sf_dir).select("uid", "short_id", "prompt", "output")
    p = p.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(K.MAX_ATTEMPTS))))
    out = (F.when(F.col("uid") % 11 == 0, F.col("prompt"))
           .when((F.col("attempt") == 1) & (F.col("uid") % 3 == 0), F.col("prompt"))
           .otherwise(F.concat(F.col("output"), F.lit(" ["), F.col("attempt").cast("string"), F.lit("]"))))
    return p.withColumn("output", out)


@query("first_valid_attempt", with_ctes(CTE_PAIRS) + f"""
SELECT uid, short_id, COALESCE(arg_min(o, CASE WHEN o <> prompt THEN a END), {sql_str(K.FALLBACK_ANSWER)}) AS answer,
       min(CASE WHEN o <> prompt THEN a END) AS chosen_attempt
FROM (SELECT uid, short_id, prompt, a,
             CASE WHEN uid % 11 = 0 THEN prompt WHEN a = 1 AND uid % 3 = 0 THEN prompt
                  ELSE output || ' [' || CAST(a AS VARCHAR) || ']' END AS o
      FROM fx_pairs, range(1, 6) r(a)) GROUP BY uid, short_id""")
def q_first_valid_attempt(spark, sf_dir):
    r = TH.first_valid_attempt(fx_attempts(spark, sf_dir))
    return r.select("uid", "short_id", "answer", F.col("chosen_attempt").cast("bigint").alias("chosen_attempt"))


@query("thread_context_template", with_ctes(CTE_PAIRS) + f"""
SELECT uid, short_id,
       CASE WHEN po IS NULL THEN {format_sql('prompt', 'NULL')}
            ELSE hd || chr(10) || (CASE WHEN length(a) > 0 THEN substr(a, 1, length(a) - 1) ELSE '' END)
                 || CASE WHEN prompt IS NOT NULL AND length(prompt) > 0 THEN chr(10) || {_PNI} || prompt || {_ANS} ELSE '' END
       END AS context
FROM (SELECT *, split_part(' ' || po, {_ANS}, -1) AS a,
             CASE WHEN position({_ANS} IN ft) > 0 THEN substr(ft, 1, position({_ANS} IN ft) - 1 + {len(K.ANSWER)}) ELSE ft END AS hd
      FROM (SELECT *, lag(CASE WHEN position(prompt IN output) > 0 THEN substr(output, length(prompt) + 1) ELSE output END)
                      OVER (PARTITION BY uid ORDER BY turn) AS po,
                   first({format_sql('prompt', 'NULL')}) OVER (PARTITION BY uid ORDER BY turn
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ft
            FROM fx_pairs))""")
def q_thread_context_template(spark, sf_dir):
    return TH.thread_context(fx_pairs(spark, sf_dir), template=True).select("uid", "short_id", "context")


# ------------------------------------------------------------------ branching threads

def fx_tree(spark, sf_dir):
    """The pairs of a conversation as a binary tree (turn n answers turn n div 2); every
    thirteenth user's second turn has lost its parent."""
    p = fx_pairs(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy("turn")))
    up = p.select("uid", (F.col("n")).alias("up"), F.col("short_id").alias("up_id"))
    j = p.withColumn("up", F.floor(F.col("n") / 2).cast("int")).join(up, ["uid", "up"], "left")
    gone = (F.col("uid") % 13 == 0) & (F.col("n") == 2)
    return j.select("uid", "short_id", F.when(gone, F.lit("gone")).otherwise(F.col("up_id")).alias("short_id_parent"), "prompt", "output")


_STRIPPED = "CASE WHEN position({0}prompt IN {0}output) > 0 THEN substr({0}output, length({0}prompt) + 1) ELSE {0}output END"
_TREE_CTE = [CTE_PAIRS, ("numbered", "SELECT *, row_number() OVER (PARTITION BY uid ORDER BY turn) AS n FROM fx_pairs"), ("tree", """
SELECT c.uid, c.short_id, CASE WHEN c.uid % 13 = 0 AND c.n = 2 THEN 'gone' ELSE p.short_id END AS parent, c.prompt, c.output
FROM numbered c LEFT JOIN numbered p ON p.uid = c.uid AND p.n = c.n // 2"""), ("paths", f"""
SELECT * FROM (WITH RECURSIVE r(uid, short_id, depth, context, root_prompt, po, prompt, output) AS (
  SELECT uid, short_id, 0::BIGINT, prompt, prompt, CAST(NULL AS VARCHAR), prompt, output FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT t.uid, t.short_id, r.depth + 1, r.context || ' ' || {_STRIPPED.format('r.')} || chr(10) || t.prompt, r.root_prompt, {_STRIPPED.format('r.')}, t.prompt, t.output
  FROM r JOIN tree t ON t.uid = r.uid AND t.parent = r.short_id)
SELECT uid, short_id, depth, context, root_prompt, po FROM r)""")]


@query("thread_forest", with_ctes(*_TREE_CTE) + """
SELECT t.uid, t.short_id, p.depth, p.depth IS NULL AS orphan, p.context
FROM tree t LEFT JOIN paths p ON p.uid = t.uid AND p.short_id = t.short_id""")
def q_thread_forest(spark, sf_dir):
    return TH.thread_forest(fx_tree(spark, sf_dir)).select("uid", "short_id", "depth", "orphan", "context")


@query("thread_forest_template", with_ctes(*_TREE_CTE) + f"""
SELECT uid, short_id, depth, depth IS NULL AS orphan,
       CASE WHEN depth IS NULL THEN NULL WHEN po IS NULL THEN {format_sql('prompt', 'NULL')}
            ELSE hd || chr(10) || (CASE WHEN length(a) > 0 THEN substr(a, 1, length(a) - 1) ELSE '' END)
                 || CASE WHEN prompt IS NOT NULL AND length(prompt) > 0 THEN chr(10) || {_PNI} || prompt || {_ANS} ELSE '' END
       END AS context
FROM (SELECT *, split_part(' ' || po, {_ANS}, -1) AS a,
             CASE WHEN position({_ANS} IN ft) > 0 THEN substr(ft, 1, position({_ANS} IN ft) - 1 + {len(K.ANSWER)}) ELSE ft END AS hd
      FROM (SELECT t.uid, t.short_id, t.prompt, p.depth, p.po, {format_sql('p.root_prompt', 'NULL')} AS ft
            FROM tree t LEFT JOIN paths p ON p.uid = t.uid AND p.short_id = t.short_id))""")
def q_thread_forest_template(spark, sf_dir):
    return TH.thread_forest(fx_tree(spark, sf_dir), template=True).select("uid", "short_id", "depth", "orphan", "context")
