"""Corpus and scoring queries (minimum slice first): Spark plan + DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import scoring as S
from . import fixtures as X
from .registry import query, with_ctes

L = X.L_WINDOW


def _ordered_md5(pos: str, tok: str):
    """md5 of the tokens joined by ' ' in ``pos`` order (an aggregate)."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(tok)))),
                                          lambda x: x[tok]), " "))


# ------------------------------------------------------------------ sources

@query("corpus_split", """
SELECT doc_id, lang AS dataset, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'eval' END AS split,
       n_chars FROM documents""")
def q_corpus_split(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"), "n_chars")
    return C.corpus_split(docs, "doc_id", 80)


@query("tokenize", with_ctes(X.CTE_TOKENS) + """
SELECT doc_id, dataset, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tok_md5
FROM fx_tokens""")
def q_tokenize(spark, sf_dir):
    t = X.fx_tokens(spark, sf_dir)
    return t.select("doc_id", "dataset", F.size("tokens").alias("n_tokens"),
                    F.md5(F.array_join("tokens", " ")).alias("tok_md5"))


@query("token_stream", with_ctes(X.CTE_TOKENS, X.CTE_STREAM) + """
SELECT dataset, split, doc_id, idx, pos, token FROM fx_stream""")
def q_token_stream(spark, sf_dir):
    return X.fx_stream(spark, sf_dir).select("dataset", "split", "doc_id", "idx", "pos", "token")


@query("eval_segments", with_ctes(X.CTE_TOKENS, X.CTE_STREAM, X.CTE_EVALSEG) + """
SELECT dataset, seg, count(*) AS n_tok, md5(string_agg(token, ' ' ORDER BY pos)) AS seg_md5
FROM fx_evalseg GROUP BY dataset, seg""")
def q_eval_segments(spark, sf_dir):
    return (X.fx_evalseg(spark, sf_dir).groupBy("dataset", "seg")
            .agg(F.count(F.lit(1)).alias("n_tok"), _ordered_md5("pos", "token").alias("seg_md5")))


@query("shift_labels", with_ctes(X.CTE_TOKENS, X.CTE_STREAM, X.CTE_EVALSEG, X.CTE_TARGETS) + """
SELECT dataset, seg, pos, token, target FROM fx_targets""")
def q_shift_labels(spark, sf_dir):
    return X.fx_targets(spark, sf_dir).select("dataset", "seg", "pos", "token", "target")


_NLL_CTES = (X.CTE_TOKENS, X.CTE_STREAM, X.CTE_EVALSEG, X.CTE_TARGETS, *X.CTE_MODEL, X.CTE_NLL)


@query("ngram_nll", with_ctes(*_NLL_CTES) + """
SELECT dataset, pos, token, target, nll_n FROM fx_nll""")
def q_ngram_nll(spark, sf_dir):
    return X.fx_nll(spark, sf_dir).select("dataset", "pos", "token", "target", "nll_n")


@query("perplexity", with_ctes(*_NLL_CTES) + f"""
SELECT dataset, count(*) AS n_segments,
       round(exp((CAST(sum(s) AS DOUBLE) / 1000000000) / CAST(count(*) * {L - 1} AS DOUBLE)), 6) AS ppl
FROM (SELECT dataset, seg, sum(nll_n) AS s FROM fx_nll GROUP BY dataset, seg) GROUP BY dataset""")
def q_perplexity(spark, sf_dir):
    return S.perplexity(X.fx_nll(spark, sf_dir), L).select("dataset", "n_segments", "ppl")


@query("running_perplexity", with_ctes(*_NLL_CTES) + """
SELECT dataset, pos,
       round(exp((CAST(sum(nll_n) OVER w AS DOUBLE) / 1000000000) / CAST(count(*) OVER w AS DOUBLE)), 6) AS running_ppl
FROM fx_nll WINDOW w AS (PARTITION BY dataset ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_perplexity(spark, sf_dir):
    nll = X.fx_nll(spark, sf_dir).select("dataset", "pos", "nll_n")       # no other column goes through the scan
    return S.running_perplexity(nll, ("dataset",), "pos").select("dataset", "pos", "running_ppl")


@query("vocab", with_ctes(X.CTE_TOKENS) + """
SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS id
FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM fx_tokens) GROUP BY token)""")
def q_vocab(spark, sf_dir):
    toks = X.fx_tokens(spark, sf_dir).select(F.explode("tokens").alias("token"))
    return C.vocab(toks)


_WIN_SQL = with_ctes(X.CTE_TOKENS, X.CTE_STREAM, X.CTE_TRAIN_STREAM, ("wins", f"""
SELECT dataset, k AS sample_id, {X.md5_int_sql("'0'", "CAST(k AS VARCHAR)")} % (n - {L}) AS start
FROM (SELECT dataset, count(*) AS n FROM fx_train_stream GROUP BY dataset) s, range({X.N_SAMPLES}) r(k)
WHERE n > {L}"""), ("win_rows", f"""
SELECT w.dataset, w.sample_id, w.start, t.pos, t.token
FROM wins w JOIN fx_train_stream t ON t.dataset = w.dataset AND t.pos >= w.start AND t.pos < w.start + {L}"""))


def _windows(spark, sf_dir):
    stream = X.fx_stream(spark, sf_dir).filter(F.col("split") == "train").select("dataset", "pos", "token")
    return C.sample_windows(stream, X.N_SAMPLES, L, X.SEED)


@query("sample_windows", _WIN_SQL + """
SELECT dataset, sample_id, start, count(*) AS n_tok, md5(string_agg(token, ' ' ORDER BY pos)) AS win_md5
FROM win_rows GROUP BY dataset, sample_id, start""")
def q_sample_windows(spark, sf_dir):
    return (_windows(spark, sf_dir).groupBy("dataset", "sample_id", "start")
            .agg(F.count(F.lit(1)).alias("n_tok"), _ordered_md5("pos", "token").alias("win_md5")))


def _tok_id(c):
    return F.conv(F.substr(F.md5(c), F.lit(1), F.lit(7)), 16, 10).cast("int")


@query("mask_labels", _WIN_SQL + f"""
SELECT dataset, sample_id, CAST(len(list_filter(labels, lambda x: x = -100)) AS INTEGER) AS n_masked,
       labels[{L}] AS label_last, md5(array_to_string(labels, ',')) AS labels_md5
FROM (SELECT dataset, sample_id,
             list_transform(ids, lambda x, i: CASE WHEN i = len(ids) THEN x ELSE -100 END) AS labels
      FROM (SELECT dataset, sample_id,
                   list(('0x' || substr(md5(token), 1, 7))::INTEGER ORDER BY pos) AS ids
            FROM win_rows GROUP BY dataset, sample_id))""")
def q_mask_labels(spark, sf_dir):
    from ..functions.text import mask_labels
    w = _windows(spark, sf_dir)
    arr = (w.groupBy("dataset", "sample_id")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))),
                            lambda x: _tok_id(x["token"])).alias("ids")))
    lab = arr.withColumn("labels", mask_labels("ids"))
    return lab.select("dataset", "sample_id",
                      F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"),
                      F.element_at("labels", L).alias("label_last"),
                      F.md5(F.array_join(F.col("labels").cast("array<string>"), ",")).alias("labels_md5"))


def _doc_windows_sql(split: str, n: int, seed: int) -> tuple:
    return with_ctes(X.CTE_TOKENS, (f"elig_{split}", f"""
SELECT dataset, doc_id, tokens, len(tokens) AS n,
       row_number() OVER (PARTITION BY dataset ORDER BY doc_id) - 1 AS rnk
FROM fx_tokens WHERE split = '{split}' AND len(tokens) > {L}"""), (f"picks_{split}", f"""
SELECT dataset, k AS sample_id, {X.md5_int_sql(f"'{seed}'", "'d'", "CAST(k AS VARCHAR)")} % c AS rnk
FROM (SELECT dataset, count(*) AS c FROM elig_{split} GROUP BY dataset) s, range({n}) r(k)"""), (f"dwin_{split}", f"""
SELECT p.dataset, p.sample_id, e.doc_id, st AS start, list_slice(e.tokens, st + 1, st + {L}) AS tokens
FROM (SELECT p.*, {X.md5_int_sql(f"'{seed}'", "'o'", "CAST(p.sample_id AS VARCHAR)")} AS h FROM picks_{split} p) p
JOIN elig_{split} e ON e.dataset = p.dataset AND e.rnk = p.rnk,
LATERAL (SELECT p.h % (e.n - {L}) AS st)"""))


def _doc_windows(spark, sf_dir, split, n, seed):
    docs = X.fx_tokens(spark, sf_dir).filter(F.col("split") == split).select("dataset", "doc_id", "tokens")
    return C.sample_doc_windows(docs, n, L, seed)


@query("sample_doc_windows", _doc_windows_sql("train", X.N_SAMPLES, 0) + """
SELECT dataset, sample_id, doc_id, start, md5(array_to_string(tokens, ' ')) AS win_md5 FROM dwin_train""")
def q_sample_doc_windows(spark, sf_dir):
    w = _doc_windows(spark, sf_dir, "train", X.N_SAMPLES, 0)
    return w.select("dataset", "sample_id", "doc_id", "start", F.md5(F.array_join("tokens", " ")).alias("win_md5"))


@query("pack_windows", _doc_windows_sql("eval", 256, 0) + f"""
SELECT dataset, CAST(sample_id * {L} + i - 1 AS BIGINT) AS pos, token
FROM (SELECT dataset, sample_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM dwin_eval)""")
def q_pack_windows(spark, sf_dir):
    return C.pack_windows(_doc_windows(spark, sf_dir, "eval", 256, 0), L)


@query("truncate_context", with_ctes(X.CTE_TOKENS) + """
SELECT doc_id, CAST(len(kept) AS INTEGER) AS n_kept, kept[1] AS first_kept, md5(array_to_string(kept, ' ')) AS kept_md5
FROM (SELECT doc_id, CASE WHEN len(tokens) > 2048 THEN list_slice(tokens, len(tokens) - 2048 + 1, len(tokens))
                          ELSE tokens END AS kept FROM fx_tokens)""")
def q_truncate_context(spark, sf_dir):
    from ..functions.text import truncate_context
    t = X.fx_tokens(spark, sf_dir).withColumn("kept", truncate_context("tokens", 2048))
    return t.select("doc_id", F.size("kept").alias("n_kept"), F.try_element_at("kept", F.lit(1)).alias("first_kept"),
                    F.md5(F.array_join("kept", " ")).alias("kept_md5"))


def _cands(spark, sf_dir, part=("dataset",)):
    _uni, big, ctx, _st = S.bigram_model(X.fx_train_docs(spark, sf_dir), part)
    return S.candidates(big, ctx, part)


_CAND = ("cands", "SELECT b.dataset, b.prev AS ctx, b.next AS token, b.cnt, c.ctx_cnt AS total "
                  "FROM m_big b JOIN m_ctx c ON b.dataset = c.dataset AND b.prev = c.prev")


@query("top_p_filter", with_ctes(X.CTE_TOKENS, *X.CTE_MODEL, _CAND) + """
SELECT dataset, ctx, token, cnt, CAST(cum_prev AS BIGINT) AS cum_prev FROM (
  SELECT *, COALESCE(sum(cnt) OVER (PARTITION BY dataset, ctx ORDER BY cnt DESC, token
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_prev
  FROM cands) WHERE CAST(cum_prev AS DOUBLE) < 0.9::DOUBLE * CAST(total AS DOUBLE)""")
def q_top_p_filter(spark, sf_dir):
    return S.top_p_filter(_cands(spark, sf_dir), 0.9).select("dataset", "ctx", "token", "cnt", "cum_prev")


@query("temperature_scale", with_ctes(X.CTE_TOKENS, *X.CTE_MODEL, _CAND) + """
SELECT dataset, ctx, token, round(w / sum(w) OVER (PARTITION BY dataset, ctx), 6) AS q
FROM (SELECT *, pow(CAST(cnt AS DOUBLE) / CAST(total AS DOUBLE), 1.0 / 0.7) AS w FROM cands)""")
def q_temperature_scale(spark, sf_dir):
    t = S.temperature_scale(_cands(spark, sf_dir), 0.7)
    return t.select("dataset", "ctx", "token", F.round("q", 6).alias("q"))


_GEN_STEPS = 16


@query("batch_generate", with_ctes(X.CTE_TOKENS, X.CTE_PROMPTS, ("g_train", "SELECT tokens FROM fx_tokens WHERE split = 'train'"),
                                   ("g_uni", "SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM g_train) GROUP BY token"),
                                   ("g_big", """SELECT prev, nxt, count(*) AS cnt FROM (
                                        SELECT unnest(list_slice(tokens, 1, greatest(len(tokens) - 1, 0))) AS prev,
                                               unnest(list_slice(tokens, 2, len(tokens))) AS nxt FROM g_train) GROUP BY prev, nxt"""),
                                   ("g_best", "SELECT prev AS ctx, arg_min(nxt, (-cnt, nxt)) AS nxt FROM g_big GROUP BY prev"),
                                   ("g_fb", "SELECT arg_min(token, (-cnt, token)) AS t FROM g_uni")).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "g_fb AS (", "g_fb AS MATERIALIZED (") + f""",
gen(conv_id, turn, step, last, seq) AS (
  SELECT conv_id, turn, 0, tokens[len(tokens)], []::VARCHAR[] FROM fx_prompts WHERE len(tokens) > 0
  UNION ALL
  SELECT g.conv_id, g.turn, g.step + 1, COALESCE(b.nxt, (SELECT t FROM g_fb)),
         list_append(g.seq, COALESCE(b.nxt, (SELECT t FROM g_fb)))
  FROM gen g LEFT JOIN g_best b ON b.ctx = g.last WHERE g.step < {_GEN_STEPS}),
fin AS (
  SELECT p.conv_id, p.turn, p.tokens, COALESCE(g.seq, []::VARCHAR[]) AS seq
  FROM fx_prompts p LEFT JOIN (SELECT * FROM gen WHERE step = {_GEN_STEPS}) g ON g.conv_id = p.conv_id AND g.turn = p.turn),
cut AS (
  SELECT *, list_position(list_transform(seq, lambda x: x IN ('<unk>', '<s>', '</s>', '�', '!0')), true) AS hit FROM fin)
SELECT conv_id, turn, CAST(len(gen) AS INTEGER) AS n_new, array_to_string(gen, ' ') AS generated
FROM (SELECT conv_id, turn, CASE WHEN hit > 0 THEN list_slice(seq, 1, hit - 1) ELSE seq END AS gen FROM cut)""")
def q_batch_generate(spark, sf_dir):
    train = X.fx_train_docs(spark, sf_dir)
    uni, big, ctx, _ = S.bigram_model(train.withColumn("dataset", F.lit("all")), ("dataset",))
    nxt = S.argmax_next(S.candidates(big, ctx, ("dataset",)).drop("dataset"))
    fallback = uni.agg(F.min_by("token", F.struct((-F.col("cnt")).alias("n"), F.col("token").alias("t")))).scalar()
    gen = S.batch_generate(X.fx_prompts(spark, sf_dir), nxt, fallback, _GEN_STEPS)
    return gen.select("conv_id", "turn", F.size("generated").alias("n_new"),
                      F.array_join("generated", " ").alias("generated"))


@query("cross_entropy", """
SELECT vec_id, round(m + ln(list_sum(list_transform(l, lambda x: exp(x - m)))) - l[label + 1], 6) AS ce
FROM (SELECT vec_id, label, l, list_max(l) AS m
      FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS l FROM embeddings))""")
def q_cross_entropy(spark, sf_dir):
    from ..functions.text import cross_entropy
    e = X.table(spark, sf_dir, "embeddings")
    logits = F.transform("embedding", lambda x: x.cast("double") * 10)
    return e.select("vec_id", F.round(cross_entropy(logits, F.col("label")), 6).alias("ce"))


@query("latency_summary", """
SELECT event_type AS run, count(*) AS n_steps, median(value) AS median_s,
       round(CAST(sum(CAST(value AS DECIMAL(30, 12))) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS mean_s,
       max(value) AS max_s, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS peak_mem
FROM events GROUP BY event_type""")
def q_latency_summary(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events")
    timings = ev.select(F.col("event_type").alias("run"), F.col("value").alias("seconds"),
                        F.get_json_object("props", "$.k").cast("int").alias("mem_mib"))
    return S.latency_summary(timings)


def stub_predictor():
    """A deterministic stand-in model: characters and lines of each text."""
    def predict(pdf):
        import pandas as pd
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"],
                             "n_chars": pdf["text"].str.len().astype("int32"),
                             "n_lines": (pdf["text"].str.count("\n") + 1).astype("int32")})
    return predict


@query("batch_predict", """
SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n_chars,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS n_lines
FROM conversations""")
def q_batch_predict(spark, sf_dir):
    conv = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return S.batch_predict(conv, stub_predictor, "conv_id long, turn long, n_chars int, n_lines int")


# Stop list for the query: the fixed stop words plus one two-token sequence so
# multi-token trimming and list order are exercised.
TRIM_STOPS = [[w] for w in S.K.STOP_WORDS] + [["###", "end"]]


def _trim_stop_sql() -> str:
    def arr(seq):
        return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in seq) + "]"
    stops = "[" + ", ".join(arr(s) for s in TRIM_STOPS) + "]"
    n = len(TRIM_STOPS)
    ctes = [X.CTE_TOKENS, ("ts0", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN tokens
                    WHEN doc_id % 3 = 1 THEN list_concat(tokens, {stops}[doc_id % {n} + 1])
                    ELSE list_concat(list_concat(tokens, {stops}[doc_id % {n} + 1]), {stops}[(doc_id + 1) % {n} + 1]) END AS a
FROM fx_tokens""")]
    for k, seq in enumerate(TRIM_STOPS):
        m = len(seq)
        ctes.append((f"ts{k + 1}", f"""
SELECT doc_id, CASE WHEN len(a) >= {m} AND list_slice(a, len(a) - {m} + 1, len(a)) = {arr(seq)}
                    THEN list_slice(a, 1, len(a) - {m}) ELSE a END AS a FROM ts{k}"""))
    last = f"ts{n}"
    return with_ctes(*ctes) + f"""
SELECT doc_id, CAST(len(a) AS INTEGER) AS n_tokens, array_to_string(list_slice(a, greatest(len(a) - 2, 1), len(a)), ' ') AS tail,
       md5(CASE WHEN suffix(t, '</s>') THEN left(t, length(t) - 4) ELSE t END) AS text_md5
FROM (SELECT doc_id, a, array_to_string(a, ' ') AS t FROM {last})"""


@query("trim_stop", _trim_stop_sql())
def q_trim_stop(spark, sf_dir):
    from ..functions.text import drop_end_marker, trim_stop
    t = X.fx_tokens(spark, sf_dir)
    stops = F.array(*[F.array(*[F.lit(x) for x in s]) for s in TRIM_STOPS])
    n = len(TRIM_STOPS)
    did = F.col("doc_id")
    a = (F.when(did % 3 == 0, F.col("tokens"))
         .when(did % 3 == 1, F.concat("tokens", F.element_at(stops, (did % n + 1).cast("int"))))
         .otherwise(F.concat("tokens", F.element_at(stops, (did % n + 1).cast("int")),
                             F.element_at(stops, ((did + 1) % n + 1).cast("int")))))
    r = t.select("doc_id", trim_stop(a, TRIM_STOPS).alias("a"))
    return r.select("doc_id", F.size("a").alias("n_tokens"),
                    F.array_join(F.slice("a", F.greatest(F.size("a") - 2, F.lit(1)), 3), " ").alias("tail"),
                    F.md5(drop_end_marker(F.array_join("a", " "))).alias("text_md5"))


_SAMPLE_T, _SAMPLE_P, _SAMPLE_SEED = 0.7, 0.9, 0


@query("batch_generate_sampled", with_ctes(
    X.CTE_TOKENS, X.CTE_PROMPTS, ("g_train", "SELECT tokens FROM fx_tokens WHERE split = 'train'"),
    ("g_uni", "SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM g_train) GROUP BY token"),
    ("g_big", """SELECT prev AS ctx, nxt AS token, count(*) AS cnt FROM (
         SELECT unnest(list_slice(tokens, 1, greatest(len(tokens) - 1, 0))) AS prev,
                unnest(list_slice(tokens, 2, len(tokens))) AS nxt FROM g_train) GROUP BY prev, nxt"""),
    ("g_w", f"""SELECT b.ctx, b.token, b.cnt,
         pow(CAST(b.cnt AS DOUBLE) / CAST(t.total AS DOUBLE), 1.0::DOUBLE / {_SAMPLE_T}::DOUBLE) AS w
         FROM g_big b JOIN (SELECT ctx, sum(cnt) AS total FROM g_big GROUP BY ctx) t ON t.ctx = b.ctx"""),
    ("g_cum", """SELECT *, COALESCE(sum(w) OVER (PARTITION BY ctx ORDER BY cnt DESC, token
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lo,
                         sum(w) OVER (PARTITION BY ctx) AS zall FROM g_w"""),
    ("g_keep", f"SELECT * FROM g_cum WHERE lo < {_SAMPLE_P}::DOUBLE * zall"),
    ("g_tab", "SELECT k.ctx, k.token, k.lo, z.z FROM g_keep k JOIN (SELECT ctx, sum(w) AS z FROM g_keep GROUP BY ctx) z ON z.ctx = k.ctx"),
    ("g_fb", "SELECT arg_min(token, (-cnt, token)) AS t FROM g_uni")).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
gen(conv_id, turn, step, last, seq) AS (
  SELECT conv_id, turn, 0, tokens[len(tokens)], []::VARCHAR[] FROM fx_prompts WHERE len(tokens) > 0
  UNION ALL
  SELECT g.conv_id, g.turn, g.step + 1, nx, list_append(g.seq, nx) FROM (
    SELECT g.*, COALESCE((SELECT arg_max(t.token, t.lo) FROM g_tab t
                          WHERE t.ctx = g.last AND t.lo <= ({X.md5_int_sql(f"'{_SAMPLE_SEED}'", "CAST(g.conv_id AS VARCHAR)", "CAST(g.turn AS VARCHAR)", "CAST(g.step AS VARCHAR)")}::DOUBLE / 281474976710656.0::DOUBLE) * t.z),
                         (SELECT t FROM g_fb)) AS nx
    FROM gen g WHERE g.step < {_GEN_STEPS}) g),
fin AS (
  SELECT p.conv_id, p.turn, COALESCE(g.seq, []::VARCHAR[]) AS seq
  FROM fx_prompts p LEFT JOIN (SELECT * FROM gen WHERE step = {_GEN_STEPS}) g ON g.conv_id = p.conv_id AND g.turn = p.turn),
cut AS (SELECT *, list_position(list_transform(seq, lambda x: x IN ('<unk>', '<s>', '</s>', '�', '!0')), true) AS hit FROM fin)
SELECT conv_id, turn, CAST(len(gen) AS INTEGER) AS n_new, array_to_string(gen, ' ') AS generated
FROM (SELECT conv_id, turn, CASE WHEN hit > 0 THEN list_slice(seq, 1, hit - 1) ELSE seq END AS gen FROM cut)""")
def q_batch_generate_sampled(spark, sf_dir):
    train = X.fx_train_docs(spark, sf_dir)
    uni, big, ctx, _ = S.bigram_model(train.withColumn("dataset", F.lit("all")), ("dataset",), totals=True)
    cands = S.candidates(big, ctx, ("dataset",)).drop("dataset")
    cdf = S.sampling_cdf(cands, _SAMPLE_P, _SAMPLE_T)
    fallback = uni.agg(F.min_by("token", F.struct((-F.col("cnt")).alias("n"), F.col("token").alias("t")))).scalar()
    gen = S.batch_generate_sampled(X.fx_prompts(spark, sf_dir), cdf, fallback, _GEN_STEPS, _SAMPLE_SEED)
    return gen.select("conv_id", "turn", F.size("generated").alias("n_new"), F.array_join("generated", " ").alias("generated"))
