"""Operator inputs derived from the driver tables, in Spark and as SQL CTEs.

Each ``fx_*`` function builds the DataFrame; the matching ``CTE_*`` tuple is
the same definition as DuckDB SQL for the oracle. Values derived from ids
(``event_id % 10`` ...) vary parameters across rows; nothing filters rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize_ws
from ..operators.corpus import corpus_split

L_WINDOW = 128          # window / segment length (the reference uses 2048)
N_SAMPLES = 128
SEED = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(c):
    """Microseconds since epoch of a timestamp_ntz column (time-zone free)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


# ---------------------------------------------------------------- documents

def fx_tokens(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"), "text")
    docs = corpus_split(docs, "doc_id", 80)
    return docs.select("doc_id", "dataset", "split", tokenize_ws("text").alias("tokens"))


CTE_TOKENS = ("fx_tokens", r"""
SELECT doc_id, lang AS dataset,
       CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'eval' END AS split,
       list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS tokens
FROM documents""")

CTE_STREAM = ("fx_stream", """
SELECT dataset, split, doc_id, CAST(idx AS INTEGER) AS idx, CAST(off + idx AS BIGINT) AS pos, token
FROM (SELECT dataset, split, doc_id, off, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS idx
      FROM (SELECT dataset, split, doc_id, tokens,
                   COALESCE(SUM(len(tokens)) OVER (PARTITION BY dataset, split ORDER BY doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
            FROM fx_tokens))""")

CTE_EVALSEG = ("fx_evalseg", f"""
SELECT s.dataset, s.pos, s.token, s.pos // {L_WINDOW} AS seg
FROM fx_stream s JOIN (SELECT dataset, max(pos) + 1 AS n FROM fx_stream WHERE split = 'eval' GROUP BY dataset) m
  ON s.dataset = m.dataset
WHERE s.split = 'eval' AND s.pos // {L_WINDOW} < m.n // {L_WINDOW}""")

CTE_TARGETS = ("fx_targets", """
SELECT dataset, seg, pos, token, lead(token) OVER (PARTITION BY dataset, seg ORDER BY pos) AS target
FROM fx_evalseg""")

CTE_MODEL = [
    ("train_docs", "SELECT dataset, tokens FROM fx_tokens WHERE split = 'train'"),
    ("m_uni", """SELECT dataset, token, count(*) AS cnt
                 FROM (SELECT dataset, unnest(tokens) AS token FROM train_docs) GROUP BY dataset, token"""),
    ("m_big", """SELECT dataset, prev, nxt AS next, count(*) AS cnt
                 FROM (SELECT dataset, unnest(list_slice(tokens, 1, greatest(len(tokens) - 1, 0))) AS prev,
                              unnest(list_slice(tokens, 2, len(tokens))) AS nxt FROM train_docs)
                 GROUP BY dataset, prev, nxt"""),
    ("m_ctx", "SELECT dataset, prev, sum(cnt) AS ctx_cnt FROM m_big GROUP BY dataset, prev"),
    ("m_stats", "SELECT dataset, sum(cnt) AS total, count(*) AS v FROM m_uni GROUP BY dataset"),
]

CTE_NLL = ("fx_nll", """
SELECT t.dataset, t.seg, t.pos, t.token, t.target, -ln(p) AS nll,
       CAST(floor(-ln(p) * 1000000000) AS BIGINT) AS nll_n
FROM (SELECT t.*,
             CASE WHEN c.ctx_cnt IS NULL
                  THEN (COALESCE(u.cnt, 0) + 1)::DOUBLE / (s.total + s.v + 1)::DOUBLE
                  ELSE 0.7 * (COALESCE(b.cnt, 0)::DOUBLE / c.ctx_cnt::DOUBLE)
                       + 0.3 * ((COALESCE(u.cnt, 0) + 1)::DOUBLE / (s.total + s.v + 1)::DOUBLE) END AS p
      FROM fx_targets t
      LEFT JOIN m_big b ON b.dataset = t.dataset AND b.prev = t.token AND b.next = t.target
      LEFT JOIN m_ctx c ON c.dataset = t.dataset AND c.prev = t.token
      LEFT JOIN m_uni u ON u.dataset = t.dataset AND u.token = t.target
      LEFT JOIN m_stats s ON s.dataset = t.dataset
      WHERE t.target IS NOT NULL) t""")


def fx_stream(spark, sf_dir) -> DataFrame:
    from ..operators.corpus import token_stream
    return token_stream(fx_tokens(spark, sf_dir), part=("dataset", "split"))


def fx_evalseg(spark, sf_dir) -> DataFrame:
    from ..operators.corpus import eval_segments, token_stream
    ev = fx_tokens(spark, sf_dir).filter(F.col("split") == "eval")          # the streams of the splits are apart
    ev = token_stream(ev, part=("dataset", "split")).drop("split")
    return eval_segments(ev, L_WINDOW, part=("dataset",))


def fx_targets(spark, sf_dir) -> DataFrame:
    from ..operators.scoring import shift_labels
    return shift_labels(fx_evalseg(spark, sf_dir).select("dataset", "seg", "pos", "token"))


def fx_train_docs(spark, sf_dir) -> DataFrame:
    return fx_tokens(spark, sf_dir).filter(F.col("split") == "train").select("dataset", "tokens")


def fx_nll(spark, sf_dir) -> DataFrame:
    from ..operators.scoring import ngram_nll
    return ngram_nll(fx_targets(spark, sf_dir), fx_train_docs(spark, sf_dir), lam=0.7)


CTE_TRAIN_STREAM = ("fx_train_stream", "SELECT dataset, pos, token FROM fx_stream WHERE split = 'train'")


def md5_int_sql(*parts: str) -> str:
    """SQL twin of ``corpus.md5_int``: parts are SQL expressions joined with ':'."""
    key = " || ':' || ".join(parts)
    return f"('0x' || substr(md5({key}), 1, 12))::BIGINT"


def fx_prompts(spark, sf_dir) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return conv.select("conv_id", "turn", tokenize_ws("text").alias("tokens"))


CTE_PROMPTS = ("fx_prompts", r"""
SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS tokens
FROM conversations WHERE role = 'user'""")
