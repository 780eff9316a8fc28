"""Gram-matrix queries and error-compensated quantization."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gram as G
from .q_quant import CTE_LONG, CTE_MATRIX, D, fx_matrix, range_sql, sz_sql
from .registry import query, with_ctes

_PAIRS = ("pairs", """
SELECT a.row, a.col AS i, b.col AS j, a.x * b.x AS p FROM fx_long a JOIN fx_long b ON a.row = b.row""")


@query("gram_matrix", with_ctes(CTE_MATRIX, CTE_LONG, _PAIRS) + """
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       round(2.0::DOUBLE * sum(p) / CAST((SELECT count(*) FROM fx_matrix) AS DOUBLE), 9) AS h
FROM pairs GROUP BY i, j""")
def q_gram_matrix(spark, sf_dir):
    g = G.gram_matrix(fx_matrix(spark, sf_dir), "vec", D)
    return g.select("i", "j", F.round("h", 9).alias("h"))


@query("gram_merge", with_ctes(CTE_MATRIX, CTE_LONG, _PAIRS, ("bs", """
SELECT i, j, row % 3 AS bt, sum(p) AS s FROM pairs GROUP BY i, j, row % 3"""), ("bm", """
SELECT row % 3 AS bt, CAST(count(*) AS DOUBLE) AS m FROM fx_matrix GROUP BY row % 3"""), ("h1", """
SELECT i, j, 2.0::DOUBLE / m * s AS h, m AS n FROM bs JOIN bm USING (bt) WHERE bt = 0"""), ("h2", """
SELECT h1.i, h1.j, h1.h * (h1.n / (h1.n + bm.m)) + (2.0::DOUBLE / (h1.n + bm.m)) * bs.s AS h, h1.n + bm.m AS n
FROM h1 JOIN bs ON bs.i = h1.i AND bs.j = h1.j AND bs.bt = 1 JOIN bm ON bm.bt = 1"""), ("h3", """
SELECT h2.i, h2.j, h2.h * (h2.n / (h2.n + bm.m)) + (2.0::DOUBLE / (h2.n + bm.m)) * bs.s AS h, h2.n + bm.m AS n
FROM h2 JOIN bs ON bs.i = h2.i AND bs.j = h2.j AND bs.bt = 2 JOIN bm ON bm.bt = 2""")) + """
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(h, 9) AS h FROM h3""")
def q_gram_merge(spark, sf_dir):
    m = fx_matrix(spark, sf_dir)
    state = None
    for bt in range(3):
        delta = G.gram_delta(m.filter(F.pmod(F.col("row"), F.lit(3)) == bt), "vec", D)
        state = G.gram_merge(state, delta)
    return state.select("i", "j", F.round("h", 9).alias("h"))


def fx_gram_dead(spark, sf_dir):
    """The matrix with input column 5 zeroed (a dead column)."""
    m = fx_matrix(spark, sf_dir)
    return m.withColumn("vec", F.transform("vec", lambda x, i: F.when(i == 5, F.lit(0.0)).otherwise(x)))


@query("gram_condition", with_ctes(CTE_MATRIX, ("fx_dead", """
SELECT row, list_transform(vec, lambda x, k: CASE WHEN k = 6 THEN 0.0::DOUBLE ELSE x END) AS vec FROM fx_matrix"""),
    ("fx_long2", """SELECT row, CAST(k - 1 AS INTEGER) AS col, x FROM (
        SELECT row, unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM fx_dead)"""),
    ("g", """SELECT a.col AS i, b.col AS j, 2.0::DOUBLE * sum(a.x * b.x) / CAST((SELECT count(*) FROM fx_dead) AS DOUBLE) AS h
             FROM fx_long2 a JOIN fx_long2 b ON a.row = b.row GROUP BY a.col, b.col"""),
    ("g1", "SELECT i, j, CASE WHEN i = j AND h = 0 THEN 1.0::DOUBLE ELSE h END AS h FROM g")) + """
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       round(CASE WHEN i = j THEN h + 0.01 * (SELECT avg(h) FROM g1 WHERE i = j) ELSE h END, 9) AS h FROM g1""")
def q_gram_condition(spark, sf_dir):
    g = G.gram_matrix(fx_gram_dead(spark, sf_dir), "vec", D)
    return G.gram_condition(g, 0.01).select("i", "j", F.round("h", 9).alias("h"))


@query("act_order", with_ctes(CTE_MATRIX, CTE_LONG) + """
SELECT col, round(diag, 9) AS diag, CAST(row_number() OVER (ORDER BY diag DESC, col) - 1 AS INTEGER) AS rank FROM (
  SELECT col, 2.0::DOUBLE * sum(x * x) / CAST((SELECT count(*) FROM fx_matrix) AS DOUBLE) AS diag FROM fx_long GROUP BY col)""")
def q_act_order(spark, sf_dir):
    a = G.act_order(G.gram_matrix(fx_matrix(spark, sf_dir), "vec", D))
    return a.select(F.col("col").cast("int").alias("col"), F.round("diag", 9).alias("diag"), "rank")


def gptq_sql(groupsize: int, act_order: bool, bits: int = 4) -> str:
    """The same solution the textbook way, column by column: invert the conditioned
    matrix by Gauss-Jordan steps, then quantize a column, push its error forward along
    its row of the inverse, and take the column out of the inverse. The matrix is one
    block wide (D columns), so groups see the weights before any error."""
    each = D if groupsize == -1 else groupsize
    params_from = "x" if groupsize == -1 else "CASE WHEN dead THEN 0.0::DOUBLE ELSE x END"
    lo, hi = range_sql("mn", "mx", False)
    scale, zero = sz_sql(lo, hi, bits, False)
    top = 2**bits - 1
    return with_ctes(CTE_MATRIX, CTE_LONG, _PAIRS, ("g", """
SELECT i, j, 2.0::DOUBLE * sum(p) / CAST((SELECT count(*) FROM fx_matrix) AS DOUBLE) AS h FROM pairs GROUP BY i, j"""), ("cols", f"""
SELECT i AS col, CAST({'row_number() OVER (ORDER BY h DESC, i) - 1' if act_order else 'i'} AS INTEGER) AS pos, h = 0 AS dead,
       CASE WHEN h = 0 THEN 1.0::DOUBLE ELSE h END + 0.01 * avg(CASE WHEN h = 0 THEN 1.0::DOUBLE ELSE h END) OVER () AS diagonal FROM g WHERE i = j"""), ("h0", """
SELECT list(r ORDER BY pos) AS m FROM (
  SELECT a.pos, list(CASE WHEN g.i = g.j THEN a.diagonal ELSE g.h END ORDER BY b.pos) AS r
  FROM g JOIN cols a ON a.col = g.i JOIN cols b ON b.col = g.j GROUP BY a.pos)"""), ("inverted", f"""
SELECT m FROM (WITH RECURSIVE gj(k, m) AS (
  SELECT 1, m FROM h0
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: list_transform(r, lambda x, j:
    CASE WHEN i = k AND j = k THEN 1 / v WHEN i = k THEN x / v WHEN j = k THEN -x / v ELSE x - r[k] * pr[j] / v END))
  FROM (SELECT k, m, m[k] AS pr, m[k][k] AS v FROM gj WHERE k <= {D}))
SELECT k, m FROM gj) WHERE k = {D + 1}"""), ("pushes", f"""
SELECT c, list_transform(pr, lambda x: x / v) AS t FROM (WITH RECURSIVE oc(c, m, pr, v) AS (
  SELECT 1, m, m[1], m[1][1] FROM inverted
  UNION ALL
  SELECT c + 1, n, n[c + 1], n[c + 1][c + 1] FROM (
    SELECT c, list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - r[c] * pr[j] / v)) AS n FROM oc WHERE c < {D}))
SELECT c, pr, v FROM oc)"""), ("ordered", """
SELECT l.row, c.pos, l.x, c.dead FROM fx_long l JOIN cols c ON c.col = l.col"""), ("gp", f"""
SELECT row, list({scale} ORDER BY grp) AS s, list({zero} ORDER BY grp) AS z FROM (
  SELECT row, pos // {each} AS grp, min({params_from}) AS mn, max({params_from}) AS mx FROM ordered GROUP BY row, pos // {each}) GROUP BY row"""), ("w0", """
SELECT row, list(CASE WHEN dead THEN 0.0::DOUBLE ELSE x END ORDER BY pos) AS w FROM ordered GROUP BY row"""), ("done", f"""
SELECT row, q FROM (WITH RECURSIVE st(row, c, w, q) AS (
  SELECT row, 1, w, CAST([] AS DOUBLE[]) FROM w0
  UNION ALL
  SELECT row, c + 1, list_transform(w, lambda x, j: CASE WHEN j <= c THEN x ELSE x - (w[c] - v) * t[j] END), list_append(q, v)
  FROM (SELECT st.row, st.c, st.w, st.q, p.t, gp.s[(st.c - 1) // {each} + 1] *
          (least(greatest(round_even(st.w[st.c] / gp.s[(st.c - 1) // {each} + 1], 0) + gp.z[(st.c - 1) // {each} + 1], 0), {top}) - gp.z[(st.c - 1) // {each} + 1]) AS v
        FROM st JOIN gp ON gp.row = st.row JOIN pushes p ON p.c = st.c))
SELECT row, c, q FROM st) WHERE c = {D + 1}""")) + """
SELECT d.row, c.col, round(d.q[c.pos + 1], 9) + 0.0 AS q FROM done d CROSS JOIN cols c"""


def gptq_query(spark, sf_dir, groupsize=-1, act_order=False):
    m = fx_matrix(spark, sf_dir)
    g = G.gram_matrix(m, "vec", D)
    r = G.gptq_quantize(m, g, 4, sym=False, groupsize=groupsize, act_order=act_order)
    return r.select("row", F.posexplode("q").alias("col", "q")).withColumn("q", F.round("q", 9) + 0.0)


@query("gptq_quantize", gptq_sql(-1, False))
def q_gptq_quantize(spark, sf_dir):
    return gptq_query(spark, sf_dir)


@query("gptq_quantize_grouped", gptq_sql(32, True))
def q_gptq_quantize_grouped(spark, sf_dir):
    return gptq_query(spark, sf_dir, groupsize=32, act_order=True)
