"""Quantization queries over the embeddings matrix (row = vec_id, 64 inputs).

Spark runs the array-form operators (one projection per row); the DuckDB
oracles use a long form (one row per element, GROUP BY for params and bit
packing), an independent formulation of the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quant as Q
from ..session import scratch_path
from ..sources import logs
from . import fixtures as X
from .registry import query, with_ctes

D = 64          # embedding width in the driver tables
GS = 32
BITS = (2, 3, 4, 8)


def fx_matrix(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


CTE_MATRIX = ("fx_matrix", "SELECT vec_id AS row, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings")
CTE_LONG = ("fx_long", """
SELECT row, CAST(k - 1 AS INTEGER) AS col, x FROM (
  SELECT row, unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM fx_matrix)""")


def range_sql(mn: str, mx: str, sym: bool):
    lo, hi = f"least({mn}, 0.0::DOUBLE)", f"greatest({mx}, 0.0::DOUBLE)"
    if sym:
        hi = f"greatest(abs({lo}), {hi})"
        lo = f"(CASE WHEN {lo} < 0 THEN -({hi}) ELSE {lo} END)"
    both0 = f"({lo} = 0 AND {hi} = 0)"
    return f"(CASE WHEN {both0} THEN -1.0::DOUBLE ELSE {lo} END)", f"(CASE WHEN {both0} THEN 1.0::DOUBLE ELSE {hi} END)"


def sz_sql(lo: str, hi: str, bits: int, sym: bool, ternary: bool = False):
    if ternary:
        return hi, lo
    mq = 2 ** bits - 1
    s = f"(({hi}) - ({lo})) / {mq}.0::DOUBLE"
    z = f"{(mq + 1) / 2}::DOUBLE" if sym else f"(round_even(-({lo}) / ({s}), 0) + 0.0::DOUBLE)"
    return s, z


def code_sql(x: str, s: str, z: str, bits: int) -> str:
    return f"least(greatest(round_even({x} / {s}, 0) + {z}, 0.0::DOUBLE), {2 ** bits - 1}.0::DOUBLE)"


def deq_sql(x: str, s: str, z: str, bits: int, ternary: bool = False) -> str:
    if ternary:
        return (f"(CASE WHEN {x} > {s} / 2 THEN {s} ELSE 0.0::DOUBLE END + "
                f"CASE WHEN {x} < {z} / 2 THEN {z} ELSE 0.0::DOUBLE END)")
    return f"({s} * ({code_sql(x, s, z, bits)} - {z}))"


def params_cte(name: str, bits: int, sym: bool, gs: int, ternary: bool = False):
    lo, hi = range_sql("mn", "mx", sym)
    s, z = sz_sql(lo, hi, bits, sym, ternary)
    return (name, f"""
SELECT row, grp, {s} AS scale, {z} AS zero FROM (
  SELECT row, col // {gs} AS grp, min(x) AS mn, max(x) AS mx FROM fx_long GROUP BY row, col // {gs})""")


def deq_cte(name: str, params: str, bits: int, gs: int, ternary: bool = False):
    return (name, f"""
SELECT l.row, l.col, l.x, p.scale, p.zero, CAST({code_sql('l.x', 'p.scale', 'p.zero', bits) if not ternary else '0'} AS INTEGER) AS code,
       {deq_sql('l.x', 'p.scale', 'p.zero', bits, ternary)} AS deq
FROM fx_long l JOIN {params} p ON p.row = l.row AND p.grp = l.col // {gs}""")


def _gparams(spark, sf_dir, bits, sym, gs):
    return Q.group_params(fx_matrix(spark, sf_dir), bits, sym, gs, d=D)


def _rtn(spark, sf_dir, bits, sym=False, gs=D):
    return Q.rtn_quantize(_gparams(spark, sf_dir, bits, sym, gs), bits, gs)


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- params

_CP_SQL = " UNION ALL ".join(
    f"SELECT row, {b} AS bits, {str(sym).lower()} AS sym, {sz_sql(*range_sql('list_min(vec)', 'list_max(vec)', sym), b, sym)[0]} AS scale, "
    f"{sz_sql(*range_sql('list_min(vec)', 'list_max(vec)', sym), b, sym)[1]} AS zero FROM fx_matrix"
    for b in BITS for sym in (False, True))


@query("channel_params", with_ctes(CTE_MATRIX) + _CP_SQL)
def q_channel_params(spark, sf_dir):
    m = fx_matrix(spark, sf_dir)
    return _union([Q.channel_params(m, b, sym).select("row", F.lit(b).alias("bits"), F.lit(sym).alias("sym"), "scale", "zero")
                   for b in BITS for sym in (False, True)])


_TP = " UNION ALL ".join(
    f"SELECT row, {str(sym).lower()} AS sym, {sz_sql(*range_sql('g.mn', 'g.mx', sym), 4, sym)[0]} AS scale, "
    f"{sz_sql(*range_sql('g.mn', 'g.mx', sym), 4, sym)[1]} AS zero FROM fx_matrix, "
    f"(SELECT min(list_min(vec)) AS mn, max(list_max(vec)) AS mx FROM fx_matrix) g" for sym in (False, True))


@query("tensor_params", with_ctes(CTE_MATRIX) + _TP)
def q_tensor_params(spark, sf_dir):
    m = fx_matrix(spark, sf_dir)
    return _union([Q.tensor_params(m, 4, sym).select("row", F.lit(sym).alias("sym"), "scale", "zero") for sym in (False, True)])


@query("group_params", with_ctes(CTE_MATRIX, CTE_LONG, *[params_cte(f"gp{b}", b, False, GS) for b in BITS]) +
       " UNION ALL ".join(f"SELECT row, CAST(grp AS INTEGER) AS grp, {b} AS bits, scale, zero FROM gp{b}" for b in BITS))
def q_group_params(spark, sf_dir):
    frames = []
    for b in BITS:
        p = _gparams(spark, sf_dir, b, False, GS)
        frames.append(p.select("row", F.posexplode(F.arrays_zip("scales", "zeros")).alias("grp", "p"))
                      .select("row", "grp", F.lit(b).alias("bits"), F.col("p.scales").alias("scale"), F.col("p.zeros").alias("zero")))
    return _union(frames)


def _mse_sql(bits: int, sym: bool) -> str:
    lo, hi = range_sql("list_min(vec)", "list_max(vec)", sym)
    _s0, z0 = sz_sql(lo, hi, bits, sym)
    p = "(1.0::DOUBLE - CAST(i AS DOUBLE) / 100.0::DOUBLE)"
    lo1, hi1 = f"({p} * lo)", f"({p} * hi)"
    s1 = f"(({hi1} - {lo1}) / {2 ** bits - 1}.0::DOUBLE)"
    z1 = "z0" if sym else f"(round_even(-{lo1} / {s1}, 0) + 0.0::DOUBLE)"
    err = f"list_sum(list_transform(vec, lambda x: pow(abs({deq_sql('x', s1, z1, bits)} - x), 2.4::DOUBLE)))"
    cand = f"{{'err': {err}, 'i': i, 's': {s1}, 'z': {z1}}}"
    return f"""
SELECT row, {bits} AS bits, {str(sym).lower()} AS sym, CAST(b.i AS INTEGER) AS best_i, b.s AS scale, b.z AS zero, round(b.err, 8) AS err
FROM (SELECT row, list_min(list_transform(range(80), lambda i: {cand})) AS b
      FROM (SELECT row, vec, {lo} AS lo, {hi} AS hi, {z0} AS z0 FROM fx_matrix))"""


@query("mse_params", with_ctes(CTE_MATRIX) + " UNION ALL ".join(_mse_sql(b, s) for b in (3, 4) for s in (False, True)))
def q_mse_params(spark, sf_dir):
    m = fx_matrix(spark, sf_dir)
    return _union([Q.mse_params(m, b, s).select("row", F.lit(b).alias("bits"), F.lit(s).alias("sym"),
                                                 "best_i", "scale", "zero", F.round("err", 8).alias("err"))
                   for b in (3, 4) for s in (False, True)])


# ---------------------------------------------------------------- quantize

@query("ternary_quantize", with_ctes(CTE_MATRIX, CTE_LONG, params_cte("tp", 2, True, D, ternary=True),
                                     deq_cte("tq", "tp", 2, D, ternary=True)) + "SELECT row, col, deq AS q FROM tq")
def q_ternary_quantize(spark, sf_dir):
    t = Q.ternary_quantize(fx_matrix(spark, sf_dir), sym=True)
    return t.select("row", F.posexplode("deq").alias("col", "q"))


_RTN_CTES = [CTE_MATRIX, CTE_LONG] + [c for b in BITS for c in (params_cte(f"cp{b}", b, False, D), deq_cte(f"rq{b}", f"cp{b}", b, D))]


def _rtn_long(spark, sf_dir, b):
    r = _rtn(spark, sf_dir, b)
    return (r.select("row", F.posexplode(F.arrays_zip("codes", "deq")).alias("col", "z"))
            .select("row", "col", F.lit(b).alias("bits"), F.col("z.codes").alias("code"), F.col("z.deq").alias("deq")))


@query("rtn_quantize", with_ctes(*_RTN_CTES) + " UNION ALL ".join(
    f"SELECT row, col, {b} AS bits, code, deq FROM rq{b}" for b in BITS))
def q_rtn_quantize(spark, sf_dir):
    return _union([_rtn_long(spark, sf_dir, b) for b in BITS])


_G4 = [CTE_MATRIX, CTE_LONG, params_cte("gp4", 4, False, GS), deq_cte("gq4", "gp4", 4, GS)]


@query("quant_codes", with_ctes(*_G4) + f"""
SELECT row, col, CAST(round_even((deq + zero * scale) / scale, 0) AS INTEGER) AS code FROM gq4""")
def q_quant_codes(spark, sf_dir):
    r = Q.rtn_quantize(_gparams(spark, sf_dir, 4, False, GS), 4, GS).drop("codes")
    c = Q.quant_codes(r, GS, "deq")
    return c.select("row", F.posexplode("codes").alias("col", "code"))


def pack_sql(src: str, key: str, pos: str, val: str, bits: int, extra: str = "") -> str:
    """Relational bit packing: each value emits its piece(s) per 32-bit word."""
    s = f"({pos} * {bits} - w * 32)"
    piece = f"CASE WHEN {s} >= 0 THEN ((CAST({val} AS BIGINT) << {s}) & 4294967295) ELSE (CAST({val} AS BIGINT) >> (-{s})) END"
    return f"""
SELECT {key}, {extra} CAST(w AS INTEGER) AS word_idx, bit_or({piece}) AS word FROM (
  SELECT *, unnest(list_distinct([({pos} * {bits}) // 32, ({pos} * {bits} + {bits - 1}) // 32])) AS w FROM {src})
GROUP BY ALL"""


@query("pack_words", with_ctes(*_RTN_CTES) + " UNION ALL ".join(
    f"SELECT * FROM ({pack_sql(f'rq{b}', 'row', 'col', 'code', b, f'{b} AS bits,')})" for b in BITS))
def q_pack_words(spark, sf_dir):
    frames = []
    for b in BITS:
        pw = Q.pack_words(_rtn(spark, sf_dir, b), b, D)
        frames.append(pw.select("row", F.lit(b).alias("bits"), F.posexplode("words").alias("word_idx", "word")))
    return _union(frames)


_ZP_CTES = [CTE_MATRIX, CTE_LONG] + [params_cte(f"gp{b}", b, False, GS) for b in BITS]


@query("pack_zeros", with_ctes(*_ZP_CTES) + " UNION ALL ".join(
    f"SELECT {b} AS bits, * FROM ({pack_sql(f'(SELECT row, CAST(grp AS INTEGER) AS grp, (CAST(zero AS BIGINT) - 1) & {2 ** b - 1} AS v FROM gp{b})', 'grp', 'row', 'v', b)})"
    for b in BITS))
def q_pack_zeros(spark, sf_dir):
    return _union([Q.pack_zeros(_gparams(spark, sf_dir, b, False, GS), b).select(F.lit(b).alias("bits"), "grp", "word_idx", "word")
                   for b in BITS])


def _packed(spark, sf_dir, b, gs):
    p = Q.rtn_quantize(_gparams(spark, sf_dir, b, False, gs), b, gs)
    return Q.pack_words(p, b, D).select("row", "words", "scales", "zeros", "deq")


_UQ_CTES = [CTE_MATRIX, CTE_LONG] + [c for b in BITS for c in (params_cte(f"gp{b}", b, False, GS), deq_cte(f"gq{b}", f"gp{b}", b, GS))]


@query("unpack_dequant", with_ctes(*_UQ_CTES) + " UNION ALL ".join(
    f"SELECT row, col, {b} AS bits, deq AS w FROM gq{b}" for b in BITS))
def q_unpack_dequant(spark, sf_dir):
    frames = []
    for b in BITS:
        u = Q.unpack_dequant(_packed(spark, sf_dir, b, GS), b, D, GS)
        frames.append(u.select("row", F.posexplode("w").alias("col", "w")).select("row", "col", F.lit(b).alias("bits"), "w"))
    return _union(frames)


@query("verify_packed", with_ctes(*_UQ_CTES) + " UNION ALL ".join(
    f"SELECT {b} AS bits, 0.0::DOUBLE AS max_abs_diff, true AS ok" for b in BITS))
def q_verify_packed(spark, sf_dir):
    frames = []
    for b in BITS:
        u = Q.unpack_dequant(_packed(spark, sf_dir, b, GS), b, D, GS)
        frames.append(Q.verify_packed(u, 1e-12).select(F.lit(b).alias("bits"), "max_abs_diff", "ok"))
    return _union(frames)


@query("dequant_matmul", with_ctes(*_G4) + """
SELECT x.row AS b, w.row AS row, round(sum(x.x * w.deq), 6) AS y
FROM fx_long x JOIN gq4 w ON w.col = x.col GROUP BY x.row, w.row""")
def q_dequant_matmul(spark, sf_dir):
    xs = fx_matrix(spark, sf_dir).select(F.col("row").alias("b"), F.col("vec").alias("x"))
    y = Q.dequant_matmul(xs, _packed(spark, sf_dir, 4, GS), 4, D, GS)
    return y.select("b", "row", F.round("y", 6).alias("y"))


@query("quant_error", with_ctes(*_G4) + """
SELECT row, round(sum((x - deq) * (x - deq)), 9) AS sq_err, max(abs(x - deq)) AS max_abs FROM gq4 GROUP BY row""")
def q_quant_error(spark, sf_dir):
    r = Q.rtn_quantize(_gparams(spark, sf_dir, 4, False, GS), 4, GS)
    e = Q.quant_error(fx_matrix(spark, sf_dir), r.select("row", "deq"))
    return e.select("row", F.round("sq_err", 9).alias("sq_err"), "max_abs")


@query("quant_error_total", with_ctes(*_G4) + """
SELECT count(*) AS n_rows, round(sum(e), 9) AS total_sq_err, max(m) AS max_abs
FROM (SELECT row, sum((x - deq) * (x - deq)) AS e, max(abs(x - deq)) AS m FROM gq4 GROUP BY row)""")
def q_quant_error_total(spark, sf_dir):
    r = Q.rtn_quantize(_gparams(spark, sf_dir, 4, False, GS), 4, GS)
    t = Q.quant_error_total(Q.quant_error(fx_matrix(spark, sf_dir), r.select("row", "deq")))
    return t.select("n_rows", F.round("total_sq_err", 9).alias("total_sq_err"), "max_abs")


@query("footprint", """
WITH cat AS (SELECT label AS matrix_id, count(*) AS rows, 64 AS cols FROM embeddings GROUP BY label),
c AS (SELECT *, CASE WHEN gs = -1 THEN cols ELSE gs END AS g FROM cat, (VALUES (2), (3), (4), (8)) b(bits), (VALUES (-1), (32)) s(gs))
SELECT matrix_id, bits, gs AS groupsize,
       CAST(rows * ceil(cols * bits / 32) * 4 AS BIGINT) AS packed_bytes,
       CAST(ceil(cols / g) * ceil(rows * bits / 32) * 4 AS BIGINT) AS zeros_bytes,
       CAST(ceil(cols / g) * rows * 2 AS BIGINT) AS scales_bytes, CAST(rows * 2 AS BIGINT) AS bias_bytes,
       CAST(rows * ceil(cols * bits / 32) * 4 + ceil(cols / g) * ceil(rows * bits / 32) * 4 + ceil(cols / g) * rows * 2 + rows * 2 AS BIGINT) AS total_bytes,
       CAST(rows * cols * 2 AS BIGINT) AS fp16_bytes,
       round(CAST(rows * ceil(cols * bits / 32) * 4 + ceil(cols / g) * ceil(rows * bits / 32) * 4 + ceil(cols / g) * rows * 2 + rows * 2 AS DOUBLE)
             / CAST(rows * cols * 2 AS DOUBLE), 6) AS ratio
FROM c""")
def q_footprint(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    cat = e.groupBy(F.col("label").alias("matrix_id")).agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(D))
    return Q.footprint(cat)


@query("packed_store", with_ctes(*_RTN_CTES) + " UNION ALL ".join(
    f"SELECT 0 AS matrix_id, {b} AS bits, * FROM ({pack_sql(f'rq{b}', 'row', 'col', 'code', b)})" for b in BITS))
def q_packed_store(spark, sf_dir):
    frames = []
    for b in BITS:
        pw = Q.pack_words(_rtn(spark, sf_dir, b), b, D)
        frames.append(pw.select(F.lit(0).alias("matrix_id"), F.lit(b).alias("bits"), "row",
                                F.posexplode("words").alias("word_idx", "word")))
    path = scratch_path(spark, "packed_store")
    logs.write_packed(_union(frames), path)
    return logs.read_packed(spark, path).select("matrix_id", "bits", "row", "word_idx", "word")
