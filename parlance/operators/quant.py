"""Quantization of vector tables: parameters, round-to-nearest, ternary, grid
search, integer codes, bit packing, unpacking, packed matmul, errors, sizes.

A matrix is a table of rows ``(row, vec array<double>)`` (one output channel
per row, input features along the array). Everything per row is a projection
with higher-order functions, so quantizing a 100 TB table is one scan with no
shuffle; only ``pack_zeros`` (packs across rows) and the matmul aggregate
shuffle, on small keys.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

MASK32 = 0xFFFFFFFF
MSE_ROWS = 512          # vectors whose whole grid is evaluated at once


def maxq_for(bits: int) -> int:
    return 2 ** bits - 1


def value_range(xmin_raw: Column, xmax_raw: Column, sym: bool):
    """Range including zero; symmetric widening; an all-zero range becomes (-1, 1)."""
    xmin = F.least(xmin_raw, F.lit(0.0))
    xmax = F.greatest(xmax_raw, F.lit(0.0))
    if sym:
        xmax = F.greatest(F.abs(xmin), xmax)
        xmin = F.when(xmin < 0, -xmax).otherwise(xmin)
    both0 = (xmin == 0) & (xmax == 0)
    return F.when(both0, F.lit(-1.0)).otherwise(xmin), F.when(both0, F.lit(1.0)).otherwise(xmax)


def scale_zero(xmin: Column, xmax: Column, bits: int, sym: bool, ternary: bool = False):
    """(scale, zero) from a range: asymmetric zero = round-half-even(-xmin/scale)."""
    if ternary:
        return xmax, xmin
    mq = maxq_for(bits)
    scale = (xmax - xmin) / mq
    zero = F.lit((mq + 1) / 2) if sym else F.rint(-xmin / scale) + F.lit(0.0)
    return scale, zero


def quantize_value(x: Column, scale: Column, zero: Column, bits: int, ternary: bool = False) -> Column:
    """Dequantized value: ``scale * (clamp(rint(x/scale) + zero, 0, maxq) - zero)``;
    ternary: ``x > scale/2 -> scale``, ``x < zero/2 -> zero``, else 0."""
    if ternary:
        return (F.when(x > scale / 2, scale).otherwise(F.lit(0.0))
                + F.when(x < zero / 2, zero).otherwise(F.lit(0.0)))
    return scale * (code_value(x, scale, zero, bits) - zero)


def code_value(x: Column, scale: Column, zero: Column, bits: int) -> Column:
    return F.least(F.greatest(F.rint(x / scale) + zero, F.lit(0.0)), F.lit(float(maxq_for(bits))))


def _group_arrays(vec: Column, d: int, groupsize: int):
    gs = d if groupsize in (-1, None) or groupsize >= d else groupsize
    ng = math.ceil(d / gs)
    return gs, ng, F.transform(F.sequence(F.lit(0), F.lit(ng - 1)), lambda g: F.slice(vec, g * gs + 1, F.lit(gs)))


def group_params(matrix: DataFrame, bits: int, sym: bool, groupsize: int = -1, d: int | None = None,
                 vec: str = "vec", ternary: bool = False) -> DataFrame:
    """Per (row, input group) ``scales`` / ``zeros`` arrays (one entry per group;
    ``groupsize=-1`` = per row). Adds scales, zeros, groupsize."""
    d = d or _dim(matrix, vec)
    gs, _ng, groups = _group_arrays(F.col(vec), d, groupsize)

    def one(g):
        lo, hi = value_range(F.array_min(g), F.array_max(g), sym)
        s, z = scale_zero(lo, hi, bits, sym, ternary)
        return F.struct(s.alias("s"), z.alias("z"))
    p = F.transform(groups, one)
    return (matrix.withColumn("_p", p)
            .withColumn("scales", F.transform("_p", lambda x: x["s"]))
            .withColumn("zeros", F.transform("_p", lambda x: x["z"]))
            .withColumn("groupsize", F.lit(gs)).drop("_p"))


def channel_params(matrix: DataFrame, bits: int, sym: bool, vec: str = "vec", ternary: bool = False) -> DataFrame:
    """Per row ``scale``/``zero`` from its min/max (zero always in range)."""
    lo, hi = value_range(F.array_min(vec), F.array_max(vec), sym)
    s, z = scale_zero(lo, hi, bits, sym, ternary)
    return matrix.withColumn("scale", s).withColumn("zero", z)


def tensor_params(matrix: DataFrame, bits: int, sym: bool, vec: str = "vec") -> DataFrame:
    """One range for the whole matrix, repeated on every row: the parameters are
    computed once in a global aggregate and attached as one scalar subquery."""
    g = matrix.agg(F.min(F.array_min(vec)).alias("mn"), F.max(F.array_max(vec)).alias("mx"))
    lo, hi = value_range(F.col("mn"), F.col("mx"), sym)
    s, z = scale_zero(lo, hi, bits, sym)
    p = g.select(F.struct(s.alias("s"), z.alias("z")).alias("p")).scalar()
    return matrix.withColumn("_p", p).withColumn("scale", F.col("_p.s")).withColumn("zero", F.col("_p.z")).drop("_p")


def mse_params(matrix: DataFrame, bits: int, sym: bool, norm: float = K.MSE_NORM, grid: int = K.MSE_GRID,
               maxshrink: float = K.MSE_MAXSHRINK, vec: str = "vec") -> DataFrame:
    """Shrink the range by ``p = 1 - i/grid`` (i < maxshrink*grid) and keep the
    p with least ``sum |q(x) - x|^norm`` (first wins on ties). The whole grid is
    evaluated inside the row — no grid join, no shuffle: batches of vectors of finite
    numbers with NumPy, any others with higher-order functions of the same arithmetic.
    Adds scale, zero, best_i, err."""
    v = F.col(vec)
    lo, hi = value_range(F.array_min(v), F.array_max(v), sym)
    _s, base_z = scale_zero(lo, hi, bits, sym)
    mq = maxq_for(bits)
    n = int(maxshrink * grid)
    # the row's range is computed once and handed to every grid point as a lambda variable
    rng = F.array_repeat(F.struct(lo.alias("lo"), hi.alias("hi"), base_z.alias("z0")), n)

    def cand(r, i):
        p = F.lit(1.0) - i.cast("double") / F.lit(float(grid))
        lo1, hi1 = p * r["lo"], p * r["hi"]
        s1 = (hi1 - lo1) / mq
        z1 = r["z0"] if sym else F.rint(-lo1 / s1) + F.lit(0.0)
        return F.struct(s1.alias("s"), z1.alias("z"), i.alias("i"))

    def err(c):
        e = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(quantize_value(x, c["s"], c["z"], bits) - x), F.lit(norm)))
        return F.struct(e.alias("err"), c["i"].alias("i"), c["s"].alias("s"), c["z"].alias("z"))
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fast = _mse_udf(bits, sym, norm, grid, n)(F.when(finite, v), lo, hi, base_z)
    best = F.when(F.coalesce(finite, F.lit(False)) & F.col("_fast").isNotNull(), F.col("_fast")).otherwise(
        F.array_min(F.transform(F.transform(rng, cand), err)))
    matrix = matrix.withColumn("_fast", fast)
    return (matrix.withColumn("_best", best)
            .withColumn("scale", F.col("_best.s")).withColumn("zero", F.col("_best.z"))
            .withColumn("best_i", F.col("_best.i")).withColumn("err", F.col("_best.err")).drop("_best", "_fast"))


def _mse_udf(bits: int, sym: bool, norm: float, grid: int, n: int):
    """The best grid point of every vector (struct err, i, s, z), null where the vector is
    null. Errors are added up element after element, as in a fold over the array."""
    mq = float(maxq_for(bits))

    def of(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, z0: np.ndarray) -> list[np.ndarray]:
        p = 1.0 - np.arange(n, dtype=np.float64) / float(grid)
        lo1, hi1 = p * lo[:, None], p * hi[:, None]
        s = (hi1 - lo1) / mq
        z = np.repeat(z0[:, None], n, axis=1) if sym else np.rint(-lo1 / s) + 0.0
        e = np.zeros_like(s)
        for k in range(x.shape[1]):
            c = x[:, k, None]
            q = s * (np.minimum(np.maximum(np.rint(c / s) + z, 0.0), mq) - z)
            e += np.abs(q - c) ** norm
        at, rows = np.argmin(e, axis=1), np.arange(len(x))
        return [e[rows, at], at, s[rows, at], z[rows, at]]

    def best(vec: pd.Series, lo: pd.Series, hi: pd.Series, z0: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"err": np.nan, "i": 0, "s": np.nan, "z": np.nan}, index=vec.index).astype(object)
        out[:] = None
        widths = vec.map(lambda a: -1 if a is None else len(a))
        for w in sorted(set(widths) - {-1}):
            rows = np.flatnonzero(widths.to_numpy() == w)
            for part in np.array_split(rows, math.ceil(len(rows) / MSE_ROWS)):
                x = np.stack([np.asarray(vec.iloc[r], dtype=np.float64) for r in part])
                found = of(x, *(c.iloc[part].to_numpy(np.float64) for c in (lo, hi, z0)))
                for c, y in zip(out.columns, found, strict=True):
                    out.iloc[part, out.columns.get_loc(c)] = y.tolist()
        out["i"] = out["i"].astype("Int32")
        return out.astype({"err": "Float64", "s": "Float64", "z": "Float64"})

    return F.pandas_udf(best, "err double, i int, s double, z double")


def expand_groups(arr: Column, gs: int, d: int) -> Column:
    """Per-group values repeated to one value per input column."""
    return F.slice(F.flatten(F.transform(arr, lambda v: F.array_repeat(v, gs))), 1, d)


def _elements(params: DataFrame, vec: str, gs: int | None, d: int | None):
    """(x, s, z) per element: each array is referenced once by the zip, so no
    computed array is re-evaluated per element."""
    if "scales" in params.columns:
        d = d or _dim(params, vec)
        return F.arrays_zip(F.col(vec).alias("x"), expand_groups(F.col("scales"), gs, d).alias("s"),
                            expand_groups(F.col("zeros"), gs, d).alias("z"))
    v = F.col(vec)
    # array_repeat evaluates the row's scale / zero once (a lambda reading the
    # columns directly would recompute them for every element)
    return F.arrays_zip(v.alias("x"), F.array_repeat(F.col("scale"), F.size(v)).alias("s"),
                        F.array_repeat(F.col("zero"), F.size(v)).alias("z"))


def rtn_quantize(params: DataFrame, bits: int, gs: int | None = None, vec: str = "vec",
                 ternary: bool = False, d: int | None = None) -> DataFrame:
    """Round-to-nearest with group params (``scales``/``zeros`` arrays and group
    size ``gs``) or per-row ``scale``/``zero``: adds ``codes`` (int array) and
    ``deq`` (dequantized values)."""
    els = params.withColumn("_el", _elements(params, vec, gs, d))
    out = els.withColumn("deq", F.transform("_el", lambda e: quantize_value(e["x"], e["s"], e["z"], bits, ternary)))
    if not ternary:
        out = out.withColumn("codes", F.transform("_el", lambda e: code_value(e["x"], e["s"], e["z"], bits).cast("int")))
    return out.drop("_el")


def ternary_quantize(matrix: DataFrame, sym: bool = True, vec: str = "vec") -> DataFrame:
    """Ternary (maxq = -1): scale = range max, zero = range min."""
    p = channel_params(matrix, 2, sym, vec, ternary=True)
    return rtn_quantize(p, 2, None, vec, ternary=True)


def quant_codes(params: DataFrame, gs: int, w: str = "deq", d: int | None = None) -> DataFrame:
    """Integer codes ``round((w + zero*scale)/scale)`` with each column's group."""
    els = _elements(params, w, gs, d)
    return params.withColumn("codes", F.transform(els, lambda e: F.rint((e["x"] + e["z"] * e["s"]) / e["s"]).cast("int")))


def n_words(n: int, bits: int) -> int:
    return math.ceil(n * bits / 32)


def _piece(code: Column, c: Column, w: Column, bits: int) -> Column:
    """Bits of ``code`` (at stream position bits*c) that land in 32-bit word w."""
    s = c * bits - w * 32
    left = F.call_function("shiftleft", code.cast("bigint"), s.cast("int"))
    right = F.call_function("shiftright", code.cast("bigint"), (-s).cast("int"))
    inside = (s > -bits) & (s < 32)
    return F.when(~inside, F.lit(0).cast("bigint")).when(s >= 0, left.bitwiseAND(F.lit(MASK32))).otherwise(right)


def pack_words(df: DataFrame, bits: int, d: int, codes: str = "codes", out: str = "words") -> DataFrame:
    """Pack ``bits``-wide codes along the row into little-endian 32-bit words
    (code k at bits [bits*k, bits*k+bits) of the stream; 3-bit codes straddle
    words). Words are unsigned values in bigint. One pass over the codes per
    row (an ``aggregate`` that ORs each code into the words it touches)."""
    nw = n_words(d, bits)
    items = F.transform(F.col(codes), lambda c, k: F.struct(c.alias("c"), k.alias("k")))
    init = F.array_repeat(F.lit(0).cast("bigint"), nw)
    words = F.aggregate(items, init, lambda acc, e: F.transform(
        acc, lambda word, w: word.bitwiseOR(_piece(e["c"], e["k"], w, bits))))
    return df.withColumn(out, words)


def unpack_codes(words: Column, bits: int, d: int) -> Column:
    """Inverse of ``pack_words``: the d codes of a row from its words, in one
    pass over the words."""
    mask = maxq_for(bits)
    items = F.transform(words, lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    init = F.array_repeat(F.lit(0).cast("bigint"), d)

    def contrib(e, c):
        s = c * bits - e["w"] * 32
        inside = (s > -bits) & (s < 32)
        part = F.when(s >= 0, F.call_function("shiftright", e["v"], s.cast("int"))).otherwise(
            F.call_function("shiftleft", e["v"], (-s).cast("int")))
        return F.when(inside, part).otherwise(F.lit(0).cast("bigint"))
    acc = F.aggregate(items, init, lambda a, e: F.transform(a, lambda x, c: x.bitwiseOR(contrib(e, c))))
    return F.transform(acc, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))


def pack_zeros(params: DataFrame, bits: int, row: str = "row") -> DataFrame:
    """Pack ``(zero - 1) & maxq`` of every row along the row axis, per input
    group: (grp, word_idx, word). Rows must be dense 0..n-1 (use a rank).
    The stored value wraps instead of underflowing, so ``zero = 0`` survives."""
    mq = maxq_for(bits)
    z = params.select(F.col(row).cast("bigint").alias("r"), F.posexplode("zeros").alias("grp", "z"))
    z = z.withColumn("v", (F.col("z").cast("bigint") - 1).bitwiseAND(F.lit(mq)))
    pos = F.col("r") * bits
    z = z.withColumn("w", F.explode(F.array_distinct(F.array(F.floor(pos / 32), F.floor((pos + bits - 1) / 32)))))
    pieces = z.withColumn("piece", _piece(F.col("v"), F.col("r"), F.col("w"), bits))
    return pieces.groupBy("grp", F.col("w").cast("int").alias("word_idx")).agg(F.bit_or("piece").alias("word"))


def unpack_zeros(words: DataFrame, bits: int, n_rows: int) -> DataFrame:
    """Inverse of ``pack_zeros``: (grp, row, zero) with ``zero = (v + 1) & maxq``."""
    mq = maxq_for(bits)
    per_grp = words.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))),
                                                   lambda x: x["word"]).alias("ws"))
    return (per_grp.select("grp", F.posexplode(unpack_codes(F.col("ws"), bits, n_rows)).alias("row", "v"))
            .withColumn("zero", ((F.col("v") + 1).bitwiseAND(F.lit(mq))).cast("double")).drop("v"))


def unpack_dequant(df: DataFrame, bits: int, d: int, gs: int, words: str = "words") -> DataFrame:
    """Codes from words, then ``w = scale * (code - zero)`` with group params."""
    df = df.withColumn("codes", unpack_codes(F.col(words), bits, d))
    els = F.arrays_zip(F.col("codes").alias("c"), expand_groups(F.col("scales"), gs, d).alias("s"),
                       expand_groups(F.col("zeros"), gs, d).alias("z"))
    return df.withColumn("w", F.transform(els, lambda e: e["s"] * (e["c"] - e["z"])))


# ---------------------------------------------------------------- matmul

MAX_BROADCAST_X = 1 << 20   # values (rows x width) we accept to broadcast for either side
MATMUL_BLOCK = 2048         # weight rows unpacked at a time in the product of blocks
X_BLOCK, W_BLOCK = 4096, 32768   # rows per block there: packed weights are small, so their blocks are
X_SLICE = 512               # larger, and activations (the wide side) are read again less often


def _unpack_np(words: np.ndarray, scales: np.ndarray, zeros: np.ndarray, bits: int, d: int, gs: int) -> np.ndarray:
    """Dense weights (rows x d) from packed words with NumPy bit operations."""
    shifts = np.arange(d, dtype=np.int64) * bits
    widx, sft = shifts // 32, shifts % 32
    words = np.concatenate([words, np.zeros((len(words), 1), dtype=np.int64)], axis=1)
    lo = words[:, widx] >> sft
    hi = np.where(sft + bits > 32, words[:, widx + 1] << (32 - sft), 0)
    codes = (lo | hi) & (2 ** bits - 1)
    g = np.arange(d) // gs
    return scales[:, g] * (codes - zeros[:, g])


def _stack(series, dtype=np.float64) -> np.ndarray:
    return np.stack(series.map(lambda a: np.asarray(a, dtype=dtype)).to_numpy())


def _products(ids: np.ndarray, xm: np.ndarray, rows: np.ndarray, w: np.ndarray, plus: np.ndarray | None):
    """Frames of b, row and y, each of a slice of the activations and of the weight rows."""
    for at in range(0, len(w), MATMUL_BLOCK):
        cut = slice(at, at + MATMUL_BLOCK)
        for x0 in range(0, len(xm), X_SLICE):
            y = xm[x0:x0 + X_SLICE] @ w[cut].T
            if plus is not None:
                y = y + plus[None, cut]
            yield pd.DataFrame({"b": np.repeat(ids[x0:x0 + X_SLICE], y.shape[1]), "row": np.tile(rows[cut], len(y)), "y": y.reshape(-1)})


def dequant_matmul(x: DataFrame, packed: DataFrame, bits: int, d: int, gs: int, bias: str | None = None,
                   x_id: str = "b", x_vec: str = "x", row: str = "row") -> DataFrame:
    """``y[b, row] = sum_k x[b,k] * W[row,k] (+ bias[row])`` straight from packed words.

    Plan choice by checked sizes: a small activation table is broadcast and
    every partition of the packed matrix unpacks a batch of rows and multiplies
    with NumPy (the matrix is never shuffled or stored dense); otherwise a small
    packed matrix is broadcast and the activations stream past it; when both
    are large, rows are grouped into blocks, one a partition, and each (activation
    block, weight block) pair is a task of a cross join that copies no row.
    Output: b, row, y.
    """
    spark = x.sparkSession
    wcols = [row, "words", "scales", "zeros"] + ([bias] if bias else [])
    cap = MAX_BROADCAST_X // max(d, 1)
    nx = x.limit(cap + 1).count()
    if nx <= cap:
        xs = x.select(x_id, x_vec).toPandas()
        bx = spark.sparkContext.broadcast((xs[x_id].to_numpy(), _stack(xs[x_vec]) if len(xs) else np.zeros((0, d))))

        def run(batches):
            ids_, xm_ = bx.value
            for pdf in batches:
                if pdf.empty:
                    continue
                w = _unpack_np(_stack(pdf["words"], np.int64), _stack(pdf["scales"]), _stack(pdf["zeros"]), bits, d, gs)
                yield from _products(ids_, xm_, pdf[row].to_numpy(), w, pdf[bias].to_numpy() if bias else None)
        return packed.select(*wcols).mapInPandas(run, "b long, row long, y double")

    nw = packed.limit(cap + 1).count()
    if nw <= cap:
        wp = packed.select(*wcols).toPandas()
        wm = _unpack_np(_stack(wp["words"], np.int64), _stack(wp["scales"]), _stack(wp["zeros"]), bits, d, gs)
        bw = spark.sparkContext.broadcast((wp[row].to_numpy(), wm, wp[bias].to_numpy() if bias else None))

        def run_x(batches):
            rows_, wm_, b_ = bw.value
            for pdf in batches:
                if pdf.empty:
                    continue
                yield from _products(pdf[x_id].to_numpy(), _stack(pdf[x_vec]), rows_, wm_, b_)
        return x.select(x_id, x_vec).mapInPandas(run_x, "b long, row long, y double")

    def run_blocks(batches):
        import pyarrow as pa

        for batch in batches:
            for xs, ws in zip(batch.column(0), batch.column(1), strict=True):
                xt, wt = _block_table(xs), _block_table(ws)
                xm, ids, rows = _matrix(xt.column(1), np.float64), xt.column(0).chunk(0).cast("int64"), wt.column(0).chunk(0).cast("int64")
                parts = [_matrix(wt.column(c), t) for c, t in (("words", np.int64), ("scales", np.float64), ("zeros", np.float64))]
                plus = wt.column(bias).to_numpy() if bias else None
                for at in range(0, wt.num_rows, MATMUL_BLOCK):
                    cut = slice(at, at + MATMUL_BLOCK)
                    w, few_rows = _unpack_np(*(p[cut] for p in parts), bits, d, gs), rows.slice(at, MATMUL_BLOCK)
                    for x0 in range(0, xt.num_rows, X_SLICE):
                        y = xm[x0:x0 + X_SLICE] @ w.T
                        if bias:
                            y = y + plus[None, cut]
                        few = ids.slice(x0, X_SLICE)
                        yield pa.RecordBatch.from_arrays([few.take(pa.array(np.repeat(np.arange(len(few)), len(w)))),
                                                          few_rows.take(pa.array(np.tile(np.arange(len(w)), len(few)))),
                                                          pa.array(y.reshape(-1))], names=["b", "row", "y"])
    pairs = _blocks(x.select(x_id, x_vec), X_BLOCK, "xb").hint("shuffle_replicate_nl").crossJoin(_blocks(packed.select(*wcols), W_BLOCK, "wb"))
    return pairs.mapInArrow(run_blocks, "b long, row long, y double")


def _blocks(df: DataFrame, rows: int, out: str) -> DataFrame:
    """The rows dealt out evenly to partitions of about ``rows``, each packed into one value
    (an Arrow stream). A cross join reads the partitions again for every pair, so a row is
    written once, however many blocks its own meets."""
    def pack(batches):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if held:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for b in held:
                    stream.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[out])
    return df.repartition(max(1, math.ceil(df.count() / rows))).mapInArrow(pack, f"{out} binary")


def _block_table(block):
    """The one-chunk Arrow table that ``_blocks`` packed."""
    import pyarrow as pa

    return pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks()


def _matrix(column, dtype) -> np.ndarray:
    """A list column as a matrix; lists of different lengths are an error."""
    lists = column.chunk(0)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    m = flat.reshape(len(lists), -1)
    if lists.null_count or (np.diff(lists.offsets.to_numpy()) != m.shape[1]).any():
        raise ValueError("vectors are missing or of different lengths")
    return m


def quant_error(a: DataFrame, b: DataFrame, key: str = "row", va: str = "vec", vb: str = "deq") -> DataFrame:
    """Per row: squared error and max abs difference between two vector tables."""
    j = a.select(key, F.col(va).alias("_a")).join(b.select(key, F.col(vb).alias("_b")), on=key)
    diff = F.zip_with("_a", "_b", lambda p, q: p - q)
    return j.select(key, F.aggregate(diff, F.lit(0.0), lambda acc, e: acc + e * e).alias("sq_err"),
                    F.array_max(F.transform(diff, lambda e: F.abs(e))).alias("max_abs"))


def quant_error_total(per_row: DataFrame) -> DataFrame:
    """Matrix totals of ``quant_error``: rows, total squared error, largest abs diff."""
    return per_row.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sq_err").alias("total_sq_err"),
                       F.max("max_abs").alias("max_abs"))


def verify_packed(unpacked: DataFrame, tol: float = 1e-12, got: str = "w", want: str = "deq") -> DataFrame:
    """Packed result equals the dense one within ``tol``: one row with the
    largest absolute difference over all elements and the verdict (a global
    max, combined map-side). A missing element, array or value is an infinite
    difference; a table without rows is not ok."""
    gap = F.zip_with(got, want, lambda p, q: F.coalesce(F.abs(p - q), F.lit(float("inf"))))
    diff = F.coalesce(F.when(F.size(got) == F.size(want), F.coalesce(F.array_max(gap), F.lit(0.0))), F.lit(float("inf")))
    return (unpacked.agg(F.max(diff).alias("max_abs_diff"))
            .withColumn("ok", F.coalesce(F.col("max_abs_diff") <= tol, F.lit(False))))


def footprint(catalog: DataFrame, bits_list=(2, 3, 4, 8), groupsizes=(-1, 32)) -> DataFrame:
    """Bytes of packed words, packed zeros, fp16 scales and bias per matrix,
    bit width and group size, against a 16-bit dense copy. ``catalog`` has
    (matrix_id, rows, cols)."""
    combos = F.array(*[F.struct(F.lit(b).alias("bits"), F.lit(g).alias("gs")) for b in bits_list for g in groupsizes])
    c = catalog.withColumn("_c", F.explode(combos)).select("matrix_id", "rows", "cols", "_c.bits", "_c.gs")
    gs = F.when(F.col("gs") == -1, F.col("cols")).otherwise(F.col("gs"))
    ng = F.ceil(F.col("cols") / gs)
    packed = F.col("rows") * F.ceil(F.col("cols") * F.col("bits") / 32) * 4
    zeros = ng * F.ceil(F.col("rows") * F.col("bits") / 32) * 4
    scales = ng * F.col("rows") * 2
    bias = F.col("rows") * 2
    total = packed + zeros + scales + bias
    fp16 = F.col("rows") * F.col("cols") * 2
    return c.select("matrix_id", "bits", F.col("gs").alias("groupsize"),
                    packed.cast("bigint").alias("packed_bytes"), zeros.cast("bigint").alias("zeros_bytes"),
                    scales.cast("bigint").alias("scales_bytes"), bias.cast("bigint").alias("bias_bytes"),
                    total.cast("bigint").alias("total_bytes"), fp16.cast("bigint").alias("fp16_bytes"),
                    F.round(total.cast("double") / fp16.cast("double"), 6).alias("ratio"))


def _dim(df: DataFrame, vec: str) -> int:
    """Width of a matrix (all rows share it): read from one row, not a scan."""
    return int(df.select(F.size(vec)).first()[0])
