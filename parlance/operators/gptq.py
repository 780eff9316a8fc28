"""Error-compensated quantization of many matrices, over tiles.

A matrix of any width is cut into tiles of ``TILE`` columns. The factor of the
inverse Gram matrix comes from an in-place blocked Cholesky elimination: step k
factors one diagonal tile per matrix, finishes row k of the inverse factor and
updates the tiles below it, all as joins of tile tables. Weight rows, in blocks, then
pass over the column tiles: a tile takes off the errors of all tiles before it (a
join with the factor's tiles, summed per block of rows) and is solved in a task.
No task, nor the driver, holds a Gram matrix or a factor; the driver only counts
steps, as many as the widest matrix has tiles.
"""

from __future__ import annotations

from functools import reduce
from math import lcm

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import scratch_path

TILE = 256                # columns of a tile, rounded up to whole blocks and groups
CELLS = 1 << 20           # weights of a block of rows over the whole width

_TILES = "n int, m int, data binary"


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tiles(df: DataFrame, keep: list[str], inputs: list[str], fn) -> DataFrame:
    """``keep, n, m, data`` of ``fn`` over the dense tiles named ``inputs`` (each a struct
    of rows, columns and bytes, or null)."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for row in zip(*(b.column(i) for i in range(len(keep), b.num_columns)), strict=True):
                values = [None if (t := c.as_py()) is None else np.frombuffer(t["data"]).reshape(t["n"], t["m"]) for c in row]
                out.append(np.ascontiguousarray(fn(*values)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array([x.shape[0] for x in out], pa.int32()), pa.array([x.shape[1] for x in out], pa.int32()),
                                              pa.array([x.tobytes() for x in out], pa.binary())], names=[*keep, "n", "m", "data"])

    kinds = dict(df.dtypes)
    return df.select(*keep, *inputs).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), _TILES]))


def _tile(name: str = "tile"):
    return F.struct("n", "m", "data").alias(name)


def tile_width(groupsize: int, blocksize: int) -> int:
    """Columns of a tile: whole blocks and whole groups, so neither crosses its edge."""
    unit = blocksize if groupsize == -1 else lcm(blocksize, groupsize)
    return unit * max(1, TILE // unit)


# ------------------------------------------------------------ the factor

def column_order(gram: DataFrame, percdamp: float, act_order: bool, key: str) -> DataFrame:
    """``key, i, pos, dead, diagonal, d``: every column's place in processing order, whether
    it has no input, and its conditioned diagonal (1 where dead, plus ``percdamp``
    times the mean). Windows hold one row a column of one matrix."""
    own = Window.partitionBy(key)
    place = F.row_number().over(own.orderBy(F.col("h").desc(), "i")) - 1 if act_order else F.col("i")
    raised = F.when(F.col("h") == 0, F.lit(1.0)).otherwise(F.col("h"))
    return (gram.filter("i = j").select(key, "i", "h").withColumn("_raised", raised)
            .select(key, "i", place.cast("int").alias("pos"), (F.col("h") == 0).alias("dead"),
                    (F.col("_raised") + F.lit(percdamp) * F.avg("_raised").over(own)).alias("diagonal"), F.count("*").over(own).cast("int").alias("d")))


def gram_tiles(gram: DataFrame, columns: DataFrame, width: int, key: str) -> DataFrame:
    """``key, s, t, n, m, data``: the lower tiles of the conditioned matrix, in processing
    order turned upside down (tile 0 is the last)."""
    def side(c: str) -> DataFrame:
        return columns.select(key, F.col("i").alias(c), F.col("pos").alias(f"{c}p"), *([F.col("diagonal"), F.col("d")] if c == "i" else []))

    def tile_of(c: str):
        return F.floor((F.col("d") - 1) / width) - F.floor(F.col(c) / width)

    def place(c: str):                                 # from the tile's end
        return F.least(F.floor(F.col(c) / width) * width + width, F.col("d")) - 1 - F.col(c)

    cells = (gram.select(key, "i", "j", "h").join(side("i"), [key, "i"]).join(side("j"), [key, "j"])
             .select(key, tile_of("ip").cast("int").alias("s"), tile_of("jp").cast("int").alias("t"),
                     place("ip").cast("int").alias("a"), place("jp").cast("int").alias("b"),
                     F.when(F.col("i") == F.col("j"), F.col("diagonal")).otherwise(F.col("h")).alias("h")).filter("s >= t"))

    def dense(pdf):
        import pandas as pd

        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        x = np.zeros((a.max() + 1, b.max() + 1))
        x[a, b] = pdf["h"].to_numpy()
        return pd.DataFrame({key: pdf[key].iloc[:1], "s": pdf["s"].iloc[:1], "t": pdf["t"].iloc[:1], "n": [x.shape[0]], "m": [x.shape[1]], "data": [x.tobytes()]})

    return cells.groupBy(key, "s", "t").applyInPandas(dense, f"{key} {dict(gram.dtypes)[key]}, s int, t int, {_TILES}")


def inverse_factor_tiles(tiles: DataFrame, key: str, steps: int) -> DataFrame:
    """``key, s, t, n, m, data``: the lower tiles of L^-1, L the Cholesky factor of the
    symmetric matrices whose lower tiles are given, by elimination in place: with
    tile (k, k) = L L', row k becomes L^-1 times itself (and L^-1 on the diagonal),
    column k becomes C = column times L'^-1, and every tile (i, j) below loses
    C_i C_j' where j > k, or C_i times row k's tile j where j <= k."""
    now = _saved(tiles, "elimination") if steps > 1 else tiles
    rows = []
    for k in range(steps):
        mine = now.filter(F.col("s") == k)
        pivot = _tiles(mine.filter(F.col("t") == k).select(key, _tile()), [key], ["tile"],
                       lambda a: np.linalg.solve(np.linalg.cholesky(a), np.eye(len(a))))
        if steps == 1:
            return pivot.select(key, F.lit(0).alias("s"), F.lit(0).alias("t"), "n", "m", "data")
        pivot = _saved(pivot, "pivot")
        inverse = pivot.select(key, _tile("inverse"))
        before = mine.filter(F.col("t") < k).select(key, "t", _tile()).join(inverse, key)
        row = _tiles(before, [key, "t"], ["tile", "inverse"], lambda a, inv: inv @ a).unionByName(pivot.withColumn("t", F.lit(k)))
        rows.append(row.withColumn("s", F.lit(k)))
        if k + 1 == steps:
            break
        row = rows[-1] = _saved(rows[-1], "row")
        below = now.filter((F.col("t") == k) & (F.col("s") > k)).select(key, "s", _tile()).join(inverse, key)
        column = _saved(_tiles(below, [key, "s"], ["tile", "inverse"], lambda a, inv: a @ inv.T), "column")
        left = column.select(key, "s", _tile("left"))
        right = (_tiles(column.select(key, F.col("s").alias("t"), _tile()), [key, "t"], ["tile"], lambda a: a.T)
                 .unionByName(row.select(key, "t", "n", "m", "data")).select(key, "t", _tile("right")))
        rest = (now.filter((F.col("s") > k) & (F.col("t") != k)).select(key, "s", "t", _tile())
                .unionByName(column.select(key, "s", F.lit(k).alias("t"), F.lit(None).cast("struct<n:int,m:int,data:binary>").alias("tile"))))
        now = _saved(_tiles(rest.join(left, [key, "s"]).join(right, [key, "t"]), [key, "s", "t"], ["tile", "left", "right"],
                            lambda a, c, r: (0.0 if a is None else a) - c @ r), "elimination")
    return reduce(DataFrame.unionByName, [r.select(key, "s", "t", "n", "m", "data") for r in rows])


def factor_tiles(gram: DataFrame, columns: DataFrame, width: int, steps: int, key: str) -> DataFrame:
    """``key, bi, bj, n, m, data``: the upper tiles of U, (H + damping)^-1 = U'U, columns in
    processing order."""
    lower = inverse_factor_tiles(gram_tiles(gram, columns, width, key), key, steps)
    last = columns.select(key, F.floor((F.col("d") - 1) / width).cast("int").alias("last")).distinct()
    turned = lower.join(last, key).select(key, (F.col("last") - F.col("s")).alias("bi"), (F.col("last") - F.col("t")).alias("bj"), _tile())
    return _tiles(turned, [key, "bi", "bj"], ["tile"], lambda a: a[::-1, ::-1])


# ------------------------------------------------------------ the rows

def range_params(x: np.ndarray, bits: int, sym: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per-row (scale, zero) over the given columns (the rule of quant.value_range)."""
    low, high = x.min(axis=1, initial=0.0), x.max(axis=1, initial=0.0)
    if sym:
        high = np.maximum(-low, high)
        low = np.where(low < 0, -high, low)
    flat = (low == 0) & (high == 0)
    low[flat], high[flat] = -1.0, 1.0
    top = (1 << bits) - 1
    scale = (high - low) / top
    return scale, np.full(len(x), (top + 1) / 2) if sym else np.rint(-low / scale) + 0.0


def compensated_codes(w: np.ndarray, u: np.ndarray, bits: int, sym: bool, groupsize: int, blocksize: int,
                      whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solve, column by column, for the codes of ``w`` (rows x columns of a tile, less the
    errors of the tiles before it); ``u`` is the factor's diagonal tile:

        v_c = w_c - sum over k < c of e_k u_kc,    e_c = (v_c - value(code_c)) / u_cc

    ``w`` itself never changes: a block of ``blocksize`` columns first takes off, in
    one product, the errors of all blocks before it, and inside the block each
    column takes off those of the columns since. A group's parameters (``whole``
    where groupsize is -1) are those of its columns less the errors of the blocks
    before the one in which the group begins. Returns codes, errors and parameters
    (2 x rows x groups).
    """
    rows, d = w.shape
    top, each = (1 << bits) - 1, d if groupsize == -1 else groupsize
    params = np.empty((2, rows, -(-d // each)))
    if groupsize == -1:
        params[:, :, 0] = whole if whole is not None else range_params(w, bits, sym)
    errors, codes = np.empty((rows, d)), np.empty((rows, d), np.int32)
    for begin in range(0, d, blocksize):
        def less_before(columns, begin=begin):
            return w[:, columns] - errors[:, :begin] @ u[:begin, columns]

        block = less_before(slice(begin, begin + blocksize))
        for c in range(begin, begin + block.shape[1]):
            if groupsize != -1 and c % each == 0:
                params[:, :, c // each] = range_params(less_before(slice(c, c + each)), bits, sym)
            scale, zero = params[:, :, c // each]
            v = block[:, c - begin] - errors[:, begin:c] @ u[begin:c, c]
            codes[:, c] = np.clip(np.rint(v / scale) + zero, 0, top)
            errors[:, c] = (v - scale * (codes[:, c] - zero)) / u[c, c]
    return codes, errors, params


def weight_tiles(matrix: DataFrame, orders: DataFrame, width: int, bits: int, sym: bool, groupsize: int, key: str) -> DataFrame:
    """``key, rb, k, rows, whole, n, m, data``: blocks of rows cut into column tiles, columns
    in processing order, those without input zero. ``whole``: scale and zero of whole
    rows, taken before columns are zeroed (null with groups)."""
    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for b in batches:
            keys = b.column(0).to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for begin, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                order, dead = (np.asarray(b.column(c)[begin].as_py()) for c in (3, 4))
                each = max(1, min(1024, CELLS // max(1, len(order))))
                for at in range(begin, end, each):
                    part = b.slice(at, min(each, end - at))
                    w = np.array(part.column(2).to_pylist(), np.float64).reshape(part.num_rows, -1)
                    whole = np.stack(range_params(w, bits, sym)).tobytes() if groupsize == -1 else None
                    w = np.where(dead, 0.0, w[:, order])
                    parts = [w[:, c:c + width] for c in range(0, w.shape[1], width)]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).slice(0, 1).take(pa.array([0] * n)), pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()),
                        pa.array([part.column(1).to_pylist()] * n, pa.list_(pa.int64())), pa.array([whole] * n, pa.binary()),
                        pa.array([len(w)] * n, pa.int32()), pa.array([p.shape[1] for p in parts], pa.int32()), pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary()),
                    ], names=[key, "rb", "k", "rows", "whole", "n", "m", "data"])
                    number += 1

    kind = dict(matrix.dtypes)[key]
    placed = matrix.select(key, F.col("row").cast("long").alias("row"), F.col("vec").cast("array<double>").alias("vec")).join(orders, key)
    return placed.select(key, "row", "vec", "order", "dead").mapInArrow(cut, f"{key} {kind}, rb long, k int, rows array<long>, whole binary, {_TILES}")


def gptq_quantize(matrix: DataFrame, gram: DataFrame, bits: int, sym: bool = False, groupsize: int = -1,
                  blocksize: int = K.GPTQ_BLOCKSIZE, percdamp: float = K.GPTQ_PERCDAMP, act_order: bool = False,
                  vec: str = "vec", row: str = "row", d: int | None = None, key: str | None = None) -> DataFrame:
    """Error-compensated quantization of every row of ``matrix`` given the Gram matrix
    ``gram`` in long form (i, j, h). With ``key`` (say ``matrix_id``) both tables hold
    many matrices, of any widths; rows of a matrix without a Gram matrix are left out.
    ``d`` is not needed; it stays for callers that name it.

    Output, columns in their original order: (key,) row, q (dequantized array), loss
    (row total), codes, scales and zeros (an entry per group) and col_group (the group
    of each column; runs of ``groupsize`` unless ``act_order``). ``codes`` go straight
    to ``quant.pack_words``, ``zeros`` to ``quant.pack_zeros``; ``dequant_by_group``
    reads them back.
    """
    named, key = key, "_matrix"                          # no name of the caller's meets one of ours
    of = F.lit(0) if named is None else F.col(named)
    matrix, gram = matrix.select(of.alias(key), F.col(row).alias("row"), F.col(vec).alias("vec")), gram.select(of.alias(key), "i", "j", "h")
    kind = dict(matrix.dtypes)[key]
    width = tile_width(groupsize, blocksize)
    columns = _saved(column_order(gram, percdamp, act_order, key), "columns")
    sorted_columns = F.sort_array(F.collect_list(F.struct("pos", "i", "dead")))       # a matrix's columns
    orders = columns.groupBy(key).agg(sorted_columns.alias("c")).select(key, F.col("c.i").alias("order"), F.col("c.dead").alias("dead"))
    steps = -(-(columns.agg(F.max("d")).first()[0] or 1) // width)
    again = _saved if steps > 1 else lambda df, _: df              # written where later steps read it again
    factor = again(factor_tiles(gram, columns, width, steps, key), "factor")
    weights = again(weight_tiles(matrix, orders, width, bits, sym, groupsize, key), "weights")

    def solve(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(b.num_rows):
                t, f = b.column(5)[at].as_py(), b.column(6)[at].as_py()
                w, u_kk = np.frombuffer(t["data"]).reshape(t["n"], t["m"]), np.frombuffer(f["data"]).reshape(f["n"], f["m"])
                for x in b.column(7)[at].as_py() or []:
                    w = w - np.frombuffer(x).reshape(w.shape)
                whole = b.column(4)[at].as_py()
                codes, errors, params = compensated_codes(w, u_kk, bits, sym, groupsize, blocksize, None if whole is None else np.frombuffer(whole).reshape(2, -1))
                yield pa.RecordBatch.from_arrays([
                    *(b.column(c).slice(at, 1) for c in range(4)), pa.array([t["n"]], pa.int32()), pa.array([t["m"]], pa.int32()),
                    pa.array([errors.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([params.tobytes()], pa.binary())],
                    names=[key, "rb", "k", "rows", "n", "m", "data", "codes", "params"])

    solved = []
    for k in range(steps):
        mine = weights.filter(F.col("k") == k).select(key, "rb", "k", "rows", "whole", _tile("w"))
        own = factor.filter((F.col("bi") == k) & (F.col("bj") == k)).select(key, _tile("u"))
        mine = mine.join(own, key)
        if k:
            above = factor.filter((F.col("bj") == k) & (F.col("bi") < k)).select(key, F.col("bi").alias("k"), _tile("u"))
            errors = reduce(DataFrame.unionByName, solved).select(key, "rb", "k", _tile("e"))
            off = _tiles(errors.join(above, [key, "k"]), ["rb"], ["e", "u"], lambda e, u: e @ u)
            mine = mine.join(off.groupBy("rb").agg(F.collect_list("data").alias("before")), "rb")     # one row block's width
        else:
            mine = mine.withColumn("before", F.lit(None).cast("array<binary>"))
        solved.append(again(mine.select(key, "rb", "k", "rows", "whole", "w", "u", "before").mapInArrow(
            solve, f"{key} {kind}, rb long, k int, rows array<long>, {_TILES}, codes binary, params binary"), "solved"))

    def whole_rows(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(b.num_rows):
                tiles, order, rows = b.column(1)[at].as_py(), np.asarray(b.column(2)[at].as_py()), b.column(3)[at].as_py()
                n, back = len(rows), np.argsort(np.asarray(order))
                codes = np.concatenate([np.frombuffer(t["codes"], np.int32).reshape(n, -1) for t in tiles], axis=1)
                errors = np.concatenate([np.frombuffer(t["data"]).reshape(n, -1) for t in tiles], axis=1)
                params = [np.frombuffer(t["params"]).reshape(2, n, -1) for t in tiles]
                params = params[0] if groupsize == -1 else np.concatenate(params, axis=2)
                scales, zeros = params
                group = np.arange(codes.shape[1]) // (codes.shape[1] if groupsize == -1 else groupsize)
                q = scales[:, group] * (codes - zeros[:, group])
                arrays = [pa.array(rows, pa.int64()), pa.array(list(q[:, back])), pa.array((errors**2).sum(axis=1) / 2), pa.array(list(codes[:, back])),
                          pa.array(list(scales)), pa.array(list(zeros)), pa.array([group[back].astype(np.int32)] * n)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([at] * n)), *arrays],
                                                 names=[key, row, "q", "loss", "codes", "scales", "zeros", "col_group"])

    each = F.struct("k", "codes", "data", "params")
    blocks = reduce(DataFrame.unionByName, solved).groupBy(key, "rb").agg(F.sort_array(F.collect_list(each)).alias("tiles"), F.first("rows").alias("rows"))
    out = blocks.join(orders, key).select(key, "tiles", "order", "rows").mapInArrow(
        whole_rows, f"{key} {kind}, {row} long, q array<double>, loss double, codes array<int>, scales array<double>, zeros array<double>, col_group array<int>")
    return out.drop(key) if named is None else out.withColumnRenamed(key, named)


def dequant_by_group(df: DataFrame, codes: str = "codes", out: str = "w") -> DataFrame:
    """``scale * (code - zero)`` with the group that ``col_group`` names for each column."""
    cells = F.arrays_zip(F.col(codes).alias("c"), F.col("col_group").alias("g"))
    return df.withColumn(out, F.transform(cells, lambda e: F.get("scales", e["g"]) * (e["c"] - F.get("zeros", e["g"]))))
