"""Gram (Hessian) matrices of activation tables, conditioning and column order.

``gram_matrix`` never sends per-row outer products through a shuffle: each
task sums its rows into tiles of ``TILE`` columns and emits the partial tiles,
which are added up in two rounds of streamed sums (by slot, then by tile), so a
task holds one tile however many partitions there were. Where the matrix is wider
than ``CELLS`` allows, its tile rows are cut into stripes and the input is read
once a stripe: no task holds a whole wide matrix. With ``key`` a table holds many
matrices of one width.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .gptq import dequant_by_group, gptq_quantize  # noqa: F401  (re-exported)

TILE, CELLS, SLOTS = 256, 1 << 24, 64      # columns of a tile; doubles a task may sum into; partial sums of a tile


def _partial_tiles(df: DataFrame, vec: str, d: int, key: str, first: int, last: int) -> DataFrame:
    """``key, bi, bj, slot, data, n``: each task's sums of x_i x_j over its rows, the upper
    tiles of tile rows first .. last - 1. Sums are given out early when the keys
    that met in the task fill ``CELLS``."""
    edges = list(range(0, d + TILE, TILE))
    width = (min(edges[last], d) - edges[first]) * d

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        slot, sums, counts = TaskContext.get().partitionId() % SLOTS, {}, {}

        def out():
            for k, acc in sums.items():
                for bi in range(first, last):
                    for bj in range(bi, len(edges) - 1):
                        x = acc[edges[bi] - edges[first]:edges[bi + 1] - edges[first], edges[bj]:edges[bj + 1]]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([k], kind), pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([slot], pa.int32()),
                            pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([counts[k]], pa.int64())], names=[key, "bi", "bj", "slot", "data", "n"])
            sums.clear()
            counts.clear()

        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column(0).type
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            keys = np.array(b.column(0).to_pylist(), object)
            for k in dict.fromkeys(keys.tolist()):
                mine = x[keys == k]
                if k not in sums:
                    if sums and (len(sums) + 1) * width > CELLS:
                        yield from out()
                    sums[k], counts[k] = np.zeros((width // d, d)), 0
                sums[k] += mine[:, edges[first]:edges[last]].T @ mine
                counts[k] += len(mine)
        yield from out()

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(run, f"{key} {kind}, bi int, bj int, slot int, data binary, n long")


def _summed(parts: DataFrame, by: list[str]) -> DataFrame:
    """Partial tiles added up by ``by``, streamed: a task holds one tile."""
    def run(batches):
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([*held, pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=[*by, "data", "n"])

        now, held, total, n = None, None, None, 0
        for b in batches:
            for at in range(b.num_rows):
                here = tuple(b.column(i)[at].as_py() for i in range(len(by)))
                x = np.frombuffer(b.column(len(by))[at].as_py())
                if here != now:
                    if held:
                        yield out()
                    now, held, total, n = here, [b.column(i).slice(at, 1) for i in range(len(by))], np.zeros(len(x)), 0
                total += x
                n += b.column(len(by) + 1)[at].as_py()
        if held:
            yield out()

    kinds = dict(parts.dtypes)
    return (parts.select(*by, "data", "n").repartition(*by).sortWithinPartitions(*by)
            .mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "data binary", "n long"])))


def gram_sums(df: DataFrame, vec: str, d: int, key: str | None = None) -> DataFrame:
    """``(key,) i, j, s, n``: the sums of x_i x_j over all rows and the row count."""
    one = key is None
    if one:
        key, df = "_matrix", df.withColumn("_matrix", F.lit(0))
    blocks = -(-d // TILE)
    each = max(1, CELLS // (d * TILE))
    parts = reduce(DataFrame.unionByName, [_partial_tiles(df, vec, d, key, a, min(a + each, blocks)) for a in range(0, blocks, each)])
    tiles = _summed(_summed(parts, [key, "bi", "bj", "slot"]), [key, "bi", "bj"])

    def cells(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(b.num_rows):
                bi, bj = b.column(1)[at].as_py(), b.column(2)[at].as_py()
                x = np.frombuffer(b.column(3)[at].as_py()).reshape(min(TILE, d - bi * TILE), -1)
                for i, j, part in [(bi, bj, x)] + ([(bj, bi, x.T)] if bi != bj else []):
                    n, m = part.shape
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array([at] * (n * m))), pa.array(np.repeat(np.arange(n, dtype=np.int32) + i * TILE, m)),
                        pa.array(np.tile(np.arange(m, dtype=np.int32) + j * TILE, n)), pa.array(np.ascontiguousarray(part).ravel()),
                        b.column(4).take(pa.array([at] * (n * m)))], names=[key, "i", "j", "s", "n"])

    out = tiles.mapInArrow(cells, f"{key} {dict(df.dtypes)[key]}, i int, j int, s double, n long")
    return out.drop(key) if one else out


def gram_matrix(df: DataFrame, vec: str, d: int, n: int | None = None, key: str | None = None) -> DataFrame:
    """H = (2/N) Σ x xᵀ in long form ((key,) i, j, h); N defaults to the row count. An
    empty table gives no rows."""
    nn = F.col("n").cast("double") if n is None else F.lit(float(n))
    return gram_sums(df, vec, d, key).withColumn("h", F.lit(2.0) * F.col("s") / nn).drop("s", "n")


def gram_merge(state: DataFrame | None, delta: DataFrame) -> DataFrame:
    """Running-mean update with a new batch: ``h·n/(n+m) + (2/(n+m))·s``.

    state: (i, j, h, n) or None for an empty state; delta: (i, j, s, m)."""
    if state is None:
        return delta.select("i", "j", (F.lit(2.0) / F.col("m").cast("double") * F.col("s")).alias("h"),
                            F.col("m").alias("n"))
    j = state.join(delta, on=["i", "j"])
    tot = (F.col("n") + F.col("m")).cast("double")
    return j.select("i", "j", (F.col("h") * (F.col("n").cast("double") / tot) + (F.lit(2.0) / tot) * F.col("s")).alias("h"),
                    (F.col("n") + F.col("m")).alias("n"))


def gram_delta(df: DataFrame, vec: str, d: int) -> DataFrame:
    """A batch's contribution in long form (i, j, s, m)."""
    return gram_sums(df, vec, d).select("i", "j", "s", F.col("n").alias("m"))


def gram_condition(gram: DataFrame, percdamp: float = K.GPTQ_PERCDAMP) -> DataFrame:
    """Dead columns (zero diagonal) get diagonal 1; then ``percdamp * mean(diag)``
    is added to the diagonal. Adds ``dead`` (per i)."""
    diag = gram.filter(F.col("i") == F.col("j")).select("i", (F.col("h") == 0).alias("dead"))
    fixed = gram.join(diag, on="i").withColumn(
        "h", F.when((F.col("i") == F.col("j")) & F.col("dead"), F.lit(1.0)).otherwise(F.col("h")))
    mean_diag = fixed.filter(F.col("i") == F.col("j")).select(F.avg("h")).scalar()
    return fixed.withColumn("h", F.when(F.col("i") == F.col("j"), F.col("h") + F.lit(percdamp) * mean_diag)
                            .otherwise(F.col("h")))


def act_order(gram: DataFrame) -> DataFrame:
    """Columns ranked by Gram diagonal, descending (ties by column): (col, diag,
    rank). One row per column, so a single ordered window is bounded by d."""
    diag = gram.filter(F.col("i") == F.col("j")).select(F.col("i").alias("col"), F.col("h").alias("diag"))
    w = Window.orderBy(F.col("diag").desc(), F.col("col"))
    return diag.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))
