"""Exact top-k by inner product over a pivot-distance index.

Vectors are whole numbers, floor(256 x) of each component. With one more
coordinate, sqrt(M^2 - |x|^2) (0 for queries, M the greatest norm), the largest
inner product is the smallest distance: |q - x|^2 = |q|^2 + M^2 - 2 q.x. The index
keys every vector by its nearest pivot and its distance from it, in annuli. A
query first reads the annuli around its own distance from its nearest pivot until
they hold enough rows, which gives a k-th score to beat; then it reads just those
annuli of all pivots that the triangle inequality, d(q, x) >= |d(q, p) - d(x, p)|,
leaves in play. Cells are cut into blocks of bounded size, and so are the queries
of a cell, so a task's work does not grow with a hot annulus or vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

PIVOTS, ANNULI, BLOCK, QUERY_BLOCK, SLACK = 16, 24, 16_384, 4_096, 1e-6
_HITS = "query_id long, vec_id long, score long, size double"      # score null: beyond a long; size orders all


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, v``: floor(256 x) of every component, x as double, as doubles that hold whole
    numbers. Rows are left out whose id or vector is null, or whose vector holds null
    or non-finite components; all others stay, repeated ids and rows too."""
    x = F.transform("embedding", lambda c: c.cast("double") * 256.0)
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # from 2 ** 52 on a double is a whole number
    whole = F.transform("x", lambda c: F.when(F.abs(c) < F.lit(float(2**52)), F.floor(F.when(F.abs(c) < F.lit(float(2**52)), c).otherwise(0.0)).cast("double")).otherwise(c))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null").filter(fine).select("vec_id", whole.alias("v"))


def _matrix(data, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<f8").reshape(-1, dim)


def _products(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """Inner products of one query with rows of whole numbers: as doubles, exact while
    every partial sum is below 2 ** 53, and as exact integers by place for the others."""
    top = np.abs(q).max(initial=0.0) * np.abs(x).max(axis=1, initial=0.0) * q.size
    with np.errstate(over="ignore", invalid="ignore"):
        scores = x @ q
    exact, whole = {}, None
    for i in np.flatnonzero(~(top < 2.0**53)).tolist():
        whole = whole or [int(c) for c in q.tolist()]
        exact[i] = sum(a * int(b) for a, b in zip(whole, x[i].tolist(), strict=True))
        try:
            scores[i] = float(exact[i])
        except OverflowError:
            scores[i] = np.inf if exact[i] > 0 else -np.inf
    return scores, exact


class PivotIndex:
    """What every task knows: pivots (``PIVOTS`` rows) and their cells' sizes and
    bounds (``PIVOTS * ANNULI`` rows at most)."""

    def __init__(self, pivots: np.ndarray, norm2: float, dim: int):
        self.pivots, self.norm2, self.dim = pivots.astype(np.float64), norm2, dim
        self.lift = np.sqrt(np.maximum(0.0, norm2 - (self.pivots**2).sum(1)))
        self.width = max(1e-9, 2 * float(np.sqrt(norm2))) / ANNULI
        self.cells: dict[tuple[int, int], tuple[int, float, float]] = {}

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distances in the lifted space of rows to every pivot."""
        x = x.astype(np.float64)
        own = (x**2).sum(1)
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm2 - own))
        d2 = own[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * x @ self.pivots.T + (lift[:, None] - self.lift[None, :]) ** 2
        return np.sqrt(np.maximum(0.0, d2))

    def first_cells(self, d: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """Annuli of the nearest pivot, by their gap to the query's distance,
        until they hold ``enough`` rows."""
        held, out = 0, []
        for p in np.argsort(d, kind="stable").tolist():
            own = [(max(0.0, lo - d[p], d[p] - hi), a, n) for (pp, a), (n, lo, hi) in self.cells.items() if pp == p]
            for _, a, n in sorted(own):
                out.append((p, a))
                held += n
                if held >= enough:
                    return out
        return out

    def cells_in_play(self, d: np.ndarray, norm2: float, least: float) -> list[tuple[int, int]]:
        """Cells that can hold a score of ``least`` or more: inner products are at
        most (|q|^2 + M^2 - gap^2) / 2."""
        out = []
        for (p, a), (_, lo, hi) in self.cells.items():
            gap = max(0.0, lo - d[p], d[p] - hi)
            most = (norm2 + self.norm2 - gap * gap) / 2
            if most + SLACK * (abs(most) + norm2 + self.norm2) + 1 >= least:
                out.append((p, a))
        return out


def build_index(vectors: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[PivotIndex | None, DataFrame]:
    """The index of all vectors, and its rows ``pivot, annulus, block, vec_id, v``.
    Of equal vectors only rows of the k + 1 smallest ids, k of one id, can be in any
    result, so no more are kept. Pivots are the ``pivots`` vectors with the smallest hash."""
    # first k rows of an id and vector, then ids by rank: both limits are pushed below the shuffle
    same = F.row_number().over(Window.partitionBy("v", "vec_id").orderBy(F.lit(1)))
    few = vectors.withColumn("r", same).filter(F.col("r") <= k).drop("r")
    ids = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = saved(few.withColumn("r", ids).filter(F.col("r") <= k + 1).drop("r"), "vectors")
    size = kept.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).alias("norm2")).first()
    if not size.dim:
        return None, kept
    dim = int(size.dim)
    # vectors of fewer components count as ending in zeros
    padded = kept.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))).alias("v"))
    chosen = [r.v for r in padded.orderBy(F.xxhash64("v"), "vec_id").limit(pivots).collect()]
    index = PivotIndex(np.array(chosen, np.float64), float(size.norm2), dim)
    shared = kept.sparkSession.sparkContext.broadcast(index)

    def place(batches):
        import pyarrow as pa

        index = shared.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, index.dim)
            d = index.distances(x, query=False)
            p = d.argmin(1)
            near = d[np.arange(len(d)), p]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(p.astype(np.int32)), pa.array((near / index.width).astype(np.int32)), pa.array(near),
                pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<f8")], pa.binary())], names=["vec_id", "pivot", "annulus", "d", "v"])

    rows = saved(padded.mapInArrow(place, "vec_id long, pivot int, annulus int, d double, v binary"), "index")
    cells = rows.groupBy("pivot", "annulus").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
    index.cells = {(r.pivot, r.annulus): (r.n, r.lo, r.hi) for r in cells}
    return index, rows


def _hits(rows: DataFrame, asked: DataFrame, index: PivotIndex, k: int, query_blocks: int) -> DataFrame:
    """The k best of every (query, block of a cell) that ``asked`` names:
    ``query_id, v, pivot, annulus``."""
    spark = rows.sparkSession
    blocks = spark.createDataFrame([(p, a, max(1, -(-n // BLOCK))) for (p, a), (n, _, _) in index.cells.items()], "pivot int, annulus int, blocks int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    cut = F.broadcast(blocks)                           # a row per cell: PIVOTS * ANNULI at most
    have = (rows.join(cut, ["pivot", "annulus"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
            .withColumn("part", parts).select("pivot", "annulus", "block", "part", "vec_id", "v"))
    want = (asked.join(cut, ["pivot", "annulus"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).select("pivot", "annulus", "block", "part", "query_id", "v"))
    dim = index.dim

    def best(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": pd.array([], "Int64"), "size": np.zeros(0)})
        left = left.sort_values("vec_id")
        ids, x = left["vec_id"].to_numpy(), _matrix(left["v"], dim)
        out = []
        for query, q in zip(right["query_id"].tolist(), _matrix(right["v"], dim), strict=True):
            scores, exact = _products(q, x)
            own = np.flatnonzero(ids != query)
            if len(own) > k:                            # all that tie with the k-th
                edge = np.partition(scores[own], len(own) - k)[len(own) - k]
                own = own[scores[own] >= edge]
            value = lambda i: exact[i] if i in exact else int(scores[i])  # noqa: B023, E731
            near = sorted(own.tolist(), key=lambda i: (-value(i), i))[:k]         # noqa: B023
            out += [(query, int(ids[i]), v if -2**63 <= (v := value(i)) < 2**63 else None, float(scores[i])) for i in near]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pd.DataFrame({"query_id": np.array(cols[0], np.int64), "vec_id": np.array(cols[1], np.int64), "score": pd.array(cols[2], "Int64"), "size": np.array(cols[3], np.float64)})

    key = ["pivot", "annulus", "block", "part"]
    return have.groupBy(*key).cogroup(want.groupBy(*key)).applyInPandas(lambda a, b: best(a, b), _HITS)


def exact_top_k(vectors: DataFrame, query_ids, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k other rows of greatest whole inner
    product with each query, ties to the smaller id (all rows, if fewer).

    ``vectors`` has ``vec_id, embedding``; ``query_ids`` is a condition on
    ``vec_id``. See ``whole_vectors`` for rows that take no part. Rows of one id are
    candidates each for themselves, none of them for a query of that id; a query id
    of several rows has one list, of the best pairs of any of them. Vectors of
    different length are compared as if padded by zeros; rows of equal vectors all
    compete; other columns are not read; an empty table gives no rows. Scores are
    exact; one in the result that a long cannot hold is an error.
    """
    spark = vectors.sparkSession
    whole = saved(whole_vectors(vectors), "whole")
    queries = whole.filter(query_ids)
    index, rows = build_index(whole, k, pivots)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shared = spark.sparkContext.broadcast(index)
    asked_of = queries.select(F.col("vec_id").alias("query_id"), F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(index.dim) - F.size("v"))).alias("v"))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def cells(second: bool):
        def ask(batches):
            import pyarrow as pa

            index = shared.value
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, index.dim)
                d = index.distances(x, query=True)
                norms = (x.astype(np.float64) ** 2).sum(1)
                least = b.column(2).to_pylist() if second else None
                rows = []
                for i, query in enumerate(b.column(0).to_pylist()):
                    first = index.first_cells(d[i], 4 * (k + 1))
                    if not second:
                        mine = first
                    else:
                        seen = set(first)
                        floor = -np.inf if least[i] is None else float(least[i])
                        mine = [c for c in index.cells_in_play(d[i], float(norms[i]), floor) if c not in seen]
                    data = np.ascontiguousarray(x[i], "<f8").tobytes()
                    rows += [(query, p, a, data) for p, a in mine]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)],
                                                 names=["query_id", "pivot", "annulus", "v"])

        return ask

    kinds = "query_id long, pivot int, annulus int, v binary"
    near = saved(_hits(rows, asked_of.mapInArrow(cells(False), kinds), index, k, query_blocks), "hits")
    best = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("score"), "vec_id")
    least = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("size").alias("least"))
    rest = asked_of.join(least, "query_id", "left").select("query_id", "v", "least").mapInArrow(cells(True), kinds)
    found = near.unionByName(_hits(rows, rest, index, k, query_blocks))
    score = F.coalesce("score", F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
