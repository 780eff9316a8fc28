"""Approximate nearest neighbours by inner product in a forest of hash prefixes.

Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2) (0 for queries, M the
greatest norm), so that the largest inner product has the smallest angle. Each of
``TREES`` trees gives every vector a string of ``BITS`` bits: the signs of its
projections on the tree's own random orthogonal directions, less the median of a
bounded sample. Sorted by its strings, a tree is an array in which a prefix is a range.

A query descends every tree to the longest prefix that it shares and ascends all
trees at once, a bit at a time, until the ranges together hold enough rows. What is
enough is fitted: a bounded sample of queries is answered by brute force, and the
least number of candidates at which they find ``RECALL`` of their true neighbours
is taken. Ranges are scored whole, in blocks of bounded size, so nothing is cut
off; a node's rows and queries meet once, wherever the node lies in its tree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

TREES, BITS, SAMPLE, SAMPLE_QUERIES, RECALL, SEED = 16, 64, 4_096, 64, 0.95, 11
BLOCK, QUERY_BLOCK, HEAVY = 4_096, 1_024, 256      # rows and queries of a scored block; a heavy node has over 1 / HEAVY of the rows


# ----------------------------------------------------------------------------
# vectors

def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, v, vk`` (components as double and their MD5) of every different row that
    takes part: its id not null, its vector not null, not zero (or of no components)
    and without null or non-finite components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).filter("vec_id is not null and v is not null").filter(fine)
    return some.withColumn("vk", F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda c: (c + 0.0).cast("string")))))).dropDuplicates(["vec_id", "vk"])


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow column of double lists, ended by zeros to ``dim`` components."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    out = np.zeros((len(ends), dim))
    if len(ends) and len(flat) == len(ends) * dim:
        return flat.reshape(-1, dim)
    for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        out[i, :b - a] = flat[a:b]
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> float:
    """The inner product, its products summed without rounding between."""
    from math import fsum, isfinite

    terms = (q * x).tolist()
    return fsum(terms) if all(map(isfinite, terms)) else float(np.dot(q, x))


class Hasher:
    """The trees' directions, offsets and the scale: what every task knows."""

    def __init__(self, dim: int, scale: float, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.dim, self.scale, self.trees, self.bits = dim, scale, trees, bits
        draw = np.random.default_rng(seed)
        blocks = []
        for _ in range(trees):                         # orthogonal within each run of dim + 1 bits
            rows = [np.linalg.qr(draw.standard_normal((dim + 1, dim + 1)))[0] for _ in range(-(-bits // (dim + 1)))]
            blocks.append(np.concatenate(rows)[:bits])
        self.directions = np.concatenate(blocks)
        self.offsets = np.zeros(trees * bits)
        self.greatest = 1.0                            # the greatest norm, in scaled components

    def projections(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.scale
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.greatest**2 - (x**2).sum(1)))
        return np.concatenate([x, lift[:, None]], axis=1) @ self.directions.T

    def strings(self, x: np.ndarray, query: bool) -> np.ndarray:
        """A signed long a tree; its first bit is the longest prefix's first."""
        bits = (self.projections(x, query) > self.offsets).reshape(len(x), self.trees, self.bits)
        packed = np.packbits(bits, axis=2).reshape(len(x), self.trees, 8)
        return packed.view(">u8")[:, :, 0].astype(np.uint64).view(np.int64)


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common prefix of 64-bit strings."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    out = np.full(x.shape, 64, np.int64)
    for half in (32, 16, 8, 4, 2, 1):                  # the place of the highest set bit
        high = x >> np.uint64(half)
        big = high > 0
        out -= np.where(big, half, 0)
        x = np.where(big, high, x)
    return out - (x > 0)


def _prefix(string, level):
    """The first ``level`` bits of a string column as a number."""
    return F.when(level == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftright({string}, cast(64 - level as int))"))


# ----------------------------------------------------------------------------
# the index

def fit_hasher(vectors: DataFrame, trees: int = TREES) -> Hasher | None:
    """Directions from a seed, offsets from the ``SAMPLE`` rows of smallest hash, the
    greatest component and norm from all rows. None for an empty table."""
    size = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("scale")).first()
    if not size.dim:
        return None
    hasher = Hasher(int(size.dim), float(size.scale), trees)
    scaled = F.transform("v", lambda c: c / F.lit(hasher.scale))
    norm2 = vectors.agg(F.max(F.aggregate(scaled, F.lit(0.0), lambda s, c: s + c * c)).alias("n")).first().n
    hasher.greatest = float(np.sqrt(norm2))
    sample = vectors.orderBy(F.xxhash64("vk"), "vec_id").limit(SAMPLE).select("v").collect()
    x = np.zeros((len(sample), hasher.dim))
    for i, r in enumerate(sample):
        x[i, :len(r.v)] = r.v
    hasher.offsets = np.median(hasher.projections(x, query=False), axis=0)
    return hasher


def hashed(vectors: DataFrame, hasher: Hasher, query: bool, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``data`` (components as bytes) and ``strings`` (one a tree) of vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(hasher)

    def run(batches):
        import pyarrow as pa

        hasher = shared.value
        for b in batches:
            x = _matrix(b.column(b.num_columns - 1), hasher.dim)
            strings = hasher.strings(x, query)
            lists = pa.ListArray.from_arrays(np.arange(0, strings.size + 1, hasher.trees, dtype=np.int32), pa.array(strings.ravel()))
            data = pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], data, lists], names=[*keep, "data", "strings"])

    kinds = dict(vectors.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "data binary", "strings array<long>"])
    return vectors.select(*keep, "v").mapInArrow(run, schema)


def fit_candidates(index: DataFrame, asked: DataFrame, hasher: Hasher, k: int, recall: float = RECALL) -> int:
    """How many rows (a row counts once a tree) a query's ranges must hold: the least at
    which ``SAMPLE_QUERIES`` queries (those of smallest hash) find ``recall`` of their
    true neighbours, ``k`` + 1 rows in one tree at least. One pass over all rows."""
    sample = asked.orderBy(F.xxhash64("vk")).limit(SAMPLE_QUERIES).select("vk", "data", "strings").collect()
    if not sample:
        return hasher.trees * (k + 1)
    own = [bytes(r.vk) for r in sample]
    q = np.frombuffer(b"".join(bytes(r.data) for r in sample), "<f8").reshape(len(sample), hasher.dim)
    q_strings = np.array([r.strings for r in sample], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((own, q, q_strings, hasher.dim, hasher.trees))

    def measure(batches):
        """Each task's best rows of every query with the bits they share with it, and
        how many rows share how many bits (summed over trees)."""
        import pyarrow as pa

        own, q, q_strings, dim, trees = shared.value
        best, counts = [[] for _ in own], np.zeros((len(own), 65), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            keys, x = b.column(0).to_pylist(), np.frombuffer(b"".join(b.column(1).to_pylist()), "<f8").reshape(-1, dim)
            strings = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, trees)
            scores = q @ x.T
            for i, mine in enumerate(own):
                bits = _shared_bits(strings, q_strings[i][None, :])
                counts[i] += np.bincount(bits.ravel(), minlength=65)
                top = np.argsort(-scores[i], kind="stable")[:k + 1]
                found = [(float(scores[i, j]), int(bits[j].max())) for j in top.tolist() if keys[j] != mine]
                best[i] = sorted(best[i] + found, reverse=True)[:k]
        rows = [(i, s, level, 0) for i, found in enumerate(best) for s, level in found]
        rows += [(i, None, level, int(n)) for i, level in zip(*np.nonzero(counts), strict=True) for n in [counts[i, level]]]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)) if t == pa.int32() else c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.int32(), pa.int64()), strict=True)], names=["q", "score", "level", "n"])

    told = saved(index.select("vk", "data", "strings").mapInArrow(measure, "q int, score double, level int, n long"), "measured")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("level")))
    near = told.filter("score is not null").withColumn("r", rank).filter(F.col("r") <= k).collect()       # SAMPLE_QUERIES * k rows
    held = np.zeros((len(own), 65), np.int64)
    for r in told.filter("score is null").groupBy("q", "level").agg(F.sum("n").alias("n")).collect():      # SAMPLE_QUERIES * 65 rows
        held[r.q, r.level] = r.n
    held = held[:, ::-1].cumsum(1)[:, ::-1]             # rows that share at least so many bits
    neighbours = np.zeros((len(own), 65), np.int64)
    for r in near:
        neighbours[r.q, r.level] += 1
    total = neighbours.sum()
    neighbours = neighbours[:, ::-1].cumsum(1)[:, ::-1]

    def found(enough: int) -> float:
        level = (held >= enough).sum(1) - 1            # the deepest level that holds enough, the root if none does
        return neighbours[np.arange(len(own)), np.maximum(level, 0)].sum() / max(1, total)

    options = np.unique(held)
    low, high = 0, len(options) - 1
    while low < high:
        mid = (low + high) // 2
        if found(int(options[mid])) >= recall:
            high = mid
        else:
            low = mid + 1
    return max(int(options[low]), hasher.trees * (k + 1))


def node_counts(index: DataFrame, least: int) -> DataFrame:
    """``tree, level, prefix, n`` of every prefix that ``least`` rows or more share, read off
    the trees' sorted arrays; each stretch of an array tells its own prefixes, and
    those at its ends also when they are small, for their sums."""
    strings = index.select(F.posexplode("strings").alias("tree", "string")).groupBy("tree", "string").agg(F.count("*").alias("n"))
    ranged = strings.repartitionByRange("tree", "string").sortWithinPartitions("tree", "string")

    def count(batches):
        import pyarrow as pa

        for b in batches:
            tree, string, n = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.diff(tree)) + 1
            out = []
            for s, t in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tree)], strict=True):
                if s == t:
                    continue
                sums = np.concatenate([[0], np.cumsum(n[s:t])])
                for level in range(BITS + 1):
                    prefix = string[s:t] >> (64 - level) if level else np.zeros(t - s, np.int64)
                    at = np.concatenate([[0], np.flatnonzero(np.diff(prefix)) + 1, [t - s]])
                    held = np.diff(sums[at])
                    told = held >= least
                    told[[0, -1]] = True
                    out += [(int(tree[s]), level, p, h) for p, h in zip(prefix[at[:-1]][told].tolist(), held[told].tolist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["tree", "level", "prefix", "n"])

    parts = ranged.mapInArrow(count, "tree int, level int, prefix long, n long")
    return parts.groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _join_nodes(rows: DataFrame, nodes: DataFrame, heavy: int) -> DataFrame:
    """``rows`` joined on (tree, level, prefix) with ``nodes``, which have ``n``. Nodes of
    over 1 / ``HEAVY`` of the rows, at most HEAVY a tree and level, are broadcast, so
    that a shuffled key has few rows."""
    key = ["tree", "level", "prefix"]
    return (rows.join(F.broadcast(nodes.filter(F.col("n") > heavy)), key)
            .unionByName(rows.join(nodes.filter(F.col("n") <= heavy), key)))


# ----------------------------------------------------------------------------
# the search

def ascended(index: DataFrame, asked: DataFrame, enough: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """How far each query must ascend: ``vk, level`` of the longest prefix length at which
    its ranges in all trees hold ``enough`` rows (the root's 0 if none does); and the
    counts. Ranges of fewer than enough / (2 trees) rows are not counted, so a query may
    ascend a bit further, never less far."""
    counts = saved(node_counts(index, max(1, enough // (2 * TREES))), "counts")
    deepest = counts.agg(F.max("level").alias("d")).first().d or 0
    paths = (asked.select("vk", F.posexplode("strings").alias("tree", "string"))
             .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))))
    paths = paths.withColumn("prefix", _prefix("string", F.col("level"))).select("vk", "tree", "level", "prefix")
    held = _join_nodes(paths, counts, rows // HEAVY).groupBy("vk", "level").agg(F.sum("n").alias("n"))
    level = held.filter(F.col("n") >= enough).groupBy("vk").agg(F.max("level").alias("level"))
    return saved(asked.select("vk").join(level, "vk", "left").select("vk", F.coalesce("level", F.lit(0)).alias("level")), "levels"), counts


def forest_hits(index: DataFrame, asked: DataFrame, levels: DataFrame, counts: DataFrame, hasher: Hasher, k: int, rows: int) -> DataFrame:
    """``query, vk, vec_id, score``: of every block of every query's ranges, the k + 1 best."""
    heavy = rows // HEAVY
    key = ["tree", "level", "prefix"]
    wanted = (asked.join(levels, "vk").select("vk", "data", "level", F.posexplode("strings").alias("tree", "string"))
              .withColumn("prefix", _prefix("string", F.col("level"))).drop("string"))
    wanted = saved(wanted, "wanted")
    nodes = wanted.groupBy(*key).agg(F.count("*").alias("asked")).join(counts, key, "left")
    # a range too small to be counted is one block
    nodes = saved(nodes.select(*key, F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                               F.ceil(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) / BLOCK).cast("int").alias("blocks"),
                               F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("parts")), "nodes")
    used = sorted(r.level for r in nodes.select("level").distinct().collect())      # at most 65
    if not used:
        return index.sparkSession.createDataFrame([], "query binary, vk binary, vec_id long, score double")
    each = index.select("vk", "vec_id", "data", F.posexplode("strings").alias("tree", "string")).withColumn("level", F.explode(F.array(*[F.lit(x) for x in used])))
    each = each.withColumn("prefix", _prefix("string", F.col("level"))).drop("string")
    cell = F.xxhash64(*key, "block", "part").alias("cell")           # two cells of one name only score each other's rows too
    have = (_join_nodes(each, nodes, heavy).withColumn("block", F.pmod(F.xxhash64("vec_id", "vk"), F.col("blocks")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select(cell, F.lit(1).alias("kind"), "vk", "vec_id", "data"))
    want = (_join_nodes(wanted, nodes, heavy).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("part", F.pmod(F.xxhash64("vk"), F.col("parts")).cast("int"))
            .select(cell, F.lit(0).alias("kind"), "vk", F.lit(None).cast("long").alias("vec_id"), "data"))
    dim = hasher.dim

    def score(batches):
        import pyarrow as pa

        def best(queries, rows):
            """The k + 1 best of ``rows`` for each of ``queries``, all that tie among them."""
            q = np.frombuffer(b"".join(d for _, d in queries), "<f8").reshape(-1, dim)
            x = np.frombuffer(b"".join(r[2] for r in rows), "<f8").reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                scores = q @ x.T
            out = []
            for i, (query, _) in enumerate(queries):
                near = range(len(rows))
                if len(rows) > k + 1:
                    edge = np.partition(scores[i], len(rows) - k - 1)[len(rows) - k - 1]
                    slack = 1e-9 * max(1e-300, float(np.abs(q[i]) @ np.abs(x).max(0)))
                    if np.isfinite(edge) and np.isfinite(slack):
                        near = np.flatnonzero(scores[i] >= edge - slack).tolist()
                found = sorted((-_exact(q[i], x[j]), rows[j][1], rows[j][0]) for j in near)[:k + 1]
                out += [(query, vk, vec, -s) for s, vec, vk in found]
            return out

        def told(out):
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.float64()), strict=True)], names=["query", "vk", "vec_id", "score"])

        now, queries, rows, out = None, [], [], []
        for b in batches:
            for c, kind, vk, vec, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if c != now:
                    if queries and rows:
                        out += best(queries, rows)
                    now, queries, rows = c, [], []
                if kind:
                    rows.append((vk, vec, data))
                else:
                    queries.append((vk, data))
            if out:
                yield told(out)
                out = []
        if queries and rows:
            yield told(best(queries, rows))

    return (have.unionByName(want).repartition("cell").sortWithinPartitions("cell", "kind")
            .mapInArrow(score, "query binary, vk binary, vec_id long, score double"))


def nearest(vectors: DataFrame, query_ids, k: int = 20, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query, by inner
    product in double precision (products summed without rounding between), ties to the
    smaller id; all other rows if there are no more than k.

    ``vectors`` has ``vec_id, embedding``; ``query_ids`` is a condition on ``vec_id``.
    Vectors null, zero, of no components or with null or non-finite components take no
    part, nor do rows of null id. Repeated rows count once; different vectors of one id
    are rows of their own, each a query and a candidate. Vectors of different length
    compare as if ended by zeros. Equal vectors are asked once, and only the k + 1
    smallest ids among equal candidates are kept: no other can be in a result. Other
    columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = saved(distinct_vectors(vectors), "vectors")
    same = F.row_number().over(Window.partitionBy("vk").orderBy("vec_id"))
    kept = whole.withColumn("r", same).filter(F.col("r") <= k + 1).drop("r")
    hasher = fit_hasher(whole, trees)
    if hasher is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = saved(hashed(kept, hasher, False, ("vk", "vec_id")), "index")
    asked = saved(hashed(whole.filter(query_ids).groupBy("vk").agg(F.first("v").alias("v")), hasher, True, ("vk",)), "asked")
    rows = index.count()
    levels, counts = ascended(index, asked, fit_candidates(index, asked, hasher, k, recall), rows)
    hits = forest_hits(index, asked, levels, counts, hasher, k, rows)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "vk")
    once = hits.groupBy("query", "vk", "vec_id").agg(F.max("score").alias("score"))
    best = saved(once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).drop("r"), "best")
    ids = whole.filter(query_ids).select(F.col("vec_id").alias("query_id"), F.col("vk").alias("query"))
    found = ids.join(best, "query").filter((F.col("vec_id") != F.col("query_id")) | (F.col("vk") != F.col("query")))
    mine = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", "vk")
    return found.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
