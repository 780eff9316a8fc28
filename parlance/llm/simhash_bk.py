"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Fingerprints are made per document, equal ones become one node, and nodes within
``RADIUS`` bits meet by the pigeonhole principle: two fingerprints that differ in
at most 2 bits agree in one of 3 bands. Each (band, value) is a shard whose rows
meet in one task, which puts them into a BK-tree (children keyed by their integer
Hamming distance to the parent), follows only edges that the triangle inequality
allows, and joins what it finds. A shard hands on a star of links, not its pairs.
Shards of more than ``SHARD`` fingerprints are cut again by the values of 4 of 6
blocks (2 bits spoil at most 2 blocks), in which at most 2 ** 22 values are left.
Components then come from alternating large and small stars.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, saved, slices, words_of

SHINGLE, RADIUS, SEED, SHARD = 3, 2, 42, 1024
_ONES = (1 << 64) - 1


def simhash(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a word sequence: bit i is 1 if over half of the
    shingles' XXH64 have it. Fewer words than a shingle are one shingle, no words
    give 0."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    text = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[:n - 1]]
    last = ends[min(shingle, len(words)) - 1:]
    hashes = np.array([xxh64_intdigest(text[a:b - 1], SEED) for a, b in zip(starts, last, strict=False)], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        some = hashes[at:at + 65_536]
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


class BKTree:
    """Fingerprints, each child under its parent's edge of their distance."""

    def __init__(self):
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add_and_find(self, value: int, radius: int) -> list[int]:
        """Insert ``value`` as the next number; the numbers of all earlier ones
        within ``radius``."""
        number = len(self.value)
        self.value.append(value)
        self.children.append({})
        if not number:
            return []
        found, todo, values, children = [], [0], self.value, self.children
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            below = children[node]
            if below:
                todo.extend([below[e] for e in range(d - radius, d + radius + 1) if e in below])
        node = 0
        while True:
            d = (values[node] ^ value).bit_count()
            if d not in children[node]:
                children[node][d] = number
                return found
            node = children[node][d]


def shard_links(nodes: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links (larger id, smaller id) that join the nodes (id, fingerprint) of a
    shard like all pairs within ``radius`` would, at most one for each node."""
    nodes = sorted(nodes)
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = BKTree()
    for i, (_, value) in enumerate(nodes):
        for j in tree.add_and_find(value & _ONES, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(nodes[i][0], nodes[root(i)][0]) for i in range(len(nodes)) if root(i) != i]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row's whole text,
    and the string columns to ``keep``."""
    def make(batches):
        import pyarrow as pa

        for batch in slices(batches):
            values = np.array([simhash(words_of(t), shingle) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *keep])
        hand_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(make, ", ".join(["doc_id long", "fp long", *(f"{k} string" for k in keep)]))


def _blocks(count: int) -> list[tuple[int, int]]:
    """(shift, mask) of ``count`` blocks of the 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _masked(mask: int):
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _shards(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each node and mask: ``shard`` (number of the mask), ``value``."""
    keyed = F.array(*[F.struct(F.lit(i).alias("shard"), _masked(m).alias("value")) for i, m in enumerate(masks)])
    return nodes.withColumn("key", F.explode(keyed)).select("node", "fp", "key.shard", "key.value")


def _links_within(rows: DataFrame, radius: int) -> DataFrame:
    """Links of every shard, whose rows pass sorted, one shard in memory."""
    def link(batches):
        import pyarrow as pa

        def out(found):
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

        key, held = None, []
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            shard, value, node, fp = cols
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (value[1:] != value[:-1])) + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)], strict=True):
                if a == b:
                    continue
                now = (int(shard[a]), int(value[a]))
                if now != key:
                    if len(held) > 1:
                        found += shard_links(held, radius)
                    key, held = now, []
                held += zip(node[a:b].tolist(), fp[a:b].tolist(), strict=True)
            if found:
                yield out(found)
        if len(held) > 1:
            yield out(shard_links(held, radius))

    return (rows.repartition("shard", "value").sortWithinPartitions("shard", "value").select("shard", "value", "node", "fp")
            .mapInArrow(link, "u long, v long"))


def near_links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links ``u, v`` (u > v) that connect the nodes (``node, fp``, different
    fingerprints) exactly as all pairs within ``radius`` bits do."""
    bands = _shards(nodes, [m << a for a, m in _blocks(radius + 1)])
    large = bands.groupBy("shard", "value").count().filter(F.col("count") > shard).select("shard", "value")
    sized = bands.join(large.withColumn("large", F.lit(True)), ["shard", "value"], "left")
    small = _links_within(sized.filter("large is null"), radius)
    blocks = _blocks(3 * radius)
    masks = [sum(blocks[i][1] << blocks[i][0] for i in kept) for kept in itertools.combinations(range(3 * radius), 2 * radius)]
    again = sized.filter("large").select("node", "fp").distinct()
    return small.unionByName(_links_within(_shards(again, masks), radius))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node that has a
    link, by alternating large and small stars, written once a round. A node's
    neighbours never meet in one task: the minimum is aggregated, then joined."""
    edges = saved(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = saved(small, "links")
        r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (r.n, r.h) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = (r.n, r.h)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp``, the columns to ``keep``, ``group`` (the smallest fingerprint
    reachable) and ``component_id`` (the group's smallest ``doc_id``, null where no
    row of it has one) of every row. Fingerprints are the nodes, so rows link and
    bridge whatever their ids: none, or one id on different texts."""
    prints = saved(fingerprints(docs, shingle, keep), "fingerprints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "group").select("fp", "group", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` of every row:
    the smallest ``doc_id`` reachable over fingerprints at most ``radius`` bits apart.

    Null, empty and blank texts have fingerprint zero and link like any other;
    repeated rows are rows of one component; rows of null ``doc_id`` link like any
    other but are never the smallest: where a component has no id, it is null;
    other columns are not read; an empty table gives no rows.
    """
    return near_groups(docs, shingle, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
