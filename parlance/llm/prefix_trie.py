"""The trie of conversation prefixes, its subtree totals by tree contraction.

Every distinct sequence of first turns is a node. A sequence is named by a digest of
running sums of its turns' digests (each taken with the turn's place), so names
come from one scan, however long a conversation is.

Totals over subtrees come from parallel tree contraction: a round rakes all leaves
(their totals go to their parents) and compresses unary chains (a chosen node with
one child, whose parent is not chosen too, is cut out: its child moves up to its
parent, its weight is added there). Rounds grow with the logarithm of the nodes, not
with the depth. Cut nodes get their totals when rounds are unrolled: what they
weighed when they were cut and their child's total. Every join in it is of unique
keys on both sides, and what goes to a parent is summed before it is shuffled, so a
node of a million children costs no more than others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import positions, running_sums
from .common import saved

SHARED, GROUP, CHUNK = 6, 100, 60_000      # crc32 % SHARED turns are shared within GROUP ids; characters of a hashed chunk
_LANES = ["p1", "p2", "p3", "p4"]


# ----------------------------------------------------------------------------
# conversations

def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), ``turn_key`` (a digest of role and text) and ``chars``
    of every row of a ``conv_id``, by turn, null first; rows of one turn by role, then
    by the text's digest. Null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_key"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("turn_key"), F.col("tie")]
    return positions(rows, ["conv_id"], order, "pos").select("conv_id", "pos", "turn_key", "chars")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the first h turns of the first one of its hundred, then
    its own turns after its first h; h = crc32 of its decimal id, modulo 6.
    Returns the turns (``conv_id, pos, turn_key, chars, length``) and the conversations
    (``conv_id, length``), turnless ones among them."""
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    first = turns.filter(F.col("pos") < SHARED - 1).filter(F.col("conv_id") % GROUP == 0).withColumnRenamed("conv_id", "base")
    held = first.groupBy("base").agg(F.count("*").alias("held"))
    convs = (turns.groupBy("conv_id").agg(F.count("*").alias("own"))
             .withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % GROUP}).join(held, "base", "left")
             .withColumn("lent", F.least("h", F.coalesce("held", F.lit(0))))
             .withColumn("length", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
             .select("conv_id", "base", "h", "lent", "length"))
    convs = saved(convs, "conversations")
    lent = convs.join(first, "base").filter(F.col("pos") < F.col("h")).select("conv_id", "pos", "turn_key", "chars", "length")
    own = (turns.join(convs, "conv_id").filter(F.col("pos") >= F.col("h"))
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "turn_key", "chars", "length"))
    return lent.unionByName(own), convs.select("conv_id", "length")


def _name(lanes: list[Column], depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *lanes, depth)))


def prefix_rows(turns: DataFrame) -> DataFrame:
    """``conv_id, node, parent, depth, chars, last`` of every prefix of every conversation."""
    digest = F.md5(F.concat_ws(":", F.col("pos"), F.col("turn_key")))
    lanes = {f"l{i}": F.conv(F.substr(digest, F.lit(8 * i - 7), F.lit(8)), 16, 10).cast("long") for i in range(1, 5)}
    summed = running_sums(turns.withColumns(lanes), ["conv_id"], ["pos"], {p: f"l{i}" for i, p in enumerate(_LANES, 1)})
    depth = F.col("pos") + 1
    return summed.select(
        "conv_id", _name([F.col(p) for p in _LANES], depth).alias("node"),
        _name([F.col(p) - F.col(f"l{i}") for i, p in enumerate(_LANES, 1)], F.col("pos")).alias("parent"),
        depth.alias("depth"), "chars", (depth == F.col("length")).alias("last"))


# ----------------------------------------------------------------------------
# tree contraction

def _plus(df: DataFrame, more: DataFrame, weights: list[str]) -> DataFrame:
    """``df`` with the sums of ``more`` (one row a node) added to its weights."""
    renamed = more.select(F.col("parent").alias("node"), *[F.col(w).alias(f"_{w}") for w in weights])
    keep = [c for c in df.columns if c not in weights]
    return df.join(renamed, "node", "left").select(*keep, *[(F.col(w) + F.coalesce(f"_{w}", F.lit(0))).alias(w) for w in weights])


def subtree_sums(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """``node`` and the totals of ``weights`` over its subtree, itself included.

    ``nodes`` has ``node, parent`` (null at a root), ``depth`` and the weights, a row a
    node; every parent is a node. Any number of trees; an empty table gives no rows.
    """
    def to_parents(rows: DataFrame) -> DataFrame:
        return rows.groupBy("parent").agg(*[F.sum(w).alias(w) for w in weights])

    alive = saved(nodes.select("node", "parent", "depth", *weights), "alive")
    done, cuts, turn = [], [], 0
    while True:
        # rake: what has no child gives its total to its parent
        kids = alive.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
        state = saved(alive.join(kids, "node", "left"), "state")
        leaves = state.filter("kids is null and parent is not null")
        done.append(leaves.select("node", *weights))
        rest = saved(_plus(state.filter("kids is not null or parent is null").drop("kids"), to_parents(leaves), weights), "rest")
        if rest.filter("parent is not null").isEmpty():
            done.append(rest.select("node", *weights))
            break
        # compress: nodes of one child, none next to another. Bits of the depth halve a
        # plain chain each round; a hash takes over where cuts have mixed the depths
        only = (rest.filter("parent is not null").groupBy(F.col("parent").alias("node"))
                .agg(F.count("*").alias("kids"), F.min("node").alias("child")).filter("kids = 1").drop("kids"))
        coin = F.col("depth").cast("long").bitwiseAND(F.lit(1 << turn)) != 0 if turn < 12 else F.xxhash64("node", F.lit(turn)) % 2 == 0
        picked = rest.filter("parent is not null").filter(coin).join(only, "node")
        cut = saved(picked.join(picked.select(F.col("child").alias("node")), "node", "left_anti"), "cut")
        cuts.append(cut)
        moved = cut.select(F.col("child").alias("node"), F.col("parent").alias("up"))
        left = (rest.join(cut.select("node"), "node", "left_anti").join(moved, "node", "left")
                .withColumn("parent", F.coalesce("up", "parent")).drop("up"))
        alive = saved(_plus(left, to_parents(cut), weights), "alive")
        turn += 1

    known = reduce(DataFrame.unionByName, done)
    for cut in reversed(cuts):
        below = known.select(F.col("node").alias("child"), *[F.col(w).alias(f"_{w}") for w in weights])
        grown = saved(cut.join(below, "child").select("node", *[(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights]), "grown")
        known = known.unionByName(grown)
    return known


# ----------------------------------------------------------------------------
# the trie

def ends_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: lowercase SHA-256 of its ``conv_id``s in decimal, ascending,
    comma-joined. Ranges of ids are joined to chunks in parallel; a node's chunks
    are then streamed through one digest, none of them held."""
    def chunks(batches):
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "at", "ids"])

        key, at, ids, size, rows = None, 0, [], 0, []
        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != key or size > CHUNK:
                    if ids:
                        rows.append((key, at, ",".join(ids)))
                    key, at, ids, size = node, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if rows:
                yield out(rows)
                rows = []
        if ids:
            yield out([(key, at, ",".join(ids))])

    def digests(batches):
        from hashlib import sha256

        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["node", "ends_sha256"])

        key, digest = None, None
        for batch in batches:
            rows = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                text = ids.as_py().encode()
                if node != key:
                    if digest:
                        rows.append((key, digest.hexdigest()))
                    key, digest = node, sha256(text)
                else:
                    digest.update(b"," + text)
            if rows:
                yield out(rows)
        if digest:
            yield out([(key, digest.hexdigest())])

    ranged = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ranged.mapInArrow(chunks, "node binary, at long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "at").mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: ``conv_id`` (smallest
    member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.

    Null role or text is empty; null turns come first; rows of one turn go by role and
    text; repeated rows are turns of their own; rows of null ``conv_id`` belong to no
    conversation and are left out; ``%`` keeps an id's sign; other columns are not
    read; a table without conversations gives no rows, not even the root.
    """
    turns, convs = rebuilt_turns(saved(ordered_turns(conversations), "turns"))
    rows = saved(prefix_rows(turns), "prefixes")
    root = _name([F.lit(0).cast("long")] * 4, F.lit(0).cast("long"))
    found = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = saved(found.unionByName(top), "nodes")
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    own = nodes.select("node", "parent", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
                       (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    totals = subtree_sums(own, ["saved_tokens", "n_leaves"])
    ends = rows.filter("last").select("node", "conv_id").unionByName(convs.filter("length = 0").select(root.alias("node"), "conv_id"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = F.sha2(F.lit(""), 256)
    return (nodes.join(totals, "node").join(ends_digests(ends), "node", "left").join(parents, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")))
