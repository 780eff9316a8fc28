"""The prefix trie against a plain fold over rebuilt conversations."""
import collections
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from parlance.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(plain):
        h = zlib.crc32(str(c).encode()) % 6
        own = plain.get(c - c % 100, [])[:h] + plain[c][h:]
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
        ends[tuple(own)].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    leaves, spared = collections.Counter(), collections.Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            spared[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), kids[n], leaves[n], spared[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members)


def fast(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(df).collect())


def test_against_a_fold(spark):
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 125), *range(301, 320)]:       # 300 is absent
        for t in range(draw.randint(1, 7)):
            rows.append((c, None if draw.random() < 0.05 else t, draw.choice(["user", "assistant", None]), draw.choice(["", None, "a", "bb", "né\U0001f600"])))
    rows += [(7, 3, "user", "again")] * 3 + [(None, 0, "user", "lost")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert fast(df) == slow(rows)
    assert fast(df.withColumns({"node": F.lit(1), "pos": F.lit("x"), "parent": F.lit(2), "length": F.lit(0)})) == slow(rows)


def test_deep_and_wide(spark, monkeypatch):
    """A chain of 300 turns, 150 equal conversations, and ids joined over many chunks."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    rows = [(100, t, "user", f"t{t}") for t in range(300)] + [(101, t, "user", f"t{t}") for t in range(300)]
    rows += [(c, 0, "system", "hello" * 2000) for c in range(1000, 15_001, 100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert fast(df) == slow(rows)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_contraction_of_random_forests(spark):
    draw = random.Random(2)
    parent = {i: None if i < 2 else (i - 1 if draw.random() < 0.7 else draw.randrange(i)) for i in range(150)}
    depth = {}
    for i in parent:
        depth[i] = 0 if parent[i] is None else depth[parent[i]] + 1
    total = {i: i for i in parent}
    for i in sorted(parent, key=depth.get, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    df = spark.createDataFrame([(i, p, depth[i], i) for i, p in parent.items()], "node long, parent long, depth long, w long")
    assert {r.node: r.w for r in prefix_trie.subtree_sums(df, ["w"]).collect()} == total
