"""A quality classifier: logistic regression over hashed word n-grams, trained
with follow-the-regularised-leader updates and applied as sparse dot products.

Tokens are runs of word characters and runs of one other mark. A text's n-grams
are its tokens, its pairs of neighbours (a pair of equal tokens is one n-gram of
its own, whatever the token) and the pairs of their shapes (case, digits, marks),
all hashed to ``2 ** BITS`` weights. A feature's value is its share of the text's
n-grams of that kind, so a score is a mean of weights and long texts need no cap.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _Memo, slices

BITS, MAX_TRAIN, EPOCHS, SCALE = 18, 20_000, 2, 12.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.002
_TOKENS = re.compile(r"\w+|([^\w\s])\1*")
_SAME, _SPREAD = 1, np.uint64(0x9E3779B97F4A7C15)      # fixed values: the hash of an equal pair, a multiplier


def _hash_token(token: str) -> tuple[int, int]:
    """(hash of the lower-cased token, hash of its shape)."""
    if token.isalpha():
        shape = "a" if token.islower() else "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "aA"
    else:
        shape = "0" if token.isdigit() else "a0" if token[0].isalnum() or token[0] == "_" else token[:1] + str(min(len(token), 3))
    return zlib.crc32(token.lower().encode()) + 2, zlib.crc32(b"\0" + shape.encode())


_HASHES = _Memo(lambda t: _hash_token(t), 400_000)


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, repeats included: one third of the array each for
    tokens, pairs and shape pairs (of which there is one fewer than tokens, so the
    last token pairs with the text's end). Empty for a text without tokens."""
    tokens = [m[0] for m in _TOKENS.finditer(text)] if text else []
    if not tokens:
        return np.empty(0, np.uint32)
    pairs = np.array([_HASHES[t] for t in tokens], np.uint64)
    words, shapes = pairs[:, 0], pairs[:, 1]
    following = np.append(words[1:], np.uint64(0))
    with np.errstate(over="ignore"):
        bigrams = np.where(words == following, np.uint64(_SAME), words * np.uint64(31) + following * np.uint64(0x85EBCA6B) + np.uint64(7))
        shape_pairs = shapes * np.uint64(131) + np.append(shapes[1:], np.uint64(0)) * np.uint64(0xC2B2AE35) + np.uint64(11)
        grams = np.concatenate([words, bigrams, shape_pairs]) * _SPREAD
    return (grams >> np.uint64(64 - BITS)).astype(np.uint32)


def probability(weights: np.ndarray, text: str | None) -> float:
    """The sparse dot product of a text through the logistic function; the last
    weight is the bias, all that an empty text has."""
    grams = features(text)
    z = float(weights[-1]) + (SCALE * float(weights[grams].mean()) if len(grams) else 0.0)
    return 1.0 / (1.0 + np.exp(-min(max(z, -35.0), 35.0)))


def ftrl_train(rows, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights of follow-the-regularised-leader (proximal, per coordinate, L1 and
    L2) over (feature hashes, label) rows, in a new random order each epoch."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def solved(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    data = []
    for grams, label in rows:
        at, counts = np.unique(grams, return_counts=True)
        data.append((np.append(at, bias).astype(np.int32), np.append(SCALE * counts / max(1, len(grams)), 1.0).astype(np.float32), label))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(data)):
            at, x, label = data[i]
            w = solved(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return solved(np.arange(size)).astype(np.float32)


def doc_remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def train_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, held_out: int = 1, folds: int = 3) -> np.ndarray:
    """Weights learnt from labelled rows outside the held-out fold: the
    ``max_train`` of them (a documented bound) with the smallest hash of their id.
    Their hashed features, not their texts, meet in one task, whose result of
    ``2 ** BITS + 1`` weights comes to the driver. Rows without a 0/1 quality or
    a document are passed over; with no row left all weights are 0."""
    spread = F.xxhash64("doc_id")
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .filter("quality in (0, 1) and doc_id is not null").filter(doc_remainder(F.col("doc_id"), folds) != held_out)
              .orderBy(spread, "doc_id", "quality").limit(max_train))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")      # max_train rows at most

    def hashed(batches):
        import pyarrow as pa

        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())],
                                             names=["doc_id", "quality", "grams"])

    def train(batches):
        import pyarrow as pa

        data = ((np.frombuffer(g, np.uint32), q) for b in batches for q, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([ftrl_train(data).tobytes()], pa.binary())], names=["weights"])

    learnt = (rows.select("doc_id", "text", "quality").mapInArrow(hashed, "doc_id long, quality int, grams binary")
              .repartition(1).sortWithinPartitions("doc_id", "quality", "grams").mapInArrow(train, "weights binary"))
    found = learnt.collect()
    return np.frombuffer(found[0].weights, np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1, higher: better) of each row's
    whole ``text``. A null or empty text has the score of the bias alone; repeated
    rows are scored each; nothing but the text goes in. An input column named
    ``score`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)       # 2 ** BITS + 1 floats

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([probability(shared.value, t) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.col("text")))
