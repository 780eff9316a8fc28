"""Token ids as fixed-width bit fields in blocks, and their way back.

A packed table has one row per block: whole documents in ascending ``doc_id``
order until a block has ``BLOCK_IDS`` ids, every id in the least number of bits
that holds the vocabulary, least significant bit first, padded to 64 ids (a whole
number of 64-bit words). A block carries its start in its shard and the length of
each of its documents, so any id is found by (shard, block, bit) without reading
what lies before it. The files are Spark's own Parquet files of these rows, in
the shared folder: tasks commit or repeat them as a whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bpe_encoder, saved, slices, vocabulary_path

BLOCK_IDS = 65_536
BROADCAST_ROWS = 500_000             # shards: rows of an int and a long
_BLOCKS = ("shard int, block long, start long, n_ids long, bits int, doc_ids array<long>, lengths array<long>, payload binary")


def id_bits(size: int) -> int:
    """Bits that hold the ids 0 .. size - 1."""
    return max(1, (size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as ``bits``-wide fields; 64 fields make ``bits`` words of 64 bits."""
    rows = -(-len(ids) // 64)
    fields = np.zeros((rows, 64), np.uint64)
    fields.reshape(-1)[:len(ids)] = ids
    words = np.zeros((rows, bits), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= fields[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= fields[:, j] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack_bits(payload: bytes, bits: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids start .. stop of a block, reading only the words that hold them."""
    words = np.frombuffer(payload, "<u8").reshape(-1, bits)
    stop = 64 * len(words) if stop is None else stop
    first = start // 64
    words = words[first:-(-stop // 64)]
    fields = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        fields[:, j] = value & mask
    return fields.reshape(-1)[start - 64 * first:stop - 64 * first].astype("<u4")


def encode_blocks(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of every document's ids and ``end_id``, shards in ascending order of
    ``doc_id`` (null first; rows of one id by a hash of their text, so even a
    ``doc_id`` of very many rows spreads over shards). Null text is empty; repeated
    rows are stored each; an empty table gives no rows."""
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, shard = bpe_encoder(vocabulary), TaskContext.get().partitionId()
        bits, end = id_bits(max(encoder.size, end_id + 1)), end_id.to_bytes(4, "little")
        block = start = held = 0
        docs_in, lengths, ids = [], [], []

        def row():
            data = np.frombuffer(b"".join(ids), "<u4")
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            values = [shard, block, start, len(data), bits, docs_in, lengths, pack_bits(data, bits)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                              names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(encoder.encode_bytes(text or "") + end)
                docs_in.append(doc)
                lengths.append(len(ids[-1]) // 4)
                held += lengths[-1]
                if held >= block_ids:
                    yield row()
                    block, start, held = block + 1, start + held, 0
                    docs_in, lengths, ids = [], [], []
        if ids:
            yield row()

    tie = F.xxhash64("text")
    return (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), tie)
            .sortWithinPartitions(F.col("doc_id"), tie).mapInArrow(encode, _BLOCKS))


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    encode_blocks(docs, vocabulary, end_id, block_ids).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the packed files, ``doc_id, start, n_tokens, ids``:
    ``start`` counts the ids of all documents before it, over all shards; ``ids``
    are little-endian unsigned 32-bit integers. Blocks are self-contained, so any
    task may read any block."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)       # a row per shard
    sizes = saved(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")), "shards")
    shards = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if sizes.count() <= BROADCAST_ROWS:                 # else a shuffle join; the rows are the same
        shards = F.broadcast(shards)

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_bits(r["payload"], r["bits"], 0, r["n_ids"])
                ends = np.cumsum(np.array(r["lengths"], np.int64))
                starts = ends - np.array(r["lengths"], np.int64)
                data = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"] + r["base"], pa.int64()), pa.array(r["lengths"], pa.int64()),
                    pa.array([bytes(data[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(shards, "shard").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
