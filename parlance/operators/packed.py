"""Rows that meet by key in packed form.

A task sorts the rows it holds, cuts them into the buckets of their keys and sends every
bucket as one compressed value (an Arrow stream whose strings are dictionaries of that
bucket), so that a row travels as a few bytes instead of its strings. ``per_bucket`` then
hands each bucket, with all rows of its keys, to a function over an Arrow table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACK_ROWS = 500_000     # rows that a task holds before it packs them
PAIR_ROWS = 800_000     # the same for counts of pairs: the more, the fewer are sent twice
PAIR_TOKENS = 200_000   # tokens that are paired at once
OUT_ROWS = 65_536       # rows of a batch that goes back to Spark
SCHEMA = "_b int, n long, block binary"


def buckets(spark: SparkSession) -> int:
    """Two for every shuffle partition: a task holds one at a time."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def codes(column):
    """Numbers that order as the values of a dictionary column do, null first as -1, and
    the column with a sorted dictionary."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(chunk, pa.ChunkedArray):                       # no rows
        chunk = pa.array([], chunk.type)
    if not pa.types.is_dictionary(chunk.type):
        chunk = chunk.dictionary_encode()
    order = pc.sort_indices(chunk.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    raw = chunk.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    code = np.where(raw < 0, np.int32(-1), rank[raw] if len(rank) else np.int32(-1)).astype(np.int32)
    return code, chunk.dictionary.take(order)


def sorted_by(columns):
    """The order of rows by columns of numbers from -1 on (rows that tie in any order):
    one sort where the columns fit into one number."""
    import numpy as np

    sizes = [int(c.max()) + 2 if len(c) else 1 for c in columns]
    if math.prod(sizes) >= 2 ** 62:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.int64)
    for c, size in zip(columns, sizes, strict=True):
        key *= size
        key += c
        key += 1
    return np.argsort(key)


def _coded(code, dictionary):
    import pyarrow as pa

    return pa.DictionaryArray.from_arrays(pa.array(code, mask=code < 0), dictionary)


def blocks(columns: dict, at):
    """Batches of SCHEMA: a block for every bucket of ``at``, its rows in the order given.
    A column is (codes, dictionary) or plain numbers."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(at, kind="stable")
    at = at[order]
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.array([], int)
    opts = pa.ipc.IpcWriteOptions(compression="zstd")
    for a, z in zip(cuts, np.r_[cuts[1:], len(at)].astype(int), strict=True):
        rows, arrays = order[a:z], []
        for c in columns.values():
            if isinstance(c, tuple):
                used, own = np.unique(c[0][rows], return_inverse=True)
                own = own.astype(np.int32) - (len(used) > 0 and used[0] < 0)
                arrays.append(_coded(own, c[1].take(pa.array(used[used >= 0]))))
            else:
                arrays.append(pa.array(c[rows]))
        batch = pa.RecordBatch.from_arrays(arrays, names=list(columns))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=opts) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([at[a]], pa.int32()), pa.array([z - a], pa.int64()),
                                          pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_b", "n", "block"])


def read_block(block):
    """The rows of a block: an Arrow batch."""
    import pyarrow as pa

    return pa.ipc.open_stream(block.as_buffer()).read_next_batch()


def pack_rows(coded: Sequence[str], order: Sequence[str], down: Sequence[str] = ()) -> Callable:
    """A mapInArrow function over rows with their bucket in ``_b``: blocks with the columns
    ``coded`` as dictionaries and rows sorted by ``order`` (those in ``down`` falling)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            columns = {c: codes(table.column(c)) if c in coded else table.column(c).to_numpy() for c in table.column_names if c != "_b"}
            keys = [columns[c][0] if c in coded else columns[c] for c in order]
            by = np.lexsort([-k if c in down else k for c, k in zip(order, keys, strict=True)][::-1])
            at = table.column("_b").to_numpy()[by]
            yield from blocks({c: (v[0][by], v[1]) if c in coded else v[by] for c, v in columns.items()}, at)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACK_ROWS:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()
    return run


def per_bucket(blocks_: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(table)``, an Arrow table, for the rows of every bucket together; dictionary
    columns of one table have one dictionary each."""
    def run(batches):
        import pyarrow as pa

        def done(held):
            out = work(pa.Table.from_batches(held).unify_dictionaries().combine_chunks())
            for b in out.to_batches(max_chunksize=OUT_ROWS):
                yield pa.RecordBatch.from_arrays([c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in b.columns], names=b.schema.names)

        held, at = [], None
        for batch in batches:
            for b, block in zip(batch.column("_b").to_pylist(), batch.column("block"), strict=True):
                if held and b != at:
                    yield from done(held)
                    held = []
                at = b
                held.append(read_block(block))
        if held:
            yield from done(held)
    return blocks_.repartition("_b").sortWithinPartitions("_b").select("_b", "block").mapInArrow(run, schema)


def rows_of(blocks_: DataFrame, schema: str) -> DataFrame:
    """The rows of all blocks, as they were packed."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block in batch.column(0):
                b = read_block(block)
                for at in range(0, b.num_rows, OUT_ROWS):
                    few = b.slice(at, OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in few.columns], names=few.schema.names)
    return blocks_.select("block").mapInArrow(run, schema)


def pair_counts(docs: DataFrame, part: Sequence[str], tokens: str, pair_rows: int = PAIR_ROWS, pair_tokens: int = PAIR_TOKENS) -> DataFrame:
    """(part, prev, next, cnt, ctx_cnt) of the neighbours in token arrays: tasks count the
    pairs they see and send the counts packed by ``prev``, whose bucket adds them up and
    so also knows how often it is followed by anything (``ctx_cnt``)."""
    part, n, kinds = list(part), buckets(docs.sparkSession), dict(docs.dtypes)
    keys = [*part, "prev", "next"]

    def summed(columns, cnt):
        """Distinct rows of codes, sorted, and what their counts add up to."""
        import numpy as np

        by = sorted_by(columns)
        columns, cnt = [c[by] for c in columns], cnt[by]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)] if len(cnt) else np.array([], bool)
        at = np.flatnonzero(new)
        return [c[at] for c in columns], np.add.reduceat(cnt, at) if len(at) else cnt

    def slices(batch):
        import numpy as np

        ends = batch.column(len(part)).offsets.to_numpy()
        cuts = np.flatnonzero(np.diff((ends - ends[0]) // pair_tokens)).tolist()
        for a, z in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, z - a)

    def pairs(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = batch.column(len(part))
        flat, of = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
        at = np.flatnonzero(of[1:] == of[:-1])
        raw = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        columns, dictionaries = [], []
        for i in range(len(part)):
            d = batch.column(i).dictionary_encode()
            columns.append(d.indices.fill_null(-1).to_numpy(zero_copy_only=False)[of[at]])
            dictionaries.append(d.dictionary)
        size = len(flat.dictionary) + 1
        pair = (raw[at].astype(np.int64) + 1) * size + raw[at + 1] + 1
        by = sorted_by([*columns, pair])
        pair, columns = pair[by], [c[by] for c in columns]
        new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in (pair, *columns)], axis=0)]) if len(pair) else np.array([], int)
        pair, columns = pair[new], [c[new].astype(np.int32) for c in columns]
        columns += [(pair // size - 1).astype(np.int32), (pair % size - 1).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*(_coded(c, d) for c, d in zip(columns, [*dictionaries, flat.dictionary, flat.dictionary], strict=True)),
                                           pa.array(np.diff(np.r_[new, len(by)]))], names=[*keys, "cnt"])

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def together(held):
            table = pa.Table.from_batches(held).unify_dictionaries()
            held.clear()
            coded, cnt = [codes(table.column(k)) for k in keys], table.column("cnt").to_numpy()
            del table
            columns, cnt = summed([c for c, _ in coded], cnt)
            return [(c, d) for c, (_, d) in zip(columns, coded, strict=True)], cnt

        def sent(columns, cnt):
            code, words = columns[-2]
            words = words.cast(pa.string()).cast(pa.binary())
            of = np.empty(len(words) + 1, np.int32)
            for at in range(0, len(words), OUT_ROWS):
                few = words.slice(at, OUT_ROWS)
                of[at:at + len(few)] = np.fromiter((zlib.crc32(w) % n for w in few.to_pylist()), np.int32, len(few))
            of[-1] = 0                                              # of null, -1
            return blocks({**dict(zip(keys, columns, strict=True)), "cnt": cnt}, of[code])

        held, size = [], 0
        for few in (few for batch in batches for few in slices(batch)):
            found = pairs(few)
            if found.num_rows:
                held.append(found)
                size += found.num_rows
            if size >= pair_rows:
                columns, cnt = together(held)
                held, size = [], 0
                if len(cnt) > pair_rows // 2:
                    yield from sent(columns, cnt)
                    del columns, cnt
                    pa.default_memory_pool().release_unused()
                else:
                    held, size = [pa.RecordBatch.from_arrays([*(_coded(*c) for c in columns), pa.array(cnt)], names=[*keys, "cnt"])], len(cnt)
        if held:
            yield from sent(*together(held))

    def merged(table):
        import numpy as np
        import pyarrow as pa

        coded = [codes(table.column(k)) for k in keys]
        columns, cnt = summed([c for c, _ in coded], table.column("cnt").to_numpy())
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)]
        total = np.add.reduceat(cnt, np.flatnonzero(new))[np.cumsum(new) - 1]
        return pa.table([*(_coded(c, d) for c, (_, d) in zip(columns, coded, strict=True)), pa.array(cnt), pa.array(total)], names=[*keys, "cnt", "ctx_cnt"])

    word = kinds[tokens].removeprefix("array<").removesuffix(">")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in part), f"prev {word}", f"next {word}", "cnt long", "ctx_cnt long"])
    return per_bucket(docs.select(*part, tokens).mapInArrow(count, SCHEMA), merged, schema)
