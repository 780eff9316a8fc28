"""Packing documents into fixed windows by non-negative least squares.

A document's ids (then one end id) are cut into whole windows, one piece of whole
units (``window / units`` ids each) and a tail shorter than a unit. The histogram
of piece sizes in units has ``units`` entries whatever the input, so the driver
solves for it: all shallow combinations of sizes that fill a window exactly are
the columns of a non-negative least squares problem whose solution says how often
to use each; rounded down, the counts become slots that pieces take by rank. What
is left over (rounding, sizes in surplus, tails) is packed greedily end to end,
cut at window borders; the last, partial window of each input partition is cut at
powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bpe_encoder, saved, slices, vocabulary_path

WINDOW, UNITS, DEPTH = 2048, 64, 4
BROADCAST_ROWS = 500_000             # rows of two ints and a long
_PIECES = ("doc_id long, doc_tokens long, start long, length long, bucket int, part int, rank long, ids binary")


def window_combinations(units: int = UNITS, depth: int = DEPTH) -> np.ndarray:
    """(n, units + 1) counts: how often each size 1..units occurs in each
    combination of at most ``depth`` sizes that sum to ``units``."""
    found: list[tuple] = []

    def extend(chosen: tuple, rest: int, most: int) -> None:
        if not rest:
            found.append(chosen)
        elif len(chosen) < depth:
            for size in range(min(rest, most), 0, -1):
                if size * (depth - len(chosen)) < rest:
                    break
                extend((*chosen, size), rest - size, size)

    extend((), units, units)
    counts = np.zeros((len(found), units + 1), np.int64)
    for row, sizes in enumerate(found):
        for s in sizes:
            counts[row, s] += 1
    return counts


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by the active-set method: columns enter by the
    steepest gradient and leave where the unconstrained step would turn negative."""
    x = np.zeros(a.shape[1])
    passive = np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[1] + 10):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        enters = int(np.argmax(gradient))
        if gradient[enters] <= tolerance:
            break
        passive[enters] = True
        while True:
            step = np.zeros_like(x)
            step[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if step[passive].min() > 0:
                x = step
                break
            falling = passive & (step <= 0)
            share = np.min(x[falling] / np.maximum(x[falling] - step[falling], 1e-300))
            x = x + share * (step - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def solve_repeats(histogram: np.ndarray, units: int = UNITS, depth: int = DEPTH) -> list[tuple[np.ndarray, int]]:
    """(combination, repeats) with repeats > 0 that never use more pieces of a
    size than the histogram has. Rows are weighted by size: a token counts alike
    wherever it lies."""
    combos = window_combinations(units, depth)
    weight = np.arange(units + 1, dtype=float)
    scale = max(1.0, float(histogram.max(initial=0)))
    x = non_negative_least_squares((combos * weight).T, histogram * weight / scale) * scale
    left, chosen = histogram.astype(np.int64).copy(), []
    left[0] = 0
    for row in np.argsort(-x, kind="stable"):
        if x[row] <= 0:
            break
        need = combos[row]
        times = min(int(x[row] + 1e-6), int(np.min(left[need > 0] // need[need > 0])))
        if times > 0:
            left -= times * need
            chosen.append((need, times))
    return chosen


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, units: int = UNITS) -> DataFrame:
    """One row per piece of every document (null text: empty), with its ids as
    little-endian unsigned 32-bit integers. ``rank`` counts the pieces of a size
    within the task ``part`` that cut them. Repeated rows are packed each."""
    unit = window // units

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = bpe_encoder(vocabulary), TaskContext.get().partitionId()
        ranks, end = [0] * (units + 1), end_id.to_bytes(4, "little")
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode_bytes(text or "") + end
                n = len(ids) // 4
                full = n // window * window
                whole = n // unit * unit
                spans = [(at, window, units) for at in range(0, full, window)]
                if whole > full:
                    spans.append((full, whole - full, (whole - full) // unit))
                if n > whole:
                    spans.append((whole, n - whole, 0))
                for at, length, bucket in spans:
                    for col, value in zip(cols, (doc, n, at, length, bucket, part, ranks[bucket], ids[4 * at:4 * (at + length)]), strict=True):
                        col.append(value)
                    ranks[bucket] += 1
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "doc_tokens", "start", "length", "bucket", "part", "rank", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def assign_sequences(pieces: DataFrame, window: int = WINDOW, units: int = UNITS, depth: int = DEPTH) -> DataFrame:
    """Pieces (as ``cut_documents`` makes them, read from a table) with the
    sequence and offset each lies at; pieces of the greedy rest may be cut again.

    The histogram (``units + 1`` rows) and the solution (at most ``depth`` slots
    for each of ``units`` combinations) are all that the driver sees or sends.
    """
    spark = pieces.sparkSession
    sizes = saved(pieces.groupBy("part", "bucket").agg(F.count("*").alias("n")), "sizes")
    histogram = np.zeros(units + 1, np.int64)
    for r in sizes.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        histogram[r.bucket] = r.n
    slots, first = [], [0] * (units + 1)
    sequences = 0
    for need, times in solve_repeats(histogram, units, depth):
        offset = 0
        for size in np.flatnonzero(need)[::-1].tolist():
            for _ in range(int(need[size])):
                slots.append((size, first[size], first[size] + times, sequences, offset))
                first[size] += times
                offset += size * (window // units)
        sequences += times
    by_part = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "bucket", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("base"))
    if sizes.count() <= BROADCAST_ROWS:                 # else a shuffle join; the rows are the same
        bases = F.broadcast(bases)
    table = spark.createDataFrame(slots, "s_bucket int, s_from long, s_to long, s_sequence long, s_offset long")
    at = F.col("rank") + F.col("base")
    placed = (pieces.join(bases, ["part", "bucket"])
              .join(F.broadcast(table), (F.col("bucket") == F.col("s_bucket")) & (at >= F.col("s_from")) & (at < F.col("s_to")), "left"))
    out = ["doc_id", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"]
    solved = (placed.filter("s_from is not null")
              .withColumn("sequence_id", F.col("s_sequence") + at - F.col("s_from"))
              .withColumn("offset", F.col("s_offset")).select(*out))
    rest = placed.filter("s_from is null")
    return solved.unionByName(_greedy(rest, sequences, window).select(*out))


def _greedy(rest: DataFrame, sequences: int, window: int) -> DataFrame:
    """Lay the pieces of each part end to end and cut them at the borders: every
    ``window`` ids, then at the falling powers of two that sum to the last rest."""
    order = Window.partitionBy("part").orderBy(F.desc("bucket"), "rank")
    laid = rest.withColumn("e", F.sum("length").over(order)).withColumn("total", F.sum("length").over(Window.partitionBy("part")))
    laid = laid.withColumn("s", F.col("e") - F.col("length")).withColumn("whole", F.col("total") - F.col("total") % window)
    top = window.bit_length() - 2
    laid = laid.withColumn("borders", F.expr(
        f"array_distinct(filter(transform(sequence({top}, 0, -1), i -> whole + shiftleft(shiftright(total - whole, i), i)), x -> x > whole))"))
    # a piece is shorter than a window: at most one multiple lies inside it
    laid = laid.withColumn("cuts", F.expr(
        f"array_sort(array_distinct(concat(array(s, e), filter(borders, x -> x > s and x < e), "
        f"filter(array((s div {window} + 1) * {window}), x -> x < e and x <= whole))))"))
    laid = laid.withColumn("piece", F.explode(F.expr("transform(sequence(0, size(cuts) - 2), i -> struct(cuts[i] as a, cuts[i + 1] as b))")))
    a, b = F.col("piece.a"), F.col("piece.b")
    begins = F.when(a < F.col("whole"), a - a % window).otherwise(
        F.greatest("whole", F.coalesce(F.array_max(F.filter("borders", lambda x: x <= a)), F.col("whole"))))
    number = F.when(a < F.col("whole"), F.expr(f"piece.a div {window}")).otherwise(
        F.expr(f"whole div {window}") + F.size(F.filter("borders", lambda x: x <= a)))
    return (laid.withColumn("sequence_id", F.lit(sequences) + F.col("part").cast("long") * F.lit(1 << 32) + number)
            .withColumn("offset", a - begins)
            .withColumn("ids", F.expr("substring(ids, cast(4 * (piece.a - s) + 1 as int), cast(4 * (piece.b - piece.a) as int))"))
            .withColumn("start", F.col("start") + a - F.col("s")).withColumn("length", b - a))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW,
                   units: int = UNITS, depth: int = DEPTH) -> DataFrame:
    """Pack every document into sequences of at most ``window`` ids.

    Input: ``doc_id, text``; other columns are not read. Null or empty text is a
    document of the end id alone; a null ``doc_id`` stays null; repeated rows are
    packed each; an empty table gives no rows. Output, one row per piece:
    ``doc_id, doc_tokens, start, length, ids, sequence_id, offset``; the ids of a
    document lie in exactly one piece each, sequences have no gaps, and a
    sequence is ``window`` ids or a power of two long.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    return assign_sequences(saved(cut_documents(docs, vocabulary, end_id, window, units), "pieces"), window, units, depth)
