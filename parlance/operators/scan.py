"""Running sums over a range-partitioned order.

Splitters sampled from the order itself cut the rows into ranges of even size
(``repartitionByRange``), every range is sorted and scanned once with the sums
carried from batch to batch, and the sorted rows are written with their local
sums. One row per range (its first and last key and what it sums to) then gives
each range its carry-in, joined by range number. No bucket width is guessed and no
task sees more than a range, however the ids or prefixes of the order are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

SHORT_GROUP = 32        # rows of a group up to which groups are added up side by side
_PART, _ROW, _OPEN = "_range", "_row", "_open"


def _changes(batch, keys: list[int]):
    """Where a row's key differs from that of the row before it (not the first row's)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    out = np.zeros(max(0, n - 1), bool)
    for k in keys:
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, n - 1)
        other = pc.fill_null(pc.not_equal(a, b), False)
        out |= np.asarray(pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False), bool)
    return out


def _sums_by_group(x, starts, ends, carry):
    """Sums up to each row and before it within the groups [start, end), the first group's
    on top of ``carry``. Short groups are added up side by side, row after row in each."""
    import numpy as np

    total = x.copy()
    size = ends - starts
    short = starts[size <= SHORT_GROUP]
    long = size[size <= SHORT_GROUP]
    for k in range(1, SHORT_GROUP):
        short, long = short[long > k], long[long > k]
        if not len(short):
            break
        total[short + k] += total[short + k - 1]
    for g in np.flatnonzero(size > SHORT_GROUP):
        np.cumsum(x[starts[g]:ends[g]], out=total[starts[g]:ends[g]])
    total[:ends[0]] += np.asarray(carry, x.dtype)
    before = np.empty_like(total)
    before[1:] = total[:-1]
    before[starts] = 0
    before[0] = carry
    return total, before


def _scan(keys: list[int], values: list[int], inclusive: bool):
    """A mapInArrow function: local running sums, the row's number in its range, and
    whether its key is the one that its range begins with."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        carry, last, opening, at = None, None, True, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            cuts = np.flatnonzero(_changes(batch, keys)) + 1
            if last is not None and first != last:
                carry, opening = None, False
            starts, ends = np.r_[0, cuts], np.r_[cuts, n]
            carry = carry or [0] * len(values)
            sums = []
            for i, v in enumerate(values):
                x = batch.column(v).to_numpy(zero_copy_only=False)
                total, before = _sums_by_group(x, starts, ends, carry[i])
                sums.append(total if inclusive else before)
                carry[i] = total[-1].item()
            opened = np.zeros(n, bool)
            if opening:
                opened[:ends[0]] = True
                opening = len(ends) == 1
            last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            arrays = [*batch.columns, *(pa.array(s) for s in sums), pa.array(np.arange(at, at + n)), pa.array(opened)]
            at += n
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *(f"_s{i}" for i in range(len(values))), _ROW, _OPEN])

    return run


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, str],
                 inclusive: bool = True) -> DataFrame:
    """``df`` with a column for every ``out: value`` of ``sums``: the sum of the numeric
    column ``value`` over the rows of the same ``keys`` up to this one in ``order``
    (before it, unless ``inclusive``).

    Whole-number columns are summed as long, others as double; null values count as
    zero; null keys are a key of their own. Rows that tie in ``order`` stay in one
    range, so an order that many rows may share should end in something that tells
    them apart. An empty table gives no rows.
    """
    keys, outs = list(keys), list(sums)
    spark, kinds = df.sparkSession, dict(df.dtypes)
    whole = {o: kinds[v] in ("tinyint", "smallint", "int", "bigint") for o, v in sums.items()}
    typed = df.withColumns({f"_v{i}": F.coalesce(F.col(sums[o]).cast("long" if whole[o] else "double"), F.lit(0)) for i, o in enumerate(outs)})
    by = [F.col(k).asc() for k in keys] + [c if isinstance(c, Column) else F.col(c).asc() for c in order]
    ranged = typed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_PART, F.spark_partition_id())
    names = ranged.columns
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in ranged.schema.fields]
                          + [T.StructField(f"_s{i}", T.LongType() if whole[o] else T.DoubleType()) for i, o in enumerate(outs)]
                          + [T.StructField(_ROW, T.LongType()), T.StructField(_OPEN, T.BooleanType())])
    path = scratch_path(spark, "scan")
    scan = _scan([names.index(k) for k in keys], [names.index(f"_v{i}") for i in range(len(outs))], inclusive)
    ranged.mapInArrow(scan, schema).write.option("compression", "zstd").parquet(path)
    local = spark.read.schema(schema).parquet(path)

    key = F.struct(*keys) if keys else F.lit(0)
    total = F.struct(*[F.col(f"_s{i}") if inclusive else F.col(f"_s{i}") + F.col(f"_v{i}") for i in range(len(outs))])
    ends = (local.groupBy(_PART).agg(F.min_by(key, _ROW).alias("first"), F.max_by(key, _ROW).alias("last"), F.max_by(total, _ROW).alias("sums"))
            .orderBy(_PART).collect())                       # a row per range
    carries, held, zero = [], None, tuple(0 if whole[o] else 0.0 for o in outs)
    for r in ends:
        carry = held[1] if held and held[0] == r["first"] else zero
        carries.append((r[_PART], *carry))
        held = (r["last"], tuple(c + s for c, s in zip(carry, r["sums"], strict=True)) if r["first"] == r["last"] else tuple(r["sums"]))
    kind = T.StructType([T.StructField(_PART, T.IntegerType())] + [T.StructField(f"_c{i}", T.LongType() if whole[o] else T.DoubleType()) for i, o in enumerate(outs)])
    joined = local.join(F.broadcast(spark.createDataFrame(carries, kind)), _PART)
    carried = {o: F.col(f"_s{i}") + F.when(F.col(_OPEN), F.col(f"_c{i}")).otherwise(F.lit(0)) for i, o in enumerate(outs)}
    return joined.withColumns(carried).select(*[c for c in df.columns if c not in outs], *outs)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """``df`` with each row's 0-based place among the rows of its ``keys`` in ``order``."""
    return running_sums(df.withColumn("_one", F.lit(1)), keys, order, {out: "_one"}, inclusive=False).drop("_one")
