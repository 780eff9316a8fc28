"""Corpus jobs: split, tokenize, global token stream, windows and segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_labels, tokenize_ws  # noqa: F401  (re-exported)
from .scan import positions, running_sums
from .sizing import broadcast_if_small, small_table


def corpus_split(df: DataFrame, key: str = "doc_id", train_pct: int = 80, out: str = "split") -> DataFrame:
    """Deterministic train / eval split of ``train_pct`` percent: by the last two
    digits of an integer key, the last one first, so that tens of percent go by
    ``key % 10`` (never ``randomSplit``, so reruns and lost executors agree)."""
    k = F.col(key)
    if dict(df.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        k = F.xxhash64(k)
    last_two = F.pmod(k, F.lit(100))
    digits = last_two % 10 * 10 + F.floor(last_two / 10)
    return df.withColumn(out, F.when(digits < train_pct, F.lit("train"))
                         .otherwise(F.lit("eval")))


def tokenize(df: DataFrame, text: str = "text", out: str = "tokens",
             tokenizer: Callable | None = None) -> DataFrame:
    """Text -> token array. Default: lower-case whitespace split (JVM-side).

    ``tokenizer`` may be a ``pandas_udf`` returning ``array<string>`` (e.g. a
    subword tokenizer loaded once per executor); it is then applied instead.
    """
    if tokenizer is None:
        return df.withColumn(out, tokenize_ws(text))
    return df.withColumn(out, tokenizer(F.col(text)))


def token_stream(docs: DataFrame, part=("dataset", "split"), order: str = "doc_id",
                 tokens: str = "tokens") -> DataFrame:
    """Each (dataset, split) corpus as one ordered stream of tokens.

    Documents follow each other in ``order`` (ids of any kind, however spread); ``pos``
    is the token's global position in its stream. Offsets are running sums of
    per-document token counts over ranges of the order. Null tokens count as none.
    Output: part..., doc_id, idx, pos, token.
    """
    part = list(part)
    counted = docs.select(*part, order, tokens).withColumn("_n", F.coalesce(F.greatest(F.size(tokens), F.lit(0)), F.lit(0)).cast("bigint"))
    with_off = running_sums(counted, part, [order], {"_off": "_n"}, inclusive=False)
    return (with_off.select(*part, order, "_off", F.posexplode(tokens).alias("idx", "token"))
            .withColumn("pos", F.col("_off") + F.col("idx"))
            .drop("_off"))


def eval_segments(stream: DataFrame, L: int, part=("dataset",)) -> DataFrame:
    """Non-overlapping length-L segments ``seg = pos div L``; the tail is dropped.

    Positions are contiguous from 0, so a segment is whole exactly when it holds
    L tokens: a count over the (dataset, seg) window (at most L rows each, the
    same partitioning the shifted targets use) — no global size join."""
    part = list(part)
    w = Window.partitionBy(*part, "seg")
    return (stream.withColumn("seg", F.floor(F.col("pos") / L))
            .withColumn("_n", F.count(F.lit(1)).over(w))
            .filter(F.col("_n") == L).drop("_n"))


def md5_int(*parts) -> Column:
    """A 48-bit integer from md5 of the parts joined by ':' (seeded uniforms)."""
    key = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(12)), 16, 10).cast("bigint")


def sample_windows(stream: DataFrame, nsamples: int, L: int, seed: int = 0,
                   part=("dataset",)) -> DataFrame:
    """``nsamples`` windows of L tokens per stream at offsets in [0, N-L-1]
    (inclusive, with replacement), ``offset = md5int(seed, k) mod (N - L)``.

    A range join done as an equi-join: the stream is keyed by ``pos div L``;
    each window touches at most two such blocks, so it is exploded to two
    block keys and the exact range is filtered after the join. The window
    table has 2·nsamples rows per stream and is broadcast after a row-count
    check (so the stream is not shuffled). Output: part..., sample_id, start, idx, pos, token.
    """
    part = list(part)
    sizes = small_table(stream.groupBy(*part).agg(F.count(F.lit(1)).alias("_N")))
    wins = (sizes.filter(F.col("_N") > L)
            .withColumn("sample_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nsamples - 1).cast("bigint"))))
            .withColumn("start", F.pmod(md5_int(seed, F.col("sample_id")), F.col("_N") - L))
            .withColumn("blk", F.explode(F.array(F.floor(F.col("start") / L), F.floor(F.col("start") / L) + 1)))
            .drop("_N"))
    keyed = stream.withColumn("blk", F.floor(F.col("pos") / L))
    joined = keyed.join(broadcast_if_small(wins), on=part + ["blk"])
    return (joined.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + L))
            .withColumn("idx", (F.col("pos") - F.col("start")).cast("int"))
            .select(*part, "sample_id", "start", "idx", "pos", "token"))


def sample_doc_windows(docs: DataFrame, nsamples: int, L: int, seed: int = 0,
                       part=("dataset",), key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Draw documents uniformly with replacement among those with more than L
    tokens, then a window of L tokens inside each at an offset in [0, n-L-1].

    Eligible documents are ranked by key over ranges (no global window); the pick for sample k is rank ``md5int(seed,'d',k) mod count``.
    Output: part..., sample_id, doc_id, start, tokens (array of L).
    """
    part = list(part)
    elig = (docs.select(*part, key, F.size(tokens).alias("_n"))
            .filter(F.col("_n") > L))
    ranked = positions(elig, part, [key], "_rank")
    counts = small_table(elig.groupBy(*part).agg(F.count(F.lit(1)).alias("_cnt")))
    picks = (counts.withColumn("sample_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nsamples - 1).cast("bigint"))))
             .withColumn("_rank", F.pmod(md5_int(seed, "d", F.col("sample_id")), F.col("_cnt")))
             .drop("_cnt"))
    chosen = ranked.join(broadcast_if_small(picks), on=part + ["_rank"])
    chosen = chosen.withColumn("start", F.pmod(md5_int(seed, "o", F.col("sample_id")), F.col("_n") - L))
    body = docs.select(*part, key, tokens)
    out = chosen.join(body, on=part + [key])
    return out.select(*part, "sample_id", key, "start",
                      F.slice(tokens, F.col("start").cast("int") + 1, L).alias("tokens"))


def pack_windows(windows: DataFrame, L: int, part=("dataset",)) -> DataFrame:
    """Concatenate windows into one stream: ``pos = sample_id * L + idx``."""
    part = list(part)
    return (windows.select(*part, "sample_id", F.posexplode("tokens").alias("idx", "token"))
            .withColumn("pos", F.col("sample_id").cast("bigint") * L + F.col("idx"))
            .select(*part, "pos", "token"))


def vocab(tokens: DataFrame, token: str = "token") -> DataFrame:
    """token -> count -> id, ids by (count desc, token).

    Counts are a partial aggregation. Ids are places in ranges of the order itself, so
    neither a huge group of rare tokens nor one of a common prefix meets in a task.
    """
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("cnt"))
    return positions(counts, [], [F.col("cnt").desc(), F.col(token).asc()], "id").select(token, "cnt", "id")
