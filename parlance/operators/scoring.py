"""Language-model scoring, next-token tables, generation and latency jobs."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import drop_end_marker, ends_with_any, trim_stop
from ..session import checkpointed, stored
from .packed import SCHEMA, bucket, buckets, codes, pack_rows, pair_counts, per_bucket, read_block, rows_of
from .scan import _sums_by_group, running_sums
from .sizing import broadcast_if_small

NANO = 1_000_000_000  # nll is summed as integer nano-nats: exact and order-free


def shift_labels(segments: DataFrame, part=("dataset", "seg"), order: str = "pos",
                 token: str = "token", out: str = "target") -> DataFrame:
    """Next-token target inside a segment; the last position has none.

    Partitioned by segment, so every window holds at most L rows."""
    w = Window.partitionBy(*part).orderBy(order)
    return segments.withColumn(out, F.lead(token).over(w))


def doc_bigrams(docs: DataFrame, part=("dataset",), tokens: str = "tokens") -> DataFrame:
    """(prev, next) pairs inside each document, from its token array (no join)."""
    t = F.col(tokens)
    pairs = F.arrays_zip(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
                         F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))))
    return (docs.select(*part, F.explode(pairs).alias("_p"))
            .select(*part, F.col("_p.0").alias("prev"), F.col("_p.1").alias("next")))


def bigram_model(train_docs: DataFrame, part=("dataset",), tokens: str = "tokens", totals: bool = False):
    """Counts for an interpolated bigram model: (unigrams, bigrams, contexts, stats).

    unigrams: part, token, cnt; bigrams: part, prev, next, cnt;
    contexts: part, prev, ctx_cnt; stats: part, total (tokens), v (distinct
    tokens). All are partial (map-side combined) aggregations. A token is a context
    wherever it does not end its document, so one pass over the tokens, written once,
    counts unigrams and contexts, and the bigrams are counted for ``big`` alone. With
    ``totals`` they travel packed by ``prev`` and have its count beside them, ``ctx_cnt``,
    so that ``candidates`` needs no join.
    """
    part = list(part)
    seen = (train_docs.select(*part, F.size(tokens).alias("_n"), F.posexplode(tokens).alias("_i", "token"))
            .groupBy(*part, "token").agg(F.count(F.lit(1)).alias("cnt"), F.count(F.when(F.col("_i") < F.col("_n") - 1, 1)).alias("ctx_cnt")))
    seen = stored(seen, "unigrams")
    uni = seen.select(*part, "token", "cnt")
    big = (pair_counts(train_docs, part, tokens) if totals else
           doc_bigrams(train_docs, part, tokens).groupBy(*part, "prev", "next").agg(F.count(F.lit(1)).alias("cnt")))
    ctx = seen.filter(F.col("ctx_cnt") > 0).select(*part, F.col("token").alias("prev"), "ctx_cnt")
    stats = uni.groupBy(*part).agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("v"))
    return uni, big, ctx, stats


def ngram_nll(targets: DataFrame, train_docs: DataFrame, lam: float = 0.7, part=("dataset",),
              tokens: str = "tokens") -> DataFrame:
    """Score (token -> target) rows with an interpolated bigram model counted on
    ``train_docs``: ``p = lam * c(a,b)/c(a,.) + (1-lam) * (c(b)+1)/(T+V+1)``;
    contexts never seen fall back to the add-one unigram alone.

    Adds ``nll`` (double) and ``nll_n`` = floor(nll * 1e9) as bigint. The
    count tables are joined by key; AQE broadcasts the ones that turn out
    small and splits skewed probe keys.
    """
    part = list(part)
    uni, big, ctx, stats = bigram_model(train_docs, part, tokens)
    mu = round(1.0 - lam, 12)
    t = targets.filter(F.col("target").isNotNull())
    j = (t.join(big.select(*part, F.col("prev").alias("token"), F.col("next").alias("target"),
                           F.col("cnt").alias("c_ab")), on=part + ["token", "target"], how="left")
          .join(ctx.select(*part, F.col("prev").alias("token"), F.col("ctx_cnt").alias("c_a")),
                on=part + ["token"], how="left")
          .join(uni.select(*part, F.col("token").alias("target"), F.col("cnt").alias("c_b")),
                on=part + ["target"], how="left")
          .join(stats, on=part, how="left"))   # one row per dataset: AQE broadcasts it at runtime
    p_uni = (F.coalesce(F.col("c_b"), F.lit(0)) + 1).cast("double") / (F.col("total") + F.col("v") + 1).cast("double")
    p_bi = F.coalesce(F.col("c_ab"), F.lit(0)).cast("double") / F.col("c_a").cast("double")
    p = F.when(F.col("c_a").isNull(), p_uni).otherwise(F.lit(lam) * p_bi + F.lit(mu) * p_uni)
    return (j.withColumn("nll", -F.log(p))
            .withColumn("nll_n", F.floor(F.col("nll") * NANO).cast("bigint"))
            .drop("c_ab", "c_a", "c_b", "total", "v"))


def perplexity(nll: DataFrame, L: int, part=("dataset",), seg: str = "seg") -> DataFrame:
    """Per segment loss = mean nll over its L-1 targets; ppl = exp(sum(loss*L)/(n*L)).

    Every segment has exactly L-1 targets, so this is exp(total / (n*(L-1))),
    summed exactly in integer nano-nats.
    """
    part = list(part)
    per_seg = nll.groupBy(*part, seg).agg(F.sum("nll_n").alias("_s"))
    return (per_seg.groupBy(*part).agg(F.count(F.lit(1)).alias("n_segments"), F.sum("_s").alias("_t"))
            .withColumn("ppl", F.round(F.exp((F.col("_t").cast("double") / NANO) /
                                             (F.col("n_segments") * (L - 1)).cast("double")), 6))
            .drop("_t"))


def running_perplexity(nll: DataFrame, part=("dataset",), order: str = "pos") -> DataFrame:
    """exp(cumulative mean nll) up to each position, running sums over ranges of it."""
    part = list(part)
    s = running_sums(nll.withColumn("_one", F.lit(1)), part, [order], {"_cum": "nll_n", "_cnt": "_one"})
    return (s.withColumn("running_ppl", F.round(F.exp((F.col("_cum").cast("double") / NANO) /
                                                       F.col("_cnt").cast("double")), 6))
            .drop("_one", "_cum"))


def candidates(big: DataFrame, ctx: DataFrame, part=("dataset",)) -> DataFrame:
    """Next-token candidate table: part, ctx, token, cnt, total (per ctx)."""
    part = list(part)
    counted = big.dropna(subset=part + ["prev"]) if "ctx_cnt" in big.columns else big.join(ctx, on=part + ["prev"])
    return (counted
            .select(*part, F.col("prev").alias("ctx"), F.col("next").alias("token"), "cnt",
                    F.col("ctx_cnt").alias("total")))


def top_p_filter(cands: DataFrame, top_p: float, part=("dataset",)) -> DataFrame:
    """Smallest most-probable set reaching top_p: keep a candidate while the
    count mass strictly before it (order: count desc, token) is < top_p·total.
    Integer counts make the cut exact. ``top_p >= 1`` keeps everything."""
    part = list(part) + ["ctx"]
    if top_p >= 1:
        return cands.withColumn("cum_prev", F.lit(None).cast("bigint"))
    c = running_sums(cands, part, [F.col("cnt").desc(), F.col("token").asc()], {"cum_prev": "cnt"}, inclusive=False)
    return c.filter(F.col("cum_prev") < F.lit(top_p) * F.col("total"))


def temperature_scale(cands: DataFrame, T: float, part=("dataset",)) -> DataFrame:
    """q = p^(1/T) renormalised per context, by a window over the keys that the candidates
    are joined by; rows without a key have no context."""
    part = list(part) + ["ctx"]
    c = cands.dropna(subset=part).withColumn("_w", F.pow(F.col("cnt").cast("double") / F.col("total").cast("double"), F.lit(1.0 / T)))
    return c.withColumn("q", F.col("_w") / F.sum("_w").over(Window.partitionBy(*part))).drop("_w")


def argmax_next(cands: DataFrame, part=()) -> DataFrame:
    """Greedy next token per context: highest count, ties by token."""
    part = list(part)
    return cands.groupBy(*part, "ctx").agg(
        F.min_by("token", F.struct((-F.col("cnt")).alias("n"), F.col("token").alias("t"))).alias("next"))


def successor_paths(nxt: DataFrame, fallback: Column, steps: int, domain: DataFrame | None = None) -> DataFrame:
    """For every token c, the greedy continuation path of ``steps`` tokens.

    The greedy step is a function of the last token only, so paths double:
    P_2k(c) = P_k(c) ++ P_k(last(P_k(c))). log2(steps) self-joins on a
    vocabulary-sized table instead of ``steps`` joins against every prompt.
    Tokens without a known successor continue with ``fallback``.
    Output: ctx, path (array<string>).
    """
    toks = nxt.select(F.col("ctx").alias("t")).union(nxt.select(F.col("next").alias("t")))
    if domain is not None:
        toks = toks.union(domain.select(F.col(domain.columns[0]).alias("t")))
    toks = toks.union(nxt.sparkSession.range(1).select(fallback.alias("t"))).distinct()
    # Each round reads the previous paths twice; checkpointing every round (to
    # the shared checkpoint folder) keeps each plan a two-scan join instead of
    # a tree that doubles with every round.
    paths = checkpointed(toks.join(nxt, toks.t == nxt.ctx, "left")
                         .select(F.col("t").alias("ctx"), F.array(F.coalesce(F.col("next"), fallback)).alias("path")))
    k = 1
    while k < steps:
        right = paths.select(F.col("ctx").alias("_c"), F.col("path").alias("_p"))
        paths = checkpointed(paths.join(right, F.element_at(paths.path, -1) == right._c, "inner")
                             .select("ctx", F.concat("path", "_p").alias("path")))
        k *= 2
    return paths.select("ctx", F.slice("path", 1, steps).alias("path"))


def batch_generate(prompts: DataFrame, nxt: DataFrame, fallback: Column, max_new: int,
                   stops: Sequence[Sequence[str]] = tuple([w] for w in K.STOP_WORDS),
                   tokens: str = "tokens") -> DataFrame:
    """Greedy generation: extend each prompt by ``max_new`` tokens, stopping at
    the first step where the sequence ends with a stop sequence; stop
    sequences are then trimmed and a trailing end marker dropped from the text.

    A next-token table under the broadcast bound (counted after it is
    checkpointed) is broadcast and each step is a hash join on the prompt
    table; a larger one goes through successor-path doubling.

    Adds ``generated`` (array<string>) and ``text``.
    """
    from .sizing import MAX_BROADCAST_ROWS
    nxt = checkpointed(nxt.select("ctx", "next"))
    if nxt.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        # next-token table under the broadcast bound: step every prompt with a
        # broadcast hash join per token (no shuffle at all)
        nb = F.broadcast(nxt.select(F.col("ctx").alias("_c"), F.col("next").alias("_nx")))
        j = (prompts.withColumn("_last", F.try_element_at(tokens, F.lit(-1)))
             .withColumn("path", F.when(F.col("_last").isNotNull(), F.array().cast("array<string>"))))
        for _ in range(max_new):
            j = j.join(nb, F.col("_last") == F.col("_c"), "left")
            step = F.when(F.col("_last").isNotNull(), F.coalesce(F.col("_nx"), fallback))
            j = (j.withColumn("path", F.concat("path", F.array(step)))
                 .withColumn("_last", step).drop("_c", "_nx"))
        j = j.withColumn("ctx", F.lit(None).cast("string"))
    else:
        paths = successor_paths(nxt, fallback, max_new,
                                domain=prompts.select(F.try_element_at(tokens, F.lit(-1)).alias("t")).filter(F.col("t").isNotNull()))
        j = prompts.withColumn("_last", F.try_element_at(tokens, F.lit(-1))).join(
            paths, F.col("_last") == paths.ctx, "left")
    gen = F.coalesce(F.col("path"), F.array().cast("array<string>"))
    maxlen = max(len(s) for s in stops)
    tail = F.slice(F.col(tokens), -maxlen, maxlen)

    def stopped(jj):
        seq = F.concat(F.when(F.size(F.col(tokens)) >= maxlen, tail).otherwise(F.col(tokens)), F.slice(gen, 1, jj))
        return ends_with_any(seq, stops)

    hits = F.transform(F.sequence(F.lit(1), F.lit(max_new)), stopped)
    first = F.array_position(hits, True)
    j = j.withColumn("_gen", gen).withColumn("_first", first)
    gen_cut = F.when(F.col("_first") > 0, F.slice("_gen", F.lit(1), F.col("_first").cast("int"))).otherwise(F.col("_gen"))
    out = j.withColumn("generated", trim_stop(gen_cut, stops)).drop("_last", "ctx", "path", "_gen", "_first")
    return out.withColumn("text", drop_end_marker(F.array_join(F.concat(F.col(tokens), F.col("generated")), " ")))


_PREDICTORS: dict = {}


def _cached_predictor(key: tuple[str, str], factory: Callable):
    if key not in _PREDICTORS:
        _PREDICTORS[key] = factory()
    return _PREDICTORS[key]


def batch_predict(df: DataFrame, predictor_factory: Callable, schema: str) -> DataFrame:
    """Run a user predictor over every partition; the predictor is built once
    per Python worker process (``predictor_factory()``) and then reused, as a
    model would be loaded once and kept. The predictor maps a pandas DataFrame
    batch to a pandas DataFrame with ``schema``. Workers tell factories apart by
    their pickled form, so closures over different settings do not mix."""
    key = (hashlib.sha256(cloudpickle.dumps(predictor_factory)).hexdigest(), getattr(predictor_factory, "__qualname__", ""))

    def run(batches):
        pred = _cached_predictor(key, predictor_factory)
        for pdf in batches:
            yield pred(pdf)
    return df.mapInPandas(run, schema)


def latency_summary(timings: DataFrame, run: str = "run", seconds: str = "seconds",
                    mem: str = "mem_mib") -> DataFrame:
    """Per run: steps, exact median (mean of the middle two), mean, max, peak memory.

    The median is a rank selection over the *distinct* (run, value) counts (a
    partial aggregation), positioned by running sums over ranges of the values, so
    neither a run's rows nor its values meet in one task and no bucket width has to
    suit them; the mean is an exact decimal sum."""
    counts = timings.groupBy(run, seconds).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(counts, [run], [seconds], {"_lo": "_c"}, inclusive=False)
    stats = broadcast_if_small(checkpointed(timings.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sum(F.col(seconds).cast("decimal(30,12)")).alias("_sum"),
        F.max(seconds).alias("max_s"),
        F.max(mem).alias("peak_mem"))))
    r_lo = F.floor((F.col("n_steps") - 1) / 2)
    r_hi = F.floor(F.col("n_steps") / 2)
    holds = lambda r: (F.col("_lo") <= r) & (r < F.col("_lo") + F.col("_c"))
    mid = (ranked.join(stats.select(run, "n_steps"), on=run)
           .filter(holds(r_lo) | holds(r_hi))
           .groupBy(run).agg(F.max(F.when(holds(r_lo), F.col(seconds))).alias("_a"),
                             F.max(F.when(holds(r_hi), F.col(seconds))).alias("_z")))
    return (stats.join(mid, on=run)
            .withColumn("median_s", (F.col("_a") + F.col("_z")) / 2)
            .withColumn("mean_s", F.round(F.col("_sum").cast("double") / F.col("n_steps").cast("double"), 6))
            .select(run, "n_steps", "median_s", "mean_s", "max_s", "peak_mem"))


MAX_PROBES = 500_000   # prompts that draw at once: what they ask for is broadcast at every step


def sampling_cdf(cands: DataFrame, top_p: float, T: float) -> DataFrame:
    """Per context, the cumulative distribution used for sampling.

    Weights are temperature-scaled ``(cnt/total)^(1/T)``; candidates in order
    (count desc, token) are kept while the scaled mass before them is below
    ``top_p`` of the context's scaled total (``top_p >= 1`` keeps all); each
    kept candidate owns ``[lo, lo + w)`` of ``[0, z)``. Rows travel once, packed by
    context, and a bucket of contexts is added up in one task.
    Output: ctx, token, lo, w, z."""
    def added(table):
        import numpy as np
        import pyarrow as pa

        code, token = codes(table.column("ctx"))[0], codes(table.column("token"))[0]
        table = table.take(np.lexsort([token, -table.column("cnt").to_numpy(), code]))
        code, w = codes(table.column("ctx"))[0], np.nan_to_num(table.column("w").to_numpy())
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[starts[1:], len(code)]
        total, lo = _sums_by_group(w, starts, ends, 0)
        size = ends - starts
        keep = lo < top_p * np.repeat(total[ends - 1], size) if top_p < 1 else np.ones(len(lo), bool)
        kept = np.add.reduceat(keep.astype(np.int64), starts)
        z = np.repeat(total[starts + np.maximum(kept, 1) - 1], size)
        out = pa.table([table.column("ctx"), table.column("token"), pa.array(lo), table.column("w"), pa.array(z)], names=["ctx", "token", "lo", "w", "z"])
        return out.filter(pa.array(keep))

    n = buckets(cands.sparkSession)
    w = F.pow(F.col("cnt").cast("double") / F.col("total").cast("double"), F.lit(1.0 / T))
    c = cands.filter(F.col("ctx").isNotNull()).select("ctx", "token", F.col("cnt").cast("long").alias("cnt"), w.alias("w"), bucket("ctx", n).alias("_b"))
    c = c.mapInArrow(pack_rows(["ctx", "token"], ["ctx", "cnt", "token"], down=["cnt"]), SCHEMA)
    return per_bucket(c, added, "ctx string, token string, lo double, w double, z double")


def sampling_table(cdf: DataFrame, n: int) -> DataFrame:
    """The distribution packed into blocks of the ``n`` buckets of its contexts, in which
    a draw is a search: sorted by (ctx, lo), a few bytes a candidate. Written once; a
    bucket may have several blocks.
    Output: _b, n (candidates), block."""
    c = cdf.filter(F.col("ctx").isNotNull()).select("ctx", "token", "lo", "z", bucket("ctx", n).alias("_b"))
    return stored(c.mapInArrow(pack_rows(["ctx", "token"], ["ctx", "lo"]), SCHEMA), "sampling")


def _draw(batches):
    """A mapInArrow function over (block, asked): for each asked (i, last, u) whose context is
    in the block, the last candidate that starts at or before ``u * z``: i, token, lo."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for block, asked in zip(batch.column(0), batch.column(1), strict=True):
            rows, asked = read_block(block), asked.values
            i, last, u = (asked.field(k) for k in ("i", "last", "u"))
            code = rows.column("ctx").indices.to_numpy()
            lo, z = rows.column("lo").to_numpy(), rows.column("z").to_numpy()
            at = pc.index_in(last, rows.column("ctx").dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
            here = np.flatnonzero(at >= 0)
            first, end = np.searchsorted(code, at[here], "left"), np.searchsorted(code, at[here], "right")
            x = u.to_numpy()[here] * z[first]
            found = np.array([a + np.searchsorted(lo[a:e], v, "right") - 1 for a, e, v in zip(first, end, x, strict=True)], np.int64)
            hit = found >= first
            found = found[hit]
            yield pa.RecordBatch.from_arrays([i.take(pa.array(here[hit])), rows.column("token").take(pa.array(found)).dictionary_decode(),
                                              pa.array(lo[found])], names=["_i", "token", "lo"])


def uniform(seed, *parts) -> Column:
    """Deterministic uniform in [0, 1) from md5(seed, parts...) (48 bits)."""
    from .corpus import md5_int
    return md5_int(seed, *parts).cast("double") / float(2 ** 48)


def batch_generate_sampled(prompts: DataFrame, cdf: DataFrame, fallback: Column, max_new: int, seed: int,
                           keys=("conv_id", "turn"), tokens: str = "tokens",
                           stops: Sequence[Sequence[str]] = tuple([w] for w in K.STOP_WORDS)) -> DataFrame:
    """Sampled generation: at step t each prompt draws ``u = uniform(seed, key, t)``
    and takes the candidate of its last token whose ``[lo, lo + w)`` holds
    ``u * z`` (the last candidate starting at or before it). Contexts never
    seen continue with ``fallback``.

    The distribution is written once, packed into buckets of contexts. Under the
    checked broadcast bound it is broadcast as sorted arrays and all steps run inside
    one ``mapInPandas`` pass over the Spark-partitioned prompts (a ``searchsorted``
    per draw). Beyond it, each step broadcasts what the prompts ask for, at most
    ``MAX_PROBES`` of them at a time, to the blocks of the packed table, which
    are never shuffled again: only the prompts' state is. Both paths
    pick the same tokens. Stop sequences are applied at the end as in greedy
    decoding."""
    keys, spark = list(keys), prompts.sparkSession
    from .sizing import MAX_BROADCAST_ROWS
    n = buckets(spark)
    table = sampling_table(cdf, n)
    if (table.agg(F.sum("n")).first()[0] or 0) <= MAX_BROADCAST_ROWS:
        small = rows_of(table, "ctx string, token string, lo double, z double")
        gen_df = _sample_in_tasks(prompts, small, fallback, max_new, seed, keys, tokens)
        return _finish_generation(_beside(prompts.select(*keys, tokens), gen_df, keys), tokens, stops)
    else_ = F.lit(spark.range(1).select(fallback.alias("f")).first()["f"])
    start = stored(prompts.select(F.monotonically_increasing_id().alias("_i"), *keys, F.try_element_at(tokens, F.lit(-1)).alias("_last"),
                                  F.array().cast("array<string>").alias("generated")), "prompts")
    turns, done = max(1, -(-start.count() // MAX_PROBES)), []
    for turn in range(turns):
        state = start.filter(F.pmod(F.xxhash64("_i"), F.lit(turns)) == turn)
        for t in range(max_new):
            u = uniform(seed, *[F.col(k) for k in keys], t)
            asked = (state.filter(F.col("_last").isNotNull()).groupBy(bucket("_last", n).alias("_b"))
                     .agg(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_last").alias("last"), u.alias("u"))).alias("asked")))
            drawn = (table.join(F.broadcast(asked), "_b").select("block", "asked").mapInArrow(_draw, "_i long, token string, lo double")
                     .groupBy("_i").agg(F.max_by("token", "lo").alias("_tok")))
            nxt = F.when(F.col("_last").isNotNull(), F.coalesce(F.col("_tok"), else_))
            state = stored(state.join(drawn, "_i", "left").withColumn("_nxt", nxt).select(
                "_i", *keys, F.coalesce("_nxt", "_last").alias("_last"),
                F.when(F.col("_nxt").isNull(), F.col("generated")).otherwise(F.concat("generated", F.array("_nxt"))).alias("generated")), "state")
        done.append(state.select(*[F.col(k).cast("string").alias(k) for k in keys], "generated"))
    return _finish_generation(_beside(prompts.select(*keys, tokens), functools.reduce(DataFrame.unionByName, done), keys), tokens, stops)


def _beside(prompts: DataFrame, generated: DataFrame, keys) -> DataFrame:
    """Prompts with what was generated for their keys (there as strings); a null key
    is a key like any other."""
    found = generated.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "generated")
    same = [F.col(k).cast("string").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return prompts.join(found, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def _finish_generation(state: DataFrame, tokens: str, stops) -> DataFrame:
    """Stop at the first step whose sequence ends with a stop sequence, trim stop
    sequences, join the text and drop a trailing end marker."""
    maxlen = max(len(x) for x in stops)
    tail = F.slice(F.col(tokens), -maxlen, maxlen)
    gen = F.coalesce(F.col("generated"), F.array().cast("array<string>"))

    def stopped(jj):
        seq = F.concat(F.when(F.size(F.col(tokens)) >= maxlen, tail).otherwise(F.col(tokens)), F.slice(gen, 1, jj))
        return ends_with_any(seq, stops)
    first = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.size(gen), F.lit(1))), stopped), True)
    state = state.withColumn("generated", gen).withColumn("_first", first)
    cut = F.when(F.col("_first") > 0, F.slice("generated", F.lit(1), F.col("_first").cast("int"))).otherwise(F.col("generated"))
    out = state.withColumn("generated", trim_stop(cut, stops)).drop("_first")
    return out.withColumn("text", drop_end_marker(F.array_join(F.concat(F.col(tokens), F.col("generated")), " ")))


def _sample_in_tasks(prompts: DataFrame, cdf: DataFrame, fallback: Column, max_new: int, seed: int,
                     keys, tokens: str) -> DataFrame:
    """Sampled steps inside tasks: the (size-checked) candidate distribution is
    broadcast as sorted arrays, prompts stay partitioned by Spark, and each draw
    is a ``searchsorted`` for the last candidate starting at or before ``u * z``
    with the same md5 uniforms as the join path."""
    import hashlib

    import numpy as np
    import pandas as pd
    spark = prompts.sparkSession
    fb = spark.range(1).select(fallback.alias("f")).first()["f"]
    pdf = cdf.select("ctx", "token", "lo", "z").toPandas().sort_values(["ctx", "lo"], kind="stable")
    ctx = pdf["ctx"].to_numpy()
    starts = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.array([], dtype=int)
    ends = np.r_[starts[1:], len(ctx)] if len(ctx) else np.array([], dtype=int)
    index = {c: (int(a), int(b)) for c, a, b in zip(ctx[starts], starts, ends)}
    bc = spark.sparkContext.broadcast((index, pdf["token"].to_numpy(), pdf["lo"].to_numpy(), pdf["z"].to_numpy()))

    def u_of(*parts):
        h = hashlib.md5(":".join(str(p) for p in parts if p is not None).encode()).hexdigest()
        return int(h[:12], 16) / float(2 ** 48)

    def run(batches):
        idx, toks, lo, z = bc.value
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                arr = getattr(row, tokens)
                last = arr[-1] if arr is not None and len(arr) else None
                gen = []
                if last is not None:
                    kv = [getattr(row, k) for k in keys]
                    for t in range(max_new):
                        se = idx.get(last)
                        if se is None:
                            nxt = fb
                        else:
                            s0, s1 = se
                            x = u_of(seed, *kv, t) * z[s0]
                            nxt = toks[s0 + max(int(np.searchsorted(lo[s0:s1], x, side="right")) - 1, 0)]
                        gen.append(nxt)
                        last = nxt
                out.append(gen)
            yield pd.DataFrame({**{k: b[k] for k in keys}, "generated": out})
    # keys travel as strings: pandas would turn a whole number beside nulls into a float
    schema = ", ".join(f"{k} string" for k in keys) + ", generated array<string>"
    return prompts.select(*[F.col(k).cast("string").alias(k) for k in keys], tokens).mapInPandas(run, schema)
