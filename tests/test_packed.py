"""Rows that travel packed: counts of pairs, sampling distributions, draws."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import packed as P
from parlance.operators import scoring as S
from parlance.operators import sizing


def test_pairs_counted_in_tasks_are_those_of_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [*"abcdefgh", "ü", "a b", None]
    docs = [(["x", "y", None][i % 3], [words[k] for k in rng.integers(0, len(words), rng.integers(0, 30))]) for i in range(300)] + [("y", None), ("x", [])]
    want = Counter((d, *p) for d, t in docs for p in zip(t or [], (t or [])[1:], strict=False))
    after = Counter()
    for (d, a, _), n in want.items():
        after[d, a] += n
    df = spark.createDataFrame(docs, "dataset string, tokens array<string>").repartition(3)
    count = P.pair_counts
    for rows, toks in ((200, 70), (1_500_000, 500_000)):             # flushed often, and once
        def small(docs, part, tokens, rows=rows, toks=toks):
            return count(docs, part, tokens, pair_rows=rows, pair_tokens=toks)
        monkeypatch.setattr(S, "pair_counts", small)
        _, big, ctx, _ = S.bigram_model(df, totals=True)
        got = big.collect()
        assert len(got) == len(want) and {tuple(r)[:3]: r["cnt"] for r in got} == want
        assert all(r["ctx_cnt"] == after[r["dataset"], r["prev"]] for r in got)
        plain = S.bigram_model(df)[1]
        c = S.candidates(big, ctx)
        assert "Join" not in c._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, c.collect()), key=repr) == sorted(map(tuple, S.candidates(plain, ctx).collect()), key=repr)


def test_distribution_by_bucket_is_that_of_a_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [(None, "a", 3, 3)], {}
    for c in range(60):
        cnt = sorted(((int(k), f"t{j}") for j, k in enumerate(rng.integers(1, 9, rng.integers(1, 70)))), key=lambda k: (-k[0], k[1]))
        total = sum(k for k, _ in cnt)
        rows += [(f"c{c}", t, k, total) for k, t in cnt]
        w = [(k / total) ** (1 / 0.7) for k, _ in cnt]
        lo = [sum(w[:j]) for j in range(len(w))]
        kept = [j for j in range(len(w)) if lo[j] < 0.85 * sum(w)]
        for j in kept:
            want[f"c{c}", cnt[j][1]] = (lo[j], w[j], sum(w[j] for j in kept))
    df = spark.createDataFrame(rows, "ctx string, token string, cnt long, total long").repartition(5)
    cdf = S.sampling_cdf(df, 0.85, 0.7)
    assert cdf._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2      # the repartition above, and the blocks
    got = {(r["ctx"], r["token"]): (r["lo"], r["w"], r["z"]) for r in cdf.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=0) for k in want)


def test_draws_past_the_bound_shuffle_no_candidate(spark, monkeypatch):
    cands = [(c, f"w{j}", float(j), 1.0, 50.0) for c in [*(f"w{k}" for k in range(40)), "hot"] for j in range(50)]
    cdf = spark.createDataFrame(cands, "ctx string, token string, lo double, w double, z double").repartition(4)    # a context in several blocks
    prompts = spark.createDataFrame([(i % 90, i % 2, ["hot"] if i % 3 else ["w7"]) for i in range(100)] + [(1000, 0, []), (1001, 0, ["never seen"])],
                                    "conv_id long, turn int, tokens array<string>")
    plans, found = [], []
    real = S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), real(df, name))[1])
    monkeypatch.setattr(S, "MAX_PROBES", 30)                                          # several rounds of prompts
    for bound in (10_000, 0):
        monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", bound)
        rows = S.batch_generate_sampled(prompts, cdf, F.lit("w3"), 3, 7).collect()
        found.append(sorted((r.conv_id, r.turn, tuple(r.tokens), tuple(r.generated)) for r in rows))
    assert found[0] == found[1] and len(found[0]) > 100                               # repeated keys are met by each of their rows
    steps = [p for name, p in plans if name == "state"]
    assert len(steps) == 3 * 4 and all("Repartition" not in p and "explode" not in p for p in steps)
