"""Gram accumulation and error-compensated quantization vs NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import gram as G
from parlance.operators import quant as Q


def mat(spark, a):
    return spark.createDataFrame([(i, r) for i, r in enumerate(a.tolist())], "row long, vec array<double>")


def test_gram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    g = G.gram_matrix(mat(spark, x).repartition(3), "vec", 8).collect()
    h = np.zeros((8, 8))
    for r in g:
        h[r.i, r.j] = r.h
    assert np.allclose(h, 2 * x.T @ x / 50)


def test_gram_merge_equals_whole(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    df = mat(spark, x)
    state = None
    for b in range(3):
        state = G.gram_merge(state, G.gram_delta(df.filter(F.col("row") % 3 == b), "vec", 4))
    h = np.zeros((4, 4))
    for r in state.collect():
        h[r.i, r.j] = r.h
    assert np.allclose(h, 2 * x.T @ x / 30)


def unblocked_reference(w, h, bits, percdamp=0.01):
    """Textbook column-by-column error feedback (no lazy blocks), per-row asym params."""
    h = h.copy()
    dead = np.diag(h) == 0
    h[dead, dead] = 1
    lo = np.minimum(w.min(1), 0)
    hi = np.maximum(w.max(1), 0)
    mq = 2 ** bits - 1
    scale = (hi - lo) / mq
    zero = np.rint(-lo / scale)
    w = w.copy()
    w[:, dead] = 0
    h += percdamp * np.mean(np.diag(h)) * np.eye(len(h))
    u = np.linalg.cholesky(np.linalg.inv(h)).T
    q = np.zeros_like(w)
    for c in range(w.shape[1]):
        qc = scale * (np.clip(np.rint(w[:, c] / scale) + zero, 0, mq) - zero)
        q[:, c] = qc
        e = (w[:, c] - qc) / u[c, c]
        w[:, c:] -= np.outer(e, u[c, c:])
    return q


def test_gptq_matches_unblocked_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 40))
    w = rng.normal(size=(25, 40))
    gram = G.gram_matrix(mat(spark, x), "vec", 40)
    got = G.gptq_quantize(mat(spark, w), gram, 4, sym=False, groupsize=-1, blocksize=16, d=40).collect()
    q = np.array([r.q for r in sorted(got, key=lambda r: r.row)])
    ref = unblocked_reference(w, 2 * x.T @ x / 200, 4)
    assert np.allclose(q, ref, atol=1e-9)


def test_gptq_beats_rtn_in_hessian_norm(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 5))
    x = base @ rng.normal(size=(5, 32)) + 0.1 * rng.normal(size=(300, 32))   # correlated inputs
    w = rng.normal(size=(40, 32))
    h = 2 * x.T @ x / 300
    for gs, act in ((-1, False), (8, True)):
        gram = G.gram_matrix(mat(spark, x), "vec", 32)
        got = G.gptq_quantize(mat(spark, w), gram, 3, groupsize=gs, act_order=act, d=32).collect()
        q = np.array([r.q for r in sorted(got, key=lambda r: r.row)])
        p = Q.group_params(mat(spark, w), 3, False, gs, d=32)
        rtn = np.array([r.deq for r in sorted(Q.rtn_quantize(p, 3, 32 if gs == -1 else gs).collect(), key=lambda r: r.row)])
        def herr(a):
            e = w - a
            return np.einsum("ij,jk,ik->", e, h, e)
        assert herr(q) < herr(rtn)


def test_dead_column_zeroed(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    x[:, 2] = 0
    w = rng.normal(size=(4, 6))
    gram = G.gram_matrix(mat(spark, x), "vec", 6)
    cond = {(r.i, r.j): r.h for r in G.gram_condition(gram, 0.01).collect()}
    diag = np.array([cond[(i, i)] for i in range(6)])
    raw = np.diag(2 * x.T @ x / 60).copy()
    raw[2] = 1
    assert np.allclose(diag, raw + 0.01 * raw.mean())
    got = G.gptq_quantize(mat(spark, w), gram, 4, d=6).collect()
    for r in got:
        assert abs(r.q[2]) <= 1e-9            # dead inputs are quantized from zero


def sequential_reference(w, h, bits, sym, groupsize, blocksize, order, percdamp=0.01):
    """Errors pushed forward column by column on a working copy, a block's errors
    reaching group parameters only when the block ends."""
    w, h = w[:, order].copy(), h[np.ix_(order, order)].copy()
    dead = np.diag(h) == 0
    h[dead, dead] = 1
    h += percdamp * np.mean(np.diag(h)) * np.eye(len(h))
    u = np.linalg.cholesky(np.linalg.inv(h)).T
    top = 2 ** bits - 1

    def fit(x):
        lo, hi = np.minimum(x.min(1), 0), np.maximum(x.max(1), 0)
        if sym:
            hi = np.maximum(abs(lo), hi)
            lo = np.where(lo < 0, -hi, lo)
        flat = (lo == 0) & (hi == 0)                # nothing but zeros: the range is -1 .. 1
        lo, hi = np.where(flat, -1, lo), np.where(flat, 1, hi)
        s = (hi - lo) / top
        return s, np.full(len(x), (top + 1) / 2) if sym else np.rint(-lo / s)

    s, z = fit(w)
    w[:, dead] = 0
    q, loss, settled = np.zeros_like(w), np.zeros(len(w)), w.copy()
    for c in range(w.shape[1]):
        if c % blocksize == 0:
            settled = w.copy()
        if groupsize != -1 and c % groupsize == 0:
            s, z = fit(settled[:, c:c + groupsize])
        q[:, c] = s * (np.clip(np.rint(w[:, c] / s) + z, 0, top) - z)
        e = (w[:, c] - q[:, c]) / u[c, c]
        loss += e ** 2 / 2
        w[:, c:] -= np.outer(e, u[c, c:])
    return q[:, np.argsort(order)], loss


@pytest.mark.parametrize("sym,groupsize,act,blocksize", [(False, 8, False, 16), (True, 8, True, 12), (True, -1, True, 7), (False, 20, True, 8)])
def test_gptq_settings_match_numpy(spark, sym, groupsize, act, blocksize):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(200, 40)) * np.linspace(1, 3, 40)[rng.permutation(40)], rng.normal(size=(25, 40))
    x[:, 11] = 0
    if sym:
        w = rng.uniform(-0.1, 1, size=(25, 40))     # a group's negative extreme lies on a rounding tie
    h = 2 * x.T @ x / 200
    gram = G.gram_matrix(mat(spark, x), "vec", 40)
    out = G.gptq_quantize(mat(spark, w), gram, 3, sym=sym, groupsize=groupsize, blocksize=blocksize, act_order=act, d=40)
    got = sorted(G.dequant_by_group(out).collect(), key=lambda r: r.row)
    order = np.argsort(-np.diag(h), kind="stable") if act else np.arange(40)
    q, loss = sequential_reference(w, h, 3, sym, groupsize, blocksize, order)
    assert np.allclose([r.q for r in got], q, atol=1e-8)
    assert np.allclose([r.loss for r in got], loss)
    assert np.allclose([r.w for r in got], [r.q for r in got])            # codes, scales, zeros and groups say the same
    if groupsize != -1 and not act:
        assert got[0].col_group == [c // groupsize for c in range(40)]


def test_gptq_result_packs_and_unpacks(spark):
    rng = np.random.default_rng(7)
    gram = G.gram_matrix(mat(spark, rng.normal(size=(90, 32))), "vec", 32)
    out = G.gptq_quantize(mat(spark, rng.normal(size=(9, 32))), gram, 4, groupsize=8, d=32)
    packed = Q.pack_words(out, 4, 32)
    for r in Q.unpack_dequant(packed.drop("codes"), 4, 32, 8).collect():
        assert np.allclose(r.w, r.q)
    zeros = {(r.row, r.grp): r.zero for r in Q.unpack_zeros(Q.pack_zeros(out, 4), 4, 9).collect()}
    assert all(zeros[r.row, g] == z for r in out.collect() for g, z in enumerate(r.zeros))


def test_gram_tiles_of_many_keys(spark, monkeypatch):
    """Stripes, early sums and both rounds of adding up; keys of other types and null."""
    monkeypatch.setattr(G, "TILE", 4)
    monkeypatch.setattr(G, "CELLS", 50)
    monkeypatch.setattr(G, "SLOTS", 2)
    rng = np.random.default_rng(8)
    rows = [(["a", "b", None][i % 3], x) for i, x in enumerate(rng.normal(size=(60, 10)).tolist())]
    df = spark.createDataFrame(rows, "matrix_id string, vec array<double>").repartition(5)
    got = {}
    for r in G.gram_matrix(df, "vec", 10, key="matrix_id").collect():
        got.setdefault(r.matrix_id, np.full((10, 10), np.nan))[r.i, r.j] = r.h
    for k in ("a", "b", None):
        x = np.array([v for m, v in rows if m == k])
        assert np.allclose(got[k], 2 * x.T @ x / len(x))
    assert G.gram_matrix(df.limit(0), "vec", 10).count() == 0


@pytest.mark.parametrize("sym,groupsize,act,blocksize", [(False, -1, False, 4), (True, 3, True, 2), (False, 4, True, 4)])
def test_gptq_over_tiles_and_matrices(spark, monkeypatch, sym, groupsize, act, blocksize):
    """Three matrices of different widths in one job, each over several tiles and row blocks,
    against the sequential version; a matrix without a Gram matrix is left out."""
    from parlance.operators import gptq

    monkeypatch.setattr(gptq, "TILE", 8)
    monkeypatch.setattr(gptq, "CELLS", 200)
    rng = np.random.default_rng(9)
    widths, rows, grams, want = {"m1": 40, "m2": 8, "m3": 13}, [], [], {}
    for name, d in widths.items():
        x, w = rng.normal(size=(120, d)) * np.linspace(1, 3, d)[rng.permutation(d)], rng.normal(size=(17, d))
        x[:, d // 2] = 0
        if sym:
            w = rng.uniform(-0.1, 1, size=(17, d))      # a group's negative extreme lies on a rounding tie
        h = 2 * x.T @ x / 120
        rows += [(name, i, r) for i, r in enumerate(w.tolist())]
        grams += [(name, i, j, float(h[i, j])) for i in range(d) for j in range(d)]
        order = np.argsort(-np.diag(h), kind="stable") if act else np.arange(d)
        want[name] = sequential_reference(w, h, 3, sym, groupsize, blocksize, order)
    rows.append(("alone", 0, [1.0, 2.0]))
    matrix = spark.createDataFrame(rows, "matrix_id string, row long, vec array<double>").repartition(3)
    gram = spark.createDataFrame(grams, "matrix_id string, i int, j int, h double").repartition(3)
    out = G.dequant_by_group(G.gptq_quantize(matrix, gram, 3, sym=sym, groupsize=groupsize, blocksize=blocksize, act_order=act, key="matrix_id")).collect()
    assert len(out) == 17 * 3
    for name in widths:
        mine = sorted((r for r in out if r.matrix_id == name), key=lambda r: r.row)
        q, loss = want[name]
        assert np.allclose([r.q for r in mine], q, atol=1e-8) and np.allclose([r.w for r in mine], q, atol=1e-8)
        assert np.allclose([r.loss for r in mine], loss)


def test_inverse_factor_over_tiles(spark):
    """U'U of the joined tiles is the inverse, however many tiles there are."""
    from parlance.operators import gptq

    rng = np.random.default_rng(10)
    x = rng.normal(size=(90, 22))
    h = 2 * x.T @ x / 90
    gram = spark.createDataFrame([(0, i, j, float(h[i, j])) for i in range(22) for j in range(22)], "mid int, i int, j int, h double")
    columns = gptq.column_order(gram, 0.01, False, "mid")
    u = np.zeros((22, 22))
    for r in gptq.factor_tiles(gram, columns, 5, 5, "mid").collect():
        u[r.bi * 5:r.bi * 5 + r.n, r.bj * 5:r.bj * 5 + r.m] = np.frombuffer(bytes(r.data)).reshape(r.n, r.m)
    assert np.allclose(u, np.triu(u)) and np.allclose(u.T @ u, np.linalg.inv(h + 0.01 * np.mean(np.diag(h)) * np.eye(22)))
