"""Quantization invariants and quirk cases."""

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import quant as Q


def mat(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "row long, vec array<double>")


def test_all_zero_row_range(spark):
    m = mat(spark, [[0.0] * 8])
    r = Q.channel_params(m, 4, False).first()
    assert r.scale == 2.0 / 15 and r.zero == round(1 / (2.0 / 15))


def test_symmetric_nonnegative_row_clips(spark):
    # all >= 0, symmetric: xmin stays 0, zero = (maxq+1)/2 -> upper values clip
    m = mat(spark, [[0.0, 1.0, 2.0, 3.0]])
    p = Q.channel_params(m, 2, True)
    r = Q.rtn_quantize(p, 2).first()
    assert r.zero == 2.0 and r.scale == 1.0
    assert r.deq == [0.0, 1.0, 1.0, 1.0]


def test_pack_unpack_identity_all_widths(spark):
    rng = np.random.default_rng(0)
    for bits in (2, 3, 4, 8):
        d = 64
        codes = rng.integers(0, 2 ** bits, size=(5, d)).tolist()
        df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "row long, codes array<int>")
        packed = Q.pack_words(df, bits, d)
        back = packed.select("row", Q.unpack_codes(F.col("words"), bits, d).alias("u"), "words").collect()
        for r in back:
            assert r.u == codes[r.row]
            assert len(r.words) == Q.n_words(d, bits)
            assert all(0 <= w < 2 ** 32 for w in r.words)


def test_three_bit_straddle(spark):
    d = 32
    codes = [0] * d
    codes[10], codes[21] = 7, 5          # 7 = 0b111 crosses word 0/1, 5 = 0b101 crosses word 1/2
    df = spark.createDataFrame([(0, codes)], "row long, codes array<int>")
    w = Q.pack_words(df, 3, d).first().words
    assert w[0] == (7 & 0b11) << 30
    assert w[1] == ((7 >> 2) & 1) | ((5 & 1) << 31)
    assert w[2] == (5 >> 1) & 0b11


def test_zero_zero_survives_packing(spark):
    # zero = 0 stores (0 - 1) & maxq = maxq and decodes back to 0
    params = spark.createDataFrame([(0, [0.0, 3.0]), (1, [15.0, 1.0])], "row long, zeros array<double>")
    words = Q.pack_zeros(params, 4)
    z = {(r.grp, r.row): r.zero for r in Q.unpack_zeros(words, 4, 2).collect()}
    assert z == {(0, 0): 0.0, (1, 0): 3.0, (0, 1): 15.0, (1, 1): 1.0}


def test_rtn_error_bounded_by_half_scale(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(20, 16)).tolist()
    p = Q.channel_params(mat(spark, rows), 4, False)
    for r in Q.rtn_quantize(p, 4).collect():
        err = np.abs(np.array(r.vec) - np.array(r.deq))
        assert err.max() <= r.scale / 2 + 1e-12


def test_matmul_paths_agree(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(size=(12, 64))
    x = rng.normal(size=(3, 64))
    m = mat(spark, w.tolist())
    p = Q.rtn_quantize(Q.group_params(m, 4, False, 32, d=64), 4, 32)
    packed = Q.pack_words(p, 4, 64).select("row", "words", "scales", "zeros", "deq")
    xs = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "b long, x array<double>")
    fast = {(r.b, r.row): r.y for r in Q.dequant_matmul(xs, packed, 4, 64, 32).collect()}
    old, oldb = Q.MAX_BROADCAST_X, Q.MATMUL_BLOCK
    try:
        Q.MAX_BROADCAST_X = 64 * 5          # x (3 rows) too big? no: W (12 rows) is -> broadcast W path
        Q.MAX_BROADCAST_X = 64 * 2
        wside = {(r.b, r.row): r.y for r in Q.dequant_matmul(xs, packed, 4, 64, 32).collect()}
        Q.MAX_BROADCAST_X, Q.MATMUL_BLOCK = 0, 4   # neither side broadcast -> block join
        blocks = {(r.b, r.row): r.y for r in Q.dequant_matmul(xs, packed, 4, 64, 32).collect()}
    finally:
        Q.MAX_BROADCAST_X, Q.MATMUL_BLOCK = old, oldb
    deq = np.array([r.deq for r in sorted(packed.collect(), key=lambda r: r.row)])
    ref = x @ deq.T
    assert len(fast) == len(wside) == len(blocks) == 36
    for (b, row), y in fast.items():
        for got in (y, wside[(b, row)], blocks[(b, row)]):
            assert abs(got - ref[b, row]) < 1e-9


def test_mse_grid_runs_in_batches_and_keeps_odd_rows(spark):
    rows = [(0, [0.5, -1.0, 0.25]), (1, [0.1, 2.0, -0.3]), (2, None), (3, [1.0, None, 0.5]), (4, [0.0, 0.0, 0.0]), (5, [])]
    df = spark.createDataFrame(rows, "row long, vec array<double>")
    q = Q.mse_params(df, 3, False)
    assert "ArrowEvalPython" in q._jdf.queryExecution().executedPlan().toString()
    got = {r["row"]: r for r in q.collect()}
    for r, vec in rows[:2]:
        lo, hi = min(min(vec), 0.0), max(max(vec), 0.0)
        errs = []
        for i in range(80):
            p = 1.0 - i / 100.0
            s = (p * hi - p * lo) / 7
            z = round(-(p * lo) / s)
            errs.append((sum(abs(s * (min(max(round(x / s) + z, 0), 7) - z) - x) ** 2.4 for x in vec), i))
        assert got[r]["best_i"] == min(errs)[1]
        assert abs(got[r]["err"] - min(errs)[0]) < 1e-12
    assert got[2]["err"] is None and got[3]["err"] is None
    assert got[4]["best_i"] == 0 and got[4]["err"] == 0.0 and got[5]["err"] == 0.0


def test_matmul_blocks_and_slices_meet_once(spark, monkeypatch):
    import numpy as np
    for name, n in (("MAX_BROADCAST_X", 1), ("X_BLOCK", 8), ("W_BLOCK", 16), ("MATMUL_BLOCK", 5), ("X_SLICE", 3)):
        monkeypatch.setattr(Q, name, n)
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(40, 32))
    m = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "row long, vec array<double>")
    packed = Q.pack_words(Q.rtn_quantize(Q.group_params(m, 4, False, 16, d=32), 4, 16), 4, 32)
    deq = {r["row"]: r["deq"] for r in packed.select("row", "deq").collect()}
    xs = m.select(m["row"].alias("b"), m["vec"].alias("x"))
    rows = Q.dequant_matmul(xs, packed, 4, 32, 16).collect()
    got = {(r["b"], r["row"]): r["y"] for r in rows}
    assert len(rows) == len(got) == 1600
    assert all(abs(y - float(np.dot(vecs[b], deq[w]))) < 1e-9 for (b, w), y in got.items())


def test_matmul_blocks_copy_no_row(spark, monkeypatch):
    for name, n in (("MAX_BROADCAST_X", 1), ("X_BLOCK", 8), ("W_BLOCK", 16), ("MATMUL_BLOCK", 5), ("X_SLICE", 3)):
        monkeypatch.setattr(Q, name, n)
    rng = np.random.default_rng(6)
    ids = [None, *range(39)]
    vecs = {i: rng.normal(size=32) for i in ids}
    m = spark.createDataFrame([(i, vecs[i].tolist()) for i in ids], "row long, vec array<double>")
    packed = Q.pack_words(Q.rtn_quantize(Q.group_params(m, 4, False, 16, d=32), 4, 16), 4, 32)
    deq = {r["row"]: r["deq"] for r in packed.select("row", "deq").collect()}
    y = Q.dequant_matmul(m.select(m["row"].alias("b"), m["vec"].alias("x")), packed, 4, 32, 16)
    plan = y._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan      # copies of rows were shuffled, one for each block they met
    rows = y.collect()
    assert len(rows) == len({(r["b"], r["row"]) for r in rows}) == 1600
    assert all(abs(r["y"] - float(np.dot(vecs[r["b"]], deq[r["row"]]))) < 1e-9 for r in rows)


def test_matmul_yields_slices_on_every_path(spark, monkeypatch):
    rng = np.random.default_rng(7)
    ids, x, rows, w, plus = np.arange(10), rng.normal(size=(10, 4)), np.arange(100, 111), rng.normal(size=(11, 4)), rng.normal(size=11)
    for name, n in (("MATMUL_BLOCK", 5), ("X_SLICE", 3)):
        monkeypatch.setattr(Q, name, n)
    parts = list(Q._products(ids, x, rows, w, plus))
    assert max(map(len, parts)) == 15                                # the whole product was one frame
    got = {(b, r): y for p in parts for b, r, y in zip(p["b"], p["row"], p["y"], strict=True)}
    assert len(got) == sum(map(len, parts)) == 110
    assert all(abs(y - (x[b] @ w[r - 100] + plus[r - 100])) < 1e-12 for (b, r), y in got.items())
