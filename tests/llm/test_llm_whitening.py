import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from profspark.llm import feast, whitening
from profspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def matrices():
    rng = np.random.default_rng(2)
    for k in range(60):
        d, r = int(rng.integers(1, 60)), 0
        r = int(rng.integers(1, d + 1))
        a = rng.standard_normal((d, r)) * 10.0 ** rng.uniform(-3, 0, r)
        yield (a @ a.T * 1e5, np.eye(d) * 7.0, np.diag(np.repeat([5.0, 3.0, 1.0], d)[:d]))[k % 3 if k % 4 == 0 else 0]


def test_inertia_counts():
    for v in matrices():
        t, w = feast.tridiagonal(v / np.trace(v)), np.linalg.eigvalsh(v / np.trace(v))
        for at in (1e-9, 0.013, 0.2, 0.71, 1.1):
            assert feast.above(t, at) == (w > at).sum()


def test_largest_equal_eigh():
    for v in matrices():
        values, vectors = feast.largest(v, 8, 1e-12)
        want, trace = np.linalg.eigvalsh(v)[::-1], np.trace(v)
        k = min(8, int((want > 1e-12 * trace).sum()))
        assert len(values) == k and np.allclose(values, want[:k], rtol=1e-9, atol=1e-13 * trace)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * trace


def test_no_eigenvalue_is_missed():
    """Close ones, a large gap, and one of many equal ones at the border of what is wanted."""
    rng = np.random.default_rng(4)
    for spectrum in ([1, 1 - 1e-7, 1 - 2e-7, *[0.5] * 20], [1e6, *[1.0] * 30], [8, 7, 6, 5, 4, 3, 2, 1.5, 1.5, 1.5, 1.5, 1.5, 0.1]):
        q, _ = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))
        v = q * np.array(spectrum) @ q.T
        values, _ = feast.largest((v + v.T) / 2, 8, 1e-12)
        assert np.allclose(values, sorted(spectrum, reverse=True)[:8], rtol=1e-8)
    assert len(feast.largest(np.zeros((5, 5)), 8, 1e-12)[0]) == 0


def brute(vectors, components=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    v = ((n * x.T.dot(x) - np.outer(s, s)) / (n * n)).astype(float)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    off = n * x - s
    return n, (off**2).sum(axis=1), (off.astype(float) / n) @ basis / np.sqrt(values), values / np.trace(v)


def test_query_equals_numpy(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    usable = {i: v for i, v in rows.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    ids = sorted(usable)
    n, deviation, white, share = brute([usable[i] for i in ids])
    got = {(r.vec_id, r.component): r for r in QUERIES["op13_whitening"](spark, SF).collect()}
    assert set(got) == {(i, k) for i in ids for k in range(1, 9)}
    for k in range(8):
        own = [got[i, k + 1] for i in ids]
        assert all(r.n == n and r.deviation == w for r, w in zip(own, deviation, strict=True))
        w = np.array([r.whitened for r in own])
        assert np.abs(w * np.sign(w @ white[:, k]) - white[:, k]).max() < 1e-6 and abs(own[0].explained - share[k]) < 1e-9
        assert {r.identity_error for r in own} == {own[0].identity_error} and own[0].identity_error < 1e-9


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n string, row int, X int")


def test_edges(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(c) for c in rng.standard_normal(12)], "a", None, 1, 2) for i in range(40)]
    bad = [(90, None), (91, [1.0] * 11 + [None]), (92, [float("nan")] + [1.0] * 11), (93, [float("inf")] * 12), (94, []), (95, [1.0, 2.0]), (None, good[0][1])]
    df = vectors(spark, [*good, good[0], *[(i, v, None, None, None, None) for i, v in bad]])
    found = whitening.whitened(df, whitening.fixed_point(F.col("embedding")))
    rows = found.collect()
    assert found.columns == ["vec_id", "embedding", "row", "X", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(rows) == 42 * 8 and {r.n for r in rows} == {42} and {r.vec_id for r in rows} == {None, *range(40)}
    assert rows[0].identity_error < 1e-9
    few = whitening.whitened(vectors(spark, [(i, [float(i), -2.0 * i, 5.0], None, None, 0, 0) for i in range(9)]), whitening.fixed_point(F.col("embedding")), keep=["vec_id"])
    assert {r.component for r in few.collect()} == {1}
    for none in (df.limit(0), df.where("embedding is null"), df.where("vec_id = 5"), df.where("vec_id = 0")):
        assert whitening.whitened(none, whitening.fixed_point(F.col("embedding"))).collect() == []


def test_large_entries_stay_exact(spark):
    """Beyond 64 bits deviations are still exact, and the query's long is null where it does not fit."""
    rows = [(i, [3e6 * (i % 5) + i, -2e8 + i * i], None, None, 0, 0) for i in range(200)]
    got = whitening.whitened(vectors(spark, rows), whitening.fixed_point(F.col("embedding")), keep=["vec_id"]).collect()
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v, *_ in rows], dtype=object)
    want = ((200 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert {r.vec_id: int(r.deviation) for r in got} == dict(enumerate(want.tolist())) and got[0].identity_error < 1e-6
