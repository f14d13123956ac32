"""Whitening against numpy's eigendecomposition of the exact integer covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pulsemill.llm import whitening

KIND = "vec_id BIGINT, embedding ARRAY<FLOAT>, x STRING, dim STRING, part INT"


def table(spark, vectors, parts=4):
    rows = [(k, v, "clash", "clash", 0) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, KIND).repartition(parts)


def integers(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], object)


def check(rows, vectors, ids, many=8):
    x = integers(vectors)
    n, dim = x.shape
    sums = x.sum(axis=0)
    off = n * x - sums
    exact = off.T @ off  # n^3 times the covariance, in integers
    cov = np.array([[float(Fraction(int(c), n**3)) for c in r] for r in exact])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * min(many, dim)
    for k in range(min(many, dim)):
        mine = np.array([got[i, k + 1].whitened for i in ids])
        want = (off.astype(float) / n) @ v[:, k] / math.sqrt(e[k])
        want *= np.sign(want @ mine)
        assert np.abs(mine - want).max() < 1e-7
        for i, r in zip(ids, off):
            row = got[i, k + 1]
            assert row.n == n and row.deviation == sum(int(c) ** 2 for c in r)
            assert row.explained == pytest.approx(e[k] / np.trace(cov), rel=1e-9) and row.identity_error < 1e-9


def test_whitening_equals_numpy(spark):
    draw = np.random.default_rng(5)
    mixed = draw.standard_normal((300, 12)) @ draw.standard_normal((12, 12)) + draw.standard_normal(12) * 50
    vectors = mixed.tolist()
    odd = [None, [], [1.0] * 11 + [None], [math.nan] + [1.0] * 11, [math.inf] + [0.0] * 11, vectors[0], [0.0] * 12, vectors[1], vectors[1]]
    every = vectors + odd
    rows = whitening.whiten(table(spark, every)).collect()
    ids = [k for k, v in enumerate(every) if v and all(c is not None and math.isfinite(c) for c in v)]
    check(rows, [every[k] for k in ids], ids)


def test_hot_vector_and_narrow_spread(spark):
    draw = np.random.default_rng(6)
    vectors = [[3.0, -2.0, 1.0]] * 200 + (draw.standard_normal((100, 3)) * [1, 1e-2, 5]).tolist()
    check(whitening.whiten(table(spark, vectors, 11)).collect(), vectors, list(range(300)))


def test_components_without_variance(spark):
    flat = [[1.0, 2.0, float(k)] for k in range(6)]
    rows = whitening.whiten(table(spark, flat)).collect()
    first = sorted((r.vec_id, r.whitened) for r in rows if r.component == 1)
    assert len(rows) == 18 and abs(abs(first[0][1]) - 2.5 / math.sqrt(35 / 12)) < 1e-9
    assert all(r.whitened == 0 and r.explained == 0 for r in rows if r.component > 1) and all(r.identity_error < 1e-9 for r in rows)
    alone = whitening.whiten(table(spark, [[5.0, 6.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]


def test_lengths_and_ids(spark):
    vectors = [[float(k), float(k * k % 7)] for k in range(9)] + [[float(k)] for k in range(5)]
    rows = whitening.whiten(table(spark, vectors)).collect()
    check([r for r in rows if r.vec_id < 9], vectors[:9], list(range(9)))
    check([r for r in rows if r.vec_id >= 9], vectors[9:], list(range(9, 14)))
    unnamed = spark.createDataFrame([(None, [1.0]), (None, [2.0]), (1, [4.0]), (1, [4.0])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = whitening.whiten(unnamed).collect()
    assert sorted((r.vec_id is None, r.n) for r in found) == [(False, 4), (False, 4), (True, 4), (True, 4)]


def test_nothing_and_too_much(spark):
    assert whitening.whiten(table(spark, [None, [None], []])).collect() == []
    assert whitening.whiten(table(spark, [[1.0]]).limit(0)).columns == [f.split(" ")[0] for f in whitening._OUT.split(", ")]
    huge = spark.createDataFrame([(k, [s * 1e300, float(k)]) for k, s in enumerate((1, -1, 1, 0))], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    rows = whitening.whiten(huge).collect()
    assert len(rows) == 8 and all(math.isfinite(r.whitened) for r in rows) and max(r.deviation for r in rows) == 2**63 - 1


def test_rank_one_updates():
    draw = np.random.default_rng(7)
    for dim in (1, 2, 7, 40):
        values, vectors, dense = np.zeros(dim), np.eye(dim), np.zeros((dim, dim))
        rows = [draw.standard_normal(dim) for _ in range(2 * dim)] + [np.zeros(dim), np.eye(dim)[0], 1e-9 * np.ones(dim), 1e6 * np.ones(dim)]
        rows += [rows[0]] * 3
        for row in rows:
            values, vectors = whitening.rank_one(values, vectors, row)
            dense += np.outer(row, row)
            assert (np.diff(values) >= 0).all() and np.abs(vectors.T @ vectors - np.eye(dim)).max() < 1e-12
            assert np.abs(vectors * values @ vectors.T - dense).max() <= 1e-12 * max(1, np.abs(dense).max())


def test_spectra_merge(spark):
    draw = np.random.default_rng(8)
    x = (draw.standard_normal((400, 6)) * 1024 + 100000).astype(np.int64)
    whole, parts = whitening.Spectrum(6), whitening.Spectrum(6)
    whole.add(x)
    for a, b in ((0, 1), (1, 3), (3, 250), (250, 400)):
        one = whitening.Spectrum(6)
        one.add(x[a:b])
        parts.merge(one)
    assert parts.sums == whole.sums == x.sum(axis=0).tolist() and parts.n == 400
    assert np.allclose(parts.values, whole.values, rtol=1e-11) and np.allclose(parts.mean, whole.mean)
