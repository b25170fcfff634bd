"""Whitening against a dense eigendecomposition, and on odd tables."""

import numpy as np
import pytest

from tillage.llm import whitening as M

SF = "/root/testdata/sf0.01"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [float(x) if x is not None else None for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def dense(vectors):
    x = np.floor(64 * np.asarray(vectors, float)) + 1_000_000
    c = x - x.mean(0)
    e, turn = np.linalg.eigh(c.T @ c / len(c))
    return x.astype(np.int64), c, e[::-1], turn[:, ::-1]


def matrix(rows, ids):
    by = {(r.vec_id, r.component): r.whitened for r in rows}
    k = max(r.component for r in rows)
    return np.array([[by[i, c] for c in range(1, k + 1)] for i in ids])


def test_query_equals_dense_algebra(spark):
    rows = M.op11_embedding_whitening(spark, SF).collect()
    source = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, c, e, turn = dense([r.embedding for r in source])
    got, want = matrix(rows, [r.vec_id for r in source]), c @ turn[:, :32] / np.sqrt(e[:32])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    n, s = len(x), x.sum(0)
    exact = {r.vec_id: sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for r, v in zip(source, x)}
    assert all(r.deviation == exact[r.vec_id] and r.n == n and r.identity_error < 1e-9 for r in rows)
    assert all(abs(r.explained * e.sum() / e[r.component - 1] - 1) < 1e-10 for r in rows)


def test_it_stops_early_and_is_exact_where_deviations_fall_off():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    c = rng.standard_normal((4000, 120)) * 1000 * 0.75 ** np.arange(120) @ turn.T
    c -= c.mean(0)
    v, b, w = M.bidiagonalise(Local(c), 120, 4, 4)
    assert v.shape[1] < 120
    _, s, q = np.linalg.svd(b)
    e = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(s[:4], e[1][:4], rtol=1e-12) and np.allclose(np.abs(q[:4] @ v.T @ e[2][:4].T), np.eye(4), atol=1e-9)
    assert np.allclose((c @ w).T @ (c @ w), np.eye(w.shape[1]), atol=1e-10)
    whole = (c @ w).T @ c @ v
    assert np.abs(whole - b).max() < 1e-9 * s[0]  # block bidiagonal up to rounding


class Local:
    """The products in memory."""

    def __init__(self, c):
        self.c = c

    def forward(self, w, v):
        p = self.c @ v
        return (self.c @ w).T @ p, p.T @ p

    def backward(self, w, new):
        q = self.c @ new
        return self.c.T @ q, (self.c @ w).T @ q, q.T @ q


@pytest.mark.parametrize("block", [1, 3, 8])
def test_one_deviation_many_times(block):
    c = np.vstack([np.eye(20), -np.eye(20)]) * 64
    c[:, 0] *= 2
    v, b, _ = M.bidiagonalise(Local(c), 20, 5, block)
    s = np.linalg.svd(b)[1]
    assert np.allclose(s[:20], [128 * 2**0.5] + [64 * 2**0.5] * 19) and np.allclose(v.T @ v, np.eye(20), atol=1e-12)


def test_nulls_dimensions_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((30, 3)).tolist()
    odd = [None, [1.0, None, 2.0], [float("nan"), 1, 2], [float("inf"), 1, 2], [], *rng.standard_normal((9, 2)).tolist()]
    df = table(spark, [*good, *odd, good[0]], [*range(30), *range(30, 44), None])
    df = df.selectExpr("vec_id", "embedding", "1 AS x", "2 AS dim", "'a' AS whitened", "3 AS ids")
    rows = M.whiten(df).collect()
    three = [r for r in rows if r.n == 31]
    assert len(three) == 31 * 3 and len(rows) == 31 * 3 + 9 * 2 and {r.vec_id for r in rows if r.n == 9} == set(range(35, 44))
    assert np.allclose(sorted(r.whitened for r in three if r.vec_id is None), sorted(r.whitened for r in three if r.vec_id == 0), rtol=1e-12)
    _, c, e, turn = dense([*good, good[0]])
    want = c @ turn / np.sqrt(e)
    got = matrix([r for r in three if r.vec_id is not None], range(30))
    assert np.abs(np.abs(got) - np.abs(want[:30])).max() < 1e-9


def test_few_components_or_none(spark):
    assert M.whiten(table(spark, [])).collect() == []
    assert M.whiten(table(spark, [[1, 2, 3]])).collect() == []
    assert M.whiten(table(spark, [[1, 2, 3]] * 5)).collect() == []
    rows = M.whiten(table(spark, [[i, 2 * i, 7] for i in range(9)])).collect()
    assert {r.component for r in rows} == {1} and all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in rows)


def test_huge_entries_saturate(spark):
    rows = M.whiten(table(spark, [[1e300, 1], [-1e300, 2], [0, 3], [5, 1]])).collect()
    assert {r.component for r in rows} == {1} and max(r.deviation for r in rows) == 2**63 - 1 and rows[0].identity_error < 1e-9
