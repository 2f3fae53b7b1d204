"""Whitening against numpy's eigenvectors of the exact covariance; repeated and missing directions; edge rows."""

import math

import numpy as np
import pytest

from packtables.llm import whitening as W
from packtables.llm.queries import op13_whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, whitened string, n int"


def integers(rows):
    """Usable rows as ``{place: whole numbers}``."""
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(got, rows, least_gap=1e-3):
    """Every number against the exact sums and numpy's decomposition; returns the eigenvalues."""
    x = np.array([v for _, v in rows], np.int64)
    n, s = len(x), x.sum(0)
    m = (n * x - s) / n
    e, vecs = np.linalg.eigh(m.T @ m / n)
    e, vecs = e[::-1], vecs[:, ::-1]
    k = min(32, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == k * n and all(r.n == n for r in got)
    dev = sorted((i, sum((n * a - int(b)) ** 2 for a, b in zip(v, s))) for i, v in rows)
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == dev
    w = {}
    for r in got:
        w.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    for c in w:
        gap = min([abs(e[c - 1] - e[j]) for j in (c - 2, c) if 0 <= j < len(e)], default=1) / e[0]
        if gap > least_gap:         # a component of its own: equal up to its sign
            want = {}
            for (i, _), y in zip(rows, m @ vecs[:, c - 1] / math.sqrt(e[c - 1])):
                want.setdefault(i, []).append(y)
            pairs = [(a, b) for i in want for a, b in zip(sorted(w[c][i]), sorted(want[i]))]
            turned = [(a, b) for i in want for a, b in zip(sorted(w[c][i]), sorted(-y for y in want[i]))]
            assert min(max(abs(a - b) for a, b in p) for p in (pairs, turned)) < 1e-8
    return e


def test_query_matches_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(op13_whitening(spark, SF).collect(), integers(rows), 1e-4)


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.standard_normal(5) * [9, 4, 2, 1, 0.5]]) for i in range(150)]
    rows += [(3, rows[3][1])] * 2 + [(None, rows[5][1]), (160, None), (161, [1.0, None, 0.0, 0.0, 0.0]), (162, [float("nan")] + [0.0] * 4),
                                     (163, [0.0, float("inf"), 0.0, 0.0, 0.0])]
    odd = [(170, [1.0, 2.0]), (171, []), (172, [1.0] * 9)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows + odd], SCHEMA).repartition(4)
    got = W.whiten(df).collect()
    usable = integers([(-1 if i is None else i, v) for i, v in rows])
    check([type("R", (), {**r.asDict(), "vec_id": -1 if r.vec_id is None else r.vec_id}) for r in got], usable)
    assert W.whiten(df.limit(0)).collect() == []
    assert W.whiten(df.filter("vec_id = 171")).collect() == []
    assert W.whiten(df.filter("vec_id = 4")).collect() == [] and W.whiten(df.filter("vec_id = 3")).collect() == []


def test_equal_eigenvalues_and_missing_directions(spark):
    """A cross polytope has one eigenvalue for all directions; a constant and a copied dimension have none of their own."""
    corners = [[s * (j == i) * 10.0 for j in range(6)] for i in range(6) for s in (1, -1)]
    rows = [(i, v) for i, v in enumerate(corners)]
    e = check(W.whiten(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect(), integers(rows))
    assert e[0] == pytest.approx(e[-1])
    rng = np.random.default_rng(4)
    rows = []
    for i in range(80):
        a, b, c = (float(x) for x in rng.integers(-90, 90, 3))
        rows.append((i, [a, b, a, 5.0, c / 64]))
    got = W.whiten(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check(got, integers(rows))


def test_wide_spread_of_deviations(spark):
    """Deviations a hundred thousand times apart: small components keep their digits."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.standard_normal(6) * [2000, 2000, 50, 50, 1, 0.05]]) for i in range(300)]
    check(W.whiten(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(3)).collect(), integers(rows), 1e-12)


def test_bidiagonal_factors(spark):
    """V is orthogonal, B is upper bidiagonal and the singular values of X are B's."""
    rows = W.vectors(spark.read.parquet(f"{SF}/embeddings.parquet"))
    x = np.array([r.x for r in rows.collect()], np.int64)
    n, s = len(x), x.sum(0)
    right, b = W.bidiagonalise(rows, n, s)
    assert np.abs(right @ right.T - np.eye(64)).max() < 1e-13
    assert np.abs(b - np.triu(np.tril(b, 1))).max() == 0
    assert np.linalg.svd(b)[1] == pytest.approx(np.linalg.svd((n * x - s) / n)[1], rel=1e-10)


def test_deviations_beyond_64_bits_raise(spark):
    with pytest.raises(OverflowError):
        W.whiten(spark.createDataFrame([(1, [1e9], "", 0), (2, [-1e9], "", 0)], SCHEMA)).collect()
    assert W.whiten(spark.createDataFrame([(1, [0.5], "", 0), (2, [1.0], "", 0)], SCHEMA)).count() == 2
