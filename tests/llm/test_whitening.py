import math
from fractions import Fraction

import numpy as np
import pytest

from plotyard.llm.queries import QUERIES
from plotyard.llm.whitening import WIDE, refined_eigenpairs, whiten_embeddings

SCHEMA = "label string, embedding array<double>, vec_id long, n string"


def brute(rows, components=4):
    """Exact sums in Python, NumPy's eigenvectors in double precision."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in good]
    fit = sorted({x for _, x in grid})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = np.array([[float(Fraction(n * x[d] - sums[d], n)) for d in range(dims)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in grid:
        deviation = sum((n * x[d] - sums[d]) ** 2 for d in range(dims))
        flat = np.array([float(Fraction(n * x[d] - sums[d], n)) for d in range(dims)])
        for k in range(min(components, dims)):
            whitened = float(flat @ vectors[:, k] / math.sqrt(values[k])) if values[k] > 1e-9 * values.sum() else None
            out.setdefault((i, k + 1), []).append((n, deviation if deviation < 1 << 63 else None, whitened, values[k] / values.sum()))
    return out


def compare(found, want):
    rows = {}
    for r in found:
        rows.setdefault((r.vec_id, r.component), []).append(r)
    assert set(rows) == set(want)
    signs = {}
    for (i, k), have in rows.items():
        assert len(have) == len(want[i, k])
        for r in have:
            n, deviation, whitened, explained = want[i, k][0]
            assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-9, abs=1e-12)
            if whitened is None:
                assert r.whitened is None
                continue
            if k not in signs and abs(whitened) > 1e-3:
                signs[k] = math.copysign(1, r.whitened * whitened)
            assert r.whitened == pytest.approx(signs.get(k, 1) * whitened, rel=1e-7, abs=1e-7)
            assert r.identity_error < 1e-9


def test_odd_rows_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1] + 1e3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)]  # a group of copies has no weight
    rows += [(5, rows[5][1]), (None, rows[3][1]), (600, [-0.0] * 6), (601, [1e-9] * 6)]
    bad = [(700, None), (701, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (702, [math.nan] * 6), (703, [math.inf] + [0.0] * 5), (704, []), (705, [1.0] * 5)]
    frame = spark.createDataFrame([("x", v, i, "clash") for i, v in rows + bad], SCHEMA).repartition(5)
    compare(whiten_embeddings(frame).collect(), brute(rows))


def test_fewer_directions_than_components(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 0.0]) for i in range(20)]
    found = whiten_embeddings(spark.createDataFrame([("x", v, i, "") for i, v in rows], SCHEMA)).collect()
    compare(found, brute(rows))
    assert {r.component for r in found if r.whitened is None} == {2, 3}
    one = whiten_embeddings(spark.createDataFrame([("x", [1.0, 2.0], 1, "")] * 3, SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 6


def test_empty_tables(spark):
    for rows in ([], [("x", None, 1, "")], [("x", [], 1, "")]):
        assert whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * [4e7, 1e6, 2e5]).tolist()) for i in range(12)]
    compare(whiten_embeddings(spark.createDataFrame([("x", v, i, "") for i, v in rows], SCHEMA)).collect(), brute(rows))
    beyond = rows + [(12, [1e300, -1e300, 1.0])]
    found = whiten_embeddings(spark.createDataFrame([("x", v, i, "") for i, v in beyond], SCHEMA)).collect()
    assert len(found) == 39 and {r.deviation for r in found} == {None}


@pytest.mark.parametrize("gap", [1e-2, 1e-6, 1e-9, 1e-13])
def test_clustered_eigenvalues_are_resolved(gap):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0].astype(WIDE)
    for _ in range(3):
        q = q @ (1.5 * np.eye(24, dtype=WIDE) - 0.5 * q.T @ q)
    want = np.concatenate([1 + gap * np.arange(5, dtype=WIDE), WIDE(0.5) + gap * np.arange(3, dtype=WIDE), np.geomspace(1e-3, 0.3, 16).astype(WIDE)])
    values, vectors = refined_eigenpairs(q * want @ q.T)
    eps = np.finfo(WIDE).eps
    assert np.abs(np.sort(values) - np.sort(want)).max() < 300 * eps
    order = np.argsort(-want)
    assert np.abs(1 - np.abs((q[:, order] * vectors).sum(axis=0))).max() < (3000 * eps / gap) ** 2 + 3000 * eps


def test_equal_eigenvalues_give_an_orthonormal_basis():
    values, vectors = refined_eigenpairs(np.diag([2.0, 1, 1, 1, 0, 0]))
    assert values.tolist() == [2, 1, 1, 1, 0, 0]
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-15


def test_query_matches_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    compare(QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.001").collect(), brute(rows))
