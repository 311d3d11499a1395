"""Exact search and whitening against brute force over all vectors."""

from collections import Counter
from decimal import Decimal
from math import floor, inf, nan

import numpy as np
import pytest
from gridlake.llm import vafile, whitening
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int"


def random_vectors(n, width=16, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)).astype(np.float32) / 4
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    return rows + [(n + i, x[0].tolist(), 0) for i in range(copies)]


def odd_rows(width=16):
    v = [0.125] * width
    return [
        (1000, None, 0), (1001, [], 0), (1002, [None] + v[1:], 0), (1003, [nan] + v[1:], 0), (1004, [inf] + v[1:], 0),
        (1005, [0.0] * width, 0), (1020, v, 0), (1020, v, 0), (None, v, 0), (1040, v, 1), (None, None, None),
        (1060, [0.5, -0.25], 0), (1061, [0.25, 0.25], 0), (1080, [1.0, 2.0, 3.0], 0),
    ]


def usable(rows):
    return [(i, v) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]


def brute_top(rows, k, scale):
    kept = [(n, i, [floor(scale * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(usable(rows))]
    out = Counter()
    for n, i, q in kept:
        if i is None or i % 20:
            continue
        found = [(-sum(a * b for a, b in zip(q, c)), j is None, j or 0, m) for m, j, c in kept if m != n and len(c) == len(q)]
        for rank, (down, none, j, _) in enumerate(sorted(found)[:k], 1):
            out[i, rank, None if none else j, -down] += 1
    return out


def check_top(spark, rows, k=5, scale=64):
    docs = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = vafile.top_k(docs, F.col("vec_id") % 20 == 0, k=k, scale=scale)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_top(rows, k, scale)


def test_search_with_ties_copies_and_odd_vectors(spark):
    check_top(spark, random_vectors(150, copies=60) + odd_rows())


def test_search_over_many_blocks_and_stripes(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("STRIPE", 3), ("QUERIES", 2), ("SAMPLED", 8)):
        monkeypatch.setattr(vafile, name, value)
    check_top(spark, random_vectors(260, seed=3, copies=30), k=4)


def test_search_with_fewer_rows_than_results(spark):
    check_top(spark, random_vectors(4), k=20)


def test_search_with_large_components(spark):
    rows = random_vectors(60, seed=4)
    rows += [(100 + i, [2.0 ** (18 + i % 4)] * 8 + [-1.0 * i] * 8, 0) for i in range(50)]
    check_top(spark, rows)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vafile.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert vafile.top_k(spark.createDataFrame([(1, [1.0, 2.0], 0)], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    assert vafile.top_k(spark.createDataFrame([(0, [1.0, 2.0], 0)], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_search_ignores_other_columns(spark):
    rows = spark.createDataFrame([(i, [i / 4.0, 1.0], 1, 2, "x") for i in range(40)], "vec_id long, embedding array<double>, row int, rep int, query string")
    got = vafile.top_k(rows, F.col("vec_id") % 20 == 0, k=1).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 1), (20, 39)}


def test_cells_bound_every_vector():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (500, 6))
    borders = vafile.cell_borders(x[:20], 3)
    least, most = vafile.cell_ranges(vafile.cells_of(x, borders), borders, x.min(axis=0), x.max(axis=0))
    assert (least <= x).all() and (x <= most).all()
    q = rng.integers(-50, 50, (20, 6)).astype(float)
    under, over = vafile.score_bounds(q, least, most)
    assert (under <= q @ x.T).all() and (q @ x.T <= over).all()


def brute_whitening(rows, components, scale=1024, shift=100_000):
    """By length of vector: ids, exact deviations, covariance, eigenvalues and vectors by the library."""
    out = {}
    for width in {len(v) for _, v in usable(rows)}:
        ids = [i for i, v in usable(rows) if len(v) == width]
        x = [[floor(scale * float(np.float32(c))) + shift for c in v] for _, v in usable(rows) if len(v) == width]
        n, sums = len(x), [sum(c) for c in zip(*x)]
        deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
        centred = np.array([[float(a - Decimal(s) / n) for a, s in zip(row, sums)] for row in x])
        covariance = centred.T @ centred / n
        values, vectors = np.linalg.eigh(covariance)
        out[width] = ids, deviations, centred, covariance, values[::-1], vectors.T[::-1]
    return out


def check_whitening(spark, rows, components=4):
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3), components=components)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    want = brute_whitening(rows, components)
    assert len(got) == sum(len(x[0]) * min(components, w) for w, x in want.items())
    seen = Counter((r.vec_id, r.n, int(r.deviation)) for r in got if r.component == 1)
    assert seen == Counter((i, len(x[0]), d) for x in want.values() for i, d in zip(x[0], x[1]))
    return got, want


def test_whitening_matches_the_library(spark):
    rows = random_vectors(400, width=24, seed=2)
    got, want = check_whitening(spark, rows, components=8)
    ids, _, centred, covariance, values, vectors = want[24]
    place = {i: n for n, i in enumerate(ids)}
    for k in range(8):
        mine = [r for r in got if r.component == k + 1]
        w = np.empty(len(ids))
        w[[place[r.vec_id] for r in mine]] = [r.whitened for r in mine]
        expected = centred @ vectors[k] / np.sqrt(values[k])
        assert np.abs(w - np.sign(w @ expected) * expected).max() < 1e-9
        assert abs(mine[0].explained - values[k] / np.trace(covariance)) < 1e-12
    assert max(r.identity_error for r in got) < 1e-12


def test_whitening_of_odd_vectors(spark):
    got, _ = check_whitening(spark, random_vectors(50, copies=20) + odd_rows())
    alone = [r for r in got if r.vec_id == 1080]  # one vector of its length: no variance
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(alone)] == [
        (k, 1, 0, None, 0.0, 0.0) for k in (1, 2, 3)
    ]
    assert [r.whitened is None for r in sorted(r for r in got if r.vec_id == 1060)] == [False, True]


def test_whitening_of_large_components(spark):
    check_whitening(spark, [(i, [1e12 * (i % 3), float(i), -3e11 * i], 0) for i in range(30)])


def test_whitening_of_nothing(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0)], VECTORS)).count() == 0


def test_whitening_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(random_vectors(200, seed=6), VECTORS)
    one, many = ({(r.vec_id, r.component): r.whitened for r in whitening.whiten(docs.repartition(p)).collect()} for p in (1, 7))
    assert one == many  # exact sums give the same covariance


def test_whitening_ignores_other_columns(spark):
    docs = spark.createDataFrame([(i, [i / 2.0, 1.0 - i * i], 1, 2) for i in range(9)], "vec_id long, embedding array<double>, width int, n int")
    assert {r.n for r in whitening.whiten(docs).collect()} == {9}


@pytest.mark.parametrize("seed", range(4))
def test_inertia_counts_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    np.fill_diagonal(a, 0)  # forces pivots of two
    values = np.linalg.eigvalsh(a)
    for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.0]:
        assert whitening.eigenvalues_below(a, shift) == (values < shift).sum()


@pytest.mark.parametrize("values", [[5, 3, 2, 1, 0.5], [4, 4, 4, 1, 1], [2, 2 + 1e-9, 2 - 1e-9, 0, 0], [1, 0, 0, 0, 0], [7, 7 - 1e-13, 1e-8, 0, 0]])
def test_leading_components_of_close_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((5, 5)))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading_components(a, 4)
    assert np.allclose(got, sorted(values, reverse=True)[:4], atol=1e-13)
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * got).max() < 1e-12


def test_slices_certify_the_number():
    a = np.diag([9.0, 7.0, 7.0, 3.0, 1.0])
    low, high, above, inside = zip(*whitening.slices_of(a, 4))
    assert above == (0, 1, 3) and inside == (1, 2, 1)
    assert all(x <= v <= y for x, y, v in zip(low, high, (9, 7, 3)))
