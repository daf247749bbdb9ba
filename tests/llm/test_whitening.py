"""Whitening against exact and plain linear algebra, on small tables with awkward rows."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from pageloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, dims string, n string, component string, i string"
INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, *["clash"] * 5) for i, v in rows], SCHEMA).repartition(3)


def some(seed: int, n: int, d: int = 6):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(2, 0.3, d)).astype(np.float32).tolist()


def plain(rows):
    """Covariance in fractions, then numpy; rows by (id, components)."""
    kept = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(x) for _, x in kept)
    kept = [(i, x + [0] * (d - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.array([[float(sum(Fraction(n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit) / n**3) for b in range(d)]
                    for a in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    mean = np.array([v / n for v in s])
    out = {}
    for i, x in kept:
        w = (np.array(x) - mean) @ vectors
        out.setdefault(i, []).append((n, sum((n * a - b) ** 2 for a, b in zip(x, s)), w / np.sqrt(np.maximum(values, 1e-30)),
                                      values / np.trace(cov)))
    return out


def check(found, expected):
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {}).setdefault((r.deviation, abs(r.whitened or 0)), []).append(r)
    assert {i: sum(map(len, g.values())) for i, g in by.items()} == {i: len(v) * len(v[0][2]) for i, v in expected.items()}
    for i, results in expected.items():
        for n, deviation, w, explained in results:
            for k, value in enumerate(w):
                assert any(r.component == k + 1 and r.n == n and r.deviation == deviation
                           and abs(r.whitened) == pytest.approx(abs(value), rel=1e-6, abs=1e-8)
                           and r.explained == pytest.approx(explained[k], rel=1e-9)
                           for g in by[i].values() for r in g)


def test_whitened_rows_with_nulls_repeats_and_short_vectors(spark):
    rows = list(enumerate(some(1, 300)))
    rows += [(400, rows[0][1]), (400, rows[0][1]), (400, rows[5][1]), (None, rows[7][1]), (401, None), (402, [1.0, None] * 3),
             (403, [NAN] * 6), (404, [1.0, INF, 0.0, 0.0, 0.0, 0.0]), (405, [-0.0] * 6), (406, [0.0] * 6), (407, [0.5]), (408, [])]
    found = whitening.whiten(frame(spark, rows)).collect()
    check(found, plain(rows))
    assert {r.identity_error for r in found} == {found[0].identity_error} and 0 <= found[0].identity_error < 1e-9


def test_whitened_covariance_is_the_identity(spark):
    rows = list(enumerate(some(2, 500)))
    found = whitening.whiten(frame(spark, rows * 2)).collect()
    w = np.zeros((500, 4))
    for r in found:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9


def test_sliced_products_are_exact():
    rng = np.random.default_rng(3)
    for x in (rng.integers(-5, 9, (1, 3)), rng.integers(-900, 70_000, (4097, 7)), np.zeros((65, 2), np.int64),
              rng.integers(-2**63, 2**63 - 1, (130, 5)), np.array([[-2**63, 2**63 - 1]] * 64)):
        sums, products = whitening.sliced_products(x.astype(np.int64))
        whole = x.astype(object)
        assert (products == whole.T @ whole).all() and (sums == whole.sum(0)).all()


def test_scatter_adds_up_tasks(spark):
    x = np.random.default_rng(4).integers(-2**40, 2**40, (700, 3))
    rows = [(k, 3, whitening._narrow(v)) for k, v in enumerate(x)]
    n, sums, products = whitening.scatter(spark.createDataFrame(rows, "vec_id long, dims int, x binary").repartition(6), 3)
    whole = x.astype(object)
    assert n == 700 and sums == whole.sum(0).tolist() and (products == whole.T @ whole).all()


def test_huge_entries_and_deviations_beyond_a_long(spark):
    assert whitening.fixed_point(np.array([1e30, -1e30, 2.0**54, -0.001, 2.0**55])).tolist() == [
        2**63 - 1, -2**63, 2**62, -1, 2**63 - 1]
    x = np.array([[2**31, 5], [2**33, -5], [3, 4]])
    expected = [sum((10 * int(a) - b) ** 2 for a, b in zip(row, (7, -7))) for row in x]
    assert whitening.deviations(x, 10, [7, -7]) == [e if e < 2**63 else None for e in expected]
    found = whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3.0, 2.0])])).collect()
    assert len(found) == 6 and {r.deviation for r in found if r.vec_id != 3} == {None}


def test_no_variance_and_no_rows(spark):
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, 0.0)}
    line = whitening.whiten(frame(spark, [(k, [float(k), 0.0, 0.0]) for k in range(5)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    for rows in ([], [(1, None)], [(1, [])]):
        empty = whitening.whiten(frame(spark, rows))
        assert empty.count() == 0 and empty.columns == [
            "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query_over_a_given_table(spark, small):
    found = whitening.whitened_embeddings(spark, small).collect()
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(found, plain([(r[0], list(r[1])) for r in rows]))
