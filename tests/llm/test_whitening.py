"""Whitening against a dense eigendecomposition in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import SF_SMALL
from tokenmill.llm import whitening as wh


def test_secular_roots():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 40):
        d, z = np.sort(rng.normal(size=n)) * 10, rng.normal(size=n) * np.logspace(-6, 0, n)
        near, off = wh.secular_roots(d, z * z, 0.7)
        want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))
        assert np.allclose(d[near] + off, want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("kind", ["plain", "copies", "flat", "one axis"])
def test_updates_and_merge(kind):
    """Spectra of vectors added one by one and merged; equal and zero eigenvalues are deflated."""
    rng = np.random.default_rng(1)
    x = np.floor(64 * rng.normal(size=(90, 12))) + 1_000_000
    if kind == "copies":
        x[10:80] = x[3]
    if kind == "flat":
        x[:, 4:] = 1_000_000
    if kind == "one axis":
        x = 1_000_000 + np.kron(np.eye(9), np.ones((10, 1)))
    a, b = wh.Spectrum(x.shape[1]), wh.Spectrum(x.shape[1])
    for k, row in enumerate(x):
        (a if k < 40 else b).add(row)
    a.add(x[0], 5)
    x = np.concatenate([x, np.repeat(x[:1], 5, 0)])
    a.merge(b)
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    assert a.n == len(x) and np.allclose(a.mean, x.mean(0))
    assert np.allclose(a.vectors.T @ a.vectors, np.eye(x.shape[1]), atol=1e-12)
    assert np.allclose(a.vectors * a.values @ a.vectors.T, scatter, atol=1e-11 * np.abs(scatter).max())


def check(rows, got, components=32):
    """``rows``: (vec_id, vector) of usable rows."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows])
    n, total = len(x), x.sum(0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    use = min(components, int((values > 1e-12 * values.sum()).sum()))
    deviation = [int(((n * r.astype(object) - total.astype(object)) ** 2).sum()) for r in x]
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    white = np.zeros((n, use))
    for k, (i, _) in enumerate(rows):
        parts = by[i, deviation[k]]
        assert sorted(parts) == list(range(1, use + 1))
        for c, same in parts.items():
            assert all(r.n == n and abs(r.explained - values[c - 1] / values.sum()) <= 1e-9 for r in same)
            white[k, c - 1] = same[0].whitened
    assert len(got) == n * use
    want = centred @ vectors[:, :use] / np.sqrt(values[:use])
    sign = np.sign((white * want).sum(0))
    # an eigenvector is as well defined as its eigenvalue is apart from the next ones
    apart = np.minimum(np.abs(np.diff(values, prepend=np.inf)), np.abs(np.diff(values, append=-np.inf)))[:use]
    firm = apart > 1e-6 * values[0]
    assert firm.any() and np.abs(white * sign - want)[:, firm].max() < 1e-6
    error = np.abs(np.cov(white.T, bias=True).reshape(use, use) - np.eye(use)).max()
    assert all(abs(r.identity_error - error) < 1e-9 for r in got) and error <= 1e-4


def test_edges(spark):
    rng = np.random.default_rng(2)
    fine = [(k, (rng.normal(size=5) * [1, 2, 3, 4, 5]).tolist()) for k in range(60)]
    fine += [(7, fine[7][1]), (None, fine[8][1]), (61, fine[9][1])] + [(100 + k, fine[3][1]) for k in range(40)]
    odd = [(200, None), (201, []), (202, [None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] + [0.0] * 4),
           (205, [1.0, 2.0]), (206, [0.5] * 6)]
    d = spark.createDataFrame(fine + odd, "vec_id long, embedding array<double>") \
        .withColumns({"n": F.lit(1), "x": F.lit("a"), "component": F.lit(2)}).repartition(7)
    for fan_in in (2, 32):
        check(fine, wh.whiten(d, fan_in=fan_in).collect())
    check(fine, wh.whiten(d, components=2).collect(), 2)
    for none in (d.limit(0), d.filter("vec_id >= 200 and vec_id < 205"), d.filter("vec_id = 3")):
        assert wh.whiten(none).isEmpty()
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert wh.whiten(same).isEmpty()
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    check([(r.vec_id, r.embedding) for r in line.collect()], wh.whiten(line).collect())   # one component only


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check(rows, wh.query(spark, SF_SMALL).collect())
