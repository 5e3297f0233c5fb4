"""Whitening against exact sums and numpy's eigenvectors."""

import math

import numpy as np
import pytest

from sitegrain.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Per row of (vec_id, vector): n, deviation, and the whole eigensystem of the fit list."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], np.float64) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, e[::-1], u[:, ::-1]


def check(got, rows, components=16):
    kept, n, sums, e, u = brute(rows)
    width = min(components, int((e > e[0] * 1e-11).sum()))
    assert len(got) == len(kept) * width
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), []).append(r)
    want = {}
    for i, x in kept:
        want.setdefault((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))), []).append(x)
    assert {k: len(v) for k, v in by_row.items()} == {k: len(v) * width for k, v in want.items()}
    gaps = [min(abs(e[i] - e[j]) for j in (i - 1, i + 1) if 0 <= j < len(e)) if len(e) > 1 else e[0] for i in range(width)]
    sign = {}
    for key, xs in want.items():
        if len(xs) > 1 and len({tuple(x) for x in xs}) > 1:
            continue
        mine = {r.component: r for r in by_row[key]}
        assert sorted(mine) == list(range(1, width + 1))
        for k, r in mine.items():
            value = sum((n * a - s) / n * c for a, s, c in zip(xs[0], sums, u[:, k - 1])) / math.sqrt(e[k - 1])
            if abs(value) > 1e-6:
                assert sign.setdefault(k, math.copysign(1, value * r.whitened)) == math.copysign(1, value * r.whitened)
            assert abs(abs(r.whitened) - abs(value)) < (1e-9 + 1e-13 * e[0] / gaps[k - 1]) * max(1, abs(value))  # rounding of the covariance turns a component by so much
            assert r.n == n and abs(r.explained / (e[k - 1] / e.sum()) - 1) < 1e-4 and r.identity_error < 1e-4


@pytest.mark.parametrize("dims,falling", [(24, 0.5), (40, 0.2), (40, 0.999), (3, 0.9), (1, 1)])
def test_agrees_with_numpy(spark, dims, falling):
    """Steep spectra settle within the block, flat ones need all dimensions."""
    draw = np.random.default_rng(dims)
    x = draw.standard_normal((300, dims)) * 40 * falling ** np.arange(dims) @ np.linalg.qr(draw.standard_normal((dims, dims)))[0] + 7
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += rows[:40] + [(None, rows[3][1]), (900, None), (901, [math.nan] * dims), (902, [math.inf] * dims), (903, [None] * dims)]
    table = spark.createDataFrame([(i, v, "a", "b", 1.5) for i, v in rows], "vec_id long, embedding array<float>, x string, n string, whitened double").repartition(5)
    out = whitening.whiten(table)
    assert out.columns == ["vec_id", "embedding", "x", "n", "whitened", "_n", "deviation", "_whitened", "explained", "identity_error"]
    assert {(r.x, r.n, r.whitened) for r in out.collect()} == {("a", "b", 1.5)}
    check(whitening.digest(whitening.whiten(table.select("vec_id", "embedding"))).collect(), rows)


def test_block_and_whole(spark):
    """What the block finds where the spectrum is steep is what the whole covariance gives."""
    draw = np.random.default_rng(0)
    x = np.floor(draw.standard_normal((500, 60)) * np.concatenate([1000 * 0.6 ** np.arange(12), np.full(48, 0.01)])).astype(int)
    rows = spark.createDataFrame([(v.tolist(),) for v in np.unique(x, axis=0)], "x array<long>").repartition(3)
    steps = []
    summed, whitening._summed = whitening._summed, lambda *a: steps.append(1) or summed(*a)
    try:
        block = whitening.fit(rows, 60, 4, passes=40)
        assert len(steps) < 42
        whole = whitening.fit(rows, 60, 4, passes=0)
    finally:
        whitening._summed = summed
    assert np.allclose(np.abs(np.sum(block.components * whole.components, 0)), 1, atol=1e-12) and np.allclose(block.eigenvalues, whole.eigenvalues, rtol=1e-12)


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    empty = whitening.whiten(make([]))
    assert empty.columns == ["vec_id", "embedding", "n", "deviation", "whitened", "explained", "identity_error"] and not empty.collect()
    same = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened) for r in sorted(same)] == [(1, 1, 0, []), (2, 1, 0, [])]
    mixed = whitening.whiten(make([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, []), (4, [5.0]), (5, [6.0]), (6, None)])).collect()
    assert {r.vec_id: (r.n, len(r.whitened)) for r in mixed} == {1: (2, 1), 2: (2, 1), 3: (1, 0), 4: (2, 1), 5: (2, 1)}
    assert {r.vec_id: r.deviation for r in mixed}[4] == 64 * 64
    huge = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0])])).collect()
    assert {r.deviation for r in huge} == {(1 << 63) - 1}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op11_embedding_whitening(spark, SF).collect(), rows)
