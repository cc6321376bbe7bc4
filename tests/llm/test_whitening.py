from math import floor

import numpy as np
import pytest

from feedloom.llm import whitening


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 64, 130])
def test_polar_factor(size):
    a = symmetric(np.linspace(-3, 4, size) + 0.01, size)
    u = whitening.polar(a)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(u - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12
    assert whitening.polar(np.zeros((size, size))) is None


SPECTRA = {
    "falling": 1.0 / np.arange(1, 65) ** 2,
    "wide": 10.0 ** -np.arange(0, 24, 0.5),
    "one large": np.r_[1e6, np.ones(30) * 1e-3],
    "pairs": np.repeat([5.0, 3.0, 2.0, 1.0], 5),
    "mean is a value": np.array([0.0, 1.0, 2.0]),
    "near ties": 1 + 1e-9 * np.arange(20),
    "rank two": np.r_[3.0, 1.0, np.zeros(12)],
    "all equal": np.full(6, 2.5),
    "nothing": np.zeros(4),
    "one": np.array([7.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("wanted", [1, 4, 100])
def test_components_equal_eigh(name, wanted):
    spectrum = np.sort(SPECTRA[name])[::-1]
    a = symmetric(spectrum, 7)
    values, vectors = whitening.components(a, wanted)
    k, top = min(wanted, len(a)), max(spectrum[0], 1e-300)
    assert vectors.shape == (len(a), k)
    assert np.abs(values - spectrum[:k]).max() <= 1e-13 * top * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13 * len(a)
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-13 * top * len(a)


def brute(rows):
    """By plain numbers and numpy's eigh: {(vec_id, component): row}, n."""
    kept = [(i, [floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, size = len(distinct), len(distinct[0])
    sums = [sum(x[d] for x in distinct) for d in range(size)]
    centred = np.array(distinct, float) - np.array(sums) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = []
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(4, size)):
            out.append((i, k + 1, n, deviation, abs((np.array(x) - np.array(sums) / n) @ vectors[:, k]) / np.sqrt(values[k]), values[k] / np.trace(covariance)))
    return out


def test_rows_equal_plain_numbers(spark):
    rng = np.random.default_rng(1)
    base = (rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)).astype("f4")
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(7, rows[3][1]), (None, rows[4][1])]
    rows += [(2000, None), (2001, [None] + [0.5] * 11), (2002, [float("nan")] * 12), (2003, [float("-inf")] + [0.0] * 11), (2004, [-0.0] * 12)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int")
    found = whitening.whiten(table.repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(map(tuple, found), key=key), sorted(brute(rows), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([abs(g[4]) for g in got], [w[4] for w in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-10)
    assert {g[6] for g in got} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9
    # One sign for all rows of a component.
    first = {k: [g[4] for g in got if g[1] == k and g[0] is not None and g[0] >= 1000 and g[0] < 1050] for k in range(1, 5)}
    assert all(len(v) == 50 and np.ptp(v) < 1e-12 for v in first.values())


def test_lengths_apart_flat_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 2.0]), (2, [1.5, 0.25]), (3, [4.0, 4.0]), (4, [0.5]), (5, [0.75]), (6, []), (7, [1e300, 0.0, 1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in found) == [
        *((i, k, 3) for i in (1, 2, 3) for k in (1, 2)), (4, 1, 2), (5, 1, 2), (7, 1, 1), (7, 2, 1), (7, 3, 1),
    ]
    assert all(r["identity_error"] < 1e-9 for r in found if r["vec_id"] < 6)
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted((r["component"], r["explained"], abs(r["whitened"]) if r["whitened"] else None) for r in flat) == [(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 0.0, None), (2, 0.0, None)]
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
