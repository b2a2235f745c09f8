import math

import numpy as np
import pytest

from riskfabric.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"


def _plain(vectors, count=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = ((n * x - sums) / n).astype(float)
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1][:count], q[:, ::-1][:, :count]
    return deviation, centred @ q / np.sqrt(values), values / (centred**2).sum() * n


def _held(rows, keys, vectors, count=8, close=1e-7):
    deviation, whitened, explained = _plain(vectors, count)
    found = {}
    for r in rows:
        found.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for i, key in enumerate(keys):
        for k in range(count):
            r = found[key, k + 1][0]
            sign.setdefault(k, np.sign(r.whitened * whitened[i, k]))
            assert r.n == len(vectors) and r.deviation == deviation[i]
            assert abs(r.whitened * sign[k] - whitened[i, k]) < close and abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9
    assert len(rows) == len(keys) * count


def test_op12_equals_a_full_decomposition(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    good = [(r.vec_id, r.embedding) for r in table if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    _held(queries.op12_embedding_whitening(spark, FOLDER).collect(), [k for k, _ in good], [v for _, v in good])


@pytest.mark.parametrize("width", [3, 8, 40, 100])
def test_filters_find_flat_and_steep_spectra(spark, width):
    rng = np.random.default_rng(width)
    for scales in (np.linspace(1, 0.7, width), np.geomspace(1, 1e-2, width)):
        vectors = (rng.standard_normal((300, width)) * scales).tolist()
        rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
        _held(whitening.whiten(rows).collect(), range(300), vectors, min(8, width))


def test_many_partial_sums_are_added_in_two_steps(spark):
    vectors = np.random.default_rng(1).standard_normal((400, 6)).tolist()
    fit = whitening.Fit(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(80))
    fit.parts = 80
    x = np.floor(1024 * np.array(vectors)) + 100_000
    assert np.allclose(fit.product(np.eye(6)), np.cov(x.T, bias=True), rtol=1e-12)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [2.0, 1.0], [0.5, 0.25], [0.5, 0.25], [1e300, 1.0], [nan, 1.0], [inf, 1.0], [1.0, None], None, [], [1.0, 2.0, 3.0]]
    rows = spark.createDataFrame([(None if i == 2 else i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, component string")
    got = whitening.whiten(rows).collect()
    assert sorted({-1 if r.vec_id is None else r.vec_id for r in got}) == [-1, 0, 1, 3] and len(got) == 8 and {r.n for r in got} == {4}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(1)).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_deviations_beyond_a_long_are_missing():
    x = np.array([[1 << 50, 0], [0, 0]], np.int64)
    assert whitening._deviations(x, 2, x.sum(axis=0)) == [None, None]
    assert whitening._deviations(x // (1 << 20), 2, x.sum(axis=0) // (1 << 20)) == [1 << 60, 1 << 60]
