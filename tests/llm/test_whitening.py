import math
import random

import numpy as np
import pytest

from auditflow.llm import whitening
from auditflow.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n long, d long, x string, ids string, component int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, None, None, None, "x", "i", None) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def by_hand(vectors, wanted=8):
    """Components by a full eigenvalue decomposition, deviations with whole numbers."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    centred = np.array([[v - s / n for v, s in zip(row, sums, strict=True)] for row in x])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    m = min(wanted, int((e > 1e-12 * e.sum()).sum()))
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return centred @ q[:, :m] / np.sqrt(e[:m]), e[:m] / e.sum(), deviation


def check(spark, vectors, close=1e-7):
    got = sorted(whitening.whiten(table(spark, vectors)).collect(), key=lambda r: (r.vec_id, r.component))
    white, explained, deviation = by_hand(vectors)
    m = white.shape[1]
    assert len(got) == len(vectors) * m
    mine = np.array([r.whitened for r in got]).reshape(-1, m)
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < close
    assert [r.deviation for r in got] == [d for d in deviation for _ in range(m)]
    assert np.allclose([r.explained for r in got[:m]], explained, rtol=1e-9)
    assert {r.n for r in got} == {len(vectors)} and got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1


def random_vectors(n, d, seed=1):
    rnd = np.random.default_rng(seed)
    return (rnd.standard_normal((n, d)) * np.linspace(3, 0.2, d) @ np.linalg.qr(rnd.standard_normal((d, d)))[0]).tolist()


@pytest.mark.parametrize(("n", "d"), [(300, 16), (40, 3), (12, 20), (200, 1)])
def test_against_brute_force(spark, n, d):
    check(spark, random_vectors(n, d))


def test_repeated_rows(spark):
    check(spark, random_vectors(60, 10) * 3)


def test_equal_eigenvalues(spark):
    """Along the axes, two values each: the components are any basis, but they must whiten."""
    vectors = [[s * (k == j) for j in range(6)] for k in range(6) for s in (1.0, -1.0)]
    got = whitening.whiten(table(spark, vectors)).collect()
    assert len(got) == 12 * 6 and got[0].identity_error < 1e-9
    assert np.allclose([r.explained for r in got], 1 / 6)


def test_low_rank(spark):
    base = np.array(random_vectors(2, 12))
    vectors = (np.round(np.random.default_rng(2).integers(-50, 50, (80, 2)) @ np.round(base))).tolist()
    check(spark, vectors)
    assert {r.component for r in whitening.whiten(table(spark, vectors)).collect()} == {1, 2}


def test_unusable_vectors_are_dropped(spark):
    good = random_vectors(50, 5)
    rows = good + [None, [], [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    ids = [*range(48), None, 3, *range(100, 106)]
    got = whitening.whiten(table(spark, rows, ids)).collect()
    assert len(got) == 50 * 5 and {r.vec_id for r in got} == {*range(48), None} and {r.n for r in got} == {50}


def test_nothing_varies_or_nothing_there(spark):
    for rows in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 7, [[]]):
        assert whitening.whiten(table(spark, rows)).collect() == []


def test_huge_entries(spark):
    random.seed(4)
    rows = [[random.uniform(-1, 1) * 1e15, 1.0] for _ in range(20)] + [[1e300, 1.0], [-1e300, 2.0]]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.deviation for r in got} == {None} and got[0].identity_error < 1e-9
    check(spark, [[random.randint(0, 9) * 1000.5, 1.0 * k] for k in range(20)])


def test_query(spark):
    got = op13_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").toPandas()
    white, explained, deviation = by_hand([list(map(float, v)) for v in vectors.embedding])
    got = got.sort_values(["vec_id", "component"])
    mine = got.whitened.to_numpy().reshape(-1, 8)
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-7
    assert got.deviation.tolist() == [d for d in deviation for _ in range(8)]
    assert np.allclose(got.explained.to_numpy()[:8], explained, rtol=1e-9) and got.identity_error.max() < 1e-4
