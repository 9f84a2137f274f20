"""Embedding whitening against numpy's symmetric eigenvalues and whole numbers of any size."""

import math

import numpy as np
import pytest

from tidewheel.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x long, n long, component string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, 0, 1, 2, "c") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def plain(vectors, k=8):
    """(vectors that remain as whole numbers, exact deviations, eigenvalues, eigenvectors)."""
    good = [v for v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    y = np.array(x, float) - np.array([b / n for b in s])
    e, v = np.linalg.eigh(y.T @ y / n)
    return y, dev, e[::-1][:k], v[:, ::-1][:, :k]


@pytest.mark.parametrize("dims", [3, 12, 130])
def test_equals_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(200, dims)) * np.linspace(1, 3, dims)]
    awkward = [None, [], [None] * dims, [1.0, *[float("nan")] * (dims - 1)], [float("inf"), *[1.0] * (dims - 1)]]
    got = whiten(frame(spark, awkward + vectors)).collect()
    y, dev, e, v = plain(vectors)
    k = min(8, dims)
    assert len(got) == 200 * k and {r.vec_id for r in got} == set(range(5, 205)) and {r.n for r in got} == {200}
    white = y @ v / np.sqrt(e)
    mine = np.zeros((200, k))
    for r in got:
        mine[r.vec_id - 5, r.component - 1] = r.whitened
        assert r.deviation == dev[r.vec_id - 5] and r.deviation_exact == str(r.deviation)
        assert abs(r.explained / (e[r.component - 1] / (sum(dev) / 200**3)) - 1) < 1e-9
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-8
    off = np.abs((mine - mine.mean(0)).T @ (mine - mine.mean(0)) / 200 - np.eye(k)).max()
    assert off < 1e-9 and {r.identity_error for r in got}.pop() < 1e-9


def test_ties_repeats_and_ranks(spark):
    # two dimensions with variance, one without; repeated rows and ids, a null id
    vectors = [[1.0, 0.0, 5.0], [-1.0, 0.0, 5.0], [0.0, 1.0, 5.0], [0.0, -1.0, 5.0]] * 2
    got = whiten(frame(spark, vectors, [1, 1, None, 2, 3, 3, 3, 3])).collect()
    assert len(got) == 16 and {r.component for r in got} == {1, 2} and all(abs(r.explained - 0.5) < 1e-9 for r in got)
    assert sum(r.vec_id is None for r in got) == 2


def test_nothing_to_whiten(spark):
    for vectors in ([], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        got = whiten(frame(spark, vectors))
        assert got.collect() == [] and got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_and_other_lengths(spark):
    rng = np.random.default_rng(0)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(40, 2)) * 1e14]
    got = whiten(frame(spark, [*vectors, [1.0], [1e38, 0.0]])).collect()
    _, dev, _, _ = plain(vectors)
    assert {r.n for r in got} == {40} and all(r.deviation is None and r.deviation_exact == str(dev[r.vec_id]) for r in got)
    assert max(r.identity_error for r in got) < 1e-6
