"""Whitening against plain whole numbers and numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from labelloom.llm import whitening as wt

SCHEMA = "vec_id bigint, embedding array<float>, component string, n string, _key int"


def brute(vectors, dims):
    """n, sums, and n * sum(x * y) - sum(x) * sum(y), in Python numbers."""
    xs = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (dims - len(v)) for v in vectors]
    n = len(xs)
    sums = [sum(x[j] for x in xs) for j in range(dims)]
    cov = [[n * sum(x[i] * x[j] for x in xs) - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    return xs, n, sums, cov


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, "c", "n", 1) for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize("least, most", [(0, 1), (-5, 5), (0, 0), (-(2**40), 2**40), (2**61 - 9, 2**61)])
def test_plane_products_are_exact(least, most):
    draw = random.Random(most)
    for rows in (1, 63, 64, 65, 300):
        values = [[draw.randint(least, most) for _ in range(4)] for _ in range(rows)]
        values[0][2] = least
        totals = wt.Products()
        totals.add(np.array(values[:40], np.int64))
        totals.add(np.array(values[40:], np.int64).reshape(-1, 4))
        assert totals.rows == rows
        for i in range(4):
            assert totals.sums[i] == sum(v[i] for v in values)
            for j in range(i, 4):
                assert totals.products[i, j] == sum(v[i] * v[j] for v in values)


def test_planes_hold_the_bits():
    shifted = np.array([[draw % 13, 0, draw % 2] for draw in range(100)], np.uint64)
    planes, dimension, bits = wt.bit_planes(shifted)
    assert list(zip(dimension, bits)) == [(0, 0), (0, 1), (0, 2), (0, 3), (2, 0)]
    for plane, dim, bit in zip(planes, dimension, bits):
        assert int(np.bitwise_count(plane).sum()) == sum(int(x) >> bit & 1 for x in shifted[:, dim])


def test_shorter_vectors_are_filled_up():
    vectors = pa.array([[1.5], [], [-0.001, 2.0]], pa.list_(pa.float64()))
    assert wt.whole_numbers(vectors, 1024).tolist() == [[1536, 0], [0, 0], [-2, 2048]]
    assert wt.whole_numbers(vectors.slice(1), 1024, 3).tolist() == [[0, 0, 0], [-2, 2048, 0]]
    with pytest.raises(OverflowError):
        wt.whole_numbers(pa.array([[1e300]]), 1024)


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_numpy(spark, partitions):
    draw = np.random.default_rng(1)
    mixed = draw.normal(0, 0.3, (400, 12)) @ draw.normal(0, 1, (12, 12))
    vectors = [list(map(float, np.float32(v))) for v in mixed]
    vectors += [vectors[0]] * 30 + [vectors[1][:5], []]
    df = rows_of(spark, vectors)
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (903, [float("-inf")] * 12)]
    df = df.unionByName(spark.createDataFrame([(k, v, "c", "n", 1) for k, v in bad], SCHEMA))
    df = df.unionByName(spark.createDataFrame([(None, vectors[2], "c", "n", 1)], SCHEMA))
    got = wt.whiten(df.repartition(partitions), components=8).collect()
    vectors.append(vectors[2])
    xs, n, sums, cov = brute(vectors, 12)
    assert len(got) == n * 8 and {r.n for r in got} == {n}
    deviation = {i: sum((n * x - s) ** 2 for x, s in zip(xs[i], sums)) for i in range(n)}
    matrix = np.array([[c / n**2 for c in row] for row in cov])
    values, directions = np.linalg.eigh(matrix)
    assert {r.vec_id for r in got} == {None, *range(n - 1)}
    whitened = np.zeros((n, 8))
    for r in got:
        at = n - 1 if r.vec_id is None else r.vec_id
        whitened[at, r.component - 1] = r.whitened
        assert int(r.deviation) == deviation[at]
        assert r.explained == pytest.approx(values[-r.component] / matrix.trace(), rel=1e-9)
        assert r.identity_error < 1e-9
    centred = np.array([[n * a - s for a, s in zip(x, sums)] for x in xs], float) / n
    for c in range(8):
        want = centred @ directions[:, -1 - c] / math.sqrt(values[-1 - c])
        assert np.allclose(whitened[:, c], want, atol=1e-8) or np.allclose(whitened[:, c], -want, atol=1e-8)


def test_what_has_no_variance_is_left_out(spark):
    flat = [[0.5, x / 8, 0.25 + x / 4] for x in range(16)]
    got = wt.whiten(rows_of(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 16
    assert got[0].explained == pytest.approx(1.0)
    for vectors in ([[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]], [], [None]):
        assert wt.whiten(rows_of(spark, vectors)).collect() == []


def test_large_numbers_stay_exact(spark):
    vectors = [[1e9, 0.5], [-1e9, 0.25], [3.0, -7e8]]
    xs, n, sums, _ = brute([list(np.float32(v).astype(float)) for v in vectors], 2)
    got = {r.vec_id: int(r.deviation) for r in wt.whiten(rows_of(spark, vectors)).collect()}
    assert got == {i: sum((n * x - s) ** 2 for x, s in zip(xs[i], sums)) for i in range(n)}
