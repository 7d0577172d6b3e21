import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candidata.llm import whitening
from candidata.llm.queries import QUERIES
from odd_data import SMALL

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def brute(rows, components=4):
    """(id, component) -> (n, deviation, |whitened|, explained), with plain numpy."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    mean = np.array([s / n for s in sums])
    centred = fit.astype(float) - mean
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    out = []
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(components):
            e, axis = values[-1 - k], axes[:, -1 - k]
            out.append((i, k + 1, n, deviation, abs((np.array(x, float) - mean) @ axis) / math.sqrt(e), e / covariance.trace()))
    return sorted(out)


def check(df, rows):
    found = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in df)
    want = brute(rows)
    assert [f[:4] for f in found] == [w[:4] for w in want]
    assert np.allclose([f[4:] for f in found], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    assert {r["identity_error"] for r in df}.pop() < 1e-10


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op12_whitening"](spark, SMALL).collect(), rows)


def vectors(n, d=6, seed=1, offset=0.0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)) * np.linspace(1, 4, d) + offset
    return [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def test_unusable_and_repeated_rows(spark):
    good = vectors(300)
    good += [(i + 1000, good[0][1]) for i in range(200)] + [good[3], good[3]]
    bad = [(None, None), (1, []), (2, [1.0] * 5 + [None]), (3, [math.nan] * 6), (4, [math.inf] * 6), (5, [-math.inf] + [0.0] * 5), (6, [1.0] * 7)]
    check(whitening.whiten(frame(spark, good + bad)).collect(), good)


def test_null_id_and_signs(spark):
    rows = vectors(100)
    found = whitening.whiten(frame(spark, rows + [(None, rows[0][1])])).collect()
    nulls = {r["component"]: r["whitened"] for r in found if r["vec_id"] is None}
    assert nulls == {r["component"]: r["whitened"] for r in found if r["vec_id"] == 0}
    for k in range(1, 5):
        assert abs(sum(r["whitened"] for r in found if r["component"] == k and r["vec_id"] is not None)) < 1e-8


def test_far_from_zero(spark):
    rows = vectors(200, offset=30_000.0)
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_deviation_beyond_64_bits_is_null(spark):
    rows = vectors(50, offset=0.0) + [(99, [1e6] * 6)]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert {r["deviation"] is None for r in found if r["vec_id"] == 99} == {True}
    assert {r["deviation"] is None for r in found if r["vec_id"] != 99} == {False}
    assert len(found) == 51 * 4
    saturated = whitening.whiten(frame(spark, vectors(50) + [(99, [3e38] * 6)])).collect()
    assert {r["vec_id"] for r in saturated} == {*range(50), 99}


def test_too_few_vectors(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    two = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9)), r["explained"]) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def planted(values, seed=0):
    """A symmetric matrix with these eigenvalues, and its eigenvectors in extended precision."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal to extended precision
        q = q @ (1.5 * np.eye(d) - 0.5 * (q.T @ q))
    return (q * np.array(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 2, 24),
        [1 + 1e-7 * k for k in range(12)],  # far below the resolution of float32
        [1, 1 + 1e-9, 1 + 2e-9, 2, 2 + 1e-8, 3, 1e-6, 1.1e-6, 0, 5],
        [10.0 ** -k for k in range(9)],
    ],
)
def test_refinement(values):
    matrix, q = planted(values)
    found, axes = whitening.refined_eigenvectors(matrix.astype(float))
    order = np.argsort(-np.asarray(values), kind="stable")
    want = q[:, order].astype(float)
    assert np.allclose(found, np.asarray(values)[order], atol=4e-15 * max(values))
    assert np.max(np.abs(axes.T @ axes - np.eye(len(found)))) < 1e-15 * len(found)
    # Rounding the matrix to doubles alone turns a vector by eps / gap.
    gaps = np.diff(np.sort(values)).min() / max(values)
    assert np.max(np.abs(np.abs((axes * want).sum(axis=0)) - 1)) < 1e-13
    assert np.max(np.minimum(np.abs(axes - want).max(axis=0), np.abs(axes + want).max(axis=0))) < 2e-15 * len(found) / gaps
    residual = matrix @ axes.astype(np.longdouble) - axes.astype(np.longdouble) * found.astype(np.longdouble)
    assert np.max(np.abs(residual)) < 2e-15 * max(values)


def test_refinement_of_equal_values():
    matrix, _ = planted([2, 2, 2, 1, 1, 0])
    values, axes = whitening.refined_eigenvectors(matrix.astype(float))
    assert np.allclose(values, [2, 2, 2, 1, 1, 0], atol=1e-14)
    assert np.max(np.abs((axes * values) @ axes.T - matrix.astype(float))) < 1e-14
    assert whitening.refined_eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_rows_are_whitened_in_tasks(spark):
    df = whitening.whiten(frame(spark, vectors(100)))
    assert df.select(F.count("*")).first()[0] == 400
