"""Whitening of embeddings by principal components that are refined beyond working precision.

Spark sums moments per partition; the driver sees a number per dimension and one per pair of
dimensions. The eigenvectors of the covariance come from a float32 solver and are corrected by
the iteration of Ogita and Aishima, which needs matrix products only and doubles the correct
digits each time. Eigenvalues too close for it are told apart by solving the small shifted
problem of their cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidata.cluster import written

WIDE = np.longdouble


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction of approximate eigenvectors: (vectors, values, size of the change, gap below
    which two values cannot be told apart)."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    # Exactly symmetric, as a change that is not antisymmetric would cost orthogonality.
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    gap = 2 * (np.linalg.norm(off.astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= gap
    change = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
    return x + x @ change, values, float(np.max(np.abs(change), initial=0)), float(gap)


def _clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of two or more of the rising values whose neighbours are no further apart than `gap`."""
    cuts = np.flatnonzero(np.diff(values) > gap) + 1
    bounds = [0, *cuts.tolist(), len(values)]
    return [slice(i, j) for i, j in zip(bounds, bounds[1:]) if j - i > 1]


def refined_eigenvectors(matrix: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix, to double precision.

    float32 eigenvectors are corrected in float64, then in extended precision, until a round
    changes no less than the one before it. After each round, the vectors of a cluster are turned by the
    eigenvectors of X'(A - mu I)X, the cluster's own small problem, in which the shift mu leaves the
    differences of its values. A cluster of equal values keeps any orthonormal basis.
    The largest entry of a vector is positive.
    """
    d = len(matrix)
    scale = float(np.max(np.abs(matrix), initial=0)) or 1.0
    a = matrix.astype(np.float64) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    for kind in (np.float64, WIDE):
        a, x = a.astype(kind), x.astype(kind)
        # Below this, values differ by no more than the rounding of their matrix.
        floor = 8 * d**1.5 * float(np.finfo(kind).eps)
        before = math.inf
        for _ in range(rounds):
            x, values, change, gap = _step(a, x)
            order = np.argsort(values, kind="stable")
            x, values = x[:, order], values[order]
            close = [c for c in _clusters(values, gap) if gap > floor or values[c][-1] - values[c][0] > floor]
            for part in close:
                mine, mu = x[:, part], values[part].mean()
                small = mine.T @ (a @ mine - mu * mine)
                size = float(np.max(np.abs(small))) or 1.0
                small = ((small + small.T) / 2 / size).astype(np.float64)
                x[:, part] = mine @ np.linalg.eigh(small)[1].astype(kind)
            if not close and (change <= floor or change > before / 2):
                break
            before = change
    x, values = _step(a, x)[:2]
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    x = x / np.sqrt((x * x).sum(axis=0))
    top = x[np.argmax(np.abs(x), axis=0), np.arange(d)] if d else np.empty(0)
    return (values * scale).astype(np.float64), np.where(top < 0, -x, x).astype(np.float64)


def integer_vectors(rows: DataFrame, id: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, __x): the entries as whole numbers floor(scale * entry).

    Rows whose vector is null or empty, or holds a null or non-finite entry, are left out, and
    so are those of another length than most rows have (the longer one at a tie). Entries
    beyond 64 bits take the nearest 64-bit number.
    """
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    good = rows.filter((F.size(vector) > 0) & finite)
    sizes = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    return good.filter(F.size(vector) == (sizes["d"] if sizes else 0)).select(F.col(id), whole.alias("__x"))


def _matrix(batch: pa.RecordBatch, name: str = "__x") -> np.ndarray:
    column = batch.column(batch.schema.names.index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _whole_sum(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if not len(x) or max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 2**62:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                sums = _whole_sum(_matrix(batch))
                n, total = n + batch.num_rows, [a + b for a, b in zip(total or [0] * len(sums), sums)]
        if n:
            sums = pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), sums], names=["i", "v"])

    rows = fit.mapInArrow(partial, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    sums = {r["i"]: int(r["v"]) for r in rows}
    return sums.pop(-1, 0), [sums[i] for i in range(len(sums))]


class Centred:
    """Rows minus the exact mean S/n, rounded once."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.near = np.array([round(s / n) for s in sums], np.int64)
        self.rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, self.near)])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 per row, exact; null where it passes 64 bits."""
        bound = float(np.max(np.abs(self.of(x)), initial=0)) * self.n
        if bound * bound * max(1, x.shape[1]) < 2**62 and np.max(np.abs(x), initial=0) * self.n < 2**62:
            y = x * self.n - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v < 2**63 else None for v in (y * y).sum(axis=1).tolist()]


def product_sums(fit: DataFrame, of: Centred, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred rows, or of their projection on the given columns."""
    d = len(of.sums) if project is None else project.shape[1]
    i, j = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            c = of.of(_matrix(batch)) if batch.num_rows else np.zeros((0, len(of.sums)))
            c = c if project is None else c @ project
            total += c.T @ c
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"]
        )

    rows = fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / of.n
    return out


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row.

    The fit is over the different whole-number vectors: n of them, their mean, covariance and its
    first `components` eigenvectors. A component without variance (a share of 1e-13 of the
    trace or less) is left out. identity_error is measured on the whitened fit list itself.

    Unusable rows are those `integer_vectors` leaves out. A null id is an id; equal rows are
    whitened each, and weigh once in the fit however many there are; equal eigenvalues give any
    basis, the same for all rows. Other columns are not passed on. A table without usable rows, or
    with one vector only, gives an empty result. Vectors have no text; their length bounds
    what the driver holds, the number of rows does not.
    """
    kind = rows.schema[id].dataType
    schema = (
        f"`{id}` {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    vectors = written(integer_vectors(rows, id, vector), "vectors")
    fit = written(vectors.select("__x").distinct(), "fit")
    n, sums = column_sums(fit)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    of = Centred(n, sums)
    covariance = product_sums(fit, of)
    values, axes = refined_eigenvectors(covariance)
    trace = float(np.trace(covariance))
    kept = [k for k in range(min(components, len(values))) if values[k] > 1e-13 * trace]
    if not kept:
        return rows.sparkSession.createDataFrame([], schema)
    project = axes[:, kept] / np.sqrt(values[kept])
    error = float(np.max(np.abs(product_sums(fit, of, project) - np.eye(len(kept)))))

    def project_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, k = _matrix(batch), len(kept)
            whitened = of.of(x) @ project
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.array(kept, np.int32) + 1, len(x))),
                    pa.array(np.full(len(x) * k, n, np.int64)),
                    pa.array(of.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(values[kept] / trace, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project_rows, schema)
