"""Distances between a vector column and a query vector (or another column), as built-in expressions.

Against a literal vector of a few dimensions the sum is written out, which stays inside whole-stage code generation; longer ones would exceed
the size of a generated method, so that an Arrow function computes whole batches by matrix products. Pairs of columns use higher-order
functions. Vectors of unequal length raise an error in column pairs and give null against a literal. A null vector gives null. All
sums are in double precision."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions up to which a distance is written out term by term.
UNROLLED = 16
#: Names of the metrics.
METRICS = {
    "cosine": "cosine", "cos": "cosine", "cosine_normalized": "cosine_unit", "cosine_unit": "cosine_unit",
    "euclidean": "l2", "l2": "l2", "euclid": "l2", "squared_euclidean": "l2sq", "l2sq": "l2sq",
    "dot": "dot", "dotproduct": "dot", "dot_product": "dot", "inner_product": "dot", "ip": "dot",
    "manhattan": "l1", "l1": "l1", "taxicab": "l1", "hamming": "hamming",
    "chebyshev": "linf", "linf": "linf", "l_inf": "linf", "max": "linf",
}

Vector = Column | Sequence[float]


def metric(name: str) -> str:
    """The metric that a name in any case means."""
    found = METRICS.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown metric {name!r}; known are {', '.join(sorted(METRICS))}")
    return found


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _terms(v: Column, q: Vector, term) -> list[Column] | Column:
    if isinstance(q, Column):
        checked = F.when(F.size(v) == F.size(q), _double(v)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))
        return F.zip_with(checked, _double(q), term)
    if len(q) <= UNROLLED:
        return [term(F.get(v, F.lit(i)).cast("double"), F.lit(float(x))) for i, x in enumerate(q)]
    return F.zip_with(_double(v), F.array(*[F.lit(float(x)) for x in q]), term)


def _sum(terms: list[Column] | Column) -> Column:
    if isinstance(terms, list):
        return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _max(terms: list[Column] | Column) -> Column:
    if isinstance(terms, list):
        return F.greatest(F.lit(0.0), *terms)
    return F.coalesce(F.array_max(terms), F.lit(0.0))


def squares(v: Column, width: int | None = None) -> Column:
    """Sum of squares of a vector."""
    if width is not None and width <= UNROLLED:
        return _sum([F.get(v, F.lit(i)).cast("double") * F.get(v, F.lit(i)).cast("double") for i in range(width)])
    return F.aggregate(_double(v), F.lit(0.0), lambda a, x: a + x * x)


def dot(v: Column, q: Vector) -> Column:
    return _sum(_terms(v, q, lambda a, b: a * b))


def block_distances(kind: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances (query, row) between two matrices of doubles."""
    if kind in ("cosine", "cosine_unit", "dot"):
        product = queries @ rows.T
        if kind == "dot":
            return -product
        if kind == "cosine_unit":
            return 1 - product
        size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]
        return np.where(size == 0, 1.0, 1 - product / np.where(size == 0, 1, size))
    out = np.empty((len(queries), len(rows)))
    for i, q in enumerate(queries):
        apart = rows - q
        if kind in ("l2", "l2sq"):
            out[i] = np.einsum("ij,ij->i", apart, apart)
        elif kind == "l1":
            out[i] = np.abs(apart).sum(1)
        elif kind == "linf":
            out[i] = np.abs(apart).max(1, initial=0)
        else:
            out[i] = ((rows != 0) != (q != 0)).sum(1)
    return np.sqrt(out) if kind == "l2" else out


def _by_batch(kind: str, query: Sequence[float]):
    point = np.array([query], np.float64)

    @F.arrow_udf("double")
    def far(v: pa.Array) -> pa.Array:
        lengths = v.value_lengths().fill_null(-1).to_numpy()
        fits = lengths == point.shape[1]
        values = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, point.shape[1])
        out = np.full(len(v), np.nan)
        out[fits] = block_distances(kind, values, point)[0]
        return pa.array(out, mask=~fits)

    return far


def distance(name: str, v: Column, q: Vector) -> Column:
    """The distance of the metric ``name``; smaller is nearer. Cosine is 1 if either vector is zero; dot is negated."""
    kind = metric(name)
    if isinstance(q, Column):
        return _written_out(kind, v, q)
    if len(q) > UNROLLED:
        return _by_batch(kind, [float(x) for x in q])(v)
    return F.when(F.size(v) == len(q), _written_out(kind, v, q))


def _written_out(kind: str, v: Column, q: Vector) -> Column:
    width = None if isinstance(q, Column) else len(q)
    if kind == "cosine":
        own = squares(v, width)
        other = squares(q) if isinstance(q, Column) else F.lit(float(sum(x * x for x in q)))
        size = F.sqrt(own) * F.sqrt(other)
        return F.when(size == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(v, q) / F.nullif(size, F.lit(0.0)))
    if kind == "cosine_unit":
        return F.lit(1.0) - dot(v, q)
    if kind == "dot":
        return -dot(v, q)
    if kind in ("l2", "l2sq"):
        total = _sum(_terms(v, q, lambda a, b: (a - b) * (a - b)))
        return F.sqrt(total) if kind == "l2" else total
    if kind == "l1":
        return _sum(_terms(v, q, lambda a, b: F.abs(a - b)))
    if kind == "hamming":
        return _sum(_terms(v, q, lambda a, b: F.when((a != 0) != (b != 0), 1.0).otherwise(0.0)))
    return _max(_terms(v, q, lambda a, b: F.abs(a - b)))


def normalized(v: Column) -> Column:
    """The vector divided by its norm; a zero vector stays."""
    norm = F.sqrt(squares(v))
    return F.transform(_double(v), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def sound(v: Column, width: int) -> Column:
    """Whether a vector has the width and holds finite values only."""
    return F.coalesce((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
