"""Whitening of embeddings by upper-triangle column aggregates.

Entries become whole numbers, floor(scale * c). The fit list is each distinct vector once. Spark SQL expressions, one
for each pair of dimensions i <= j, sum the centred products in one aggregation (in passes of ``PAIRS`` pairs where
there are more); the driver assembles the covariance from these sums, of a number fixed by the dimensions alone, and
LAPACK decomposes it. Rows are projected and scaled by built-in functions, and the covariance of the whitened fit list
is measured against the identity.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped; a null id is kept;
repeated rows and vectors are whitened each and fitted once; vectors of differing lengths are an error; of fewer
dimensions than ``components`` all are returned; a component without variance (up to rounding) cannot be whitened:
its ``whitened`` is null and it takes no part in ``identity_error``; without any variance ``explained`` is null; equal
eigenvalues share a plane, in which any orthonormal pair is right; an empty table gives no row; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.storage import materialise

#: Sums of products in one aggregation: all pairs of up to 90 dimensions.
PAIRS = 4096


@dataclass
class Fit:
    """n distinct vectors, their sums by dimension, eigenvalues from the largest down and components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def usable(self, component: int) -> bool:
        return bool(self.values[component] > len(self.sums) * np.finfo(float).eps * self.values[0])


def whole_vectors(rows: DataFrame, vec_id: str, column: str, scale: int) -> DataFrame:
    """(vec_id, x): the rows whose vector has entries, all of them finite, as whole numbers."""
    entries = F.col(column).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(F.col(column).isNotNull() & (F.size(column) > 0) & finite)
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(entries, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def covariance(fitted: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance, divisor n, of the vectors ``x`` of ``fitted``."""
    d = len(sums)
    centred = fitted.select(*((F.col("x")[i].cast("double") - F.lit(sums[i] / n)).alias(f"c{i}") for i in range(d)))
    pairs, found = list(combinations_with_replacement(range(d), 2)), np.zeros((d, d))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        row = centred.agg(*(F.expr(f"sum(c{i} * c{j})").alias(f"s{k}") for k, (i, j) in enumerate(some))).first()
        for (i, j), s in zip(some, row, strict=True):
            found[i, j] = found[j, i] = s / n
    return found


def fit(fitted: DataFrame) -> Fit | None:
    """Fit on the distinct vectors ``x``; None if there are none."""
    size = fitted.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not size["n"]:
        return None
    if size["least"] != size["most"]:
        raise ValueError(f"vectors have from {size['least']} to {size['most']} entries")
    sums = list(fitted.agg(*(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size["most"]))).first())
    values, vectors = np.linalg.eigh(covariance(fitted, size["n"], sums))
    values, vectors = values[::-1], vectors[:, ::-1]
    # Either sign is right; this one does not depend on the library.
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(sums))]
    return Fit(size["n"], sums, values, vectors * np.where(largest < 0, -1.0, 1.0))


def projected(found: Fit, component: int) -> Column:
    """The centred ``x`` on a component, over the root of its eigenvalue; null where that is zero."""
    if not found.usable(component):
        return F.lit(None).cast("double")
    centred = F.zip_with("x", F.array(*map(F.lit, found.means)), lambda a, m: a.cast("double") - m)
    products = F.zip_with(centred, F.array(*(F.lit(float(v)) for v in found.vectors[:, component])), lambda a, v: a * v)
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p) / F.lit(float(np.sqrt(found.values[component])))


def deviation(found: Fit) -> Column:
    """Sum over dimensions of (n x - S)^2 as an exact decimal: n^2 sum(x^2) - 2 n sum(x S) + sum(S^2)."""
    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    squares = F.aggregate(F.transform("x", lambda a: a * a), F.lit(0).cast("long"), lambda s, a: s + a)
    mixed = F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in found.sums)), lambda a, s: a * s)
    crossed = F.aggregate(mixed, F.lit(0).cast("long"), lambda s, a: s + a)
    exact = lambda c: c.cast("decimal(38,0)")
    return (exact(squares) * whole(found.n**2) - exact(crossed) * whole(2 * found.n) + whole(sum(s * s for s in found.sums))).cast("decimal(38,0)")


def identity_error(fitted: DataFrame, found: Fit, components: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    used = [k for k in range(components) if found.usable(k)]
    if not used:
        return 0.0
    white = fitted.select(*(projected(found, k).alias(f"w{k}") for k in used))
    pairs = list(combinations_with_replacement(used, 2))
    row = white.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"v{i}_{j}") for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, row, strict=True))


def whiten(rows: DataFrame, vec_id: str = "vec_id", column: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation (exact decimal), whitened, explained and identity_error for each usable row and
    component."""
    usable = whole_vectors(rows, vec_id, column, scale)
    # A distinct vector is gathered once, and read for sums, products and the check.
    fitted = materialise(usable.select("x").distinct(), "whitening-fit")
    found = fit(fitted)
    schema = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if found is None:
        return usable.where("false").select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))))
    few = min(components, len(found.sums))
    error, trace = identity_error(fitted, found, few), float(found.values.sum())
    each = [
        F.struct(
            F.lit(k + 1).alias("component"),
            projected(found, k).alias("whitened"),
            F.lit(float(found.values[k]) / trace if found.usable(k) else 0.0 if trace > 0 else None).cast("double").alias("explained"),
        )
        for k in range(few)
    ]
    out = usable.select("vec_id", deviation(found).alias("deviation"), F.explode(F.array(*each)).alias("c"))
    return out.select("vec_id", "c.component", F.lit(found.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
