"""Operator 11: whitening of embeddings by a randomised range finder.

Vectors become whole numbers, and the fit list is each distinct one once. A random block of a
few more columns than components is multiplied by the covariance again and again: each power
pass reads all centred rows, and a task hands on one block of dimensions x columns. After each
pass the covariance is solved within the block's span (Rayleigh-Ritz). Where the residuals, set
against the gaps between eigenvalues, do not fall to rounding, the block is widened to all
dimensions, and one pass more gives the whole covariance.

Rows never leave their tasks; the driver holds blocks of the model's size alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import masked, materialize, release, spare

#: Components beyond these count as these; sums of them over any table stay below 128 bits.
MOST = 1 << 62
LONG = (1 << 63) - 1
#: Partial results are merged in so many tasks before the driver adds them up.
SLOTS = 64
#: Eigenvalues below this share of the greatest are rounding: such directions have no variance.
NULL_SHARE = 1e-11


def whole_numbers(vector: str = "embedding", scale: int = 64, offset: int = 1_000_000):
    """Column of floor(scale * entry) + offset; null where the vector or an entry is null or not finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda c: F.greatest(F.least(F.floor(F.lit(float(scale)) * c.cast("double")), F.lit(MOST - offset)), F.lit(-MOST)) + offset)
    return F.when(F.col(vector).isNotNull() & finite, whole)


@dataclass(frozen=True)
class Whitening:
    """A fit: list size, exact sums, unit components as columns, eigenvalues, trace and how far whitened vectors are from the identity."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def floors(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rests(self) -> np.ndarray:
        """What the mean is above ``floors``, to the last bit."""
        return np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean: whole numbers are subtracted before anything is rounded."""
        return (x - self.floors).astype(np.float64) - self.rests

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact sums over dimensions of (n * x - S)^2; beyond long they count as its end."""
        rests = np.array([s % self.n for s in self.sums], np.int64)
        away = x - self.floors
        widest = int(np.abs(away).max(initial=0)) * self.n + self.n
        if widest * widest * max(1, x.shape[1]) <= LONG:
            return ((self.n * away - rests) ** 2).sum(1)
        exact = ((self.n * away.astype(object) - rests.astype(object)) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), object)
        return np.array([min(LONG, int(s)) for s in exact], np.int64)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _summed(rows: DataFrame, dims: int, part: Callable[[np.ndarray], tuple]) -> tuple:
    """Sums of ``part``'s arrays over all rows of ``rows`` (column x).

    A task adds up its batches, tasks are merged in ``SLOTS`` groups, in the order of their
    numbers, and the driver adds up what those give.
    """

    def add(a: tuple | None, b: tuple) -> tuple:
        return b if a is None else tuple(x + y for x, y in zip(a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = add(total, part(_matrix(batch, dims)))
        if total is not None:
            at = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([at % SLOTS], pa.int32()), pa.array([at], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], names=["slot", "at", "part"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for held in group.sort_values("at")["part"]:
            total = add(total, pickle.loads(held))
        return pd.DataFrame({"slot": group["slot"].iloc[:1], "part": [pickle.dumps(total)]})

    parts = rows.select("x").mapInArrow(run, "slot int, at int, part binary").groupBy("slot").applyInPandas(merge, "slot int, part binary")
    total = None
    for row in sorted(parts.collect()):
        total = add(total, pickle.loads(row.part))
    return total


def _counted(x: np.ndarray) -> tuple:
    """Rows and exact sums: halves of 32 bits are added up as long, and joined as whole numbers of any size."""
    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return len(x), np.array([(int(h) << 32) + int(l) for h, l in zip(high, low)], object)


def _ritz(q: np.ndarray, z: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenpairs of the covariance within span(q), given z, its product with q, and the worst bound on a component's angle."""
    inner = q.T @ z
    e, u = np.linalg.eigh((inner + inner.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    kept = min(components, len(e))
    vectors, values = q @ u[:, :kept], e[:kept]
    residual = np.linalg.norm(z @ u[:, :kept] - vectors * values, axis=0)
    gaps = [min((abs(values[i] - e[j]) for j in (i - 1, i + 1) if 0 <= j < len(e)), default=abs(values[i])) for i in range(kept)]
    angle = max((r / max(g, np.finfo(float).tiny) for r, g in zip(residual, gaps)), default=0.0)
    return vectors, values, float(angle)


def fit(rows: DataFrame, dims: int, components: int = 16, oversample: int = 10, passes: int = 6, tolerance: float = 1e-12, seed: int = 11) -> Whitening | None:
    """Fit on ``rows`` (column x, distinct, all of ``dims`` entries); None where there are none.

    ``passes`` power passes are made over a block of ``components + oversample`` columns, fewer
    where every component's angle is within ``tolerance``; if they do not reach it, the block
    is all dimensions. Directions without variance are no components.
    """
    counted = _summed(rows, dims, _counted)
    if counted is None:
        return None
    n, sums = counted
    model = Whitening(n, tuple(int(s) for s in sums), np.zeros((dims, 0)), np.zeros(0), 0.0)

    def power(q: np.ndarray) -> tuple[np.ndarray, float]:
        def part(x: np.ndarray) -> tuple:
            c = model.centred(x)
            return c.T @ (c @ q), float((c * c).sum())

        z, squares = _summed(rows, dims, part)
        return z / n, squares / n

    q, found = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, min(dims, components + oversample))))[0], None
    for _ in range(passes if q.shape[1] < dims else 0):
        z, trace = power(q)
        vectors, values, angle = _ritz(q, z, components)
        if angle <= tolerance:
            found = vectors, values
            break
        q = np.linalg.qr(z)[0]
    if found is None:
        z, trace = power(np.eye(dims))
        found = _ritz(np.eye(dims), z, components)[:2]
    vectors, values = found
    real = values > max(values[0] if len(values) else 0.0, 0.0) * NULL_SHARE
    model = Whitening(n, model.sums, vectors[:, real], values[real], trace)

    def spread(x: np.ndarray) -> tuple:
        w = model.whitened(x)
        return w.T @ w, w.sum(0)

    products, total = _summed(rows, dims, spread)
    off = products / n - np.outer(total / n, total / n) - np.eye(len(model.eigenvalues))
    return Whitening(n, model.sums, model.components, model.eigenvalues, trace, float(np.abs(off).max(initial=0.0)))


def whiten(table: DataFrame, vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``table`` with n, deviation, whitened (array of a value a component), explained (array) and identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out; all others
    stay, in any number of copies, with a null id too. Vectors of each number of dimensions are
    a table of their own. There are as many components as are asked for, or as there are
    directions with variance: none, and so empty arrays, for empty vectors or where all are
    equal. Entries beyond 2^62 count as that, and deviations beyond long as its end. Other
    columns keep their names; those of the result get underscores in front where ``table`` has
    them already. An empty table gives an empty table.
    """
    plain, named = masked(table)
    vector = plain.columns[table.columns.index(vector)]
    rows = plain.withColumn("x", whole_numbers(vector, scale, offset)).where("x is not null")
    distinct = materialize(rows.select("x").distinct(), "fit_list")
    out = None
    made = {k: spare(k, table.columns) for k in ("n", "deviation", "whitened", "explained", "identity_error")}
    kinds = dict(zip(made, ("bigint", "bigint", "array<double>", "array<double>", "double")))
    for dims in sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect()):
        model = fit(distinct.where(F.size("x") == dims), dims, components)
        part = rows.where(F.size("x") == dims).mapInArrow(_projector(model, dims, plain.columns), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), *(f"`{k}` {v}" for k, v in kinds.items())]))
        out = part if out is None else out.unionByName(part)
    release(distinct)
    if out is None:
        out = plain.limit(0).select("*", *(F.lit(None).cast(v).alias(k) for k, v in kinds.items()))
    return named(out, *(F.col(k).alias(v) for k, v in made.items()))


def _projector(model: Whitening, dims: int, columns: list[str]) -> Callable:
    explained = (model.eigenvalues / model.trace).tolist() if len(model.eigenvalues) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dims)
            rows, width = len(x), len(model.eigenvalues)
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
            whitened = pa.ListArray.from_arrays(ends, pa.array(model.whitened(x).reshape(-1)))
            shares = pa.ListArray.from_arrays(ends, pa.array(explained * rows, pa.float64()))
            made = [pa.array([model.n] * rows, pa.int64()), pa.array(model.deviations(x)), whitened, shares, pa.array([model.identity_error] * rows, pa.float64())]
            yield pa.record_batch([*(batch.column(c) for c in columns), *made], names=[*columns, "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def digest(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component: vec_id, component from 1, n, deviation, whitened, explained, identity_error."""
    both = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = whitened.select("vec_id", "n", "deviation", "identity_error", both)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
