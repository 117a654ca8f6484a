"""Whitening of embeddings by shifted CholeskyQR.

An entry c counts as the integer floor(1024 * c) + 100000, so sums are exact.  With Y the centred rows, one pass of the method
forms the Gram matrix of Y R^-1 (R is what the passes before have found, applied by triangular solves, one after the other, to
each row), factors it by Cholesky, and puts the new factor before R.  The first pass adds a shift to the diagonal, so that the
factor exists for any condition number; a later one adds it only if its matrix has no factor.  As soon as a Gram matrix is near the
identity its own factor ends the loop, as rows are then orthogonal to rounding.  Y = Q R, so the singular values of R
are those of Y and its right singular vectors are the components.  Nothing but d x d matrices meets on the driver: tasks add up
the rows they see, and the rows of their matrices are added by Spark, each in one of d keys that stream through a task.

Five or six narrow passes over the vectors; none is written or shuffled.

Defined cases: a vector that is null or has a null or non-finite entry is left out; so is one of another length than most have
(of lengths as frequent, the greater one counts).  Repeated rows, null ids and ties stay as they are.  An entry beyond 2^62 /
1024 counts as that.  ``deviation`` is null where the exact sum does not fit 64 bits.  Components without variance are left out, so
a table of one row, or of equal rows, has none, and neither has an empty one.  Kept columns that are named like a new one give
way to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, LIMIT = 1024, 100_000, float(1 << 62)
#: Passes at most; only vectors without variance in some direction need more than three.
PASSES = 6
#: A direction with less than this share of the greatest singular value has no variance.
NOTHING = 1e-10
NEW = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, with finite entries only."""
    x = F.col(f"`{vector}`")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return vectors.where(x.isNotNull() & F.forall(x.cast("array<double>"), finite))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a batch as integers."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Sums:
    """Number of rows, and their exact sum in each dimension."""

    n: int
    total: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums; Python's integers where 64 bits could not hold it."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.total), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.total, np.int64)
        return self.n * x.astype(object) - np.array(self.total, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of squares of each row of n * x - sums; None where it does not fit a long."""
        y = self.scaled(x)
        most = int(np.abs(y).max(initial=0))
        if most * most * max(1, y.shape[1]) < 1 << 63:
            return (y * y).sum(1).tolist()
        exact = (y.astype(object) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def solved(y: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """y R^-1 for an upper triangular R: one column after the other, for all rows at once."""
    out = np.empty(y.shape, order="F")
    for j in range(y.shape[1]):
        out[:, j] = (y[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _added(rows: DataFrame, width: int, size: int, part: Callable[[np.ndarray], np.ndarray], dims: int, kind: type = np.float64) -> np.ndarray:
    """The sum over all rows of part(their integers), a matrix of size x width.  A task adds up its own; each of the matrix's
    rows is then added by itself."""
    element = "long" if kind is np.int64 else "double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros((size, width), kind)
        for batch in batches:
            if batch.num_rows:
                mine += part(integers(batch.column("v"), dims))
        yield _rows(enumerate(mine))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, values in zip(batch.column("i").to_pylist(), batch.column("values"), strict=True):
                x = values.values.to_numpy(zero_copy_only=False)
                held[i] = held[i] + x if i in held else x
        yield _rows(held.items())

    def _rows(found) -> pa.RecordBatch:
        at, values = zip(*found, strict=True) if (found := list(found)) else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([v.tolist() for v in values], pa.list_(pa.from_numpy_dtype(kind)))], names=["i", "values"])

    schema = f"i int, values array<{element}>"
    out = np.zeros((size, width), kind)
    for r in rows.select("v").mapInArrow(partial, schema).repartition("i").mapInArrow(merged, schema).collect():  # the matrix
        out[r["i"]] += np.array(r["values"], kind)
    return out


def sums(rows: DataFrame, dims: int) -> Sums:
    """Exact sums: the high and low halves of each integer are added apart."""

    def part(x: np.ndarray) -> np.ndarray:
        return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.full(dims, len(x))])

    high, low, n = _added(rows, dims, 3, part, dims, np.int64)
    return Sums(int(n[0]) if dims else 0, tuple((int(h) << 32) + int(b) for h, b in zip(high, low, strict=True)))


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of gram; of gram and a shift, doubled until there is one, if it has none."""
    extra = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + extra * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            extra = max(2 * extra, shift, np.finfo(float).tiny)


@dataclass(frozen=True)
class Model:
    """What whitening needs: sums, components as columns, their variances, each one's share of all variance."""

    sums: Sums
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.sums.centred(x) @ self.components / np.sqrt(self.variances)


def _vectors(vectors: DataFrame, vector: str, *kept: Column) -> tuple[DataFrame, int]:
    """Rows to be whitened (kept columns, v as doubles) and their length."""
    whole = usable(vectors, vector)
    lengths = whole.groupBy(F.size(f"`{vector}`").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = lengths.d if lengths else 0
    return whole.where(F.size(f"`{vector}`") == dims).select(*kept, F.col(f"`{vector}`").cast("array<double>").alias("v")), dims


def fit(rows: DataFrame, dims: int, most: int = 8) -> Model:
    """The greatest components (up to ``most``) of rows, column v, all of that length."""
    own = sums(rows, dims) if dims else Sums(0, ())
    nothing = Model(own, np.empty((dims, 0)), np.empty(0), np.empty(0))
    if own.n == 0:
        return nothing
    found: list[np.ndarray] = []

    def gram(x: np.ndarray) -> np.ndarray:
        y = own.centred(x)
        for r in found:
            y = solved(y, r)
        return y.T @ y

    upper, unit = np.eye(dims), 11 * (own.n * dims + dims * (dims + 1)) * np.finfo(float).eps / 2
    for k in range(PASSES):
        g = _added(rows, dims, dims, gram, dims)
        if not g.any():
            break
        shift = min(unit, 0.01) * float(np.trace(g))
        r = factor(g + shift * np.eye(dims) if k == 0 else g, shift)
        found.append(r)
        upper = r @ upper
        if k and np.abs(g - np.eye(dims)).sum(1).max() < 0.5:
            break
    if not found:
        return nothing
    _, singular, right = np.linalg.svd(upper)
    real = int((singular > NOTHING * singular[0]).sum()) if singular[0] > 0 else 0
    kept, variances = min(most, real), singular**2 / own.n
    return Model(own, right[:kept].T.copy(), variances[:kept], variances[:kept] / variances.sum())


def identity_error(rows: DataFrame, dims: int, model: Model) -> float:
    """The greatest absolute entry of the whitened rows' covariance less the identity; centred before multiplying."""
    k = len(model.variances)
    mean = _added(rows, k, 1, lambda x: model.whitened(x).sum(0, keepdims=True), dims)[0] / model.sums.n

    def products(x: np.ndarray) -> np.ndarray:
        y = model.whitened(x) - mean
        return y.T @ y

    return float(np.abs(_added(rows, k, k, products, dims) / model.sums.n - np.eye(k)).max())


def whitened(vectors: DataFrame, vector: str = "embedding", keep: list[str] | None = None, most: int = 8) -> DataFrame:
    """One row for each usable vector and component (from 1, greatest variance first): the kept columns, component, n,
    deviation, whitened, explained and identity_error."""
    names = [x.split()[0] for x in NEW.split(", ")]
    kept = [c for c in (keep if keep is not None else vectors.columns) if c != vector and c not in names]
    rows, dims = _vectors(vectors, vector, F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    model = fit(rows, dims, most)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {NEW}"
    k = len(model.variances)
    error = identity_error(rows, dims, model) if k else 0.0
    sent = rows.sparkSession.sparkContext.broadcast((model, error))  # a few components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wrong = sent.value
        for batch in batches:
            x = integers(batch.column("v"), dims)
            size = len(x) * k
            times = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column("row").take(times),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, own.sums.n, np.int64)),
                pa.array(own.sums.deviations(x), pa.int64()).take(times),
                pa.array(own.whitened(x).ravel()),
                pa.array(np.tile(own.explained, len(x))),
                pa.array(np.full(size, wrong)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *names])

    out = (rows if k else rows.limit(0)).mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *names)
