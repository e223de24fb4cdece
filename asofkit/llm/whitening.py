"""Operator 11: whitening of embeddings by eigenvectors in mixed precision.

The entries become integers, so that counts, sums and products over all rows are exact whatever the order of the tasks. The covariance is added up on the cluster in rows of the d x d
matrix through a tree of partial sums; only those d rows (bounded by the dimension of the vectors, not by their number) reach the driver. Its eigenvectors are found
in single precision first and then corrected in extended precision by Ogita and Aishima's iteration, which is nothing but matrix products:
``R = I - X'X``, ``S = X'VX``, ``X <- X + XE`` with ``E_ij = (S_ij + e_j R_ij) / (e_j - e_i)``, or ``R_ij / 2`` where two eigenvalues are too close
to tell apart. The vectors of such a cluster are turned among themselves by a sub-solve: the same method on the small matrix ``X_J' V X_J``, shifted by its mean
eigenvalue and scaled up, until the cluster falls apart or is one multiple eigenvalue.

Defined cases: rows whose vector is null, empty, or holds a null, NaN or infinite entry are dropped. Vectors belong to the space of the commonest length (of equally common ones the longest);
rows of another length are dropped. Entries beyond 2**47 count as 2**47. Repeated rows all get their components, but stand in the fit list once. A component without variance (less than 2**-40
of the largest) has a null ``whitened`` and no part in the identity error; with a single fit vector every ``explained`` and the identity error are null. A deviation beyond a long
is null. Fewer than 16 dimensions have as many components as they are. An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import work_table

COMPONENTS, SCALE, OFFSET, MOST_ENTRY = 16, 64, 1_000_000, float(1 << 53)
BLOCK_ROWS, TREE = 4096, 32
#: The higher precision.
EXTENDED = np.longdouble


# ---- eigenvectors -----------------------------------------------------------------------------------------------


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of eigenvalues that lie within ``width`` of their neighbour; only clusters of two and more."""
    order = np.argsort(values)
    edges = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [c for c in np.split(order, edges) if len(c) > 1]


def refine(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """One step of the iteration: better vectors, the eigenvalues, the distance below which eigenvalues are not told apart, and whether only rounding was corrected."""
    d, eps = len(v), np.finfo(EXTENDED).eps
    r = np.eye(d, dtype=EXTENDED) - x.T @ x
    s = x.T @ v @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off, norm = s - np.diag(np.diag(s)), np.abs(values).max()
    width = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > width
    gap = np.where(far, gap, 1)
    e = np.where(far, (s + values[None, :] * r) / gap, r / 2)
    rounding = 8 * d * eps * (1 + norm / np.abs(gap) * far)  # what rounding in s makes of e
    return x + x @ e, values, float(width), bool((np.abs(e) <= rounding).all())


def eigenvectors(v: np.ndarray, most_steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, in the higher precision.

    A vector is known to the precision of the matrix over the distance to the next eigenvalue, as with any solver.
    """
    v = np.asarray(v, dtype=EXTENDED)
    d, unit = len(v), np.eye(len(v), dtype=EXTENDED)
    scale = np.abs(v).max() if d else EXTENDED(0)
    if d < 2 or scale == 0:
        return np.diag(v).copy(), unit
    a = v / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(EXTENDED)
    nothing, solved = 8 * d * np.finfo(EXTENDED).eps, set()
    for _ in range(most_steps):
        x, values, width, settled = refine(a, x)
        turned = False
        for c in _clusters(values, width) if settled else ():
            # the rest of a cluster, solved among its own vectors; a multiple eigenvalue has no rest, and any basis of it will do
            t = x[:, c].T @ a @ x[:, c]
            t = (t + t.T) / 2 - np.trace(t) / len(c) * np.eye(len(c), dtype=EXTENDED)
            if np.abs(t).max() > nothing and tuple(c) not in solved:
                solved.add(tuple(c))
                x[:, c] = x[:, c] @ eigenvectors(t, most_steps)[1]
                turned = True
        if settled and not turned:
            break
    for _ in range(2):  # without turning them, make the vectors orthogonal and of length one to the last digit
        x = x @ (unit + (unit - x.T @ x) / 2)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1, 1)  # the largest entry is positive
    return values[order] * scale, x


# ---- sums over the cluster --------------------------------------------------------------------------------------


def _pack(x: np.ndarray) -> pa.Array:
    """Rows of longs as binaries of byte planes, which compress well."""
    n, d = x.shape
    planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(n, d, 8).transpose(0, 2, 1))
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * (8 * d)), pa.py_buffer(planes)]).cast(pa.binary())


def _unpack(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """Blocks of rows of longs."""
    for at in range(0, len(column), BLOCK_ROWS):
        raw = b"".join(column.slice(at, BLOCK_ROWS).to_pylist())
        planes = np.frombuffer(raw, np.uint8).reshape(-1, 8, d)
        yield np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(-1, d)


def _finite(df: DataFrame, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))


def _longs(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -MOST_ENTRY, MOST_ENTRY).astype(np.int64) + OFFSET


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return _longs(np.asarray(column.flatten().cast(pa.float64())).reshape(-1, d))


def _tree_sum(partials: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the vectors ``v`` of each key ``i`` over all tasks, through a tree; at most as many keys and entries as there are dimensions reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, total = None, None
        for b in batches:
            for k, raw in zip(b.column("i").to_pylist(), b.column("v").to_pylist()):
                v = np.frombuffer(raw)
                i, total = k, v if total is None else total + v
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "part", "v"])

    spread = partials.withColumn("part", F.col("part") % TREE)
    once = spread.groupBy("i", "part").applyInArrow(add, "i int, part int, v binary")
    return {r["i"]: np.frombuffer(r["v"]) for r in once.groupBy("i").applyInArrow(add, "i int, part int, v binary").collect()}


def _partials(fit: DataFrame, d: int, column: str, per_block, keys: int) -> DataFrame:
    """Per task, ``keys`` vectors of doubles, added up over its blocks of rows. Sums of integers stay exact below 2**53."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _unpack(batch.column(column), d):
                got = per_block(x)
                total = got if total is None else total + got
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(keys), pa.int32()), pa.array([part] * keys, pa.int32()), pa.array([np.ascontiguousarray(v, np.float64).tobytes() for v in total], pa.binary())], ["i", "part", "v"])

    return fit.select(column).mapInArrow(run, "i int, part int, v binary")


# ---- the model --------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """A fitted whitening: ``n`` distinct vectors of ``d`` longs with exact sums, eigenvalues and the matrix of the first components."""

    n: int
    d: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def centre(self) -> np.ndarray:
        """The nearest whole vector to the mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part without rounding, then the rest, which is at most a half."""
        centre = self.centre
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, centre)])
        return (x - centre).astype(np.float64) - rest

    @property
    def usable(self) -> np.ndarray:
        return (self.values > 0) & (self.values > self.values[:1].max(initial=0) * 2.0**-40)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        root = np.sqrt(np.where(self.usable, self.values, 1).astype(np.float64))
        return self.centred(x) @ self.vectors / root

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n*x - S)**2, in whole numbers of any size."""
        centre = self.centre
        z = x - centre
        wide = object if z.size and np.abs(z).max() > 1 << 26 else np.int64
        z = z.astype(wide)
        rest = np.array([s - self.n * int(c) for s, c in zip(self.sums, centre)], dtype=object)
        squares = (z * z).sum(axis=1)
        n, own = self.n, sum(int(r) ** 2 for r in rest)
        cross = z.astype(object) @ rest
        found = (n * n * int(q) - 2 * n * int(c) + own for q, c in zip(squares, cross))
        return [f if f < 1 << 63 else None for f in found]


def fit_whitening(vectors: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on every distinct vector of longs; None where no row remains."""
    rows = _finite(vectors.select(F.col(vector_col).alias("v")), "v")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    d = common["d"]

    def longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([_pack(_rows(b.column("v"), d))], ["x"])

    fit = work_table(rows.filter(F.size("v") == d).mapInArrow(longs, "x binary").distinct(), "fit-vectors")

    low = (1 << 26) - 1
    # sums in two halves, so that they are exact for any entries: x = high * 2**26 + low
    halves = _tree_sum(_partials(fit, d, "x", lambda x: np.stack((np.full(d, float(len(x))), (x >> 26).sum(axis=0).astype(float), (x & low).sum(axis=0).astype(float))), 3))
    n = int(halves[0][0])
    sums = [(int(h) << 26) + int(lo) for h, lo in zip(halves[1], halves[2])]
    model = Whitening(n, d, sums, np.zeros(0), np.zeros((d, 0)), 0.0, None)
    centre = model.centre

    def products(x: np.ndarray) -> np.ndarray:
        z = (x - centre).astype(np.float64)
        return z.T @ z

    gram = _tree_sum(_partials(fit, d, "x", products, d))
    # products of vectors that are centred but for the part of the mean below a half, which is taken off here
    rest = np.array([EXTENDED(s - n * int(c)) / n for s, c in zip(sums, centre)])
    v = np.stack([gram[i] for i in range(d)]).astype(EXTENDED) / n - np.outer(rest, rest)
    values, x = eigenvectors((v + v.T) / 2)
    k = min(components, d)
    model.values, model.vectors, model.trace = values[:k].astype(np.float64), x[:, :k].astype(np.float64), float(np.trace(v))

    if model.usable.any():
        means = _tree_sum(_partials(fit, d, "x", lambda b: model.whiten(b).sum(axis=0)[None, :], 1))[0] / n

        def spread(b: np.ndarray) -> np.ndarray:
            w = model.whiten(b) - means
            return w.T @ w

        found = _tree_sum(_partials(fit, d, "x", spread, k))
        error = np.abs(np.stack([found[i] for i in range(k)]) / n - np.eye(k))
        model.identity_error = float(error[np.ix_(model.usable, model.usable)].max())
    return model


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: id, ``component, n, deviation, whitened, explained, identity_error``."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit_whitening(vectors, vector_col=vector_col, components=components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    k = len(model.values)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dead = np.tile(~model.usable, BLOCK_ROWS)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                x = _rows(b.column("v"), model.d)
                m = len(x)
                each = np.repeat(np.arange(m), k)
                arrays = [
                    b.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(model.whiten(x).ravel(), mask=dead[: m * k]), pa.array(explained * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = _finite(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v").filter(F.size("v") == model.d)
    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)
