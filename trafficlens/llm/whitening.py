"""Whitened principal components of embeddings, by spectral divide and conquer.

Vectors are put on an integer lattice; Spark sums the lattice points and, centred at whole numbers,
their products, so the covariance does not depend on how rows lie in partitions. The covariance (one
row and column per dimension) is split on the driver: the polar factor of ``V - shift`` is found by
dynamically weighted Halley steps (QDWH), gives the projector on the eigenvectors above the shift,
and so two invariant subspaces that are split in the same way down to single components. The
components are broadcast and every vector is projected in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.columns import named

#: Lattice points per unit, and what is added to a point.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Points are held within this bound, so that a double shows them exactly.
FAR = float(1 << 52)
EPS = float(np.finfo(float).eps)


# ---- spectral divide and conquer ---------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, which has its signs as eigenvalues."""
    m = len(a)
    size = np.linalg.norm(a)
    x = a / size
    # a lower bound of the least singular value
    r = np.linalg.qr(x, mode="r")
    pivots = np.abs(np.diag(r))
    low = EPS
    if pivots.min() > m * EPS:
        low = max(EPS, 0.9 / np.linalg.norm(np.linalg.inv(r)))
    eye = np.eye(m)
    for _ in range(40):
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / (sq * sq))
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - sq) / (sq * root))
        q = (p - 1) ** 2 / 4
        w = p + q - 1
        if w > 100:  # by QR while the matrix is ill-conditioned
            both, _ = np.linalg.qr(np.concatenate([np.sqrt(w) * x, eye]))
            new = q / w * x + (p - q / w) / np.sqrt(w) * (both[:m] @ both[m:].T)
        else:
            new = q / w * x + (p - q / w) * np.linalg.solve(eye + w * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        low = min(1.0, low * (p + q * sq) / (1 + w * sq))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= EPS ** (1 / 3) and abs(1 - low) <= 10 * EPS:
            break
    return x


def _halves(a: np.ndarray, scale: float, rng) -> tuple[np.ndarray, int]:
    """(orthogonal basis, k): the first k columns span the eigenvectors above some shift.

    The mean of the diagonal lies between the least and the largest eigenvalue, so it divides any
    matrix that is no multiple of the identity. A shift that meets an eigenvalue gives no clean
    projector and another one near it is taken.
    """
    m = len(a)
    diagonal = np.diag(a)
    mean, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(m)) / np.sqrt(m)
    best = None
    shifts = [float(np.median(diagonal)), mean]
    shifts += [mean + sign * f * spread for f in (0.03, 0.1, 0.21, 0.003, 0.4) for sign in (1, -1)]
    for shift in shifts:
        shifted = a - shift * np.eye(m)
        if not np.linalg.norm(shifted):
            continue
        projector = (polar(shifted) + np.eye(m)) / 2
        k = int(round(np.trace(projector)))
        if not 1 <= k < m:
            continue
        upper = np.linalg.qr(projector @ rng.standard_normal((m, k)))[0]
        upper = np.linalg.qr(projector @ upper)[0]
        rest = np.eye(m) - projector
        lower = np.linalg.qr(rest @ rng.standard_normal((m, m - k)))[0]
        lower = np.linalg.qr(rest @ lower)[0]
        basis = np.linalg.qr(np.concatenate([upper, lower], axis=1))[0]
        error = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or error < best[0]:
            best = error, basis, k
        if error <= 20 * np.sqrt(m) * EPS * scale:
            break
    if best is None:
        raise ArithmeticError("the spectrum could not be divided")
    return best[1], best[2]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, falling.

    Each vector's largest entry is positive. Of equal eigenvalues any basis is given.
    """
    m = len(v)
    scale = np.linalg.norm(v)
    rng = np.random.default_rng(7)
    values, vectors, todo = [], [], [(np.array(v, float), np.eye(m))]
    while todo:
        a, frame = todo.pop()
        flat = np.linalg.norm(a - np.trace(a) / len(a) * np.eye(len(a)))
        if len(a) == 1 or flat <= 4 * EPS * scale:
            values.extend(np.diag(a))
            vectors.append(frame)
            continue
        basis, k = _halves(a, scale, rng)
        for part in (basis[:, :k], basis[:, k:]):
            inner = part.T @ a @ part
            todo.append(((inner + inner.T) / 2, frame @ part))
    found = np.concatenate(vectors, axis=1)
    order = np.argsort(-np.array(values), kind="stable")
    found = found[:, order]
    top = found[np.abs(found).argmax(axis=0), np.arange(m)]
    return np.array(values)[order], found * np.where(top < 0, -1.0, 1.0)


# ---- sums over all vectors ---------------------------------------------------------------------


def _points(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Lattice points of a batch as an int64 matrix; what a shorter vector lacks counts as zero."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(ends)
    width = int(size.max(initial=0)) if dims is None else dims
    with np.errstate(over="ignore"):
        point = np.clip(np.floor(SCALE * flat), -FAR, FAR).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = point
    return out + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, high, low) of the points less the offset, and the number of rows as (-1, 0, n)."""
    high, low, n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in batches:
        point = _points(batch.column(0)) - OFFSET
        more = point.shape[1] - len(high)
        if more > 0:
            high, low = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (high, low))
        high[:point.shape[1]] += (point >> 24).sum(axis=0)
        low[:point.shape[1]] += (point & 0xFFFFFF).sum(axis=0)
        n += len(point)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, len(high))), pa.array(np.concatenate([[0], high])),
         pa.array(np.concatenate([[n], low]))], ["dim", "high", "low"])


def _upper(total: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(total))
    return pa.RecordBatch.from_arrays(
        [pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "value"])


def _products(centre: np.ndarray):
    """Sums of products of the points about whole numbers; exact in doubles below 2**53."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)))
        for batch in batches:
            y = (_points(batch.column(0), len(centre)) - centre).astype(float)
            total += y.T @ y
        yield _upper(total)

    return run


def _matrix(rows: DataFrame, dims: int) -> np.ndarray:
    got = rows.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((dims, dims))
    i, j, value = (got.column(k).to_numpy() for k in range(3))
    out[i, j] = out[j, i] = value
    return out


@dataclass(frozen=True)
class Whitening:
    """``total`` and ``n`` are exact; column c of ``vectors`` has the variance ``values[c]``."""

    n: int
    total: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def weights(self, components: int) -> np.ndarray:
        """What a centred vector is multiplied by. A direction without variance has weight zero."""
        e = self.values[:components]
        flat = e <= len(self.values) * EPS * max(self.values[0], 0.0) if len(e) else e > 0
        return np.where(flat, 0.0, self.vectors[:, :components] / np.sqrt(np.where(flat, 1.0, e)))


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and has finite numbers only."""
    v = named(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNotNull() & ~bad)


def fit(rows: DataFrame, vector_col: str = "embedding") -> Whitening:
    """The whitening of all usable vectors of ``rows``.

    A vector that is shorter than the longest one lacks numbers that count as zero. No usable vector
    gives a whitening without components. Per dimension pair one number comes to the driver.
    """
    own = usable(rows, vector_col).select(
        named(vector_col).cast(T.ArrayType(T.DoubleType())).alias("v"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = own.mapInArrow(_sums, "dim long, high long, low long").groupBy("dim").agg(
        wide("high"), wide("low")).collect()
    sums = {r["dim"]: (int(r["high"]) << 24) + int(r["low"]) for r in got}
    n = sums.pop(-1, 0)
    dims = len(sums)
    total = [sums[k] + n * OFFSET for k in range(dims)]
    if not n or not dims:
        none = np.zeros(0)
        return Whitening(n, total, none, none, np.zeros((0, 0)), 0.0)
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = np.array([float(Fraction(s, n) - c) for s, c in zip(total, centre)])
    moment = _matrix(own.mapInArrow(_products(np.array(centre, np.int64)),
                                    "i long, j long, value double"), dims)
    v = moment / n - np.outer(rest, rest)
    values, vectors = eigen(v)
    return Whitening(n, total, np.array(centre, float) + rest, values, vectors, float(np.trace(v)))


# ---- whitened vectors --------------------------------------------------------------------------


def _projected(point: np.ndarray, mean: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (point - mean) @ weights


def _spread(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, weights = sent.value
        k = weights.shape[1]
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            z = _projected(_points(batch.column(0), len(mean)), mean, weights)
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            total += z.T @ z
        yield _upper(total)

    return run


def identity_error(rows: DataFrame, model: Whitening, vector_col: str = "embedding",
                   components: int = COMPONENTS) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, from all of them.

    A direction without variance cannot be whitened; with one among the components this is 1.
    """
    k = min(components, len(model.values))
    if not k:
        return 0.0
    own = usable(rows, vector_col).select(
        named(vector_col).cast(T.ArrayType(T.DoubleType())).alias("v"))
    sent = rows.sparkSession.sparkContext.broadcast((model.mean, model.weights(k)))
    sums = _matrix(own.mapInArrow(_spread(sent), "i long, j long, value double"), k + 1)
    mean = sums[:k, k] / model.n
    return float(np.abs(sums[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(point: np.ndarray, n: int, total: list[int]) -> list[int] | np.ndarray:
    """Per row the sum over dimensions of (n * x - S)**2, exact."""
    far = max(int(np.abs(point).max(initial=0)), 1)
    reach = n * far + max(map(abs, total))
    if reach < 1 << 62:
        off = n * point - np.array(total, np.int64)
        most = int(np.abs(off).max(initial=0))
        if most * most * max(len(total), 1) < 1 << 63:
            return (off * off).sum(axis=1)
        off = off.astype(object)
    else:
        off = n * point.astype(object) - np.array(total, dtype=object)
    return [sum(int(x) * int(x) for x in row) for row in off]


def _whitened(sent, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, mean, weights = sent.value
        k = weights.shape[1]
        for batch in batches:
            point = _points(batch.column(keys), len(mean))
            exact = _deviation(point, n, total)
            if isinstance(exact, np.ndarray):
                short, long = pa.array(exact), pa.nulls(len(exact), pa.string())
            else:
                fits = [x < 1 << 63 for x in exact]
                short = pa.array([x if ok else None for x, ok in zip(exact, fits)], pa.int64())
                long = pa.array([None if ok else str(x) for x, ok in zip(exact, fits)], pa.string())
            z = _projected(point, mean, weights)
            row = pa.array(np.repeat(np.arange(len(point)), k))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(row) for c in range(keys)],
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(point))),
                 short.take(row), long.take(row), pa.array(np.ascontiguousarray(z).reshape(-1))],
                [*[f"k{c}" for c in range(keys)], "component", "deviation", "wide", "whitened"])

    return run


def whiten(rows: DataFrame, model: Whitening, keep: list[str], vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: ``keep`` columns as k0, k1 ..., component (from 1), n, deviation,
    whitened, explained, deviation_exact.

    ``deviation`` is null where the exact sum passes 64 bits; ``deviation_exact`` has it in any case
    up to 38 digits. A direction without variance is whitened to 0. There are as many components as
    dimensions if those are fewer. Ids may be null and rows may repeat; each row has its own result.
    """
    k = min(components, len(model.values))
    own = usable(rows, vector_col).select(
        *[named(c).alias(f"k{i}") for i, c in enumerate(keep)],
        named(vector_col).cast(T.ArrayType(T.DoubleType())).alias("v"))
    schema = T.StructType(own.schema.fields[:-1]).add("component", "integer").add(
        "deviation", "long").add("wide", "string").add("whitened", "double")
    if not k:
        out = own.sparkSession.createDataFrame([], schema)
    else:
        sent = rows.sparkSession.sparkContext.broadcast(
            (model.n, model.total, model.mean, model.weights(k)))
        out = own.mapInArrow(_whitened(sent, len(keep)), schema)
    share = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.values[:k]]
    explained = F.element_at(F.array(*map(F.lit, share or [0.0])), F.col("component"))
    return out.select(
        *[f"k{i}" for i in range(len(keep))], "component", F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", explained.alias("explained"),
        F.coalesce(F.col("deviation").cast("decimal(38,0)"), F.col("wide").cast("decimal(38,0)"))
        .alias("deviation_exact"))
