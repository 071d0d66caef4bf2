"""Whitening of embeddings by block Lanczos, without a covariance matrix in memory.

Vectors become whole numbers, so counts, sums and deviations are exact. A pass over the vectors takes a
block Q and gives sum((x - mean) (x - mean)' Q) / n: each task multiplies its rows, centred first, and
only a block of (dimensions, width) leaves it, summed by Spark. Block Lanczos puts each product into the
basis after orthogonalising it twice against all of the basis (full reorthogonalisation). Where the
remainder has no full rank (a breakdown), directions of no weight are replaced by random ones that
are orthogonal to the basis. The projected matrix gives Ritz values and vectors; their residuals,
measured by the part of the last product that is outside the basis, say when to stop. The driver
holds the basis, at most (dimensions, dimensions).
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.session import in_arrow

COMPONENTS = 8
#: Directions of a block beyond the components asked for, rows multiplied at a time.
SPARE, ROWS = 4, 8192
#: A residual, over the greatest eigenvalue, at which a component has converged; the part of a direction's length below which it is lost.
TOLERANCE, LOST = 2e-14, 1e-13
#: An entry becomes floor(SCALE * c) + OFFSET; beyond LARGEST that is not exact, and the entry counts as not finite.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**50


@dataclass(frozen=True)
class Whitening:
    """What a fit has found: n rows, exact sums by dimension, eigenvalues and unit eigenvectors (one a column), the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None


def _whole(batch: pa.RecordBatch, dim: int | None = None):
    """The rows that count, and their vectors as whole numbers: those of `dim` entries (if given), all present and finite."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    size = np.asarray(column.value_lengths().fill_null(-1))
    for d in [dim] if dim is not None else sorted(set(size.tolist()) - {-1}):
        at = np.flatnonzero(size == d)
        for i in range(0, len(at), ROWS):
            some = pa.array(at[i : i + ROWS])
            flat = column.take(some).flatten()
            c = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(some), d)
            good = (np.abs(c) < LARGEST).all(1)
            x = np.floor(SCALE * c[good]).astype(np.int64) + OFFSET
            yield at[i : i + ROWS][good], x


def _sums(batches):
    """(dim, n, i, s): how many vectors of a dimension a task has, and the sum of each entry."""
    seen: dict[int, list] = {}
    for batch in batches:
        for at, x in _whole(batch):
            if len(at):
                own = seen.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                own[0] += len(at)
                own[1] = [a + b for a, b in zip(own[1], x.sum(0, dtype=np.int64).tolist())]
    out = [(d, n, i, s) for d, (n, sums) in seen.items() for i, s in enumerate(sums or [0])]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)] + [pa.array([str(r[3]) for r in out], pa.string())], ["dim", "n", "i", "s"])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n from whole numbers: the whole part is taken off before anything is rounded."""
    whole, rest = sums // n, sums % n
    return (x - whole) - rest / n


def _summed(pieces: DataFrame, width: int) -> np.ndarray:
    """The sum by row number i of rows (i, c0, c1, ...) that tasks have made."""
    rows = pieces.groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]).collect()  # one row a dimension
    out = np.zeros((len(rows), width))
    for r in rows:
        out[r[0]] = r[1:]
    return out


def _block(block: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(block)))] + [pa.array(np.ascontiguousarray(c)) for c in block.T], ["i", *(f"c{j}" for j in range(block.shape[1]))])


def product(vectors: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The covariance of the vectors (embedding) times q, in one pass over them."""

    def multiplied(batches):
        total = np.zeros(q.shape)
        for batch in batches:
            for _, x in _whole(batch, len(sums)):
                x = _centred(x, n, sums)
                total += x.T @ (x @ q)
        yield _block(total)

    width = q.shape[1]
    return _summed(in_arrow(vectors, multiplied, ", ".join(["i long", *(f"c{j} double" for j in range(width))])), width) / n


def _added(basis: np.ndarray, block: np.ndarray, rng: np.random.Generator, scale: float) -> tuple[np.ndarray, bool]:
    """Orthonormal directions of a block that are orthogonal to the basis; lost ones are drawn anew while there is room. And whether some were."""
    block, room = block.copy(), basis.shape[0] - basis.shape[1]
    found, restarted = np.empty((basis.shape[0], 0)), False
    for j in range(min(block.shape[1], room)):
        v, length = block[:, j], scale
        for attempt in range(8):
            both = np.hstack([basis, found])
            for _ in range(2):
                v = v - both @ (both.T @ v)
            size = np.linalg.norm(v)
            if size > LOST * length:
                break
            restarted, v = True, rng.standard_normal(len(v))
            length = np.linalg.norm(v)
        v = v / np.linalg.norm(v)
        both = np.hstack([basis, found])
        v = v - both @ (both.T @ v)
        found = np.hstack([found, (v / np.linalg.norm(v))[:, None]])
    return found, restarted


def lanczos(multiply, dim: int, wanted: int, width: int, tolerance: float = TOLERANCE, seed: int = 13) -> tuple[np.ndarray, np.ndarray, dict]:
    """The `wanted` greatest eigenvalues and their vectors of a symmetric matrix of which only `multiply`(block) is known. And passes, restarts and residuals."""
    rng = np.random.default_rng(seed)
    basis, images, told = np.empty((dim, 0)), np.empty((dim, 0)), {"passes": 0, "restarts": 0}
    block, _ = _added(basis, rng.standard_normal((dim, min(width, dim))), rng, 1.0)
    while True:
        image = multiply(block)
        told["passes"] += 1
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:wanted], inner[:, ::-1][:, :wanted]
        vectors = basis @ inner
        top = max(float(values[0]), np.finfo(float).tiny)
        told["residuals"] = np.linalg.norm(images @ inner - vectors * values, axis=0) / top
        if basis.shape[1] == dim or (len(values) == wanted and (told["residuals"] <= tolerance).all()):
            vectors /= np.linalg.norm(vectors, axis=0)
            return values, vectors, told
        block, restarted = _added(basis, image, rng, top)
        told["restarts"] += restarted


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The first principal components of vectors (embedding), from passes over them; None without a vector.

    Vectors that are null, or have null entries or such as are not finite, are left out. The dimension is
    that of most vectors (the greatest of several such); one that is shorter or longer is left out as well, as one with
    entries that others lack. Components without variance, up to rounding, are not found.
    """
    given = vectors.select("embedding")
    tasks = in_arrow(given, _sums, "dim long, n long, i long, s string")
    totals = tasks.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    best = totals.where("i = 0 AND dim > 0").orderBy(F.desc("n"), F.desc("dim")).select("dim").first()
    if best is None:
        return None
    rows = totals.where(F.col("dim") == best.dim).orderBy("i").collect()  # one row a dimension
    n, sums, dim = rows[0].n, np.array([int(r.s) for r in rows], np.int64), best.dim
    spread = in_arrow(given, lambda it: _spread(it, n, sums), "s string").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).first().s
    trace = int(spread) / n**3
    wanted = min(components, dim)
    values, found, _ = lanczos(lambda q: product(given, n, sums, q), dim, wanted, wanted + SPARE)
    real = values > max(values[0], 0) * dim * np.finfo(float).eps
    values, found = values[real], found[:, real]
    found = found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1.0, 1.0)
    fit = Whitening(n, tuple(sums.tolist()), values, found, trace)
    if not len(values):
        return fit
    seen = _summed(in_arrow(given, lambda it: _seen(it, fit), ", ".join(["i long", *(f"c{j} double" for j in range(len(values)))])), len(values)) / n
    return Whitening(n, fit.sums, values, found, trace, float(np.abs(seen - np.eye(len(values))).max()))


def _spread(batches, n: int, sums: np.ndarray):
    """The deviations of a task's vectors, added up."""
    total = 0
    for batch in batches:
        for _, x in _whole(batch, len(sums)):
            total += sum(deviations(x, n, sums).tolist())
    yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["s"])


def whitened(x: np.ndarray, fit: Whitening) -> np.ndarray:
    return _centred(x, fit.n, np.array(fit.sums, np.int64)) @ fit.vectors / np.sqrt(fit.values)


def _seen(batches, fit: Whitening):
    """Products of whitened rows, which are centred as the vectors are."""
    total = np.zeros((len(fit.values),) * 2)
    for batch in batches:
        for _, x in _whole(batch, len(fit.sums)):
            z = whitened(x, fit)
            total += z.T @ z
    yield _block(total)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The sum over dimensions of (n * x - sums) ** 2, exactly: in 64 bits where they hold it, else as Python's numbers."""
    apart, most = x - sums // n, 2.0**31 / max(1.0, float(len(sums)) ** 0.5)
    if n * (float(np.abs(apart).max(initial=0)) + 1) >= most:
        apart = apart.astype(object)
    apart = n * apart - sums % n
    return (apart * apart).sum(1)


def _decimals(x: np.ndarray) -> pa.Array:
    return pa.array(map(Decimal, x.tolist()), pa.decimal128(38, 0))


def _applied(batches, fit: Whitening, names: list[str]):
    sums, k = np.array(fit.sums, np.int64), len(fit.values)
    for batch in batches:
        for at, x in _whole(batch, len(sums)):
            z, m = whitened(x, fit), len(at)
            rows = np.repeat(np.arange(m), k)
            kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at[rows])) for c in names]
            arrays = [
                *kept, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), _decimals(deviations(x, fit.n, sums)).take(pa.array(rows)), pa.array(z.ravel()),
                pa.array(np.tile(fit.values / fit.trace, m)), pa.array(np.full(m * k, fit.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, fit: Whitening | None) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error: a row for each vector (vec_id, embedding, ...) that counts and each component.

    deviation is the sum over dimensions of (n x - S) ** 2, whitened the centred vector on the component
    over the root of its eigenvalue, explained the eigenvalue's share of the trace. A null vec_id is
    kept, repeated rows are rows of their own, extra columns are ignored. Without a vector, or without
    variance, there are no rows.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    given = vectors.select("vec_id", "embedding")
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fit is None or not len(fit.values):
        return in_arrow(given.where("false"), lambda it: iter(()), schema)
    return in_arrow(given, lambda it: _applied(it, fit, ["vec_id"]), schema)
