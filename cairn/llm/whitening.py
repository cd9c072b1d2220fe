"""Whitening of embeddings on their leading principal components, by a block Jacobi-Davidson iteration.

A vector's entries c become whole numbers floor(64 c) + 1000000. Each distinct vector of whole numbers is once in the
fit list, whose covariance V (divisor n) is never formed: the iteration only needs products of V with a few vectors at
a time, and each product is one Spark job that centres its rows before it multiplies and sends back a matrix of the
dimension times the vectors. The driver holds a search space of a few dozen vectors, whatever the number of rows:

* Rayleigh-Ritz in the search space gives approximate pairs and their residuals;
* pairs are locked from the largest eigenvalue on once their residual is at the level of double precision;
* for the others, the correction equation, projected against locked and current vectors, is solved by a few steps of MINRES, all
  pairs in step so that they share the products; the corrections widen the search space, which is
  restarted from its best vectors when it is full.

Rows whose vector is null or holds null or non-finite entries are left out. So are vectors with an entry whose
size reaches 2^46, beyond which 64 c has no exact whole number, and vectors of another length than most
(of equally frequent lengths, the greatest). Repeated rows each get their results; they are one vector of the
fit list. A component whose eigenvalue is not above 1e-12 of the trace (fewer distinct vectors or dimensions than components) has
no row, so a table of one distinct vector, like an empty one, gives no rows. ``deviation`` is null where it does not
fit a long. Columns other than the two named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.tables import settled_parquet

SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more have no exact whole number.
LIMIT = float(1 << 46)
#: Vectors of the fit list to a block, at most.
BLOCK = 4096
#: A residual counts as zero at this part of the largest eigenvalue: the rounding of sums in double precision.
TOLERANCE = 1024 * np.finfo(float).eps
#: Steps of MINRES for each correction.
INNER = 5
#: Iterations after which the search is given up as broken.
MOST_OUTER = 200
#: Eigenvalues up to this part of the trace are none.
NEGLIGIBLE = 1e-12

Product = Callable[[np.ndarray], np.ndarray]


def _whole(vector: Column) -> Column:
    entry = lambda c: F.floor(c.cast("double") * SCALE) + SHIFT
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LIMIT))  # NaN is above all numbers here
    return F.when(sound, F.transform(vector, entry))


def whole_numbers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and x of the rows that remain."""
    found = rows.select(F.col(key).alias("key"), _whole(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    lengths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    most = lengths.first()
    return found.filter(F.size("x") == (most.d if most else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The lists of a column, all of one length, as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@dataclass
class Fit:
    """The fit list: its size, the sum of each dimension, its rows centred and packed in blocks, and the trace of its covariance."""

    n: int
    sums: list[int]
    blocks: DataFrame
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as 64-bit numbers where these are sure to hold it, else as Python's."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    kind = np.int64 if most < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, kind)


def fit_list(x: DataFrame) -> Fit:
    """Distinct vectors, packed in blocks of centred doubles below the shared folder."""
    distinct = settled_parquet(x.select("x").distinct())

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("x"))
            high, low = (m >> 26).sum(axis=0), (m & ((1 << 26) - 1)).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(m.shape[1]), pa.int32()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64()), "rows": pa.array([len(m)] * m.shape[1], pa.int64())})

    parts = distinct.mapInArrow(part_sums, "place int, high long, low long, rows long")
    total = lambda name: F.sum(F.col(name).cast("decimal(20,0)")).alias(name)
    rows = parts.groupBy("place").agg(total("high"), total("low"), F.sum("rows").alias("rows")).orderBy("place").collect()
    n, sums = (int(rows[0].rows) if rows else 0), [(int(r.high) << 26) + int(r.low) for r in rows]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                m = (_centred(_matrix(batch.column("x").slice(at, BLOCK)), n, sums) / n).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"block": pa.array([m.tobytes()], pa.binary()), "squares": [float(np.square(m).sum())]})

    blocks = settled_parquet(distinct.mapInArrow(pack, "block binary, squares double"))
    squares = blocks.agg(F.sum("squares")).first()[0]
    return Fit(n, sums, blocks, (squares or 0.0) / max(n, 1))


def _summed(fit: Fit, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``part``, a small matrix: each task adds its own up, Spark adds those up entry by entry."""
    d = fit.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column("block"):
                m = part(np.frombuffer(block.as_buffer(), np.float64).reshape(-1, d))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(total.size), pa.int32()), "value": pa.array(total.ravel(), pa.float64())})

    rows = fit.blocks.select("block").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.place] = r.value
    return out


def products(fit: Fit) -> Product:
    """The function B -> V B for a matrix of few columns, as one Spark job."""
    return lambda b: _summed(fit, lambda m: m.T @ (m @ b)).reshape(b.shape) / fit.n


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(m).sum(axis=0))


def _new_directions(t: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what the columns of ``t`` add to the spaces ``against``."""
    before = np.hstack(against)
    t = t / np.maximum(_norms(t), np.finfo(float).tiny)
    for _ in range(2):
        t = t - before @ (before.T @ t)
    q, size, _ = np.linalg.svd(t, full_matrices=False)
    q = q[:, size > 1e-10]
    return np.linalg.qr(q - before @ (before.T @ q))[0] if q.shape[1] else q


def minres(product: Product, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions, one a column, of a symmetric system whose ``product`` takes all columns at once."""
    tiny = np.finfo(float).tiny
    beta = _norms(right)
    v, v_old = right / np.maximum(beta, tiny), np.zeros_like(right)
    x, w, w_old = (np.zeros_like(right) for _ in range(3))
    eta, cos, cos_old, sin, sin_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_next = _norms(p)
        delta = cos * alpha - cos_old * sin * beta
        rho1 = np.maximum(np.hypot(delta, beta_next), tiny)
        rho2, rho3 = sin * alpha + cos_old * cos * beta, sin_old * beta
        w, w_old = (v - rho2 * w - rho3 * w_old) / rho1, w
        cos_old, sin_old, cos, sin = cos, sin, delta / rho1, beta_next / rho1
        x = x + cos * eta * w
        eta = -sin * eta
        v, v_old, beta = p / np.maximum(beta_next, tiny), v, beta_next
        if not (np.abs(eta) > 0).any():
            break
    return x


def jacobi_davidson(product: Product, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive matrix given by its product."""
    k = min(k, d)
    room, kept = max(4 * k, 32), 2 * k
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = np.linalg.qr(np.random.default_rng(1).standard_normal((d, min(d, 2 * k))))[0]
    image = product(space)
    for _ in range(MOST_OUTER):
        theta, s = np.linalg.eigh((lambda h: (h + h.T) / 2)(space.T @ image))
        theta, s = theta[::-1], s[:, ::-1]
        u, au = space @ s, image @ s
        wanted = min(k - len(values), u.shape[1])
        residual = au[:, :wanted] - u[:, :wanted] * theta[:wanted]
        top = max([abs(theta[0]), *values[:1]])
        whole = locked.shape[1] + u.shape[1] >= d  # nothing is outside the search space
        sound = (_norms(residual) <= TOLERANCE * top) | whole
        done = wanted if sound.all() else int(np.argmin(sound))
        locked, values = np.hstack([locked, u[:, :done]]), np.append(values, theta[:done])
        if len(values) == k:
            return values, locked
        u, au, theta, residual = u[:, done:], au[:, done:], theta[done:], residual[:, done:]
        if u.shape[1] + residual.shape[1] > room:
            u, au, theta = u[:, :kept], au[:, :kept], theta[:kept]
        space, image = u, au
        fixed = np.hstack([locked, u[:, : residual.shape[1]]])
        project = lambda m, q=fixed: m - q @ (q.T @ m)
        shift = theta[: residual.shape[1]]
        corrected = lambda m, p=project, z=shift: p(product(p(m)) - z * m)
        t = minres(corrected, -project(residual), INNER)
        more = _new_directions(t, [locked, space])
        if not more.shape[1]:  # stuck in rounding: widen by chance
            more = _new_directions(np.random.default_rng(len(values)).standard_normal((d, min(k, d - locked.shape[1] - space.shape[1]))), [locked, space])
        space, image = np.hstack([space, more]), np.hstack([image, product(more)])
    raise ArithmeticError("the residuals of the leading eigenvectors do not reach double precision")


@dataclass
class Components:
    """Leading eigenvectors (columns), their eigenvalues and how far the whitened fit list is from the identity."""

    values: np.ndarray
    vectors: np.ndarray
    identity_error: float


def components(fit: Fit, k: int) -> Components:
    d = fit.dimension
    values, vectors = jacobi_davidson(products(fit), d, k) if fit.n and d and fit.trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    real = values > NEGLIGIBLE * fit.trace
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return Components(values, vectors, 0.0)
    to = vectors / np.sqrt(values)
    covariance = _summed(fit, lambda m: (lambda y: y.T @ y)(m @ to)).reshape(len(values), -1) / fit.n
    return Components(values, vectors, float(np.abs(covariance - np.eye(len(values))).max()))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error and eigenvalue for each remaining row and component up to ``k``."""
    kind = rows.schema[key].dataType
    x = whole_numbers(rows, key, vector)
    fit = fit_list(x)
    found = components(fit, k)
    n, sums, values, m = fit.n, fit.sums, found.values, len(found.values)
    to = found.vectors / np.sqrt(values)
    explained = values / fit.trace if fit.trace else values
    error = found.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                centred = _centred(_matrix(part.column("x")), n, sums)
                rows = len(centred)
                small = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0)))) ** 2 * len(sums) < 1 << 62
                squares = (centred if small else centred.astype(object)) ** 2
                deviation = pa.array([v if v < 1 << 63 else None for v in squares.sum(axis=1).tolist()], pa.int64())
                white = (centred / n).astype(np.float64) @ to
                each, which = np.repeat(np.arange(rows), m), np.tile(np.arange(m), rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(each)), pa.array(which + 1, pa.int32()), pa.array(np.full(rows * m, n), pa.int64()), deviation.take(pa.array(each)),
                     pa.array(white.ravel()), pa.array(explained[which]), pa.array(np.full(rows * m, error)), pa.array(values[which])],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
                )

    return x.mapInArrow(project, f"key {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double").withColumnRenamed("key", key)
