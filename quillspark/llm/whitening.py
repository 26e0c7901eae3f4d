"""Embedding whitening: the components of all vectors, and every vector's place along them in units of one deviation.

Vectors become integers, so that their sums and, around the integer next to the mean, their products are exact and do
not depend on how Spark deals the rows. Tasks add up D sums and D x D products of their rows; Spark adds those of the
tasks; the driver gets D x D numbers, never rows. There the scatter, centred on the exact mean, goes through a
Cholesky factorisation with diagonal pivots, and the columns of the triangular factor are rotated in pairs (one-sided
Jacobi) until all are orthogonal. Their squared norms are the eigenvalues, and the columns, normalised, the
components. The triangle is small where the spectrum ends, so small eigenvalues keep their digits.

Defined results: a vector that is null, or holds a null or a number that is not finite (or above 2^40, which leaves
no room for exact products), is left out; so are vectors of another length than most have (of equally frequent lengths
the longer stays), and empty ones. Repeated rows are vectors each, whatever their ids, which may be null. Directions
without any spread have no component, so vectors that are all equal, or a single one, give no rows, as an empty table
does; of equal eigenvalues the order is that of the factorisation. There are no texts, and other columns, of any name,
are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, prepare, release

SCALE, SHIFT = 1024, 100_000
#: Numbers beyond are taken as not finite.
LARGEST = float(1 << 40)
#: Products up to here are whole numbers in a double, and so are their sums.
EXACT = 1 << 53
ROWS = 4096


def integers(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The rows that are kept of a list column, by length: (their places, their numbers as long)."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = lists.flatten()
    numbers = np.nan_to_num(values.to_numpy(zero_copy_only=False), nan=np.inf) if len(values) else np.zeros(0)
    good = np.abs(numbers) <= LARGEST  # a null is a NaN here
    bad = np.zeros(len(sizes), bool)
    bad[np.repeat(np.arange(len(sizes)), sizes)[~good]] = True
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes[(sizes > 0) & ~bad]).tolist():
        rows = np.flatnonzero((sizes == size) & ~bad)
        at = starts[rows][:, None] + np.arange(size)
        out.append((rows, np.floor(numbers[at] * SCALE).astype(np.int64) + SHIFT))
    return sizes, out


def _sums(batches):
    """A row for each length and place: how many vectors, and the sum of their numbers there."""
    release()
    total: dict[int, list] = {}
    for batch in pieces(batches, ROWS):
        for rows, x in integers(batch.column(0))[1]:
            n, s = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
            total[x.shape[1]] = [n + len(rows), s + x.sum(axis=0)]
    for size, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n, np.int64)), pa.array(s)], names=["size", "i", "n", "s"])


def products(y: np.ndarray) -> np.ndarray:
    """y'y, exactly, as whole numbers (of Python, where 64 bits may not hold them)."""
    top = int(np.abs(y).max(initial=0))
    total = np.zeros((y.shape[1], y.shape[1]), np.int64 if top * top * len(y) < 1 << 62 else object)
    if top * top >= EXACT:
        wide = y.astype(total.dtype)
        return total + wide.T @ wide
    step = max(1, EXACT // max(top * top, 1))
    for i in range(0, len(y), step):
        part = y[i : i + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


@dataclass
class Centre:
    """n vectors, their sums, the whole numbers next to the means, and what is left of the sums beyond those."""

    n: int
    middle: np.ndarray
    rest: np.ndarray

    @property
    def shift(self) -> np.ndarray:
        return self.rest / self.n

    def own(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers, less the middle, of the vectors that have this length."""
        for rows, x in integers(column)[1]:
            if x.shape[1] == len(self.middle):
                return rows, x - self.middle
        return np.zeros(0, np.int64), np.zeros((0, len(self.middle)), np.int64)


def centre(vectors: DataFrame, vector: str = "embedding") -> Centre | None:
    """The exact sums; None where no vector is left."""
    prepare(vectors.sparkSession)
    # In decimals, as a sum over very many vectors may outgrow a long.
    sums = vectors.select(vector).mapInArrow(_sums, "size int, i int, n long, s long").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(19,0)")).alias("s"))
    best = sums.where("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    found = sums.where(F.col("size") == best["size"]).orderBy("i").collect()  # a row for each dimension
    n, s = best.n, [int(r.s) for r in found]
    middle = [(2 * x + n) // (2 * n) for x in s]
    return Centre(n, np.array(middle, np.int64), np.array([x - n * m for x, m in zip(s, middle)], np.int64))


def covariance(vectors: DataFrame, at: Centre, vector: str = "embedding") -> np.ndarray:
    """D x D: the mean product of what two dimensions differ from their means by; each number is that of the exact sums."""
    d = len(at.middle)
    upper = np.triu_indices(d)

    def run(batches):
        release()
        total = np.zeros((d, d), object)
        small = np.zeros((d, d), np.int64)
        for batch in pieces(batches, ROWS):
            part = products(at.own(batch.column(0))[1])
            if part.dtype == object or np.abs(part).max(initial=0) > 1 << 61 or np.abs(small).max(initial=0) > 1 << 61:
                total, small = total + part + small, np.zeros((d, d), np.int64)
            else:
                small += part
        total = (total + small)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array([str(v) for v in total])], names=["i", "j", "p"])

    sums = vectors.select(vector).mapInArrow(run, "i int, j int, p string").groupBy("i", "j").agg(F.sum(F.col("p").cast("decimal(38,0)")).alias("p")).toArrow()
    out = np.zeros((d, d))
    rest = at.rest.tolist()
    for i, j, p in zip(*(c.to_pylist() for c in sums.columns)):
        out[i, j] = out[j, i] = (at.n * int(p) - rest[i] * rest[j]) / (at.n * at.n)
    return out


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L', L lower trapezoidal; it ends where no more than rounding is left of the diagonal."""
    a, d = v.copy(), len(v)
    order, low = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if not a[p, p] > least:
            return low[:, :k], order
        if p != k:
            a[[k, p]], order[[k, p]], low[[k, p], :k] = a[[p, k]], order[[p, k]], low[[p, k], :k]
            a[:, [k, p]] = a[:, [p, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns as rounds of pairs that have none in common."""
    ring = [*range(n), *([-1] if n % 2 else [])]
    half, out = len(ring) // 2, []
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[: half - 1 : -1]) if a >= 0 and b >= 0]
        out.append(tuple(np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2)
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def orthogonal_columns(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns rotated in pairs until all are orthogonal to rounding. Pairs of a round have no column in common and are rotated together."""
    g, plan = g.copy(), rounds(g.shape[1])
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for i, j in plan:
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.abs(c) / np.sqrt(np.maximum(a * b, np.finfo(float).tiny))
            worst = max(worst, size.max(initial=0.0))
            turn = size > eps
            if not turn.any():
                continue
            zeta = (b - a) / np.where(turn, 2 * c, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            g[:, i], g[:, j] = cos * x - sin * y, sin * x + cos * y
        if worst <= 8 * eps:
            return g
    return g


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and their unit vectors as columns; the largest entry of each is positive."""
    low, order = pivoted_cholesky(v)
    turned = orthogonal_columns(low)
    values = (turned * turned).sum(axis=0)
    kept = np.argsort(-values, kind="stable")
    kept = kept[values[kept] > 0]
    vectors = np.zeros((len(v), len(kept)))
    vectors[order] = turned[:, kept] / np.sqrt(values[kept])
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))])
    return values[kept], vectors * signs


@dataclass
class Whitening:
    """A centre, the leading components (columns) and their variances, and the whole variance."""

    at: Centre
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened places of vectors that ``Centre.own`` gave."""
        return (y - self.at.shift) @ (self.components / np.sqrt(self.variances))


def fit(vectors: DataFrame, components: int = 8, vector: str = "embedding") -> Whitening | None:
    """Learns from all vectors; None where they have no spread."""
    at = centre(vectors, vector)
    if at is None:
        return None
    v = covariance(vectors, at, vector)
    values, own = eigen(v)
    k = min(components, len(values))
    return Whitening(at, own[:, :k], values[:k], float(np.trace(v))) if k else None


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest entry of the whitened vectors' covariance less the identity, over all of them."""
    k = len(model.variances)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # D x k numbers

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in pieces(batches, ROWS):
            w = shared.value.project(shared.value.at.own(batch.column(0))[1])
            w = np.column_stack([np.ones(len(w)), w])
            total += w.T @ w
        at = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "p"])

    sums = vectors.select(vector).mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()  # (k + 1)^2 rows
    found = np.zeros((k + 1, k + 1))
    for r in sums:
        found[r.i, r.j] = r.p / model.at.n
    mean = found[0, 1:]
    return float(np.abs(found[1:, 1:] - np.outer(mean, mean) - np.eye(k)).max())


def deviations(y: np.ndarray, at: Centre) -> list[int | None]:
    """The sum of (n x - S)^2 of each vector, exactly; null where a long does not hold it."""
    about = (((y - at.shift) * at.n) ** 2).sum(axis=1)
    exact = ((y * at.n - at.rest) ** 2).sum(axis=1)  # right wherever the sum fits
    out: list[int | None] = exact.tolist()
    for i in np.flatnonzero(about > 9.2e18).tolist():
        whole = sum((at.n * int(a) - int(b)) ** 2 for a, b in zip(y[i], at.rest)) if about[i] < 9.3e18 else 1 << 64
        out[i] = whole if whole < 1 << 63 else None
    return out


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, distance2 double"


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: whitened, and besides the number of vectors, the vector's exact deviation from the mean
    (null beyond a long; ``distance2`` is the same over n^2, as a double), the component's share of the variance, and the
    identity error of the whole result."""
    spark = vectors.sparkSession
    model = fit(vectors, components, vector)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(vectors, model, vector)
    k, shared = len(model.variances), spark.sparkContext.broadcast(model)
    explained = model.variances / model.trace

    def run(batches):
        model = shared.value
        for batch in pieces(batches, ROWS):
            rows, y = model.at.own(batch.column(1))
            if not len(rows):
                continue
            ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
            each = lambda values, kind: pa.array(values, kind).take(pa.array(np.repeat(np.arange(len(rows)), k)))
            centred = y - model.at.shift
            columns = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(rows) * k, model.at.n, np.int64)),
                each(deviations(y, model.at), pa.int64()), pa.array(model.project(y).ravel()), pa.array(np.tile(explained, len(rows))),
                pa.array(np.full(len(rows) * k, error)), each((centred * centred).sum(axis=1), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "distance2"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(run, SCHEMA)
