"""Whitening of embeddings along the leading eigenvectors of their covariance, found by mixed-precision refinement.

Vectors are put on a grid (``floor(256 * c)``), so everything that is summed over the table is an integer and exact: the sums per
dimension, and the products of entries after an integer near the mean is taken off. Partial sums of any order, and of tasks
that ran twice, give the same covariance; the remaining fraction of the mean is corrected in exact arithmetic on the
driver, which holds one number per pair of dimensions whatever the table's size.

The eigenvectors start as those of the covariance in float32 and are corrected by Ogita-Aishima steps, four matrix products each, in
the widest floating-point type of the machine. Pairs of eigenvalues nearer than the step can tell apart form clusters; the
covariance restricted to a cluster, shifted by its mean, is a small problem of its own scale that is solved in the same way, so
that its float32 start resolves differences that were below float32 in the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.session import hand_over, release_shuffles

COMPONENTS = 4
GRID = 256
ROUNDS = 40  # refinement steps; a few are enough, as errors square with each
SAFE = 1 << 24  # entries up to this size are multiplied as float64 without rounding
ROWS = 8192  # vectors multiplied at once; ROWS * SAFE**2 fits a long
WIDE = np.longdouble
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def refined_eigenpairs(matrix: np.ndarray, noise: np.longdouble | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in ``WIDE``. Differences up to ``noise`` count as equal
    eigenvalues, of which any basis serves."""
    a = (matrix.astype(WIDE) + matrix.T.astype(WIDE)) / 2
    size, eps = len(a), np.finfo(WIDE).eps
    scale = np.abs(a).max(initial=WIDE(0))
    noise = scale * size * eps if noise is None else noise
    if size < 2 or scale <= noise:
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(size, dtype=WIDE)[:, order]
    x = np.linalg.eigh((a / scale).astype(np.float32))[1].astype(WIDE)
    one, norm, solved = np.eye(size, dtype=WIDE), np.linalg.norm(a), False
    for _ in range(ROUNDS):
        r, s = one - x.T @ x, x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small gap is no rotation
        values = np.diag(s) / (1 - np.diag(r))
        unsure = 2 * (np.linalg.norm(s - np.diag(np.diag(s))) + norm * np.linalg.norm(r))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > max(unsure, noise)
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        clusters = _clusters(values, unsure) if unsure > noise else []
        settled = np.abs(step) <= 16 * size * eps + np.where(apart, 4 * noise / np.where(apart, np.abs(gap), 1), 0)
        if settled.all() and (solved or not clusters):
            break
        x = x + x @ step
        for members in clusters:
            part = x[:, members]
            inner = part.T @ a @ part
            inner = (inner + inner.T) / 2 - np.diag(np.full(len(members), np.diag(inner).mean()))
            x[:, members] = part @ refined_eigenpairs(inner, noise)[1]
        solved = bool(clusters)
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def _clusters(values: np.ndarray, width: np.longdouble) -> list[np.ndarray]:
    """Indices of two or more values whose neighbours in order are at most ``width`` apart."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [members for members in np.split(order, cuts) if len(members) > 1]


def _grid_vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and grid vectors (int64) of the usable vectors, those of one length at a time."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == dims)
        entries = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        entries = entries.reshape(len(rows), dims)
        usable = np.isfinite(entries).all(axis=1)
        limit = float(1 << 63)
        # beyond a long, an entry is the nearest long that a double holds
        with np.errstate(over="ignore"):
            cells = np.clip(np.floor(GRID * entries[usable]), -limit, np.nextafter(limit, 0)).astype(np.int64)
        yield rows[usable], cells


def _pack(cells: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest of three integer widths, so equal vectors have equal bytes."""
    out: list[bytes] = [b""] * len(cells)
    low, high = (cells.min(axis=1), cells.max(axis=1)) if cells.shape[1] else (np.zeros(len(cells)),) * 2
    left = np.ones(len(cells), dtype=bool)
    for kind in ("<i2", "<i4", "<i8"):
        limits = np.iinfo(kind)
        chosen = np.flatnonzero(left & (low >= limits.min) & (high <= limits.max))
        left[chosen] = False
        raw, width = cells[chosen].astype(kind).tobytes(), cells.shape[1] * np.dtype(kind).itemsize
        for k, row in enumerate(chosen.tolist()):
            out[row] = raw[k * width : (k + 1) * width]
    return out


def _unpack(column: pa.BinaryArray, dims: int) -> np.ndarray:
    vectors = [x.as_py() for x in column]
    out = np.empty((len(vectors), dims), dtype=np.int64)
    for k, raw in enumerate(vectors):
        out[k] = np.frombuffer(raw, f"<i{len(raw) // dims}")
    return out


def _distinct_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, cells in _grid_vectors(batch.column(0)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), cells.shape[1]), pa.int32()), pa.array(_pack(cells), pa.binary())], names=["dims", "x"]
            )


LIMBS = ("low", "middle", "high")


def _limbs(total: np.ndarray) -> list[np.ndarray]:
    """Integers of any size as longs, 48 bits in each but the last."""
    return [(part & ((1 << 48) - 1) if k < 2 else part).astype(np.int64) for k, part in enumerate((total, total >> 48, total >> 96))]


def _limb_batch(names: str, columns: list[np.ndarray], total: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64() if name == "n" else pa.int32() for name in names.split()] + [pa.int64()] * len(LIMBS)
    arrays = [pa.array(c, t) for c, t in zip([*columns, *_limbs(total)], kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[*names.split(), *LIMBS])


def _sums(dims: int):
    """Per task a row per dimension: vectors, and the limbs of their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, dtype=object), np.zeros(dims, dtype=object)
        for batch in batches:
            x = _unpack(batch.column(0), dims)
            n += len(x)
            high += (x >> 20).sum(axis=0).astype(object)
            low += (x & ((1 << 20) - 1)).sum(axis=0).astype(object)
        if n:
            yield _limb_batch("i n", [np.arange(dims), np.full(dims, n)], high * (1 << 20) + low)

    return run


def _products(centre: list[int]):
    """Per task a row per pair of dimensions: the limbs of the exact sum of products of entries less ``centre``."""
    dims = len(centre)
    upper = np.triu_indices(dims)

    def product(y: np.ndarray) -> np.ndarray:
        if y.dtype == object:
            return (y.T @ y)[upper]
        total, peak = np.zeros((dims, dims), dtype=np.int64), max(1, int(np.abs(y).max(initial=0)))
        rows = max(1, (1 << 53) // (peak * peak))
        for k in range(0, len(y), rows):
            part = y[k : k + rows].astype(np.float64)
            total += (part.T @ part).astype(np.int64)
        return total[upper]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(upper[0]), dtype=object), False
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                x = _unpack(batch.column(0).slice(k, ROWS), dims)
                y = x.astype(object) - np.array(centre, dtype=object) if max(map(abs, centre)) + int(np.abs(x).max(initial=0)) > SAFE else x - np.array(centre)
                total, seen = total + product(y).astype(object), True
        if seen:
            yield _limb_batch("i j", list(upper), total)

    return run


def _exact(frame: DataFrame, *keys: str) -> dict[tuple, int]:
    sums = frame.groupBy(*keys).agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in LIMBS))
    return {tuple(r[k] for k in keys): sum(int(r[c]) << 48 * p for p, c in enumerate(LIMBS)) for r in sums.collect()}


def _wide(number: int) -> np.longdouble:
    near = float(number)
    return WIDE(near) + WIDE(float(number - int(near)))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: int64 where that holds every result, else Python's integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _deviation(centred: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; null where it passes a long."""
    dims = centred.shape[1]
    if centred.dtype != object and dims * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    totals = [sum(int(v) ** 2 for v in row) for row in centred]
    return [t if t < 1 << 63 else None for t in totals]


class Whitening:
    """What the fit leaves: ``n`` vectors with ``sums`` per dimension, and per component its direction, eigenvalue and explained part."""

    def __init__(self, n: int, sums: list[int], products: dict[tuple, int], centre: list[int], components: int):
        dims = len(sums)
        self.n, self.sums = n, sums
        rest = [s - n * m for s, m in zip(sums, centre, strict=True)]
        self.covariance = np.empty((dims, dims), dtype=WIDE)
        for (i, j), total in products.items():
            self.covariance[i, j] = self.covariance[j, i] = _wide(n * total - rest[i] * rest[j]) / _wide(n * n)
        values, vectors = refined_eigenpairs(self.covariance)
        trace = np.trace(self.covariance)
        self.count = min(components, dims)
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)])
        self.directions = (vectors * signs).astype(np.float64)[:, : self.count]
        self.eigenvalues = [float(v) if v > trace * dims * np.finfo(np.float64).eps else 0.0 for v in values[: self.count]]
        self.explained = [float(v / trace) if trace > 0 else None for v in values[: self.count]]

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """A column per component that has variance."""
        some = [k for k, e in enumerate(self.eigenvalues) if e > 0]
        return (centred / self.n).astype(np.float64) @ self.directions[:, some] / np.sqrt([self.eigenvalues[k] for k in some])

    def identity_error(self, fit: DataFrame) -> float | None:
        """Largest absolute entry of the whitened vectors' measured covariance less the identity."""
        k = sum(e > 0 for e in self.eigenvalues)
        if not k:
            return None

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for batch in batches:
                z = self.whiten(_centred(_unpack(batch.column(0), len(self.sums)), self.n, self.sums))
                total[0] += z.sum(axis=0)
                total[1:] += z.T @ z
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

        rows = fit.mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
        total = np.zeros((k + 1, k))
        for r in rows:
            total[r.i, r.j] = r.value
        total /= self.n
        return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of the packed vectors ``x`` of ``fit``, a written table as it is read more than once."""
    sums = fit.mapInArrow(_sums(dims), "i int, n long, low long, middle long, high long")
    n = sums.filter("i = 0").agg(F.sum("n")).first()[0]
    found = _exact(sums, "i")
    totals = [found[(i,)] for i in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in totals]  # the integer nearest the mean
    products = _exact(fit.mapInArrow(_products(centre), "i int, j int, low long, middle long, high long"), "i", "j")
    return Whitening(n, totals, products, centre, components)


def whiten_embeddings(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component (from 1, by falling eigenvalue): ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``
    and ``identity_error``.

    Rows are dropped whose vector is null or holds a null or a number that is not finite, or has another length than most distinct
    vectors have (of equally common lengths the longest counts). The fit takes each distinct grid vector once, so repeated
    vectors have no weight, but every repeated row gets its results; null ids are kept. ``deviation`` is null beyond a
    long. A component without variance has a null ``whitened``, and ``identity_error`` covers the others; where nothing varies,
    ``explained`` and ``identity_error`` are null. An empty table gives no rows. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    distinct = rows.select("vector").mapInArrow(_distinct_vectors, "dims int, x binary").distinct()
    fit = hand_over(distinct, "grid-vectors")
    release_shuffles(spark)
    common = fit.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common.dims if common else 0
    if not dims:
        return spark.createDataFrame([], RESULT)
    fit = fit.filter(F.col("dims") == dims).select("x")
    model = fit_whitening(fit, dims, components)
    error = model.identity_error(fit)
    columns = [f.split()[0] for f in RESULT.split(", ")]
    some = [k for k, e in enumerate(model.eigenvalues) if e > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, cells in _grid_vectors(batch.column(1)):
                if cells.shape[1] != dims:
                    continue
                ids = batch.column(0).take(pa.array(numbers))
                centred = _centred(cells, model.n, model.sums)
                deviation, z = pa.array(_deviation(centred), pa.int64()), model.whiten(centred)
                for k in range(model.count):
                    n = len(ids)
                    whitened = pa.array(z[:, some.index(k)]) if k in some else pa.nulls(n, pa.float64())
                    constant = lambda value, kind: pa.array([value] * n, kind)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [ids, constant(k + 1, pa.int32()), constant(model.n, pa.int64()), deviation, whitened,
                         constant(model.explained[k], pa.float64()), constant(error, pa.float64())],
                        names=columns,
                    )

    return rows.mapInArrow(run, RESULT)
