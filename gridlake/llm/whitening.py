"""Whitening of vectors by their leading principal components.

Components become integers, ``floor(scale * c) + shift``, so that sums and products are exact: a first pass
adds them up, a second adds the products of what is left after an integer next to the mean is taken off, and the rest
of the centring is done on the exact sums.  Spectrum slicing finds the leading eigenvalues of the covariance: the signs in an
LDL' factorisation of the covariance less a shift count the eigenvalues below that shift, which is bisected
until each wanted one is alone in its slice.  Rayleigh quotient iteration then converges cubically, and the
counts at both ends of the slice certify the number of the eigenvalue it found.  A third pass measures the covariance of the
whitened values, a fourth returns them.

Covariances have one row per pair of dimensions, whatever the number of vectors; vectors are never exchanged.

Defined results: vectors that are null, empty or hold null or non-finite components, or components whose integer does not fit a
long, are dropped; vectors of each length are a fit list of their own.  Equal eigenvalues take any orthonormal basis of their space.
A component without variance (fewer vectors than components, constant dimensions) has ``whitened`` null and ``explained`` 0 and is no
part of ``identity_error``, which is 0 if no component has variance.  Repeated rows count as often as they occur; a null id stays null; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPS = float(np.finfo(np.float64).eps)
#: vectors whose products are added up together
ROWS = 4096
ENTRIES = "width int, i int, j int, value decimal(38,0)"
WHITENED = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
)


def eigenvalues_below(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix below ``shift``: negative pivots of LDL' with Bunch and Kaufman's pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    limit, below, k, n = (1 + 17**0.5) / 8, 0, 0, len(matrix)

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        pair = False
        column = np.abs(a[k + 1 :, k])
        if len(column) and (off := column.max()) > 0 and abs(a[k, k]) < limit * off:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < limit * off * off:
                if abs(a[r, r]) >= limit * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    pair = True
        if pair:  # a block of two has one eigenvalue of either sign
            c = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
            below, k = below + 1, k + 2
        else:
            d = a[k, k]
            if d:
                c = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(c, c / d)
            below, k = below + (d < 0), k + 1
    return int(below)


def slices_of(matrix: np.ndarray, count: int) -> list[tuple[float, float, int, int]]:
    """Slices (low, high, eigenvalues above high, eigenvalues inside) that hold the ``count`` greatest, from the top.

    A slice holds one eigenvalue, or several that differ by rounding only.
    """
    n = len(matrix)
    reach = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    narrow = 32 * n * EPS * reach

    def above(shift: float) -> int:
        return n - eigenvalues_below(matrix, shift)

    out = []
    todo = [(-narrow - reach * EPS, reach * (1 + 1e-9) + narrow, n, 0)]  # low, high, above low, above high
    while todo:
        low, high, at_low, at_high = todo.pop()
        inside = at_low - at_high
        if not inside or at_high >= count:
            continue
        if inside == 1 or high - low <= narrow:
            out.append((low, high, at_high, inside))
            continue
        middle = (low + high) / 2
        at_middle = above(middle)
        todo.append((low, middle, at_low, at_middle))
        todo.append((middle, high, at_middle, at_high))  # the upper part first
    return sorted(out, reverse=True)


def _solve(matrix: np.ndarray, shift: float, v: np.ndarray, reach: float) -> np.ndarray:
    eye = np.eye(len(matrix))
    for nudge in (0.0, EPS * reach, -4 * EPS * reach, 64 * EPS * reach):
        try:
            w = np.linalg.solve(matrix - (shift + nudge) * eye, v)
        except np.linalg.LinAlgError:
            continue
        size = np.linalg.norm(w)
        if np.isfinite(size) and size > 0:
            return w / size
    raise ArithmeticError("the shifted covariance cannot be solved")


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues, falling, and their unit eigenvectors as rows."""
    n = len(matrix)
    count = min(count, n)
    if not np.any(matrix):
        return np.zeros(count), np.eye(n)[:count]
    reach = float(np.abs(matrix).sum(axis=1).max())
    random = np.random.default_rng(0)
    values, vectors = [], np.zeros((0, n))

    def others_out(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - vectors.T @ (vectors @ v)
        return v / np.linalg.norm(v)

    for low, high, over, inside in slices_of(matrix, count):
        for _ in range(min(inside, count - over)):
            lower, upper = low, high
            while True:
                shift = (lower + upper) / 2
                v = others_out(random.standard_normal(n))
                for _ in range(2):  # towards the eigenvector nearest to the middle
                    v = others_out(_solve(matrix, shift, v, reach))
                value = v @ matrix @ v
                for _ in range(12):
                    residual = np.linalg.norm(matrix @ v - value * v)
                    if residual <= 4 * EPS * reach:
                        break
                    v = others_out(_solve(matrix, value, v, reach))
                    value = v @ matrix @ v
                if lower <= value <= upper or inside > 1 or upper - lower <= 8 * EPS * reach:
                    break
                # it left the slice: halve the slice on the side that the count names
                if n - eigenvalues_below(matrix, shift) > over:
                    lower = shift
                else:
                    upper = shift
            v = others_out(_solve(matrix, value, v, reach)) if residual > EPS * reach else v
            values.append(float(v @ matrix @ v))
            vectors = np.vstack([vectors, v])
    return np.array(values), vectors


def integers(entries: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.floor(scale * entries.astype(np.float64)).astype(np.int64) + shift


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of integers, exact; a matrix of Python integers."""
    most = float(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _valid(vector: Column, scale: int, shift: int) -> Column:
    most = float(1 << 62)
    return (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) + abs(shift) < most)
    )


def _parts(batches: Iterator[pa.RecordBatch], scale: int, shift: int):
    """Vectors of one length as integers, with their ids."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            widths = part.column(1).to_numpy()
            for width in np.unique(widths).tolist():
                some = part.filter(pa.array(widths == width))
                entries = np.asarray(some.column(2).flatten()).reshape(-1, width)
                yield width, some.column(0), integers(entries, scale, shift)


def _entries(found: dict[int, dict[tuple[int, int], int]]) -> Iterator[pa.RecordBatch]:
    for width, values in found.items():
        items = list(values.items())
        for k in range(0, len(items), 1 << 16):
            some = items[k : k + (1 << 16)]
            columns = [
                pa.array([width] * len(some), pa.int32()),
                pa.array([i for (i, _), _ in some], pa.int32()),
                pa.array([j for (_, j), _ in some], pa.int32()),
                pa.array([Decimal(int(v)) for _, v in some], pa.decimal128(38, 0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["width", "i", "j", "value"])


def _adder(scale: int, shift: int):
    """Number of vectors (at -1, -1) and sum of every dimension (at -1, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for width, _, x in _parts(batches, scale, shift):
            high, low = x >> 32, x & 0xFFFFFFFF  # sums of halves fit
            sums = (high.sum(axis=0).astype(object) << 32) + low.sum(axis=0).astype(object)
            found[width] = found.get(width, 0) + np.append(sums, len(x))
        yield from _entries({w: {(-1, -1): s[w], **{(-1, j): s[j] for j in range(w)}} for w, s in found.items()})

    return run


def _multiplier(centres: dict[int, np.ndarray], scale: int, shift: int):
    """Sums of products (at i, j) of what is left without the centre, i up to j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for width, _, x in _parts(batches, scale, shift):
            found[width] = found.get(width, 0) + exact_products(x - centres[width])
        yield from _entries({w: {(i, j): s[i, j] for i in range(w) for j in range(i, w)} for w, s in found.items()})

    return run


def whitened_values(x: np.ndarray, model: dict) -> np.ndarray:
    """Projections on the components over their deviations, nan for components without variance."""
    n, centre, rest = model["n"], model["centre"], model["rest"]
    y = (x - centre).astype(np.float64) - rest / n
    scale = np.where(model["values"] > 0, np.sqrt(np.where(model["values"] > 0, model["values"], 1)), np.nan)
    y = np.ascontiguousarray(y)
    # summed row by row: a matrix product may add in another order for another number of rows
    projected = np.empty((len(y), len(model["vectors"])))
    for k, v in enumerate(model["vectors"]):
        projected[:, k] = (y * v).sum(axis=1)
    return projected / scale


def deviations(x: np.ndarray, model: dict) -> list[int]:
    """Sum over dimensions of ``(n * x - S) ** 2`` of each row, exact."""
    n, rest = model["n"], model["rest_exact"]
    y = x - model["centre"]
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
    if most * most * len(rest) < 1 << 63:
        z = n * y - np.array(rest, np.int64)
        return (z * z).sum(axis=1).tolist()
    z = n * y.astype(object) - np.array(rest, object)
    return (z * z).sum(axis=1).tolist()


def _measurer(models: dict[int, dict], scale: int, shift: int):
    """Sums of whitened values (at -1, j) and of their products (at i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for width, _, x in _parts(batches, scale, shift):
            w = whitened_values(x, models[width])
            w = w[:, models[width]["values"] > 0]
            found[width] = found.get(width, 0) + np.vstack([w.sum(axis=0, keepdims=True), w.T @ w])
        for width, sums in found.items():
            m = sums.shape[1]
            i, j = np.divmod(np.arange(sums.size), max(m, 1))
            names = ["width", "i", "j", "value"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), width), pa.int32()), pa.array(i - 1, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel())], names=names
            )

    return run


def _teller(models: dict[int, dict], scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, ids, x in _parts(batches, scale, shift):
            model = models[width]
            m, rows = len(model["values"]), len(x)
            deviation = pa.array([Decimal(v) for v in deviations(x, model)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(rows), m))
            whitened = whitened_values(x, model).ravel()
            explained = np.tile(model["explained"], rows)
            columns = [
                ids.take(each),
                pa.array(np.tile(np.arange(1, m + 1), rows), pa.int32()),
                pa.array(np.full(m * rows, model["n"]), pa.int64()),
                deviation.take(each),
                pa.array(whitened, mask=np.isnan(whitened)),
                pa.array(explained),
                pa.array(np.full(m * rows, model["identity_error"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_OUT)

    return run


_OUT = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def _summed(rows: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Entries added up over tasks: a row per dimension or pair of dimensions of each length."""
    found: dict[int, dict] = {}
    for r in rows.groupBy("width", "i", "j").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r.width, {})[r.i, r.j] = r.value
    return found


def fit(rows: DataFrame, components: int, scale: int, shift: int) -> dict[int, dict]:
    """For each length of vector: number, sums, leading eigenvalues and unit eigenvectors of the exact covariance."""
    sums = _summed(rows.mapInArrow(_adder(scale, shift), ENTRIES))
    models = {}
    for width, found in sums.items():
        n = int(found[-1, -1])
        total = [int(found[-1, j]) for j in range(width)]
        centre = [(s + n // 2) // n for s in total]
        rest = [s - n * c for s, c in zip(total, centre)]  # sum of what is left, between -n/2 and n/2
        models[width] = {"n": n, "centre": np.array(centre, np.int64), "rest_exact": rest, "rest": np.array([float(t) for t in rest])}
    products = _summed(rows.mapInArrow(_multiplier({w: m["centre"] for w, m in models.items()}, scale, shift), ENTRIES))
    for width, model in models.items():
        n, rest = model["n"], model["rest_exact"]
        covariance = np.empty((width, width))
        for (i, j), v in products[width].items():
            covariance[i, j] = covariance[j, i] = (n * int(v) - rest[i] * rest[j]) / (n * n)
        values, vectors = leading_components(covariance, components)
        trace = float(np.trace(covariance))
        values = np.where(values > 32 * width * EPS * trace, values, 0.0)
        model.update(values=values, vectors=vectors, explained=values / trace if trace else np.zeros(len(values)))
    return models


def whiten(
    vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component.

    ``deviation`` is exact, as a decimal.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("width"), F.col(vector_col).alias("vector"))
    rows = rows.where(_valid(F.col("vector"), scale, shift))
    models = fit(rows, components, scale, shift)
    measured = _summed(rows.mapInArrow(_measurer(models, scale, shift), "width int, i int, j int, value double")) if models else {}
    for width, model in models.items():
        found, n, m = measured.get(width, {}), model["n"], int((model["values"] > 0).sum())
        mean = np.array([found[-1, j] / n for j in range(m)])
        covariance = np.array([[found[i, j] / n for j in range(m)] for i in range(m)]).reshape(m, m) - np.outer(mean, mean)
        model["identity_error"] = float(np.abs(covariance - np.eye(m)).max(initial=0.0))
    return rows.mapInArrow(_teller(models, scale, shift), WHITENED + ", identity_error double")
