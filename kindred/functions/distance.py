"""Distances: as column expressions over unrolled features, and as numpy kernels over blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = str | Callable[[np.ndarray, np.ndarray], float]
#: Bytes of one array of a tile of a block.
TILE_BYTES = 128 << 10


def distance_column(a: Sequence[Column], b: Sequence[Column], metric: str = "minkowski", p: float = 2, w: Sequence[float] | None = None) -> Column:
    """Distance of two rows of feature columns, in generated code."""
    add = lambda parts: reduce(lambda x, y: x + y, parts)
    if metric == "minkowski":
        metric = {1: "manhattan", 2: "euclidean", float("inf"): "chebyshev"}.get(p, "minkowski")
    if metric in ("euclidean", "l2"):
        return F.sqrt(add([(x - y) * (x - y) for x, y in zip(a, b)]))
    if metric in ("manhattan", "l1", "cityblock"):
        return add([F.abs(x - y) for x, y in zip(a, b)])
    if metric in ("chebyshev", "infinity"):
        parts = [F.abs(x - y) for x, y in zip(a, b)]
        return F.greatest(*parts) if len(parts) > 1 else parts[0]
    if metric == "minkowski":
        return F.pow(add([F.pow(F.abs(x - y), F.lit(float(p))) for x, y in zip(a, b)]), F.lit(1.0 / p))
    if metric == "cosine":
        dot = add([x * y for x, y in zip(a, b)])
        return 1 - dot / (F.sqrt(add([x * x for x in a])) * F.sqrt(add([y * y for y in b])))
    if metric == "hamming":
        w = [1.0] * len(a) if w is None else list(w)
        return add([F.when(x != y, F.lit(float(v))).otherwise(0.0) for x, y, v in zip(a, b, w)]) / sum(w)
    raise ValueError(f"Unknown metric: {metric}")


def distance_block(a: np.ndarray, b: np.ndarray, metric: Metric = "minkowski", p: float = 2, w: np.ndarray | None = None) -> np.ndarray:
    """Distances of all rows of one block to all rows of another, from exact differences."""
    if callable(metric):
        return np.array([[metric(x, y) for y in b] for x in a], float).reshape(len(a), len(b))
    if metric == "minkowski":
        metric = {1: "manhattan", 2: "euclidean", float("inf"): "chebyshev"}.get(p, "minkowski")
    if metric == "cosine":
        return 1 - (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    out = np.zeros((len(a), len(b)))
    if metric == "hamming":
        w = np.ones(a.shape[1]) if w is None else np.asarray(w, float)
        for j in range(a.shape[1]):
            out += w[j] * (a[:, j, None] != b[None, :, j])
        return out / w.sum()
    if metric not in ("euclidean", "l2", "manhattan", "l1", "cityblock", "chebyshev", "infinity", "minkowski"):
        raise ValueError(f"Unknown metric: {metric}")
    columns = np.ascontiguousarray(b.T)
    for here, there in _tiles(len(a), len(b), 8):
        _add_features(out[here, there], a[here], columns[:, there], metric, p)
    return _rooted(out, metric, p)


def _tiles(rows: int, columns: int, size: int) -> Iterator[tuple[slice, slice]]:
    """Slices of a block whose arrays of ``size`` bytes a cell stay in a core's cache."""
    high = min(rows, 32)
    wide = max(1, TILE_BYTES // size // max(1, high))
    for j in range(0, columns, wide):
        for i in range(0, rows, max(1, high)):
            yield slice(i, i + high), slice(j, j + wide)


def _add_features(out: np.ndarray, a: np.ndarray, columns: np.ndarray, metric: str, p: float) -> None:
    """Adds up what all features add to the distances of one tile; columns: the other rows, transposed."""
    d, power = np.empty(out.shape), np.empty(out.shape)
    for x, y in zip(a.T, columns):
        np.subtract(x[:, None], y[None, :], out=d)
        if metric in ("euclidean", "l2"):
            np.multiply(d, d, out=d)
        else:
            np.abs(d, out=d)
        if metric in ("chebyshev", "infinity"):
            np.maximum(out, d, out=out)
        elif metric == "minkowski":
            out += _power(d, p, power)
        else:
            out += d


def _power(d: np.ndarray, p: float, out: np.ndarray) -> np.ndarray:
    """d to the power p; by products where p is 3, as a general power costs many times that."""
    if p == 3:
        np.multiply(d, d, out=out)
        return np.multiply(out, d, out=out)
    return np.power(d, p, out=out)


def _rooted(out: np.ndarray, metric: str, p: float) -> np.ndarray:
    if metric in ("euclidean", "l2"):
        return np.sqrt(out)
    return out ** (1.0 / p) if metric == "minkowski" else out


def paired_distances(a: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray, metric: str, p: float) -> np.ndarray:
    """The cells (rows, cols) of :func:`distance_block`; features are added in the same order."""
    if metric == "minkowski":
        metric = {1: "manhattan", 2: "euclidean", float("inf"): "chebyshev"}.get(p, "minkowski")
    out, zero = np.zeros(len(rows)), np.zeros((1, a.shape[1]))
    for i in range(0, len(rows), 2048):
        s = slice(i, i + 2048)
        _add_features(out[None, s], zero, np.ascontiguousarray((b[cols[s]] - a[rows[s]]).T), metric, p)
    return _rooted(out, metric, p)


_DESCRIBED: dict = {}


def _described(b: np.ndarray, how: Callable[[np.ndarray], tuple]) -> tuple:
    """``how(b)``, kept for the blocks of queries that meet the same rows."""
    if how not in _DESCRIBED or _DESCRIBED[how][0] is not b:
        _DESCRIBED[how] = b, how(b)
    return _DESCRIBED[how][1]


def _in_bytes(b: np.ndarray) -> tuple:
    """Squared norms of the rows, their range, its steps and their features cut to bytes, transposed."""
    low, high = b.min(), b.max()
    step = (high - low) / 254
    columns = np.floor((np.ascontiguousarray(b.T) - low) / step).astype(np.uint8) if step > 0 and np.isfinite(step) else None
    return (b * b).sum(1), low, high, step, columns


def _in_singles(b: np.ndarray) -> tuple:
    """Mean, size of the largest feature beside it, the rows in these terms at single precision, and their squared norms."""
    centre = b.mean(axis=0)
    scale = max(float((b.max(axis=0) - centre).max()), float((centre - b.min(axis=0)).max()))
    if not 0 < scale < np.inf:
        return centre, 0.0, b, b
    out = np.empty(b.shape, np.float32)
    for i in range(0, len(b), 4096):
        out[i : i + 4096] = (b[i : i + 4096] - centre) / scale
    return centre, scale, out, np.einsum("ij,ij->i", out, out)


def power_candidates(a: np.ndarray, b: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (row of a, row of b) that hold at least the k nearest rows (and all that tie with them) by a power p above 2;
    None where too many are left.

    Rows are centred and scaled to single precision. In each of 4 k parts of b the nearest row by one matrix product bounds
    the k-th distance from above. The distance is no less than the Euclidean one over d^(1/2 - 1/p), which the product has;
    of the pairs within that the distance at single precision decides. Both bounds allow for their rounding.
    """
    centre, scale, there, nb = _described(b, _in_singles)
    if not scale:
        return None
    here, width = (a - centre) / scale, a.shape[1]
    if p * np.log(np.abs(here).max(initial=0) + 2) + np.log(width) > 80:  # sums have to fit single precision
        return None
    here = here.astype(np.float32)
    na = np.einsum("ij,ij->i", here, here)
    near = here @ there.T
    near *= -2
    near += nb
    edges = np.linspace(0, len(b), min(len(b), 4 * k) + 1).astype(int)
    first = np.stack([i + near[:, i:j].argmin(axis=1) for i, j in zip(edges, edges[1:])], axis=1)
    exact = paired_distances(a, np.repeat(np.arange(len(a)), first.shape[1]), b, first.ravel(), "minkowski", p).reshape(first.shape)
    reach = np.partition(exact, k - 1, axis=1)[:, k - 1] / scale * (1 + 1e-9)
    unit = float(np.finfo(np.float32).eps)
    slack = unit * (2 * width + 32) * (na.astype(float) + float(nb.max()))
    most = (reach * width ** (0.5 - 1 / p)) ** 2 * (1 + 4 * unit) + slack - na
    found = np.flatnonzero(near <= np.nextafter(most.astype(np.float32), np.float32(np.inf))[:, None])
    if len(found) > near.size // 8:
        return None
    rows, cols = np.divmod(found, len(b))
    # of a power: rounding of the rows by the triangle inequality, of the sum in proportion
    size = np.abs(here).max(axis=1).astype(float) + 1
    limit = ((reach + 2 * unit * size * width ** (1 / p)) * (1 + unit * (width + 32))) ** p
    keep = np.empty(len(rows), bool)
    for i in range(0, len(rows), 1024):
        s = slice(i, i + 1024)
        d = there[cols[s]]
        d -= here[rows[s]]
        np.abs(d, out=d)
        keep[s] = _power(d, p, np.empty_like(d)).sum(axis=1) <= limit[rows[s]]
    return rows[keep], cols[keep]


def chebyshev_candidates(a: np.ndarray, b: np.ndarray, k: int, metric: str, p: float) -> np.ndarray:
    """A mask that holds at least the k nearest rows (and all that tie with them) by the largest difference.

    The rows nearest by one matrix product bound the k-th distance from above; the largest difference is no less than that
    of features cut to bytes.
    """
    na, (nb, low, high, step, columns) = (a * a).sum(1), _described(b, _in_bytes)
    near = a @ b.T
    near *= -2
    near += nb
    near += na[:, None]
    some = min(len(b), 4 * k)
    first = np.argpartition(near, some - 1, axis=1)[:, :some]
    exact = paired_distances(a, np.repeat(np.arange(len(a)), some), b, first.ravel(), metric, p).reshape(len(a), some)
    reach = np.partition(exact, k - 1, axis=1)[:, k - 1] * (1 + 1e-9)
    if columns is None:
        return np.ones(near.shape, bool)
    # rows of b are in range, so that cutting a's values to it makes no difference larger; flooring changes one by less than a step
    qa = np.floor((np.clip(a, low, high) - low) / step).astype(np.uint8)
    most = np.minimum(np.floor(reach / step + 1e-6) + 1, 127).astype(np.uint8)
    # b - a + most is at most 2 most where the bytes are near enough; bytes that wrap around let some more in
    qa = most[:, None] - qa
    limit = np.where(most < 127, 2 * most, 255).astype(np.uint8)
    out = np.empty(near.shape, bool)
    for here, there in _tiles(len(a), len(b), 2):
        shape = out[here, there].shape
        held, sums = np.zeros(shape, np.uint8), np.empty(shape, np.uint8)
        for x, y in zip(qa[here].T, columns[:, there]):
            np.add(y[None, :], x[:, None], out=sums)
            np.maximum(held, sums, out=held)
        np.less_equal(held, limit[here, None], out=out[here, there])
    return out


def euclidean_candidates(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """A mask that holds at least the k nearest rows (and all that tie with them) by one matrix product.

    The product's rounding error is bounded by the rows' norms, so candidates within it stay in.
    """
    na, nb = (a * a).sum(1), (b * b).sum(1)
    near = na[:, None] + nb[None, :] - 2 * (a @ b.T)
    slack = 1e-12 * a.shape[1] * (na + nb.max())
    return near <= np.partition(near, k - 1, axis=1)[:, k - 1, None] + slack[:, None]
