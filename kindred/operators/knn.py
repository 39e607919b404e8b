"""The nearest-neighbour join.

``NeighbourIndex`` holds reference rows in ascending id order; a row's place in that order is its position.
The k rows are chosen by (distance, position) and then ordered by (distance scaled and rounded, distance of
positions, position). Three physical plans give the same rows:

* ``block``: references broadcast (their size is checked), each query block meets them in one task; no shuffle; few
  features are searched along the widest of them, in windows that hold all rows near enough;
* ``grid``: references too large to broadcast are dealt to blocks, partial nearest rows are merged by query;
* ``columns``: unrolled column arithmetic and a window, all in SQL operators, for few references.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.distance import Metric, chebyshev_candidates, distance_block, distance_column, euclidean_candidates, paired_distances, power_candidates
from kindred.functions.linalg import matrix_of
from kindred.functions.storage import materialised

#: Decimals to which scaled distances are rounded before ties are broken.
DECIMALS = 10
#: Largest reference matrix that is broadcast, in bytes.
BROADCAST_BYTES = 128 << 20
#: Distances held at once by a task.
BLOCK_CELLS = 2_000_000
#: Times as many for distances by a power above 2, which are looked for at single precision.
SINGLE_BLOCKS = 4
GRID_ROWS = 20_000
#: Ids of queries that are sorted on the driver for the tie rule, in bytes; more are numbered by a range exchange.
ID_BYTES = 32 << 20
#: Features up to which, and reference rows from which, windows along one feature pay; queries that share a window.
WINDOW_FEATURES, WINDOW_ROWS, WINDOW_QUERIES = 4, 1_000, 48
#: References in a bucket of the plan by columns.
COLUMN_ROWS = 64


def with_position(df: DataFrame, id_col: str, name: str = "position") -> DataFrame:
    """Rows numbered from 0 in ascending id order by one range exchange; the driver gets a count a partition."""
    ordered = df.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).withColumn("_m", F.monotonically_increasing_id())
    kept = materialised(ordered, "positions")
    part = F.shiftright("_m", 33)
    counts = sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _o long")
    numbered = kept.join(F.broadcast(table), part == F.col("_p"))
    return numbered.select(*df.columns, (F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias(name))


def order_neighbours(distance: np.ndarray, position: np.ndarray, query: np.ndarray, decimals: int = DECIMALS) -> np.ndarray:
    """For each row of (distance, position) the order of the deterministic tie rule."""
    scale = np.maximum(distance.max(axis=1, keepdims=True), 1.0)
    rounded = np.rint(distance / scale * 10.0**decimals)
    rows = np.repeat(np.arange(len(distance)), distance.shape[1])
    order = np.lexsort((position.ravel(), np.abs(query[:, None] - position).ravel(), rounded.ravel(), rows))
    return order.reshape(distance.shape) - np.arange(len(distance))[:, None] * distance.shape[1]


class NeighbourIndex:
    """Reference rows: ids, feature matrix and, if wanted, numeric targets; or the table itself if it is too large."""

    def __init__(self, references: DataFrame, id_col: str, features: str, targets: Sequence[str] = (), metric: Metric = "minkowski", p: float = 2, w: Sequence[float] | None = None, broadcast_bytes: int = BROADCAST_BYTES):
        self.id_col, self.features, self.targets = id_col, features, list(targets)
        self.metric, self.p, self.w = metric, p, None if w is None else np.asarray(w, float)
        self.repeated = False
        self.source = references
        self.table = references.select(F.col(f"`{id_col}`"), F.col(f"`{features}`"), *[F.col(f"`{t}`") for t in targets])
        size = references.agg(F.count("*"), F.max(F.size(features)), F.min(F.size(features))).first()
        self.n, self.width = size[0], size[1] or 0
        if size[1] != size[2]:
            raise ValueError("reference rows have different numbers of features")
        self.local = self.n * (self.width + len(self.targets) + 1) * 8 <= broadcast_bytes
        if self.local:
            rows = self.table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{features}`").alias("x"), F.array(*[F.col(f"`{t}`").cast("double") if isinstance(self.table.schema[t].dataType, T.NumericType) else F.lit(None) for t in targets]).cast("array<double>").alias("y")).toArrow()
            rows = rows.sort_by("id").combine_chunks()
            self.ids, self.id_type = np.array(rows["id"].to_pylist()), rows["id"].type
            self.x = (matrix_of(rows["x"].combine_chunks()) if self.n else np.zeros((0, 0))).astype(float)
            self.y = matrix_of(rows["y"].combine_chunks()).astype(float).reshape(self.n, -1) if targets else np.zeros((self.n, 0))
            if self.n and (self.ids[1:] == self.ids[:-1]).any():  # rows of one id are told apart by their features
                order = np.lexsort([*self.y.T[::-1], *self.x.T[::-1], np.unique(self.ids, return_inverse=True)[1]])
                self.ids, self.x, self.y = self.ids[order], self.x[order], self.y[order]
                self.repeated = True
            order, starts = equal_rows(self.x)
            self.n_classes, self.classes = len(starts), (order, starts) if 2 * len(starts) <= self.n else None
        else:
            self.numbered = with_position(self.table, id_col, "_position")
            self.repeated = not self.numbered.groupBy(F.col(f"`{id_col}`")).count().where("count > 1").isEmpty()

    def table_with(self, columns: Sequence[str]) -> DataFrame:
        """Columns of the references by ``neighbor_id``."""
        return self.source.select(F.col(f"`{self.id_col}`").alias("neighbor_id"), *[F.col(f"`{c}`") for c in columns])

    def _checked(self, k: int, self_join: bool) -> None:
        if not 1 <= k <= self.n - self_join:
            raise ValueError(f"Expected 1 <= n_neighbors <= {self.n - self_join}, but n_neighbors = {k}")

    def search(self, x: np.ndarray, k: int, own: np.ndarray | None, query: np.ndarray | None, deterministic: bool, decimals: int = DECIMALS) -> tuple[np.ndarray, np.ndarray]:
        """(distance, position) arrays of shape (rows, k). own: a position that each row may not have. NaN and infinity are an error."""
        if not np.isfinite(x).all():
            raise ValueError("Query features contain NaN or infinity")
        dist, pos = [], []
        if self.width <= WINDOW_FEATURES and self.n >= WINDOW_ROWS and self.w is None and self.n_classes >= WINDOW_ROWS and _is_minkowski(self.metric, self.p):
            d, q = self._windows(x, k, own)
            return self._ordered(d, q, query if deterministic else None, decimals)
        if self.classes and len(x):
            d, q = self._by_classes(x, k, own)
            return self._ordered(d, q, query if deterministic else None, decimals)
        cells = BLOCK_CELLS * (SINGLE_BLOCKS if 2 < _power_of(self.metric, self.p) < np.inf else 1)
        step = max(1, cells // max(1, self.n))
        for i in range(0, len(x), step):
            d, q = nearest(x[i : i + step], self.x, k, self.metric, self.p, self.w, None if own is None else own[i : i + step])
            if deterministic and query is not None:
                o = order_neighbours(d, q, query[i : i + step], decimals)
                d, q = np.take_along_axis(d, o, 1), np.take_along_axis(q, o, 1)
            dist.append(d)
            pos.append(q)
        return (np.concatenate(dist), np.concatenate(pos)) if dist else (np.zeros((0, k)), np.zeros((0, k), int))

    @staticmethod
    def _ordered(d: np.ndarray, q: np.ndarray, query: np.ndarray | None, decimals: int) -> tuple[np.ndarray, np.ndarray]:
        for i in range(0, len(d) if query is not None else 0, 100_000):
            o = order_neighbours(d[i : i + 100_000], q[i : i + 100_000], query[i : i + 100_000], decimals)
            d[i : i + 100_000], q[i : i + 100_000] = np.take_along_axis(d[i : i + 100_000], o, 1), np.take_along_axis(q[i : i + 100_000], o, 1)
        return d, q

    def _by_classes(self, x: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`search` where many references have the same features: distances are those of different rows only. Of
        every class as near as the k-th, all that tie included, its first rows by position can be among the k."""
        order, starts = self.classes
        sizes, kept = np.diff(starts, append=self.n), self.x[order[starts]]
        most = k + (own is not None)
        asks, begin = equal_rows(x)
        which = np.empty(len(x), np.int64)
        which[asks] = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(x)))
        different = x[asks[begin]]
        dist, pos = np.empty((len(different), most)), np.empty((len(different), most), np.int64)
        step = max(1, BLOCK_CELLS // len(kept))
        for i in range(0, len(different), step):
            rows, near, d = _near(different[i : i + step], kept, min(most, len(kept)), self.metric, self.p, self.w, None)
            many = np.minimum(sizes[near], most)
            at = np.repeat(starts[near], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            dist[i : i + step], pos[i : i + step] = _first(np.repeat(rows, many), np.repeat(d, many), order[at], most)
        dist, pos = dist[which], pos[which]
        if own is None:
            return dist, pos
        mine = pos == own[:, None]
        mine[~mine.any(axis=1), -1] = True
        return dist[~mine].reshape(-1, k), pos[~mine].reshape(-1, k)

    def _windows(self, x: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`search` along the feature of most spread: no distance is less than the difference in one feature, so the
        rows within the k-th distance found so far hold all that are nearer, and all that tie."""
        if not hasattr(self, "_along"):
            axis = int(np.argmax(self.x.std(axis=0)))
            order = np.argsort(self.x[:, axis], kind="stable")
            self._along = axis, order, self.x[order], self.x[order, axis]
        axis, order, rows, line = self._along
        dist, pos = np.empty((len(x), k)), np.empty((len(x), k), np.int64)
        asked = np.argsort(x[:, axis], kind="stable")
        for i in range(0, len(asked), WINDOW_QUERIES):
            part = asked[i : i + WINDOW_QUERIES]
            a, mine = x[part], None if own is None else own[part]
            low, high = a[0, axis], a[-1, axis]
            lo, hi = max(0, int(np.searchsorted(line, low)) - 2 * k - 2), min(self.n, int(np.searchsorted(line, high, "right")) + 2 * k + 2)
            while True:
                d = distance_block(a, rows[lo:hi], self.metric, self.p)
                if mine is not None:
                    d[order[None, lo:hi] == mine[:, None]] = np.inf
                reach = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) if hi - lo >= k else np.full(len(a), np.inf)
                # slack for the rounding of distances
                need = int(np.searchsorted(line, (a[:, axis] - reach).min() * (1 - 1e-12) if np.isfinite(reach).all() else -np.inf)), int(np.searchsorted(line, (a[:, axis] + reach).max(), "right"))
                if need[0] >= lo and need[1] <= hi:
                    break
                lo, hi = min(lo, need[0]), max(hi, need[1])
            at, cols = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None])
            value, where = d[at, cols], order[lo + cols]
            by = np.lexsort((where, value, at))
            at, value, where = at[by], value[by], where[by]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            dist[part], pos[part] = value[keep].reshape(-1, k), where[keep].reshape(-1, k)
        return dist, pos


def _is_minkowski(metric: Metric, p: float) -> bool:
    return metric in ("euclidean", "l2", "manhattan", "l1", "cityblock", "chebyshev", "infinity") or metric == "minkowski" and p >= 1


def nearest(a: np.ndarray, b: np.ndarray, k: int, metric: Metric, p: float, w: np.ndarray | None, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of b nearest to each row of a, by (distance, position)."""
    rows, cols, d = _near(a, b, k, metric, p, w, own)
    return _first(rows, d, cols, k)


def _first(rows: np.ndarray, d: np.ndarray, cols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs the first k of each row, by (distance, position)."""
    order = np.lexsort((cols, d, rows))
    rows, cols, d = rows[order], cols[order], d[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return d[keep].reshape(-1, k), cols[keep].reshape(-1, k)


def _near(a: np.ndarray, b: np.ndarray, k: int, metric: Metric, p: float, w: np.ndarray | None, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row of b, distance) of pairs that hold the k nearest of each row and all that tie with them."""
    wide, asked = a.shape[1] > 12 and len(b) > 4 * k and not callable(metric), k + (own is not None)
    pairs, mask, power = None, None, _power_of(metric, p) if wide and w is None else 0
    if wide and (metric in ("euclidean", "l2") or metric == "minkowski" and p == 2):
        mask = euclidean_candidates(a, b, min(len(b), asked))
    elif power > 2 and np.isinf(power):
        mask = chebyshev_candidates(a, b, min(len(b), asked), metric, power)
        if mask.sum() > mask.size // 8:
            mask = None
    elif power > 2:
        pairs = power_candidates(a, b, min(len(b), asked), power)
    if mask is not None or pairs is not None:
        rows, cols = pairs or np.nonzero(mask)
        d = np.sqrt(((a[rows] - b[cols]) ** 2).sum(1)) if not power > 2 else paired_distances(a, rows, b, cols, metric, power)
        if own is not None:
            keep = cols != own[rows]
            rows, cols, d = rows[keep], cols[keep], d[keep]
        return rows, cols, d
    full = distance_block(a, b, metric, p, w)
    if own is not None:
        full[np.arange(len(a)), own] = np.inf
    rows, cols = np.nonzero(full <= np.partition(full, k - 1, axis=1)[:, k - 1, None])
    return rows, cols, full[rows, cols]


def _power_of(metric: Metric, p: float) -> float:
    """The power of a metric of Minkowski's family, or 0."""
    return {"chebyshev": np.inf, "infinity": np.inf, "euclidean": 2, "l2": 2, "manhattan": 1, "l1": 1, "cityblock": 1, "minkowski": p}.get(metric, 0)


def equal_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in an order that has equal ones side by side, by their number, and where each class begins."""
    order = np.lexsort(x.T[::-1]) if x.shape[1] else np.arange(len(x))
    there = x[order]
    return order, np.flatnonzero(np.concatenate([[True], (there[1:] != there[:-1]).any(axis=1)])) if len(x) else np.zeros(0, int)


def kneighbors(index: NeighbourIndex, queries: DataFrame | None = None, k: int = 5, id_col: str | None = None, features: str | None = None, deterministic: bool = True, decimals: int = DECIMALS, position_col: str | None = None, strategy: str = "auto") -> DataFrame:
    """Long form (query_id, rank from 1, neighbor_position, neighbor_id, distance).

    ``queries=None`` joins the references with themselves, each without itself. Queries are numbered by
    ascending id for the tie rule unless ``position_col`` has their positions.
    """
    self_join = queries is None
    index._checked(k, self_join)
    id_col, features = id_col or index.id_col, features or index.features
    if strategy == "auto":
        strategy = "block" if index.local else "grid"
    if strategy == "block":
        return _block(index, queries, k, id_col, features, deterministic, decimals, position_col)
    if self_join and not index.local:
        source = index.numbered.select(id_col, features, "_position")
    elif self_join:
        source = index.table.select(id_col, features)
    else:
        source = queries.select(id_col, features, *([F.col(position_col).alias("_position")] if position_col else []))
        if deterministic and not position_col:
            source = with_position(source, id_col, "_position")
    if strategy == "grid":
        return _grid(index, source, k, self_join, id_col, features, deterministic, decimals)
    if index.repeated:
        raise ValueError("This plan needs reference ids that are not repeated")
    return _columns(index, source, k, self_join, id_col, features, deterministic, decimals)


def query_rows(index: NeighbourIndex, queries: DataFrame | None, id_col: str, features: str, ordered: bool, position_col: str | None = None) -> tuple[DataFrame, np.ndarray | None]:
    """What :func:`found_for` takes for a local index: positions where the references ask for themselves; else ids and
    features, with positions where the order needs them: from a column, from the sorted ids that come along, or numbered."""
    if queries is None:
        spark = index.source.sparkSession
        return spark.range(0, index.n, 1, max(1, min(index.n // 256, 2 * spark.sparkContext.defaultParallelism))), None
    name, vector = F.col(f"`{id_col}`").alias("_id"), F.col(f"`{features}`").alias("_x")  # names that Arrow functions take
    if position_col:
        return queries.select(name, vector, F.col(f"`{position_col}`").alias("_position")), None
    source = queries.select(name, vector)
    if not ordered:
        return source, None
    size = source.agg(F.sum(F.octet_length(F.col("_id").cast("string")) + 8), F.count(F.when(F.col("_id").isNull(), 1))).first()
    if size[1] or (size[0] or 0) > ID_BYTES:
        return with_position(source, "_id", "_position"), None
    return source, np.sort(np.array(source.select("_id").toArrow()["_id"].to_pylist()))


def _block(index: NeighbourIndex, queries: DataFrame | None, k: int, id_col: str, features: str, deterministic: bool, decimals: int, position_col: str | None) -> DataFrame:
    source, ids = query_rows(index, queries, id_col, features, deterministic, position_col)
    shared, metric, self_join = source.sparkSession.sparkContext.broadcast((index_state(index), ids)), index.metric, queries is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sorted_ids = shared.value
        own.metric = metric
        for batch in batches:
            if not batch.num_rows:
                continue
            d, pos, asked = found_for(own, batch, k, self_join, deterministic, decimals, sorted_ids)
            n = len(d)
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(pos.ravel().astype(np.int64)), pa.array(own.ids[pos.ravel()], own.id_type), pa.array(d.ravel())], _NAMES)

    own_kind = index.table.schema[index.id_col].dataType.simpleString()
    kind = own_kind if self_join else source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"query_id {kind}, rank int, neighbor_position long, neighbor_id {own_kind}, distance double")


_NAMES = ["query_id", "rank", "neighbor_position", "neighbor_id", "distance"]


def index_state(index: NeighbourIndex) -> NeighbourIndex:
    """What a task needs of an index, but for the metric, which may be a function and goes with the task."""
    import copy

    out = copy.copy(index)
    for name in ("source", "table", "numbered", "metric"):
        out.__dict__.pop(name, None)
    return out


def found_for(own: NeighbourIndex, batch: pa.RecordBatch, k: int, self_join: bool, deterministic: bool, decimals: int = DECIMALS, sorted_ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distances and positions of the neighbours of a batch from :func:`query_rows`, and the ids that ask."""
    if self_join:
        query = batch.column(0).to_numpy()
        d, pos = own.search(own.x[query], k, query, query, deterministic, decimals)
        return d, pos, pa.array(own.ids[query], own.id_type)
    x = matrix_of(batch.column(1)).astype(float)
    if len(x) and x.shape[1] != own.width:
        raise ValueError(f"Queries have {x.shape[1]} features where the references have {own.width}")
    query = batch.column(2).to_numpy() if batch.num_columns > 2 else None
    if sorted_ids is not None:
        query = np.searchsorted(sorted_ids, np.array(batch.column(0).to_pylist()))
    d, pos = own.search(x, k, None, query, deterministic, decimals)
    return d, pos, batch.column(0)


def _ranked(pairs: DataFrame, k: int, deterministic: bool, decimals: int) -> DataFrame:
    """From (query_id, query_position, neighbor_position, neighbor_id, distance) the k rows in order."""
    asks = ("query_id", "query_position")  # ids may repeat
    first = Window.partitionBy(*asks).orderBy("distance", "neighbor_position")
    chosen = pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    if deterministic:
        scale = F.greatest(F.max("distance").over(Window.partitionBy(*asks)), F.lit(1.0))
        tie = Window.partitionBy(*asks).orderBy("_r", F.abs(F.col("query_position") - F.col("neighbor_position")), "neighbor_position")
        chosen = chosen.withColumn("_r", F.rint(F.col("distance") / scale * 10.0**decimals)).withColumn("rank", F.row_number().over(tie))
    return chosen.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("neighbor_position").cast("long").alias("neighbor_position"), "neighbor_id", "distance")


def _columns(index: NeighbourIndex, source: DataFrame, k: int, self_join: bool, id_col: str, features: str, deterministic: bool, decimals: int) -> DataFrame:
    references = index.table.select(F.col(index.id_col).alias("neighbor_id"), *[F.col(index.features)[j].cast("double").alias(f"_r{j}") for j in range(index.width)])
    bucket, edges, axis = _buckets(index, k)
    ids = [x.item() if hasattr(x, "item") else x for x in index.ids]
    numbered = source.sparkSession.createDataFrame(list(zip(range(index.n), ids, bucket)), f"neighbor_position long, neighbor_id {references.schema['neighbor_id'].dataType.simpleString()}, _bucket int")
    left = source.select(F.col(id_col).alias("query_id"), (F.col("_position") if "_position" in source.columns else F.lit(0).cast("long")).alias("query_position"), *[F.col(features)[j].cast("double").alias(f"_q{j}") for j in range(index.width)])
    if self_join:
        left = left.drop("query_position").join(F.broadcast(numbered.select(F.col("neighbor_position").alias("query_position"), F.col("neighbor_id").alias("query_id"))), "query_id")
    references = references.join(F.broadcast(numbered.where("_bucket >= 0")), "neighbor_id")
    q, r = ([F.col(f"_{s}{j}") for j in range(index.width)] for s in "qr")
    distance = distance_column(q, r, index.metric, index.p, None if index.w is None else index.w.tolist())
    other = F.col("query_position") != F.col("neighbor_position") if self_join else F.lit(True)
    if len(edges) > 1:
        cuts = F.broadcast(source.sparkSession.createDataFrame(edges, "_bucket int, _low double, _high double"))
        bad = F.lit(False)
        for c in q:
            bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        left = left.withColumn(f"_q{axis}", F.when(bad, F.raise_error(F.lit("Query features contain NaN or infinity"))).otherwise(q[axis]))
        first = left.join(cuts, (q[axis] >= F.col("_low")) & (q[axis] < F.col("_high"))).join(F.broadcast(references), "_bucket").where(other)
        found = first.groupBy("query_id", "query_position", *[f"_q{j}" for j in range(index.width)]).agg(F.get(F.sort_array(F.collect_list(distance)), k - 1).alias("_reach"))
        # slack for the rounding of distances
        reach = F.coalesce(F.col("_reach"), F.lit(float("inf"))) * (1 + 1e-9) + F.abs(q[axis]) * 1e-12
        left = found.withColumns({"_from": q[axis] - reach, "_to": q[axis] + reach})
        pairs = left.join(cuts, (F.col("_low") <= F.col("_to")) & (F.col("_high") >= F.col("_from"))).join(F.broadcast(references), "_bucket")
        pairs = pairs.where(other & r[axis].between(F.col("_from"), F.col("_to")))
    else:
        pairs = left.join(F.broadcast(references), other)
    pairs = pairs.select("query_id", "query_position", "neighbor_position", "neighbor_id", distance.alias("distance"))
    return _ranked(pairs, k, deterministic, decimals)


def _buckets(index: NeighbourIndex, k: int) -> tuple[list[int], list[tuple[int, float, float]], int]:
    """For each position its bucket along the feature of most spread, -1 where k + 1 equal rows come before; the buckets'
    (number, from, below); the feature. One bucket where no distance is known to be at least the difference in one feature."""
    order, starts = index.classes or equal_rows(index.x)
    place = np.arange(index.n) - np.repeat(starts, np.diff(starts, append=index.n))
    kept = np.sort(order[place <= k])
    bucket = np.full(index.n, -1)
    axis = int(np.argmax(index.x.std(axis=0)))
    size = max(COLUMN_ROWS, 4 * (k + 1))
    line = index.x[kept, axis]
    value, count = np.unique(line, return_counts=True)
    below, cuts = np.cumsum(count), [0]  # a bucket has at least ``size`` rows, and all of a value
    while index.w is None and _is_minkowski(index.metric, index.p):
        done = below[cuts[-1] - 1] if cuts[-1] else 0
        cut = int(np.searchsorted(below, done + size)) + 1
        if len(line) - done < 2 * size or len(line) - below[min(cut, len(below)) - 1] < size:
            break
        cuts.append(cut)
    low = value[cuts]
    bucket[kept] = np.searchsorted(low, line, "right") - 1
    bounds = [-np.inf, *low[1:].tolist(), np.inf]
    return bucket.tolist(), [(i, bounds[i], bounds[i + 1]) for i in range(len(low))], axis


def _grid(index: NeighbourIndex, source: DataFrame, k: int, self_join: bool, id_col: str, features: str, deterministic: bool, decimals: int) -> DataFrame:
    """References in blocks of positions; each block meets each slice of the queries in one task, k rows a query go on."""
    references = index.numbered if not index.local else with_position(index.table, index.id_col, "_position")
    blocks = -(-index.n // GRID_ROWS)
    if "_position" not in source.columns:
        source = with_position(source, id_col, "_position") if deterministic or self_join else source.withColumn("_position", F.lit(0).cast("long"))
    slices = max(1, -(-source.count() // GRID_ROWS))
    left = source.select(F.col(id_col).alias("query_id"), F.col("_position").alias("query_position"), F.col(features).alias("q"), F.pmod(F.xxhash64(id_col), F.lit(slices)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = references.select(F.col(index.id_col).alias("neighbor_id"), F.col("_position").alias("neighbor_position"), F.col(index.features).alias("r"), F.floor(F.col("_position") / GRID_ROWS).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))
    metric, p, w = index.metric, index.p, index.w

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks().sort_by("neighbor_position")
        names = ["query_id", "query_position", "neighbor_position", "neighbor_id", "distance"]
        if not a.num_rows or not b.num_rows:
            kinds = [a.schema.field("query_id").type, pa.int64(), pa.int64(), b.schema.field("neighbor_id").type, pa.float64()]
            return pa.schema(list(zip(names, kinds))).empty_table()
        x, y = (matrix_of(t[c].combine_chunks()).astype(float) for t, c in ((a, "q"), (b, "r")))
        if not np.isfinite(x).all():
            raise ValueError("Query features contain NaN or infinity")
        pos, query = b["neighbor_position"].to_numpy(), a["query_position"].to_numpy()
        keep = min(k + self_join, b.num_rows)
        out = []
        for i in range(0, len(x), max(1, BLOCK_CELLS // len(y))):
            s = slice(i, i + max(1, BLOCK_CELLS // len(y)))
            d, at = nearest(x[s], y, keep, metric, p, w, None)
            n = len(d)
            rows = np.repeat(np.arange(i, i + n), keep)
            cols = at.ravel()
            here = np.ones(len(rows), bool) if not self_join else pos[cols] != query[rows]
            rows, cols = rows[here], cols[here]
            out.append(pa.Table.from_arrays([a["query_id"].take(pa.array(rows)), pa.array(query[rows]), pa.array(pos[cols]), b["neighbor_id"].take(pa.array(cols)), pa.array(d.ravel()[here])], names=names))
        return pa.concat_tables(out)

    kinds = [t.schema[c].dataType.simpleString() for t, c in ((source, id_col), (index.table, index.id_col))]
    pairs = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(meet, f"query_id {kinds[0]}, query_position long, neighbor_position long, neighbor_id {kinds[1]}, distance double")
    return _ranked(pairs, k, deterministic, decimals)


def kneighbors_graph(index: NeighbourIndex, queries: DataFrame | None = None, k: int = 5, mode: str = "connectivity", **options) -> DataFrame:
    """The join as an edge table (query_id, neighbor_id, weight): 1 or the distance."""
    if mode not in ("connectivity", "distance"):
        raise ValueError(f"Unsupported mode: {mode}")
    weight = F.lit(1.0) if mode == "connectivity" else F.col("distance")
    return kneighbors(index, queries, k, **options).select("query_id", "neighbor_id", weight.alias("weight"))


Weights = str | Callable[[np.ndarray], np.ndarray] | None


def neighbour_weights(distance: np.ndarray, weights: Weights) -> np.ndarray:
    """Weights of an array of (rows, k) distances; zero distances take all the weight of their row."""
    if weights is None or weights == "uniform":
        return np.ones_like(distance)
    if weights == "distance":
        with np.errstate(divide="ignore"):
            w = 1.0 / distance
        infinite = np.isinf(w)
        rows = infinite.any(axis=1)
        w[rows] = infinite[rows]
        return w
    if callable(weights):
        return np.asarray(weights(distance), float)
    raise ValueError("weights not recognized: should be 'uniform', 'distance', or a callable function")
