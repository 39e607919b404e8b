"""Forests whose leaves are a feature space.

Trees are grown from exact splits on all training rows; each (target, tree) is a task of its own, boosted targets are a
task each. Rows of up to ``TRAIN_BYTES`` go along with the function, those of larger tables as a file in the shared folder;
the trees are the same. ``LargeForest`` and ``LargeBoosting``, whose splits are those of binned features (``pyspark.ml``),
hold no table in one task; they are to be named, no fit turns to them by the size of its input. Trees can't match another implementation's
node for node, as random streams differ; what is kept is what leaves mean.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.linalg import matrix_of
from kindred.functions.schema import target_kinds, validate_features, validate_targets, vector_of
from kindred.functions.storage import folder

#: Largest training table (features and targets) that the driver sorts and sends along, in bytes.
TRAIN_BYTES = 64 << 20


@dataclass
class Tree:
    """Nodes in depth-first order; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            i = np.flatnonzero(inner)
            node = at[i]
            at[i] = np.where(x[i, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.apply(x)]


def _count(value: int | float, n: int) -> int:
    """A number of rows, given as such or as a fraction."""
    return max(1, math.ceil(value * n)) if isinstance(value, float) else int(value)


def features_per_split(rule: str | int | float | None, p: int) -> int:
    if rule is None:
        return p
    if rule == "sqrt":
        return max(1, int(math.sqrt(p)))
    if rule == "log2":
        return max(1, int(math.log2(p)))
    return max(1, int(rule * p)) if isinstance(rule, float) else int(rule)


def _impurity(sums: np.ndarray, squares: np.ndarray, w: np.ndarray, criterion: str) -> np.ndarray:
    """Weighted impurity of nodes from their sums of (one-hot) targets and of the targets' second terms."""
    mean = sums / w[..., None]
    if criterion in ("gini",):
        return w * (1 - (mean**2).sum(-1))
    if criterion in ("entropy", "log_loss"):
        with np.errstate(divide="ignore", invalid="ignore"):
            return -w * np.where(mean > 0, mean * np.log2(mean), 0).sum(-1)
    if criterion == "poisson":
        with np.errstate(divide="ignore", invalid="ignore"):
            return squares - np.where(mean > 0, sums * np.log(mean), 0).sum(-1)
    return squares - (sums**2).sum(-1) / w


def _second(y: np.ndarray, criterion: str) -> np.ndarray:
    """y log y for the Poisson deviance, else the square."""
    if criterion != "poisson":
        return y**2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(y > 0, y * np.log(y), 0.0)


def _absolute(y: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(y)
    half = np.searchsorted(np.cumsum(w[order]), w.sum() / 2)
    return float((w * np.abs(y - y[order][min(half, len(y) - 1)])).sum())


class Grower:
    """Grows one tree depth-first, or best-first under ``max_leaf_nodes``."""

    def __init__(self, criterion: str = "squared_error", max_depth: int | None = None, min_samples_split: int | float = 2, min_samples_leaf: int | float = 1, min_weight_fraction_leaf: float = 0.0, max_features: str | int | float | None = None, max_leaf_nodes: int | None = None, min_impurity_decrease: float = 0.0, ccp_alpha: float = 0.0):
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, random: np.random.Generator) -> Tree:
        """y: (rows, outputs): numbers, or one-hot classes."""
        n, p = x.shape
        self._n, self._w = n, float(w.sum())
        least, split_at = _count(self.min_samples_leaf, n), _count(self.min_samples_split, n)
        tries = features_per_split(self.max_features, p)
        second = _second(y, self.criterion)
        nodes: list[list] = []

        def node(rows: np.ndarray) -> int:
            ww = w[rows]
            total = ww.sum()
            sums, squares = (ww[:, None] * y[rows]).sum(0), float((ww[:, None] * second[rows]).sum())
            impurity = _absolute(y[rows, 0], ww) if self.criterion == "absolute_error" else float(_impurity(sums[None], np.array([squares]), np.array([total]), self.criterion)[0])
            nodes.append([-1, 0.0, -1, -1, sums / total, impurity, total])
            return len(nodes) - 1

        def best_split(rows: np.ndarray, impurity: float, depth: int):
            if len(rows) < max(2, split_at, 2 * least) or impurity <= 1e-12 or self.max_depth is not None and depth >= self.max_depth:
                return None
            best, seen = None, 0
            for j in random.permutation(p):
                if seen >= tries and best is not None:
                    break
                seen += 1
                order = rows[np.argsort(x[rows, j], kind="stable")]
                xs, ws = x[order, j], w[order]
                cuts = np.flatnonzero(xs[1:] > xs[:-1] + 1e-12) + 1
                cuts = cuts[(cuts >= least) & (cuts <= len(order) - least)]
                if not len(cuts):
                    continue
                cw = np.cumsum(ws)
                cs = np.cumsum(ws[:, None] * y[order], axis=0)
                cq = np.cumsum(ws * second[order].sum(1))
                lw, rw = cw[cuts - 1], cw[-1] - cw[cuts - 1]
                fits = (lw >= self.min_weight_fraction_leaf * self._w) & (rw >= self.min_weight_fraction_leaf * self._w) & (lw > 0) & (rw > 0)
                cuts, lw, rw = cuts[fits], lw[fits], rw[fits]
                if not len(cuts):
                    continue
                ls, lq = cs[cuts - 1], cq[cuts - 1]
                if self.criterion == "absolute_error":
                    gain = np.array([impurity - _absolute(y[order[:c], 0], ws[:c]) - _absolute(y[order[c:], 0], ws[c:]) for c in cuts])
                elif self.criterion == "friedman_mse":
                    gain = ((ls / lw[:, None] - (cs[-1] - ls) / rw[:, None]) ** 2).sum(1) * lw * rw / (lw + rw)
                else:
                    gain = impurity - _impurity(ls, lq, lw, self.criterion) - _impurity(cs[-1] - ls, cq[-1] - lq, rw, self.criterion)
                at = int(gain.argmax())
                if best is None or gain[at] > best[0] + 1e-12:
                    c = cuts[at]
                    best = (float(gain[at]), int(j), float(xs[c - 1] / 2 + xs[c] / 2), order[:c], order[c:])
            if best is None or best[0] <= 1e-12 or best[0] / self._w < self.min_impurity_decrease:
                return None
            return best

        root = node(np.arange(n))
        if self.max_leaf_nodes is None:
            stack = [(root, np.arange(n), 0, None, 0)]
            nodes.clear()
            while stack:
                _, rows, depth, parent, side = stack.pop()
                me = node(rows)
                if parent is not None:
                    nodes[parent][side] = me
                got = best_split(rows, nodes[me][5], depth)
                if got:
                    nodes[me][0], nodes[me][1] = got[1], got[2]
                    stack += [(0, got[4], depth + 1, me, 3), (0, got[3], depth + 1, me, 2)]
        else:
            import heapq

            heap, leaves, order = [], 1, 0
            if got := best_split(np.arange(n), nodes[root][5], 0):
                heap.append((-got[0], order, root, 0, got))
            while heap and leaves < self.max_leaf_nodes:
                _, _, me, depth, got = heapq.heappop(heap)
                nodes[me][0], nodes[me][1] = got[1], got[2]
                for side, rows in ((2, got[3]), (3, got[4])):
                    child = node(rows)
                    nodes[me][side] = child
                    if more := best_split(rows, nodes[child][5], depth + 1):
                        order += 1
                        heapq.heappush(heap, (-more[0], order, child, depth + 1, more))
                leaves += 1
        if self.ccp_alpha > 0:
            self._prune(nodes)
        columns = list(zip(*[v[:5] for v in nodes]))
        return Tree(*(np.array(c) for c in columns))

    def _prune(self, nodes: list[list]) -> None:
        """Weakest links go while they cost less than ``ccp_alpha`` a leaf; their nodes stay unreachable."""

        def below(i: int) -> tuple[float, int]:
            if nodes[i][0] < 0:
                return nodes[i][5] / self._w, 1
            a, b = below(nodes[i][2]), below(nodes[i][3])
            return a[0] + b[0], a[1] + b[1]

        while True:
            inner = [i for i in range(len(nodes)) if nodes[i][0] >= 0 and self._reached(nodes, i)]
            cost = [((nodes[i][5] / self._w - c) / (k - 1), i) for i in inner for c, k in [below(i)]]
            if not cost or min(cost)[0] > self.ccp_alpha:
                return
            nodes[min(cost)[1]][0] = -1

    @staticmethod
    def _reached(nodes: list[list], i: int) -> bool:
        todo = [0]
        while todo:
            j = todo.pop()
            if j == i:
                return True
            if nodes[j][0] >= 0:
                todo += [nodes[j][2], nodes[j][3]]
        return False


# ---- boosting losses: (initial prediction, gradient to fit, loss, leaf update)


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Boosting:
    """Gradient boosting with an initial prediction, a learning rate on every tree and a loss for each stage."""

    def __init__(self, kind: str, loss: str, n_estimators: int, learning_rate: float, subsample: float, alpha: float, grower: dict, n_iter_no_change: int | None = None, validation_fraction: float = 0.1, tol: float = 1e-4):
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def _start(self, y: np.ndarray, classes: int, w: np.ndarray) -> np.ndarray:
        n = len(y)
        if self.kind == "regression":
            start = {"squared_error": np.average(y, weights=w), "absolute_error": np.median(y), "huber": np.median(y), "quantile": np.quantile(y, self.alpha)}[self.loss]
            return np.full((n, 1), start)
        share = np.clip(np.array([np.average(y == c, weights=w) for c in range(classes)]), 1e-9, 1 - 1e-9)
        if classes == 2:
            odds = np.log(share[1] / share[0])
            return np.full((n, 1), odds if self.loss == "log_loss" else odds / 2)
        return np.tile(np.log(share), (n, 1))

    def _loss(self, y: np.ndarray, raw: np.ndarray, w: np.ndarray) -> float:
        r = raw[:, 0]
        if self.kind == "regression":
            e = y - r
            each = {"squared_error": e**2, "absolute_error": np.abs(e), "quantile": np.where(e >= 0, self.alpha * e, (self.alpha - 1) * e)}.get(self.loss)
            if each is None:
                d = np.quantile(np.abs(e), self.alpha)
                each = np.where(np.abs(e) <= d, e**2 / 2, d * (np.abs(e) - d / 2))
        elif raw.shape[1] > 1:
            p = _softmax(raw)
            each = -np.log(np.clip(p[np.arange(len(y)), y.astype(int)], 1e-15, None))
        elif self.loss == "exponential":
            each = np.exp(-(2 * y - 1) * r)
        else:
            each = 2 * (np.logaddexp(0, r) - y * r)
        return float(np.average(each, weights=w))

    def _gradient(self, y: np.ndarray, raw: np.ndarray, k: int) -> np.ndarray:
        r = raw[:, k]
        if self.kind == "regression":
            e = y - r
            if self.loss == "squared_error":
                return e
            if self.loss == "huber":
                d = np.quantile(np.abs(e), self.alpha)
                return np.clip(e, -d, d)
            return np.sign(e) if self.loss == "absolute_error" else np.where(e >= 0, self.alpha, self.alpha - 1)
        if raw.shape[1] > 1:
            return (y == k) - _softmax(raw)[:, k]
        if self.loss == "exponential":
            s = 2 * y - 1
            return s * np.exp(-s * r)
        return y - 1 / (1 + np.exp(-r))

    def _leaf(self, y: np.ndarray, raw: np.ndarray, g: np.ndarray, k: int, classes: int, w: np.ndarray) -> float:
        if self.kind == "regression":
            e = y - raw[:, k]
            if self.loss == "absolute_error":
                return float(np.median(e))
            if self.loss == "quantile":
                return float(np.quantile(e, self.alpha))
            if self.loss == "huber":
                d, m = np.quantile(np.abs(e), self.alpha), np.median(e)
                return float(m + np.mean(np.sign(e - m) * np.minimum(d, np.abs(e - m))))
            return float(np.average(g, weights=w))
        top = float((w * g).sum())
        if raw.shape[1] > 1:
            p = (y == k) - g
            top, low = top * (classes - 1) / classes, float((w * np.abs(p) * (1 - np.abs(p))).sum())
        elif self.loss == "exponential":
            low = float((w * np.abs(g)).sum())
        else:
            p = y - g
            low = float((w * p * (1 - p)).sum())
        return 0.0 if abs(low) < 1e-150 else top / low

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int, seed: int, sample_weight: np.ndarray | None = None) -> tuple[list[list[Tree]], list[float]]:
        """Trees by stage and class, and the loss at the start and after each stage."""
        random = np.random.default_rng(seed)
        w = np.ones(len(y)) if sample_weight is None else sample_weight
        held = np.zeros(len(y), bool)
        if self.n_iter_no_change:
            held[random.permutation(len(y))[: int(self.validation_fraction * len(y))]] = True
        raw, fit_rows = self._start(y, classes, w), np.flatnonzero(~held)
        stages, losses, best, waited = [], [self._loss(y[fit_rows], raw[fit_rows], w[fit_rows])], np.inf, 0
        grower = Grower(**self.grower)
        for _ in range(self.n_estimators):
            rows = fit_rows if self.subsample >= 1 else np.sort(random.choice(fit_rows, max(1, int(self.subsample * len(fit_rows))), replace=False))
            made, before = [], raw.copy()
            for k in range(raw.shape[1]):
                g = self._gradient(y, before, k)
                tree = grower.grow(x[rows], g[rows, None], w[rows], random)
                leaves = tree.apply(x)
                value = tree.value[:, 0].astype(float).copy()
                for leaf in np.unique(leaves[rows]):
                    inside = rows[leaves[rows] == leaf]
                    value[leaf] = self._leaf(y[inside], before[inside], g[inside], k, classes, w[inside])
                tree.value = value
                raw[:, k] += self.learning_rate * value[leaves]
                made.append(tree)
            stages.append(made)
            losses.append(self._loss(y[rows], raw[rows], w[rows]))
            if self.n_iter_no_change:
                now = self._loss(y[held], raw[held], w[held])
                waited = 0 if now < best - self.tol else waited + 1
                best = min(best, now)
                if waited >= self.n_iter_no_change:
                    break
        return stages, losses


def train_improvement(losses: Sequence[float]) -> np.ndarray:
    """The part of the whole drop in loss that each stage has; equal parts if nothing drops."""
    drop = np.diff(np.asarray(losses, float))
    return np.ones_like(drop) if np.allclose(drop, 0.0) else drop / drop.sum()


class _Rows:
    """Sorted training rows: features, and a column of numbers (or numbered classes) for each target."""

    def __init__(self, x: np.ndarray, ys: list[np.ndarray]):
        self.x, self.ys = x, ys

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.x, self.ys[i]


class _StoredRows(_Rows):
    """The same from a file that all tasks can read, with a column for each feature and target; a task reads its target only."""

    def __init__(self, uri: str, width: int):
        self.uri, self.width = uri, width

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        store, path = pyarrow.fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(path) as source:
            found = pa.ipc.open_file(source).read_all()
            x = np.empty((found.num_rows, self.width))
            for j in range(self.width):
                x[:, j] = found.column(j).to_numpy()
            return x, found.column(self.width + i).to_numpy()


def _sorted_rows(x: np.ndarray, rows: pd.DataFrame, kinds: Sequence[str]) -> tuple[_Rows, list[list | None]]:
    """Training rows in an order of their own, as they come in any, and the classes of each target."""
    names = [f"_t{i}" for i in range(len(kinds))]
    order = np.lexsort([*[pd.factorize(rows[a], sort=True)[0] for a in names], *x.T])
    x, rows = x[order], rows.iloc[order]
    ys, found = [], []
    for kind, a in zip(kinds, names):
        classes = None
        if kind == "classification":
            classes, y = np.unique(rows[a].astype(str).to_numpy(), return_inverse=True)
        else:
            y = rows[a].to_numpy(float)
        found.append(classes if classes is None else list(classes))
        ys.append(np.asarray(y, float))
    return _Rows(x, ys), found


def _stored(rows: DataFrame, kinds: Sequence[str]) -> tuple[_StoredRows, list[list | None]]:
    """Sorts the rows in one task, which writes them for those of the trees; the driver gets the classes only."""
    uri, names = f"{folder(rows.sparkSession)}/rows.arrow", rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        x = np.concatenate([matrix_of(c) for c in held.column(0).chunks if len(c)]).astype(float)
        made, classes = _sorted_rows(x, held.drop_columns(names[:1]).to_pandas(), kinds)
        columns = [*made.x.T, *made.ys]
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        store.create_dir(path.rsplit("/", 1)[0])
        packed = pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], [str(i) for i in range(len(columns))])
        with store.open_output_stream(path) as out, pa.ipc.new_file(out, packed.schema) as file:
            file.write_table(packed)
        yield pa.RecordBatch.from_arrays([pa.array([made.x.shape[1]], pa.int32()), pa.array([pickle.dumps(classes)], pa.binary())], ["width", "classes"])

    width, classes = rows.repartition(1).mapInArrow(write, "width int, classes binary").first()
    return _StoredRows(uri, width), pickle.loads(bytes(classes))


class TreeNodeTransformer:
    """Base: one forest for each target; a row becomes the leaf it reaches in each tree.

    State after ``fit``: ``forests_`` (lists of trees, class-major), ``n_trees_per_iteration_``,
    ``tree_weights_``, ``target_kinds_``, ``classes_``.
    """

    random_state: int | None = None
    n_estimators: int = 1

    def fit(self, df: DataFrame, columns: Sequence[str], targets: Sequence[str], categorical: Sequence[str] = ()) -> TreeNodeTransformer:
        self.columns, self.targets = list(columns), list(targets)
        self.target_kinds_ = target_kinds(df, targets, categorical)
        validate_targets(df, targets)
        n = validate_features(df, columns)
        names = [f"_t{i}" for i in range(len(targets))]
        kinds = [self.target_kinds_[t] for t in targets]
        rows = df.select(vector_of(columns).alias("x"), *[F.col(f"`{t}`").alias(a) for t, a in zip(targets, names)])
        if n * (len(columns) + len(targets)) * 8 > TRAIN_BYTES:
            _check_options(self)
            held, self.classes_ = _stored(rows, kinds)
        else:
            frame = rows.toPandas()
            held, self.classes_ = _sorted_rows(np.vstack(frame["x"]).astype(float), frame, kinds)
        self._train(df, held)
        return self

    @property
    def n_forests_(self) -> int:
        return len(self.forests_)

    def _run(self, df: DataFrame, tasks: list[tuple[int, int]], work) -> dict[tuple[int, int], object]:
        """``work`` on each task in a Spark task of its own; training data goes along (Spark broadcasts large functions)."""
        spark = df.sparkSession

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([(i, j, pickle.dumps(work(int(i), int(j)))) for i, j in zip(batch["i"], batch["j"])], columns=["i", "j", "tree"])

        parts = min(len(tasks), max(1, spark.sparkContext.defaultParallelism))
        table = spark.createDataFrame(tasks, "i int, j int").repartition(parts, "i", "j")
        return {(r[0], r[1]): pickle.loads(r[2]) for r in table.mapInPandas(run, "i int, j int, tree binary").collect()}

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Leaf ids of a feature matrix, one column for each tree."""
        return np.column_stack([t.apply(x) for forest in self.forests_ for t in forest]).astype(np.int64)

    def transform(self, df: DataFrame, name: str = "leaves") -> DataFrame:
        """``df`` with the leaf ids as an array column."""
        if not hasattr(self, "forests_"):
            raise RuntimeError(f"This {type(self).__name__} is not fitted yet")
        shared = df.sparkSession.sparkContext.broadcast(self.forests_)
        own = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix_of(batch.column(len(own))).astype(float)
                leaves = np.column_stack([t.apply(x) for forest in shared.value for t in forest]).astype(np.int64) if len(x) else np.zeros((0, 1), np.int64)
                offsets = np.arange(0, leaves.size + 1, max(1, leaves.shape[1]), dtype=np.int32)[: len(x) + 1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaves.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*own, name])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], vector_of(self.columns).alias("_x")).mapInArrow(run, f"{schema}, `{name}` array<bigint>")

    def fit_transform(self, df: DataFrame, *args, **kwargs) -> DataFrame:
        return self.fit(df, *args, **kwargs).transform(df)


def _class_weights(y: np.ndarray, rule: str | dict | None, classes: list | None) -> np.ndarray:
    if rule is None or classes is None:
        return np.ones(len(y))
    if rule in ("balanced", "balanced_subsample"):
        counts = np.bincount(y.astype(int), minlength=len(classes))
        return (len(y) / (len(classes) * np.maximum(counts, 1)))[y.astype(int)]
    return np.array([rule.get(c, 1.0) for c in classes])[y.astype(int)]


class RFNodeTransformer(TreeNodeTransformer):
    def __init__(self, *, n_estimators: int = 50, criterion_reg: str = "squared_error", criterion_clf: str = "gini", max_depth: int | None = None, min_samples_split: int | float = 2, min_samples_leaf: int | float = 5, min_weight_fraction_leaf: float = 0.0, max_features_reg: str | int | float | None = 1.0, max_features_clf: str | int | float | None = "sqrt", max_leaf_nodes: int | None = None, min_impurity_decrease: float = 0.0, bootstrap: bool = True, max_samples: int | float | None = None, class_weight_clf: str | dict | None = None, ccp_alpha: float = 0.0, random_state: int | None = None):
        self.__dict__.update({k: v for k, v in locals().items() if k not in ("self", "__class__")})

    def _train(self, df: DataFrame, held: _Rows) -> None:
        seed = 0 if self.random_state is None else self.random_state
        common = {k: getattr(self, k) for k in ("max_depth", "min_samples_split", "min_samples_leaf", "min_weight_fraction_leaf", "max_leaf_nodes", "min_impurity_decrease", "ccp_alpha")}
        classes, bootstrap, most, rule = self.classes_, self.bootstrap, self.max_samples, self.class_weight_clf
        reg = Grower(criterion=self.criterion_reg, max_features=self.max_features_reg, **common)
        clf = Grower(criterion=self.criterion_clf, max_features=self.max_features_clf, **common)

        def work(i: int, j: int) -> Tree:
            random = np.random.default_rng([seed, i, j])
            x, y = held.of(i)
            n = len(x)
            w = _class_weights(y, rule, classes[i])
            if bootstrap:
                size = n if most is None else (max(1, round(most * n)) if isinstance(most, float) else most)
                w = w * np.bincount(random.integers(0, n, size), minlength=n)
            rows = np.flatnonzero(w > 0)
            target = y[:, None] if classes[i] is None else np.eye(len(classes[i]))[y.astype(int)]
            return (reg if classes[i] is None else clf).grow(x[rows], target[rows], w[rows].astype(float), random)

        made = self._run(df, [(i, j) for i in range(len(classes)) for j in range(self.n_estimators)], work)
        self.forests_ = [[made[i, j] for j in range(self.n_estimators)] for i in range(len(classes))]
        self.n_trees_per_iteration_ = [1] * len(classes)
        self.tree_weights_ = [np.full(self.n_estimators, 1.0 / self.n_estimators) for _ in classes]

    def get_feature_names_out(self) -> list[str]:
        return [f"rf{i}_tree{k}" for i, f in enumerate(self.forests_) for k in range(len(f))]


class GBNodeTransformer(TreeNodeTransformer):
    def __init__(self, *, loss_reg: str = "squared_error", loss_clf: str = "log_loss", learning_rate: float = 0.1, n_estimators: int = 100, subsample: float = 1.0, criterion: str = "friedman_mse", min_samples_split: int | float = 2, min_samples_leaf: int | float = 1, min_weight_fraction_leaf: float = 0.0, max_depth: int | None = 3, min_impurity_decrease: float = 0.0, max_features: str | int | float | None = None, alpha_reg: float = 0.9, max_leaf_nodes: int | None = None, validation_fraction: float = 0.1, n_iter_no_change: int | None = None, tol: float = 1e-4, ccp_alpha: float = 0.0, random_state: int | None = None, tree_weighting_method: str = "train_improvement"):
        self.__dict__.update({k: v for k, v in locals().items() if k not in ("self", "__class__")})

    def _train(self, df: DataFrame, held: _Rows) -> None:
        if self.tree_weighting_method not in ("train_improvement", "uniform"):
            raise ValueError(f"Invalid tree_weighting_method: {self.tree_weighting_method}. Must be 'train_improvement' or 'uniform'.")
        seed = 0 if self.random_state is None else self.random_state
        grower = {k: getattr(self, k) for k in ("criterion", "max_depth", "min_samples_split", "min_samples_leaf", "min_weight_fraction_leaf", "max_features", "max_leaf_nodes", "min_impurity_decrease", "ccp_alpha")}
        classes = self.classes_
        if self.loss_clf == "exponential" and any(c and len(c) > 2 for c in classes):
            raise ValueError("The exponential loss is for two classes")
        rest = (self.n_estimators, self.learning_rate, self.subsample, self.alpha_reg, grower, self.n_iter_no_change, self.validation_fraction, self.tol)
        models = [Boosting("regression" if c is None else "classification", self.loss_reg if c is None else self.loss_clf, *rest) for c in classes]

        def work(i: int, j: int):
            return models[i].fit(*held.of(i), len(classes[i] or ()), seed + i)

        made = self._run(df, [(i, 0) for i in range(len(classes))], work)
        self.forests_, self.n_trees_per_iteration_, self.tree_weights_, self.losses_ = [], [], [], []
        for i in range(len(classes)):
            stages, losses = made[i, 0]
            per = len(stages[0])
            self.forests_.append([s[c] for c in range(per) for s in stages])  # class-major
            self.n_trees_per_iteration_.append(per)
            self.losses_.append(losses)
            if self.tree_weighting_method == "uniform":
                self.tree_weights_.append(np.full(len(stages) * per, 1.0 / (len(stages) * per)))
            else:
                w = train_improvement(losses)
                self.tree_weights_.append(np.tile(w / w.sum(), per))

    def get_feature_names_out(self) -> list[str]:
        out = []
        for i, (forest, per) in enumerate(zip(self.forests_, self.n_trees_per_iteration_)):
            n = len(forest) // per
            out += [f"gb{i}_tree{k}" for k in range(n)] if per == 1 else [f"gb{i}_cls{j}_tree{k}" for j in range(per) for k in range(n)]
        return out


def hamming_weights(transformer: TreeNodeTransformer, forest_weights: str | Sequence[float] = "uniform") -> np.ndarray:
    """Weights of all trees: forest weight times tree weight, shared between the trees of an iteration."""
    n = transformer.n_forests_
    if isinstance(forest_weights, str) and forest_weights == "uniform":
        forests = np.full(n, 1.0 / n)
    else:
        forests = validated_forest_weights(forest_weights, n)
        forests = forests / forests.sum()
    return np.hstack([t * f / k for t, f, k in zip(transformer.tree_weights_, forests, transformer.n_trees_per_iteration_)])


def validated_forest_weights(weights: Sequence[float], n: int) -> np.ndarray:
    try:
        out = np.array(weights, dtype=np.float64)
    except (TypeError, ValueError) as e:
        raise ValueError(f"`forest_weights` must be a sequence of numeric values, but got {weights} instead.") from e
    if out.shape != (n,):
        raise ValueError(f"Expected `forest_weights` to have length {n}, but got {out.size}.")
    for good, what in ((np.isfinite(out), "finite"), (out >= 0, "non-negative")):
        if not good.all():
            raise ValueError(f"Expected elements in `forest_weights` to be {what}, but got {out}.")
    if out.sum() <= 0:
        raise ValueError(f"At least one element in `forest_weights` must be positive, but got {out}.")
    return out


class _Large(TreeNodeTransformer):
    """Leaves of ``pyspark.ml`` models, for training tables that are too large to broadcast: splits of binned features, a
    model for each target (and class), all rows stay in the executors."""

    def fit(self, df: DataFrame, columns: Sequence[str], targets: Sequence[str], categorical: Sequence[str] = ()) -> _Large:
        from pyspark.ml.feature import VectorAssembler

        self.columns, self.targets = list(columns), list(targets)
        self.target_kinds_ = target_kinds(df, targets, categorical)
        validate_targets(df, targets)
        rows = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(columns))], outputCol="_v").transform(
            df.select(*[F.col(f"`{c}`").cast("double").alias(f"_f{i}") for i, c in enumerate(columns)], *[F.col(f"`{t}`").alias(f"_t{i}") for i, t in enumerate(targets)])
        )
        self.models_, self.classes_, self.n_trees_per_iteration_, self.tree_weights_, self.forests_ = [], [], [], [], []
        for i, t in enumerate(targets):
            own = rows.select("_v", F.col(f"_t{i}").alias("_y"))
            classes = None
            if self.target_kinds_[t] == "classification":
                own = own.withColumn("_y", F.col("_y").cast("string"))
                classes = sorted(r[0] for r in own.select("_y").distinct().collect())
            self.classes_.append(classes)
            self._one(own, classes)
        return self

    def _least(self, rows: DataFrame) -> int:
        return _count(self.min_samples_leaf, rows.count()) if isinstance(self.min_samples_leaf, float) else self.min_samples_leaf

    def _keep(self, models: list, weights: np.ndarray, per: int) -> None:
        self.models_ += models
        self.n_trees_per_iteration_.append(per)
        self.tree_weights_.append(weights)
        self.forests_.append([None] * len(weights))

    def transform(self, df: DataFrame, name: str = "leaves") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        own = [F.col(f"`{c}`") for c in df.columns]
        made = df.select(F.struct(*own).alias("_row"), *[F.col(f"`{c}`").cast("double").alias(f"_f{i}") for i, c in enumerate(self.columns)])
        out = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(self.columns))], outputCol="_v").transform(made).select("_row", "_v")
        for i, m in enumerate(self.models_):
            changed = {m.leafCol: f"_leaf{i}", m.predictionCol: f"_p{i}"}
            for extra in ("rawPredictionCol", "probabilityCol"):
                if m.hasParam(extra):
                    changed[m.getParam(extra)] = ""
            out = m.copy(changed).transform(out)
        leaves = F.concat(*[vector_to_array(f"_leaf{i}").cast("array<bigint>") for i in range(len(self.models_))])
        return out.select("_row.*", leaves.alias(name))


def _indexed(rows: DataFrame, classes: list[str]) -> DataFrame:
    numbers = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    return rows.withColumn("_y", numbers[F.col("_y")])


class LargeForest(_Large):
    def __init__(self, *, n_estimators: int = 50, max_depth: int | None = 12, min_samples_leaf: int = 5, criterion_clf: str = "gini", max_features_reg: str | int | float | None = 1.0, max_features_clf: str | int | float | None = "sqrt", bootstrap: bool = True, random_state: int | None = 0, max_bins: int = 256):
        self.__dict__.update({k: v for k, v in locals().items() if k not in ("self", "__class__")})

    def _one(self, rows: DataFrame, classes: list[str] | None) -> None:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.regression import RandomForestRegressor

        def subset(rule) -> str:
            return f"{features_per_split(rule, len(self.columns))}"

        common = {"featuresCol": "_v", "labelCol": "_y", "leafCol": "_leaf", "numTrees": self.n_estimators, "maxDepth": 30 if self.max_depth is None else self.max_depth, "minInstancesPerNode": self._least(rows), "bootstrap": self.bootstrap, "seed": self.random_state or 0, "maxBins": self.max_bins}
        if classes is None:
            model = RandomForestRegressor(featureSubsetStrategy=subset(self.max_features_reg), **common).fit(rows.withColumn("_y", F.col("_y").cast("double")))
        else:
            model = RandomForestClassifier(featureSubsetStrategy=subset(self.max_features_clf), impurity="gini" if self.criterion_clf == "gini" else "entropy", **common).fit(_indexed(rows, classes))
        self._keep([model], np.full(self.n_estimators, 1.0 / self.n_estimators), 1)

    def get_feature_names_out(self) -> list[str]:
        return RFNodeTransformer.get_feature_names_out(self)


class LargeBoosting(_Large):
    """A model for each numeric target or pair of classes, and one for each of more classes, against the others."""

    def __init__(self, *, n_estimators: int = 100, learning_rate: float = 0.1, subsample: float = 1.0, max_depth: int | None = 3, min_samples_leaf: int = 1, random_state: int | None = 0, tree_weighting_method: str = "train_improvement", max_bins: int = 256):
        self.__dict__.update({k: v for k, v in locals().items() if k not in ("self", "__class__")})

    def _one(self, rows: DataFrame, classes: list[str] | None) -> None:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.regression import GBTRegressor

        common = {"featuresCol": "_v", "labelCol": "_y", "leafCol": "_leaf", "maxIter": self.n_estimators, "stepSize": self.learning_rate, "subsamplingRate": self.subsample, "maxDepth": 30 if self.max_depth is None else self.max_depth, "minInstancesPerNode": self._least(rows), "seed": self.random_state or 0, "maxBins": self.max_bins}
        if classes is None:
            rows = rows.withColumn("_y", F.col("_y").cast("double"))
            start = rows.agg(F.var_pop("_y")).first()[0]
            models, losses = [GBTRegressor(**common).fit(rows)], []
            losses.append([start, *models[0].evaluateEachIteration(rows, "squared")])
        else:
            models, losses = [], []
            for c in classes[1:] if len(classes) == 2 else classes:
                one = rows.withColumn("_y", (F.col("_y") == c).cast("double"))
                share = one.agg(F.avg("_y")).first()[0]
                models.append(GBTClassifier(**common).fit(one))
                start = -2 * (share * np.log(share) + (1 - share) * np.log(1 - share)) if 0 < share < 1 else 0.0
                losses.append([start, *models[-1].evaluateEachIteration(one)])
        per = len(models)
        if self.tree_weighting_method == "uniform":
            weights = np.full(self.n_estimators * per, 1.0 / (self.n_estimators * per))
        else:
            w = np.maximum(train_improvement(np.mean(losses, axis=0)), 0.0)  # a stage can lose what the first tree won
            weights = np.tile(w / w.sum(), per)
        self._keep(models, weights, per)

    def get_feature_names_out(self) -> list[str]:
        return GBNodeTransformer.get_feature_names_out(self)


def _check_options(small: TreeNodeTransformer) -> None:
    """Options that a table beyond ``TRAIN_BYTES`` may not have: others than those of the transformers for large tables."""
    import inspect

    kind = LargeForest if isinstance(small, RFNodeTransformer) else LargeBoosting
    known, defaults = inspect.signature(kind.__init__).parameters, inspect.signature(type(small).__init__).parameters
    lost = [n for n, p in defaults.items() if n != "self" and n not in known and getattr(small, n) != p.default]
    if lost:
        raise ValueError(f"A training table of this size is fitted without {', '.join(lost)}")
