"""Estimators: a feature space and a nearest-neighbour join in it.

``fit`` takes a DataFrame with an id column, feature columns and target columns. Transforms are projections of
the references; independent predictions (each row without itself) are computed when asked for.
"""

from __future__ import annotations

import copy
import inspect
import pickle
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.distance import Metric
from kindred.functions.schema import validate_features, validate_targets, vector_of
from kindred.operators import knn
from kindred.operators.knn import NeighbourIndex, Weights
from kindred.operators.predict import impute_nearest, predict, r2_scores
from kindred.operators.transforms import CCATransformer, CCorATransformer, MahalanobisTransformer, StandardScalerWithDOF
from kindred.operators.trees import GBNodeTransformer, RFNodeTransformer, TreeNodeTransformer, hamming_weights

SPACE = "_space"


class KNNRegressor:
    """Base of all estimators. Subclasses choose the space by ``_get_transformer``."""

    uses_y_fit = False

    def __init__(self, n_neighbors: int = 5, *, weights: Weights = "uniform", algorithm: str = "auto", leaf_size: int = 30, p: float = 2, metric: Metric = "minkowski", metric_params: dict | None = None, n_jobs: int | None = None):
        """``algorithm``, ``leaf_size`` and ``n_jobs`` are accepted for their callers; plans do not depend on them."""
        self.n_neighbors, self.weights, self.algorithm, self.leaf_size = n_neighbors, weights, algorithm, leaf_size
        self.p, self.metric, self.metric_params, self.n_jobs = p, metric, metric_params, n_jobs

    # ---- parameters
    @classmethod
    def _names(cls) -> list[str]:
        return [n for n in inspect.signature(cls.__init__).parameters if n not in ("self", "params")]

    def get_params(self) -> dict:
        return {n: getattr(self, n) for n in self._names()}

    def set_params(self, **params) -> KNNRegressor:
        for name, value in params.items():
            if name not in self._names():
                raise ValueError(f"Invalid parameter {name!r} for {type(self).__name__}")
            setattr(self, name, value)
        return self

    def clone(self) -> KNNRegressor:
        return type(self)(**copy.deepcopy(self.get_params()))

    # ---- hooks
    def _get_transformer(self):
        return None

    def _fit_transformer(self, df: DataFrame, fit_targets: list[str]):
        transformer = self._get_transformer()
        return transformer.fit(df, self.features) if transformer is not None else None

    def _in_space(self, df: DataFrame) -> DataFrame:
        """``df`` with the space's coordinates as an array column."""
        if self.transformer_ is None:
            return df.withColumn(SPACE, vector_of(self.features))
        if isinstance(self.transformer_, TreeNodeTransformer):
            return self.transformer_.transform(df, SPACE)
        made = self.transformer_.transform(df, "_s_")
        return made.withColumn(SPACE, vector_of(["_s_" + n for n in self.transformer_.names]))

    def _metric(self) -> dict:
        w = (self.metric_params or {}).get("w")
        return {"metric": self.metric, "p": (self.metric_params or {}).get("p", self.p), "w": w}

    # ---- fitting
    def fit(self, df: DataFrame, features: Sequence[str], targets: Sequence[str], id_col: str, y_fit: Sequence[str] | None = None) -> KNNRegressor:
        """``y_fit``: other columns of ``df`` to fit the space on, for the spaces that use targets."""
        if y_fit is not None and not self.uses_y_fit:
            raise TypeError(f"{type(self).__name__} does not use y_fit")
        self.features, self.targets, self.id_col = list(features), list(targets), id_col
        self.n_rows_ = validate_features(df, self.features)
        validate_targets(df, self.targets)
        self.y_fit_ = list(y_fit) if y_fit is not None else None
        self.transformer_ = self._fit_transformer(df, self.y_fit_ or self.targets)
        self.references_ = df
        self.index_ = NeighbourIndex(self._in_space(df), id_col, SPACE, self.targets, **self._metric())
        if self.index_.repeated:  # scores join predictions by id
            raise ValueError(f"Values of {id_col} repeat; each reference needs an id of its own")
        self.n_features_in_ = self.index_.width
        self.__dict__.pop("_independent", None)
        return self

    def save(self, path: str) -> None:
        """The references as a table and the fitted state beside it, in any store that Spark writes to."""
        self._checked()
        state = {k: v for k, v in self.__dict__.items() if k not in ("references_", "index_", "_independent")}
        state["transformer_"] = copy.copy(self.transformer_)
        if hasattr(self.transformer_, "ordination_"):
            state["transformer_"].ordination_ = None  # it holds the table; its projection is in the transformer
        self.references_.write.parquet(f"{path}/references")
        spark = self.references_.sparkSession
        spark.createDataFrame([(bytearray(pickle.dumps((type(self), state))),)], "state binary").coalesce(1).write.parquet(f"{path}/state")

    def _checked(self) -> None:
        if not hasattr(self, "index_"):
            raise RuntimeError(f"This {type(self).__name__} instance is not fitted yet. Call 'fit' with appropriate arguments before using this estimator.")

    def _queries(self, df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"Features seen at fit time, yet now missing: {missing}")
        return self._in_space(df)

    # ---- use
    def kneighbors(self, df: DataFrame | None = None, n_neighbors: int | None = None, return_distance: bool = True, return_dataframe_index: bool = False, use_deterministic_ordering: bool = True, id_col: str | None = None, **options) -> DataFrame:
        """Long form: query_id, rank, neighbor (position, or the reference's id), distance."""
        self._checked()
        found = knn.kneighbors(self.index_, self._queries(df), n_neighbors or self.n_neighbors, id_col or self.id_col, SPACE, use_deterministic_ordering, **options)
        neighbor = F.col("neighbor_id" if return_dataframe_index else "neighbor_position").alias("neighbor")
        return found.select("query_id", "rank", neighbor, *(["distance"] if return_distance else []))

    def kneighbors_graph(self, df: DataFrame | None = None, n_neighbors: int | None = None, mode: str = "connectivity") -> DataFrame:
        self._checked()
        return knn.kneighbors_graph(self.index_, self._queries(df), n_neighbors or self.n_neighbors, mode)

    def predict(self, df: DataFrame, id_col: str | None = None) -> DataFrame:
        self._checked()
        return predict(self.index_, self._queries(df), self.n_neighbors, self.weights, id_col or self.id_col, SPACE)

    def impute(self, df: DataFrame, columns: Sequence[str], id_col: str | None = None) -> DataFrame:
        """Columns of any type from the nearest reference."""
        self._checked()
        return impute_nearest(self.index_, self._queries(df), columns, id_col or self.id_col, SPACE)

    def score(self, df: DataFrame, id_col: str | None = None) -> float:
        """Mean R² over the targets, which ``df`` has too."""
        own = id_col or self.id_col
        return r2_scores(df, self.predict(df, own), own, self.targets).first()["score"]

    @property
    def independent_prediction_(self) -> DataFrame:
        """Predictions of the references, each without itself."""
        self._checked()
        return predict(self.index_, None, self.n_neighbors, self.weights)

    @property
    def independent_score_(self) -> float:
        if "_independent" not in self.__dict__:
            self._independent = r2_scores(self.references_, self.independent_prediction_, self.id_col, self.targets).first()["score"]
        return self._independent

    @property
    def dataframe_index_in_(self) -> DataFrame:
        """Reference ids by position."""
        self._checked()
        return self.references_.select(self.id_col).orderBy(self.id_col)


class RawKNNRegressor(KNNRegressor):
    """Distances in the features as they are."""


class EuclideanKNNRegressor(KNNRegressor):
    """Distances of standardised features."""

    def _get_transformer(self):
        return StandardScalerWithDOF(ddof=1)

    def _fit_transformer(self, df: DataFrame, fit_targets: list[str]):
        scaler = super()._fit_transformer(df, fit_targets)
        if not scaler.scale.all():
            raise ValueError(f"Feature {self.features[int((scaler.scale == 0).argmax())]} is constant")
        return scaler


class MahalanobisKNNRegressor(KNNRegressor):
    """Distances of whitened features."""

    def _get_transformer(self):
        return MahalanobisTransformer()


class OrdinationKNNRegressor(KNNRegressor):
    """Distances along ordination axes of features and targets (or ``y_fit``)."""

    uses_y_fit = True

    def __init__(self, n_neighbors: int = 5, *, n_components: int | None = None, weights: Weights = "uniform", algorithm: str = "auto", leaf_size: int = 30, p: float = 2, metric: Metric = "minkowski", metric_params: dict | None = None, n_jobs: int | None = None):
        super().__init__(n_neighbors, weights=weights, algorithm=algorithm, leaf_size=leaf_size, p=p, metric=metric, metric_params=metric_params, n_jobs=n_jobs)
        self.n_components = n_components

    def _fit_transformer(self, df: DataFrame, fit_targets: list[str]):
        if self.n_components == 0:
            raise ValueError("n_components has to be 1 at least for neighbours")
        return self._get_transformer().fit(df, self.features, fit_targets)


class GNNRegressor(OrdinationKNNRegressor):
    def _get_transformer(self):
        return CCATransformer(self.n_components)


class MSNRegressor(OrdinationKNNRegressor):
    def _get_transformer(self):
        return CCorATransformer(self.n_components)


class WeightedTreesNNRegressor(KNNRegressor):
    """Weighted Hamming distances of forest leaves."""

    uses_y_fit = True
    transformer_class: type[TreeNodeTransformer]

    def __init__(self, *, forest_weights: str | Sequence[float] = "uniform", n_neighbors: int = 5, weights: Weights = "uniform", n_jobs: int | None = None, categorical: Sequence[str] = (), **params):
        super().__init__(n_neighbors, weights=weights, algorithm="brute", metric="hamming", n_jobs=n_jobs)
        self.forest_weights, self.categorical = forest_weights, categorical
        known = inspect.signature(self.transformer_class.__init__).parameters
        #: Parameters that change nothing here; other values than these are refused.
        idle = {"oob_score": False, "warm_start": False, "verbose": 0, "monotonic_cst": None, "init": None}
        for name, value in params.items():
            if name in idle and value == idle[name]:
                continue
            if name not in known:
                raise ValueError(f"Parameter {name!r} is not supported by {type(self).__name__}")
        self.tree_params = {k: v for k, v in params.items() if k in known}

    def get_params(self) -> dict:
        return {"forest_weights": self.forest_weights, "n_neighbors": self.n_neighbors, "weights": self.weights, "n_jobs": self.n_jobs, "categorical": self.categorical, **self._get_transformer_params()}

    def set_params(self, **params) -> WeightedTreesNNRegressor:
        known = self.get_params()
        for name, value in params.items():
            if name not in known:
                raise ValueError(f"Invalid parameter {name!r} for {type(self).__name__}")
            if name in ("forest_weights", "n_neighbors", "weights", "n_jobs", "categorical"):
                setattr(self, name, value)
            else:
                self.tree_params[name] = value
        return self

    def _get_transformer_params(self) -> dict:
        defaults = {n: p.default for n, p in inspect.signature(self.transformer_class.__init__).parameters.items() if n != "self"}
        return defaults | self.tree_params

    def _get_transformer(self):
        return self.transformer_class(**self._get_transformer_params())

    def _fit_transformer(self, df: DataFrame, fit_targets: list[str]):
        out = self._get_transformer().fit(df, self.features, fit_targets, self.categorical)
        self.hamming_weights_ = hamming_weights(out, self.forest_weights)
        return out

    def _metric(self) -> dict:
        return {"metric": "hamming", "w": self.hamming_weights_}


class RFNNRegressor(WeightedTreesNNRegressor):
    transformer_class = RFNodeTransformer


class GBNNRegressor(WeightedTreesNNRegressor):
    transformer_class = GBNodeTransformer


ESTIMATORS = [RawKNNRegressor, EuclideanKNNRegressor, MahalanobisKNNRegressor, MSNRegressor, GNNRegressor, RFNNRegressor, GBNNRegressor]


def grid_search(estimator: KNNRegressor, grid: dict[str, Sequence], df: DataFrame, features: Sequence[str], targets: Sequence[str], id_col: str, folds: int = 5) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Best parameters by mean held-out score over folds, which are cut by a hash of the id."""
    from itertools import product

    fold = F.pmod(F.xxhash64(id_col), F.lit(folds))
    results = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        scores = []
        for i in range(folds):
            model = estimator.clone().set_params(**params).fit(df.where(fold != i), features, targets, id_col)
            scores.append(model.score(df.where(fold == i)))
        results.append((params, sum(scores) / folds))
    best = max(results, key=lambda r: r[1])
    return best[0], best[1], results


def load_model(spark: SparkSession, path: str) -> KNNRegressor:
    """A saved model. Its state is a pickle: load only what you trust."""
    kind, state = pickle.loads(bytes(spark.read.parquet(f"{path}/state").first()[0]))
    model = kind.__new__(kind)
    model.__dict__.update(state)
    model.references_ = spark.read.parquet(f"{path}/references")
    model.index_ = NeighbourIndex(model._in_space(model.references_), model.id_col, SPACE, model.targets, **model._metric())
    return model


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
