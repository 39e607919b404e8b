"""Feature spaces: fitted on a table, applied as a projection. All but the tree spaces are affine maps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.linalg import tall_skinny_r
from kindred.functions.schema import validate_features
from kindred.operators.ordination import CCA, CCorA, _double, project


def moments(df: DataFrame, columns: Sequence[str], ddof: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and standard deviations with ``ddof``, by one aggregate."""
    row = df.agg(F.count("*"), *[F.avg(_double(c)) for c in columns], *[F.var_pop(_double(c)) for c in columns]).first()
    n, p = row[0], len(columns)
    if n <= ddof:
        raise ValueError(f"Found {n} row(s) while a minimum of {ddof + 1} is required")
    mean, var = np.array(row[1 : 1 + p], float), np.array(row[1 + p :], float)
    return n, mean, np.sqrt(var * n / (n - ddof))


class AffineTransformer:
    """Fitted state: ``center``, ``matrix``, ``names``. Subclasses have ``fit``."""

    center: np.ndarray
    matrix: np.ndarray
    columns: list[str]
    names: list[str]

    def get_feature_names_out(self) -> list[str]:
        self._checked()
        return list(self.names)

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """``df`` with the transformed columns (names with ``prefix``)."""
        self._checked()
        return project(df, self.columns, self.center, self.matrix, [prefix + n for n in self.names])

    def fit_transform(self, df: DataFrame, *args, prefix: str = "", **kwargs) -> DataFrame:
        return self.fit(df, *args, **kwargs).transform(df, prefix)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) @ self.matrix

    def _checked(self) -> None:
        if not hasattr(self, "matrix"):
            raise RuntimeError(f"This {type(self).__name__} is not fitted yet")


class StandardScalerWithDOF(AffineTransformer):
    """(x - mean) / deviation. A constant column gives NaN (0 / 0) or infinity, as plain division does."""

    def __init__(self, ddof: int = 0):
        self.ddof = ddof

    def fit(self, df: DataFrame, columns: Sequence[str]) -> StandardScalerWithDOF:
        self.columns = self.names = list(columns)
        _, self.center, self.scale = moments(df, columns, self.ddof)
        with np.errstate(divide="ignore"):
            self.matrix = np.diag(1.0 / self.scale)
        return self

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        self._checked()
        made = {}
        for c, m, s in zip(self.columns, self.center, self.scale):
            d = _double(c) - float(m)
            made[prefix + c] = d / float(s) if s else F.when(d == 0, float("nan")).otherwise(F.signum(d) * float("inf"))
        return df.withColumns(made)


class MahalanobisTransformer(AffineTransformer):
    """Whitening: Euclidean distances of transformed rows are Mahalanobis distances."""

    def fit(self, df: DataFrame, columns: Sequence[str]) -> MahalanobisTransformer:
        if len(columns) < 2:
            raise ValueError(f"Found {len(columns)} feature(s) while a minimum of 2 is required")
        self.columns = self.names = list(columns)
        n, self.center, scale = moments(df, columns, 1)
        r = tall_skinny_r(df, [(_double(c) - float(m)) / float(s) for c, m, s in zip(columns, self.center, scale)])
        lower = np.linalg.cholesky(r.T @ r / (n - 1))
        self.matrix = np.diag(1 / scale) @ np.linalg.inv(lower.T)
        return self


class ComponentTransformer(AffineTransformer):
    """A space of ordination axes, all or the first ``n_components``."""

    def __init__(self, n_components: int | None = None):
        self.n_components = n_components

    def _reduced(self, ordination: CCA | CCorA) -> int:
        most = ordination.max_components
        n = most if self.n_components is None else self.n_components
        if not 0 <= n <= most:
            raise ValueError(f"n_components={n} must be between 0 and {most}")
        self.ordination_, self.n_components_ = ordination, n
        self.names = [f"{type(ordination).__name__.lower()}{i}" for i in range(n)]
        return n


class CCATransformer(ComponentTransformer):
    def fit(self, df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> CCATransformer:
        if len(targets) < 2:
            raise ValueError("`y` must be a 2D array")
        validate_features(df, [*columns, *targets], 1, 2)
        ordination = CCA(df, list(columns), list(targets))
        n = self._reduced(ordination)
        self.columns, self.center, self.matrix = list(columns), ordination.center, ordination.projector(n)
        return self


class CCorATransformer(ComponentTransformer):
    def fit(self, df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> CCorATransformer:
        both = [*columns, *targets]
        validate_features(df, both, 2)
        n, mean, scale = moments(df, both, 1)
        if not scale.all():
            raise ValueError(f"Column {both[int(np.flatnonzero(scale == 0)[0])]} is constant")
        factor = tall_skinny_r(df, [(_double(c) - float(m)) / float(s) for c, m, s in zip(both, mean, scale)])
        p = len(columns)
        ordination = CCorA(factor, p, n)
        k = self._reduced(ordination)
        self.columns, self.center = list(columns), mean[:p]
        self.matrix = np.diag(1 / scale[:p]) @ ordination.projector(k)
        return self
