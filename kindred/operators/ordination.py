"""Constrained ordination: canonical correspondence and canonical correlation of distributed tables.

A pass of sums, then one pass that reduces the rows of [X' | Y'] to a small triangular factor. That factor has
all inner products of the rows, so the rest is small matrix algebra on the driver; singular values are those
of the full matrices, which a product of the matrix with itself would blur.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.linalg import f_cdf, tall_skinny_r

#: Singular values that count as zero in either method, and the level of the correlation test.
CCA_ZERO = float(np.sqrt(2.220446e-16))
CCORA_ZERO = 1e-8
P_LEVEL = 0.05


def _double(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def project(df: DataFrame, columns: Sequence[str], center: np.ndarray, matrix: np.ndarray, names: Sequence[str]) -> DataFrame:
    """``df`` with (x - center) @ matrix as unrolled column arithmetic."""
    made = {}
    for j, name in enumerate(names):
        parts = [(_double(c) - F.lit(float(m))) * F.lit(float(v)) for c, m, v in zip(columns, center, matrix[:, j])]
        made[name] = sum(parts[1:], parts[0])
    return df.withColumns(made) if made else df


@dataclass
class CCA:
    """Canonical correspondence analysis of abundances (``species``) constrained by ``environment``."""

    df: DataFrame
    environment: list[str]
    species: list[str]
    dist_based: bool = False
    center: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        # a column of its own, so that the sum isn't spelt out in every expression that divides by it
        self.df = self.df.withColumn("_cca_total", sum((_double(s) for s in self.species[1:]), _double(self.species[0])))
        total = self.site_weights
        x = [F.sum(_double(c) * total) for c in self.environment]
        row = self.df.agg(F.count("*"), F.min(total), F.sum(total), *[F.sum(_double(s)) for s in self.species], *x).first()
        if not row[0] or row[1] <= 0:
            raise ValueError("All row sums must be greater than 0")
        sums = np.array(row[3 : 3 + len(self.species)], float)
        self.excluded = [s for s, v in zip(self.species, sums) if v <= 0]
        self.species = [s for s in self.species if s not in self.excluded]
        self.n_rows, self.grand_total = row[0], float(row[2])
        self.species_weights = sums[sums > 0]
        self.colsum = self.species_weights / self.grand_total
        self.center = np.array(row[3 + len(sums) :], float) / self.grand_total
        self.df = self.df.withColumn("_cca_root", F.sqrt(F.col("_cca_total") / self.grand_total))
        self.factor = tall_skinny_r(self.df, [*self.x_scale, *self.y_bar])

    # row-wise quantities, as columns
    @property
    def site_weights(self) -> Column:
        return F.col("_cca_total")

    @property
    def rowsum(self) -> Column:
        return self.site_weights / self.grand_total

    @property
    def x_scale(self) -> list[Column]:
        return [(_double(c) - float(m)) * F.col("_cca_root") for c, m in zip(self.environment, self.center)]

    @property
    def y_bar(self) -> list[Column]:
        r = F.col("_cca_root")
        return [_double(s) / r / float(self.grand_total * np.sqrt(c)) - r * float(np.sqrt(c)) for s, c in zip(self.species, self.colsum)]

    def _scores(self, columns: list[Column], matrix: np.ndarray, prefix: str, id_col: str) -> DataFrame:
        r = F.col("_cca_root")
        made = [(sum((c * float(v) for c, v in zip(columns, matrix[:, j])), F.lit(0.0)) / r).alias(f"{prefix}{j}") for j in range(matrix.shape[1])]
        return self.df.select(id_col, *made)

    # small matrices, from the factor alone
    @cached_property
    def _solved(self) -> dict:
        p = len(self.environment)
        x, y = self.factor[:, :p], self.factor[:, p:]
        q, r = np.linalg.qr(x)
        beta, _, ls_rank, _ = np.linalg.lstsq(r, q.T @ y, rcond=None)
        fit = x @ beta
        u, s, vt = np.linalg.svd(fit, full_matrices=False)
        rank = int(min(ls_rank, (s > CCA_ZERO).sum()))
        coefficients = np.linalg.lstsq(r, q.T @ u[:, :rank], rcond=None)[0]
        return {"x": x, "y": y, "beta": beta, "u": u[:, :rank], "s": s[:rank] ** 2, "v": vt.T[:, :rank], "rank": rank, "coefficients": coefficients}

    @property
    def tot_chi(self) -> float:
        return float((self._solved["y"] ** 2).sum())

    @property
    def rank(self) -> int:
        return self._solved["rank"]

    max_components = rank

    @property
    def eigenvalues(self) -> np.ndarray:
        return self._solved["s"]

    @property
    def coefficients(self) -> np.ndarray:
        return self._solved["coefficients"]

    @property
    def axis_weights(self) -> np.ndarray:
        return np.diag(np.sqrt(self.eigenvalues / self.eigenvalues.sum()))

    def projector(self, n: int) -> np.ndarray:
        return self.coefficients[:, :n] @ self.axis_weights[:n, :n]

    @property
    def v(self) -> np.ndarray:
        return self._solved["v"] / np.sqrt(self.colsum)[:, None]

    @property
    def species_scores(self) -> np.ndarray:
        return self.v * np.sqrt(self.eigenvalues)

    @property
    def biplot_scores(self) -> np.ndarray:
        x = self._solved["x"]
        return (x.T @ self._solved["u"]) / np.sqrt((x**2).sum(0))[:, None]

    # scores of sites and species
    def site_lc_scores(self, id_col: str) -> DataFrame:
        return self._scores(self.x_scale, self.coefficients, "lc", id_col)

    def site_wa_scores(self, id_col: str) -> DataFrame:
        return self._scores(self.y_bar, self._solved["v"] / np.sqrt(self.eigenvalues), "wa", id_col)

    def fitted(self, id_col: str) -> DataFrame:
        made = [sum((x * float(b) for x, b in zip(self.x_scale, self._solved["beta"][:, j])), F.lit(0.0)).alias(s) for j, s in enumerate(self.species)]
        return self.df.select(id_col, *made)

    def residuals(self, id_col: str) -> DataFrame:
        made = [(y - sum((x * float(b) for x, b in zip(self.x_scale, self._solved["beta"][:, j])), F.lit(0.0))).alias(s) for j, (s, y) in enumerate(zip(self.species, self.y_bar))]
        return self.df.select(id_col, *made)

    def site_n2(self, id_col: str) -> DataFrame:
        w = self.site_weights
        return self.df.select(id_col, (1 / sum((F.pow(_double(s) / w, 2) for s in self.species), F.lit(0.0))).alias("n2"))

    def species_n2(self) -> np.ndarray:
        row = self.df.agg(*[F.sum(F.pow(_double(s) / float(w), 2)) for s, w in zip(self.species, self.species_weights)]).first()
        return 1 / np.array(row, float)

    def species_tolerances(self, id_col: str) -> np.ndarray:
        """Abundance-weighted deviations of the site scores from each species' score, by one aggregate."""
        r, names = F.col("_cca_root"), [f"_lc{j}" for j in range(self.rank)]
        lc = [sum((x * float(v) for x, v in zip(self.x_scale, self.coefficients[:, j])), F.lit(0.0)) / r for j in range(self.rank)]
        df = self.df.select(*[F.col(f"`{s}`") for s in self.species], *[c.alias(n) for c, n in zip(lc, names)])
        row = df.agg(*[F.sum(_double(s) * F.pow(F.col(n) - float(self.species_scores[i, j]), 2)) for i, s in enumerate(self.species) for j, n in enumerate(names)]).first()
        squares = np.array(row, float).reshape(len(self.species), self.rank)
        return np.sqrt(squares / self.species_weights[:, None])


def correlation_test(p: int, q: int, n: int, correlations: np.ndarray) -> np.ndarray:
    """P-values of Rao's F approximation for the correlations that remain from each one on; from the first
    without degrees of freedom on there are none."""
    out = []
    usable = min(p, q)
    left = n - usable - 1 - (abs(p - q) + 1) / 2
    for i in range(usable):
        a, b = p - i, q - i
        below = a * a + b * b - 5
        power = np.sqrt((a * a * b * b - 4) / below) if below > 0 else 0.0
        if not power > 0:
            continue
        wilks = float(np.prod(1 - correlations[i:usable] ** 2)) ** (1 / power)
        d1, d2 = a * b, left * power - (a * b - 2) / 2
        if d2 < 1 or d1 < 1:
            break
        ratio = np.inf if wilks == 0 else (1 - wilks) / wilks * d2 / d1
        out.append(0.0 if np.isinf(ratio) else 1 - f_cdf(ratio, d1, d2))
    return np.array(out)


class CCorA:
    """Canonical correlation of standardised columns."""

    def __init__(self, factor: np.ndarray, p: int, n: int):
        """``factor``: triangular factor of the centred rows [X | Y], p columns of X, n rows."""
        self.n = n
        self.x, self.y = factor[:, :p], factor[:, p:]
        self.k = min(self.x.shape[1], self.y.shape[1])
        ux, sx, vx = np.linalg.svd(self.x, full_matrices=False)
        uy, sy, vy = np.linalg.svd(self.y, full_matrices=False)
        self.rank_x, self.rank_y = int((sx > CCORA_ZERO).sum()), int((sy > CCORA_ZERO).sum())
        if self.rank_x < p:
            raise ValueError(f"The features are collinear: rank {self.rank_x} of {p}")
        self.vx_ds = vx.T / sx
        self._vy = vy[: self.rank_y].T / sy[: self.rank_y]
        u, s, vt = np.linalg.svd(ux.T @ uy[:, : self.rank_y], full_matrices=False)
        self.cancorr = np.clip(s, 0, 1)
        # the first canonical variate has unit length, so its deviation is that of n centred values
        self.cscal = np.sqrt(n - 1) / np.linalg.norm(self.x @ self.vx_ds @ u[:, 0])
        self.x_coef = self.vx_ds @ u[:, : self.k] * self.cscal
        self.y_coef = self._vy @ vt.T[:, : self.k] * self.cscal

    @cached_property
    def f_test(self) -> np.ndarray:
        return correlation_test(self.rank_y, self.x_coef.shape[0], self.n, self.cancorr)

    @property
    def max_components(self) -> int:
        return max(1, int((self.f_test <= P_LEVEL).sum()))

    def projector(self, n: int) -> np.ndarray:
        return self.x_coef[:, :n] @ np.diag(self.cancorr[:n])
