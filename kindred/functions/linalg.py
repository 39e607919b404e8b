"""Distributed tall-skinny QR and the few special functions that model fitting needs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def tall_skinny_r(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """The R factor (d x d) of the rows' matrix. Each task keeps one d x d factor; these are dealt to fewer tasks, whose
    factors are joined on the driver."""
    d = len(columns)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, d))
        for batch in batches:
            held = np.linalg.qr(np.vstack([held, matrix_of(batch.column(0)).reshape(-1, d)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.list_(pa.float64()))], ["v"])

    rows = df.select(F.array(*[c.cast("double") for c in columns]).alias("v")).mapInArrow(factor, "v array<double>")
    tasks = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(max(1, tasks)).mapInArrow(factor, "v array<double>")
    parts = [r[0] for r in rows.collect()]  # d rows for each of the last tasks
    full = np.linalg.qr(np.array(parts).reshape(-1, d), mode="r")
    return np.vstack([full, np.zeros((max(0, d - len(full)), d))])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + up * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + up / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_cdf(x: float, d1: float, d2: float) -> float:
    """Distribution function of the F distribution."""
    return 0.0 if not x > 0 else incomplete_beta(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))
