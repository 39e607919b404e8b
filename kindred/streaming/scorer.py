"""Scoring of a stream against fitted references: each micro-batch meets the broadcast references, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.knn import kneighbors
from kindred.operators.predict import predict
from kindred.plans.estimators import SPACE, KNNRegressor


def score_stream(model: KNNRegressor, stream: DataFrame, id_col: str | None = None) -> DataFrame:
    """Predictions for a streaming DataFrame. Rows of a stream have no position, which only orders equal distances."""
    own = id_col or model.id_col
    return predict(model.index_, model._in_space(stream).withColumn("_zero", F.lit(0).cast("long")), model.n_neighbors, model.weights, own, SPACE, position_col="_zero")


def neighbours_stream(model: KNNRegressor, stream: DataFrame, k: int | None = None, id_col: str | None = None) -> DataFrame:
    """Neighbours for a streaming DataFrame, by (distance, position)."""
    return kneighbors(model.index_, model._in_space(stream), k or model.n_neighbors, id_col or model.id_col, SPACE, deterministic=False, strategy="block")
