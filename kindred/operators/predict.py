"""Prediction from neighbours and its score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators.knn import DECIMALS, NeighbourIndex, Weights, found_for, index_state, kneighbors, neighbour_weights, query_rows


def predict(index: NeighbourIndex, queries: DataFrame | None = None, k: int = 5, weights: Weights = "uniform", id_col: str | None = None, features: str | None = None, position_col: str | None = None) -> DataFrame:
    """(id, one column for each target): weighted means over the k neighbours. ``queries=None``: of the references without themselves.

    Where the references are broadcast, targets are gathered in the same pass; else neighbours are joined to the targets.
    """
    self_join = queries is None
    index._checked(k, self_join)
    id_col, features = id_col or index.id_col, features or index.features
    if not index.local or any(not isinstance(index.table.schema[t].dataType, T.NumericType) for t in index.targets):
        return _joined(index, kneighbors(index, queries, k, id_col, features, position_col=position_col), weights, id_col)
    # the order of neighbours can matter to a callable
    source, ids = query_rows(index, queries, id_col, features, callable(weights), position_col)
    shared, metric = source.sparkSession.sparkContext.broadcast((index_state(index), ids)), index.metric
    names = [id_col, *index.targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sorted_ids = shared.value
        own.metric = metric
        for batch in batches:
            if not batch.num_rows:
                continue
            d, pos, asked = found_for(own, batch, k, self_join, True, DECIMALS, sorted_ids)
            w = neighbour_weights(d, weights)
            y = (own.y[pos] * w[:, :, None]).sum(axis=1) / w.sum(axis=1)[:, None]
            yield pa.RecordBatch.from_arrays([asked, *[pa.array(c) for c in y.T]], names)

    kind = (index.table.schema[index.id_col] if self_join else source.schema["_id"]).dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{t}` double" for t in index.targets))


def _joined(index: NeighbourIndex, found: DataFrame, weights: Weights, id_col: str) -> DataFrame:
    """By a join on the neighbour's id. Text and boolean targets take the nearest neighbour's value."""
    targets = index.table.select(F.col(f"`{index.id_col}`").alias("neighbor_id"), *[F.col(f"`{t}`") for t in index.targets])
    if callable(weights):
        found = _weighted(found, weights)
    elif weights == "distance":
        zero = F.min("distance").over(_by_query()) == 0
        found = found.withColumn("w", F.when(zero, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance"))))
    else:
        found = found.withColumn("w", F.lit(1.0))
    both = found.join(targets, "neighbor_id")
    numeric = {t: isinstance(index.table.schema[t].dataType, T.NumericType) for t in index.targets}
    made = [(F.sum(F.col("w") * F.col(f"`{t}`").cast("double")) / F.sum("w") if numeric[t] else F.min_by(F.col(f"`{t}`"), "rank")).alias(t) for t in index.targets]
    return both.groupBy(F.col("query_id").alias(id_col)).agg(*made)


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id")


def _weighted(found: DataFrame, weights) -> DataFrame:
    rows = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_position", "neighbor_id", "distance"))).alias("n"))
    kind = found.schema["query_id"].dataType.simpleString(), found.schema["neighbor_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.asarray(weights(np.array([[x["distance"] for x in n]])), float)[0]
                made = pa.Table.from_pylist([{"query_id": q, **x, "w": float(v)} for x, v in zip(n, w)])
                yield from made.set_column(1, "rank", made["rank"].cast(pa.int32())).to_batches()

    return rows.mapInArrow(run, f"query_id {kind[0]}, rank int, neighbor_position long, neighbor_id {kind[1]}, distance double, w double")


def impute_nearest(index: NeighbourIndex, queries: DataFrame | None, columns: Sequence[str], id_col: str | None = None, features: str | None = None) -> DataFrame:
    """Columns of any type from the single nearest neighbour."""
    found = kneighbors(index, queries, 1, id_col, features)
    return found.join(index.table_with(columns), "neighbor_id").select(F.col("query_id").alias(id_col or index.id_col), "neighbor_id", *[F.col(f"`{c}`") for c in columns])


def r2_scores(truth: DataFrame, predicted: DataFrame, id_col: str, targets: Sequence[str]) -> DataFrame:
    """One row: r2 of each target and their mean ``score``. A constant target scores 1 if predicted exactly, else 0."""
    marks = {t: i for i, t in enumerate(targets)}
    left = truth.select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{t}`").cast("double").alias(f"y_{i}") for t, i in marks.items()])
    both = left.join(predicted.select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{t}`").alias(f"p_{i}") for t, i in marks.items()]), "_id")
    means = both.agg(*[F.avg(f"y_{i}").alias(f"m_{i}") for i in marks.values()])
    sums = both.crossJoin(F.broadcast(means)).agg(  # one row of means
        *[F.sum(F.pow(F.col(f"y_{i}") - F.col(f"p_{i}"), 2)).alias(f"e_{i}") for i in marks.values()],
        *[F.sum(F.pow(F.col(f"y_{i}") - F.col(f"m_{i}"), 2)).alias(f"s_{i}") for i in marks.values()],
    )
    each = {t: F.when(F.col(f"s_{i}") > 0, 1 - F.try_divide(F.col(f"e_{i}"), F.col(f"s_{i}"))).otherwise((F.col(f"e_{i}") == 0).cast("double")) for t, i in marks.items()}
    total = sum(each.values(), F.lit(0.0)) / len(targets)
    return sums.select(*[c.alias(f"r2_{t}") for t, c in each.items()], total.alias("score"))
