"""Column names, types and validation of feature and target columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANK = [T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def is_dataframe_like(obj: object) -> bool:
    """A table with named, typed columns: Spark, pandas or polars."""
    return hasattr(obj, "columns") and hasattr(obj, "dtypes")


def is_series_like(obj: object) -> bool:
    """One named, typed column. A Spark DataFrame is a table, not a column."""
    return hasattr(obj, "name") and hasattr(obj, "dtype") and not isinstance(obj, DataFrame)


def is_number_like_type(kind: T.DataType) -> bool:
    if not isinstance(kind, T.DataType):
        raise TypeError(f"{kind!r} is not a data type")
    return isinstance(kind, T.NumericType)


def is_categorical_type(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BooleanType))


def is_nan_like(column: Column | str, kind: T.DataType) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def get_feature_names(df: DataFrame | Sequence | None) -> list[str]:
    """Column names; positions as text where there are none."""
    if df is None:
        return []
    if hasattr(df, "columns"):
        return [str(c) for c in df.columns]
    if is_series_like(df):
        return [str(df.name) if df.name is not None else "0"]
    first = next(iter(df), None)
    return [] if first is None else [str(i) for i in range(len(first) if isinstance(first, Sequence) and not isinstance(first, str) else 1)]


def get_feature_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def get_feature_names_and_types(df: DataFrame) -> dict[str, T.DataType]:
    """Names with types; a repeated name is an error."""
    names = df.columns
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"Duplicate column names: {repeated}")
    return get_feature_types(df)


def minimum_type(kinds: Sequence[T.DataType]) -> T.DataType:
    """The smallest type that holds values of all given types."""
    if any(isinstance(k, T.StringType) for k in kinds):
        if not all(isinstance(k, T.StringType) for k in kinds):
            raise ValueError("The target has both string and non-string types")
        return T.StringType()
    ranks = [_RANK.index(type(k)) if type(k) in _RANK else _RANK.index(T.DoubleType) for k in kinds]
    top = max(ranks)
    if _RANK[top] is T.FloatType and any(_RANK[r] in (T.IntegerType, T.LongType) for r in ranks):
        return T.DoubleType()
    return _RANK[top]()


def target_kinds(df: DataFrame, targets: Sequence[str], categorical: Sequence[str] = ()) -> dict[str, str]:
    """"regression" for numbers, "classification" for text, booleans and those named categorical."""
    types = get_feature_names_and_types(df.select(*[F.col(f"`{t}`") for t in targets]))
    return {t: "classification" if t in categorical or not is_number_like_type(types[t]) else "regression" for t in targets}


def validate_targets(df: DataFrame, targets: Sequence[str]) -> None:
    """One aggregate over all targets: no null or NaN."""
    types = get_feature_names_and_types(df.select(*[F.col(f"`{t}`") for t in targets]))
    counts = df.agg(*[F.sum(is_nan_like(F.col(f"`{t}`"), types[t]).cast("int")).alias(f"t{i}") for i, t in enumerate(targets)]).first()
    bad = [t for i, t in enumerate(targets) if counts[i]]
    if bad:
        raise ValueError(f"Target {bad[0]} has NaN-like elements")


def promote_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """``df`` with the targets validated and cast to the smallest type that holds all of them."""
    validate_targets(df, targets)
    types = get_feature_types(df)
    kind = minimum_type([types[t] for t in targets])
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) if c in targets else F.col(f"`{c}`") for c in df.columns])


def validate_features(df: DataFrame, columns: Sequence[str], min_rows: int = 1, min_features: int = 1) -> int:
    """One aggregate: enough rows and features, no null, NaN or infinity. Returns the number of rows."""
    if len(columns) < min_features:
        raise ValueError(f"Found {len(columns)} feature(s) while a minimum of {min_features} is required")
    row = feature_counts(df, columns).first()
    if row[0] < min_rows:
        raise ValueError(f"Found {row[0]} row(s) while a minimum of {min_rows} is required")
    bad = [c for c, n in zip(columns, row[1:]) if n]
    if bad:
        raise ValueError(f"Column {bad[0]} contains NaN or infinity")
    return row[0]


def feature_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``n`` rows, and of each column (``bad_0``, ``bad_1``...) the values that are null, NaN or infinite."""
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    return df.agg(F.count("*").alias("n"), *[F.count(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 1)).alias(f"bad_{i}") for i, v in enumerate(values)])


def vector_of(columns: Sequence[str]) -> Column:
    """Columns packed as an array of doubles; they are doubles before any arithmetic."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
