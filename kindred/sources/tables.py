"""Readers for plot tables: a csv of an id and numbers, and pairs of such files."""

from __future__ import annotations

import os
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder with the published data files, where it is not given.
DATA_VARIABLE = "KINDRED_DATA"


@dataclass
class Dataset:
    """A read pair of tables. ``frame`` has all columns, joined by id."""

    id_col: str
    data: DataFrame
    target: DataFrame
    feature_names: list[str]
    target_names: list[str]

    @property
    def frame(self) -> DataFrame:
        return self.data.join(self.target, self.id_col)

    @property
    def index(self) -> DataFrame:
        return self.data.select(self.id_col)

    def __repr__(self) -> str:
        return f"Dataset(n={self.data.count()}, features={len(self.feature_names)}, targets={len(self.target_names)})"


def load_csv_data(spark: SparkSession, path: str) -> tuple[str, DataFrame, list[str]]:
    """(id column, table, other columns): the first column is a long id, the rest doubles; any other cell is an error."""
    names = spark.read.option("header", True).csv(path).columns  # reads the header line
    schema = T.StructType([T.StructField(names[0], T.LongType(), False), *[T.StructField(n, T.DoubleType(), False) for n in names[1:]]])
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return names[0], df, names[1:]


def _with_place(df: DataFrame) -> DataFrame:
    """``df`` with ``_place``, the row's number in its file; the driver gets a count for each partition."""
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    counts = sorted(tuple(r) for r in marked.groupBy(part.alias("p")).count().collect())
    before = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))
    starts = F.create_map(*[F.lit(x) for pair in (before or {0: 0}).items() for x in pair])
    return marked.withColumn("_place", (starts[part] + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_m")


def load_dataset_from_csv_filenames(spark: SparkSession, *, data_filename: str, target_filename: str, return_X_y: bool = False, as_frame: bool = True, folder: str | None = None, match: str = "id") -> Dataset | tuple[DataFrame, DataFrame]:
    """Two files of the same plots. Everything is a table, so ``as_frame`` changes nothing.

    ``match="id"`` joins them by id; ids of one file only are an error. With ``match="position"`` the n-th rows of both are
    one plot, whose id the data file has; the target file's ids are not looked at, and different lengths are an error.
    """
    folder = folder or os.environ.get(DATA_VARIABLE, "")
    id_col, data, features = load_csv_data(spark, os.path.join(folder, data_filename))
    other, target, targets = load_csv_data(spark, os.path.join(folder, target_filename))
    if match == "position":
        n, m = data.count(), target.count()
        if n != m:
            raise ValueError(f"{data_filename} has {n} rows and {target_filename} has {m}")
        places = _with_place(data).select("_place", F.col(f"`{id_col}`").alias("_id"))
        target = _with_place(target).join(places, "_place").select(F.col("_id").alias(id_col), *[F.col(f"`{t}`") for t in targets])
    elif match == "id":
        target = target.withColumnRenamed(other, id_col)
        alone = data.select(id_col).join(target.select(id_col), id_col, "full_outer").count() - data.join(target.select(id_col), id_col, "left_semi").count()
        if alone:
            raise ValueError(f"{alone} id(s) are in one of {data_filename} and {target_filename} only")
    else:
        raise ValueError(f"match has to be 'id' or 'position', not {match!r}")
    return (data, target) if return_X_y else Dataset(id_col, data, target, features, targets)


def load_moscow_stjoes(spark: SparkSession, return_X_y: bool = False, as_frame: bool = True, folder: str | None = None, match: str = "id"):
    """Moscow Mountain / St. Joes: 165 plots, 28 features, 35 targets."""
    return load_dataset_from_csv_filenames(spark, data_filename="moscow_env.csv", target_filename="moscow_spp.csv", return_X_y=return_X_y, as_frame=as_frame, folder=folder, match=match)


def load_swo_ecoplot(spark: SparkSession, return_X_y: bool = False, as_frame: bool = True, folder: str | None = None, match: str = "id"):
    """Southwest Oregon ecoplots: 3005 plots, 18 features, 25 targets."""
    return load_dataset_from_csv_filenames(spark, data_filename="swo_ecoplot_env.csv", target_filename="swo_ecoplot_spp.csv", return_X_y=return_X_y, as_frame=as_frame, folder=folder, match=match)


def from_rows(spark: SparkSession, rows, names: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """In-memory rows (nested lists, an array, a pandas frame or series) as a table with an id column: the frame's index, else positions."""
    import pandas as pd

    frame = rows.to_frame() if isinstance(rows, pd.Series) else rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows)
    frame = frame.rename(columns={c: str(c) for c in frame.columns}) if names is None else frame.set_axis(names, axis=1)
    return spark.createDataFrame(frame.assign(**{id_col: frame.index})[[id_col, *frame.columns]])
