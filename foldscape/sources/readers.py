"""Panels and slope matrices from files and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foldscape.operators.panel import ROW, matching, with_rows


def array_names(n: int, leading=()) -> list[str]:
    """c0, c1, … for the columns of an array, with given names for the first ones."""
    leading = list(leading)
    if len(leading) > n:
        raise ValueError(f"{len(leading)} names for {n} columns")
    return leading + [f"c{i}" for i in range(n - len(leading))]


def _bytes(spark: SparkSession, path: str) -> bytes:
    """A file's bytes by Spark's own reader, so that any of its stores will do."""
    return spark.read.format("binaryFile").load(path).select("content").first()[0]


def _from_matrix(spark: SparkSession, matrix, leading) -> DataFrame:
    import pandas as pd

    if matrix.ndim != 2:
        raise ValueError(f"an array panel has two dimensions, not {matrix.ndim}")
    names = array_names(matrix.shape[1], leading)
    frame = pd.DataFrame(matrix.astype(float), columns=names)
    frame.insert(0, ROW, range(1, len(frame) + 1))
    return spark.createDataFrame(frame)


def read_panel(spark: SparkSession, path: str, *, member: str | None = None, leading=(), match=(), target: str | None = None, order: str | None = None, remove_first: bool = False, schema=None) -> DataFrame:
    """A panel with row_id from .csv, .parquet, .feather, .npy or .npz.

    Rows are numbered by `order`; without it, in the order of the file. `match`
    keeps columns that contain one of the patterns, and the target.
    """
    import io

    import numpy as np

    if path.endswith(".csv"):
        read = spark.read.option("header", True)
        df = read.schema(schema).csv(path) if schema else read.option("inferSchema", True).csv(path)
    elif path.endswith((".parquet", ".parquet/")):
        df = spark.read.parquet(path)
    elif path.endswith(".feather"):
        import pyarrow.feather

        df = spark.createDataFrame(pyarrow.feather.read_table(io.BytesIO(_bytes(spark, path))).to_pandas())
    elif path.endswith(".npz"):
        with np.load(io.BytesIO(_bytes(spark, path))) as held:
            if member not in held.files:
                raise KeyError(f"{member} isn't in {path}; it has {sorted(held.files)}")
            df = _from_matrix(spark, held[member], leading)
    elif path.endswith(".npy"):
        df = _from_matrix(spark, np.load(io.BytesIO(_bytes(spark, path))), leading)
    else:
        raise ValueError(f"unknown format: {path}")
    return as_panel(df, match=match, target=target, order=order, remove_first=remove_first)


def as_panel(df: DataFrame, *, match=(), target: str | None = None, order: str | None = None, remove_first: bool = False) -> DataFrame:
    """Any DataFrame as a panel: row_id is added if it has none."""
    if ROW not in df.columns:
        own = order or "_file_order"
        df = with_rows(df if order else df.withColumn(own, F.monotonically_increasing_id()), own)
        df = df if order else df.drop(own)
        df = df.select(ROW, *[c for c in df.columns if c != ROW])
    if remove_first:
        df = df.drop(next(c for c in df.columns if c != ROW))
    names = [c for c in df.columns if c != ROW]
    return df.select(ROW, *[f"`{c}`" for c in matching(names, match, target)])


def read_slopes(spark: SparkSession, path: str) -> DataFrame:
    """(source, predicted, slope) from a square matrix: .csv without labels of rows, or .feather with them as its index."""
    if path.endswith(".csv"):
        wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
        if not isinstance(wide.schema[0].dataType, DoubleType):
            raise ValueError("a slope matrix in CSV has no column of labels: its first column must be numbers with decimals")
        labels = wide.columns
        rows = with_rows(wide.withColumn("_o", F.monotonically_increasing_id()), "_o").drop("_o")
    elif path.endswith(".feather"):
        import io

        import pyarrow.feather

        frame = pyarrow.feather.read_table(io.BytesIO(_bytes(spark, path))).to_pandas()
        if list(frame.index) != list(frame.columns):
            raise ValueError("a slope matrix has the same labels on both sides")
        labels = [str(c) for c in frame.columns]
        frame.columns = labels
        frame.insert(0, ROW, range(1, len(frame) + 1))
        rows = spark.createDataFrame(frame)
    else:
        raise ValueError(f"unknown format: {path}")
    if rows.count() != len(labels):
        raise ValueError(f"a slope matrix is square: {rows.count()} rows, {len(labels)} columns")
    return matrix_to_slopes(rows, labels)


def matrix_to_slopes(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Long form of a wide matrix whose nth row is labelled by the nth name."""
    long = rows.select(ROW, *[F.col(f"`{c}`").cast("double").alias(c) for c in labels]).unpivot([ROW], labels, "predicted", "slope")
    return long.select(F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(ROW).cast("int")).alias("source"), "predicted", "slope")


def slopes_to_matrix(slopes: DataFrame, labels: list[str]) -> DataFrame:
    """The wide form, one row a source."""
    return slopes.groupBy("source").pivot("predicted", labels).agg(F.first("slope"))


def read_root(spark: SparkSession, path: str) -> DataFrame:
    """An earlier result as the seed of a driver graph."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.endswith(".feather"):
        import io

        import pyarrow.feather

        return spark.createDataFrame(pyarrow.feather.read_table(io.BytesIO(_bytes(spark, path))).to_pandas())
    return spark.read.parquet(path)


def matrix_schema(labels: list[str]) -> StructType:
    return StructType([StructField(c, DoubleType()) for c in labels])
