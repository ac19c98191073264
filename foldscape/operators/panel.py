"""Panels: wide tables of time-ordered observations with an explicit row_id from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from foldscape.functions.stats import finite

ROW = "row_id"


def with_rows(df: DataFrame, order: str) -> DataFrame:
    """row_id by the order of a column. Numbers are counted in each range of it and summed up, so no task has all rows.

    The ranges are cached: drawn again, their bounds could differ from those that were counted.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).persist()
    counts = parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row a partition
    starts, total = [], 0
    for r in counts:
        starts.append((r["_part"], total))
        total += r["n"]
    base = spark.createDataFrame(starts or [(0, 0)], "_part int, _base long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("_local", local).join(F.broadcast(base), "_part").withColumn(ROW, F.col("_base") + F.col("_local")).drop("_part", "_base", "_local")


def variables(df: DataFrame, time_col: str | None = None) -> list[str]:
    """Numeric columns beside row_id and the time column, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in (ROW, time_col)]


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """row_id and the columns as doubles; NaN and infinities become null."""
    return df.select(F.col(ROW).cast("long").alias(ROW), *[finite(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])


def matching(names: list[str], patterns, keep: str | None = None) -> list[str]:
    """Names that contain a pattern, each once, by pattern and then position; `keep` is added if it is lost."""
    if not patterns:
        return list(names)
    out = list(dict.fromkeys(n for p in patterns for n in names if p in n))
    return out + [keep] if keep and keep in names and keep not in out else out


def choose(names: list[str], span: tuple[int, int] | None = None, positions=None, patterns=None) -> list[str]:
    """Columns by half-open 0-based range, by 0-based positions, or by substring; the first that is given counts."""
    if span:
        return list(names[span[0] : span[1]])
    if positions:
        return [names[i] for i in positions]
    return matching(names, patterns)


def drop_leading(df: DataFrame, remove_first: bool = False, implicit_time: bool = False) -> DataFrame:
    """Drop the first column for each of the two flags: both together drop two."""
    names = [c for c in df.columns if c != ROW]
    return df.drop(*names[: int(remove_first) + int(implicit_time)])


def candidates(names: list[str], excluded=(), selected=()) -> list[str]:
    """Names that are neither excluded nor selected, in order. A target is a candidate unless it is excluded."""
    out = set(excluded) | set(selected)
    return [n for n in names if n not in out]


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """row_id, variable, value."""
    return df.unpivot([ROW], columns, "variable", "value")


def dense(df: DataFrame, keys: DataFrame, on: list[str], fills: dict) -> DataFrame:
    """`keys` with the columns of `df`, nulls filled where `fills` says so."""
    return keys.join(df, on, "left").fillna(fills)


def lags(df: DataFrame, columns: list[str], e: int, tau: int = -1) -> DataFrame:
    """row_id and, for each column V, lags `V(t-0)` … `V(t-(e-1))`; lag k of row t is the value at t + k·tau.

    Each value is sent to the rows that it is a lag of, and they are gathered by
    row: one shuffle, whatever e is, and no window over all rows. Rows of the
    panel whose lags lie outside it have nulls.
    """
    sent = df.select(F.explode(F.sequence(F.lit(0), F.lit(e - 1))).alias("_k"), *[f"`{c}`" for c in columns], (F.col(ROW) - F.col("_k") * tau).alias("_to"), (F.col("_k") == 0).alias("_own"))
    found = sent.groupBy(F.col("_to").alias(ROW)).agg(
        F.max("_own").alias("_own"), *[F.max(F.when(F.col("_k") == k, F.col(f"`{c}`"))).alias(f"{c}(t-{k})") for c in columns for k in range(e)]
    )
    return found.where("_own").drop("_own")


def with_lags(df: DataFrame, columns: list[str], delays: int, tau: int = -1) -> DataFrame:
    """`df` with the lags 1 … delays of the columns."""
    found = lags(df, columns, delays + 1, tau)
    return df.join(found.drop(*[f"{c}(t-0)" for c in columns]), ROW)


def lead(df: DataFrame, column: str, tp: int, name: str) -> DataFrame:
    """row_id and the column's value tp rows later, by equi-join on row numbers: gaps stay gaps."""
    return df.select((F.col(ROW) - tp).alias(ROW), F.col(f"`{column}`").alias(name))
