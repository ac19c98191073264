"""Nearest neighbours of predicted rows among library rows, as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscape.functions.stats import ranges
from foldscape.operators.panel import ROW, lead
from foldscape.plans.cost import strategy

#: Pairs of rows (times candidates) up to which the relational plans are used; the nested loop's inner side is smaller still.
RELATIONAL_PAIRS = 20_000_000


def library(df: DataFrame, target: str, spans, tp: int, tail: str = "keep") -> DataFrame:
    """Rows that may be neighbours: in the ranges, with a known target tp rows later (`_y`).

    tail="trim" also asks that the later row is in the ranges.
    """
    out = df.join(lead(df, target, tp, "_y"), ROW).where(ranges(F.col(ROW), spans) & F.col("_y").isNotNull())
    return out.where(ranges(F.col(ROW) + tp, spans)) if tail == "trim" else out


def predicted(df: DataFrame, spans) -> DataFrame:
    return df.where(ranges(F.col(ROW), spans))


def eligible(p: Column, q: Column, radius: int) -> Column:
    """A row isn't its own neighbour, nor are rows within the exclusion radius."""
    return F.abs(p - q) > radius if radius else p != q


def squares(a: str, b: str) -> Column:
    """Squared distance of two arrays; null if any coordinate is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def pair_table(lib: DataFrame, pred: DataFrame, columns: list[str], extra: list[str], radius: int) -> DataFrame:
    """p, l, y, d2 over `columns`, and arrays xp and xl of `extra` columns, for all eligible pairs.

    A nested loop: callers keep it to RELATIONAL_PAIRS, which bounds its inner side.
    """
    array = lambda names: F.array(*[F.col(f"`{c}`") for c in names]) if names else F.array().cast("array<double>")
    inner = lib.select(F.col(ROW).alias("l"), F.col("_y").alias("y"), array(columns).alias("bl"), array(extra).alias("xl"))
    outer = pred.select(F.col(ROW).alias("p"), array(columns).alias("bp"), array(extra).alias("xp"))
    return outer.join(inner, eligible(F.col("p"), F.col("l"), radius)).select("p", "l", "y", squares("bp", "bl").alias("d2"), "xp", "xl")


def nearest(pairs: DataFrame, by: list[str], k: Column | int) -> DataFrame:
    """The k nearest neighbours of each p (and `by`): ties go to the smaller l. Adds rank, d and d_min."""
    window = Window.partitionBy(*by, "p")
    ranked = pairs.where("d2 is not null").withColumn("rank", F.row_number().over(window.orderBy("d2", "l"))).where(F.col("rank") <= k)
    return ranked.withColumn("d", F.sqrt("d2")).withColumn("d_min", F.min("d").over(window))


def knn(
    df: DataFrame, columns: list[str], target: str, lib, pred, tp: int = 1, radius: int = 0, k: int | None = None, tail: str = "keep", plan: str | None = None
) -> DataFrame:
    """p, l, y, d2, rank, d, d_min of the k (by default one more than there are columns) nearest neighbours."""
    k = k or len(columns) + 1
    if (plan or strategy(1, lib, pred, RELATIONAL_PAIRS)) == "vectorised":
        from foldscape.operators.blocks import block_neighbors

        return nearest(block_neighbors(library(df, target, lib, tp, tail), predicted(df, pred), columns, radius, k), [], k)
    return nearest(pair_table(library(df, target, lib, tp, tail), predicted(df, pred), columns, [], radius).drop("xp", "xl"), [], k)
