"""Embedding dimension: skill of a column's own lags for a target, for each number of lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldscape.functions.stats import pearson
from foldscape.operators.blocks import block_embeddings
from foldscape.operators.neighbors import RELATIONAL_PAIRS, eligible, library, nearest, predicted
from foldscape.operators.panel import ROW, lags, lead
from foldscape.operators.simplex import project
from foldscape.plans.cost import strategy


def embed_dimension(df: DataFrame, column: str, target: str, lib, pred, max_e: int = 15, tp: int = 1, tau: int = -1, radius: int = 0, tail: str = "keep", plan: str | None = None) -> DataFrame:
    """e and rho for e = 1 … max_e, in one job: distances for all e are running sums over lags."""
    if (plan or strategy(max_e, lib, pred, RELATIONAL_PAIRS)) == "vectorised":
        each = block_embeddings(df, column, target, lib, pred, max_e, tp, tau, radius, tail)
        return each.groupBy("e").agg(pearson(F.col("obs"), F.col("pred")).alias("rho"))
    embedded = lags(df, [column], max_e, tau)
    arrays = embedded.select(ROW, F.array(*[F.col(f"`{column}(t-{k})`") for k in range(max_e)]).alias("x"))
    inner = library(df, target, lib, tp, tail).select(ROW, "_y").join(arrays, ROW).select(F.col(ROW).alias("l"), F.col("_y").alias("y"), F.col("x").alias("xl"))
    outer = predicted(df, pred).select(ROW).join(arrays, ROW).select(F.col(ROW).alias("p"), F.col("x").alias("xp"))
    pairs = outer.join(inner, eligible(F.col("p"), F.col("l"), radius))
    steps = F.zip_with("xp", "xl", lambda a, b: (a - b) * (a - b))
    sums = F.transform(F.sequence(F.lit(1), F.lit(max_e)), lambda e: F.aggregate(F.slice("steps", 1, e), F.lit(0.0), lambda s, x: s + x))
    each = pairs.withColumn("steps", steps).select("p", "l", "y", F.posexplode(sums).alias("at", "d2")).select((F.col("at") + 1).alias("e"), "p", "l", "y", "d2")
    found = project(nearest(each, ["e"], F.col("e") + 1), ["e"]).join(lead(df, target, tp, "obs").withColumnRenamed(ROW, "p"), "p", "left")
    return found.groupBy("e").agg(pearson(F.col("obs"), F.col("pred")).alias("rho"))


def best_e(curve: DataFrame) -> DataFrame:
    """e and rho at the largest rho, compared at 4 decimals; the smallest such e."""
    return curve.where("rho is not null").agg(F.min_by(F.struct("e", "rho"), F.struct(-F.round("rho", 4), F.col("e"))).alias("b")).select("b.e", "b.rho")


def first_peak(curve: DataFrame) -> DataFrame:
    """e and rho at the first strict inner peak of rho, compared at 4 decimals; at the last e if there is none."""
    order = Window.orderBy("e")  # max_e rows
    r = F.round("rho", 4)
    marked = curve.where("rho is not null").withColumn("peak", (r > F.lag(r).over(order)) & (r > F.lead(r).over(order)))
    at = F.coalesce(F.min(F.when(F.col("peak"), F.col("e"))), F.max("e"))
    return marked.agg(at.alias("e"), F.collect_list(F.struct("e", "rho")).alias("all")).select("e", F.filter("all", lambda x: x["e"] == F.col("e"))[0]["rho"].alias("rho"))
