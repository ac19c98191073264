"""Simplex projection: a future value as the weighted mean of the neighbours' futures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscape.functions.stats import metrics, weight
from foldscape.operators.neighbors import knn
from foldscape.operators.panel import ROW, lead, with_lags


def project(neighbors: DataFrame, by: list[str]) -> DataFrame:
    """by, p, pred and pred_var from neighbours with d, d_min and y."""
    w = neighbors.withColumn("w", weight(F.col("d"), F.col("d_min")))
    mean = w.groupBy(*by, "p").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("pred"), F.collect_list(F.struct("w", "y")).alias("near"))
    # at most k neighbours a row: the variance is taken about the mean, in a second pass over them
    spread = F.aggregate("near", F.lit(0.0), lambda s, x: s + x["w"] * (x["y"] - F.col("pred")) * (x["y"] - F.col("pred")))
    total = F.aggregate("near", F.lit(0.0), lambda s, x: s + x["w"])
    return mean.select(*by, "p", "pred", F.try_divide(spread, total).alias("pred_var"))


def simplex(df: DataFrame, columns: list[str], target: str, lib, pred, tp: int = 1, radius: int = 0, e: int = 0, tau: int = -1, tail: str = "keep", plan: str | None = None) -> DataFrame:
    """row_id, obs, pred and pred_var: rows are those predicted, moved by tp, from the first one predicted on.

    With e = 0 the columns are the state space; with e > 1 each column is first
    extended by its lags. The first tp rows have no prediction; the last ones no
    observation where the panel ends.
    """
    space = list(columns)
    if e > 1:
        df = with_lags(df, columns, e - 1, tau)
        space = [n for c in columns for n in (c, *[f"{c}(t-{k})" for k in range(1, e)])]
    found = project(knn(df, space, target, lib, pred, tp, radius, tail=tail, plan=plan), []).select((F.col("p") + tp).alias(ROW), "pred", "pred_var")
    rows = df.select(ROW).where(_reach(pred, tp))
    every = rows.union(found.select(ROW)).distinct()
    return every.join(lead(df, target, 0, "obs"), ROW, "left").join(found, ROW, "left").select(ROW, "obs", "pred", "pred_var")


def _reach(spans, tp: int):
    """Rows of the ranges, and those tp beyond their ends."""
    hit = F.lit(False)
    for a, b in spans:
        hit = hit | F.col(ROW).between(min(a, a + tp), max(b, b + tp))
    return hit


def skill(forecast: DataFrame) -> DataFrame:
    """n, rho, mae, rmse and cae of a forecast."""
    return forecast.agg(*metrics())
