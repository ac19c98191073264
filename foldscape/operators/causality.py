"""Convergent cross mapping: does skill grow with the library?"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscape.functions.stats import LEAST_WEIGHT, ols, pearson
from foldscape.operators.neighbors import RELATIONAL_PAIRS, eligible, nearest
from foldscape.operators.panel import ROW, lags, lead
from foldscape.operators.simplex import project

#: Panel bytes (rows times lags times 8) up to which a draw's task gets the series whole.
SERIES_BYTES = 64 << 20


def draws(rows: DataFrame, sizes, sample: int, seed: int) -> DataFrame:
    """size, draw and l: `sample` random libraries of each size, without replacement.

    Rows are ranked by md5 of seed, size, draw and row number: the same libraries
    in every run and on any engine. Each draw is ranked on its own.
    """
    grid = rows.sparkSession.createDataFrame([(int(n), s) for n in sizes for s in range(sample)], "size int, draw int")
    each = rows.select(F.col(ROW).alias("l")).join(F.broadcast(grid), F.lit(True))
    from pyspark.sql import Window

    key = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("size", "draw", "l")]))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("size", "draw").orderBy(key, "l")))
    return ranked.where("rank <= size").drop("rank")


def ccm_curve(df: DataFrame, column: str, target: str, sizes, sample: int = 20, seed: int = 0, e: int = 1, tau: int = -1, tp: int = 0, radius: int = 0, plan: str | None = None, n: int | None = None) -> DataFrame:
    """size and rho: mean skill of the column's e lags for the target, by library size. n: the panel's rows, if known."""
    n = df.count() if n is None else n
    names = [f"{column}(t-{k})" for k in range(e)]
    space = lags(df, [column], e, tau).join(lead(df, target, tp, "y"), ROW).select(ROW, "y", F.array(*[F.col(f"`{c}`") for c in names]).alias("x"))
    space = space.where(F.forall("x", lambda v: v.isNotNull()))
    drawn = draws(space.where("y is not null"), sizes, sample, seed)
    plan = plan or ("relational" if n * sample * sum(sizes) <= RELATIONAL_PAIRS else "vectorised")
    if plan == "relational":
        inner = drawn.join(space.withColumnRenamed(ROW, "l"), "l").select("size", "draw", "l", "y", F.col("x").alias("xl"))
        outer = space.select(F.col(ROW).alias("p"), F.col("x").alias("xp"))
        d2 = F.aggregate(F.zip_with("xp", "xl", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        pairs = inner.join(F.broadcast(outer), eligible(F.col("p"), F.col("l"), radius)).select("size", "draw", "p", "l", "y", d2.alias("d2"))
        found = project(nearest(pairs, ["size", "draw"], e + 1), ["size", "draw"])
        obs = space.select(F.col(ROW).alias("p"), F.col("y").alias("obs"))
        each = found.join(obs, "p").groupBy("size", "draw").agg(pearson(F.col("obs"), F.col("pred")).alias("rho"))
    else:
        each = _by_draw(space, drawn, n, e, radius)
    return each.groupBy("size").agg(F.avg("rho").alias("rho"))


def _by_draw(space: DataFrame, drawn: DataFrame, n: int, e: int, radius: int) -> DataFrame:
    """size, draw and rho, a draw a task. The series goes along whole, behind a check of its size."""
    if n * (e + 2) * 8 > SERIES_BYTES:
        raise ValueError(f"{n} rows are too many for library draws in memory; predict fewer rows or use the relational plan")
    series = space.toPandas()
    rows, y, x = series[ROW].to_numpy(), series["y"].to_numpy(float), np.array(series["x"].tolist(), float)

    def run(key, own):
        lib = np.isin(rows, own["l"].to_numpy())
        lr, ly, lx = rows[lib], y[lib], x[lib]
        order = np.argsort(lr)
        lr, ly, lx = lr[order], ly[order], lx[order]
        pred = np.full(len(rows), np.nan)
        for a in range(0, len(rows), 256):
            d2 = ((x[a : a + 256, None, :] - lx[None]) ** 2).sum(axis=2)
            d2[np.abs(rows[a : a + 256, None] - lr[None]) <= radius] = np.inf
            near = np.argsort(d2, axis=1, kind="stable")[:, : e + 1]
            d = np.sqrt(np.take_along_axis(d2, near, axis=1))
            least = d[:, :1]
            w = np.where(least > 0, np.exp(-d / np.where(least > 0, least, 1)), np.where(d == 0, 1.0, 0.0))
            w = np.where(np.isfinite(d), np.maximum(w, LEAST_WEIGHT), 0)
            pred[a : a + 256] = (w * ly[near]).sum(axis=1) / w.sum(axis=1)
        ok = np.isfinite(pred) & np.isfinite(y)
        o, p = y[ok] - y[ok].mean(), pred[ok] - pred[ok].mean()
        both = np.sqrt((o**2).sum() * (p**2).sum())
        return pd.DataFrame({"size": [key[0]], "draw": [key[1]], "rho": [float((o * p).sum() / both) if both > 0 else None]})

    return drawn.groupBy("size", "draw").applyInPandas(run, "size int, draw int, rho double")


def slope(curve: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The convergence slope: of rho (null as 0) on size / n, to 5 decimals; null for fewer than two sizes."""
    by = by or []
    points = curve.select(*by, F.coalesce("rho", F.lit(0.0)).alias("r"), (F.col("size") / F.lit(float(n))).alias("s"))
    return ols(points, by, "r", "s").select(*by, F.round("slope", 5).alias("slope"))


def slopes_of(df: DataFrame, target: str, dimensions: dict[str, int], sizes, n: int, **how) -> dict[str, float]:
    """Slope of the target's manifold predicting each candidate, in that many dimensions: the driven variable remembers its driver. One job."""
    every = None
    for name, e in dimensions.items():
        one = slope(ccm_curve(df, target, name, sizes, e=e, n=n, **how), n).select(F.lit(name).alias("variable"), "slope")
        every = one if every is None else every.unionByName(one)
    found = {r["variable"]: r["slope"] for r in every.collect()} if every is not None else {}
    return {name: found[name] if found.get(name) is not None else 0.0 for name in dimensions}


def slope_of(df: DataFrame, candidate: str, target: str, sizes, n: int, e: int = 1, **how) -> float:
    """The slope of one candidate."""
    return slopes_of(df, target, {candidate: e}, sizes, n, **how)[candidate]


def slope_table(matrix: DataFrame, orientation: str = "candidate_row") -> DataFrame:
    """candidate, target and slope from (source, predicted, slope)."""
    a, b = ("source", "predicted") if orientation == "candidate_row" else ("predicted", "source")
    return matrix.select(F.col(a).alias("candidate"), F.col(b).alias("target"), F.when(~F.isnan("slope"), F.col("slope")).alias("slope"))


def check_slopes(slopes: DataFrame, names: list[str], target: str) -> None:
    """Every candidate needs a row, rows and columns the same names, and the target must be one of them."""
    rows = {r[0] for r in slopes.select("candidate").distinct().collect()}
    columns = {r[0] for r in slopes.select("target").distinct().collect()}
    if rows != columns:
        raise ValueError(f"a slope matrix needs the same names on both sides: {sorted(rows ^ columns)}")
    if target not in columns:
        raise ValueError(f"the slope matrix has no {target}")
    missing = [n for n in names if n not in rows]
    if missing:
        raise ValueError(f"the slope matrix lacks {missing}")


def passing(ranked: DataFrame, slopes: DataFrame, target: str, slope_min: float) -> DataFrame:
    """Ranked candidates whose slope is above the threshold, in rank order; a null slope fails."""
    own = slopes.where(F.col("target") == target).select(F.col("candidate").alias("variable"), "slope")
    return ranked.join(own, "variable").where(F.col("slope") > slope_min).orderBy(F.desc("rho"), "ord")
