"""Chosen observables against principal components and diffusion maps, by forecast metrics."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscape.config import as_ranges
from foldscape.functions.stats import metrics, ranges, reported
from foldscape.operators.blocks import block_neighbors
from foldscape.operators.neighbors import RELATIONAL_PAIRS, nearest, pair_table
from foldscape.operators.panel import ROW, numeric, variables
from foldscape.operators.simplex import simplex
from foldscape.plans.cost import strategy

log = logging.getLogger("foldscape")

#: Library rows up to which eigenvectors are taken on the driver.
DIFFUSION_ROWS = 5_000


def linear(train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
    """row_id, obs and pred of a least-squares fit with intercept; rows with nulls are left out."""
    assembled = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip")
    fit = LinearRegression(featuresCol="_f", labelCol=target, regParam=0.0, solver="normal").fit(assembled.transform(train.where(F.col(f"`{target}`").isNotNull())))
    out = fit.transform(assembled.transform(test))
    return out.select(ROW, F.col(f"`{target}`").alias("obs"), F.col("prediction").alias("pred"))


def pca_scores(train: DataFrame, test: DataFrame, features: list[str], k: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """row_id and c0 … of both blocks, centred by the first one's means, and the explained variance ratios."""
    assembled = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip")
    centred = StandardScaler(inputCol="_f", outputCol="_c", withMean=True, withStd=False).fit(assembled.transform(train))
    model = PCA(k=k, inputCol="_c", outputCol="_s").fit(centred.transform(assembled.transform(train)))

    def scores(df: DataFrame) -> DataFrame:
        s = model.transform(centred.transform(assembled.transform(df))).withColumn("_s", vector_to_array("_s"))
        return s.select(ROW, *[F.col("_s")[i].alias(f"c{i}") for i in range(k)])

    return scores(train), scores(test), [float(v) for v in model.explainedVariance.toArray()]


def kernel_width(d2: np.ndarray) -> float:
    """Epsilon where the log of the summed kernel grows fastest with the log of epsilon."""
    exponents = np.arange(-40.0, 41.0)
    d2 = d2[np.isfinite(d2)].reshape(-1)
    scale = np.median(d2[d2 > 0]) if (d2 > 0).any() else 1.0
    sums = np.array([np.exp(-d2 / (4 * 2.0**p * scale)).sum() for p in exponents])
    growth = np.diff(np.log(sums)) / np.log(2.0)
    return float(2.0 ** exponents[int(growth.argmax())] * scale)


class DiffusionMap:
    """Eigenvectors of a normalised neighbour kernel on library rows, extended to others by its weighted means.

    epsilon: a number; "bgh" for the width of fastest growth; "bgh_generous" for twice that.
    """

    def __init__(self, k: int = 15, components: int = 5, epsilon="bgh", alpha: float = 0.5):
        self.k, self.components, self.epsilon, self.alpha = k, components, epsilon, alpha

    def fit(self, train: DataFrame, features: list[str]) -> DiffusionMap:
        n = train.count()
        if n > DIFFUSION_ROWS:
            raise ValueError(f"{n} library rows; eigenvectors are taken on the driver of up to {DIFFUSION_ROWS}")
        near = neighbor_table(train, train, features, self.k, itself=True).collect()
        self.features, self.train = features, train
        self.rows = sorted({r["p"] for r in near})
        place = {r: i for i, r in enumerate(self.rows)}
        m = len(self.rows)
        d2 = np.full((m, m), np.inf)
        for r in near:
            d2[place[r["p"]], place[r["l"]]] = r["d2"]
        d2 = np.minimum(d2, d2.T)
        self.width = float(self.epsilon) if not isinstance(self.epsilon, str) else kernel_width(d2) * (2 if self.epsilon == "bgh_generous" else 1)
        kernel = np.exp(-d2 / (4 * self.width))
        self.density = kernel.sum(axis=1) ** -self.alpha
        kernel = kernel * self.density[:, None] * self.density[None, :]
        root = np.sqrt(kernel.sum(axis=1))
        values, vectors = np.linalg.eigh(kernel / root[:, None] / root[None, :])
        order = np.argsort(-values)[1 : self.components + 1]  # the first is constant
        self.values = values[order]
        vectors = vectors[:, order] / root[:, None]
        sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        self.vectors = vectors * np.where(sign == 0, 1, sign)
        return self

    def coordinates(self, df: DataFrame) -> DataFrame:
        """row_id and c0 … for any rows, by their nearest library rows: a join and a weighted mean."""
        spark = df.sparkSession
        table = spark.createDataFrame(
            [(int(r), float(w), [float(x) for x in v]) for r, w, v in zip(self.rows, self.density, self.vectors / self.values, strict=True)], "l long, q double, v array<double>"
        )
        near = neighbor_table(self.train, df, self.features, self.k, itself=True).join(F.broadcast(table), "l")  # DIFFUSION_ROWS at most
        w = near.withColumn("w", F.exp(-F.col("d2") / (4 * self.width)) * F.col("q"))
        means = [F.try_divide(F.sum(F.col("w") * F.col("v")[i]), F.sum("w")).alias(f"c{i}") for i in range(len(self.values))]
        return w.groupBy(F.col("p").alias(ROW)).agg(*means)


def neighbor_table(lib: DataFrame, pred: DataFrame, features: list[str], k: int, itself: bool = False, plan: str | None = None) -> DataFrame:
    """p, l and d2 of the k nearest library rows of every row, in the space of the features; optionally each row itself too."""
    known = lib.withColumn("_y", F.lit(0.0))
    if (plan or strategy(1, ((1, lib.count()),), ((1, pred.count()),), RELATIONAL_PAIRS)) == "vectorised":
        found = block_neighbors(known, pred, features, 0, k).select("p", "l", "d2")
    else:
        found = nearest(pair_table(known, pred, features, [], 0), [], k).select("p", "l", "d2")
    if itself:
        same = pred.select(F.col(ROW).alias("p")).join(lib.select(F.col(ROW).alias("l")), F.col("p") == F.col("l")).select("p", "l", F.lit(0.0).alias("d2"))
        found = found.unionByName(same)
    return found


METHODS = ("simplex", "pca", "diffusion")


def compare(df: DataFrame, target: str, columns: list[str], *, methods=METHODS, **how) -> DataFrame:
    """method, cae, rmse, rho and r2 of simplex on `columns`, and of regressions on PCA and diffusion coordinates of `features`.

    Metrics are of the values as they are; only a plot of them is scaled. `how`: as for forecasts().
    """
    if not columns:
        raise ValueError("columns are required")
    out = None
    for method, forecast in forecasts(df, target, columns, methods=methods, **how).items():
        one = reported(forecast.agg(*metrics())).select(F.lit(method).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def forecasts(
    df: DataFrame, target: str, columns: list[str], *, methods=METHODS, features: list[str] | None = None, exclude=(), lib=(), pred=(), tp: int = 0, e: int = 0,
    tau: int = -1, radius: int = 0, components: int = 5, k: int = 15, epsilon="bgh", alpha: float = 0.5,
) -> dict[str, DataFrame]:
    """row_id, obs and pred by each of the methods; what a plot of the comparison shows."""
    names = variables(df)
    features = [f for f in (features or [c for c in names if c != target]) if f not in set(exclude)]
    panel = numeric(df, names)
    n = panel.count()
    lib, pred = as_ranges(lib) or ((1, n),), as_ranges(pred) or ((1, n),)
    train, test = panel.where(ranges(F.col(ROW), lib)), panel.where(ranges(F.col(ROW), pred))
    y = panel.select(ROW, f"`{target}`")
    out = {}
    if "simplex" in methods:
        out["simplex"] = simplex(panel, columns, target, lib, pred, tp, radius, e, tau).select(ROW, "obs", "pred")
    if "pca" in methods:
        a, b, explained = pca_scores(train, test, features, min(components, len(features)))
        log.info("explained variance: %s", [round(v, 4) for v in explained])
        coordinates = [c for c in a.columns if c != ROW]
        out["pca"] = linear(a.join(y, ROW), b.join(y, ROW), coordinates, target)
    if "diffusion" in methods:
        full = train.dropna(subset=features)
        maps = DiffusionMap(k, components, epsilon, alpha).fit(full, features)
        coordinates = [f"c{i}" for i in range(len(maps.values))]
        out["diffusion"] = linear(maps.coordinates(full).join(y, ROW), maps.coordinates(test.dropna(subset=features)).join(y, ROW), coordinates, target)
    return out
