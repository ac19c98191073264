"""Column expressions and aggregates that the operators are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_WEIGHT = 1e-6


def finite(x: Column) -> Column:
    """x, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def pearson(o: Column, p: Column) -> Column:
    """Correlation over pairs without nulls; null where a side is constant."""
    both = o.isNotNull() & p.isNotNull()
    o, p = F.when(both, o), F.when(both, p)
    return F.try_divide(F.covar_pop(o, p), F.stddev_pop(o) * F.stddev_pop(p))


def metrics(o: str = "obs", p: str = "pred") -> list[Column]:
    """n, rho, mae, rmse and cae of two columns, over pairs without nulls."""
    a, b = F.col(o), F.col(p)
    gap = F.abs(a - b)
    return [
        F.count(gap).alias("n"), pearson(a, b).alias("rho"), F.avg(gap).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.sum(gap).alias("cae"),
    ]


def reported(df: DataFrame) -> DataFrame:
    """Metrics as they are reported: cae to 2 places, rmse and rho to 3, and the square of that rho to 3."""
    rho = F.round("rho", 3)
    return df.select(F.round("cae", 2).alias("cae"), F.round("rmse", 3).alias("rmse"), rho.alias("rho"), F.round(rho * rho, 3).alias("r2"))


def weight(d: Column, least: Column) -> Column:
    """Exponential weight of a distance relative to the least one; at a least distance of 0, all weight is on distance 0."""
    relative = F.exp(-F.try_divide(d, least))
    return F.greatest(F.when(least > 0, relative).otherwise(F.when(d == 0, 1.0).otherwise(0.0)), F.lit(LEAST_WEIGHT))


def minmax(df: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """Columns scaled to [0, 1]; a constant one becomes 0, nulls stay. Ranges come from one aggregation."""
    lows = [F.min(finite(F.col(c))).alias(f"low_{i}") for i, c in enumerate(columns)]
    highs = [F.max(finite(F.col(c))).alias(f"high_{i}") for i, c in enumerate(columns)]
    row = df.agg(*lows, *highs).first()
    scaled = {}
    for i, c in enumerate(columns):
        low, high = row[f"low_{i}"], row[f"high_{i}"]
        if low is None:
            continue
        scaled[c + suffix] = (F.col(c) - F.lit(low)) / F.lit(high - low if high > low else 1.0)
    return df.withColumns(scaled) if scaled else df


def ols(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Slope and intercept of y on x by group; null where x is constant."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(x))
    found = df.groupBy(*by).agg(F.try_divide(F.covar_pop(a, b), F.var_pop(b)).alias("slope"), F.avg(a).alias("mean_y"), F.avg(b).alias("mean_x"))
    return found.select(*by, "slope", (F.col("mean_y") - F.col("slope") * F.col("mean_x")).alias("intercept"))


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def ranges(column: Column, spans) -> Column:
    """Whether a row number is in one of the inclusive ranges."""
    hit = F.lit(False)
    for a, b in spans:
        hit = hit | column.between(a, b)
    return hit
