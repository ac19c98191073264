"""Cross mapping: forecast skill of a target from each of many column combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscape.functions.stats import pearson
from foldscape.operators import blocks
from foldscape.operators.neighbors import RELATIONAL_PAIRS, library, nearest, pair_table, predicted
from foldscape.operators.panel import ROW, lead
from foldscape.operators.simplex import project, simplex, skill
from foldscape.plans.cost import strategy


def sweep_forecasts(df: DataFrame, base: list[str], names: list[str], target: str, lib, pred, tp: int, radius: int, tail: str = "keep", plan: str | None = None) -> DataFrame:
    """variable, p, obs and pred of the projection on [variable, *base], for every variable in one job."""
    plan = plan or strategy(len(names), lib, pred, RELATIONAL_PAIRS)
    if plan == "vectorised":
        return blocks.block_forecasts(df, base, names, target, lib, pred, tp, radius, tail)
    pairs = pair_table(library(df, target, lib, tp, tail), predicted(df, pred), base, names, radius)
    each = pairs.select("p", "l", "y", "d2", F.posexplode(F.zip_with("xp", "xl", lambda a, b: (a - b) * (a - b))).alias("v", "x2"))
    near = nearest(each.select("v", "p", "l", "y", (F.col("d2") + F.col("x2")).alias("d2")), ["v"], len(base) + 2)
    found = project(near, ["v"]).join(lead(df, target, tp, "obs").withColumnRenamed(ROW, "p"), "p", "left")
    naming = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("v") + 1)
    return found.select(naming.alias("variable"), "p", "obs", "pred")


class Carried:
    """Squared differences of every pair of rows in every variable, worked out once and held for all dimensions of an expansion.

    A dimension's distances are those of the variables chosen before, carried on,
    and a candidate's own. RELATIONAL_PAIRS bounds what is held: pairs times variables.
    """

    def __init__(self, df: DataFrame, names: list[str], target: str, lib, pred, tp: int, radius: int, tail: str = "keep"):
        pairs = pair_table(library(df, target, lib, tp, tail), predicted(df, pred), [], names, radius)
        self.held = pairs.select("p", "l", "y", F.zip_with("xp", "xl", lambda a, b: (a - b) * (a - b)).alias("steps")).persist()
        self.names, self.obs = list(names), lead(df, target, tp, "obs").withColumnRenamed(ROW, "p")

    def sweep(self, base: list[str], names: list[str]) -> DataFrame:
        """As sweep(), for variables that are held."""
        step = lambda c: F.col("steps")[self.names.index(c)]
        d2 = F.lit(0.0)
        for c in base:
            d2 = d2 + step(c)
        each = self.held.select("p", "l", "y", F.posexplode(F.array(*[d2 + step(c) for c in names])).alias("v", "d2"))
        found = project(nearest(each, ["v"], len(base) + 2), ["v"]).join(self.obs, "p", "left")
        rho = found.groupBy("v").agg(pearson(F.col("obs"), F.col("pred")).alias("rho"))
        return rho.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("v") + 1).alias("variable"), (F.col("v") + 1).alias("ord"), "rho")

    def release(self) -> None:
        self.held.unpersist()


def sweep(df: DataFrame, base: list[str], names: list[str], target: str, lib, pred, tp: int = 1, radius: int = 0, tail: str = "keep", plan: str | None = None) -> DataFrame:
    """variable, ord (its place in `names`) and rho, for every variable."""
    found = sweep_forecasts(df, base, names, target, lib, pred, tp, radius, tail, plan).groupBy("variable").agg(pearson(F.col("obs"), F.col("pred")).alias("rho"))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("variable")).cast("int")
    return found.select("variable", place.alias("ord"), "rho")


def ranking(swept: DataFrame, rho_min: float) -> DataFrame:
    """Rows with rho above the threshold, best first; ties by place. Null skills are never ranked."""
    return swept.where(F.col("rho") > rho_min).orderBy(F.desc("rho"), "ord")


def cross_map(df: DataFrame, combos: list[list[str]], target: str, lib=(), pred=(), tp: int = 1, tau: int = -1, radius: int = 0, e: int = 0, embedded: bool = True) -> DataFrame:
    """columns, target and rho of each column combination; empty ranges are all rows.

    Combinations that differ in their first column alone are one sweep.
    """
    if not embedded and e < 1:
        raise ValueError("combinations are either embedded or need e of 1 at least")
    n = df.count() if not (lib and pred) else 0
    lib, pred = lib or ((1, n),), pred or ((1, n),)
    out = None
    groups: dict[tuple[str, ...], list[str]] = {}
    for c in combos:
        groups.setdefault(tuple(c[1:]), []).append(c[0])
    for rest, firsts in groups.items():
        if embedded or e == 1:
            found = sweep(df, list(rest), list(dict.fromkeys(firsts)), target, lib, pred, tp, radius)
            rows = found.select(F.array(F.col("variable"), *[F.lit(c) for c in rest]).alias("columns"), "rho")
        else:
            rows = None
            for first in firsts:
                one = skill(simplex(df, [first, *rest], target, lib, pred, tp, radius, e, tau)).select(F.array(*[F.lit(c) for c in (first, *rest)]).alias("columns"), "rho")
                rows = one if rows is None else rows.unionByName(one)
        rows = rows.select("columns", F.lit(target).alias("target"), "rho")
        out = rows if out is None else out.unionByName(rows)
    return out
