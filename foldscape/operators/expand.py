"""Greedy expansion: add the observable that forecasts best with those chosen so far, one dimension at a time."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscape.config import ExpandConfig
from foldscape.functions.stats import pearson
from foldscape.operators import causality, embedding
from foldscape.operators.crossmap import Carried, sweep
from foldscape.operators.neighbors import RELATIONAL_PAIRS
from foldscape.operators.panel import candidates, lags, numeric, variables
from foldscape.operators.simplex import simplex
from foldscape.plans.cost import strategy

log = logging.getLogger("foldscape")

SELECTED = "dim int, variable string, rho double"
RANKED = "dim int, rank int, variable string, rho double"
PASSING = "dim int, rank int, variable string, rho double, slope double"
EDIM = "variable string, target string, e int, rho double, accepted boolean"


@dataclass
class ExpandResult:
    """Tables of an expansion; each has a few rows a candidate and dimension."""

    spark: SparkSession
    config: ExpandConfig
    target: str
    rows: list[tuple] = field(default_factory=list)
    ranked: list[tuple] = field(default_factory=list)
    passed: list[tuple] = field(default_factory=list)
    edims: dict[str, tuple] = field(default_factory=dict)
    delays: list[tuple] = field(default_factory=list)

    @property
    def variables(self) -> list[str]:
        return [r[1] for r in self.rows]

    @property
    def selected(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SELECTED)

    @property
    def rankings(self) -> DataFrame:
        return self.spark.createDataFrame(self.ranked, RANKED)

    @property
    def passing(self) -> DataFrame:
        """With a slope matrix: all candidates whose slope passes, by dimension."""
        return self.spark.createDataFrame(self.passed, PASSING)

    @property
    def edim(self) -> DataFrame:
        """Embedding dimensions of candidates that the gate looked at."""
        return self.spark.createDataFrame(list(self.edims.values()), EDIM)

    @property
    def time_delays(self) -> DataFrame:
        return self.spark.createDataFrame(self.delays, "eval_column string, delays int, rho double")

    def best_dimension(self) -> int | None:
        """The first dimension of the largest rho, compared at 4 decimals."""
        return min(self.rows, key=lambda r: (-round(r[2], 4), r[0]))[0] if self.rows else None


#: Candidates that the gate looks at in one job, whether or not the first of them passes.
GATE_BATCH = 4


class Gate:
    """Decides whether a candidate is causally linked to the target; what it finds holds for all dimensions."""

    def __init__(self, panel: DataFrame, cfg: ExpandConfig, n: int, slopes: dict[str, float | None] | None, result: ExpandResult):
        self.panel, self.cfg, self.n, self.slopes, self.result = panel, cfg, n, slopes, result
        self.sizes = cfg.sizes(n) if cfg.gate and slopes is None else ()
        self.dims: dict[str, tuple[int, float]] = {}
        self.found: dict[str, float] = {}

    def dimension(self, name: str, rho: float) -> tuple[int, float]:
        # a given dimension is judged by the sweep's own skill, which changes with the dimension
        return (self.cfg.e, round(rho, 4)) if self.cfg.e > 0 else self.dims[name]

    def measure(self, ranked: list[tuple[str, float]]) -> None:
        """Embedding dimensions of candidates in one job, and slopes of those that have the skill in another."""
        cfg = self.cfg
        fresh = [v for v, _ in ranked if v not in self.dims] if cfg.e <= 0 else []
        every = None
        for name in fresh:
            curve = embedding.embed_dimension(self.panel, name, cfg.target, cfg.lib, cfg.pred, cfg.max_e, cfg.tp, cfg.tau, cfg.exclusion_radius, cfg.lib_tail)
            one = (embedding.first_peak if cfg.first_peak else embedding.best_e)(curve).select(F.lit(name).alias("variable"), "e", "rho")
            every = one if every is None else every.unionByName(one)
        if every is not None:
            rows = {r["variable"]: r for r in every.collect()}
            for name in fresh:
                row = rows.get(name)
                self.dims[name] = (row["e"], round(row["rho"], 4)) if row is not None and row["rho"] is not None else (1, float("-inf"))
        skilled = {v: self.dimension(v, rho)[0] for v, rho in ranked if v not in self.found and self.dimension(v, rho)[1] >= cfg.embed_rho_min}
        self.found |= causality.slopes_of(self.panel, cfg.target, skilled, self.sizes, self.n, sample=cfg.sample, seed=cfg.seed, tau=cfg.tau, tp=cfg.tp, radius=cfg.exclusion_radius)

    def passes(self, name: str, rho: float) -> bool:
        cfg = self.cfg
        if self.slopes is not None:
            value = self.slopes.get(name)
            return value is not None and value > cfg.slope_min
        e, rho_e = self.dimension(name, rho)
        if rho_e < cfg.embed_rho_min:
            return False
        ok = self.found[name] > cfg.slope_min
        self.result.edims[name] = (name, cfg.target, e, rho_e, ok)
        return ok

    def first(self, ranked: list[tuple[str, float]]) -> tuple[str, float] | None:
        """The first of ranked candidates that passes."""
        if not self.cfg.gate:
            return ranked[0]
        for a in range(0, len(ranked), GATE_BATCH):
            some = ranked[a : a + GATE_BATCH]
            if self.slopes is None:
                self.measure(some)
            for v, rho in some:
                if self.passes(v, rho):
                    return v, rho
        return None


def expand(df: DataFrame, target: str | None = None, *, config: ExpandConfig | None = None, slopes: DataFrame | None = None, plan: str | None = None) -> ExpandResult:
    """Select up to max_dim observables of a panel (row_id and numeric columns) for a target.

    slopes: (source, predicted, slope), which replaces the measured gate; it is
    ignored where the gate is off. A dimension is one Spark job over all candidates,
    of which the driver gets a row each.
    """
    from dataclasses import replace

    cfg = config or ExpandConfig()
    cfg = (replace(cfg, target=target) if target else cfg).needs_target()
    names = variables(df, cfg.time_col)
    if cfg.target not in names:
        raise ValueError(f"the panel has no numeric column {cfg.target}")
    panel = numeric(df, names).persist()
    n = panel.count()
    cfg = cfg.split(n)
    result = ExpandResult(df.sparkSession, cfg, cfg.target)
    lookup = None
    if slopes is not None and cfg.gate:
        table = causality.slope_table(slopes, cfg.slope_orientation)
        causality.check_slopes(table, candidates(names, cfg.exclude), cfg.target)
        lookup = {r["candidate"]: r["slope"] for r in table.where(F.col("target") == cfg.target).collect()}
    gate = Gate(panel, cfg, n, lookup, result)
    every = candidates(names, cfg.exclude)
    carried = None
    if every and (plan or strategy(len(every), cfg.lib, cfg.pred, RELATIONAL_PAIRS)) == "relational":
        carried = Carried(panel, every, cfg.target, cfg.lib, cfg.pred, cfg.tp, cfg.exclusion_radius, cfg.lib_tail)
    band = 0
    try:
        for dim in range(1, cfg.max_dim + 1):
            chosen = result.variables
            left = candidates(names, cfg.exclude, chosen)
            best = []
            if left:
                found = carried.sweep(chosen, left) if carried else sweep(panel, chosen, left, cfg.target, cfg.lib, cfg.pred, cfg.tp, cfg.exclusion_radius, cfg.lib_tail, plan)
                swept = found.collect()
                best = sorted(((r["rho"], r["ord"], r["variable"]) for r in swept if r["rho"] is not None and r["rho"] > cfg.rho_min), key=lambda r: (-r[0], r[1]))
            if not best:
                log.info("dimension %d: no candidate above %s", dim, cfg.rho_min)
                break
            result.ranked += [(dim, i, v, rho) for i, (rho, _, v) in enumerate(best, 1)]
            if lookup is not None:
                result.passed += [(dim, i, v, rho, lookup[v]) for i, (rho, _, v) in enumerate(best, 1) if lookup[v] is not None and lookup[v] > cfg.slope_min]
            winner = gate.first([(v, rho) for rho, _, v in best])
            if winner is None:
                log.info("dimension %d: no candidate passes the gate", dim)
                break
            if cfg.stop_on_decline and result.rows and winner[1] <= result.rows[-1][2]:
                break
            result.rows.append((dim, *winner))
            log.info("dimension %d: %s %.6f", dim, *winner)
            if cfg.log_percent and int(100 * dim / cfg.max_dim / cfg.log_percent) > band:
                band = int(100 * dim / cfg.max_dim / cfg.log_percent)
                log.info("%d %% of at most %d dimensions", 100 * dim // cfg.max_dim, cfg.max_dim)
        if cfg.time_delay and result.rows:
            result.delays = time_delays(panel, cfg, result)
    finally:
        panel.unpersist()
        if carried:
            carried.release()
    return result


def time_delays(panel: DataFrame, cfg: ExpandConfig, result: ExpandResult) -> list[tuple]:
    """Skill of the best dimension's columns with delays of the target, and of each of those columns, added."""
    best = result.variables[: result.best_dimension()]
    out = []
    for column in dict.fromkeys([cfg.target, *best]):
        extra = [f"{column}(t-{k})" for k in range(1, cfg.time_delay + 1)]
        wide = panel.join(lags(panel, [column], cfg.time_delay + 1, cfg.tau).select("row_id", *[f"`{c}`" for c in extra]), "row_id")
        forecast = simplex(wide, [*best, *extra], cfg.target, cfg.lib, cfg.pred, cfg.tp, cfg.exclusion_radius, tail=cfg.lib_tail)
        out.append((column, cfg.time_delay, forecast.agg(pearson(F.col("obs"), F.col("pred")).alias("rho")).first()["rho"]))
    return out
