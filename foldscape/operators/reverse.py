"""Driver graph: from a target back through the observables that forecast it, breadth first."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from foldscape.config import ExpandConfig
from foldscape.operators.expand import ExpandResult, expand
from foldscape.operators.panel import ROW, matching, variables

log = logging.getLogger("foldscape")

NODES = "target string, depth int, parent string, visit_order int"
EDGES = "target string, driver string, rank int, rho double"


@dataclass
class DriverGraph:
    """Nodes in the order of their visits, edges in the order of selection, and each target's own result."""

    spark: SparkSession
    visited: list[tuple] = field(default_factory=list)
    links: list[tuple] = field(default_factory=list)
    results: dict[str, ExpandResult | None] = field(default_factory=dict)

    @property
    def order(self) -> list[str]:
        return [v[0] for v in self.visited]

    @property
    def nodes(self) -> DataFrame:
        return self.spark.createDataFrame(self.visited, NODES)

    @property
    def edges(self) -> DataFrame:
        return self.spark.createDataFrame(self.links, EDGES)


def child_config(base: ExpandConfig, target: str) -> ExpandConfig:
    """For a driver's own run: it is the target, isn't a candidate, and writes nothing. Its parent stays a candidate."""
    return replace(base, target=target, exclude=tuple(dict.fromkeys([*base.exclude, target])), plot=False, out_csv=None, out_tables=None)


def seeded(seed) -> list[tuple[str, float | None]]:
    """(driver, rho) of a given root: a DataFrame with `variable` or `variables`, or a list of names."""
    if isinstance(seed, DataFrame):
        name = "variables" if "variables" in seed.columns else "variable"
        rho = "rho" if "rho" in seed.columns else None
        order = ["dim"] if "dim" in seed.columns else []
        return [(r[name], r[rho] if rho else None) for r in (seed.orderBy(*order) if order else seed).collect()]
    return [(str(s), None) for s in seed]


def run_ceiling(done: int, queued: int, names: int, depth_left: int | None, branch: int) -> int:
    """How many runs there can be at most: those done and queued with all that may still hang below them."""
    if depth_left is None:
        return names
    below, level = 0, queued
    for _ in range(max(0, depth_left)):
        level = min(names, level * branch)
        below += level
    return min(names, done + queued + below)


def driver_graph(
    df: DataFrame, target: str | None = None, *, config: ExpandConfig | None = None, slopes: DataFrame | None = None, seed=None,
    max_depth: int | None = None, log_every: int = 1, log_percent: float = 0, quiet: bool = False,
    checkpoint: Callable[[DriverGraph], None] | None = None, checkpoint_minutes: float = 0,
    run: Callable[[ExpandConfig], ExpandResult] | None = None,
) -> DriverGraph:
    """Expand the target, then each of its drivers, and theirs, until max_depth; every observable once.

    Levels are worked through whole: a queue in order of arrival visits the same
    nodes in the same order, at the same depths. `seed` stands for the root's own
    run. `checkpoint` is called after a level once checkpoint_minutes have passed.
    """
    cfg = config or ExpandConfig()
    cfg = (replace(cfg, target=target) if target else cfg).needs_target()
    if cfg.match:
        keep = matching(variables(df, cfg.time_col), cfg.match, cfg.target)
        df = df.select(*[c for c in (ROW, cfg.time_col) if c in df.columns], *keep)
    names = variables(df, cfg.time_col)
    panel = None
    if run is None:
        panel = df.persist()
        cfg = cfg.split(panel.count())
        run = lambda c: expand(panel, config=c, slopes=slopes)
    graph = DriverGraph(df.sparkSession)
    level, depth, seen, since = [(cfg.target, None)], 0, {cfg.target}, time.monotonic()
    began = since
    every = max(1, round(len(names) * log_percent / 100)) if log_percent else max(1, log_every)
    while level:
        following = []
        for name, parent in level:
            graph.visited.append((name, depth, parent, len(graph.visited)))
            if seed is not None and depth == 0:
                drivers, graph.results[name] = seeded(seed), None
            else:
                result = run(cfg if depth == 0 else child_config(cfg, name))
                drivers, graph.results[name] = [(r[1], r[2]) for r in result.rows], result
            graph.links += [(name, d, i, rho) for i, (d, rho) in enumerate(drivers, 1)]
            for d, _ in drivers:
                if d not in seen and (max_depth is None or depth < max_depth):
                    seen.add(d)
                    following.append((d, name))
            done = len(graph.visited)
            if not quiet and (done == 1 or done % every == 0):
                left = None if max_depth is None else max_depth - depth
                most = run_ceiling(done, len(level) + len(following), len(names), left, cfg.max_dim)
                each = (time.monotonic() - began) / done
                log.info("%d of at most %d runs: %s at depth %d; %.1f s a run, %.0f s left at most", done, most, name, depth, each, each * (most - done))
        if checkpoint and time.monotonic() - since >= 60 * checkpoint_minutes:
            checkpoint(graph)
            since = time.monotonic()
        level, depth = following, depth + 1
    if panel is not None:
        panel.unpersist()
    if not quiet:
        log.info("%d runs", len(graph.visited))
    if checkpoint:
        checkpoint(graph)
    return graph
