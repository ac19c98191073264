"""Command line: expand, crossmap, reverse and evaluate. Flags are never abbreviated."""

from __future__ import annotations

import argparse
import os
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscape.config import ExpandConfig, as_ranges, resolve
from foldscape.operators.crossmap import cross_map
from foldscape.operators.evaluate import compare, forecasts
from foldscape.operators.expand import expand
from foldscape.operators.panel import choose, variables
from foldscape.operators.reverse import driver_graph
from foldscape.sources import readers, sinks

#: Config field: flags, and what argparse needs to know.
COMMON = {
    "path": (["-d", "--data"], {}),
    "slope_path": (["-smf", "--slopes"], {}),
    "member": (["-dN", "--member"], {}),
    "remove_first": (["-rT", "--remove-first"], {"action": "store_true", "default": None}),
    "time_col": (["-tc", "--time-col"], {}),
    "match": (["-cn", "--match"], {"nargs": "+"}),
    "leading_names": (["-di", "--leading-names"], {"nargs": "+"}),
    "exclude": (["-rc", "--exclude"], {"nargs": "+"}),
    "max_dim": (["-D", "--max-dim"], {"type": int}),
    "target": (["-t", "--target"], {}),
    "lib": (["-l", "--lib"], {"nargs": "+", "type": int}),
    "pred": (["-p", "--pred"], {"nargs": "+", "type": int}),
    "tp": (["-T", "--tp"], {"type": int}),
    "tau": (["-tau", "--tau"], {"type": int}),
    "exclusion_radius": (["-xr", "--exclusion-radius"], {"type": int}),
    "sample": (["-s", "--sample"], {"type": int}),
    "lib_sizes": (["-ls", "--lib-sizes"], {"nargs": "+", "type": int}),
    "lib_percents": (["-L", "--lib-percents"], {"nargs": "+", "type": float}),
    "gate": (["-nC", "--no-gate"], {"action": "store_false", "default": None}),
    "slope_min": (["-ccs", "--slope-min"], {"type": float}),
    "seed": (["-seed", "--seed"], {"type": int}),
    "slope_orientation": (["-so", "--slope-orientation"], {}),
    "e": (["-E", "--embedding"], {"type": int}),
    "rho_min": (["-cmin", "--rho-min"], {"type": float}),
    "embed_rho_min": (["-emin", "--embed-rho-min"], {"type": float}),
    "max_e": (["-mE", "--max-e"], {"type": int}),
    "first_peak": (["-fE", "--first-peak"], {"action": "store_true", "default": None}),
    "time_delay": (["-tD", "--time-delay"], {"type": int}),
    "keep_ranked": (["-mrd", "--keep-ranked"], {"type": int}),
    "keep_passing": (["-mrc", "--keep-passing"], {"type": int}),
    "out_dir": (["-od", "--out-dir"], {}),
    "out_tables": (["-o", "--out-tables"], {}),
    "out_csv": (["-oc", "--out-csv"], {}),
    "log_file": (["-lf", "--log-file"], {}),
    "console": (["-n", "--no-console"], {"action": "store_false", "default": None}),
    "verbose": (["-v", "--verbose"], {"action": "store_true", "default": None}),
    "debug": (["-g", "--debug"], {"action": "store_true", "default": None}),
    "plot": (["-P", "--plot"], {"action": "store_true", "default": None}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foldscape", allow_abbrev=False)
    sub = top.add_subparsers(dest="command", required=True)
    commands = {n: sub.add_parser(n, allow_abbrev=False) for n in ("expand", "reverse", "crossmap", "evaluate")}
    for name in ("expand", "reverse"):
        for field, (flags, how) in COMMON.items():
            commands[name].add_argument(*flags, dest=field, **how)
    for field in ("log_percent",):
        commands["expand"].add_argument("-lp", "--log-percent", dest=field, type=float)
    r = commands["reverse"]
    r.add_argument("-md", "--max-depth", type=int)
    r.add_argument("-mo", "--root-result", help="an earlier result that stands for the root's run")
    r.add_argument("-rv", "--root-variables", nargs="+")
    r.add_argument("-pg", "--progress", action="store_true")
    r.add_argument("-le", "--log-every", type=int, default=1)
    r.add_argument("-lp", "--log-every-percent", type=float, default=0)
    r.add_argument("-qc", "--quiet-children", action="store_true")
    r.add_argument("-fi", "--file-interval", type=float, default=0, help="minutes between checkpoints")
    c = commands["crossmap"]
    for field in ("path", "target", "lib", "pred", "tp", "tau", "exclusion_radius", "e", "member", "out_csv"):
        flags, how = COMMON[field]
        c.add_argument(*flags, dest=field, **how)
    c.add_argument("-c", "--columns", nargs="+", required=True)
    c.add_argument("-em", "--embedded", action="store_true")
    v = commands["evaluate"]
    for field in ("path", "target", "lib", "pred", "tp", "tau", "exclusion_radius", "e", "member", "leading_names", "exclude", "remove_first", "out_csv", "plot"):
        flags, how = COMMON[field]
        v.add_argument(*flags, dest=field, **how)
    v.add_argument("-c", "--columns", nargs="+", required=True)
    v.add_argument("-cr", "--columns-range", nargs=2, type=int)
    v.add_argument("-ic", "--column-positions", nargs="+", type=int)
    v.add_argument("-cm", "--column-match", nargs="+")
    v.add_argument("-nc", "--components", type=int, default=5)
    v.add_argument("-k", "--neighbors", type=int, default=15)
    v.add_argument("-eps", "--epsilon", default="bgh")
    v.add_argument("-a", "--alpha", type=float, default=0.5)
    v.add_argument("-mm", "--min-max", action="store_true")
    v.add_argument("-pr", "--plot-rho", action="store_true")
    v.add_argument("-fs", "--figure-size", nargs=2, type=float)
    v.add_argument("-xl", "--x-limits", nargs=2, type=float)
    return top


def _session() -> SparkSession:
    return SparkSession.builder.appName("foldscape").getOrCreate()


def _panel(spark: SparkSession, cfg: ExpandConfig) -> DataFrame:
    return readers.read_panel(spark, cfg.path, member=cfg.member, leading=cfg.leading_names, match=cfg.match, target=cfg.target, remove_first=cfg.remove_first)


def _known(args: argparse.Namespace) -> dict:
    names = {f.name for f in fields(ExpandConfig)}
    return {k: v for k, v in vars(args).items() if k in names and v is not None}


def _file(cfg: ExpandConfig, name: str) -> str:
    return os.path.join(sinks.out_dir(cfg.out_dir), name)


def main(argv: list[str] | None = None) -> DataFrame:
    args = parser().parse_args(argv)
    cfg = resolve(args=_known(args))
    log = sinks.log_to(cfg.console, cfg.log_file, cfg.verbose)
    spark = _session()
    slopes = readers.read_slopes(spark, cfg.slope_path) if cfg.slope_path and cfg.gate else None
    if args.command == "expand":
        result = expand(_panel(spark, cfg), config=cfg, slopes=slopes)
        if cfg.out_csv:
            sinks.write_csv(result.selected, _file(cfg, cfg.out_csv))
        if cfg.out_tables:
            sinks.write_result(result, _file(cfg, cfg.out_tables))
        if cfg.plot:
            sinks.plot_result(result.selected, cfg.target, _file(cfg, f"{cfg.target}.png"))
        out = result.selected
    elif args.command == "reverse":
        seed = args.root_variables or (readers.read_root(spark, args.root_result) if args.root_result else None)
        path = _file(cfg, cfg.out_tables) if cfg.out_tables else None
        graph = driver_graph(
            _panel(spark, replace(cfg, match=())), config=cfg, slopes=slopes, seed=seed, max_depth=args.max_depth, log_every=args.log_every,
            log_percent=args.log_every_percent, quiet=args.quiet_children or not args.progress,
            checkpoint=(lambda g: sinks.write_graph(g, path)) if path else None, checkpoint_minutes=args.file_interval,
        )
        if cfg.out_csv:
            sinks.write_target_csvs(graph, _file(cfg, os.path.splitext(cfg.out_csv)[0]))
        out = graph.edges
    elif args.command == "crossmap":
        out = cross_map(_panel(spark, cfg), [args.columns], cfg.target, cfg.lib, cfg.pred, cfg.tp, cfg.tau, cfg.exclusion_radius, cfg.e, args.embedded)
        if cfg.out_csv:
            out.select(F.concat_ws(" ", "columns").alias("columns"), "target", "rho").toPandas().to_csv(cfg.out_csv, index=False)
    else:
        df = _panel(spark, cfg)
        features = choose([c for c in variables(df) if c != cfg.target], args.columns_range, args.column_positions, args.column_match)
        epsilon = args.epsilon if args.epsilon in ("bgh", "bgh_generous") else float(args.epsilon)
        how = {
            "features": features, "exclude": cfg.exclude, "lib": as_ranges(cfg.lib), "pred": as_ranges(cfg.pred), "tp": cfg.tp, "e": cfg.e, "tau": cfg.tau,
            "radius": cfg.exclusion_radius, "components": args.components, "k": args.neighbors, "epsilon": epsilon, "alpha": args.alpha,
        }
        out = compare(df, cfg.target, args.columns, **how)
        if cfg.out_csv:
            out.toPandas().to_csv(cfg.out_csv, index=False)
        if cfg.plot:
            shown = forecasts(df, cfg.target, args.columns, **how)
            sinks.plot_forecasts(shown, out, "rho" if args.plot_rho else "cae", _file(cfg, "evaluate.png"), args.min_max, args.figure_size, args.x_limits)
    for row in out.collect():
        log.info("%s", row.asDict())
    return out
