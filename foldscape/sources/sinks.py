"""Where results go: CSV, Parquet tables with a config beside them, checkpoints, logs and plots."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldscape.config import ExpandConfig
from foldscape.functions.stats import minmax
from foldscape.operators.expand import ExpandResult
from foldscape.operators.reverse import DriverGraph


def out_dir(path: str) -> str:
    """The folder, made if its parent is there."""
    if not os.path.isdir(path):
        os.mkdir(path)
    return path


def put(spark, path: str, data: bytes) -> str:
    """A file of a few bytes on any file system that Spark writes to; it replaces another whole. Paths without a scheme are relative to this process."""
    path = path if "://" in path else os.path.abspath(path)
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    to, draft = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    own = to.getFileSystem(conf)
    out = own.create(draft, True)
    out.write(bytearray(data))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(own.getUri(), conf).rename(own.makeQualified(draft), own.makeQualified(to), how)
    return path


def write_csv(selected: DataFrame, path: str) -> None:
    """variables and rho in the order of selection, as one file: a result has a row a dimension."""
    import csv
    import io

    text = io.StringIO(newline="")
    out = csv.writer(text)
    out.writerow(["variables", "rho"])
    out.writerows((r["variable"], r["rho"]) for r in selected.orderBy("dim").collect())
    put(selected.sparkSession, path, text.getvalue().encode())


def truncated(ranked: DataFrame, n: int | None) -> DataFrame:
    """The n best of each dimension; all by default."""
    if n is None:
        return ranked
    own = Window.partitionBy("dim").orderBy(F.desc("rho"), "rank")
    return ranked.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= n).drop("_n")


def write_result(result: ExpandResult, path: str) -> None:
    """All tables of a run as Parquet and its config as JSON, below a folder; rankings cut as the config says."""
    cfg = result.config
    for name, table in (
        ("selected", result.selected), ("rankings", truncated(result.rankings, cfg.keep_ranked)), ("passing", truncated(result.passing, cfg.keep_passing)),
        ("edim", result.edim), ("time_delays", result.time_delays),
    ):
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    _write_config(result.spark, cfg, f"{path}/config")


def _write_config(spark, cfg: ExpandConfig, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(cfg)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_result(spark, path: str) -> tuple[ExpandConfig, dict[str, DataFrame]]:
    cfg = ExpandConfig(**json.loads(spark.read.text(f"{path}/config").first()[0]))
    return cfg, {n: spark.read.parquet(f"{path}/{n}") for n in ("selected", "rankings", "passing", "edim", "time_delays")}


def write_graph(graph: DriverGraph, path: str) -> str:
    """Nodes and edges (by target) as a new version below `path`, on any file system. Spark marks the edges, written last, once they are whole."""
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    graph.nodes.coalesce(1).write.parquet(f"{path}/{version}/nodes")
    graph.edges.coalesce(1).write.partitionBy("target").parquet(f"{path}/{version}/edges")
    return version


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The last version that is whole."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName() for s in fs.listStatus(to(path))), reverse=True)
    version = next((v for v in found if v.startswith("v-") and fs.exists(to(f"{path}/{v}/edges/_SUCCESS"))), None)
    if version is None:
        raise ValueError(f"no whole graph below {path}")
    return spark.read.parquet(f"{path}/{version}/nodes"), spark.read.parquet(f"{path}/{version}/edges")


def write_target_csvs(graph: DriverGraph, stem: str) -> list[str]:
    """`stem_target.csv` for each target, in the order of visits."""
    out = []
    for name in graph.order:
        rows = [(i, d, rho) for t, d, i, rho in graph.links if t == name]
        path = f"{stem}_{name}.csv"
        write_csv(graph.spark.createDataFrame(rows, "dim int, variable string, rho double"), path)
        out.append(path)
    return out


def log_to(console: bool = True, path: str | None = None, verbose: bool = False) -> logging.Logger:
    """The library's logger, to the console, to the end of a file, or both."""
    log = logging.getLogger("foldscape")
    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    for h in list(log.handlers):
        log.removeHandler(h)
    for h in ([logging.StreamHandler()] if console else []) + ([logging.FileHandler(path)] if path else []):
        h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(h)
    return log


def plot_result(selected: DataFrame, title: str = "", path: str | None = None):
    """Skill by dimension, with the variables beside it."""
    import matplotlib.pyplot as plt

    rows = selected.orderBy("dim").toPandas()
    figure, axis = plt.subplots()
    axis.plot(rows["dim"], rows["rho"], marker="o")
    for r in rows.itertuples():
        axis.annotate(r.variable, (r.dim, r.rho))
    axis.set(xlabel="dimension", ylabel="rho", title=title)
    if path:
        figure.savefig(path)
    return figure


def plot_data(forecasts: dict[str, DataFrame], scale: bool = False) -> DataFrame:
    """method, row_id, obs and pred: the panels of an evaluation's plot, each series on [0, 1] if scaled."""
    out = None
    for method, f in forecasts.items():
        one = (minmax(f, ["obs", "pred"]) if scale else f).select(F.lit(method).alias("method"), "row_id", "obs", "pred")
        out = one if out is None else out.unionByName(one)
    return out


def plot_forecasts(forecasts: dict[str, DataFrame], report: DataFrame, label: str = "cae", path: str | None = None, scale: bool = False, figsize=None, xlim=None):
    """Observations, and a panel for each method that is labelled by its cae or rho."""
    import matplotlib.pyplot as plt

    scores = {r["method"]: r[label] for r in report.collect()}
    every = plot_data(forecasts, scale).orderBy("row_id").toPandas()
    figure, axes = plt.subplots(len(forecasts) + 1, 1, sharex=True, figsize=figsize)
    for i, method in enumerate(forecasts):
        rows = every[every["method"] == method]
        if not i:
            axes[0].plot(rows["row_id"], rows["obs"])
            axes[0].set_title("observations")
        axes[i + 1].plot(rows["row_id"], rows["pred"])
        axes[i + 1].set_title(f"{method}: {label} {scores[method]}")
    if xlim:
        axes[-1].set_xlim(*xlim)
    if path:
        figure.savefig(path)
    return figure
