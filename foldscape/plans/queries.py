"""Queries of the engine on the test tables: one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscape.config import ExpandConfig, default_split
from foldscape.functions.stats import metrics, minmax, ols, ranges, reported, top, weight
from foldscape.operators import causality, crossmap, embedding, evaluate, neighbors, panel, reverse, simplex
from foldscape.operators.expand import expand
from foldscape.plans.fixtures import OTHERS, TARGET, WEEKLY, panel_embedding, panel_hourly, panel_smooth, panel_weekly
from foldscape.sources.readers import as_panel, matrix_to_slopes, read_panel, read_root, read_slopes, slopes_to_matrix
from foldscape.sources.sinks import put, read_graph, read_result, truncated, write_csv, write_graph, write_result, write_target_csvs

Query = DataFrame


def _smooth(spark: SparkSession, sf_dir: str):
    df = panel_smooth(spark, sf_dir).persist()
    lib, pred = default_split(df.count())
    return df, lib, pred


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles at 6 decimals: sums differ in their last digits by the order of rows."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def panel_long(spark, sf_dir):
    return panel.long_form(panel_smooth(spark, sf_dir), WEEKLY)


def numeric_cast(spark, sf_dir):
    return panel.numeric(panel_weekly(spark, sf_dir).withColumn("n_orders", F.col("n_orders").cast("int")), ["n_orders", "qty"])


def in_memory_panel(spark, sf_dir):
    return as_panel(panel_weekly(spark, sf_dir).drop("row_id"), order="w", match=["n_", "rev"], target="ext")


def column_match(spark, sf_dir):
    df = panel_weekly(spark, sf_dir)
    return df.select("row_id", *panel.matching(WEEKLY, ["n_", "cust"], TARGET))


def column_choice(spark, sf_dir):
    df = panel_weekly(spark, sf_dir)
    return df.select("row_id", *panel.choose(WEEKLY, span=(1, 3)), *panel.choose(WEEKLY, positions=[5]))


def dropped_columns(spark, sf_dir):
    return panel.drop_leading(panel_weekly(spark, sf_dir), remove_first=True, implicit_time=True)


def candidate_set(spark, sf_dir):
    df = panel_weekly(spark, sf_dir)
    names = panel.candidates(panel.variables(df), ["qty"], ["n_cust"])
    return spark.createDataFrame(list(enumerate(names)), "ord int, variable string")


def lag_embed(spark, sf_dir):
    df = panel.lags(panel_smooth(spark, sf_dir), ["revenue"], 3, -2)
    return df.select("row_id", *[F.col(f"`revenue(t-{k})`").alias(f"lag{k}") for k in range(3)])


def lead_target(spark, sf_dir):
    df = panel_smooth(spark, sf_dir)
    return df.select("row_id", "revenue").join(panel.lead(df, "revenue", 3, "later"), "row_id", "left")


def with_delays(spark, sf_dir):
    df = panel.with_lags(panel_smooth(spark, sf_dir).select("row_id", "qty", "ext"), ["qty"], 2)
    return df.select("row_id", "qty", "ext", F.col("`qty(t-1)`").alias("qty_1"), F.col("`qty(t-2)`").alias("qty_2"))


def lib_pred_split(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return df.select("row_id", ranges(F.col("row_id"), lib).alias("in_lib"), ranges(F.col("row_id"), pred).alias("in_pred"))


def library_rows(spark, sf_dir):
    df, lib, _ = _smooth(spark, sf_dir)
    keep = neighbors.library(df, TARGET, lib, 2).select("row_id", F.col("_y").alias("y"))
    trim = neighbors.library(df, TARGET, lib, 2, "trim").select("row_id", F.lit(True).alias("trimmed"))
    return keep.join(trim, "row_id", "left").select("row_id", "y", F.coalesce("trimmed", F.lit(False)).alias("trimmed"))


def row_ranges(spark, sf_dir):
    df = panel_smooth(spark, sf_dir)
    return df.where(ranges(F.col("row_id"), ((1, 10), (51, 60), (100, 100)))).select("row_id", "revenue")


def ccm_sizes(spark, sf_dir):
    n = panel_smooth(spark, sf_dir).count()
    return spark.createDataFrame([(i, s) for i, s in enumerate(ExpandConfig().sizes(n))], "ord int, size int")


def knn_pairs(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return _rounded(neighbors.knn(df, ["n_orders", "n_lines"], TARGET, lib, pred).select("p", "l", "rank", "d"), "d")


def knn_excluded(spark, sf_dir):
    df, _, _ = _smooth(spark, sf_dir)
    n = df.count()
    return _rounded(neighbors.knn(df, ["n_cust"], TARGET, ((1, n),), ((1, n),), radius=4).select("p", "l", "rank", "d"), "d")


def neighbor_weights(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    near = neighbors.knn(df, ["n_orders", "n_lines"], TARGET, lib, pred)
    return _rounded(near.select("p", "l", weight(F.col("d"), F.col("d_min")).alias("w")), "w")


def simplex_predict(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    out = simplex.simplex(df, ["n_orders", "n_cust"], TARGET, lib, pred)
    return _rounded(out, "pred").withColumn("pred_var", F.round("pred_var"))  # of the order of 1e11


def simplex_embedded(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return _rounded(simplex.simplex(df, ["n_orders"], TARGET, lib, pred, tp=2, e=3).select("row_id", "obs", "pred"), "pred")


def forecast_metrics(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return _rounded(simplex.skill(simplex.simplex(df, ["n_orders", "n_cust"], TARGET, lib, pred)), "rho", "mae", "rmse", "cae")


def reported_metrics(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return reported(simplex.simplex(df, ["n_orders", "n_cust"], TARGET, lib, pred).agg(*metrics()))


def cross_map_rank(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    ranked = crossmap.ranking(crossmap.sweep(df, [], OTHERS, TARGET, lib, pred), -1.0)
    return _rounded(ranked.select("variable", "rho"), "rho")


def cross_map_given(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    out = crossmap.cross_map(df, [["qty", "n_orders"], ["ext", "n_orders"], ["n_lines"]], TARGET, lib, pred)
    return _rounded(out.select(F.concat_ws(",", "columns").alias("columns"), "target", "rho"), "rho")


def cross_map_all_rows(spark, sf_dir):
    df, _, _ = _smooth(spark, sf_dir)
    out = crossmap.cross_map(df, [["n_orders"], ["qty"]], TARGET)
    return _rounded(out.select(F.concat_ws(",", "columns").alias("columns"), "rho"), "rho")


def cross_map_blocks(spark, sf_dir):
    """As cross_map_rank, by the vectorised strategy."""
    df, lib, pred = _smooth(spark, sf_dir)
    return _rounded(crossmap.sweep(df, [], OTHERS, TARGET, lib, pred, plan="vectorised").select("variable", "rho"), "rho")


def _selected(spark, sf_dir, **how):
    df = panel_smooth(spark, sf_dir)
    return expand(df, TARGET, config=ExpandConfig(target=TARGET, exclude=(TARGET,), **how))


def greedy_expand_2d(spark, sf_dir):
    return _rounded(_selected(spark, sf_dir, max_dim=2, gate=False, rho_min=-1.0).selected, "rho")


def greedy_rankings(spark, sf_dir):
    return _rounded(_selected(spark, sf_dir, max_dim=2, gate=False, rho_min=-1.0).rankings, "rho")


def top_ranked(spark, sf_dir):
    return _rounded(truncated(_selected(spark, sf_dir, max_dim=2, gate=False, rho_min=-1.0).rankings, 2), "rho")


def greedy_expand_gated(spark, sf_dir):
    found = _selected(spark, sf_dir, max_dim=2, rho_min=0.0, embed_rho_min=0.0, max_e=4, sample=5, lib_percents=(10, 30, 60, 90), slope_min=0.0).selected
    return _rounded(found, "rho")


def edim_map(spark, sf_dir):
    return _selected(spark, sf_dir, max_dim=1, rho_min=0.0, embed_rho_min=0.0, max_e=4, sample=3, lib_percents=(10, 30, 90), slope_min=0.0).edim


def best_dimension(spark, sf_dir):
    found = _selected(spark, sf_dir, max_dim=3, gate=False, rho_min=-1.0)
    return spark.createDataFrame([(found.best_dimension(),)], "dim int")


def time_delays(spark, sf_dir):
    return _rounded(_selected(spark, sf_dir, max_dim=1, gate=False, rho_min=-1.0, time_delay=2).time_delays, "rho")


def embed_dimension(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return _rounded(embedding.embed_dimension(df, "n_orders", TARGET, lib, pred, 4), "rho")


def best_e(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return _rounded(embedding.best_e(embedding.embed_dimension(df, "n_orders", TARGET, lib, pred, 4)), "rho")


def first_peak_e(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return _rounded(embedding.first_peak(embedding.embed_dimension(df, "n_orders", TARGET, lib, pred, 4)), "rho")


def _curve(spark, sf_dir, **how):
    df, _, _ = _smooth(spark, sf_dir)
    return df, causality.ccm_curve(df, TARGET, "n_orders", (20, 80, 160), sample=3, e=2, tp=1, **how)


def library_draws(spark, sf_dir):
    df, _, _ = _smooth(spark, sf_dir)
    return causality.draws(df, (20, 80), 2, 7)


def ccm_curve(spark, sf_dir):
    return _rounded(_curve(spark, sf_dir)[1], "rho")


def ccm_curve_blocks(spark, sf_dir):
    return _rounded(_curve(spark, sf_dir, plan="vectorised")[1], "rho")


def ccm_slope(spark, sf_dir):
    df, curve = _curve(spark, sf_dir)
    return causality.slope(curve, df.count())


#: A matrix that isn't symmetric and has no diagonal, by the places of two variables.
SLOPES = [(a, b, None if a == b else round(0.011 * i - 0.007 * j, 4)) for i, a in enumerate(WEEKLY) for j, b in enumerate(WEEKLY)]


def _slopes(spark):
    return spark.createDataFrame(SLOPES, "source string, predicted string, slope double")


def slope_matrix_lookup(spark, sf_dir):
    rows, columns = (causality.slope_table(_slopes(spark), o).where(F.col("target") == TARGET) for o in ("candidate_row", "candidate_column"))
    return rows.select("candidate", F.col("slope").alias("by_row")).join(columns.select("candidate", F.col("slope").alias("by_column")), "candidate")


def slope_matrix_wide(spark, sf_dir):
    return slopes_to_matrix(_slopes(spark), WEEKLY)


def slope_matrix_long(spark, sf_dir):
    wide = slopes_to_matrix(_slopes(spark), WEEKLY)
    place = F.array_position(F.array(*[F.lit(c) for c in WEEKLY]), F.col("source"))
    return matrix_to_slopes(wide.withColumn("row_id", place), WEEKLY)


def passing_subset(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    ranked = crossmap.ranking(crossmap.sweep(df, [], OTHERS, TARGET, lib, pred), -1.0)
    out = causality.passing(ranked, causality.slope_table(_slopes(spark)), TARGET, 0.01)
    return _rounded(out.select("variable", "rho", "slope"), "rho")


def expand_with_matrix(spark, sf_dir):
    df = panel_smooth(spark, sf_dir)
    cfg = ExpandConfig(target=TARGET, exclude=(TARGET,), max_dim=2, rho_min=-1.0)
    return _rounded(expand(df, config=cfg, slopes=_slopes(spark)).selected, "rho")


def _graph(spark, sf_dir):
    cfg = ExpandConfig(target=TARGET, exclude=(TARGET,), max_dim=1, gate=False, rho_min=-1.0)
    return reverse.driver_graph(panel_smooth(spark, sf_dir), config=cfg, max_depth=2, quiet=True)


def driver_graph(spark, sf_dir):
    return _rounded(_graph(spark, sf_dir).edges, "rho")


def driver_nodes(spark, sf_dir):
    return _graph(spark, sf_dir).nodes


def seeded_graph(spark, sf_dir):
    cfg = ExpandConfig(target=TARGET, exclude=(TARGET,), max_dim=1, gate=False, rho_min=-1.0)
    return reverse.driver_graph(panel_smooth(spark, sf_dir), config=cfg, seed=["qty", "ext"], max_depth=0, quiet=True).edges


def embedding_knn(spark, sf_dir):
    """Over all vectors, half of them as library."""
    df = panel_embedding(spark, sf_dir, 4)
    lib, pred = default_split(df.count())
    return _rounded(neighbors.knn(df, ["e0", "e1"], "e3", lib, pred).select("p", "l", "rank", "d"), "d")


def embedding_knn_blocks(spark, sf_dir):
    """As embedding_knn, by the vectorised strategy."""
    df = panel_embedding(spark, sf_dir, 4)
    lib, pred = default_split(df.count())
    return _rounded(neighbors.knn(df, ["e0", "e1"], "e3", lib, pred, plan="vectorised").select("p", "l", "rank", "d"), "d")


def embed_dimension_blocks(spark, sf_dir):
    """As embed_dimension, by the vectorised strategy."""
    df, lib, pred = _smooth(spark, sf_dir)
    return _rounded(embedding.embed_dimension(df, "n_orders", TARGET, lib, pred, 4, plan="vectorised"), "rho")


def embedding_crossmap(spark, sf_dir):
    """Six dimensions beside e1, over all vectors."""
    df = panel_embedding(spark, sf_dir, 8)
    lib, pred = default_split(df.count())
    return _rounded(crossmap.sweep(df, ["e1"], [f"e{i}" for i in range(2, 8)], "e0", lib, pred).select("variable", "rho"), "rho")


def embedding_wide(spark, sf_dir):
    """All 64 dimensions over all vectors: large enough for the vectorised strategy."""
    df = panel_embedding(spark, sf_dir)
    lib, pred = default_split(df.count())
    return _rounded(crossmap.sweep(df, [], [f"e{i}" for i in range(1, 64)], "e0", lib, pred, plan="vectorised").select("variable", "rho"), "rho")


def hourly_sweep(spark, sf_dir):
    """Candidates with nulls: rows without a value are nobody's neighbours."""
    df = panel_hourly(spark, sf_dir)
    lib, pred = default_split(df.count())
    out = crossmap.sweep(df, [], ["n_view", "v_view", "v_error"], "n_click", lib, pred, radius=2)
    return _rounded(out.select("variable", "rho"), "rho")


def minmax_scale(spark, sf_dir):
    df = panel_smooth(spark, sf_dir).withColumn("flat", F.lit(3.0))
    return _rounded(minmax(df, ["revenue", "qty", "flat"]).select("row_id", "revenue", "qty", "flat"), "revenue", "qty")


def ols_single(spark, sf_dir):
    df = panel_smooth(spark, sf_dir).withColumn("half", F.when(F.col("row_id") <= 172, "a").otherwise("b"))
    return _rounded(ols(df, ["half"], "revenue", "n_orders"), "slope", "intercept")


def linear_fit(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    out = evaluate.linear(df.where(ranges(F.col("row_id"), lib)), df.where(ranges(F.col("row_id"), pred)), ["n_orders"], TARGET)
    return out.select("row_id", "obs", F.round("pred", 4).alias("pred"))


def best_per_half(spark, sf_dir):
    df = panel_smooth(spark, sf_dir).withColumn("half", F.when(F.col("row_id") <= 172, "a").otherwise("b"))
    return top(df.select("half", "row_id", "revenue"), ["half"], [F.desc("revenue"), F.col("row_id")], 3)


def pca_evaluate(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    names = OTHERS[:4]
    a, b, _ = evaluate.pca_scores(df.where(ranges(F.col("row_id"), lib)), df.where(ranges(F.col("row_id"), pred)), names, 2)
    y = df.select("row_id", TARGET)
    return reported(evaluate.linear(a.join(y, "row_id"), b.join(y, "row_id"), ["c0", "c1"], TARGET).agg(*metrics()))


def diffusion_evaluate(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    scaled = minmax(df, WEEKLY)
    maps = evaluate.DiffusionMap(10, 2, 0.05).fit(scaled.where(ranges(F.col("row_id"), lib)), OTHERS[:4])
    return maps.coordinates(scaled.where(ranges(F.col("row_id"), pred)))


def evaluate_compare(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return evaluate.compare(df, TARGET, ["n_orders", "n_cust"], features=OTHERS, lib=lib, pred=pred, tp=1, components=2, k=10)


def evaluate_simplex(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return evaluate.compare(df, TARGET, ["n_orders", "n_cust"], methods=("simplex",), lib=lib, pred=pred, tp=1)


def evaluate_pca(spark, sf_dir):
    """One component of two features."""
    df, lib, pred = _smooth(spark, sf_dir)
    return evaluate.compare(df, TARGET, ["n_orders"], methods=("pca",), features=["n_orders", "n_lines"], lib=lib, pred=pred, components=1)


def evaluate_all_rows(spark, sf_dir):
    """Without ranges, all rows are library and predicted."""
    df, _, _ = _smooth(spark, sf_dir)
    return evaluate.compare(df, TARGET, ["n_orders", "n_cust"], methods=("simplex",), tp=1)


def evaluate_embedded(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    return evaluate.compare(df, TARGET, ["n_orders"], methods=("simplex",), lib=lib, pred=pred, tp=1, e=3)


def pca_explained(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    part = lambda spans: df.where(ranges(F.col("row_id"), spans))
    ratios = evaluate.pca_scores(part(lib), part(pred), ["n_orders", "n_lines"], 2)[2]
    return spark.createDataFrame([(i, round(r, 6)) for i, r in enumerate(ratios)], "component int, ratio double")


def diffusion_neighbors(spark, sf_dir):
    df, lib, pred = _smooth(spark, sf_dir)
    part = lambda spans: df.where(ranges(F.col("row_id"), spans))
    return _rounded(evaluate.neighbor_table(part(lib), part(pred), ["n_orders", "n_lines"], 5), "d2")


def _folder(spark) -> str:
    """A new folder where files of the queries below go: shared, if the cluster names a shared one."""
    import tempfile
    import uuid

    return f"{spark.conf.get('spark.checkpoint.dir', None) or f'file://{tempfile.gettempdir()}'}/foldscape-files-{uuid.uuid4().hex}"


def _rows_of(spark, sf_dir):
    """panel_weekly's numbers in order: a few hundred rows, as they are written to files by hand."""
    return panel_weekly(spark, sf_dir).orderBy("row_id").select(*WEEKLY).toPandas()


def csv_scan(spark, sf_dir):
    path = put(spark, f"{_folder(spark)}/panel.csv", _rows_of(spark, sf_dir).to_csv(index=False).encode())
    return read_panel(spark, path, match=["n_", "rev"], target="ext")


def _feather(frame, index: bool = False) -> bytes:
    import io

    import pyarrow as pa
    import pyarrow.feather

    out = io.BytesIO()
    pyarrow.feather.write_feather(pa.Table.from_pandas(frame, preserve_index=index), out)
    return out.getvalue()


def feather_scan(spark, sf_dir):
    return read_panel(spark, put(spark, f"{_folder(spark)}/panel.feather", _feather(_rows_of(spark, sf_dir))), remove_first=True)


def _numpy(save, *args, **kwargs) -> bytes:
    import io

    out = io.BytesIO()
    save(out, *args, **kwargs)
    return out.getvalue()


def npy_scan(spark, sf_dir):
    import numpy as np

    data = _numpy(np.save, _rows_of(spark, sf_dir).to_numpy())
    return read_panel(spark, put(spark, f"{_folder(spark)}/panel.npy", data), leading=["n_orders", "revenue"])


def npz_member(spark, sf_dir):
    import numpy as np

    rows = _rows_of(spark, sf_dir).to_numpy()
    data = _numpy(np.savez, other=rows[:3], panel=rows)
    return read_panel(spark, put(spark, f"{_folder(spark)}/panels.npz", data), member="panel", match=["c1", "c4"])


def _slope_frame():
    import pandas as pd

    wide = {b: [next(s for x, y, s in SLOPES if (x, y) == (a, b)) for a in WEEKLY] for b in WEEKLY}
    return pd.DataFrame(wide, index=WEEKLY, dtype=float)


def slope_csv(spark, sf_dir):
    return read_slopes(spark, put(spark, f"{_folder(spark)}/slopes.csv", _slope_frame().to_csv(index=False).encode()))


def slope_feather(spark, sf_dir):
    found = read_slopes(spark, put(spark, f"{_folder(spark)}/slopes.feather", _feather(_slope_frame(), index=True)))
    return found.select("source", "predicted", F.when(~F.isnan("slope"), F.col("slope")).alias("slope"))


def result_csv(spark, sf_dir):
    """A result as CSV, read again as the root of a driver graph."""
    path = f"{_folder(spark)}/result.csv"
    write_csv(_selected(spark, sf_dir, max_dim=2, gate=False, rho_min=-1.0).selected, path)
    found = reverse.seeded(read_root(spark, path))
    return _rounded(spark.createDataFrame([(i, v, r) for i, (v, r) in enumerate(found, 1)], "dim int, variable string, rho double"), "rho")


def result_tables(spark, sf_dir):
    """All tables of a run written and read again; rankings cut at two a dimension."""
    path = f"{_folder(spark)}/result"
    write_result(_selected(spark, sf_dir, max_dim=2, gate=False, rho_min=-1.0, keep_ranked=2), path)
    return _rounded(read_result(spark, path)[1]["rankings"], "rho")


def graph_tables(spark, sf_dir):
    path = f"{_folder(spark)}/graph"
    write_graph(_graph(spark, sf_dir), path)
    return _rounded(read_graph(spark, path)[1], "rho").select("target", "driver", "rank", "rho")


def target_csvs(spark, sf_dir):
    """One CSV a target of a driver graph, read again."""
    paths = write_target_csvs(_graph(spark, sf_dir), f"{_folder(spark)}/drivers")
    out = None
    for path in paths:
        name = path.rsplit("drivers_", 1)[1][:-4]
        one = read_root(spark, path).select(F.lit(name).alias("target"), F.col("variables").alias("driver"), F.round(F.col("rho").cast("double"), 6).alias("rho"))
        out = one if out is None else out.unionByName(one)
    return out


def _all() -> dict:
    own = [
        panel_long, numeric_cast, in_memory_panel, column_match, column_choice, dropped_columns, candidate_set, lag_embed, lead_target, with_delays, lib_pred_split,
        library_rows, row_ranges, ccm_sizes, knn_pairs, knn_excluded, neighbor_weights, simplex_predict, simplex_embedded, forecast_metrics, reported_metrics,
        cross_map_rank, cross_map_given, cross_map_all_rows, cross_map_blocks, greedy_expand_2d, greedy_rankings, top_ranked, greedy_expand_gated, edim_map,
        best_dimension, time_delays, embed_dimension, best_e, first_peak_e, library_draws, ccm_curve, ccm_curve_blocks, ccm_slope, slope_matrix_lookup,
        slope_matrix_wide, slope_matrix_long, passing_subset, expand_with_matrix, driver_graph, driver_nodes, seeded_graph, embedding_knn, embedding_crossmap,
        embedding_wide, hourly_sweep, minmax_scale, ols_single, linear_fit, best_per_half, pca_evaluate, diffusion_evaluate, evaluate_compare,
        evaluate_simplex, evaluate_pca, embedding_knn_blocks, embed_dimension_blocks,
        evaluate_all_rows, evaluate_embedded, pca_explained, diffusion_neighbors, csv_scan, feather_scan, npy_scan, npz_member, slope_csv, slope_feather,
        result_csv, result_tables, graph_tables, target_csvs,
    ]
    return {"panel_weekly": panel_weekly, "panel_smooth": panel_smooth, "panel_hourly_dense": panel_hourly} | {f.__name__: f for f in own}


QUERIES = _all()
