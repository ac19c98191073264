"""Engine queries against SQL on the smallest tables."""

import pytest

from foldscape.plans.oracle import SQL
from foldscape.plans.queries import QUERIES
from tests.oracle import same

SOME = [
    "panel_weekly", "panel_smooth", "panel_hourly_dense", "lag_embed", "library_rows", "knn_excluded", "simplex_predict", "simplex_embedded", "cross_map_given",
    "cross_map_blocks", "greedy_rankings", "first_peak_e", "ccm_slope", "passing_subset", "driver_nodes", "embedding_crossmap", "hourly_sweep", "minmax_scale", "ols_single",
    "best_dimension", "time_delays", "edim_map", "greedy_expand_gated", "evaluate_simplex", "evaluate_pca", "embedding_knn", "embedding_knn_blocks", "embed_dimension_blocks",
    "evaluate_all_rows", "evaluate_embedded", "pca_explained", "diffusion_neighbors", "csv_scan", "feather_scan", "npy_scan", "npz_member", "slope_csv", "slope_feather",
    "result_csv", "result_tables", "graph_tables", "target_csvs",
]


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
