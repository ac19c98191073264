"""Operators against independent numpy versions, and properties that must hold."""

import datetime
import json
import math
import os
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldscape.config import ExpandConfig, as_ranges, default_split, resolve
from foldscape.functions.stats import metrics, minmax, reported
from foldscape.operators import causality, crossmap, embedding, evaluate, neighbors, panel, reverse, simplex
from foldscape.operators.expand import expand
from foldscape.plans import fixtures, queries
from foldscape.plans.cost import strategy
from foldscape.sources import readers, sinks


def coupled(n=120):
    """Two logistic maps, x driving y, and a third that drives nobody; no random numbers."""
    x, y, z = [0.4], [0.2], [0.31]
    for _ in range(n - 1):
        a, b, c = x[-1], y[-1], z[-1]
        x.append(a * (3.7 - 3.7 * a))
        y.append(b * (3.6 - 3.6 * b - 0.25 * a))
        z.append(c * (3.9 - 3.9 * c))
    return pd.DataFrame({"row_id": range(1, n + 1), "x": x, "y": y, "noise": z})


@pytest.fixture(scope="module")
def maps(spark):
    return spark.createDataFrame(coupled()).persist()


def np_simplex(X, y, lib, pred, tp=1, radius=0, k=None):
    """{row: prediction of y at row + tp}, 1-based, written without Spark."""
    k = k or X.shape[1] + 1
    out = {}
    n = len(y)
    for p in pred:
        d = []
        for q in lib:
            if abs(p - q) > radius and 1 <= q + tp <= n and np.isfinite(y[q + tp - 1]) and np.isfinite(X[q - 1]).all() and np.isfinite(X[p - 1]).all():
                d.append((math.sqrt(((X[p - 1] - X[q - 1]) ** 2).sum()), q))
        d = sorted(d)[:k]
        if d:
            m = d[0][0]
            w = [max(math.exp(-a / m) if m > 0 else float(a == 0), 1e-6) for a, _ in d]
            out[p] = sum(a * y[q + tp - 1] for a, (_, q) in zip(w, d, strict=True)) / sum(w)
    return out


def test_simplex_matches_numpy(maps):
    f = coupled()
    got = {r["row_id"]: r["pred"] for r in simplex.simplex(maps, ["x", "y"], "y", ((1, 60),), ((61, 120),)).collect()}
    want = np_simplex(f[["x", "y"]].to_numpy(), f["y"].to_numpy(), range(1, 61), range(61, 121))
    assert len(got) == 61 and got[61] is None
    for p, v in want.items():
        assert got[p + 1] == pytest.approx(v, abs=1e-12)


def test_simplex_with_ties_zero_distances_and_radius(spark):
    f = pd.DataFrame({"row_id": range(1, 31), "a": [float(i % 3) for i in range(30)], "t": [float(i * i % 7) for i in range(30)]})
    df = spark.createDataFrame(f)
    for radius in (0, 3):
        got = {r["row_id"]: r["pred"] for r in simplex.simplex(df, ["a"], "t", ((1, 30),), ((1, 30),), radius=radius).collect()}
        for p, v in np_simplex(f[["a"]].to_numpy(), f["t"].to_numpy(), range(1, 31), range(1, 31), radius=radius).items():
            assert got[p + 1] == pytest.approx(v, abs=1e-12)


def test_metrics_of_published_pairs(spark):
    rows = spark.createDataFrame([(1.0, 1.1), (2.0, 1.7), (3.0, 3.3), (None, 2.0), (4.0, None)], "obs double, pred double")
    m = rows.agg(*metrics()).first()
    o, p = np.array([1, 2, 3.0]), np.array([1.1, 1.7, 3.3])
    assert m["n"] == 3 and m["rho"] == pytest.approx(np.corrcoef(o, p)[0, 1]) and m["cae"] == pytest.approx(np.abs(o - p).sum())
    assert m["rmse"] == pytest.approx(np.sqrt(((o - p) ** 2).mean())) and m["mae"] == pytest.approx(np.abs(o - p).mean())
    r = reported(rows.agg(*metrics())).first()
    assert r["r2"] == round(r["rho"] ** 2, 3)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "obs double, pred double").agg(*metrics()).first()
    assert flat["rho"] is None


def test_relational_and_vectorised_agree(spark, maps):
    wide = maps.withColumn("gap", F.when(F.col("row_id") % 7 != 0, F.col("x") * 2)).withColumn("step", F.floor(F.col("x") * 4).cast("double"))
    how = (wide, ["y"], ["x", "noise", "gap", "step"], "y", ((1, 60),), ((55, 120),), 1, 2)
    a = {r["variable"]: r["rho"] for r in crossmap.sweep(*how, plan="relational").collect()}
    b = {r["variable"]: r["rho"] for r in crossmap.sweep(*how, plan="vectorised").collect()}
    assert a.keys() == b.keys() == {"x", "noise", "gap", "step"}
    for v in a:
        assert a[v] == pytest.approx(b[v], abs=1e-9)
    assert strategy(80, ((1, 300),), ((301, 600),), neighbors.RELATIONAL_PAIRS) == "relational"
    assert strategy(64, ((1, 1000),), ((1, 1000),), neighbors.RELATIONAL_PAIRS) == "vectorised"


def test_shifts_and_row_order_change_nothing(spark, maps):
    base = crossmap.sweep(maps, [], ["x", "noise"], "y", ((1, 60),), ((61, 120),)).collect()
    moved = maps.withColumn("x", F.col("x") + 8).orderBy(F.desc("row_id")).repartition(3)
    again = crossmap.sweep(moved, [], ["x", "noise"], "y", ((1, 60),), ((61, 120),)).collect()
    a, b = ({r["variable"]: r["rho"] for r in rows} for rows in (base, again))
    assert a == pytest.approx(b, abs=1e-9)


def test_embed_dimension_matches_numpy(maps):
    f = coupled()
    got = {r["e"]: r["rho"] for r in embedding.embed_dimension(maps, "x", "y", ((1, 60),), ((61, 120),), 4).collect()}
    for e in range(1, 5):
        X = np.stack([f["x"].shift(k).to_numpy() for k in range(e)], 1)
        want = np_simplex(X, f["y"].to_numpy(), range(1, 61), range(61, 121))
        pairs = [(f["y"][p], v) for p, v in want.items() if p < 120]
        assert got[e] == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], abs=1e-9)


def test_best_and_first_peak(spark):
    curve = spark.createDataFrame([(1, 0.5), (2, 0.70001), (3, 0.6), (4, 0.70002), (5, None)], "e int, rho double")
    assert embedding.best_e(curve).first()["e"] == 2  # equal at 4 decimals: the smaller
    assert embedding.first_peak(curve).first()["e"] == 2
    rising = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "e int, rho double")
    assert embedding.first_peak(rising).first()["e"] == 3


def test_convergence_tells_driver_from_driven(maps):
    sizes = (10, 20, 60, 110)
    forward = causality.slope_of(maps, "x", "y", sizes, 120, sample=8, e=2)
    back = causality.slope_of(maps, "y", "x", sizes, 120, sample=8, e=2)
    noise = causality.slope_of(maps, "noise", "y", sizes, 120, sample=8, e=2)
    assert forward > 0.05 and forward > back and forward > noise
    a = causality.ccm_curve(maps, "y", "x", sizes, 3, 1, 2, plan="relational").orderBy("size").collect()
    b = causality.ccm_curve(maps, "y", "x", sizes, 3, 1, 2, plan="vectorised").orderBy("size").collect()
    assert [r["rho"] for r in a] == pytest.approx([r["rho"] for r in b], abs=1e-9)


def test_flat_curve_has_no_slope(spark):
    flat = spark.createDataFrame([(10, 0.3), (20, 0.3), (30, 0.3)], "size int, rho double")
    assert causality.slope(flat, 100).first()["slope"] == 0
    assert causality.slope(flat.where("size = 10"), 100).first()["slope"] is None


def test_draws_are_without_replacement(maps):
    rows = causality.draws(maps, (5, 20), 3, 1).groupBy("size", "draw").agg(F.count("*").alias("n"), F.countDistinct("l").alias("d")).collect()
    assert len(rows) == 6 and all(r["n"] == r["d"] == r["size"] for r in rows)


def test_lags_both_ways(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "row_id long, v double")
    back = {r[0]: tuple(r[1:]) for r in panel.lags(df, ["v"], 3, -1).collect()}
    ahead = {r[0]: tuple(r[1:]) for r in panel.lags(df, ["v"], 2, 2).collect()}
    assert back[1] == (1.0, None, None) and back[4] == (4.0, 3.0, 2.0) and len(back) == 5
    assert ahead[1] == (1.0, 3.0) and ahead[5] == (5.0, None)


def test_expansion_without_gate_is_greedy(maps):
    cfg = ExpandConfig(target="y", exclude=("y",), max_dim=3, gate=False, rho_min=-1.0)
    found = expand(maps, config=cfg)
    first = crossmap.sweep(maps, [], ["x", "noise"], "y", *default_split(120)).orderBy(F.desc("rho")).first()
    assert found.variables[0] == first["variable"] and found.rows[0][2] == pytest.approx(first["rho"])
    assert len(found.rows) == 2 and found.rankings.count() == 3  # no candidate is left for the third
    assert found.best_dimension() in (1, 2)
    assert expand(maps, config=replace(cfg, rho_min=2.0)).rows == []


def test_gate_keeps_the_driver(maps):
    cfg = ExpandConfig(target="y", exclude=("y",), max_dim=2, tp=0, e=2, rho_min=-1.0, embed_rho_min=-1.0, sample=8, lib_sizes=(10, 20, 60, 110), slope_min=0.05)
    found = expand(maps, config=cfg)
    assert "x" in found.variables
    assert {r["variable"] for r in found.edim.where("accepted").collect()} >= {"x"}
    strict = expand(maps, config=replace(cfg, slope_min=5.0))
    assert strict.rows == [] and strict.rankings.count() > 0


def test_matrix_gate_orientations_and_checks(spark, maps):
    names = ["x", "y", "noise"]
    m = spark.createDataFrame([(a, b, None if a == b else {"xy": 0.5, "yx": 0.0, "noisey": 0.0, "ynoise": 0.5}.get(a + b, 0.0)) for a in names for b in names], "source string, predicted string, slope double")
    cfg = ExpandConfig(target="y", exclude=("y",), max_dim=1, rho_min=-1.0)
    assert expand(maps, config=cfg, slopes=m).variables == ["x"]
    assert expand(maps, config=replace(cfg, slope_orientation="candidate_column"), slopes=m).variables == ["noise"]
    assert expand(maps, config=cfg, slopes=m).passing.count() == 1
    with pytest.raises(ValueError, match="lacks"):
        expand(maps.withColumn("w", F.col("x") + 1), config=cfg, slopes=m)
    assert len(expand(maps, config=replace(cfg, gate=False), slopes=m).rows) == 1  # ignored


def test_time_delays(maps):
    rows = expand(maps, config=ExpandConfig(target="y", exclude=("y",), max_dim=1, gate=False, rho_min=-1.0, time_delay=2)).delays
    assert len(rows) == 2 and rows[0][0] == "y" and all(-1 <= r[2] <= 1 for r in rows)


@pytest.mark.parametrize("seed", range(12))
def test_levels_visit_like_a_queue(spark, seed):
    """Random digraphs with cycles and self-edges, against a plain queue with a visited set."""
    from collections import deque

    rng = np.random.default_rng(seed)
    names = [f"n{i}" for i in range(9)]
    drivers = {n: list(rng.permutation(names)[: rng.integers(0, 4)]) for n in names}
    depth_limit = None if seed % 3 == 0 else int(rng.integers(0, 4))

    class Fake:
        def __init__(self, target):
            self.rows = [(i, d, 0.5) for i, d in enumerate(drivers[target], 1)]

    df = spark.createDataFrame([tuple([1] + [1.0] * 9)], ["row_id", *names])
    got = reverse.driver_graph(df, config=ExpandConfig(target="n0"), max_depth=depth_limit, quiet=True, run=lambda c: Fake(c.target))
    queue, seen, order = deque([("n0", 0)]), set(), []
    while queue:
        name, depth = queue.popleft()
        if name in seen or (depth_limit is not None and depth > depth_limit):
            continue
        seen.add(name)
        order.append((name, depth))
        queue.extend((d, depth + 1) for d in drivers[name] if d != name)
    assert [(v[0], v[1]) for v in got.visited] == order
    assert {(t, d) for t, d, _, _ in got.links} == {(n, d) for n, _ in order for d in drivers[n]}


def test_child_config_and_ceiling():
    cfg = ExpandConfig(target="a", exclude=("z",), plot=True, out_csv="f")
    child = reverse.child_config(cfg, "b")
    assert child.target == "b" and child.exclude == ("z", "b") and not child.plot and child.out_csv is None
    assert reverse.run_ceiling(1, 2, 10, 1, 3) == 9 and reverse.run_ceiling(1, 2, 10, None, 3) == 10


def test_pca_against_numpy(spark, maps):
    f = coupled()
    a, b, ratio = evaluate.pca_scores(maps.where("row_id <= 60"), maps.where("row_id > 60"), ["x", "y", "noise"], 2)
    X = f[["x", "y", "noise"]].to_numpy()
    mean = X[:60].mean(0)
    _, s, vt = np.linalg.svd(X[:60] - mean, full_matrices=False)
    want = (X[60:] - mean) @ vt[:2].T
    got = b.orderBy("row_id").toPandas()[["c0", "c1"]].to_numpy()
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    assert ratio == pytest.approx((s**2 / (s**2).sum())[:2])


def test_diffusion_extension_agrees_on_its_own_rows(maps):
    own = maps.where("row_id <= 60")
    found = evaluate.DiffusionMap(12, 2, "bgh").fit(own, ["x", "y"])
    again = found.coordinates(own).orderBy("row_id").toPandas()[["c0", "c1"]].to_numpy()
    for i in range(2):
        assert abs(np.corrcoef(found.vectors[:, i], again[:, i])[0, 1]) > 0.9


def test_diffusion_map_matches_numpy(maps):
    """Kernel on the nearest neighbours, normalised by density, and its leading eigenvectors, by brute force."""
    k, width, alpha = 9, 0.02, 0.5
    own, others = maps.where("row_id <= 60"), maps.where("row_id > 60")
    model = evaluate.DiffusionMap(k, 2, width, alpha).fit(own, ["x", "y"])
    rows = maps.orderBy("row_id").toPandas()[["x", "y"]].to_numpy()
    a, b = rows[:60], rows[60:]
    d2 = ((a[:, None] - a[None]) ** 2).sum(2)
    near = np.zeros((60, 60), bool)
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (d2[i, j], j))[:k]
        near[i, order] = near[i, i] = True
    kernel = np.where(near | near.T, np.exp(-d2 / (4 * width)), 0.0)
    q = kernel.sum(1) ** -alpha
    kernel = kernel * q[:, None] * q[None]
    values, vectors = np.linalg.eig(kernel / kernel.sum(1)[:, None])  # the walk itself; the operator takes its symmetric form
    order = np.argsort(-values.real)[1:3]
    assert np.allclose(model.values, values.real[order], atol=1e-9)
    for i, o in enumerate(order):
        assert abs(np.corrcoef(model.vectors[:, i], vectors[:, o].real)[0, 1]) == pytest.approx(1, abs=1e-6)
    found = model.coordinates(others).orderBy("row_id").toPandas()[["c0", "c1"]].to_numpy()
    for i in range(len(b)):
        far = ((b[i] - a) ** 2).sum(1)
        some = sorted(range(60), key=lambda j: (far[j], j))[:k]
        w = np.exp(-far[some] / (4 * width)) * q[some]
        assert np.allclose(found[i], (w[:, None] * model.vectors[some] / model.values).sum(0) / w.sum())


def test_forecasts_of_both_strategies_agree(spark, maps):
    spans = (((1, 60),), ((50, 120),))
    near = [sorted(map(tuple, neighbors.knn(maps, ["x", "noise"], "y", *spans, radius=2, plan=p).select("p", "l", "rank", "y").collect())) for p in ("relational", "vectorised")]
    assert near[0] == near[1]
    for how in ({"e": 0}, {"e": 3, "tau": -2}):
        a, b = ({r["row_id"]: r["pred"] for r in simplex.simplex(maps, ["x"], "y", *spans, plan=p, **how).collect()} for p in ("relational", "vectorised"))
        assert a == pytest.approx(b, abs=1e-9)
    a, b = ({r["e"]: r["rho"] for r in embedding.embed_dimension(maps, "x", "y", *spans, max_e=5, tau=-2, radius=1, plan=p).collect()} for p in ("relational", "vectorised"))
    assert a == pytest.approx(b, abs=1e-9)
    own, others = maps.where("row_id <= 60"), maps.where("row_id > 55")
    a, b = (sorted(map(tuple, evaluate.neighbor_table(own, others, ["x", "y"], 4, itself=True, plan=p).select("p", "l").collect())) for p in ("relational", "vectorised"))
    assert a == b


def test_large_forecasts_have_no_nested_loop(spark):
    """200,000 rows against as many: no nested loop, and no broadcast that grows with the panel."""
    wide = spark.range(1, 400_001).select(F.col("id").alias("row_id"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    spans = (((1, 200_000),), ((200_001, 400_000),))
    for df in (neighbors.knn(wide, ["x"], "y", *spans), simplex.simplex(wide, ["x"], "y", *spans), embedding.embed_dimension(wide, "x", "y", *spans, max_e=3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_of_few_rows(maps, monkeypatch):
    from foldscape.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    monkeypatch.setattr(blocks, "CHUNK", 2)
    how = (maps, ["y"], ["x", "noise", "y"], "y", ((1, 60),), ((55, 120),), 1, 2)
    a, b = ({r["variable"]: r["rho"] for r in crossmap.sweep(*how, plan=p).collect()} for p in ("relational", "vectorised"))
    assert a == pytest.approx(b, abs=1e-9)


def test_carried_distances_agree_with_fresh_ones(maps):
    spans = (((1, 60),), ((55, 120),))
    held = crossmap.Carried(maps, ["x", "noise", "y"], "y", *spans, 1, 2)
    for base in ([], ["y"], ["y", "x"]):
        left = [c for c in ("x", "noise", "y") if c not in base]
        a = {r["variable"]: (r["ord"], r["rho"]) for r in held.sweep(base, left).collect()}
        b = {r["variable"]: (r["ord"], r["rho"]) for r in crossmap.sweep(maps, base, left, "y", *spans, 1, 2).collect()}
        assert a == b
    held.release()


def test_compare_reports_three_methods(maps):
    rows = evaluate.compare(maps, "y", ["x"], lib=(1, 60), pred=(61, 120), tp=1, components=2, k=8).collect()
    assert [r["method"] for r in rows] == ["simplex", "pca", "diffusion"]
    with pytest.raises(ValueError):
        evaluate.compare(maps, "y", [])


def test_minmax_constant_and_null(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0, None), (2, 4.0, 5.0, None), (3, None, 5.0, None)], "row_id long, a double, b double, c double")
    rows = minmax(df, ["a", "b", "c"]).orderBy("row_id").collect()
    assert [r["a"] for r in rows] == [0.0, 1.0, None] and {r["b"] for r in rows} == {0.0} and {r["c"] for r in rows} == {None}


def test_config_resolution():
    assert as_ranges([1, 5, 8, 9]) == ((1, 5), (8, 9)) == as_ranges([(1, 5), (8, 9)])
    assert ExpandConfig().sizes(344) == (34, 51, 292, 309)
    with pytest.raises(ValueError, match="three"):
        ExpandConfig(lib_sizes=(10, 20)).sizes(100)
    with pytest.raises(ValueError, match="between"):
        ExpandConfig().sizes(40)
    with pytest.raises(TypeError):
        resolve(cores=3)
    with pytest.raises(ValueError):
        ExpandConfig(match="abc")
    with pytest.raises(ValueError):
        ExpandConfig().needs_target()
    assert resolve(ExpandConfig(max_dim=2), tp=3).tp == 3 and resolve(ExpandConfig(max_dim=2), {"max_dim": 5, "other": 1}).max_dim == 5


def test_projection_rules():
    names = ["abc", "bcd", "cde", "t"]
    assert panel.matching(names, ["bc", "c"], "t") == ["abc", "bcd", "cde", "t"]
    assert panel.choose(names, (1, 3), [0], ["t"]) == ["bcd", "cde"] and panel.choose(names, None, [0, 2]) == ["abc", "cde"]
    assert panel.choose(names) == names and panel.candidates(names, ["abc"], ["t"]) == ["bcd", "cde"]
    assert readers.array_names(4, ["t", "u"]) == ["t", "u", "c0", "c1"]


def test_sources_round_trip(spark, tmp_path):
    f = coupled(12)
    wide = f.drop(columns="row_id")
    wide.to_csv(tmp_path / "p.csv", index=False)
    np.save(tmp_path / "p.npy", wide.to_numpy())
    np.savez(tmp_path / "p.npz", own=wide.to_numpy())
    import pyarrow as pa
    import pyarrow.feather

    pyarrow.feather.write_feather(pa.Table.from_pandas(wide), str(tmp_path / "p.feather"))
    spark.createDataFrame(f).write.parquet(str(tmp_path / "p.parquet"))
    for name, how in (("p.csv", {}), ("p.feather", {}), ("p.parquet", {}), ("p.npy", {"leading": ["x", "y", "noise"]}), ("p.npz", {"leading": ["x", "y", "noise"], "member": "own"})):
        got = readers.read_panel(spark, str(tmp_path / name), **how).orderBy("row_id").toPandas()
        assert np.allclose(got[["row_id", "x", "y", "noise"]].to_numpy(), f.to_numpy())
    assert readers.read_panel(spark, str(tmp_path / "p.csv"), match=["no"], target="y").columns == ["row_id", "noise", "y"]
    assert readers.read_panel(spark, str(tmp_path / "p.npy"), remove_first=True).columns == ["row_id", "c1", "c2"]
    with pytest.raises(KeyError, match="own"):
        readers.read_panel(spark, str(tmp_path / "p.npz"), member="other")
    with pytest.raises(ValueError):
        readers.read_panel(spark, "x.txt")


def test_slope_files(spark, tmp_path):
    m = pd.DataFrame([[0.5, 0.1], [0.2, 0.7]], columns=["a", "b"], index=["a", "b"])
    m.to_csv(tmp_path / "m.csv", index=False)
    m.to_feather(tmp_path / "m.feather")
    for name in ("m.csv", "m.feather"):
        got = {(r["source"], r["predicted"]): r["slope"] for r in readers.read_slopes(spark, str(tmp_path / name)).collect()}
        assert got == {("a", "a"): 0.5, ("a", "b"): 0.1, ("b", "a"): 0.2, ("b", "b"): 0.7}
    pd.DataFrame([[0.5, 0.1]], columns=["a", "b"]).to_csv(tmp_path / "bad.csv", index=False)
    with pytest.raises(ValueError, match="square"):
        readers.read_slopes(spark, str(tmp_path / "bad.csv"))


def test_sinks_round_trip(spark, maps, tmp_path):
    found = expand(maps, config=ExpandConfig(target="y", exclude=("y",), max_dim=2, gate=False, rho_min=-1.0, keep_ranked=1))
    sinks.write_csv(found.selected, str(tmp_path / "r.csv"))
    assert list(pd.read_csv(tmp_path / "r.csv")["variables"]) == found.variables
    sinks.write_result(found, str(tmp_path / "r"))
    cfg, tables = sinks.read_result(spark, str(tmp_path / "r"))
    assert cfg == found.config and tables["selected"].count() == 2 and tables["rankings"].count() == 2
    assert [r["variable"] for r in readers.read_root(spark, str(tmp_path / "r" / "selected")).orderBy("dim").collect()] == found.variables
    graph = reverse.driver_graph(maps, config=ExpandConfig(target="y", exclude=("y",), max_dim=1, gate=False, rho_min=-1.0), max_depth=1, quiet=True)
    os.mkdir(tmp_path / "g")
    sinks.write_graph(graph, str(tmp_path / "g"))
    sinks.write_graph(graph, str(tmp_path / "g"))
    nodes, edges = sinks.read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == len(graph.visited) and edges.count() == len(graph.links)
    assert len(sinks.write_target_csvs(graph, str(tmp_path / "out"))) == len(graph.visited)
    with pytest.raises(FileNotFoundError):
        sinks.out_dir(str(tmp_path / "no" / "such"))


def test_command_line(spark, tmp_path, monkeypatch):
    from foldscape import cli

    coupled(60).drop(columns="row_id").to_csv(tmp_path / "p.csv", index=False)
    monkeypatch.chdir(tmp_path)
    out = cli.main(["expand", "-d", str(tmp_path / "p.csv"), "-t", "y", "-rc", "y", "-D", "1", "-nC", "-cmin", "-1", "-oc", "r.csv", "-n"])
    assert out.count() == 1 and (tmp_path / "r.csv").exists()
    assert cli.main(["crossmap", "-d", str(tmp_path / "p.csv"), "-t", "y", "-c", "x", "noise", "-em"]).count() == 1
    args = ["reverse", "-d", str(tmp_path / "p.csv"), "-t", "y", "-rc", "y", "-D", "1", "-nC", "-cmin", "-1", "-md", "1", "-l", "1", "30", "-p", "31", "60", "-lp", "50"]
    assert cli.main(args).count() >= 1
    assert cli.main(["evaluate", "-d", str(tmp_path / "p.csv"), "-t", "y", "-c", "x", "-nc", "2", "-k", "6"]).count() == 3


def test_scoring_a_stream(spark, maps, tmp_path):
    from foldscape.streaming.scoring import score_stream

    maps.where("row_id > 100").select("row_id", "x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, x double").parquet(str(tmp_path / "in"))
    query = score_stream(maps.where("row_id <= 100"), stream, ["x"], "y", ((1, 99),), 1, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_entry_lists_sql_for_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    json.dumps(list(entry.queries()))


def test_plans_push_columns_to_the_scan(spark):
    from foldscape.plans.fixtures import panel_weekly

    plan = panel_weekly(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "l_comment" not in plan.split("== Physical Plan ==")[1] and "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_shipdate" in plan


# --- queries over whole tables


def slow_sweep(rows, base, names, target, radius=0):
    """Skill of each name, with the first half of all rows as library and the rest predicted, by comparison."""
    half, out = len(rows) // 2, {}
    at = {r["row_id"]: r for r in rows}
    for name in names:
        columns = [*base, name]
        pairs = []
        for p in range(half + 1, len(rows) + 1):
            near = sorted(
                (sum((at[p][c] - at[l][c]) ** 2 for c in columns), l) for l in range(1, half + 1)
                if abs(p - l) > radius and all(at[i][c] is not None for i in (p, l) for c in columns)
            )[: len(columns) + 1]
            if not near or p + 1 not in at:
                continue
            d = [math.sqrt(x) for x, _ in near]
            w = [max(math.exp(-x / d[0]) if d[0] > 0 else float(x == 0), 1e-6) for x in d]
            pairs.append((at[p + 1][target], sum(a * at[l + 1][target] for a, (_, l) in zip(w, near, strict=True)) / sum(w)))
        out[name] = np.corrcoef(np.array(pairs).T)[0, 1]
    return out


def test_embedding_crossmap_uses_all_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["variable"]: r["rho"] for r in queries.embedding_crossmap(spark, str(tmp_path)).collect()}
    panel_rows = [{"row_id": i + 1} | {f"e{k}": round(x, 6) for k, x in enumerate(v)} for i, v in rows]
    assert found == pytest.approx(slow_sweep(panel_rows, ["e1"], [f"e{i}" for i in range(2, 8)], "e0"), abs=2e-6)


def test_hourly_sweep_uses_all_hours(spark, tmp_path):
    rng = np.random.default_rng(2)
    kinds = ["click", "error", "purchase", "signup", "view"]
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=int(m)), kinds[int(rng.integers(5))], round(float(rng.normal()), 3)) for m in rng.integers(0, 800 * 60, 3000)]
    rows += [(start, "click", 1.0), (start + datetime.timedelta(hours=799), "click", 1.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {r["variable"]: r["rho"] for r in queries.hourly_sweep(spark, str(tmp_path)).collect()}
    hours = [r.asDict() for r in fixtures.panel_hourly(spark, str(tmp_path)).collect()]
    assert len(hours) == 800
    assert found == pytest.approx(slow_sweep(hours, [], ["n_view", "v_view", "v_error"], "n_click", 2), abs=2e-6)
