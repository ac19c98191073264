"""SQL that another engine runs on the same tables, for the queries that SQL can express."""

from __future__ import annotations

from foldscape.plans.fixtures import OTHERS, TARGET, TYPES, WEEKLY
from foldscape.plans.queries import SLOPES

_WEEKLY = """
wo AS (SELECT date_trunc('week', o_orderdate) AS w, CAST(count(*) AS DOUBLE) AS n_orders, round(sum(o_totalprice), 2) AS revenue,
              CAST(count(DISTINCT o_custkey) AS DOUBLE) AS n_cust FROM orders GROUP BY 1),
wl AS (SELECT date_trunc('week', l_shipdate) AS w, CAST(count(*) AS DOUBLE) AS n_lines, round(sum(l_quantity), 2) AS qty,
              round(sum(l_extendedprice), 2) AS ext FROM lineitem GROUP BY 1),
weekly AS (SELECT row_number() OVER (ORDER BY w) AS row_id, strftime(CAST(w AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS w, n_orders, revenue, n_cust, n_lines, qty, ext FROM wo JOIN wl USING (w))"""
_SMOOTH = (
    _WEEKLY + ",\nsmooth AS (SELECT row_id, " + ", ".join(f"round(avg({c}) OVER (ORDER BY row_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS {c}" for c in WEEKLY)
    + " FROM weekly),\nn AS (SELECT count(*) AS n, count(*) // 2 AS half FROM smooth)"
)
_LONG = ",\nlong AS (SELECT * FROM (UNPIVOT smooth ON " + ", ".join(WEEKLY) + " INTO NAME variable VALUE value))"
_HALVES = ("l.row_id <= (SELECT half FROM n)", "p.row_id > (SELECT half FROM n)")
_WEIGHT = "greatest(CASE WHEN m > 0 THEN exp(-d / m) WHEN d = 0 THEN 1.0 ELSE 0.0 END, 1e-6)"


def _square(columns: list[str]) -> str:
    return " + ".join(["0.0", *[f"(p.{c} - l.{c}) * (p.{c} - l.{c})" for c in columns]])


def _near(columns: list[str], k: int, panel: str = "smooth", target: str = TARGET, lib: str = _HALVES[0], pred: str = _HALVES[1], tp: int = 1, radius: int = 0) -> str:
    """CTEs near (p, l, y, rank, d, m, w) and forecast (p, pred, pred_var)."""
    return f""",
pairs AS (
  SELECT p.row_id AS p, l.row_id AS l, y.{target} AS y, {_square(columns)} AS d2
  FROM {panel} p JOIN {panel} l ON abs(p.row_id - l.row_id) > {radius} JOIN {panel} y ON y.row_id = l.row_id + {tp}
  WHERE {lib} AND {pred} AND y.{target} IS NOT NULL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d2, l) AS rank FROM pairs WHERE d2 IS NOT NULL QUALIFY rank <= {k}),
near AS (SELECT *, {_WEIGHT} AS w FROM (SELECT p, l, y, rank, sqrt(d2) AS d, min(sqrt(d2)) OVER (PARTITION BY p) AS m FROM ranked)),
mean AS (SELECT p, sum(w * y) / sum(w) AS pred FROM near GROUP BY p),
forecast AS (SELECT p, pred, sum(w * (y - pred) * (y - pred)) / sum(w) AS pred_var FROM near JOIN mean USING (p) GROUP BY p, pred)"""


def _aligned(tp: int = 1, panel: str = "smooth", target: str = TARGET) -> str:
    """The forecast moved by tp, with observations: CTE aligned (row_id, obs, pred, pred_var)."""
    return f""",
aligned AS (
  SELECT r.row_id, o.{target} AS obs, pred, pred_var
  FROM (SELECT row_id FROM {panel} WHERE row_id > (SELECT half FROM n) UNION SELECT p + {tp} FROM forecast) r
  LEFT JOIN {panel} o USING (row_id) LEFT JOIN forecast f ON f.p + {tp} = r.row_id
)"""


def _sweep(names: list[str], base: str = "0.0", joins: str = "", tag: str = "", k: int = 2, long: str = "long", panel: str = "smooth", target: str = TARGET, lib: str = _HALVES[0], pred: str = _HALVES[1], tp: int = 1, radius: int = 0) -> str:
    """CTE swept{tag} (variable, rho) of the projection on each name with a base distance."""
    some = ", ".join(f"'{c}'" for c in names)
    return f""",
cand{tag} AS (
  SELECT a.variable, p.row_id AS p, l.row_id AS l, y.{target} AS y, {base} + (a.value - b.value) * (a.value - b.value) AS d2
  FROM {panel} p JOIN {panel} l ON abs(p.row_id - l.row_id) > {radius} JOIN {panel} y ON y.row_id = l.row_id + {tp}
  JOIN {long} a ON a.row_id = p.row_id JOIN {long} b ON b.row_id = l.row_id AND b.variable = a.variable {joins}
  WHERE {lib} AND {pred} AND y.{target} IS NOT NULL AND a.variable IN ({some})
),
close{tag} AS (SELECT *, row_number() OVER (PARTITION BY variable, p ORDER BY d2, l) AS rank FROM cand{tag} WHERE d2 IS NOT NULL QUALIFY rank <= {k}),
heavy{tag} AS (SELECT *, {_WEIGHT} AS w FROM (SELECT variable, p, y, sqrt(d2) AS d, min(sqrt(d2)) OVER (PARTITION BY variable, p) AS m FROM close{tag})),
fc{tag} AS (SELECT variable, p, sum(w * y) / sum(w) AS pred FROM heavy{tag} GROUP BY ALL),
swept{tag} AS (SELECT variable, corr(o.{target}, pred) AS rho FROM fc{tag} c JOIN {panel} o ON o.row_id = c.p + {tp} WHERE o.{target} IS NOT NULL GROUP BY variable)"""


def _order(names: list[str]) -> str:
    return f"list_position([{', '.join(repr(n) for n in names)}], variable)"


def _q(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


_HOURLY = (
    """
hours AS (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS h FROM events),
found AS (SELECT date_trunc('hour', ts) AS h, """
    + ", ".join(f"CAST(count(*) FILTER (event_type = '{t}') AS DOUBLE) AS n_{t}, round(avg(value) FILTER (event_type = '{t}'), 6) AS v_{t}" for t in TYPES)
    + " FROM events GROUP BY 1),\nhourly AS (SELECT row_number() OVER (ORDER BY h) AS row_id, strftime(CAST(h AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS h, "
    + ", ".join([*[f"coalesce(n_{t}, 0) AS n_{t}" for t in TYPES], *[f"v_{t}" for t in TYPES]]) + " FROM hours LEFT JOIN found USING (h))"
)


def _vectors(dims: int) -> str:
    wide = ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS e{i}" for i in range(dims))
    return f"vectors AS (SELECT vec_id + 1 AS row_id, {wide} FROM embeddings),\nn AS (SELECT count(*) // 2 AS half FROM vectors),\nlong AS (SELECT * FROM (UNPIVOT vectors ON {', '.join(f'e{i}' for i in range(dims))} INTO NAME variable VALUE value))"


_RHO = f"SELECT variable, round(rho, 6) AS rho FROM swept WHERE rho > -1.0 ORDER BY 2 DESC, {_order(OTHERS)}"


def _two(names: list[str], before: str = "", where: str = "rho > -1.0") -> str:
    """CTEs win and second: the best of `names`, and the best of the others together with it."""
    best = lambda tag: f"SELECT variable, rho FROM swept{tag} WHERE {where} ORDER BY rho DESC, {_order(OTHERS)} LIMIT 1"
    joins = (
        "JOIN win ON true JOIN long c ON c.row_id = p.row_id AND c.variable = win.variable "
        "JOIN long d ON d.row_id = l.row_id AND d.variable = win.variable AND a.variable <> win.variable"
    )
    return (
        _SMOOTH + _LONG + _sweep(names) + before + f",\nwin AS ({best('')})" + _sweep(names, "(c.value - d.value) * (c.value - d.value)", joins, "2", 3) + f",\nsecond AS ({best('2')})"
    )


def _third() -> str:
    """CTE third, after _two(OTHERS)."""
    joins = (
        "JOIN win ON true JOIN second ON true JOIN long c ON c.row_id = p.row_id AND c.variable = win.variable JOIN long d ON d.row_id = l.row_id AND d.variable = win.variable "
        "JOIN long e ON e.row_id = p.row_id AND e.variable = second.variable JOIN long f ON f.row_id = l.row_id AND f.variable = second.variable "
        "AND a.variable NOT IN (win.variable, second.variable)"
    )
    swept = _sweep(OTHERS, "(c.value - d.value) * (c.value - d.value) + (e.value - f.value) * (e.value - f.value)", joins, "3", 4)
    return swept + f",\nthird AS (SELECT variable, rho FROM swept3 WHERE rho > -1.0 ORDER BY rho DESC, {_order(OTHERS)} LIMIT 1)"


def _delayed(column: str) -> str:
    """Skill of the winner's column with two lags of a column of `wide` (x: the winner's)."""
    ctes = f"lagged AS (SELECT row_id, {TARGET}, x, lag({column}, 1) OVER (ORDER BY row_id) AS d1, lag({column}, 2) OVER (ORDER BY row_id) AS d2 FROM wide)"
    return f"(WITH {ctes}{_near(['x', 'd1', 'd2'], 4, panel='lagged')} SELECT corr(o.{TARGET}, pred) FROM forecast f JOIN smooth o ON o.row_id = f.p + 1)"


def _gates(max_e: int, percents, sample: int) -> str:
    """CTE gate (variable, e, rho, slope): embedding dimension and convergence slope of every candidate."""
    some = ", ".join(f"'{c}'" for c in OTHERS)
    lagged = ", ".join(f"lag(value, {k}) OVER (PARTITION BY variable ORDER BY row_id) AS x{k}" for k in range(max_e))
    each = "\nUNION ALL ".join(
        f"SELECT p.variable, {e} AS e, p.row_id AS p, l.row_id AS l, y.{TARGET} AS y, {_square([f'x{k}' for k in range(e)])} AS d2 FROM glag p JOIN glag l ON p.variable = l.variable AND p.row_id <> l.row_id "
        f"JOIN smooth y ON y.row_id = l.row_id + 1 WHERE {_HALVES[0]} AND {_HALVES[1]}" for e in range(1, max_e + 1)
    )
    used = " + ".join(f"CASE WHEN s.e > {k} THEN (p.x{k} - s.x{k}) * (p.x{k} - s.x{k}) ELSE 0.0 END" for k in range(max_e))
    known = " AND ".join(f"(g.e <= {k} OR t.x{k} IS NOT NULL)" for k in range(max_e))
    return f""",
glag AS (SELECT variable, row_id, {lagged} FROM long),
gpairs AS ({each}),
gnear AS (SELECT *, row_number() OVER (PARTITION BY variable, e, p ORDER BY d2, l) AS rank FROM gpairs WHERE d2 IS NOT NULL AND variable IN ({some}) QUALIFY rank <= e + 1),
gw AS (SELECT *, {_WEIGHT} AS w FROM (SELECT variable, e, p, y, sqrt(d2) AS d, min(sqrt(d2)) OVER (PARTITION BY variable, e, p) AS m FROM gnear)),
gfc AS (SELECT variable, e, p, sum(w * y) / sum(w) AS pred FROM gw GROUP BY ALL),
gcurve AS (SELECT variable, e, corr(o.{TARGET}, pred) AS rho FROM gfc c JOIN smooth o ON o.row_id = c.p + 1 GROUP BY ALL),
gbest AS (SELECT variable, e, round(rho, 4) AS rho FROM gcurve WHERE rho IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variable ORDER BY round(rho, 4) DESC, e) = 1),
cspace AS (  -- the target's lags, as many as the candidate's dimension, and the candidate one row later
  SELECT g.variable, g.e, t.row_id, {', '.join(f't.x{k}' for k in range(max_e))}, y.value AS y
  FROM gbest g JOIN glag t ON t.variable = '{TARGET}' JOIN long y ON y.variable = g.variable AND y.row_id = t.row_id + 1 WHERE {known}
),
csizes AS (SELECT CAST(floor(c * unnest([{', '.join(map(str, percents))}]) / 100) AS INTEGER) AS size FROM (SELECT count(*) AS c FROM smooth)),
cdrawn AS (
  SELECT variable, size, draw, row_id AS l FROM cspace, csizes, (SELECT unnest(range({sample})) AS draw) WHERE y IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY variable, size, draw ORDER BY md5('0/' || size || '/' || draw || '/' || row_id), row_id) <= size
),
cpairs AS (
  SELECT d.variable, s.e, d.size, d.draw, p.row_id AS p, d.l, s.y, {used} AS d2
  FROM cdrawn d JOIN cspace s ON s.variable = d.variable AND s.row_id = d.l JOIN cspace p ON p.variable = d.variable AND p.row_id <> d.l
),
cnear AS (SELECT *, row_number() OVER (PARTITION BY variable, size, draw, p ORDER BY d2, l) AS rank FROM cpairs QUALIFY rank <= e + 1),
cw AS (SELECT *, {_WEIGHT} AS w FROM (SELECT variable, size, draw, p, y, sqrt(d2) AS d, min(sqrt(d2)) OVER (PARTITION BY variable, size, draw, p) AS m FROM cnear)),
cfc AS (SELECT variable, size, draw, p, sum(w * y) / sum(w) AS pred FROM cw GROUP BY ALL),
ceach AS (SELECT c.variable, size, draw, corr(o.y, pred) AS rho FROM cfc c JOIN cspace o ON o.variable = c.variable AND o.row_id = c.p GROUP BY ALL),
ccurve AS (SELECT variable, size, avg(rho) AS rho FROM ceach GROUP BY ALL),
gate AS (
  SELECT variable, g.e, g.rho, coalesce(slope, 0.0) AS slope
  FROM gbest g LEFT JOIN (SELECT variable, round(regr_slope(coalesce(c.rho, 0.0), size / s.c), 5) AS slope FROM ccurve c, (SELECT count(*) AS c FROM smooth) s GROUP BY variable) USING (variable)
)"""


_TWO = _two(OTHERS)
_CHOSEN = "SELECT 1 AS dim, variable, round(rho, 6) AS rho FROM win UNION ALL SELECT 2, variable, round(rho, 6) FROM second"
_PASSING = [a for a, b, s in SLOPES if b == TARGET and s is not None and s > 0.01]
_RANKED = (
    f"SELECT 1 AS dim, row_number() OVER (ORDER BY rho DESC, {_order(OTHERS)}) AS rank, variable, round(rho, 6) AS rho FROM swept WHERE rho > -1.0 "
    f"UNION ALL SELECT 2, row_number() OVER (ORDER BY rho DESC, {_order(OTHERS)}), variable, round(rho, 6) FROM swept2 WHERE rho > -1.0"
)


def _edim(max_e: int) -> str:
    """CTE curve (e, rho) for the lags of n_orders."""
    lagged = ", ".join(f"lag(n_orders, {k}) OVER (ORDER BY row_id) AS x{k}" if k else "n_orders AS x0" for k in range(max_e))
    each = "\nUNION ALL ".join(
        f"SELECT {e} AS e, p.row_id AS p, l.row_id AS l, y.{TARGET} AS y, {_square([f'x{k}' for k in range(e)])} AS d2 FROM lagged p JOIN lagged l ON p.row_id <> l.row_id "
        f"JOIN smooth y ON y.row_id = l.row_id + 1 WHERE {_HALVES[0]} AND {_HALVES[1]}" for e in range(1, max_e + 1)
    )
    return f""",
lagged AS (SELECT row_id, {lagged} FROM smooth),
pairs AS ({each}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY e, p ORDER BY d2, l) AS rank FROM pairs WHERE d2 IS NOT NULL QUALIFY rank <= e + 1),
near AS (SELECT *, {_WEIGHT} AS w FROM (SELECT e, p, y, sqrt(d2) AS d, min(sqrt(d2)) OVER (PARTITION BY e, p) AS m FROM ranked)),
cast_ AS (SELECT e, p, sum(w * y) / sum(w) AS pred FROM near GROUP BY ALL),
curve AS (SELECT e, corr(o.{TARGET}, pred) AS rho FROM cast_ c JOIN smooth o ON o.row_id = c.p + 1 GROUP BY e)"""


def _draws(rows: str, sizes, sample: int, seed: int) -> str:
    key = f"md5('{seed}/' || size || '/' || draw || '/' || row_id)"
    return f"""
drawn AS (
  SELECT size, draw, row_id AS l FROM {rows}, (SELECT unnest([{', '.join(map(str, sizes))}]) AS size), (SELECT unnest(range({sample})) AS draw)
  QUALIFY row_number() OVER (PARTITION BY size, draw ORDER BY {key}, row_id) <= size
)"""


_CCM = (
    _SMOOTH + ",\nspace AS (SELECT s.row_id, y.n_orders AS y, s.revenue AS x0, b.revenue AS x1 FROM smooth s JOIN smooth b ON b.row_id = s.row_id - 1 JOIN smooth y ON y.row_id = s.row_id + 1),"
    + _draws("space", (20, 80, 160), 3, 0) + f""",
pairs AS (SELECT size, draw, p.row_id AS p, l, l_.y AS y, {_square(['x0', 'x1']).replace('l.', 'l_.')} AS d2 FROM drawn JOIN space l_ ON l_.row_id = l JOIN space p ON p.row_id <> l),
ranked AS (SELECT *, row_number() OVER (PARTITION BY size, draw, p ORDER BY d2, l) AS rank FROM pairs QUALIFY rank <= 3),
near AS (SELECT *, {_WEIGHT} AS w FROM (SELECT size, draw, p, y, sqrt(d2) AS d, min(sqrt(d2)) OVER (PARTITION BY size, draw, p) AS m FROM ranked)),
cast_ AS (SELECT size, draw, p, sum(w * y) / sum(w) AS pred FROM near GROUP BY ALL),
each AS (SELECT size, draw, corr(o.y, pred) AS rho FROM cast_ c JOIN space o ON o.row_id = c.p GROUP BY ALL),
curve AS (SELECT size, avg(rho) AS rho FROM each GROUP BY size)"""
)
_MATRIX = "matrix AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {'NULL' if s is None else f'CAST({s} AS DOUBLE)'})" for a, b, s in SLOPES) + ") t(source, predicted, slope))"


def _best_of(target: str, exclude: list[str], tag: str) -> str:
    names = [c for c in WEEKLY if c not in exclude]
    return _sweep(names, tag=tag, target=target) + f",\nwin{tag} AS (SELECT variable, rho FROM swept{tag} WHERE rho > -1.0 ORDER BY rho DESC, {_order(names)} LIMIT 1)"


def _graph() -> str:
    """The best driver of each variable, as a child run sees it; the walk from the root is recursive."""
    ctes = _SMOOTH + _LONG
    for c in WEEKLY:
        ctes += _best_of(c, sorted({TARGET, c}), f"_{c}")
    best = " UNION ALL ".join(f"SELECT '{c}' AS target, variable AS driver, rho FROM win_{c}" for c in WEEKLY)
    return f"""RECURSIVE {ctes.strip()},
best AS ({best}),
walk(target, depth, parent, path) AS (
  SELECT '{TARGET}', 0, CAST(NULL AS VARCHAR), ['{TARGET}']
  UNION ALL
  SELECT b.driver, w.depth + 1, w.target, list_append(w.path, b.driver) FROM walk w JOIN best b ON b.target = w.target
  WHERE w.depth < 2 AND NOT list_contains(w.path, b.driver)
)"""


_KNN2 = _SMOOTH + _near(["n_orders", "n_lines"], 3)
_SIM2 = _SMOOTH + _near(["n_orders", "n_cust"], 3) + _aligned()
_METRIC = "count(*) FILTER (obs IS NOT NULL AND pred IS NOT NULL) AS n, corr(obs, pred) AS rho, avg(abs(obs - pred)) AS mae, sqrt(avg((obs - pred) * (obs - pred))) AS rmse, sum(abs(obs - pred)) AS cae"
_LAGGED3 = ", ".join(["n_orders AS x0", "lag(n_orders, 1) OVER (ORDER BY row_id) AS x1", "lag(n_orders, 2) OVER (ORDER BY row_id) AS x2"])
_HALF = "CASE WHEN row_id <= 172 THEN 'a' ELSE 'b' END AS half"
_REPORT = f"SELECT 'simplex' AS method, round(cae, 2) AS cae, round(rmse, 3) AS rmse, round(rho, 3) AS rho, round(round(rho, 3) * round(rho, 3), 3) AS r2 FROM (SELECT {_METRIC} FROM aligned)"
_ALL_ROWS = {"lib": "true", "pred": "true"}

SQL = {
    "panel_weekly": _q(_WEEKLY, "SELECT * FROM weekly"),
    "panel_smooth": _q(_SMOOTH, "SELECT * FROM smooth"),
    "panel_hourly_dense": _q(_HOURLY, "SELECT * FROM hourly"),
    "panel_long": _q(_SMOOTH + _LONG, "SELECT row_id, variable, value FROM long"),
    "numeric_cast": _q(_WEEKLY, "SELECT row_id, n_orders, qty FROM weekly"),
    "in_memory_panel": _q(_WEEKLY, "SELECT row_id, n_orders, n_cust, n_lines, revenue, ext FROM weekly"),
    "column_match": _q(_WEEKLY, "SELECT row_id, n_orders, n_cust, n_lines, revenue FROM weekly"),
    "column_choice": _q(_WEEKLY, "SELECT row_id, revenue, n_cust, ext FROM weekly"),
    "dropped_columns": _q(_WEEKLY, "SELECT row_id, revenue, n_cust, n_lines, qty, ext FROM weekly"),
    "candidate_set": "SELECT * FROM (VALUES (0, 'n_orders'), (1, 'revenue'), (2, 'n_lines'), (3, 'ext')) t(ord, variable)",
    "lag_embed": _q(_SMOOTH, "SELECT row_id, revenue AS lag0, lag(revenue, 2) OVER (ORDER BY row_id) AS lag1, lag(revenue, 4) OVER (ORDER BY row_id) AS lag2 FROM smooth"),
    "lead_target": _q(_SMOOTH, "SELECT row_id, revenue, lead(revenue, 3) OVER (ORDER BY row_id) AS later FROM smooth"),
    "with_delays": _q(_SMOOTH, "SELECT row_id, qty, ext, lag(qty, 1) OVER (ORDER BY row_id) AS qty_1, lag(qty, 2) OVER (ORDER BY row_id) AS qty_2 FROM smooth"),
    "lib_pred_split": _q(_SMOOTH, "SELECT row_id, row_id <= half AS in_lib, row_id > half AS in_pred FROM smooth, n"),
    "library_rows": _q(_SMOOTH, "SELECT s.row_id, y.revenue AS y, s.row_id + 2 <= half AS trimmed FROM smooth s, n, smooth y WHERE y.row_id = s.row_id + 2 AND s.row_id <= half"),
    "row_ranges": _q(_SMOOTH, "SELECT row_id, revenue FROM smooth WHERE row_id BETWEEN 1 AND 10 OR row_id BETWEEN 51 AND 60 OR row_id = 100"),
    "ccm_sizes": _q(_SMOOTH, "SELECT i - 1 AS ord, CAST(floor(n * p / 100) AS INTEGER) AS size FROM n, (SELECT unnest([1, 2, 3, 4]) AS i, unnest([10, 15, 85, 90]) AS p)"),
    "knn_pairs": _q(_KNN2, "SELECT p, l, rank, round(d, 6) AS d FROM near"),
    "knn_excluded": _q(_SMOOTH + _near(["n_cust"], 2, radius=4, **_ALL_ROWS), "SELECT p, l, rank, round(d, 6) AS d FROM near"),
    "neighbor_weights": _q(_KNN2, "SELECT p, l, round(w, 6) AS w FROM near"),
    "simplex_predict": _q(_SIM2, "SELECT row_id, obs, round(pred, 6) AS pred, round(pred_var) AS pred_var FROM aligned"),
    "simplex_embedded": _q(
        _SMOOTH + f",\nlagged AS (SELECT row_id, revenue, {_LAGGED3} FROM smooth)" + _near(["x0", "x1", "x2"], 4, panel="lagged", tp=2) + _aligned(2),
        "SELECT row_id, obs, round(pred, 6) AS pred FROM aligned",
    ),
    "forecast_metrics": _q(_SIM2, f"SELECT n, round(rho, 6) AS rho, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(cae, 6) AS cae FROM (SELECT {_METRIC} FROM aligned)"),
    "reported_metrics": _q(_SIM2, f"SELECT round(cae, 2) AS cae, round(rmse, 3) AS rmse, round(rho, 3) AS rho, round(round(rho, 3) * round(rho, 3), 3) AS r2 FROM (SELECT {_METRIC} FROM aligned)"),
    "cross_map_rank": _q(_SMOOTH + _LONG + _sweep(OTHERS), _RHO),
    "cross_map_blocks": _q(_SMOOTH + _LONG + _sweep(OTHERS), _RHO),
    "cross_map_given": _q(
        _SMOOTH + _LONG + _sweep(["qty", "ext"], _square(["n_orders"]), k=3) + _sweep(["n_lines"], tag="2"),
        "SELECT variable || ',n_orders' AS columns, 'revenue' AS target, round(rho, 6) AS rho FROM swept UNION ALL SELECT variable, 'revenue', round(rho, 6) FROM swept2",
    ),
    "cross_map_all_rows": _q(_SMOOTH + _LONG + _sweep(["n_orders", "qty"], **_ALL_ROWS), "SELECT variable AS columns, round(rho, 6) AS rho FROM swept"),
    "greedy_expand_2d": _q(_TWO, _CHOSEN),
    "expand_with_matrix": _q(_two(_PASSING), _CHOSEN),
    "greedy_rankings": _q(_TWO, _RANKED),
    "top_ranked": _q(_TWO, f"SELECT * FROM ({_RANKED}) WHERE rank <= 2"),
    "embed_dimension": _q(_SMOOTH + _edim(4), "SELECT e, round(rho, 6) AS rho FROM curve"),
    "best_e": _q(_SMOOTH + _edim(4), "SELECT e, round(rho, 6) AS rho FROM curve ORDER BY round(rho, 4) DESC, e LIMIT 1"),
    "first_peak_e": _q(
        _SMOOTH + _edim(4),
        "SELECT e, round(rho, 6) AS rho FROM (SELECT *, round(rho, 4) AS r, lag(round(rho, 4)) OVER (ORDER BY e) AS a, lead(round(rho, 4)) OVER (ORDER BY e) AS b FROM curve) ORDER BY coalesce(r > a AND r > b, false) DESC, CASE WHEN coalesce(r > a AND r > b, false) THEN e ELSE -e END LIMIT 1",
    ),
    "best_dimension": _q(
        _TWO + _third(),
        "SELECT CAST(dim AS INTEGER) AS dim FROM (SELECT 1 AS dim, rho FROM win UNION ALL SELECT 2, rho FROM second UNION ALL SELECT 3, rho FROM third) ORDER BY round(rho, 4) DESC, dim LIMIT 1",
    ),
    "time_delays": _q(
        _TWO + f",\nwide AS (SELECT s.row_id, s.{TARGET}, v.value AS x FROM smooth s JOIN long v USING (row_id) JOIN win USING (variable))",
        f"SELECT '{TARGET}' AS eval_column, 2 AS delays, round({_delayed(TARGET)}, 6) AS rho UNION ALL SELECT variable, 2, round({_delayed('x')}, 6) FROM win",
    ),
    "edim_map": _q(
        _SMOOTH + _LONG + _sweep(OTHERS) + _gates(4, (10, 30, 90), 3) + f""",
ranks AS (
  SELECT variable, g.e, g.rho, g.rho >= 0.0 AND slope > 0.0 AS passes, row_number() OVER (ORDER BY s.rho DESC, {_order(OTHERS)}) AS rank
  FROM swept s JOIN gate g USING (variable) WHERE s.rho > 0.0
)""",
        f"SELECT variable, '{TARGET}' AS target, e, rho, passes AS accepted FROM ranks WHERE rho >= 0.0 AND rank <= coalesce((SELECT min(rank) FROM ranks WHERE passes), 99)",
    ),
    "greedy_expand_gated": _q(
        _two(OTHERS, _gates(4, (10, 30, 60, 90), 5), "rho > 0.0 AND variable IN (SELECT variable FROM gate WHERE rho >= 0.0 AND slope > 0.0)"), _CHOSEN
    ),
    "embed_dimension_blocks": _q(_SMOOTH + _edim(4), "SELECT e, round(rho, 6) AS rho FROM curve"),
    "evaluate_simplex": _q(_SIM2, _REPORT),
    "evaluate_pca": _q(
        _SMOOTH + """,
moments AS (
  SELECT avg(n_orders) AS mx, avg(n_lines) AS my, var_samp(n_orders) AS sxx, var_samp(n_lines) AS syy, covar_samp(n_orders, n_lines) AS sxy FROM smooth, n WHERE row_id <= half
),
axis AS (SELECT *, (sxx + syy) / 2 + sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy) - sxx AS along FROM moments),
scores AS (SELECT row_id, revenue AS obs, (sxy * (n_orders - mx) + along * (n_lines - my)) / sqrt(sxy * sxy + along * along) AS c FROM smooth, axis),
line AS (SELECT regr_slope(obs, c) AS b, regr_intercept(obs, c) AS a FROM scores, n WHERE row_id <= half),
aligned AS (SELECT row_id, obs, a + b * c AS pred FROM scores, line, n WHERE row_id > half)""",
        f"SELECT 'pca' AS method, round(cae, 2) AS cae, round(rmse, 3) AS rmse, round(rho, 3) AS rho, round(round(rho, 3) * round(rho, 3), 3) AS r2 FROM (SELECT {_METRIC} FROM aligned)",
    ),
    "evaluate_all_rows": _q(
        _SMOOTH + _near(["n_orders", "n_cust"], 3, **_ALL_ROWS) + ",\naligned AS (SELECT o.revenue AS obs, pred FROM forecast f JOIN smooth o ON o.row_id = f.p + 1)", _REPORT
    ),
    "evaluate_embedded": _q(
        _SMOOTH + f",\nlagged AS (SELECT row_id, revenue, {_LAGGED3} FROM smooth)" + _near(["x0", "x1", "x2"], 4, panel="lagged") + _aligned(), _REPORT
    ),
    "pca_explained": _q(
        _SMOOTH + """,
moments AS (SELECT var_samp(n_orders) AS sxx, var_samp(n_lines) AS syy, covar_samp(n_orders, n_lines) AS sxy FROM smooth, n WHERE row_id <= half),
halves AS (SELECT (sxx + syy) / 2 AS m, sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy) AS r FROM moments)""",
        "SELECT component, round(0.5 + CASE component WHEN 0 THEN r ELSE -r END / (2 * m), 6) AS ratio FROM halves, (SELECT unnest([0, 1]) AS component)",
    ),
    "diffusion_neighbors": _q(
        _SMOOTH + f""",
pairs AS (SELECT p.row_id AS p, l.row_id AS l, {_square(['n_orders', 'n_lines'])} AS d2 FROM smooth p JOIN smooth l ON p.row_id <> l.row_id WHERE {_HALVES[0]} AND {_HALVES[1]})""",
        "SELECT p, l, round(d2, 6) AS d2 FROM pairs QUALIFY row_number() OVER (PARTITION BY p ORDER BY d2, l) <= 5",
    ),
    "csv_scan": _q(_WEEKLY, "SELECT row_id, n_orders, n_cust, n_lines, revenue, ext FROM weekly"),
    "feather_scan": _q(_WEEKLY, "SELECT row_id, revenue, n_cust, n_lines, qty, ext FROM weekly"),
    "npy_scan": _q(_WEEKLY, "SELECT row_id, n_orders, revenue, n_cust AS c0, n_lines AS c1, qty AS c2, ext AS c3 FROM weekly"),
    "npz_member": _q(_WEEKLY, "SELECT row_id, revenue AS c1, qty AS c4 FROM weekly"),
    "slope_csv": _q(_MATRIX, "SELECT source, predicted, slope FROM matrix"),
    "slope_feather": _q(_MATRIX, "SELECT source, predicted, slope FROM matrix"),
    "result_csv": _q(_TWO, _CHOSEN),
    "result_tables": _q(_TWO, f"SELECT * FROM ({_RANKED}) WHERE rank <= 2"),
    "graph_tables": "WITH " + _graph() + "\nSELECT w.target, b.driver, 1 AS rank, round(b.rho, 6) AS rho FROM walk w JOIN best b USING (target)",
    "target_csvs": "WITH " + _graph() + "\nSELECT w.target, b.driver, round(b.rho, 6) AS rho FROM walk w JOIN best b USING (target)",
    "library_draws": _q(_SMOOTH + "," + _draws("smooth", (20, 80), 2, 7), "SELECT size, draw, l FROM drawn"),
    "ccm_curve": _q(_CCM, "SELECT size, round(rho, 6) AS rho FROM curve"),
    "ccm_curve_blocks": _q(_CCM, "SELECT size, round(rho, 6) AS rho FROM curve"),
    "ccm_slope": _q(_CCM, "SELECT round(regr_slope(rho, size / n), 5) AS slope FROM curve, n"),
    "slope_matrix_lookup": _q(_MATRIX, f"SELECT r.source AS candidate, r.slope AS by_row, c.slope AS by_column FROM matrix r JOIN matrix c ON c.predicted = r.source AND c.source = '{TARGET}' WHERE r.predicted = '{TARGET}'"),
    "slope_matrix_wide": _q(_MATRIX, "SELECT source, " + ", ".join(f"max(slope) FILTER (predicted = '{c}') AS {c}" for c in WEEKLY) + " FROM matrix GROUP BY source"),
    "slope_matrix_long": _q(_MATRIX, "SELECT source, predicted, slope FROM matrix"),
    "passing_subset": _q(_SMOOTH + _LONG + _sweep(OTHERS) + ",\n" + _MATRIX, f"SELECT variable, round(rho, 6) AS rho, slope FROM swept JOIN matrix ON source = variable AND predicted = '{TARGET}' WHERE slope > 0.01"),
    "driver_graph": "WITH " + _graph() + "\nSELECT w.target, b.driver, 1 AS rank, round(b.rho, 6) AS rho FROM walk w JOIN best b USING (target)",
    "driver_nodes": "WITH " + _graph() + "\nSELECT target, depth, parent, depth AS visit_order FROM walk",
    "seeded_graph": "SELECT * FROM (VALUES ('revenue', 'qty', 1, CAST(NULL AS DOUBLE)), ('revenue', 'ext', 2, NULL)) t(target, driver, rank, rho)",
    "embedding_knn": _q(_vectors(4) + _near(["e0", "e1"], 3, panel="vectors", target="e3"), "SELECT p, l, rank, round(d, 6) AS d FROM near"),
    "embedding_knn_blocks": _q(_vectors(4) + _near(["e0", "e1"], 3, panel="vectors", target="e3"), "SELECT p, l, rank, round(d, 6) AS d FROM near"),
    "embedding_crossmap": _q(
        _vectors(8) + _sweep([f"e{i}" for i in range(2, 8)], _square(["e1"]), k=3, panel="vectors", target="e0"), "SELECT variable, round(rho, 6) AS rho FROM swept"
    ),
    "embedding_wide": _q(_vectors(64) + _sweep([f"e{i}" for i in range(1, 64)], panel="vectors", target="e0"), "SELECT variable, round(rho, 6) AS rho FROM swept"),
    "hourly_sweep": _q(
        _HOURLY + ",\nn AS (SELECT count(*) // 2 AS half FROM hourly),\nlong AS (" + " UNION ALL ".join(f"SELECT row_id, '{c}' AS variable, {c} AS value FROM hourly" for c in ("n_view", "v_view", "v_error")) + ")"
        + _sweep(["n_view", "v_view", "v_error"], panel="hourly", target="n_click", radius=2),
        "SELECT variable, round(rho, 6) AS rho FROM swept",
    ),
    "minmax_scale": _q(_SMOOTH, "SELECT row_id, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in ("revenue", "qty")) + ", 0.0::DOUBLE AS flat FROM smooth"),
    "ols_single": _q(_SMOOTH, f"SELECT half, round(regr_slope(revenue, n_orders), 6) AS slope, round(regr_intercept(revenue, n_orders), 6) AS intercept FROM (SELECT *, {_HALF} FROM smooth) GROUP BY half"),
    "linear_fit": _q(
        _SMOOTH,
        "SELECT row_id, revenue AS obs, round(a + b * n_orders, 4) AS pred FROM smooth, n, (SELECT regr_slope(revenue, n_orders) AS b, regr_intercept(revenue, n_orders) AS a FROM smooth, n WHERE row_id <= half) WHERE row_id > half",
    ),
    "best_per_half": _q(_SMOOTH, f"SELECT half, row_id, revenue, row_number() OVER (PARTITION BY half ORDER BY revenue DESC, row_id) AS rank FROM (SELECT *, {_HALF} FROM smooth) QUALIFY rank <= 3"),
}
