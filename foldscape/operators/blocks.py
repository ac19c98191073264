"""The vectorised strategy: exact nearest neighbours over blocks of rows and candidates.

Rows are cut into blocks and candidates into chunks, and each block and chunk is
packed into one row of numbers. A task has one block to predict, one block of
library rows and one chunk of candidates, computes their distances with numpy, and
passes on the nearest neighbours that it saw; a second task merges these for its
rows and candidates. Blocks reach their tasks by block numbers; nothing is
broadcast, and what a task holds is bounded by block and chunk sizes, whatever the
panel's size.

A candidate's space is its own column and those that all candidates share; or, for
lags of one column, its own and all before it, whose distances are running sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldscape.functions.stats import LEAST_WEIGHT
from foldscape.operators.neighbors import library, predicted
from foldscape.operators.panel import ROW, lags, lead

BLOCK_ROWS, CHUNK = 1024, 16

_PACKED = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("rows", pa.binary()), ("v", pa.binary()), ("b", pa.binary()), ("x", pa.binary())])
_PACKED_DDL = "block long, chunk int, rows binary, v binary, b binary, x binary"
_NEAR = np.dtype([("i", "<i4"), ("p", "<i8"), ("d2", "<f8"), ("l", "<i8"), ("y", "<f8")])
_NEAR_SCHEMA = pa.schema([("pblock", pa.int64()), ("chunk", pa.int32()), ("near", pa.binary())])
_NEAR_DDL = "pblock long, chunk int, near binary"


def _table(schema: pa.Schema, columns) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack(df: DataFrame, value: Column, base: list[str], names: list[str], chunk: int) -> DataFrame:
    """Blocks of the panel's rows: row numbers, a value of each, base coordinates, and a chunk of the candidates' values."""
    numbers = [F.col(f"`{c}`").cast("double").alias(f"n{i}") for i, c in enumerate([*base, *names])]
    rows = df.select(F.floor(F.col(ROW) / BLOCK_ROWS).cast("long").alias("block"), F.col(ROW).cast("long").alias("row"), value.cast("double").alias("v"), *numbers)

    def run(key, t):
        order = np.argsort(t["row"].to_numpy())
        column = lambda c: t[c].to_numpy(zero_copy_only=False).astype(float)[order]  # noqa: E731  nulls become NaN
        matrix = lambda a, b: np.stack([column(f"n{i}") for i in range(a, b)], 1).tobytes() if b > a else b""
        shared = (t["row"].to_numpy()[order].astype("<i8").tobytes(), column("v").tobytes(), matrix(0, len(base)))
        first, last = len(base), len(base) + len(names)
        parts = [(key[0].as_py(), j, *shared, matrix(a, min(a + chunk, last))) for j, a in enumerate(range(first, max(last, first + 1), chunk))]
        return _table(_PACKED, zip(*parts, strict=True))

    return rows.groupBy("block").applyInArrow(run, _PACKED_DDL)


def _ranked(near: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each candidate and row, as many as `ks` says, ties by library row; and where each group begins."""
    near = near[np.lexsort((near["l"], near["d2"], near["p"], near["i"]))]
    head = np.flatnonzero(np.append(True, (near["p"][1:] != near["p"][:-1]) | (near["i"][1:] != near["i"][:-1]))) if len(near) else np.zeros(0, np.int64)
    rank = np.arange(len(near)) - np.repeat(head, np.diff(np.append(head, len(near))))
    stays = rank < ks[near["i"]]
    return near[stays], np.flatnonzero(rank[stays] == 0)


def _first(ks: np.ndarray, n_base: int, radius: int, running: bool):
    """The nearest library rows of one block, for each candidate of a chunk and row of a block to predict."""

    def run(key, t):
        sides = {r["pred"]: r for r in t.to_pylist()}
        found = []
        if len(sides) == 2:
            pr, lr = (np.frombuffer(sides[s]["rows"], "<i8") for s in (True, False))
            y = np.frombuffer(sides[False]["v"], float)
            bp, bl = (np.frombuffer(sides[s]["b"], float).reshape(-1, n_base) if n_base else np.zeros((0, 0)) for s in (True, False))
            xp, xl = (np.frombuffer(sides[s]["x"], float).reshape(len(r), -1) for s, r in ((True, pr), (False, lr)))
            base = np.zeros((len(pr), len(lr)))
            for j in range(n_base):
                base += (bp[:, j, None] - bl[None, :, j]) ** 2
            base[np.abs(pr[:, None] - lr[None, :]) <= radius] = np.nan
            for i in range(max(1, xp.shape[1])):
                d2 = base + (xp[:, i, None] - xl[None, :, i]) ** 2 if xp.shape[1] else base.copy()
                if running:
                    base = d2.copy()
                d2[np.isnan(d2)] = np.inf
                k = min(int(ks[i]), len(lr))
                kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
                at, to = np.nonzero((d2 <= kth[:, None]) & np.isfinite(d2))
                near = np.empty(len(at), _NEAR)
                near["i"], near["p"], near["d2"], near["l"], near["y"] = i, pr[at], d2[at, to], lr[to], y[to]
                found.append(_ranked(near, ks)[0])
        return _table(_NEAR_SCHEMA, [[key[0].as_py()], [key[2].as_py()], [np.concatenate(found).tobytes()]] if found else [[]] * 3)

    return run


def _nearest(lib: DataFrame, pred: DataFrame, base: list[str], names: list[str], ks: list[int], radius: int, running: bool = False) -> DataFrame:
    """What each pair of blocks saw: rows of _NEAR_DDL. `lib` has `_y`; `ks`: neighbours of each candidate of a chunk."""
    chunk = max(1, len(names)) if running else CHUNK
    sides = {True: _pack(pred, F.lit(0.0), base, names, chunk), False: _pack(lib, F.col("_y"), base, names, chunk)}
    ends = {s: df.agg(F.floor(F.min(ROW) / BLOCK_ROWS).cast("long").alias("a"), F.floor(F.max(ROW) / BLOCK_ROWS).cast("long").alias("b")).first() for s, df in ((True, pred), (False, lib))}
    dealt = None
    for side, packed in sides.items():
        other = ends[not side]
        blocks = F.sequence(F.lit(other["a"]), F.lit(other["b"])) if other["a"] is not None else F.array().cast("array<long>")
        mine, theirs = ("pblock", "lblock") if side else ("lblock", "pblock")
        rows = packed.withColumn("theirs", F.explode(blocks)).select(
            F.col("block").alias(mine), F.col("theirs").alias(theirs), "chunk", F.lit(side).alias("pred"), "rows", "v", "b", "x"
        ).select("pblock", "lblock", "chunk", "pred", "rows", "v", "b", "x")
        dealt = rows if dealt is None else dealt.unionByName(rows)
    return dealt.groupBy("pblock", "lblock", "chunk").applyInArrow(_first(np.array(ks), len(base), radius, running), _NEAR_DDL)


def _merged(ks: np.ndarray):
    """The nearest rows of all blocks."""
    schema = pa.schema([("p", pa.int64()), ("l", pa.int64()), ("y", pa.float64()), ("d2", pa.float64())])

    def run(key, t):
        near, _ = _ranked(np.frombuffer(b"".join(t["near"].to_pylist()), _NEAR), ks)
        return _table(schema, [near[c] for c in ("p", "l", "y", "d2")])

    return run


def block_neighbors(lib: DataFrame, pred: DataFrame, columns: list[str], radius: int, k: int) -> DataFrame:
    """p, l, y and d2 of the k nearest library rows of each row; `lib` has `_y`."""
    near = _nearest(lib, pred, columns, [], [k], radius)
    return near.groupBy("pblock", "chunk").applyInArrow(_merged(np.array([k])), "p long, l long, y double, d2 double")


def _forecast(ks: np.ndarray):
    """Forecasts from the nearest rows of all blocks."""
    schema = pa.schema([("chunk", pa.int32()), ("i", pa.int32()), ("p", pa.int64()), ("pred", pa.float64())])

    def run(key, t):
        near, head = _ranked(np.frombuffer(b"".join(t["near"].to_pylist()), _NEAR), ks)
        if not len(near):
            return _table(schema, [[]] * 4)
        d = np.sqrt(near["d2"])
        least = np.repeat(d[head], np.diff(np.append(head, len(near))))
        w = np.where(least > 0, np.exp(-d / np.where(least > 0, least, 1.0)), np.where(d == 0, 1.0, 0.0))
        w = np.maximum(w, LEAST_WEIGHT)
        forecast = np.add.reduceat(w * near["y"], head) / np.add.reduceat(w, head)
        return _table(schema, [np.full(len(head), key[1].as_py()), near["i"][head], near["p"][head], forecast])

    return run


def block_forecasts(df: DataFrame, base: list[str], names: list[str], target: str, lib, pred, tp: int, radius: int, tail: str = "keep") -> DataFrame:
    """variable, p, obs and pred of the projection on [variable, *base] for every variable."""
    ks = [len(base) + 2] * CHUNK
    near = _nearest(library(df, target, lib, tp, tail), predicted(df, pred), base, names, ks, radius)
    found = near.groupBy("pblock", "chunk").applyInArrow(_forecast(np.array(ks)), "chunk int, i int, p long, pred double")
    naming = df.sparkSession.createDataFrame([(j // CHUNK, j % CHUNK, n) for j, n in enumerate(names)], "chunk int, i int, variable string")
    obs = lead(df, target, tp, "obs").withColumnRenamed(ROW, "p")
    return found.join(F.broadcast(naming), ["chunk", "i"]).join(obs, "p", "left").select("variable", "p", "obs", "pred")


def block_embeddings(df: DataFrame, column: str, target: str, lib, pred, max_e: int, tp: int, tau: int, radius: int, tail: str = "keep") -> DataFrame:
    """e, p, obs and pred of the projection on the first e lags of a column, for e = 1 … max_e."""
    names = [f"{column}(t-{k})" for k in range(max_e)]
    space = lags(df, [column], max_e, tau)
    own = library(df, target, lib, tp, tail).select(ROW, "_y").join(space, ROW)
    ks = list(range(2, max_e + 2))
    near = _nearest(own, predicted(space, pred), [], names, ks, radius, running=True)
    found = near.groupBy("pblock", "chunk").applyInArrow(_forecast(np.array(ks)), "chunk int, i int, p long, pred double")
    obs = lead(df, target, tp, "obs").withColumnRenamed(ROW, "p")
    return found.join(obs, "p", "left").select((F.col("i") + 1).alias("e"), "p", "obs", "pred")
