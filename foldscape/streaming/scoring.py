"""Micro-batch scoring: forecasts for rows that arrive in a stream, from a fixed library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscape.operators.blocks import block_neighbors
from foldscape.operators.neighbors import RELATIONAL_PAIRS, library, nearest, pair_table
from foldscape.operators.panel import ROW
from foldscape.operators.simplex import project


def score_batch(lib: DataFrame, batch: DataFrame, columns: list[str], lib_rows: int | None = None) -> DataFrame:
    """row_id (of the arrival) and its forecast; `lib` as from neighbors.library. In blocks where rows times library are many."""
    k = len(columns) + 1
    many = (lib.count() if lib_rows is None else lib_rows) * batch.count() > RELATIONAL_PAIRS
    near = nearest(block_neighbors(lib, batch, columns, 0, k) if many else pair_table(lib, batch, columns, [], 0), [], k)
    return project(near, []).select(F.col("p").alias(ROW), "pred", "pred_var")


def score_stream(panel: DataFrame, stream: DataFrame, columns: list[str], target: str, spans, tp: int, sink: str, checkpoint: str):
    """Write forecasts of each micro-batch of `stream` (row_id and columns) to Parquet at `sink`, a folder a batch."""
    lib = library(panel, target, spans, tp).select(ROW, "_y", *columns).persist()
    lib_rows = lib.count()

    def write(batch: DataFrame, epoch: int) -> None:
        score_batch(lib, batch, columns, lib_rows).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
