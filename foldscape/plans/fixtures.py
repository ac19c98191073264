"""Panels made of the test tables, and the queries that run each operator on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldscape.operators.panel import ROW

WEEKLY = ["n_orders", "revenue", "n_cust", "n_lines", "qty", "ext"]
TYPES = ["click", "error", "purchase", "signup", "view"]
TARGET = "revenue"
OTHERS = [c for c in WEEKLY if c != TARGET]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly orders and shipments, numbered by week. The window is over weeks, not rows."""
    o = _table(spark, sf_dir, "orders").groupBy(F.date_trunc("week", "o_orderdate").alias("w")).agg(
        F.count("*").cast("double").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.countDistinct("o_custkey").cast("double").alias("n_cust")
    )
    l = _table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").alias("w")).agg(  # noqa: E741
        F.count("*").cast("double").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("ext")
    )
    rows = o.join(l, "w").withColumn(ROW, F.row_number().over(Window.orderBy("w")).cast("long"))
    return rows.select(ROW, F.col("w").cast("timestamp").cast("string").alias("w"), *WEEKLY)


def panel_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 8-week means of panel_weekly."""
    own = Window.orderBy(ROW).rowsBetween(-7, 0)
    return panel_weekly(spark, sf_dir).select(ROW, *[F.round(F.avg(c).over(own), 6).alias(c) for c in WEEKLY])


def panel_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mean values of events by hour and type; hours without events are filled in: count 0, mean null."""
    events = _table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("h"), "event_type", "value")
    found = events.groupBy("h").agg(
        *[F.count(F.when(F.col("event_type") == t, 1)).cast("double").alias(f"n_{t}") for t in TYPES],
        *[F.round(F.avg(F.when(F.col("event_type") == t, F.col("value"))), 6).alias(f"v_{t}") for t in TYPES],
    )
    ends = events.agg(F.min("h").alias("a"), F.max("h").alias("b"))
    hours = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("h"))
    rows = hours.join(found, "h", "left").fillna(0.0, [f"n_{t}" for t in TYPES])
    return rows.withColumn(ROW, F.row_number().over(Window.orderBy("h")).cast("long")).select(
        ROW, F.col("h").cast("timestamp").cast("string").alias("h"), *[f"n_{t}" for t in TYPES], *[f"v_{t}" for t in TYPES]
    )


def panel_embedding(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """Embeddings as a panel of dimensions, a row a vector."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") + 1).alias(ROW), *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"e{i}") for i in range(dims)])
