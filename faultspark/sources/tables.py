"""Grids and polygons in, samples and CDFs out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import validate_grid


def read_coupling(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Grid nodes from long-form files with lat, lon, value and perhaps grid_id, in any order of columns; ordered and checked.

    CSV files have a header and are read by its names; text that is no number is an undefined value.
    """
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError("fmt must be 'parquet', 'csv' or 'json'")
    raw = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.schema("grid_id string, lat double, lon double, value double").json(path)
    if "grid_id" not in raw.columns:
        raw = raw.withColumn("grid_id", F.lit("grid"))
    number = lambda c: F.col(c).try_cast("double")
    nodes = raw.select(F.coalesce(F.col("grid_id"), F.lit("grid")).alias("grid_id"), number("lat").alias("lat"), number("lon").alias("lon"), F.coalesce(number("value"), F.lit(float("nan"))).alias("value"))
    return validate_grid(nodes).select("grid_id", "lat_idx", "lon_idx", "lat", "lon", "value")


def read_segment_polygons(spark: SparkSession, path: str) -> DataFrame:
    """seg_order, ring (array of x, y), strike and dip from a JSON list; the file's order is the order of choice."""
    raw = spark.read.option("multiLine", True).schema("polygon array<array<double>>, dip double, strike double").json(path)
    ring = F.transform("polygon", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return raw.select(F.monotonically_increasing_id().alias("seg_order"), ring.alias("ring"), "strike", "dip")


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    samples.write.mode(mode).partitionBy("event_id").parquet(path)


def wide_cdf(cdf: DataFrame, key: str, names: list | None = None) -> DataFrame:
    """One column for each key's CDF (names, if given, spare the pass that finds them), a row a level."""
    return cdf.groupBy("x_idx", "x").pivot(key, names).agg(F.first("cdf"))


def write_cdf(cdf: DataFrame, path: str, *, wide: bool = False, key: str = "k", mode: str = "errorifexists") -> None:
    (wide_cdf(cdf, key) if wide else cdf).write.mode(mode).parquet(path)
