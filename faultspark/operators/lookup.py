"""Bilinear values of grids at points, by equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import grid_meta, inverse_transform

MOST_NAMES = 10_000
BROADCAST_CELLS = 2_000_000  # 64 bytes each: at most about 128 MB go to every executor


def grid_cells(grid: DataFrame) -> DataFrame:
    """Per node (i along lon, j along lat) its value and those of the three nodes beyond, with the extent's numbers."""
    row = Window.partitionBy("grid_id", "lat_idx").orderBy("lon_idx")
    column = Window.partitionBy("grid_id", "lon_idx").orderBy("lat_idx")
    pairs = grid.select("grid_id", F.col("lon_idx").alias("i"), F.col("lat_idx").alias("j"), F.col("value").alias("v00"), F.lead("value").over(row).alias("v10"), "lon_idx", "lat_idx")
    return pairs.withColumn("v01", F.lead("v00").over(column)).withColumn("v11", F.lead("v10").over(column)).select("grid_id", "i", "j", "v00", "v10", "v01", "v11")


def _sized(cells: DataFrame) -> DataFrame:
    """Broadcast after a count of the nodes; beyond the bound the join shuffles."""
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def in_cells(points: DataFrame, meta: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """points with their grid's meta, their place in steps of its nodes (_fx, _fy), clamped to the border, and their cell i, j; null for no place or no grid."""
    px, py = F.col(x), F.col(y)
    fx = (px - F.col("x_min")) / (F.col("x_max") - F.col("x_min")) * (F.col("n_x") - 1)
    fy = (py - F.col("y_min")) / (F.col("y_max") - F.col("y_min")) * (F.col("n_y") - 1)
    clamp = lambda c, n: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, c)))
    placed = points.join(F.broadcast(meta), "grid_id", "left").withColumn("_fx", clamp(F.when(~F.isnan(px), fx), "n_x")).withColumn("_fy", clamp(F.when(~F.isnan(py), fy), "n_y"))  # one row a grid
    return placed.withColumn("i", F.floor("_fx").cast("int")).withColumn("j", F.floor("_fy").cast("int"))


def bilinear(v00: Column, v10: Column, v01: Column, v11: Column) -> Column:
    """The value at _fx, _fy of cell i, j; corners that are null take no part."""
    t, s = F.col("_fx") - F.col("i"), F.col("_fy") - F.col("j")
    part = lambda v, w: F.coalesce(v * w, F.lit(0.0))
    return part(v00, (1 - t) * (1 - s)) + part(v10, t * (1 - s)) + part(v01, (1 - t) * s) + part(v11, t * s)


def lookup_grid(points: DataFrame, grid: DataFrame, *, x: str = "lon", y: str = "lat", outside: str = "border", out: str = "value") -> DataFrame:
    """points (grid_id, x, y, ...) with the bilinear value.

    Positions are clamped to the border unless outside='null'. A NaN corner in use gives NaN, even at
    weight 0; corners beyond the last row or column take no part.
    """
    if outside not in ("border", "null"):
        raise ValueError("outside must be 'border' or 'null'")
    px, py = F.col(x), F.col(y)
    placed = in_cells(points, grid_meta(grid), x, y)
    inside = px.between(F.col("x_min"), F.col("x_max")) & py.between(F.col("y_min"), F.col("y_max")) if outside == "null" else F.lit(True)
    found = placed.join(_sized(grid_cells(grid)), ["grid_id", "i", "j"], "left")
    value = bilinear(*(F.col(c) for c in ("v00", "v10", "v01", "v11")))
    return found.withColumn(out, F.when(inside & F.col("v00").isNotNull(), value).otherwise(F.lit(float("nan")))).select(*[c for c in points.columns if c != out], out)


def on_each(rows: DataFrame, column: str, of: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """rows once for each distinct value of `column` in `of`. Up to `most` values (names of grids or moves) go into the plan; more are dealt into blocks of about as many, which rows meet one by one."""
    distinct = of.select(column).distinct()
    found = sorted(r[0] for r in distinct.limit(most + 1).collect())
    if len(found) > most:
        n = -(-distinct.count() // most)
        blocks = distinct.groupBy(F.pmod(F.xxhash64(column), F.lit(n)).alias("_block")).agg(F.collect_list(column).alias("_names"))
        each = rows.drop(column).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
        return each.join(blocks, "_block").withColumn(column, F.explode("_names")).drop("_block", "_names")
    values = F.array(*map(F.lit, found)) if found else F.array().cast(f"array<{of.schema[column].dataType.simpleString()}>")
    return rows.drop(column).withColumn(column, F.explode(values))


def lookup_many(points: DataFrame, grids: DataFrame, **how) -> DataFrame:
    """The same points against every grid of an ensemble; an error if the shapes differ."""
    shapes = grid_meta(grids).select("n_x", "n_y", "x_min", "x_max", "y_min", "y_max").distinct().limit(2).collect()
    if len(shapes) > 1:
        raise ValueError("the grids do not share one base grid")
    return lookup_grid(on_each(points, "grid_id", grids), grids, **how)


def lookup_transformed(points: DataFrame, grid: DataFrame, transforms: DataFrame, *, x: str = "lon", y: str = "lat", **how) -> DataFrame:
    """Values of the moved grid: points go through the inverse transform (transform_id, angle_deg, dx, dy, px, py), then are looked up.

    Points without a transform_id go through every transform.
    """
    each = points if "transform_id" in points.columns else on_each(points, "transform_id", transforms)
    both = each.join(transforms, "transform_id")
    bx, by = inverse_transform(*(F.col(c) for c in (x, y, "angle_deg", "dx", "dy", "px", "py")))
    found = lookup_grid(both.withColumns({"_x": bx, "_y": by}), grid, x="_x", y="_y", **how)
    return found.drop("_x", "_y", "angle_deg", "dx", "dy", "px", "py")
