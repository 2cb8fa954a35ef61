"""Grids in long form: grid_id, lat_idx, lon_idx, lat, lon, value (NaN where undefined)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp01, finite, nan_to_zero, wrap_longitude


def extent(df: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Lon/lat bounds per key, NaN left out; longitudes wrapped one by one and swapped if out of order."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    a, b = wrap_longitude(F.min(number(lon))), wrap_longitude(F.max(number(lon)))
    return df.groupBy(*keys).agg(F.least(a, b).alias("lon_min"), F.greatest(a, b).alias("lon_max"), F.min(number(lat)).alias("lat_min"), F.max(number(lat)).alias("lat_max"))


def boundaries(grids: DataFrame, *, lon_min=None, lon_max=None, lat_min=None, lat_max=None, margin: float = 0.02) -> DataFrame:
    """One box around all grids, widened by the margin's share of its size; bounds that are given win as they are."""
    box = extent(grids, ["grid_id"]).agg(F.min("lon_min").alias("a"), F.max("lon_max").alias("b"), F.min("lat_min").alias("c"), F.max("lat_max").alias("d"))
    dx, dy = margin * (F.col("b") - F.col("a")), margin * (F.col("d") - F.col("c"))
    pick = lambda given, own, name: (F.lit(float(given)) if given is not None else own).alias(name)
    return box.select(pick(lon_min, F.col("a") - dx, "lon_min"), pick(lon_max, F.col("b") + dx, "lon_max"), pick(lat_min, F.col("c") - dy, "lat_min"), pick(lat_max, F.col("d") + dy, "lat_max"))


def filter_bbox(df: DataFrame, lon_min, lon_max, lat_min, lat_max, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.where(F.col(lon).between(lon_min, lon_max) & F.col(lat).between(lat_min, lat_max))


def filter_events(events: DataFrame, bbox: tuple, max_depth: float = 50.0) -> DataFrame:
    """Events in the box (lon_min, lon_max, lat_min, lat_max) at most max_depth deep."""
    return filter_bbox(events, *bbox, lon="long", lat="lat").where(F.col("depth") <= max_depth)


def defined_nodes(grid: DataFrame) -> DataFrame:
    return grid.where(finite(F.col("value")))


def downsample(grid: DataFrame, n: int) -> DataFrame:
    """Every n-th row and column from index 0, indices closed up."""
    kept = grid.where((F.col("lat_idx") % n == 0) & (F.col("lon_idx") % n == 0))
    return kept.withColumn("lat_idx", (F.col("lat_idx") / n).cast("int")).withColumn("lon_idx", (F.col("lon_idx") / n).cast("int"))


def with_nan_to_zero(grid: DataFrame) -> DataFrame:
    return grid.withColumn("value", nan_to_zero(F.col("value")))


def with_clamp01(grid: DataFrame) -> DataFrame:
    return grid.withColumn("value", clamp01(F.col("value")))


def normalize_to_pdf(grid: DataFrame) -> DataFrame:
    """Values divided by their grid's total; an error if a total is not positive."""
    total = F.col("total")
    sums = grid.groupBy("grid_id").agg(F.sum("value").alias("total"))
    checked = F.when(finite(total) & (total > 0), total).otherwise(F.raise_error(F.lit("the sum of grid values is not positive")).cast("double"))
    return grid.join(sums, "grid_id").withColumn("value", F.col("value") / checked).drop("total")


def grid_meta(grid: DataFrame) -> DataFrame:
    """Extent and shape per grid: x_min, x_max, y_min, y_max, n_x, n_y."""
    return grid.groupBy("grid_id").agg(
        F.min("lon").alias("x_min"), F.max("lon").alias("x_max"), F.min("lat").alias("y_min"), F.max("lat").alias("y_max"),
        (F.max("lon_idx") + 1).alias("n_x"), (F.max("lat_idx") + 1).alias("n_y"),
    )


def _with_meta(points: DataFrame, meta: DataFrame) -> DataFrame:
    return points.join(meta, "grid_id")


def normalize_points(points: DataFrame, meta: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """x and y in [0, 1] of their grid's extent, as u and v."""
    out = _with_meta(points, meta)
    return out.select(*points.columns, ((F.col(x) - F.col("x_min")) / (F.col("x_max") - F.col("x_min"))).alias("u"), ((F.col(y) - F.col("y_min")) / (F.col("y_max") - F.col("y_min"))).alias("v"))


def denormalize_points(points: DataFrame, meta: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    out = _with_meta(points, meta)
    return out.select(*[c for c in points.columns if c not in ("lon", "lat")], (F.col(u) * (F.col("x_max") - F.col("x_min")) + F.col("x_min")).alias("lon"), (F.col(v) * (F.col("y_max") - F.col("y_min")) + F.col("y_min")).alias("lat"))


def apply_map(points: DataFrame, fn, meta: DataFrame) -> DataFrame:
    """fn(u, v) gives two columns from normalized coordinates (pandas UDFs are columns too); the result is in lon and lat."""
    u, v = fn(F.col("u"), F.col("v"))
    return denormalize_points(normalize_points(points, meta).withColumns({"u": u, "v": v}), meta)


def rotate_translate(x: Column, y: Column, angle_deg: Column, dx: Column, dy: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """Rotation about the pivot, then the shift."""
    c, s = F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg))
    return c * (x - px) - s * (y - py) + px + dx, s * (x - px) + c * (y - py) + py + dy


def inverse_transform(x: Column, y: Column, angle_deg: Column, dx: Column, dy: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """What rotate_translate undoes."""
    c, s = F.cos(F.radians(-angle_deg)), F.sin(F.radians(-angle_deg))
    return c * (x - px - dx) - s * (y - py - dy) + px, s * (x - px - dx) + c * (y - py - dy) + py


def with_default_pivot(transforms: DataFrame, meta: DataFrame) -> DataFrame:
    """transforms (grid_id, ...) with the extent's centre where px or py is null."""
    own = meta.select("grid_id", ((F.col("x_min") + F.col("x_max")) / 2).alias("_x"), ((F.col("y_min") + F.col("y_max")) / 2).alias("_y"))
    return transforms.join(own, "grid_id").withColumns({"px": F.coalesce("px", "_x"), "py": F.coalesce("py", "_y")}).drop("_x", "_y")


def validate_grid(nodes: DataFrame) -> DataFrame:
    """Indices for nodes (grid_id, lat, lon, value): latitude rising; an error unless every cross of lat and lon has one node."""
    lat = nodes.select("grid_id", "lat").distinct().withColumn("lat_idx", F.row_number().over(Window.partitionBy("grid_id").orderBy("lat")) - 1)
    lon = nodes.select("grid_id", "lon").distinct().withColumn("lon_idx", F.row_number().over(Window.partitionBy("grid_id").orderBy("lon")) - 1)
    sides = lat.groupBy("grid_id").agg(F.count("*").alias("n_lat")).join(lon.groupBy("grid_id").agg(F.count("*").alias("n_lon")), "grid_id")
    counts = nodes.groupBy("grid_id").agg(F.count("*").alias("n"), F.count_distinct("lat", "lon").alias("n_distinct")).join(sides, "grid_id")
    good = (F.col("n") == F.col("n_distinct")) & (F.col("n") == F.col("n_lat") * F.col("n_lon"))
    checked = counts.select("grid_id", F.when(good, True).otherwise(F.raise_error(F.lit("the grid is not rectilinear with one value per node")).cast("boolean")).alias("ok"))
    return nodes.join(lat, ["grid_id", "lat"]).join(lon, ["grid_id", "lon"]).join(checked, "grid_id").where("ok").drop("ok")


def with_monotonic_check(rows: DataFrame) -> DataFrame:
    """rows (grid_id, lat_idx, lat, ...) in file order; an error unless lat is strictly monotonic over lat_idx."""
    steps = rows.select("grid_id", "lat_idx", "lat").distinct().withColumn("d", F.col("lat") - F.lag("lat").over(Window.partitionBy("grid_id").orderBy("lat_idx")))
    sums = steps.groupBy("grid_id").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    good = (F.col("low") > 0) | (F.col("high") < 0) | F.col("low").isNull()
    return rows.join(sums.select("grid_id", F.when(good, True).otherwise(F.raise_error(F.lit("latitude is not strictly monotonic")).cast("boolean")).alias("ok")), "grid_id").where("ok").drop("ok")


def compare_grids(a: DataFrame, others: DataFrame) -> DataFrame:
    """Per other grid: whether shape and undefined nodes match a's, and the first flat index (in a's rows) that differs.

    Nodes meet by their place; a node of a that a grid lacks is found by how many of the grid's nodes met it.
    """
    from .lookup import on_each

    place = ["lat_idx", "lon_idx"]
    ids = F.array_sort(F.collect_set("grid_id"))
    mine = a.select(*place, finite(F.col("value")).alias("here"), F.lit(True).alias("_a"))
    theirs = others.groupBy(*place).agg(ids.alias("_has"), F.collect_set(F.when(finite(F.col("value")), F.col("grid_id"))).alias("_there"))
    both = mine.join(theirs, place, "full")
    flat = F.col("lat_idx") * F.lit(a.agg((F.max("lon_idx") + 1).alias("n")).first()["n"]) + F.col("lon_idx")
    each = on_each(both, "grid_id", others)
    has = F.coalesce(F.array_contains("_has", F.col("grid_id")), F.lit(False))
    shape = (F.coalesce("_a", F.lit(False)) != has)
    differs = shape | (has & (F.col("here") != F.coalesce(F.array_contains("_there", F.col("grid_id")), F.lit(False))))
    marked = each.where(F.coalesce("_a", F.lit(False)) | has).select("grid_id", flat.alias("_flat"), shape.alias("_shape"), differs.alias("_differs"))
    return marked.groupBy("grid_id").agg(
        (F.count_if("_shape") == 0).alias("same_shape"), (F.count_if("_differs") == 0).alias("same_mask"), F.min(F.when(F.col("_differs"), F.col("_flat"))).cast("long").alias("first_difference")
    )


def replace_values(grid: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("grid_id", "lat_idx", "lon_idx"), column: str = "value") -> DataFrame:
    """grid with `column` from new, row for row; an error where either has a key the other lacks."""
    joined = grid.drop(column).withColumn("_a", F.lit(1)).join(new.select(*keys, column).withColumn("_b", F.lit(1)), list(keys), "full")
    fits = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    checked = F.when(fits, F.col(column)).otherwise(F.raise_error(F.lit("the new values have another shape")).cast("double"))
    return joined.withColumn(column, checked).select(*grid.columns)
