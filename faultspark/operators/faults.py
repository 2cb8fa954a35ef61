"""Ruptures: corners, polygons, moves, times and summaries of subfaults.

subfaults: event_id, segment_id, subfault_id, lon, lat, z, slip, rake, trup, rise, and per segment strike,
dip, len_strike_km, width_dip_km (joined in). keys name the rupture, e.g. event_id or event_id and try.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, wrap_longitude
from ..functions.geodesy import direct, from_utm_points, inverse, to_utm, turn, utm_zone

REFERENCES = ("top_center", "top_left", "top_right", "center")


def project(subfaults: DataFrame, keys: list[str]) -> DataFrame:
    """UTM kilometres; the zone is that of each segment's mean longitude, known from one small aggregate."""
    by = [*keys, "segment_id"]
    zones = subfaults.groupBy(*by).agg(utm_zone(F.avg("lon")).alias("utm_zone"))
    return to_utm(subfaults.join(zones, by))


def subfault_corners(df: DataFrame, ref_loc: str = "top_center") -> DataFrame:
    """Corners of each patch in kilometres: tl, tr, br, bl as structs (x, y, z). z falls by sin(dip) down dip."""
    if ref_loc not in REFERENCES:
        raise ValueError(f"ref_loc must be one of {REFERENCES}")
    strike, dip = F.radians("strike"), F.radians("dip")
    along = (F.sin(strike), F.cos(strike), F.lit(0.0))
    down = (F.cos(strike) * F.cos(dip), -F.sin(strike) * F.cos(dip), -F.sin(dip))
    half, width = F.col("len_strike_km") * 0.5, F.col("width_dip_km")
    shift = {"top_center": (0.0, 0.0), "top_left": (1.0, 0.0), "top_right": (-1.0, 0.0), "center": (0.0, -0.5)}[ref_loc]
    top = [F.col(c) + shift[0] * half * a + shift[1] * width * d for c, a, d in zip(("x_km", "y_km", "z"), along, down)]
    corner = lambda side, deep: F.struct(*((t + side * half * a + deep * width * d).alias(n) for n, t, a, d in zip("xyz", top, along, down)))
    return df.withColumns({"tl": corner(-1.0, 0.0), "tr": corner(1.0, 0.0), "br": corner(1.0, 1.0), "bl": corner(-1.0, 1.0)})


def subfault_polygons(df: DataFrame, closed: bool = False) -> DataFrame:
    """polygon: the corners as an array of (lon, lat), the first again at the end if closed. Needs corners and utm_zone."""
    ring = F.array("tl", "tr", "br", "bl", *["tl"] * closed)
    return df.withColumn("polygon", from_utm_points(ring, F.col("utm_zone")))


def shift_event(subfaults: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Every subfault moved by the geodesic from (from_lon, from_lat) to (to_lon, to_lat) of its rupture in targets."""
    moves = targets.withColumn("_m", inverse("from_lon", "from_lat", "to_lon", "to_lat"))
    moved = subfaults.join(moves, keys).withColumn("_p", direct("lon", "lat", F.col("_m.azimuth"), F.col("_m.distance")))
    return moved.withColumns({"lon": F.col("_p.lon"), "lat": F.col("_p.lat")}).drop("_m", "_p", "from_lon", "from_lat", "to_lon", "to_lat")


def rotate_event(subfaults: DataFrame, turns: DataFrame, keys: list[str], rotate_strike: bool = True) -> DataFrame:
    """Subfaults turned by angle_deg about (pivot_lon, pivot_lat) of their rupture in turns; strike loses the angle."""
    both = subfaults.join(turns, keys).withColumn("_p", turn("lon", "lat", "pivot_lon", "pivot_lat", "angle_deg"))
    strike = F.pmod(F.col("strike") - F.col("angle_deg"), F.lit(360.0)) if rotate_strike else F.col("strike")
    return both.withColumns({"lon": F.col("_p.lon"), "lat": F.col("_p.lat"), "strike": strike}).drop("_p", "pivot_lon", "pivot_lat", "angle_deg")


def average_time(strict: bool = False) -> Column:
    """trup + rise / 2; NaN where either is missing, or an error if strict."""
    t = F.col("trup") + 0.5 * F.col("rise")
    bad = F.raise_error(F.lit("a subfault has no rupture time")).cast("double") if strict else F.lit(float("nan"))
    return F.when(finite(t), t).otherwise(bad)


def points_per_subfault(kappa: Column | float, weight: str = "slip") -> Column:
    """Area times slip times kappa/1000, truncated; weight='area' leaves slip out."""
    area = F.col("len_strike_km") * F.col("width_dip_km")
    per = F.lit(kappa) / 1000.0 if not isinstance(kappa, Column) else kappa / 1000.0
    amount = (area if weight == "area" else area * F.col("slip")) * per
    return F.when(finite(amount), amount.cast("long")).otherwise(F.lit(0).cast("long"))


def fault_summary(subfaults: DataFrame, keys: list[str], kappa: float, min_slip: float | None = None) -> DataFrame:
    """Per key: area (of subfaults with slip above min_slip), area times slip, subfaults, points, greatest slip."""
    area, slip = F.col("len_strike_km") * F.col("width_dip_km"), F.col("slip")
    counted = area if min_slip is None else F.when(finite(slip) & (slip > min_slip), area)
    return subfaults.groupBy(*keys).agg(
        F.coalesce(F.sum(counted), F.lit(0.0)).alias("area"), F.sum(F.when(finite(slip), area * slip)).alias("slip_area"), F.count("*").alias("n_subfaults"),
        F.sum(points_per_subfault(kappa)).alias("n_points"), F.max(F.when(finite(slip), slip)).alias("max_slip"),
    )


def spacing(df: DataFrame, keys: list[str], axis: str, order: list[str], fallback: str) -> DataFrame:
    """Mean of successive differences of `axis` per key in the given order, NaN left out; else the mean of `fallback`."""
    step = F.col(axis) - F.lag(axis).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.avg(F.when(finite(F.col("_step")), F.col("_step"))), F.avg(fallback)).alias("spacing"))


def replace_slip(subfaults: DataFrame, new: DataFrame) -> DataFrame:
    """The same geometry with the slip of new (event_id, segment_id, subfault_id, slip); an error on another shape."""
    from .grid import replace_values

    return replace_values(subfaults, new, ("event_id", "segment_id", "subfault_id"), "slip")


def segment_extent(subfaults: DataFrame, keys: list[str]) -> DataFrame:
    return subfaults.groupBy(*keys).agg(
        wrap_longitude(F.min("lon")).alias("lon_min"), wrap_longitude(F.max("lon")).alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max")
    )
