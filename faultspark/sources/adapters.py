"""The test tables seen as ruptures, grids, values and polygons; the queries' SQL has the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clamp01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subfaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 61).alias("event_id"), (k % 3).cast("int").alias("segment_id"), k.alias("subfault_id"), (F.col("o_totalprice") / 125000.0).alias("slip"),
        (-72 + (k % 97) * 0.03).cast("double").alias("lon"), (-30 + (k % 211) * 0.05).cast("double").alias("lat"), (5 + k % 40).cast("double").alias("z"),
        ((k * 37) % 360).cast("double").alias("strike"), (10 + k % 35).cast("double").alias("dip"), F.lit(10.0).alias("len_strike_km"), F.lit(8.75).alias("width_dip_km"),
        (k % 13).cast("double").alias("trup"), F.when(k % 7 != 0, (k % 5).cast("double")).alias("rise"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subfaults(spark, sf_dir).groupBy("event_id").agg(F.avg("lon").alias("long"), F.avg("lat").alias("lat"), F.avg("z").alias("depth"))


def _grid(rows: DataFrame, grid_id) -> DataFrame:
    i, j = F.col("l_quantity").cast("int") - 1, F.col("l_linenumber") - 1
    means = rows.groupBy(grid_id.alias("grid_id"), i.alias("lon_idx"), j.cast("int").alias("lat_idx")).agg(F.avg("l_discount").alias("d"))
    value = clamp01((F.round("d", 9) * 10 - 0.4) / 0.2)
    hole = ((F.col("lon_idx") + 1) * (F.col("lat_idx") + 1)) % 17 == 0
    return means.select("grid_id", "lat_idx", "lon_idx", (-31 + F.col("lat_idx") * 2.0).alias("lat"), (-73 + F.col("lon_idx") * 5.0 / 49).alias("lon"), F.when(hole, float("nan")).otherwise(value).alias("value"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(read(spark, sf_dir, "lineitem"), F.lit("g"))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grids; nodes that a flag has no rows for are undefined."""
    own = _grid(read(spark, sf_dir, "lineitem"), F.col("l_returnflag"))
    spine = grid(spark, sf_dir).drop("grid_id", "value").withColumn("grid_id", F.explode(F.array(*(F.lit(f) for f in "ANR"))))
    return spine.join(own.select("grid_id", "lat_idx", "lon_idx", "value"), ["grid_id", "lat_idx", "lon_idx"], "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, value (NaN by rule), weight, day and event_id."""
    v = F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("value"))
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("k"), v.alias("value"), (F.col("user_id") % 5).cast("double").alias("weight"), F.to_date("ts").alias("day"), "event_id")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping quadrangles by nation."""
    k = F.col("n_nationkey")
    x, y = (k % 5) * 2.0, F.floor(k / 5) * 2.0
    ring = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0.0, 0.0), (2.5, 0.25), (2.25, 2.75), (-0.25, 2.5))))
    return read(spark, sf_dir, "nation").select(k.alias("seg_order"), ring.alias("ring"), (k * 10).cast("double").alias("strike"), (k + 5).cast("double").alias("dip"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("point_id"), ((k * 7919) % 1009 / 101.0).alias("x"), ((k * 104729) % 1013 / 101.3).alias("y"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("key"))


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotation and shift by nation, about the middle of the grid."""
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(k.alias("transform_id"), (k * 15.0).alias("angle_deg"), (k * 0.02).alias("dx"), (k * -0.03).alias("dy"), F.lit(-70.5).alias("px"), F.lit(-25.0).alias("py"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boundary line by region through its nations."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    kind = F.when(r % 2 == 0, "Subduction").otherwise("ridge")
    return read(spark, sf_dir, "nation").select(r.alias("line_id"), r.cast("string").alias("name"), kind.alias("type"), k.alias("seq"), (-73 + (k * 7) % 25 / 5.0).alias("lon"), (-31 + (k * 11) % 25 / 2.0).alias("lat"))


def ocean_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by customer on both sides of the date line, from pole to pole; longitudes run on past 180."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("point_id"), (170 + (k * 7919) % 1009 / 50.0).alias("lon"), (-85 + (k * 104729) % 1013 / 6.0).alias("lat"))


def ocean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the regions moved to the date line, which most of their edges cross."""
    k = F.col("n_nationkey")
    lon = F.when(k % 2 == 0, 175).otherwise(-185) + (k * 7) % 25 / 2.0
    return read(spark, sf_dir, "nation").join(lines(spark, sf_dir).select("line_id", "name", "type", F.col("seq").alias("n_nationkey")), "n_nationkey").select(
        "line_id", "name", "type", k.alias("seq"), lon.alias("lon"), (-80 + (k * 11) % 25 * 6.0).alias("lat")
    )


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A right triangle by customer."""
    at = {"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + 0.5, "y2": F.col("y"), "x3": F.col("x"), "y3": F.col("y") + 0.5}
    return places(spark, sf_dir).select(F.col("point_id").alias("tri_id"), *(c.alias(n) for n, c in at.items()), F.col("v").alias("value"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A convex quadrangle by customer, with the number of points asked for in it."""
    ring = F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((0.0, 0.0), (0.5, 0.125), (0.625, 0.75), (-0.125, 0.5))))
    return places(spark, sf_dir).select(F.col("point_id").alias("poly_id"), ring.alias("ring"), (F.col("point_id") % 40).cast("int").alias("n"))


def models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, segments and subfaults of slip models by fifty customers, some hundred subfaults each, as files hold them."""
    k, c = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 50)
    rows = read(spark, sf_dir, "orders").select(
        c.alias("c"), F.concat(F.lit("s"), c).alias("event_id"), (k % 3).cast("int").alias("segment_id"), k.alias("subfault_id"), (-72 + (k % 97) * 0.03).cast("double").alias("lon"), (-30 + (k % 211) * 0.05).cast("double").alias("lat"),
        (5 + k % 40).cast("double").alias("z"), (F.col("o_totalprice") / 125000.0).alias("slip"), ((k * 11) % 180).cast("double").alias("rake"), (k % 13).cast("double").alias("trup"), F.when(k % 7 != 0, (k % 5).cast("double")).alias("rise"), F.to_date("o_orderdate").alias("day"),
    )
    num = lambda e: e.cast("double")
    segments = rows.select("event_id", "c", "segment_id").distinct().select("event_id", "segment_id", num((F.col("c") * 37 + F.col("segment_id") * 20) % 360).alias("strike"), num(10 + (F.col("c") + F.col("segment_id")) % 35).alias("dip"), F.lit(10.0).alias("len_strike_km"), (F.col("segment_id") + 8.75).cast("double").alias("width_dip_km"))
    events = rows.groupBy("event_id", "c").agg(F.min("lat").alias("lat"), F.min("lon").alias("long"), F.max("z").alias("depth"), F.max("slip").alias("mw"), F.count_distinct("segment_id").alias("nsg"), F.min("day").alias("date_parsed"), F.count("*").alias("n"))
    events = events.select(
        "event_id", "lat", "long", "depth", "mw", "nsg", "date_parsed", F.concat(F.lit("Coast "), F.col("c"), F.lit(", South")).alias("event"), F.concat(F.lit("Customer "), F.col("c"), F.lit(" (2012)")).alias("reference"),
        num(F.col("c") % 360).alias("global_strike"), num(F.col("c") % 90).alias("global_dip"), F.lit(100.0).alias("size_len"), F.lit(50.0).alias("size_wid"), F.create_map(F.lit("SGM"), F.col("n").cast("int"), F.lit("GPS"), F.col("nsg").cast("int")).alias("data"),
    )
    return events, segments, rows.drop("c", "day")
