"""Point clouds by keyed hashes: ruptures, polygons and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.geodesy import from_utm
from ..functions.rng import deal, drawn, explode_counts, uniform
from ..functions.stage import staged
from .faults import points_per_subfault, project, subfault_corners
from .grid import grid_meta
from .lookup import lookup_grid
from .spatial import triangulate


HOPELESS = 2_000_000  # proposals; a grid where none of so many is accepted has less than 2 millionths of its box to sample, but for one case in e^4


def deal_points(patches: DataFrame, n: Column, keys: list[str]) -> DataFrame:
    """Blocks of the n points of each patch; patches has corners and utm_zone."""
    return deal(patches.withColumn("_n", n), "_n", [*keys, "segment_id", "subfault_id"])


def put_points(dealt: DataFrame, keys: list[str], seed: int, rng: str = "xxhash64") -> DataFrame:
    """The points of dealt blocks, uniform in their patch's surface parallelogram. Adds sample_idx, lon, lat; the same block gives the same points wherever it lies."""
    by = [*keys, "segment_id", "subfault_id"]
    at = lambda c: F.col(f"tl.{c}") + F.col("_u") * (F.col(f"tr.{c}") - F.col(f"tl.{c}")) + F.col("_v") * (F.col(f"bl.{c}") - F.col(f"tl.{c}"))
    placed = drawn(dealt, seed, "uv", by, rng=rng).withColumns({"_x": at("x"), "_y": at("y")})
    return from_utm(placed, "_x", "_y").drop("_u", "_v", "_x", "_y", "_n")


def place_points(patches: DataFrame, n: Column, keys: list[str], seed: int, rng: str = "xxhash64") -> DataFrame:
    """n uniform points in each patch's surface parallelogram. Adds sample_idx, lon, lat."""
    return put_points(deal_points(patches, n, keys), keys, seed, rng)


def sample_rupture(subfaults: DataFrame, kappa: float | None = None, *, seed: int = 0, keys: list[str] = ["event_id"], weight: str = "slip", n_per_subfault: int | None = None, ref_loc: str = "top_center", rng: str = "xxhash64", carry: list[str] = []) -> DataFrame:  # noqa: B006
    """Points of every rupture: keys, segment_id, subfault_id, sample_idx, lon, lat and the carried columns.

    kappa null takes the column kappa of subfaults; n_per_subfault puts that many in each whatever the slip.
    """
    patches = subfault_corners(project(subfaults, keys), ref_loc)
    n = F.lit(n_per_subfault).cast("long") if n_per_subfault is not None else points_per_subfault(F.col("kappa") if kappa is None else kappa, weight)
    return place_points(patches, n, keys, seed, rng).select(*keys, "segment_id", "subfault_id", "sample_idx", *carry, "lon", "lat")


def normalize_time(samples: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """time over its greatest value in the rupture."""
    top = samples.groupBy(*keys).agg(F.max(F.when(finite(F.col(time)), F.col(time))).alias("_top"))
    return samples.join(top, keys).withColumn(time, F.try_divide(time, F.col("_top"))).drop("_top")


def random_order_take(df: DataFrame, n: Column | int, keys: list[str], identity: list[str], seed: int = 0, rng: str = "xxhash64") -> DataFrame:
    """n rows per key in the order of a keyed hash of their identity."""
    order = Window.partitionBy(*keys).orderBy(uniform(seed, "order", *keys, *identity, rng=rng), *identity)
    return df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")


def sample_uniform(subfaults: DataFrame, n: int, *, seed: int = 0, keys: list[str] = ["event_id"], rng: str = "xxhash64") -> DataFrame:  # noqa: B006
    """n points per rupture, spread over all subfaults alike: as many in each as are needed, shuffled, the first n."""
    per = subfaults.groupBy(*keys).agg(F.ceil(F.lit(n) / F.count("*")).alias("_per"))
    patches = subfault_corners(project(subfaults, keys).join(per, keys))
    points = place_points(patches, F.col("_per"), keys, seed, rng)
    taken = random_order_take(points, n, keys, ["segment_id", "subfault_id", "sample_idx"], seed, rng)
    return taken.select(*keys, "segment_id", "subfault_id", "sample_idx", "lon", "lat")


def sample_epicenter(found: DataFrame, kappa: float, *, n: int | None = None, seed: int = 0, keys: list[str] = ["event_id"], rng: str = "xxhash64") -> DataFrame:  # noqa: B006
    """Points in the subfaults that hold the epicentre (rows of find_epicenter_subfault); n of the first match goes for all."""
    first = Window.partitionBy(*keys).orderBy("segment_id", "subfault_id")
    count = F.lit(n).cast("long") if n is not None else F.first(points_per_subfault(kappa, "area")).over(first)
    patches = subfault_corners(project(found, keys)).withColumn("_count", count)
    return place_points(patches, F.col("_count"), keys, seed, rng).select(*keys, "segment_id", "subfault_id", "sample_idx", "lon", "lat")


def sample_polygons(polygons: DataFrame, n: str, *, seed: int = 0, rng: str = "xxhash64") -> DataFrame:
    """polygons (poly_id, ring: array of (x, y), and the column named n): n uniform points in each simple polygon."""
    tri = triangulate(polygons.select("poly_id", "ring"))
    area = F.abs((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / 2
    upto = Window.partitionBy("poly_id").orderBy("tri_id")
    shares = tri.withColumn("_a", area).withColumn("_to", F.sum("_a").over(upto)).withColumn("_all", F.sum("_a").over(Window.partitionBy("poly_id"))).withColumn("_last", F.lead("tri_id").over(upto).isNull())
    of = F.struct((F.col("_to") / F.col("_all")).alias("to"), "_last", "x1", "y1", "x2", "y2", "x3", "y3")
    by = shares.groupBy("poly_id").agg(F.array_sort(F.collect_list(F.struct("tri_id", of.alias("t")))).alias("tris"))  # as long as one polygon's ring
    points = explode_counts(polygons.select("poly_id", n).join(by, "poly_id"), n, ["poly_id"])
    r, u, v = (uniform(seed, s, "poly_id", "sample_idx", rng=rng) for s in "ruv")
    pick = F.element_at(F.filter("tris", lambda t: (F.col("_r") <= t["t"]["to"]) | t["t"]["_last"]), 1)["t"]
    placed = points.withColumns({"_r": r, "_u0": u, "_v0": v}).withColumn("_t", pick)
    over = F.col("_u0") + F.col("_v0") > 1
    placed = placed.withColumns({"_u": F.when(over, 1 - F.col("_u0")).otherwise(F.col("_u0")), "_v": F.when(over, 1 - F.col("_v0")).otherwise(F.col("_v0"))})
    at = lambda c: F.col(f"_t.{c}1") + F.col("_u") * (F.col(f"_t.{c}2") - F.col(f"_t.{c}1")) + F.col("_v") * (F.col(f"_t.{c}3") - F.col(f"_t.{c}1"))
    return placed.select("poly_id", "sample_idx", at("x").alias("x"), at("y").alias("y"))


def grid_proposals(grid: DataFrame, bounds: DataFrame, seed: int, rng: str) -> DataFrame:
    """Proposals number low to high - 1 of each grid in bounds (grid_id, low, high) with their place, value and whether they are accepted."""
    meta = grid_meta(grid).join(grid.where(finite(F.col("value"))).groupBy("grid_id").agg(F.max("value").alias("_top")), "grid_id").join(bounds, "grid_id")
    dealt = explode_counts(meta.withColumn("_n", F.col("high") - F.col("low")), "_n", ["grid_id"], "proposal").withColumn("proposal", F.col("proposal") + F.col("low"))
    x, y, h = (uniform(seed, s, "grid_id", "proposal", rng=rng) for s in ("x", "y", "h"))
    placed = dealt.select("grid_id", "proposal", (F.col("x_min") + x * (F.col("x_max") - F.col("x_min"))).alias("lon"), (F.col("y_min") + y * (F.col("y_max") - F.col("y_min"))).alias("lat"), (h * F.col("_top")).alias("_h"))
    found = lookup_grid(placed, grid)
    return found.withColumn("accepted", finite(F.col("value")) & (F.col("value") > F.col("_h"))).drop("_h")


def sample_grid(grid: DataFrame, n: int, *, seed: int = 0, rng: str = "xxhash64", strict: bool = True) -> DataFrame:
    """The first n accepted proposals of each grid, accepted in proportion to the bilinear value.

    The first round proposes n * max / mean * 1.2 + 64 for a grid; each goes on from its own number of proposals with as many as its own accepted share asks for, until it has n. An error
    where a grid has no positive value, or none that one of HOPELESS proposals meets; such grids are left out if not strict.
    """
    stats = grid.groupBy("grid_id").agg(F.max(F.when(finite(F.col("value")), F.col("value"))).alias("top"), F.avg(F.when(finite(F.col("value")), F.greatest("value", F.lit(0.0))).otherwise(0.0)).alias("mean"))
    stats = staged(stats.withColumn("some", F.coalesce(F.col("top") > 0, F.lit(False))), "stats")
    if strict and not stats.where("not some").isEmpty():
        raise ValueError("a grid has no positive value to sample")
    high = F.floor(F.try_divide("top", F.col("mean")) * n * 1.2).cast("long") + 64
    bounds, done = stats.where("some").select("grid_id", F.lit(0).cast("long").alias("low"), high.alias("high")), None
    while True:
        bounds = staged(bounds, "bounds")
        if bounds.isEmpty() and done is not None:
            break
        some = staged(grid_proposals(grid, bounds, seed, rng).where("accepted").drop("accepted"), "accepted")
        done = some if done is None else done.unionByName(some)
        counts = bounds.join(done.groupBy("grid_id").agg(F.count("*").alias("_n")), "grid_id", "left").select("grid_id", "high", F.coalesce("_n", F.lit(0)).alias("_n"))
        counts = staged(counts.where(F.col("_n") < n), "short")
        lost = counts.where((F.col("_n") == 0) & (F.col("high") >= HOPELESS))
        if strict and not lost.isEmpty():
            raise ValueError(f"a grid accepted none of {lost.first()['high']} proposals")
        more = F.when(F.col("_n") == 0, F.least(8 * F.col("high"), F.greatest(F.lit(HOPELESS), F.col("high")))).otherwise(F.greatest(2 * F.col("high"), F.floor(1.2 * n * F.col("high") / F.col("_n"))))
        bounds = counts.where((F.col("_n") > 0) | (F.col("high") < HOPELESS)).select("grid_id", F.col("high").alias("low"), more.cast("long").alias("high"))
    order = Window.partitionBy("grid_id").orderBy("proposal")
    return done.withColumn("sample_idx", F.row_number().over(order).cast("long") - 1).where(F.col("sample_idx") < n).select("grid_id", "sample_idx", "lon", "lat", "value")


def surface_count(grid: DataFrame, kappa: float, dx: float, dy: float) -> DataFrame:
    """Points per grid of a segment on the surface: kappa/1000 times the cell size times the sum of values, truncated."""
    return grid.groupBy("grid_id").agg((F.lit(kappa / 1000.0) * abs(dx * dy) * F.sum(F.when(finite(F.col("value")), F.col("value")))).cast("long").alias("n_points"))


def sample_surface_projection(grid: DataFrame, kappa: float, dx: float, dy: float, **how) -> DataFrame:
    """surface_count points of each grid, in place of the grid."""
    counts = surface_count(grid, kappa, dx, dy)
    most = counts.agg(F.max("n_points")).first()[0] or 0
    return sample_grid(grid, most, **how).join(F.broadcast(counts), "grid_id").where(F.col("sample_idx") < F.col("n_points")).drop("n_points")


def with_kappas(subfaults: DataFrame, kappas: list[float]) -> DataFrame:
    """Every subfault once for each density, as the column kappa."""
    return subfaults.withColumn("kappa", F.explode(F.array(*(F.lit(float(k)) for k in kappas))))
