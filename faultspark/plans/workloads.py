"""Observed CDFs, density convergence and null models. Points are placed, looked up and counted in one stage; none is shuffled or stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import explode_counts, uniform
from ..functions.stage import staged
from ..operators.ecdf import from_histogram, histogram, levels
from ..operators.faults import points_per_subfault, project, rotate_event, shift_event, subfault_corners
from ..operators.grid import defined_nodes, rotate_translate
from ..operators.lookup import BROADCAST_CELLS, lookup_grid, on_each
from ..operators.sampling import deal_points, put_points, sample_rupture, with_kappas
from ..operators.tiles import TILE, tiled_histogram

LEVELS = [k / 200 for k in range(201)]


def rupture_histogram(subfaults: DataFrame, grid: DataFrame, kappa: float | None, x: list[float], keys: list[str], *, seed: int = 0, rng: str = "xxhash64", most_nodes: int = BROADCAST_CELLS, tile: int = TILE) -> DataFrame:
    """The histogram of the grids' values at the points of each rupture; keys hold grid_id, by which subfaults are told apart if they have it, else they meet every grid.

    Grids of up to most_nodes nodes in all are broadcast as cells, larger ones met tile by tile; in neither case is a point shuffled.
    """
    own = keys if "grid_id" in subfaults.columns else [k for k in keys if k != "grid_id"]
    if grid.count() <= most_nodes:
        points = sample_rupture(subfaults, kappa, seed=seed, keys=own, rng=rng)
        return histogram(lookup_grid(points if own == keys else on_each(points, "grid_id", grid), grid), "value", x, keys, arrays=True)
    dealt = deal_points(subfault_corners(project(subfaults, own)), points_per_subfault(F.col("kappa") if kappa is None else kappa), own)
    dealt = dealt.select(*own, "segment_id", "subfault_id", "utm_zone", "tl", "tr", "bl", "_from", "_to", "_n")
    return tiled_histogram(dealt if own == keys else on_each(dealt, "grid_id", grid), lambda d: put_points(d, own, seed, rng), grid, x, keys, tile)


def observed_cdf(subfaults: DataFrame, grid: DataFrame, kappa: float | None = 3500.0, x: list[float] = LEVELS, *, keys: list[str] = ["event_id"], force_endpoints: bool = True, **how) -> DataFrame:  # noqa: B006
    """ECDF of every grid's field at the points of each rupture: keys, grid_id, x_idx, x, cdf. how: see rupture_histogram."""
    x, by = levels(x), [*keys, "grid_id"]
    return from_histogram(rupture_histogram(subfaults, grid, kappa, x, by, **how), x, by, "finite", force_endpoints)


def kappa_convergence(subfaults: DataFrame, grid: DataFrame, kappas: list[float], kappa_ref: float, x: list[float] = LEVELS, *, tol: float = 0.01, **how) -> tuple[DataFrame, DataFrame]:
    """delta = greatest difference from the reference density's CDF by event, grid and kappa; and the smallest kappa of each event and grid from which every larger one is under tol (else the largest)."""
    by = ["event_id", "grid_id"]
    cdf = staged(observed_cdf(with_kappas(subfaults, [*kappas, kappa_ref]), grid, None, x, keys=["event_id", "kappa"], **how), "cdf")  # points are made once for both sides of the join
    ref = cdf.where(F.col("kappa") == kappa_ref).select(*by, "x_idx", F.col("cdf").alias("ref"))
    delta = cdf.where(F.col("kappa").isin([float(k) for k in kappas])).join(ref, [*by, "x_idx"]).groupBy(*by, "kappa").agg(F.max(F.abs(F.col("cdf") - F.col("ref"))).alias("delta"))
    later = Window.partitionBy(*by).orderBy("kappa").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    held = delta.withColumn("ok", F.min((F.col("delta") < tol).cast("int")).over(later))
    return delta, held.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("ok") == 1, F.col("kappa"))), F.max("kappa")).alias("kappa"))


def _candidates(grid: DataFrame) -> DataFrame:
    """Defined nodes of each grid as node, lon, lat, numbered by row and column from per-row counts and a running sum over rows."""
    nodes = defined_nodes(grid).select("grid_id", "lat_idx", "lon_idx", "lon", "lat")
    rows = nodes.groupBy("grid_id", "lat_idx").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("grid_id").orderBy("lat_idx")) - F.col("n"))
    return nodes.join(rows, ["grid_id", "lat_idx"]).withColumn("node", F.col("base") + F.row_number().over(Window.partitionBy("grid_id", "lat_idx").orderBy("lon_idx")) - 1).select("grid_id", "node", F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"))


def null_model(
    events: DataFrame, subfaults: DataFrame, grid: DataFrame, *, n_null: int = 500, max_tries: int = 2000, min_finite: float = 0.95, kappa: float = 750.0, x: list[float] = LEVELS,
    seed: int = 0, mode: str = "geodesic", rng: str = "xxhash64", round_size: int | None = None, **size_of,
) -> DataFrame:
    """CDFs of the first n_null accepted relocations of each event on each grid: event_id, grid_id, realization_id, try, n_accepted, x_idx, x, cdf.

    Try t moves the rupture's epicentre (event long, lat) to a random defined node and turns it by a random angle; it is accepted if at least
    min_finite of its points hit a defined value. mode='planar' moves points in the lon/lat plane instead of along geodesics.
    One partial aggregate gives both the share and the histogram. Tries go in rounds of round_size (n_null and a quarter); a round, a written table, has the events
    only that are still short. n_accepted tells of events that stay short after max_tries; one that accepted none has one row, with n_accepted 0 and all else null.
    size_of: most_nodes and tile, see rupture_histogram, which the geodesic mode counts by; the planar one joins points with cells beyond the broadcast.
    """
    if mode not in ("geodesic", "planar"):
        raise ValueError("mode must be 'geodesic' or 'planar'")
    nodes = staged(_candidates(grid), "nodes")
    by, x = ["event_id", "grid_id"], levels(x)
    step = round_size or n_null + -(-n_null // 4)
    places = on_each(events.select("event_id", F.col("long").alias("from_lon"), F.col("lat").alias("from_lat")), "grid_id", grid)
    places = staged(places.join(nodes.groupBy("grid_id").agg(F.count("*").alias("n_nodes")), "grid_id"), "places")
    parts, open_, low = [], places, 0
    while True:
        high = min(max_tries, low + step)
        parts.append(staged(_tried(open_, subfaults, grid, nodes, low, high, min_finite, kappa, x, seed, mode, rng, **size_of), "round"))
        accepted = _union(parts).select(*by, "try").distinct().groupBy(*by).agg(F.count("*").alias("_n"))
        low = high
        if low >= max_tries:
            break
        open_ = staged(places.join(accepted.where(F.col("_n") >= n_null), by, "left_anti").select(places.columns), "open")
        if open_.isEmpty():
            break
    hist = _union(parts)
    order = Window.partitionBy(*by).orderBy("try")
    kept = hist.select(*by, "try").distinct().withColumn("realization_id", F.row_number().over(order) - 1).where(F.col("realization_id") < n_null)
    kept = staged(kept.withColumn("n_accepted", F.count("*").over(Window.partitionBy(*by))), "kept")
    cdf = from_histogram(hist.join(kept, [*by, "try"]), x, [*by, "try", "realization_id", "n_accepted"], "floor")
    cdf = cdf.select(*by, "realization_id", "try", "n_accepted", "x_idx", "x", "cdf")
    none = places.select(*by).join(kept.select(*by).distinct(), by, "left_anti").withColumn("n_accepted", F.lit(0).cast("long"))
    return cdf.unionByName(none, allowMissingColumns=True)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tried(places, subfaults, grid, nodes, low, high, min_finite, kappa, x, seed, mode, rng, **size_of) -> DataFrame:
    """Histograms of the accepted ones of tries low to high - 1 at each place (event_id, grid_id, from_lon, from_lat, n_nodes)."""
    keys = ["event_id", "grid_id", "try"]
    tries = explode_counts(places.withColumn("_n", F.lit(high - low).cast("long")), "_n", ["event_id", "grid_id"], "try").drop("_n").withColumn("try", F.col("try") + low)
    number = lambda stream: uniform(seed, stream, *keys, rng=rng)
    tries = tries.withColumn("node", F.floor(number("node") * F.col("n_nodes"))).withColumn("angle_deg", number("angle") * 360.0)
    placed = tries.join(nodes, ["grid_id", "node"]).drop("node", "n_nodes")
    if mode == "planar":
        points = sample_rupture(subfaults, kappa, seed=seed, rng=rng)
        moved = points.join(placed, "event_id")
        lon, lat = rotate_translate(F.col("lon"), F.col("lat"), F.col("angle_deg"), F.col("to_lon") - F.col("from_lon"), F.col("to_lat") - F.col("from_lat"), F.col("from_lon"), F.col("from_lat"))
        hist = histogram(lookup_grid(moved.withColumns({"lon": lon, "lat": lat}).select(*keys, "lon", "lat"), grid), "value", x, keys, arrays=True)
    else:
        ruptures = subfaults.join(placed.select(*keys), "event_id")
        shifted = shift_event(ruptures, placed.select(*keys, "from_lon", "from_lat", "to_lon", "to_lat"), keys)
        turns = placed.select(*keys, F.col("to_lon").alias("pivot_lon"), F.col("to_lat").alias("pivot_lat"), "angle_deg")
        hist = rupture_histogram(rotate_event(shifted, turns, keys), grid, kappa, x, keys, seed=seed, rng=rng, **size_of)
    each = Window.partitionBy(*keys)  # a join of the histogram with its own sums would make the points twice
    share = F.sum(F.when(F.col("bucket") >= 0, F.col("n")).otherwise(0)).over(each) / F.sum("n").over(each)
    return hist.withColumn("_share", share).where(F.col("_share") >= min_finite).drop("_share")
