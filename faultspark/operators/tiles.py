"""Fields too large to broadcast: grids as square tiles, met by blocks of points that are not made yet. No point is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import staged
from .ecdf import histogram
from .grid import grid_meta
from .lookup import bilinear, in_cells

TILE = 128  # cells a side: 129 x 129 doubles are 133 kB
BLOCKS = 64  # blocks (of 10,000 points at most) that one copy of a tile meets
AT = ["grid_id", "_ti", "_tj"]


def raster_tiles(grid: DataFrame, size: int = TILE) -> DataFrame:
    """grid_id, _ti, _tj, values: the nodes of size x size cells, row by row, those on the upper edges too, so a cell's four corners lie in one tile.

    An error if a node is missing or there twice (see validate_grid).
    """
    meta = grid_meta(grid).select("grid_id", "n_x", "n_y")
    over = lambda c: F.when((F.col(c) % size == 0) & (F.col(c) > 0), F.array(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size))).otherwise(F.array(F.floor(F.col(c) / size)))
    each = grid.select("grid_id", "lat_idx", "lon_idx", F.col("value").cast("double").alias("value"), over("lon_idx").alias("_is"), over("lat_idx").alias("_js"))
    each = each.withColumn("_ti", F.explode("_is")).withColumn("_tj", F.explode("_js"))
    tiles = each.groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("lat_idx", "lon_idx", "value"))).alias("nodes")).join(F.broadcast(meta), "grid_id")  # (size + 1)^2 nodes at most
    side = lambda n, t: F.least(F.lit(size), F.col(n) - 1 - F.col(t) * size) + 1
    whole = (F.size("nodes") == side("n_x", "_ti") * side("n_y", "_tj")) & (F.size(F.array_distinct(F.transform("nodes", lambda v: F.struct(v["lat_idx"], v["lon_idx"])))) == F.size("nodes"))
    values = F.transform("nodes", lambda v: v["value"])
    return tiles.select(*AT, F.when(whole, values).otherwise(F.raise_error(F.lit("a grid has missing or repeated nodes")).cast("array<double>")).alias("values"))


def _tile(cell: Column, size: int) -> Column:
    return F.floor(cell / size)


def tiled_values(points: DataFrame, size: int = TILE, out: str = "value") -> DataFrame:
    """points in cells (see in_cells) beside their tile's values, with the bilinear value; NaN where the place or a corner in use is."""
    stride = F.least(F.lit(size), F.col("n_x") - 1 - F.col("_ti") * size) + 1
    first = (F.col("j") - F.col("_tj") * size) * stride + (F.col("i") - F.col("_ti") * size) + 1
    right, up = F.col("i") + 1 < F.col("n_x"), F.col("j") + 1 < F.col("n_y")
    at = lambda step, there: F.when(there, F.element_at("values", (first + step).cast("int")))
    value = bilinear(at(F.lit(0), F.lit(True)), at(F.lit(1), right), at(stride, up), at(stride + 1, right & up))
    return points.withColumn(out, F.when(F.element_at("values", first.cast("int")).isNotNull(), value).otherwise(F.lit(float("nan"))))


def tiled_histogram(dealt: DataFrame, put: Callable[[DataFrame], DataFrame], grid: DataFrame, x: list[float], keys: list[str], size: int = TILE, blocks: int = BLOCKS) -> DataFrame:
    """The histogram (see ecdf.histogram) of the grids' values at the points that `put` makes of dealt blocks; dealt has grid_id.

    Points are made twice and shuffled never: first to count them by block and tile, then beside the tile's values. Blocks go to the tiles they touch; a tile that
    many blocks touch is there once for `blocks` of them, so a hot place fills many tasks. Points of a grid that is not there, or at no place, count as undefined.
    """
    dealt = staged(dealt.withColumn("_deal", F.monotonically_increasing_id()), "dealt")
    meta = staged(grid_meta(grid), "meta")
    cells = lambda d: in_cells(put(d), meta).withColumns({"_pi": _tile(F.col("i"), size), "_pj": _tile(F.col("j"), size)})
    met = staged(cells(dealt).groupBy("_deal", "grid_id", F.col("_pi").alias("_ti"), F.col("_pj").alias("_tj")).agg(F.count("*").alias("_met")), "met")
    copies = met.where("_ti is not null and _tj is not null").groupBy(*AT).agg(F.ceil(F.count("*") / blocks).alias("_copies"))
    tiles = raster_tiles(grid, size).join(copies, AT).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).drop("_copies")
    routed = met.drop("_met").join(copies, AT).withColumn("_copy", F.pmod(F.xxhash64("_deal"), "_copies")).drop("_copies")
    beside = dealt.join(routed, ["_deal", "grid_id"]).join(tiles, [*AT, "_copy"])
    points = cells(beside).where("_pi = _ti and _pj = _tj")
    found = histogram(tiled_values(points, size), "value", x, keys, arrays=True)
    nowhere = met.where("_ti is null or _tj is null").join(dealt.select("_deal", *[k for k in keys if k != "grid_id"]), "_deal").groupBy(*keys).agg(F.sum("_met").alias("n"))
    lost = nowhere.select(*keys, F.lit(-1).alias("bucket"), F.col("n").cast("double").alias("w"), F.col("n"))
    return found.unionByName(lost).groupBy(*keys, "bucket").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
