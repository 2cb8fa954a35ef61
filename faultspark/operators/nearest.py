"""Nearest sources by a hierarchy of occupied tiles: work goes with the points, not with the space between them."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import staged

FOLD = 4  # tiles of one level along an axis of a tile of the next
CROWD = 8  # sources that a source shares its tile with, on average, above which tiles are made smaller
FEW = 10_000  # sources or tiles that are broadcast; more are shuffled. Spark's own choice knows no explode


def _apart(pairs: list[tuple[Column, Column]]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, ((a - b) * (a - b) for a, b in pairs)))


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """rows dealt out, by the columns if there are any, to as many tasks as a shuffle has: small rows may make much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def fitting_tile(have: DataFrame, keys: list[str], columns: list[str], tile: float) -> float:
    """tile, or the smaller one that dense sources need for CROWD of them to share one."""
    for _ in range(8):
        shared = have.groupBy(*keys, *(F.floor(F.col(c) / tile) for c in columns)).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
        if shared <= CROWD:
            break
        tile /= 2 ** math.ceil(math.log2(shared / (CROWD / 2)) / len(columns))
    return tile


def nearest(asked: DataFrame, have: DataFrame, *, keys: list[str], identity: list[str], axes: list[tuple[str, str]], tile: float, distance: Callable[[Column], Column], rank: Callable[[Column], list[Column]], extent: float = 0.0) -> DataFrame:
    """identity and _b, a struct of d and the rank columns: of have's rows with the same keys the nearest to each of asked, the first by rank of equally near ones.

    axes names the coordinates in asked and in have; `distance`, of asked's columns and a struct of have's, is at least the coordinates' Euclidean distance less `extent` (sources
    that reach beyond their place have one, smaller than tile) and at most that distance. A row of asked meets one list of the sources in the tiles around, and is settled if one is nearer than a tile.
    The others climb to the level of ever coarser tiles that shows an occupied one, whose one source bounds the distance, and come down through the occupied tiles within that bound only.
    Without an extent tiles are made as small as dense sources ask for, so have should hold a place once. Rows of asked whose keys have no source have no row. Coordinates must be finite.
    """
    if not 0 <= extent < tile:
        raise ValueError("extent must be smaller than tile")
    mine, theirs = zip(*axes)
    cells = [f"_t{k}" for k in range(len(axes))]
    own = [*keys, *cells]
    have = staged(have, "have")
    tile = tile if extent else fitting_tile(have, keys, list(theirs), tile)
    beside = lambda few, df: F.broadcast(df) if few else df.hint("merge")
    few = have.count() <= FEW
    placed = have.select(*keys, *(F.floor(F.col(c) / tile).alias(t) for t, c in zip(cells, theirs)), F.struct(*[c for c in have.columns if c not in keys]).alias("_s"))
    apart = lambda s: _apart([(F.col(a), s[b]) for a, b in axes])
    best = F.array_min(F.transform("_near", lambda s: F.struct(distance(s).alias("d"), *rank(s)))).alias("_b")

    def lists(tiles: DataFrame, ring: int) -> DataFrame:
        """_near of each tile: the structs _s in the tiles of the ring about it."""
        for t in cells if ring else []:
            tiles = tiles.withColumn(t, F.explode(F.array(*(F.col(t) + k for k in range(-ring, ring + 1)))))
        return tiles.groupBy(*own).agg(F.collect_list("_s").alias("_near"))

    def at(rows: DataFrame, size: float) -> DataFrame:
        return rows.withColumns({t: F.floor(F.col(c) / size) for t, c in zip(cells, mine)})

    columns = asked.columns
    asked = spread(asked) if few else asked
    first = staged(at(asked, tile).join(beside(few, lists(placed, 1)), own, "left").select(*columns, best), "nearest")
    settled = F.coalesce(F.col("_b.d") < tile - extent, F.lit(False))
    one = lambda rows: rows.groupBy(*identity).agg(F.min("_b").alias("_b"))
    done = first.where(settled).select(*identity, "_b")
    open_ = first.where(~settled).select(*columns, F.col("_b.d").alias("_most"), F.monotonically_increasing_id().alias("_row"))
    columns = [*columns, "_row"]
    if keys:
        open_ = open_.join(have.select(*keys).distinct(), keys, "left_semi")
    low = staged(open_, "open")
    if low.isEmpty() or have.isEmpty():
        return one(done)

    kept = lambda tiles: tiles if few else staged(tiles, "occupied")
    occupied, hits, level = [kept(placed.groupBy(*own).agg(F.min(F.struct(*(F.col(f"_s.{c}").alias(c) for c in theirs))).alias("_s")))], [], 0
    small = [few]
    while True:  # up: the distance to one source of an occupied tile around
        hits.append(low.where("_most is not null"))
        low = low.where("_most is null")
        above = occupied[-1].withColumns({t: F.floor(F.col(t) / FOLD) for t in cells}).groupBy(*own).agg(F.min("_s").alias("_s"))
        occupied.append(kept(above))
        level += 1
        if low.isEmpty():
            break
        small.append(small[-1] or occupied[-1].count() <= FEW)
        most = F.array_min(F.transform("_near", apart)).alias("_most")
        low = staged(at(low, tile * FOLD**level).join(beside(small[-1], lists(occupied[-1], 1)), own, "left").select(*columns, most), "open")

    # down: through the tiles that a source nearer than the bound may lie in
    within = F.col("_most") * (1 + 1e-12) + extent
    pairs = None
    for up in range(level, 0, -1):
        size, inner = tile * FOLD**up, tile * FOLD ** (up - 1)
        new = spread(hits[up - 1], "_row")
        for t, c in zip(cells, mine):
            new = new.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - within) / size), F.floor((F.col(c) + within) / size))))
        pairs = new if pairs is None else pairs.unionByName(new)
        below = occupied[up - 1].select(*keys, *(F.floor(F.col(t) / FOLD).alias(t) for t in cells), F.struct(*(F.col(t).alias(f"_c{t}") for t in cells), "_s.*").alias("_s"))
        beyond = lambda s: _apart([(F.greatest(F.lit(0.0), s[f"_c{t}"] * inner - F.col(c), F.col(c) - (s[f"_c{t}"] + 1) * inner), F.lit(0.0)) for t, c in zip(cells, mine)])  # noqa: B023, E731
        met = pairs.join(beside(small[up - 1], lists(below, 0)), own).withColumn("_most", F.least("_most", F.array_min(F.transform("_near", apart))))
        met = met.withColumn("_near", F.filter("_near", lambda s: beyond(s) <= within)).withColumn("_most", F.min("_most").over(Window.partitionBy("_row")))
        met = met.withColumn("_s", F.explode("_near")).where(beyond(F.col("_s")) <= within)
        pairs = met.select(*columns, "_most", *(F.col(f"_s._c{t}").alias(t) for t in cells))
    return one(done.unionByName(pairs.join(beside(few, lists(placed, 0)), own).select(*identity, best)))
