"""Points against polygons, subfaults, triangles and boundaries: tile keys for candidates, exact tests after the join."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from .nearest import nearest, spread

EARTH_KM = 6371.0088
FEW_POINTS = 40  # that are triangulated number by number


def inside_ring(ring: Column, x: Column, y: Column) -> Column:
    """Crossing test against an array of (x, y) vertices; points on an edge fall on either side."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"]))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def _edge_distance(p: Column, q: Column, x: Column, y: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    t = F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Planar distance to the nearest edge."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.array_min(F.zip_with(ring, after, lambda p, q: _edge_distance(p, q, x, y)))


def tiles_of_ring(shapes: DataFrame, tile: float, grow: float = 0.0, ring: str = "ring") -> DataFrame:
    """A row for each tile (tx, ty) that the ring's grown box touches."""
    low = lambda c: F.floor((F.array_min(F.transform(ring, lambda p: p[c])) - grow) / tile)
    high = lambda c: F.floor((F.array_max(F.transform(ring, lambda p: p[c])) + grow) / tile)
    return shapes.withColumn("tx", F.explode(F.sequence(low("x"), high("x")))).withColumn("ty", F.explode(F.sequence(low("y"), high("y"))))


def tiled(points: DataFrame, tile: float, x: str, y: str) -> DataFrame:
    return points.withColumns({"tx": F.floor(F.col(x) / tile), "ty": F.floor(F.col(y) / tile)})


def points_in_polygons(points: DataFrame, polygons: DataFrame, *, x: str = "x", y: str = "y", tile: float = 1.0, eps: float = 0.0) -> DataFrame:
    """Pairs of a point and each polygon (ring: array of (x, y)) that covers it, grown by eps."""
    met = tiled(points, tile, x, y).join(tiles_of_ring(polygons, tile, eps), ["tx", "ty"])
    hit = inside_ring(F.col("ring"), F.col(x), F.col(y))
    return met.where(hit | (ring_distance(F.col("ring"), F.col(x), F.col(y)) <= eps) if eps else hit).drop("tx", "ty")


def find_epicenter_subfault(events: DataFrame, subfaults: DataFrame, eps: float = 1e-5, strict: bool = True) -> DataFrame:
    """Subfaults (with polygon: array of (lon, lat)) whose polygon grown by eps degrees covers the event's long, lat."""
    at = events.select("event_id", F.col("long").alias("_lon"), F.col("lat").alias("_lat"))
    rings = subfaults.withColumn("ring", F.transform("polygon", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))
    both = rings.join(at, "event_id", "right")  # the event is the tile: a point meets its own rupture only
    hit = inside_ring(F.col("ring"), F.col("_lon"), F.col("_lat")) | (ring_distance(F.col("ring"), F.col("_lon"), F.col("_lat")) <= eps)
    found = both.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    if strict:
        any_ = F.max("_hit").over(Window.partitionBy("event_id"))
        found = found.withColumn("_hit", F.when(any_, F.col("_hit")).otherwise(F.raise_error(F.lit("an epicentre lies in no subfault")).cast("boolean")))
    return found.where("_hit").drop("_hit", "_lon", "_lat", "ring")


def segment_angles(points: DataFrame, polygons: DataFrame, *, identity: list[str], x: str = "lon", y: str = "lat", tile: float = 1.0, strict: bool = True) -> DataFrame:
    """strike and dip of the first polygon (seg_order, ring, strike, dip) that holds each point; an error if none does and strict."""
    found = points_in_polygons(points, polygons, x=x, y=y, tile=tile)
    first = found.groupBy(*identity).agg(F.min_by(F.struct("strike", "dip", "seg_order"), "seg_order").alias("_s"))
    out = points.join(first, identity, "left")
    missing = F.raise_error(F.lit("a point lies in no segment polygon")).cast("double") if strict else F.lit(None).cast("double")
    pick = lambda c: F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}").cast("double")).otherwise(missing).alias(c)
    return out.select(*points.columns, pick("strike"), pick("dip"), F.col("_s.seg_order").alias("seg_order"))


def closest_subfault(points: DataFrame, subfaults: DataFrame, *, keys: list[str], identity: list[str], tile: float = 50.0) -> DataFrame:
    """Nearest subfault in kilometres (x_km, y_km) of the point's own rupture: row-major index and distance; NaN left out."""
    nodes = subfaults.where(finite(F.col("x_km")) & finite(F.col("y_km"))).select(*keys, "segment_id", "subfault_id", F.col("x_km").alias("_x"), F.col("y_km").alias("_y"))
    asked = points.where(finite(F.col("x_km")) & finite(F.col("y_km")))
    nodes = nodes.groupBy(*keys, "_x", "_y").agg(F.min(F.struct("segment_id", "subfault_id")).alias("_first")).select(*keys, "_x", "_y", "_first.*")  # of several at one place the first by rank
    d = lambda s: F.sqrt(F.pow(F.col("x_km") - s["_x"], 2) + F.pow(F.col("y_km") - s["_y"], 2))
    rank = lambda s: [s[c].alias(c) for c in ("segment_id", "subfault_id")]
    out = nearest(asked.select(*dict.fromkeys([*keys, *identity, "x_km", "y_km"])), nodes, keys=keys, identity=identity, axes=[("x_km", "_x"), ("y_km", "_y")], tile=tile, distance=d, rank=rank)
    return out.select(*identity, F.col("_b.segment_id").alias("segment_id"), F.col("_b.subfault_id").alias("subfault_id"), F.col("_b.d").alias("distance_km"))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _on_sphere(lon: Column, lat: Column) -> list[Column]:
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _chord(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))


def arc_chord(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Chord (of the unit sphere) from p to the nearest place of the shorter arc from a to b."""
    n = _cross(a, b)
    size = F.sqrt(_dot(n, n))
    off = F.abs(_dot(p, n)) / F.when(size > 0, size)  # sine of the angle to the arc's circle
    ahead = (_dot(_cross(n, a), p) >= 0) & (_dot(_cross(b, n), p) >= 0)
    to_circle = 2 * F.sin(F.asin(F.least(F.lit(1.0), off)) / 2)
    return F.when((size > 0) & ahead, to_circle).otherwise(F.least(_chord(p, a), _chord(p, b)))


def distance_to_boundaries(nodes: DataFrame, lines: DataFrame, *, identity: list[str], type_filter: str | None = "subduction", names: list[str] | None = None, contains: bool = False, tile: float = 2.0) -> DataFrame:
    """Kilometres on the sphere from each node (lon, lat) to the nearest edge of the chosen lines (line_id, name, type, seq, lon, lat).

    Edges are the shorter arcs of great circles. Arcs and nodes meet in tiles of space about the unit sphere, of `tile` degrees, where neither the date line nor the poles are anything special; arcs
    come in pieces shorter than a tile. Nodes and vertices without finite coordinates take no part; without any edge there are no rows.
    """
    kind = F.lower("type")
    chosen = lines.where(F.col("name").isin(names)) if names is not None else lines.where(F.contains(kind, F.lit(type_filter.lower())) if contains else kind == type_filter.lower()) if type_filter else lines
    order = Window.partitionBy("line_id").orderBy("seq")
    ok = finite(F.col("lon")) & finite(F.col("lat"))
    ends = chosen.where(ok).select("line_id", "seq", *(c.alias(f"_a{k}") for k, c in enumerate(_on_sphere(F.col("lon"), F.col("lat")))))
    edges = ends.select("line_id", *(f"_a{k}" for k in range(3)), *(F.lead(f"_a{k}").over(order).alias(f"_b{k}") for k in range(3))).where("_b0 is not null")
    a, b, p = ([F.col(f"_{x}{k}") for k in range(3)] for x in "abp")
    step = math.radians(tile)
    angle = 2 * F.asin(F.least(F.lit(1.0), _chord(a, b) / 2))
    pieces = edges.withColumn("_angle", angle).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_angle") / step).cast("int"))).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))

    def along(t: Column) -> list[Column]:  # the place at share t of the arc
        s = F.sin("_angle")
        u, v = F.when(s > 1e-12, F.sin((1 - t) * F.col("_angle")) / s).otherwise(1 - t), F.when(s > 1e-12, F.sin(t * F.col("_angle")) / s).otherwise(t)
        return [u * x + v * y for x, y in zip(a, b)]

    middle, t = F.struct(*(c.alias(f"m{k}") for k, c in enumerate(along((F.col("_k") - 0.5) / F.col("_n"))))), [(F.col("_k") - j) / F.col("_n") for j in (1, 0)]
    bit = [F.struct(*(c.alias(f"m{k}") for k, c in enumerate(along(x)))) for x in t]
    have = pieces.select("line_id", middle.alias("_m"), bit[0].alias("_f"), bit[1].alias("_l"), "_n", *(f"_{x}{k}" for x in "ab" for k in range(3)))
    ends_of = lambda x, own: [F.when(F.col("_n") == 1, F.col(f"_{own}{k}")).otherwise(F.col(f"_{x}.m{k}")).alias(f"_{own}{k}") for k in range(3)]
    have = have.select("line_id", *(F.col(f"_m.m{k}").alias(f"_m{k}") for k in range(3)), *ends_of("f", "a"), *ends_of("l", "b"))
    asked = nodes.where(ok).select(*identity, *(c.alias(f"_p{k}") for k, c in enumerate(_on_sphere(F.col("lon"), F.col("lat")))))
    out = nearest(asked, have, keys=[], identity=identity, axes=[(f"_p{k}", f"_m{k}") for k in range(3)], tile=step, extent=step * 0.51, distance=lambda s: arc_chord(p, *([s[f"_{x}{k}"] for k in range(3)] for x in "ab")), rank=lambda s: [s["line_id"].alias("line_id")])
    return out.select(*identity, (2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.col("_b.d") / 2))).alias("distance_km"))


def rasterize_triangles(triangles: DataFrame, nx: int = 100, ny: int = 100) -> DataFrame:
    """Constant value of each triangle (tri_id, x1..y3, value) on a regular grid over all vertices; 0 outside; the smaller tri_id wins edges."""
    xs, ys = [f"x{k}" for k in (1, 2, 3)], [f"y{k}" for k in (1, 2, 3)]
    box = triangles.agg(F.min(F.least(*xs)).alias("x_min"), F.max(F.greatest(*xs)).alias("x_max"), F.min(F.least(*ys)).alias("y_min"), F.max(F.greatest(*ys)).alias("y_max"))
    at = lambda lo, hi, k, n: F.col(lo) + F.col(k) * (F.col(hi) - F.col(lo)) / (n - 1)
    grid = box.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    grid = grid.select("i", "j", at("x_min", "x_max", "i", nx).alias("x"), at("y_min", "y_max", "j", ny).alias("y"))
    of = triangles.withColumn("_k", F.lit(1)).join(F.broadcast(box.withColumn("_k", F.lit(1))), "_k")
    cell = lambda c, lo, hi, n: F.try_divide((c - F.col(lo)) * (n - 1), F.col(hi) - F.col(lo))
    span = lambda cs, lo, hi, n: F.sequence(F.greatest(F.lit(0), F.floor(cell(F.least(*cs), lo, hi, n)).cast("int")), F.least(F.lit(n - 1), F.ceil(cell(F.greatest(*cs), lo, hi, n)).cast("int")))
    touched = of.withColumn("i", F.explode(span(xs, "x_min", "x_max", nx))).withColumn("j", F.explode(span(ys, "y_min", "y_max", ny))).drop("x_min", "x_max", "y_min", "y_max", "_k")
    side = lambda a, b: (F.col(f"x{b}") - F.col(f"x{a}")) * (F.col("y") - F.col(f"y{a}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (F.col("x") - F.col(f"x{a}"))
    s = [side(1, 2), side(2, 3), side(3, 1)]
    inside = (F.least(*s) >= -1e-12) | (F.greatest(*s) <= 1e-12)
    hits = touched.join(grid, ["i", "j"]).where(inside).groupBy("i", "j").agg(F.min_by("value", "tri_id").alias("value"))
    return grid.join(hits, ["i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def ear_clip(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon as vertex numbers."""
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    n = len(ring)
    area = sum(ring[k][0] * ring[(k + 1) % n][1] - ring[(k + 1) % n][0] * ring[k][1] for k in range(n))
    left = list(range(n)) if area >= 0 else list(range(n))[::-1]
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = (left[(k + d) % len(left)] for d in (-1, 0, 1))
            if cross(ring[a], ring[b], ring[c]) <= 0:
                continue
            rest = [v for v in left if v not in (a, b, c)]
            if not any(min(cross(ring[a], ring[b], ring[v]), cross(ring[b], ring[c], ring[v]), cross(ring[c], ring[a], ring[v])) >= 0 for v in rest):
                out.append((a, b, c))
                del left[k]
                break
        else:  # only flat corners are left
            del left[0]
    return [*out, tuple(left)] if len(left) == 3 else out


def triangulate(polygons: DataFrame) -> DataFrame:
    """polygons (poly_id, ring) as triangles: poly_id, tri_id, x1..y3. One small polygon at a time."""
    kind = polygons.schema["poly_id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = []
            for pid, ring in zip(f["poly_id"], f["ring"]):
                pts = np.array([(p["x"], p["y"]) for p in ring], float)
                pts = pts[:-1] if len(pts) > 1 and (pts[0] == pts[-1]).all() else pts
                rows += [(pid, t, *pts[list(tri)].ravel()) for t, tri in enumerate(ear_clip(pts))]
            yield pd.DataFrame(rows, columns=["poly_id", "tri_id", "x1", "y1", "x2", "y2", "x3", "y3"])

    return polygons.mapInPandas(run, f"poly_id {kind}, tri_id int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")


def _sign(rough: np.ndarray, bound: np.ndarray, exact) -> np.ndarray:
    """Signs of determinants: by floating point where that is sure, else by exact fractions (exact(k) of row k)."""
    out = np.sign(rough).astype(int)
    for k in np.flatnonzero(np.abs(rough) <= bound):
        value = exact(k)
        out[k] = (value > 0) - (value < 0)
    return out


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """1 where a, b, c turn left, -1 right, 0 on one line: exact."""
    left, right = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]), (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])

    def exact(k):
        (ax, ay), (bx, by), (cx, cy) = ([Fraction(float(x)) for x in p[k]] for p in (a, b, c))
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    return _sign(left - right, 4e-15 * (np.abs(left) + np.abs(right)), exact)


def _in_circle(a: np.ndarray, b: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """1 where p lies inside the circle through a, b, c (turning left), 0 on it: exact."""
    (ax, ay), (bx, by), (cx, cy) = ((q - p).T for q in (a, b, c))
    sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    terms = ax * by * sc, -ax * sb * cy, -ay * bx * sc, ay * sb * cx, sa * bx * cy, -sa * by * cx

    def exact(k):
        px, py = (Fraction(float(x)) for x in p)
        rows = [(Fraction(float(q[k][0])) - px, Fraction(float(q[k][1])) - py) for q in (a, b, c)]
        (x1, y1), (x2, y2), (x3, y3) = rows
        s1, s2, s3 = (x * x + y * y for x, y in rows)
        return x1 * (y2 * s3 - s2 * y3) - y1 * (x2 * s3 - s2 * x3) + s1 * (x2 * y3 - y2 * x3)

    return _sign(sum(terms), 2e-14 * sum(np.abs(t) for t in terms), exact)


def _turn_of(a: tuple, b: tuple, c: tuple) -> int:
    """_turn of three points."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    if abs(left - right) > 4e-15 * (abs(left) + abs(right)):
        return 1 if left > right else -1
    return int(_turn(*(np.array([q]) for q in (a, b, c)))[0])


def _in_circle_of(a: tuple, b: tuple, c: tuple, p: tuple) -> int:
    """_in_circle of three points and one."""
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    t = ax * by * sc, -ax * sb * cy, -ay * bx * sc, ay * sb * cx, sa * bx * cy, -sa * by * cx
    rough = sum(t)
    if abs(rough) > 2e-14 * sum(map(abs, t)):
        return 1 if rough > 0 else -1
    return int(_in_circle(*(np.array([q]) for q in (a, b, c)), np.array(p))[0])


def _delaunay_of_few(points: np.ndarray) -> np.ndarray:
    """delaunay, number by number: for a dozen points arrays cost more than they save."""
    p = [tuple(q) for q in points.tolist()]
    third = next((k for k in range(2, len(p)) if _turn_of(p[0], p[1], p[k])), None)
    if third is None:
        return np.zeros((0, 3), int)
    first = (0, 1, third) if _turn_of(p[0], p[1], p[third]) > 0 else (1, 0, third)
    tris = [first, *((first[(k + 1) % 3], first[k], -1) for k in range(3))]

    def bad(t: tuple, q: tuple) -> bool:
        u, v = p[t[0]], p[t[1]]
        if t[2] >= 0:
            return _in_circle_of(u, v, p[t[2]], q) > 0
        side = _turn_of(u, v, q)
        return side > 0 or side == 0 and ((u[0] < q[0]) != (v[0] < q[0]) or (u[1] < q[1]) != (v[1] < q[1])) and min(u[0], v[0]) <= q[0] <= max(u[0], v[0]) and min(u[1], v[1]) <= q[1] <= max(u[1], v[1])

    for k in range(2, len(p)):
        if k == third:
            continue
        out = [bad(t, p[k]) for t in tris]
        gone = [t for t, b in zip(tris, out) if b]
        edges = [(t[i], t[(i + 1) % 3]) for i in range(3) for t in gone]
        there = set(edges)
        rim = [e for e in edges if e[::-1] not in there]
        tris = [t for t, b in zip(tris, out) if not b] + [(v, k, u) if u < 0 else (k, u, v) if v < 0 else (u, v, k) for u, v in rim]  # infinity comes last
    return np.array([t for t in tris if min(t) >= 0], int).reshape(-1, 3)


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (left turns) of distinct points, one point put in after another; points on one line have none.

    Each edge of the hull has a triangle with a vertex at infinity, -1, so that the hull is covered whole however flat it is. Tests are exact: of four points on
    one circle the diagonal that was there first stays.
    """
    p = np.asarray(points, float)
    n = len(p)
    if n < 3:
        return np.zeros((0, 3), int)
    if n <= FEW_POINTS:
        return _delaunay_of_few(p)
    turns = _turn(np.repeat(p[:1], n, 0), np.repeat(p[1:2], n, 0), p)
    if not turns.any():
        return np.zeros((0, 3), int)
    third = int(np.flatnonzero(turns)[0])
    first = (0, 1, third) if turns[third] > 0 else (1, 0, third)
    tris = np.array([first, *((first[(k + 1) % 3], first[k], -1) for k in range(3))])
    for k in range(2, n):
        if k == third:
            continue
        ghost = tris[:, 2] < 0
        bad = np.zeros(len(tris), bool)
        real = tris[~ghost]
        bad[~ghost] = _in_circle(p[real[:, 0]], p[real[:, 1]], p[real[:, 2]], p[k]) > 0
        u, v = p[tris[ghost, 0]], p[tris[ghost, 1]]
        side = _turn(u, v, np.repeat(p[k : k + 1], len(u), 0))
        between = ((u < p[k]) != (v < p[k])).any(1) & (np.minimum(u, v) <= p[k]).all(1) & (p[k] <= np.maximum(u, v)).all(1)
        bad[ghost] = (side > 0) | ((side == 0) & between)
        edges = np.concatenate([tris[bad][:, [0, 1]], tris[bad][:, [1, 2]], tris[bad][:, [2, 0]]])
        code = (edges[:, 0] + 1) * (n + 1) + edges[:, 1] + 1
        rim = edges[~np.isin(code, (edges[:, 1] + 1) * (n + 1) + edges[:, 0] + 1)]
        new = np.column_stack([rim, np.full(len(rim), k)])
        new[rim[:, 0] < 0] = new[rim[:, 0] < 0][:, [1, 2, 0]]  # infinity comes last
        new[rim[:, 1] < 0] = new[rim[:, 1] < 0][:, [2, 0, 1]]
        tris = np.concatenate([tris[~bad], new])
    return tris[(tris >= 0).all(1)]


def scatter_triangles(points: DataFrame, keys: list[str]) -> DataFrame:
    """Delaunay triangles of the scattered (x, y, v) of each key: keys, tri_id, x1..y3, v1..v3. Of points at one place the least value counts.

    A key, a segment of some hundred points, is one task's group.
    """
    key_schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"{c}{k}" for k in (1, 2, 3) for c in "xyv"]

    def run(rows: pa.Table) -> pa.Table:
        x, y, v = (rows.column(c).to_numpy() for c in "xyv")
        p = np.column_stack([x, y, v])[np.lexsort((v, y, x))]
        p = p[np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(1)])]
        tris = delaunay(p[:, :2])
        of = {k: pa.array([rows.column(k)[0].as_py()] * len(tris), rows.schema.field(k).type) for k in keys}
        return pa.table(of | {"tri_id": pa.array(np.arange(len(tris), dtype=np.int32))} | dict(zip(names, p[tris].reshape(len(tris), 9).T.copy())))

    some = points.select(*keys, "x", "y", "v").where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("v")))
    return spread(some, *keys).groupBy(*keys).applyInArrow(run, f"{key_schema}, tri_id int, {', '.join(f'{c} double' for c in names)}")


def grid_scatter(points: DataFrame, keys: list[str], nx: int, ny: int, method: str = "linear", fill: float = 0.0) -> DataFrame:
    """Scattered (x, y, v) of each key on a regular nx by ny grid over their extent: keys, i, j, x, y, value.

    'linear' weighs the corners of the Delaunay triangle that a grid node lies in, the largest of several, `fill` outside the hull; a triangle meets the nodes of its box only. 'nearest' takes the
    nearest point's value, the first by x and y of equally near ones. Of points at one place the least value counts; keys must not be null.
    """
    if method not in ("linear", "nearest"):
        raise ValueError("method must be 'linear' or 'nearest'")
    some = points.select(*keys, "x", "y", "v").where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("v")))
    box = some.groupBy(*keys).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    place = lambda k, c, n: F.when(F.col(k) == n - 1, F.col(f"_{c}1")).otherwise(F.col(f"_{c}0") + F.col(k) * ((F.col(f"_{c}1") - F.col(f"_{c}0")) / max(1, n - 1)))
    by = [*keys, "i", "j"]
    if method == "nearest":
        nodes = box.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
        nodes = nodes.select(*keys, "i", "j", place("i", "x", nx).alias("x"), place("j", "y", ny).alias("y"))
        each = some.groupBy(*keys, "x", "y").agg(F.min("v").alias("v")).select(*keys, F.col("x").alias("_px"), F.col("y").alias("_py"), "v")
        d2 = lambda s: (F.col("x") - s["_px"]) * (F.col("x") - s["_px"]) + (F.col("y") - s["_py"]) * (F.col("y") - s["_py"])
        rank = lambda s: [d2(s).alias("_d2"), *(s[c].alias(c) for c in ("_px", "_py", "v"))]
        span = box.agg(F.max(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")))).first()[0]
        found = nearest(nodes, each, keys=keys, identity=[*by, "x", "y"], axes=[("x", "_px"), ("y", "_py")], tile=(span or 1.0) / 8, distance=lambda s: F.sqrt(d2(s)), rank=rank)
        return found.select(*by, "x", "y", F.col("_b.v").alias("value"))
    # each key's box is one more triangle, that holds every node and counts where no other does
    each = scatter_triangles(points, keys)
    corners = F.struct(*(c for c in each.columns if c not in keys))
    lists = each.groupBy(*keys).agg(F.collect_list(corners).alias("_tris"))  # twice as many as a key's points
    hull = F.lit(None).cast(each.select(corners.alias("t")).schema["t"].dataType)
    tri = spread(box.join(lists, keys, "left"), *keys).withColumn("_tri", F.explode(F.concat(F.array(hull), F.coalesce("_tris", F.array().cast(lists.schema["_tris"].dataType))))).drop("_tris").select(*keys, "_x0", "_x1", "_y0", "_y1", "_tri.*")
    cell = lambda v, c, n: F.coalesce(F.try_divide((v - F.col(f"_{c}0")) * (n - 1), F.col(f"_{c}1") - F.col(f"_{c}0")), F.lit(0.0))
    low = lambda c, n: F.greatest(F.lit(0), F.floor(cell(F.least(*(f"{c}{k}" for k in (1, 2, 3))), c, n)).cast("int"))
    high = lambda c, n: F.least(F.lit(n - 1), F.ceil(cell(F.greatest(*(f"{c}{k}" for k in (1, 2, 3))), c, n)).cast("int"))
    span = lambda c, n: F.sequence(F.when(F.col("tri_id").isNull(), 0).otherwise(low(c, n)), F.when(F.col("tri_id").isNull(), n - 1).otherwise(high(c, n)))
    size = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x3") - F.col("x1"))
    met = tri.withColumn("_all", F.coalesce(size, F.lit(0.0))).where("tri_id is null or _all > 0").withColumn("i", F.explode(span("x", nx))).withColumn("j", F.explode(span("y", ny))).withColumns({"x": place("i", "x", nx), "y": place("j", "y", ny)})
    side = lambda a, b: (F.col(f"x{b}") - F.col(f"x{a}")) * (F.col("y") - F.col(f"y{a}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (F.col("x") - F.col(f"x{a}"))
    met = met.withColumns({f"_w{a}": side(b, c) / F.when(F.col("_all") > 0, F.col("_all")) for a, b, c in ((1, 2, 3), (2, 3, 1), (3, 1, 2))})
    value = F.when(F.col("tri_id").isNull(), F.lit(float(fill))).otherwise(F.col("_w1") * F.col("v1") + F.col("_w2") * F.col("v2") + F.col("_w3") * F.col("v3"))
    inside = met.where((F.least("_w1", "_w2", "_w3") >= -1e-9) | F.col("tri_id").isNull()).select(*by, "x", "y", value.alias("_v"), "_all", "tri_id")
    out = inside.groupBy(*by).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.min_by("_v", F.struct(-F.col("_all"), "tri_id")).alias("value"))  # weights of nearly flat triangles are the least sure
    return out.select(*by, "x", "y", "value")


def regrid(target: DataFrame, source: DataFrame, max_radius_deg: float = 30.0, step_deg: float = 5.0) -> DataFrame:
    """source at the finite nodes of target: bilinear; where undefined the nearest node on the axes; where still undefined the
    nearest defined source node (each longitude scaled by the cosine of its own latitude) within the radius, rounded up to whole steps; NaN elsewhere.

    An error if target has no finite node, or if the boxes of a target and a source do not meet.
    """
    from .grid import grid_meta
    from .lookup import lookup_grid, on_each

    boxes = [grid_meta(g).select("grid_id", "x_min", "x_max", "y_min", "y_max") for g in (target, source)]
    t, s = (b.select(*(F.col(c).alias(f"{p}_{c}") for c in b.columns)) for b, p in zip(boxes, "ts"))
    pairs = on_each(t.withColumnRenamed("t_grid_id", "t_id"), "grid_id", source).join(s, F.col("grid_id") == F.col("s_grid_id"))
    apart = (F.col("t_x_max") < F.col("s_x_min")) | (F.col("s_x_max") < F.col("t_x_min")) | (F.col("t_y_max") < F.col("s_y_min")) | (F.col("s_y_max") < F.col("t_y_min"))
    if pairs.where(apart).limit(1).count():
        raise ValueError("a target and a source grid do not overlap")
    if target.where(finite(F.col("value"))).isEmpty():
        raise ValueError("the target has no finite node")
    meta = grid_meta(source)
    nodes = target.where(finite(F.col("value"))).select("grid_id", "lat_idx", "lon_idx", "lat", "lon")
    asked = on_each(nodes.withColumnRenamed("grid_id", "target_id"), "grid_id", source)
    linear = lookup_grid(asked, source, outside="null", out="linear").join(F.broadcast(meta), "grid_id")
    at = lambda c, lo, hi, n: F.round(F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)) * (F.col(n) - 1)).cast("int")
    near = linear.withColumns({"_i": at("lon", "x_min", "x_max", "n_x"), "_j": at("lat", "y_min", "y_max", "n_y")})
    own = source.select("grid_id", F.col("lon_idx").alias("_i"), F.col("lat_idx").alias("_j"), F.col("value").alias("nearest"))
    two = near.join(own, ["grid_id", "_i", "_j"], "left").withColumn("value", F.when(finite(F.col("linear")), F.col("linear")).otherwise(F.col("nearest")))
    two = two.select("target_id", "grid_id", "lat_idx", "lon_idx", "lat", "lon", "value")
    radius = math.ceil(max_radius_deg / step_deg) * step_deg
    flat = lambda x, y: F.col(x) * F.cos(F.radians(y))
    holes = two.where(~finite(F.col("value"))).select("target_id", "grid_id", "lat_idx", "lon_idx", "lat", flat("lon", "lat").alias("_u"))
    have = source.where(finite(F.col("value"))).select("grid_id", flat("lon", "lat").alias("_w"), F.col("lat").alias("_y"), F.col("lon").alias("_x"), F.col("value").alias("_v"))
    d = lambda s: F.sqrt((F.col("_u") - s["_w"]) * (F.col("_u") - s["_w"]) + (F.col("lat") - s["_y"]) * (F.col("lat") - s["_y"]))
    rank = lambda s: [s[c].alias(c) for c in ("_y", "_x", "_v")]
    near = nearest(holes, have, keys=["grid_id"], identity=["target_id", "grid_id", "lat_idx", "lon_idx"], axes=[("_u", "_w"), ("lat", "_y")], tile=step_deg, distance=d, rank=rank)
    filled = near.where(F.col("_b.d") <= radius).select("target_id", "grid_id", "lat_idx", "lon_idx", F.col("_b._v").alias("filled"))
    out = two.join(filled, ["target_id", "grid_id", "lat_idx", "lon_idx"], "left")
    return out.select("target_id", "grid_id", "lat_idx", "lon_idx", "lat", "lon", F.when(finite(F.col("value")), F.col("value")).otherwise(F.coalesce("filled", F.lit(float("nan")))).alias("value"))
