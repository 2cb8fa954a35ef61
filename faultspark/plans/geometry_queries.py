"""More registered queries: moves, replacements, nearest and covering shapes, rasters, densities and level-wise comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import finite
from ..operators import compare, ecdf, faults, grid, kde, lookup, sampling, spatial
from ..sources import adapters as A
from .bootstrap_sql import bootstrap

X = [5.0 * k for k in range(21)]
QX, QY = [10.0, 20.0, 30.0, 40.0, 50.0], [1e4, 3e4, 5e4, 7e4]


def _r(df, *cols, places=9):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _moved_points(s, d):
    p = A.places(s, d)
    return p.select("point_id", F.lit("g").alias("grid_id"), F.col("key").alias("transform_id"), (-73.5 + F.col("x") * 0.6).alias("lon"), (-32 + F.col("y") * 1.4).alias("lat"))


def _rotated(s, d):
    both = _moved_points(s, d).join(A.transforms(s, d), "transform_id")
    move = [F.col(c) for c in ("angle_deg", "dx", "dy", "px", "py")]
    x, y = grid.rotate_translate(F.col("lon"), F.col("lat"), *move)
    both = both.withColumns({"x": x, "y": y})
    bx, by = grid.inverse_transform(F.col("x"), F.col("y"), *move)
    return _r(both.select("point_id", "x", "y", bx.alias("back_x"), by.alias("back_y")), "x", "y", "back_x", "back_y")


def _doubled_slip(s, d):
    own = A.subfaults(s, d)
    new = own.select("event_id", "segment_id", "subfault_id", (F.col("slip") * 2).alias("slip"))
    return _r(faults.replace_slip(own, new).select("event_id", "segment_id", "subfault_id", "slip"), "slip")


def _complement(s, d):
    own = A.grid(s, d)
    return _r(grid.defined_nodes(grid.replace_values(own, own.withColumn("value", 1 - F.col("value")))).select("grid_id", "lat_idx", "lon_idx", "value"), "value")


def _closest(s, d):
    flat = lambda df: df.withColumns({"x_km": F.col("lon") * 100, "y_km": F.col("lat") * 100})
    points = flat(_moved_points(s, d)).withColumn("event_id", F.col("point_id") % 61)
    return _r(spatial.closest_subfault(points, flat(A.subfaults(s, d)), keys=["event_id"], identity=["point_id"]), "distance_km", places=6)


def _level_comparison(s, d):
    v = A.values(s, d)
    of = lambda rows: ecdf.ecdf_on_grid(rows, "value", X, ["k", "weight"])
    return _r(compare.observed_vs_null(of(v.where("weight < 2")), of(v.where("weight >= 2")), ["k"]), "p_gt")


def _level_interval(s, d):
    v = A.values(s, d)
    of = lambda rows: ecdf.ecdf_on_grid(rows, "value", X, ["k", "weight"])
    return _r(compare.observed_vs_null(of(v.where("weight < 2")), of(v.where("weight >= 2")), ["k"], resamples=1000), "p_gt", "ci_low", "ci_high")


def _relative_time(s, d):
    t = A.subfaults(s, d).select("event_id", "subfault_id", faults.average_time().alias("t"))
    return _r(sampling.normalize_time(t, ["event_id"], "t").where(finite(F.col("t"))), "t")


QUERIES = {
    "filter_events": lambda s, d: _r(grid.filter_events(A.events(s, d), (-70.7, -70.0, -26.0, -24.0), 24.5), "long", "lat", "depth"),
    "replace_slip": _doubled_slip,
    "replace_values": _complement,
    "normalize_points": lambda s, d: _r(grid.normalize_points(_moved_points(s, d), grid.grid_meta(A.grid(s, d))).select("point_id", "u", "v"), "u", "v"),
    "rotate_translate": _rotated,
    "lookup_transformed": lambda s, d: _r(lookup.lookup_transformed(_moved_points(s, d), grid.with_nan_to_zero(A.grid(s, d)), A.transforms(s, d)).select("point_id", "value"), "value"),
    "closest_subfault": _closest,
    "sample_surface_projection": lambda s, d: _r(sampling.sample_surface_projection(A.grid(s, d), 10000.0, 1.0, 1.0, rng="md5"), "lon", "lat", "value"),
    "random_order_take": lambda s, d: sampling.random_order_take(A.subfaults(s, d).select("event_id", "subfault_id"), 5, ["event_id"], ["subfault_id"], rng="md5"),
    "normalize_time": _relative_time,
    "distance_to_boundaries": lambda s, d: _r(spatial.distance_to_boundaries(A.grid(s, d), A.lines(s, d), identity=["lat_idx", "lon_idx"]), "distance_km", places=6),
    "distance_over_date_line": lambda s, d: _r(spatial.distance_to_boundaries(A.ocean_nodes(s, d), A.ocean_lines(s, d), identity=["point_id"]), "distance_km", places=6),
    "rasterize_triangles": lambda s, d: _r(spatial.rasterize_triangles(A.triangles(s, d), 20, 20), "x", "y", "value"),
    "bandwidth": lambda s, d: _r(kde.effective_n(A.values(s, d), ["k"], "weight").select("k", kde.bandwidth("silverman", F.col("n_eff"), 1).alias("h")), "h"),
    "kde_pdf2d": lambda s, d: _r(kde.kde_pdf2d(A.read(s, d, "lineitem"), "l_quantity", "l_extendedprice", QX, QY).withColumn("pdf", F.col("pdf") * 1e6), "pdf", places=6),
    "observed_vs_null": _level_comparison,
    "observed_vs_null_ci": _level_interval,
}

_POINTS = "(SELECT c_custkey AS point_id, c_nationkey AS transform_id, -73.5e0 + ((c_custkey * 7919) % 1009 / 101e0) * 0.6e0 AS lon, -32 + ((c_custkey * 104729) % 1013 / 101.3e0) * 1.4e0 AS lat FROM customer)"
_MOVES = "(SELECT n_nationkey AS transform_id, n_nationkey * 15e0 AS angle_deg, n_nationkey * 0.02e0 AS dx, n_nationkey * -0.03e0 AS dy, -70.5e0 AS px, -25e0 AS py FROM nation)"
_SUB = "(SELECT o_custkey % 61 AS event_id, CAST(o_orderkey % 3 AS INTEGER) AS segment_id, o_orderkey AS subfault_id, o_totalprice / 125000e0 AS slip, -72 + (o_orderkey % 97) * 3e-2 AS lon, -30 + (o_orderkey % 211) * 5e-2 AS lat, 5e0 + o_orderkey % 40 AS z, o_orderkey % 13 + 0.5e0 * (o_orderkey % 5) AS t FROM orders)"
_GRID = """(SELECT j AS lat_idx, i AS lon_idx, -31 + j * 2e0 AS lat, -73 + i * 5e0 / 49 AS lon,
 CASE WHEN (i + 1) * (j + 1) % 17 = 0 THEN NULL ELSE greatest(0e0, least(1e0, (round(d, 9) * 10 - 0.4e0) / 0.2e0)) END AS value
 FROM (SELECT CAST(l_quantity AS INTEGER) - 1 AS i, CAST(l_linenumber - 1 AS INTEGER) AS j, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2))"""
_VAL = "(SELECT event_type AS k, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value, CAST(user_id % 5 AS DOUBLE) AS weight FROM events)"
_X = "(SELECT CAST(i AS INTEGER) AS x_idx, i * 5e0 AS x FROM range(21) t(i))"
_FLAGS = """(SELECT f.grid_id, g.lat_idx, g.lon_idx, CASE WHEN g.value IS NULL OR o.d IS NULL THEN NULL ELSE greatest(0e0, least(1e0, (round(o.d, 9) * 10 - 0.4e0) / 0.2e0)) END AS value, g.value IS NOT NULL AS here
 FROM {grid} g CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS grid_id) f
 LEFT JOIN (SELECT l_returnflag, CAST(l_quantity AS INTEGER) - 1 AS i, l_linenumber - 1 AS j, avg(l_discount) AS d FROM lineitem GROUP BY ALL) o ON o.l_returnflag = f.grid_id AND o.i = g.lon_idx AND o.j = g.lat_idx)""".format(grid=_GRID)
_INDEX = "greatest(0e0, least(49e0, (lon + 73) / 5 * 49)) AS fx, greatest(0e0, least(6e0, (lat + 31) / 12 * 6)) AS fy"
_BILINEAR = "sum(g.value * (1 - abs(fx - g.lon_idx)) * (1 - abs(fy - g.lat_idx)))"
_CORNERS = "g.lon_idx BETWEEN CAST(floor(fx) AS INTEGER) AND CAST(floor(fx) AS INTEGER) + 1 AND g.lat_idx BETWEEN CAST(floor(fy) AS INTEGER) AND CAST(floor(fy) AS INTEGER) + 1"


def _arcs(nodes: str, lon: str, lat: str, by: str) -> str:
    """Kilometres to the nearest great-circle arc of the regions' lines through their nations at (lon, lat)."""
    cross = lambda a, b: [f"({a}{m} * {b}{n} - {a}{n} * {b}{m})" for m, n in ("yz", "zx", "xy")]
    dot = lambda u, v: " + ".join(f"{x} * {y}" for x, y in zip(u, v))
    xyz = lambda a: [f"{a}{c}" for c in "xyz"]
    chord = lambda a: " + ".join(f"(p{c} - {a}{c}) * (p{c} - {a}{c})" for c in "xyz")
    unit = lambda a: f"cos(radians(lat)) * cos(radians(lon)) AS {a}x, cos(radians(lat)) * sin(radians(lon)) AS {a}y, sin(radians(lat)) AS {a}z"
    return f"""WITH l AS (SELECT n_regionkey AS line, n_nationkey AS seq, {lon} AS lon, {lat} AS lat FROM nation WHERE n_regionkey % 2 = 0), u AS (SELECT line, seq, {unit("a")} FROM l),
e AS (SELECT *, lead(ax) OVER w AS zx, lead(ay) OVER w AS zy, lead(az) OVER w AS zz FROM u WINDOW w AS (PARTITION BY line ORDER BY seq)),
q AS (SELECT {by}, {unit("p")} FROM ({nodes})),
k AS (SELECT q.*, ax, ay, az, zx, zy, zz, {", ".join(f"{x} AS n{c}" for x, c in zip(cross("a", "z"), "xyz"))} FROM q, (SELECT * FROM e WHERE zx IS NOT NULL) e),
d AS (SELECT {by}, CASE WHEN {dot(cross("n", "a"), xyz("p"))} >= 0 AND {dot(cross("z", "n"), xyz("p"))} >= 0 THEN asin(least(1e0, abs({dot(xyz("p"), xyz("n"))}) / sqrt({dot(xyz("n"), xyz("n"))})))
 ELSE 2 * asin(least(1e0, sqrt(least({chord("a")}, {chord("z")})) / 2)) END AS angle FROM k)
SELECT {by}, round(6371.0088e0 * min(angle), 6) AS distance_km FROM d GROUP BY {by}"""


def _density(weight: str) -> str:
    """Gaussian density of the values at the levels, by Scott's rule."""
    return f"""WITH v AS (SELECT value, {weight} AS w FROM {_VAL} WHERE value IS NOT NULL), m AS (SELECT sum(w * value) / sum(w) AS mean, sum(w) AS mass, sum(w) * sum(w) / sum(w * w) AS n FROM v),
s AS (SELECT any_value(mass) AS mass, sqrt(sum(w * (value - mean) * (value - mean)) / sum(w)) AS sd, any_value(pow(n, -0.2e0)) AS h FROM v, m),
p AS (SELECT x_idx, x, round(sum(w * exp(-0.5e0 * pow((x - value) / sd / h, 2))) / (any_value(mass) * sqrt(2 * pi()) * any_value(h) * any_value(sd)), 9) AS pdf FROM v, s, {_X} GROUP BY x_idx, x)"""


def _random(stream: str) -> str:
    return f"CAST(CAST('0x' || substr(md5('0:{stream}:g:' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0"


ORACLE_SQL = {
    "filter_events": f"""SELECT event_id, round("long", 9) AS "long", round(lat, 9) AS lat, round(depth, 9) AS depth FROM (SELECT event_id, avg(lon) AS "long", avg(lat) AS lat, avg(z) AS depth FROM {_SUB} GROUP BY 1)
WHERE "long" BETWEEN -70.7e0 AND -70e0 AND lat BETWEEN -26e0 AND -24e0 AND depth <= 24.5e0""",
    "replace_slip": f"SELECT event_id, segment_id, subfault_id, round(slip * 2, 9) AS slip FROM {_SUB}",
    "replace_values": f"SELECT 'g' AS grid_id, lat_idx, lon_idx, round(1 - value, 9) AS value FROM {_GRID} WHERE value IS NOT NULL",
    "normalize_points": f"SELECT point_id, round((lon + 73) / 5, 9) AS u, round((lat + 31) / 12, 9) AS v FROM {_POINTS}",
    "rotate_translate": f"""SELECT point_id, round(cos(radians(angle_deg)) * (lon - px) - sin(radians(angle_deg)) * (lat - py) + px + dx, 9) AS x,
round(sin(radians(angle_deg)) * (lon - px) + cos(radians(angle_deg)) * (lat - py) + py + dy, 9) AS y, round(lon, 9) AS back_x, round(lat, 9) AS back_y FROM {_POINTS} JOIN {_MOVES} USING (transform_id)""",
    "lookup_transformed": f"""WITH b AS (SELECT point_id, cos(radians(-angle_deg)) * (lon - px - dx) - sin(radians(-angle_deg)) * (lat - py - dy) + px AS lon,
 sin(radians(-angle_deg)) * (lon - px - dx) + cos(radians(-angle_deg)) * (lat - py - dy) + py AS lat FROM {_POINTS} JOIN {_MOVES} USING (transform_id)), f AS (SELECT point_id, {_INDEX} FROM b),
g AS (SELECT lat_idx, lon_idx, coalesce(value, 0) AS value FROM {_GRID}) SELECT point_id, round({_BILINEAR}, 9) AS value FROM f JOIN g ON {_CORNERS} GROUP BY point_id""",
    "closest_subfault": f"""WITH d AS (SELECT p.point_id, s.segment_id, s.subfault_id, (p.lon * 100 - s.lon * 100) * (p.lon * 100 - s.lon * 100) + (p.lat * 100 - s.lat * 100) * (p.lat * 100 - s.lat * 100) AS d2
 FROM {_POINTS} p JOIN {_SUB} s ON p.point_id % 61 = s.event_id), n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, segment_id, subfault_id) AS place FROM d)
SELECT point_id, segment_id, subfault_id, round(sqrt(d2), 6) AS distance_km FROM n WHERE place = 1""",
    "random_order_take": f"SELECT event_id, subfault_id FROM (SELECT event_id, subfault_id, row_number() OVER (PARTITION BY event_id ORDER BY substr(md5('0:order:' || event_id || ':' || subfault_id), 1, 13), subfault_id) AS place FROM {_SUB}) WHERE place <= 5",
    "normalize_time": f"SELECT event_id, subfault_id, round(t / max(t) OVER (PARTITION BY event_id), 9) AS t FROM {_SUB} WHERE subfault_id % 7 <> 0",
    "distance_to_boundaries": _arcs(f"SELECT lat_idx, lon_idx, lon, lat FROM {_GRID}", "-73 + (n_nationkey * 7) % 25 / 5e0", "-31 + (n_nationkey * 11) % 25 / 2e0", "lat_idx, lon_idx"),
    "distance_over_date_line": _arcs("SELECT c_custkey AS point_id, 170 + (c_custkey * 7919) % 1009 / 50e0 AS lon, -85 + (c_custkey * 104729) % 1013 / 6e0 AS lat FROM customer", "CASE WHEN n_nationkey % 2 = 0 THEN 175 ELSE -185 END + (n_nationkey * 7) % 25 / 2e0", "-80 + (n_nationkey * 11) % 25 * 6e0", "point_id"),
    "rasterize_triangles": """WITH t AS (SELECT c_custkey AS tri, (c_custkey * 7919) % 1009 / 101e0 AS x, (c_custkey * 104729) % 1013 / 101.3e0 AS y, c_acctbal AS v FROM customer), b AS (SELECT min(x) AS x0, max(x + 0.5e0) AS x1, min(y) AS y0, max(y + 0.5e0) AS y1 FROM t),
g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, x0 + i * (x1 - x0) / 19 AS x, y0 + j * (y1 - y0) / 19 AS y FROM range(20) a(i), range(20) c(j), b)
SELECT i, j, round(g.x, 9) AS x, round(g.y, 9) AS y, coalesce(arg_min(v, tri), 0e0) AS value FROM g LEFT JOIN t ON g.x >= t.x - 1e-12 AND g.y >= t.y - 1e-12 AND g.x - t.x + g.y - t.y <= 0.5e0 + 1e-12 GROUP BY i, j, g.x, g.y""",
    "bandwidth": f"SELECT k, round(0.9e0 * pow(sum(weight) * sum(weight) / sum(weight * weight), -0.2e0), 9) AS h FROM {_VAL} GROUP BY k",
    "kde_pdf2d": """WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, count(*) AS n FROM lineitem),
s AS (SELECT any_value(n) AS n, sqrt(avg((l_quantity - mx) * (l_quantity - mx))) AS sx, sqrt(avg((l_extendedprice - my) * (l_extendedprice - my))) AS sy, pow(any_value(n), -1e0 / 6) AS h FROM lineitem, m)
SELECT CAST(j * 5 + i AS INTEGER) AS point_idx, (i + 1) * 10e0 AS x0, 1e4 + j * 2e4 AS x1,
 round(1e6 * sum(exp(-0.5e0 * (pow(((i + 1) * 10e0 - l_quantity) / sx / h, 2) + pow((1e4 + j * 2e4 - l_extendedprice) / sy / h, 2)))) / any_value(n * 2 * pi() * h * h * sx * sy), 6) AS pdf
FROM lineitem, s, range(5) a(i), range(4) c(j) GROUP BY i, j""",
    "observed_vs_null": f"""WITH c AS (SELECT k, weight, x_idx, CASE x_idx WHEN 0 THEN 0e0 WHEN 20 THEN 1e0 ELSE sum(CASE WHEN value <= x THEN 1e0 ELSE 0e0 END) / count(*) END AS cdf FROM {_VAL} v, {_X} x WHERE value IS NOT NULL GROUP BY k, weight, x_idx, x)
SELECT h.k AS k, h.x_idx AS x_idx, round(sum(CASE WHEN n.cdf <= h.cdf THEN 1e0 ELSE 0e0 END) / count(*), 9) AS p_gt, count(DISTINCT h.weight) AS n_h, count(DISTINCT n.weight) AS n_n
FROM c h JOIN c n ON h.k = n.k AND h.x_idx = n.x_idx AND h.weight < 2 AND n.weight >= 2 GROUP BY h.k, h.x_idx""",
    "observed_vs_null_ci": bootstrap(f"SELECT k, x_idx, weight >= 2 AS side, CASE x_idx WHEN 0 THEN 0e0 WHEN 20 THEN 1e0 ELSE sum(CASE WHEN value <= x THEN 1e0 ELSE 0e0 END) / count(*) END AS value FROM {_VAL} v, {_X} x WHERE value IS NOT NULL GROUP BY k, weight, x_idx, x", ["k", "x_idx"], 1000, 10000),
    # of queries registered beside this module
    "kde_pdf": _density("weight") + " SELECT x_idx AS point_idx, x, pdf FROM p",
    "pdf_cdf": _density("1e0") + f", c AS (SELECT x_idx, round(sum(CASE WHEN value <= x THEN 1e0 ELSE 0e0 END) / count(*), 9) AS cdf FROM {_VAL} v, {_X} x GROUP BY x_idx) SELECT x_idx, x, pdf, cdf FROM p JOIN c USING (x_idx)",
    "compare_grids": f"SELECT grid_id, true AS same_shape, count_if(here <> (value IS NOT NULL)) = 0 AS same_mask, min(CASE WHEN here <> (value IS NOT NULL) THEN CAST(lat_idx * 50 + lon_idx AS BIGINT) END) AS first_difference FROM {_FLAGS} GROUP BY grid_id",
    "lookup_many": f"WITH f AS (SELECT point_id, lon, lat, {_INDEX} FROM {_POINTS}), g AS (SELECT * FROM {_FLAGS}) SELECT point_id, grid_id, round(lon, 9) AS lon, round(lat, 9) AS lat, round({_BILINEAR}, 9) AS value FROM f JOIN g ON {_CORNERS} GROUP BY point_id, grid_id, lon, lat HAVING count(g.value) = count(*)",
    "segment_angles": """WITH b AS (SELECT n_nationkey AS k, n_nationkey % 5 * 2e0 AS x, n_nationkey // 5 * 2e0 AS y, [0e0, 2.5e0, 2.25e0, -0.25e0] AS ax, [0e0, 0.25e0, 2.75e0, 2.5e0] AS ay FROM nation),
e AS (SELECT k, x + ax[s + 1] AS px, y + ay[s + 1] AS py, x + ax[(s + 1) % 4 + 1] AS qx, y + ay[(s + 1) % 4 + 1] AS qy FROM b, range(4) r(s)),
p AS (SELECT c_custkey AS point_id, (c_custkey * 7919) % 1009 / 101e0 AS x, (c_custkey * 104729) % 1013 / 101.3e0 AS y FROM customer),
h AS (SELECT point_id, k FROM p, e GROUP BY point_id, k HAVING count_if((py > y) <> (qy > y) AND x < px + (y - py) * (qx - px) / (qy - py)) % 2 = 1)
SELECT point_id, min(k) * 10e0 AS strike, min(k) + 5e0 AS dip FROM p LEFT JOIN h USING (point_id) GROUP BY point_id""",
    "sample_surface_projection": f"""WITH g AS (SELECT lat_idx, lon_idx, value FROM {_GRID}), k AS (SELECT CAST(trunc(10000e0 / 1000.0 * 1.0 * sum(value)) AS BIGINT) AS n FROM g),
p AS (SELECT i AS proposal, -73 + {_random("x")} * 5 AS lon, -31 + {_random("y")} * 12 AS lat, {_random("h")} * (SELECT max(value) FROM g) AS h FROM range(40000) r(i)),
f AS (SELECT *, {_INDEX} FROM p), v AS (SELECT proposal, lon, lat, h, {_BILINEAR} AS value FROM f JOIN g ON {_CORNERS} GROUP BY proposal, lon, lat, h HAVING count(g.value) = count(*)),
a AS (SELECT *, row_number() OVER (ORDER BY proposal) - 1 AS sample_idx FROM v WHERE value > h)
SELECT 'g' AS grid_id, sample_idx, round(lon, 9) AS lon, round(lat, 9) AS lat, round(value, 9) AS value FROM a WHERE sample_idx < (SELECT n FROM k)""",
    "sample_grid": f"""WITH g AS (SELECT lat_idx, lon_idx, value FROM {_GRID}), p AS (SELECT i AS proposal, -73 + {_random("x")} * 5 AS lon, -31 + {_random("y")} * 12 AS lat, {_random("h")} * (SELECT max(value) FROM g) AS h FROM range(20000) r(i)),
f AS (SELECT *, {_INDEX} FROM p), v AS (SELECT proposal, lon, lat, h, {_BILINEAR} AS value FROM f JOIN g ON {_CORNERS} GROUP BY proposal, lon, lat, h HAVING count(g.value) = count(*)),
a AS (SELECT *, row_number() OVER (ORDER BY proposal) - 1 AS sample_idx FROM v WHERE value > h)
SELECT 'g' AS grid_id, sample_idx, round(lon, 9) AS lon, round(lat, 9) AS lat, round(value, 9) AS value FROM a WHERE sample_idx < 2000""",
}
