"""The registered queries of the rupture, grid and distribution operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import finite, wrap_longitude
from ..operators import compare, ecdf, faults, grid, kde, lookup, sampling, spatial
from ..sources import adapters as A
from . import file_queries as T
from . import geometry_queries as G
from . import rupture_sql as S
from . import workloads as W
from .bootstrap_sql import bootstrap

X = [5.0 * k for k in range(21)]
XE = [-0.5 + k / 20 for k in range(21)]


#: smaller than a paper's run (500 realizations at kappa 750, densities to 1e5), so that DuckDB can follow; the rupture box of the tables is wider than their grid's defined part
NULL = {"n_null": 8, "max_tries": 24, "min_finite": 0.75, "kappa": 20.0}
#: the study's share of defined points; most events need several rounds, some stay short or empty
ROUNDS = {"n_null": 6, "max_tries": 14, "min_finite": 0.95, "kappa": 10.0}
SOME = 500  # distinct values in a range of the bootstrap, so that the test tables have several ranges
KAPPAS, KAPPA_REF, TOL = [20.0, 60.0, 180.0], 540.0, 0.05


def _patches(s, d):
    return faults.subfault_polygons(faults.subfault_corners(faults.project(A.subfaults(s, d), ["event_id"])))


def _starts(s, d):
    """A place 0.01 degrees down dip of each event's greatest slip."""
    place = F.struct((F.col("lon") + 0.01 * F.cos(F.radians("strike"))).alias("long"), (F.col("lat") - 0.01 * F.sin(F.radians("strike"))).alias("lat"))
    first = F.min_by(place, F.struct(-F.col("slip"), "subfault_id")).alias("_p")
    return A.subfaults(s, d).groupBy("event_id").agg(first).select("event_id", "_p.*")


def _epicenter(s, d):
    found = spatial.find_epicenter_subfault(_starts(s, d), _patches(s, d)).select(*A.subfaults(s, d).columns)
    return _r(sampling.sample_epicenter(found, 500.0, rng="md5"), "lon", "lat", places=6)


def _points(s, d):
    return A.places(s, d).select("point_id", F.lit("g").alias("grid_id"), (-73.5 + F.col("x") * 0.6).alias("lon"), (-32 + F.col("y") * 1.4).alias("lat"))


def _hn(s, d):
    v = A.values(s, d)
    return v.where("weight < 2"), v.where("weight >= 2")


def _r(df, *cols, places=9):
    """Doubles to nine places, so that sums in another order agree; what goes through sines, to six."""
    return df.withColumns({c: F.round(c, places) for c in cols})


QUERIES = {
    "observed_cdf": lambda s, d: _r(W.observed_cdf(A.subfaults(s, d), A.grid(s, d), 200.0, rng="md5"), "cdf"),
    "observed_cdf_tiled": lambda s, d: _r(W.observed_cdf(A.subfaults(s, d), A.grid(s, d), 50.0, rng="md5", most_nodes=0, tile=4), "cdf"),
    "fault_summary": lambda s, d: faults.fault_summary(A.subfaults(s, d), ["event_id"], 50.0, 1.0).withColumn("slip_area", F.round("slip_area", 4)),
    "average_time": lambda s, d: A.subfaults(s, d).select("subfault_id", faults.average_time().alias("t")).where(finite(F.col("t"))),
    "spacing": lambda s, d: _r(faults.spacing(A.subfaults(s, d), ["event_id"], "lat", ["subfault_id"], "width_dip_km"), "spacing"),
    "extent": lambda s, d: grid.extent(A.subfaults(s, d), ["event_id"]),
    "boundaries": lambda s, d: _r(grid.boundaries(A.ensemble(s, d), lat_min=-40), "lon_min", "lon_max", "lat_min", "lat_max"),
    "defined_nodes": lambda s, d: _r(grid.defined_nodes(A.grid(s, d)), "value", "lon"),
    "downsample": lambda s, d: _r(grid.with_nan_to_zero(grid.downsample(A.grid(s, d), 3)), "value", "lon"),
    "normalize_to_pdf": lambda s, d: _r(grid.normalize_to_pdf(grid.with_nan_to_zero(A.grid(s, d))), "value", "lon"),
    "compare_grids": lambda s, d: grid.compare_grids(A.grid(s, d), A.ensemble(s, d)),
    "validate_grid": lambda s, d: grid.validate_grid(A.grid(s, d).select("grid_id", "lat", "lon", "value")).select("grid_id", "lat_idx", "lon_idx"),
    "lookup_grid": lambda s, d: _r(lookup.lookup_grid(_points(s, d), grid.with_nan_to_zero(A.grid(s, d))), "value", "lon", "lat"),
    "lookup_many": lambda s, d: _r(lookup.lookup_many(_points(s, d), A.ensemble(s, d)).where(finite(F.col("value"))), "value", "lon", "lat"),
    "ecdf_on_grid": lambda s, d: _r(ecdf.ecdf_on_grid(A.values(s, d), "value", X, ["k"], weight="weight"), "cdf"),
    "cdf_per_columns": lambda s, d: _r(ecdf.cdf_per_columns(A.wide(s, d), XE, array="embedding"), "cdf", "x"),
    "cdf_chunked": lambda s, d: _r(ecdf.cdf_chunked(A.values(s, d), "value", X, ["k"]), "cdf"),
    "ecdf_steps": lambda s, d: _r(ecdf.ecdf_steps(A.values(s, d), "value", ["k"]), "cdf"),
    "weighted_moments": lambda s, d: _r(kde.weighted_moments(A.values(s, d), ["value"], ["k"], "weight"), "mean_value", "var_value", "scale_value"),
    "effective_n": lambda s, d: _r(kde.effective_n(A.values(s, d), ["k"], "weight"), "n_eff"),
    "p_superiority": lambda s, d: _r(compare.p_superiority(*_hn(s, d), ["k"]), "p_gt"),
    "p_superiority_ci": lambda s, d: _r(compare.p_superiority_ci(*_hn(s, d), ["k"], size=SOME), "p_gt", "ci_low", "ci_high"),
    "kde_pdf": lambda s, d: _r(kde.kde_pdf(A.values(s, d), ["value"], [(v,) for v in X], weight="weight"), "pdf"),
    "pdf_cdf": lambda s, d: _r(kde.pdf_cdf(A.values(s, d), "value", X), "pdf", "cdf"),
    "sample_uniform": lambda s, d: _r(sampling.sample_uniform(A.subfaults(s, d), 500, rng="md5"), "lon", "lat", places=6),
    "sample_per_subfault": lambda s, d: _r(sampling.sample_rupture(A.subfaults(s, d), n_per_subfault=3, rng="md5"), "lon", "lat", places=6),
    "wrap_longitude": lambda s, d: A.ocean_nodes(s, d).select("point_id", F.round(wrap_longitude(F.col("lon")), 9).alias("lon")),
    "apply_map": lambda s, d: _r(grid.apply_map(_points(s, d), lambda u, v: (v, 1 - u), grid.grid_meta(A.grid(s, d))).select("point_id", "lon", "lat"), "lon", "lat"),
    "count_in_mask": lambda s, d: ecdf.count_in_mask(A.values(s, d), finite(F.col("value")) & (F.col("value") > 40) & (F.col("weight") >= 2)),
    "subfault_polygons": lambda s, d: _r(_patches(s, d).select("subfault_id", F.posexplode("polygon").alias("corner", "_p")).select("subfault_id", "corner", "_p.lon", "_p.lat"), "lon", "lat", places=6),
    "find_epicenter_subfault": lambda s, d: spatial.find_epicenter_subfault(_starts(s, d), _patches(s, d)).select("event_id", "segment_id", "subfault_id"),
    "sample_epicenter": _epicenter,
    "sample_grid": lambda s, d: _r(sampling.sample_grid(A.grid(s, d), 2000, rng="md5"), "lon", "lat", "value"),
    "sample_polygons": lambda s, d: _r(sampling.sample_polygons(A.plots(s, d), "n", rng="md5"), "x", "y"),
    "segment_angles": lambda s, d: spatial.segment_angles(A.places(s, d), A.boxes(s, d), identity=["point_id"], x="x", y="y", strict=False).select("point_id", "strike", "dip"),
    "grid_scatter": lambda s, d: _r(_r(spatial.grid_scatter(A.places(s, d).withColumn("key", F.floor(F.col("point_id") / 12)), ["key"], 20, 20), "x", "y"), "value", places=3),
    "grid_scatter_wide": lambda s, d: spatial.grid_scatter(A.places(s, d).withColumn("key", F.floor(F.col("point_id") / 200)), ["key"], 20, 20),
    "grid_scatter_nearest": lambda s, d: _r(spatial.grid_scatter(A.places(s, d).withColumn("key", F.floor(F.col("point_id") / 200)), ["key"], 20, 20, "nearest"), "x", "y"),
    "regrid": lambda s, d: _r(spatial.regrid(A.ensemble(s, d).where("grid_id = 'A'"), grid.downsample(A.grid(s, d), 2)).drop("lat", "lon"), "value"),
    "kappa_convergence": lambda s, d: W.kappa_convergence(A.subfaults(s, d), A.grid(s, d), KAPPAS, KAPPA_REF, tol=TOL, rng="md5")[1],
    "null_model_geodesic": lambda s, d: _r(W.null_model(A.events(s, d), A.subfaults(s, d), A.grid(s, d), rng="md5", **NULL), "cdf"),
    "null_model_planar": lambda s, d: _r(W.null_model(A.events(s, d), A.subfaults(s, d), A.grid(s, d), mode="planar", rng="md5", **NULL), "cdf"),
    "null_model_planar_rounds": lambda s, d: _r(W.null_model(A.events(s, d), A.subfaults(s, d), A.grid(s, d), mode="planar", rng="md5", round_size=4, **ROUNDS), "cdf"),
    "null_model_geodesic_rounds": lambda s, d: _r(W.null_model(A.events(s, d), A.subfaults(s, d), A.grid(s, d), rng="md5", round_size=4, **ROUNDS), "cdf"),
} | G.QUERIES | T.QUERIES

_SUB = """(SELECT o_custkey % 61 AS event_id, o_orderkey AS subfault_id, o_totalprice / 125000.0 AS slip, -72 + (o_orderkey % 97) * 3e-2 AS lon, -30 + (o_orderkey % 211) * 5e-2 AS lat,
 CAST(o_orderkey % 13 AS DOUBLE) AS trup, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 5 AS DOUBLE) END AS rise FROM orders)"""
_GRID = """(SELECT 'g' AS grid_id, j AS lat_idx, i AS lon_idx, -31 + j * 2e0 AS lat, -73 + i * 5e0 / 49 AS lon,
 CASE WHEN (i + 1) * (j + 1) % 17 = 0 THEN NULL ELSE greatest(0e0, least(1e0, (round(d, 9) * 10 - 0.4e0) / 0.2e0)) END AS value
 FROM (SELECT CAST(l_quantity AS INTEGER) - 1 AS i, CAST(l_linenumber - 1 AS INTEGER) AS j, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2))"""
_VAL = "(SELECT event_type AS k, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value, CAST(user_id % 5 AS DOUBLE) AS weight FROM events)"
_X = "(SELECT CAST(i AS INTEGER) AS x_idx, i * 5e0 AS x FROM range(21) t(i))"

ORACLE_SQL = {
    "fault_summary": f"SELECT event_id, sum(CASE WHEN slip > 1 THEN 87.5e0 ELSE 0e0 END) AS area, round(sum(87.5e0 * slip), 4) AS slip_area, count(*) AS n_subfaults, CAST(sum(CAST(trunc(87.5e0 * slip * (50e0 / 1000)) AS BIGINT)) AS BIGINT) AS n_points, max(slip) AS max_slip FROM {_SUB} GROUP BY 1",
    "average_time": f"SELECT subfault_id, trup + 0.5e0 * rise AS t FROM {_SUB} WHERE rise IS NOT NULL",
    "spacing": f"SELECT event_id, round(coalesce(avg(d), 8.75e0), 9) AS spacing FROM (SELECT event_id, lat - lag(lat) OVER (PARTITION BY event_id ORDER BY subfault_id) AS d FROM {_SUB}) GROUP BY 1",
    "extent": f"SELECT event_id, min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max FROM {_SUB} GROUP BY 1",
    "boundaries": "SELECT round(-73 - 0.02e0 * 5, 9) AS lon_min, round(-68 + 0.02e0 * 5, 9) AS lon_max, -40e0 AS lat_min, round(-19 + 0.02e0 * 12, 9) AS lat_max",
    "defined_nodes": f"SELECT grid_id, lat_idx, lon_idx, lat, round(lon, 9) AS lon, round(value, 9) AS value FROM {_GRID} WHERE value IS NOT NULL",
    "downsample": f"SELECT grid_id, CAST(lat_idx // 3 AS INTEGER) AS lat_idx, CAST(lon_idx // 3 AS INTEGER) AS lon_idx, lat, round(lon, 9) AS lon, round(coalesce(value, 0), 9) AS value FROM {_GRID} WHERE lat_idx % 3 = 0 AND lon_idx % 3 = 0",
    "normalize_to_pdf": f"SELECT grid_id, lat_idx, lon_idx, lat, round(lon, 9) AS lon, round(coalesce(value, 0) / sum(value) OVER (), 9) AS value FROM {_GRID}",
    "validate_grid": f"SELECT grid_id, lat_idx, lon_idx FROM {_GRID}",
    "lookup_grid": f"""WITH g AS (SELECT lat_idx, lon_idx, coalesce(value, 0) AS value FROM {_GRID}),
p AS (SELECT c_custkey AS point_id, -73.5e0 + ((c_custkey * 7919) % 1009 / 101e0) * 0.6e0 AS lon, -32 + ((c_custkey * 104729) % 1013 / 101.3e0) * 1.4e0 AS lat FROM customer),
f AS (SELECT *, greatest(0e0, least(49e0, (lon + 73) / 5 * 49)) AS fx, greatest(0e0, least(6e0, (lat + 31) / 12 * 6)) AS fy FROM p),
c AS (SELECT *, CAST(floor(fx) AS INTEGER) AS i, CAST(floor(fy) AS INTEGER) AS j FROM f)
SELECT point_id, 'g' AS grid_id, round(lon, 9) AS lon, round(lat, 9) AS lat, round(sum(g.value * (1 - abs(fx - g.lon_idx)) * (1 - abs(fy - g.lat_idx))), 9) AS value
FROM c JOIN g ON g.lon_idx BETWEEN i AND i + 1 AND g.lat_idx BETWEEN j AND j + 1 GROUP BY point_id, lon, lat""",
    "ecdf_on_grid": f"""SELECT k, x_idx, x, CASE x_idx WHEN 0 THEN 0e0 WHEN 20 THEN 1e0 ELSE round(sum(CASE WHEN value <= x THEN weight ELSE 0e0 END) / sum(weight), 9) END AS cdf
FROM {_VAL} v, {_X} x WHERE value IS NOT NULL GROUP BY k, x_idx, x""",
    "cdf_per_columns": """SELECT k, x_idx, round(x, 9) AS x, round(sum(CASE WHEN v <= x THEN 1e0 ELSE 0e0 END) / count(*), 9) AS cdf
FROM (SELECT CAST(unnest(range(64)) AS INTEGER) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) e, (SELECT CAST(i AS INTEGER) AS x_idx, -0.5e0 + i / 20e0 AS x FROM range(21) t(i)) x GROUP BY k, x_idx, x""",
    "cdf_chunked": f"SELECT k, x_idx, x, round(sum(CASE WHEN value <= x THEN 1e0 ELSE 0e0 END) / count(*), 9) AS cdf FROM {_VAL} v, {_X} x GROUP BY k, x_idx, x",
    "ecdf_steps": f"SELECT k, value, count(*) AS n, round(sum(count(*)) OVER (PARTITION BY k ORDER BY value) / CAST(sum(count(*)) OVER (PARTITION BY k) AS DOUBLE), 9) AS cdf FROM {_VAL} WHERE value IS NOT NULL GROUP BY k, value",
    "weighted_moments": f"""WITH v AS (SELECT * FROM {_VAL} WHERE value IS NOT NULL), m AS (SELECT k, sum(weight * value) / sum(weight) AS m FROM v GROUP BY k)
SELECT k, round(any_value(m), 9) AS mean_value, round(sum(weight * (value - m) * (value - m)) / sum(weight), 9) AS var_value, round(sqrt(sum(weight * (value - m) * (value - m)) / sum(weight)), 9) AS scale_value FROM v JOIN m USING (k) GROUP BY k""",
    "effective_n": f"SELECT k, round(sum(weight) * sum(weight) / sum(weight * weight), 9) AS n_eff FROM {_VAL} GROUP BY k",
    "p_superiority": f"""WITH v AS (SELECT * FROM {_VAL} WHERE value IS NOT NULL)
SELECT h.k AS k, round(sum(CASE WHEN n.value <= h.value THEN 1e0 ELSE 0e0 END) / count(*), 9) AS p_gt, CAST((SELECT count(*) FROM v WHERE v.k = h.k AND weight < 2) AS BIGINT) AS n_h, CAST((SELECT count(*) FROM v WHERE v.k = h.k AND weight >= 2) AS BIGINT) AS n_n
FROM v h JOIN v n ON h.k = n.k AND h.weight < 2 AND n.weight >= 2 GROUP BY h.k""",
    "p_superiority_ci": bootstrap(f"SELECT k, weight >= 2 AS side, value FROM {_VAL} WHERE value IS NOT NULL", ["k"], 1000, SOME),
    "observed_cdf": S.observed_cdf(200.0),
    "observed_cdf_tiled": S.observed_cdf(50.0),
    "kappa_convergence": S.kappa_convergence(KAPPAS, KAPPA_REF, TOL),
    "null_model_planar": S.null_planar(**NULL),
    "null_model_geodesic": S.null_geodesic(**NULL),
    "null_model_planar_rounds": S.null_planar(**ROUNDS),
    "null_model_geodesic_rounds": S.null_geodesic(**ROUNDS),
    "sample_uniform": S.sample_uniform(500),
    "sample_per_subfault": S.sample_per_subfault(3),
    "wrap_longitude": "SELECT point_id, round(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END, 9) AS lon FROM (SELECT c_custkey AS point_id, 170 + (c_custkey * 7919) % 1009 / 50e0 AS lon FROM customer)",
    "apply_map": """SELECT point_id, round((lat + 31) / 12 * 5 - 73, 9) AS lon, round((1 - (lon + 73) / 5) * 12 - 31, 9) AS lat
FROM (SELECT c_custkey AS point_id, -73.5e0 + ((c_custkey * 7919) % 1009 / 101e0) * 0.6e0 AS lon, -32 + ((c_custkey * 104729) % 1013 / 101.3e0) * 1.4e0 AS lat FROM customer)""",
    "count_in_mask": f"SELECT count(*) AS n_selected FROM {_VAL} WHERE value > 40 AND weight >= 2",
    "subfault_polygons": S.subfault_polygons(),
    "find_epicenter_subfault": S.find_epicenter_subfault(),
    "sample_epicenter": S.sample_epicenter(500.0),
    "sample_polygons": S.sample_polygons(),
    "grid_scatter": S.grid_scatter(),
    "grid_scatter_nearest": S.grid_scatter_nearest(),
    "regrid": S.regrid(),
} | G.ORACLE_SQL | T.ORACLE_SQL
