import math

import numpy as np
import pytest
from faultspark.operators import compare, faults, grid, kde, sampling, spatial
from faultspark.sources import tables
from pyspark.sql import functions as F

NODE = "grid_id string, lat_idx int, lon_idx int, lat double, lon double, value double"
SUB = "event_id long, segment_id int, subfault_id long, lon double, lat double, z double, slip double, strike double, dip double, len_strike_km double, width_dip_km double"


@pytest.fixture(scope="module")
def rupture(spark):
    rows = [(1, 0, k, -70.0, -20.0 + 0.09 * k, 10.0, 1.0 + k, 0.0, 20.0, 10.0, 8.0) for k in range(4)]
    return spark.createDataFrame(rows, SUB)


def patches(rupture):
    return faults.subfault_polygons(faults.subfault_corners(faults.project(rupture, ["event_id"])))


def test_epicentre(spark, rupture):
    at = spark.createDataFrame([(1, -69.99, -19.9)], "event_id long, long double, lat double")
    found = spatial.find_epicenter_subfault(at, patches(rupture))
    assert [r.subfault_id for r in found.collect()] == [1]
    far = spark.createDataFrame([(1, 10.0, 10.0)], "event_id long, long double, lat double")
    with pytest.raises(Exception, match="no subfault"):
        spatial.find_epicenter_subfault(far, patches(rupture)).collect()
    points = sampling.sample_epicenter(found.select(*rupture.columns), 500.0)
    assert points.count() == 40  # 500 / 1000 of 80 square kilometres
    assert spatial.find_epicenter_subfault(points.where("sample_idx = 7").select("event_id", F.col("lon").alias("long"), "lat"), patches(rupture)).first().subfault_id == 1


def test_closest_subfault_ties_take_the_first(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 2.0, 0.0), (1, 1, 0, math.nan, 1.0)], "event_id int, segment_id int, subfault_id int, x_km double, y_km double")
    pts = spark.createDataFrame([(1, 7, 1.0, 0.0), (1, 8, 1.9, 1.0)], "event_id int, p int, x_km double, y_km double")
    got = {r.p: (r.subfault_id, round(r.distance_km, 6)) for r in spatial.closest_subfault(pts, nodes, keys=["event_id"], identity=["p"]).collect()}
    assert got == {7: (0, 1.0), 8: (1, round(math.hypot(0.1, 1), 6))}


def test_distance_to_boundaries(spark):
    lines = spark.createDataFrame([(1, "a", "Subduction", 0, 0.0, 0.0), (1, "a", "Subduction", 1, 2.0, 0.0), (2, "b", "ridge", 0, 1.0, 1.0), (2, "b", "ridge", 1, 2.0, 1.0)], "line_id int, name string, type string, seq int, lon double, lat double")
    node = spark.createDataFrame([(5, 1.0, 1.0)], "n int, lon double, lat double")
    km = lambda **how: spatial.distance_to_boundaries(node, lines, identity=["n"], **how).first().distance_km
    degree = math.pi / 180 * spatial.EARTH_KM
    assert km() == pytest.approx(degree) and km(names=["b"]) == pytest.approx(0, abs=1e-9) and km(type_filter="duct", contains=True) == pytest.approx(degree)
    assert spatial.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)) is not None


def test_rasterize(spark):
    tri = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0, 3.0), (2, 4.0, 4.0, 4.0, 0.0, 0.0, 4.0, 5.0)], "tri_id int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, value double")
    got = {(r.x, r.y): r.value for r in spatial.rasterize_triangles(tri, 5, 5).collect()}
    assert len(got) == 25 and got[1.0, 1.0] == 3 and got[3.0, 3.0] == 5 and got[2.0, 2.0] == 3  # the shared edge goes to the smaller id


def test_density_in_two_dimensions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = {(r.x0, r.x1): r.pdf for r in kde.kde_pdf2d(df, "a", "b", [0.0, 1.0], [0.0, -1.0], rule=0.5, standardize=False).collect()}
    for p, pdf in got.items():
        assert pdf == pytest.approx(np.exp(-((x - p) ** 2).sum(1) / 0.5).mean() / (2 * np.pi * 0.25))


def test_superiority_counts_ties(spark):
    h = spark.createDataFrame([("k", 0, 0.2), ("k", 0, 0.5)], "k string, x_idx int, cdf double")
    n = spark.createDataFrame([("k", 0, 0.2), ("k", 0, 0.9)], "k string, x_idx int, cdf double")
    assert compare.observed_vs_null(h, n, ["k"]).first().p_gt == 0.5
    r = compare.observed_vs_null(h, n, ["k"], resamples=50).first()
    assert r.ci_low <= r.p_gt <= r.ci_high


def test_replacements_and_moves(spark, rupture):
    new = rupture.select("event_id", "segment_id", "subfault_id", F.lit(9.0).alias("slip"))
    assert {r.slip for r in faults.replace_slip(rupture, new).collect()} == {9.0}
    with pytest.raises(Exception, match="another shape"):
        faults.replace_slip(rupture, new.where("subfault_id > 0")).collect()
    how = [F.lit(v) for v in (33.0, 1.5, -2.0, 4.0, 5.0)]
    x, y = grid.rotate_translate(F.lit(3.0), F.lit(7.0), *how)
    moved = spark.range(1).select(x.alias("x"), y.alias("y"))
    back = moved.select(*(c.alias(n) for c, n in zip(grid.inverse_transform(F.col("x"), F.col("y"), *how), "ab"))).first()
    assert back.a == pytest.approx(3) and back.b == pytest.approx(7)
    same = faults.rotate_event(rupture, spark.createDataFrame([(1, -70.5, -20.0, 360.0)], "event_id long, pivot_lon double, pivot_lat double, angle_deg double"), ["event_id"])
    old = {r.subfault_id: r for r in rupture.collect()}
    assert all(abs(r.lon - old[r.subfault_id].lon) < 1e-9 and abs(r.lat - old[r.subfault_id].lat) < 1e-9 and r.strike == 0 for r in same.collect())


def test_surface_projection(spark):
    g = spark.createDataFrame([("g", j, i, float(j), float(i), 0.5) for j in range(3) for i in range(3)], NODE)
    assert sampling.surface_count(g, 100_000.0, 1.0, -2.0).first().n_points == 900
    assert sampling.sample_surface_projection(g, 100_000.0, 1.0, -2.0).count() == 900
    with pytest.raises(ValueError, match="no positive"):
        sampling.sample_grid(g.withColumn("value", F.lit(0.0)), 5)


def test_points_do_not_depend_on_partitions(rupture):
    got = [sorted(map(tuple, sampling.sample_rupture(rupture.repartition(n), 500.0).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == sum(int(80 * s * 0.5) for s in (1, 2, 3, 4))


def test_writers(spark, rupture, tmp_path):
    points = sampling.sample_rupture(rupture, 100.0)
    tables.write_samples(points, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == points.count() and (tmp_path / "s" / "event_id=1").is_dir()
    cdf = spark.createDataFrame([("a", 0, 0.0, 0.25), ("b", 0, 0.0, 0.75), ("a", 1, 1.0, 1.0)], "k string, x_idx int, x double, cdf double")
    tables.write_cdf(cdf, str(tmp_path / "c"), wide=True)
    rows = spark.read.parquet(str(tmp_path / "c")).orderBy("x_idx").collect()
    assert (rows[0].a, rows[0].b, rows[1].a, rows[1].b) == (0.25, 0.75, 1.0, None)
    nodes = spark.createDataFrame([(float(j), float(i), 0.5) for j in (3, 1, 2) for i in range(2)], "lat double, lon double, value double")
    nodes.write.csv(str(tmp_path / "g"), header=True)
    nodes.write.parquet(str(tmp_path / "p"))
    assert tables.read_coupling(spark, str(tmp_path / "p")).where("lat_idx = 0").first().lat == 1.0


def test_segment_polygons(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"polygon": [[0, 0], [2, 0], [2, 2], [0, 2]], "dip": 10, "strike": 5}, {"polygon": [[0, 0], [4, 0], [4, 4], [0, 4]], "dip": 20, "strike": 6}]')
    polygons = tables.read_segment_polygons(spark, str(tmp_path / "p.json"))
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0)], "p int, lon double, lat double")
    assert {r.p: r.dip for r in spatial.segment_angles(pts, polygons, identity=["p"]).collect()} == {1: 10, 2: 20}
    with pytest.raises(Exception, match="no segment polygon"):
        spatial.segment_angles(spark.createDataFrame([(3, 9.0, 9.0)], pts.schema), polygons, identity=["p"]).collect()


def test_superiority_in_ranges(spark):
    from faultspark.operators import compare, ecdf

    rng = np.random.default_rng(4)
    x, y = rng.normal(0.3, 1, 400).round(2), rng.normal(0, 1, 300).round(2)
    h, n = (spark.createDataFrame([("a", float(v)) for v in z], "k string, value double") for z in (x, y))
    got = compare.p_superiority_ci(h, n, ["k"], size=40).first()
    plain = [np.mean(rng.choice(y, 300)[None, :] <= rng.choice(x, 400)[:, None]) for _ in range(1000)]
    assert got.p_gt == pytest.approx(np.mean(y[None, :] <= x[:, None]))
    assert got.ci_low == pytest.approx(np.quantile(plain, 0.025), abs=0.012) and got.ci_high == pytest.approx(np.quantile(plain, 0.975), abs=0.012)
    counts = h.groupBy("k", "value").agg(F.count("*").alias("n"))
    assert ecdf.ranged(counts, "value", ["k"], 40).groupBy("_range").count().agg(F.max("count")).first()[0] < 80
    for r in ecdf.running(counts, "value", "n", ["k"], 40).collect():
        assert r._below == (x <= r.value).sum() and r._total == 400


def test_bootstrap_is_the_same_however_dealt(spark):
    from faultspark.operators import compare

    rng = np.random.default_rng(5)
    rows = [(k, float(v), s) for k in ("a", None) for s, m in ((0, 90), (1, 70)) for v in rng.normal(0, 1, m).round(1)] + [("h only", 1.0, 0), ("n only", 1.0, 1)]
    both = spark.createDataFrame(rows, "k string, value double, side int")
    got = []
    for parts, block in ((1, 100), (5, 7)):
        h, n = (both.repartition(parts).where(F.col("side") == s) for s in (0, 1))
        got.append({r.k: tuple(r)[1:] for r in compare.p_superiority_ci(h, n, ["k"], resamples=60, block=block, size=10).collect()})
    assert got[0] == got[1] and set(got[0]) == {"a", None, "h only", "n only"}
    assert got[0]["h only"] == (None, None, None) == got[0]["n only"]
    for k in ("a", None):
        p, low, high = got[0][k]
        assert low < p < high and got[0]["a"] != got[0][None]
    assert compare.p_superiority_ci(both.limit(0), both.limit(0), ["k"], resamples=10).count() == 0


def test_md5_numbers_by_arrays(spark):
    """drawn gives uniform's numbers: texts of any length, null keys, numbers past a batch's share of a row."""
    from faultspark.functions.rng import drawn, number, uniform

    rows = [("a", 1, 0, 3), ("x" * 70, 2, 7, 9), ("é", None, 95, 1203), (None, 3, 99_999, 100_001)]
    dealt = spark.createDataFrame(rows, "name string, k int, _from long, _to long")
    got = drawn(dealt, 5, "uv", ["name", "k"], rng="md5").select("sample_idx", "name", "k", "_u", "_v")
    want = number(dealt).select("sample_idx", "name", "k", *(uniform(5, s, "name", "k", "sample_idx", rng="md5").alias(f"_{s}") for s in "uv"))
    assert got.count() == 3 + 2 + 1108 + 2 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_buckets_by_arrays(spark):
    from pyspark.sql import functions as F

    from faultspark.operators.ecdf import bucket, bucket_arrays

    df = spark.createDataFrame([(v,) for v in [None, float("nan"), float("inf"), -1.0, 0.0, 0.005, 0.0051, 0.995, 1.0, 1.5, *(k / 200 for k in range(201))]], "v double")
    for x in ([k / 200 for k in range(201)], [0.0, 0.1, 0.7]):
        for inclusive in (True, False):
            assert df.where(bucket(F.col("v"), x, inclusive) != bucket_arrays(F.col("v"), x, inclusive)).isEmpty()


def test_tries_make_their_points_once(spark):
    from faultspark.plans import workloads as W

    sub = spark.createDataFrame([(1, 0, k, 2.0, -70.0 + k * 0.1, -20.0, 10.0, 0.0, 20.0, 10.0, 8.0) for k in range(4)], "event_id int, segment_id int, subfault_id int, slip double, lon double, lat double, z double, strike double, dip double, len_strike_km double, width_dip_km double")
    grid = spark.createDataFrame([("g", j, i, -21.0 + j, -71.0 + i, 0.5) for i in range(3) for j in range(3)], "grid_id string, lat_idx int, lon_idx int, lat double, lon double, value double")
    places = spark.createDataFrame([(1, "g", -70.0, -20.0, 9)], "event_id int, grid_id string, from_lon double, from_lat double, n_nodes long")
    for mode in ("planar", "geodesic"):
        tried = W._tried(places, sub, grid, W._candidates(grid), 0, 3, 0.0, 100.0, W.LEVELS, 0, mode, "md5")
        assert tried._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
        assert tried.select("try").distinct().count() == 3
