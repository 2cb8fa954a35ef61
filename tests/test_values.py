"""Known values, odd inputs and plain-Python checks of the rupture, grid and distribution operators."""

import math
import re
from fractions import Fraction

import numpy as np
import pytest
from faultspark.functions.geodesy import geodesic_direct, geodesic_inverse, to_utm
from faultspark.operators import ecdf, faults, grid, kde, lookup, sampling, spatial
from faultspark.plans import workloads
from faultspark.sources import tables
from faultspark.sources.fsp import bad_files, read_fsp
from pyspark.sql import functions as F

NAN = float("nan")
NODE = "grid_id string, lat_idx int, lon_idx int, lat double, lon double, value double"
HEAD = """% Event : Far Away 2010-2-27 [Someone (2014) ]
% EventTAG: s2010FAR
% Loc  : LAT = -35.8 LON = -72.7 DEP = 35.0
% Size : LEN = 500.0 km WID = 200.0 km Mw = 8.80 Mo = 2e22 Nm
% Mech : STRK = 15.0 DIP = 18.0 RAKE = 110.0 Htop = 5 km
"""
TABLE = "% LAT LON X==EW Y==NS Z SLIP {names}\n% ----\n{rows}\n% end\n"


def segment(k, size, names="RAKE TRUP", values="90 3", n=2):
    rows = "\n".join(f" -35.{j} -72.{j} 0 0 {5 + j}.0 {k}.5 {values}" for j in range(n))
    return f"% SEGMENT # {k}: STRIKE = {k}0.0 deg DIP = {k}5.0 deg\n{size}\n" + TABLE.format(names=names, rows=rows)


def test_utm_known_values(spark):
    rows = [(-69.0, 45.0, 19, 500.0, 4982.950400), (-66.0, 0.0, 19, 833.978557, 0.0), (-72.0, 0.0, 19, 166.021443, 0.0), (-69.0, -45.0, 19, 500.0, -4982.950400)]
    df = to_utm(spark.createDataFrame(rows, "lon double, lat double, utm_zone int, x double, y double"))
    assert all(r.x_km == pytest.approx(r.x, abs=1e-6) and r.y_km == pytest.approx(r.y, abs=1e-6) for r in df.collect())


def test_geodesics_known_values():
    d, a = geodesic_inverse(np.array([0.0, 0.0]), np.array([0.0, 0.0]), np.array([1.0, 0.0]), np.array([0.0, 1.0]))
    assert d == pytest.approx([111319.4908, 110574.3886], abs=1e-3) and a == pytest.approx([90.0, 0.0])
    x, y = geodesic_direct(np.array([10.0]), np.array([0.0]), np.array([270.0]), np.array([111319.490793]))
    assert (x[0], y[0]) == pytest.approx((9.0, 0.0), abs=1e-8)


@pytest.mark.parametrize("ref,top,middle", [("top_center", (0, 0, 10.0), None), ("center", (0, 0, 10.0 + 4 * math.sin(math.radians(30))), None), ("top_left", (0, 5, 10.0), None), ("top_right", (0, -5, 10.0), None)])
def test_corners_known_values(spark, ref, top, middle):
    """Strike 0 runs along +y, dip 30 falls to +x: 8 km down dip are 6.93 across and 4 down."""
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, 30.0, 10.0, 8.0)], "x_km double, y_km double, z double, strike double, dip double, len_strike_km double, width_dip_km double")
    r = faults.subfault_corners(df, ref).first()
    across = 8 * math.cos(math.radians(30))
    x0 = -across / 2 if ref == "center" else 0.0
    want = {"tl": (x0, top[1] - 5, top[2]), "tr": (x0, top[1] + 5, top[2]), "br": (x0 + across, top[1] + 5, top[2] - 4), "bl": (x0 + across, top[1] - 5, top[2] - 4)}
    for name, (x, y, z) in want.items():
        assert (r[name].x, r[name].y, r[name].z) == pytest.approx((x, y, z)), name


def test_polygons_close_and_match_their_corners(spark):
    rows = [(1, 0, k, -70.0 - k, -20.0 + 0.09 * k, 10.0, 1.0, 12.0, 20.0, 10.0, 8.0) for k in range(50)]
    df = spark.createDataFrame(rows, "event_id long, segment_id int, subfault_id long, lon double, lat double, z double, slip double, strike double, dip double, len_strike_km double, width_dip_km double")
    patches = faults.subfault_polygons(faults.subfault_corners(faults.project(df, ["event_id"])), closed=True)
    ring = patches.select("subfault_id", "utm_zone", "tl", "tr", "br", "bl", F.posexplode("polygon").alias("k", "p")).select("*", "p.lon", "p.lat")
    for r in to_utm(ring).collect():
        corner = r[("tl", "tr", "br", "bl", "tl")[r.k]]
        assert (r.x_km, r.y_km) == pytest.approx((corner.x, corner.y), abs=1e-6)


def test_multi_segment_files(spark, tmp_path):
    three = HEAD + "% Invs : Ntw = 1 Nsg = 3\n" + segment(1, "% Dx = 12.0 km Dz = 6.0 km") + segment(2, "% LEN = 40.0 km WID = 30.0 km", "TRUP RISE", "3 4") + segment(3, "% Dx = 5.0 km Dz = 4.0 km", n=5)
    (tmp_path / "three.fsp").write_text(three)
    events, segments, subfaults = read_fsp(spark, str(tmp_path))
    assert (events.first()["nsg"], str(events.first()["date_parsed"])) == (3, "2010-02-27")
    got = [r[:] for r in segments.orderBy("segment_id").select("segment_id", "strike", "dip", "len_strike_km", "width_dip_km").collect()]
    assert got == [(0, 10.0, 15.0, 12.0, 6.0), (1, 20.0, 25.0, 40.0, 30.0), (2, 30.0, 35.0, 5.0, 4.0)]
    rows = {(r.segment_id, r.subfault_id): r for r in subfaults.collect()}
    assert sorted(rows) == [(0, 0), (0, 1), (1, 0), (1, 1), *((2, k) for k in range(5))]
    assert (rows[1, 0].rake, rows[1, 0].trup, rows[1, 0].rise, rows[0, 1].rake, rows[0, 1].rise) == (0.0, 3.0, 4.0, 90.0, None)


def test_bad_files(spark, tmp_path):
    good = HEAD + "% Invs : Dx = 12.0 km Dz = 6.0 km\n" + TABLE.format(names="RAKE", rows=" -35.0 -72.0 0 0 5.0 1.0 90")
    (tmp_path / "good.fsp").write_text(good)
    (tmp_path / "date.fsp").write_text(good.replace("2010-2-27", ""))
    (tmp_path / "table.fsp").write_text(good.replace("LAT LON", "lost"))
    (tmp_path / "size.fsp").write_text(good.replace("Dx", "Dq"))
    assert {(r.file.rsplit("/", 1)[1], r.lacks) for r in bad_files(spark, str(tmp_path)).collect()} == {("date.fsp", "date"), ("table.fsp", "table"), ("size.fsp", "size")}
    for name, said in (("table", "no data table"), ("size", "no size")):
        with pytest.raises(Exception, match=said):
            read_fsp(spark, str(tmp_path / f"{name}.fsp"))[2].collect()
    (tmp_path / "day").mkdir()
    (tmp_path / "day" / "first.fsp").write_text(good.replace("2010-2-27", "27/2/2010"))
    assert str(read_fsp(spark, str(tmp_path / "day"))[0].first()["date_parsed"]) == "2010-02-27"


def test_read_coupling_by_header(spark, tmp_path):
    (tmp_path / "g.csv").write_text("lat,lon,value\n" + "\n".join(f"{j},{i},{'' if i == j else 'n/a' if i > j else 0.5}" for j in (3, 1, 2) for i in (0, 1, 2)))
    got = {(r.lat, r.lon): r for r in tables.read_coupling(spark, str(tmp_path / "g.csv"), "csv").collect()}
    assert len(got) == 9 and got[1.0, 0.0].lat_idx == 0 and got[3.0, 2.0].lon_idx == 2 and got[3.0, 0.0].value == 0.5 and {r.grid_id for r in got.values()} == {"grid"}
    assert math.isnan(got[1.0, 1.0].value) and math.isnan(got[1.0, 2.0].value)
    (tmp_path / "h.csv").write_text("value,grid_id,lon,lat\n1,a,0,0\n2,b,5,7\n")
    assert {(r.grid_id, r.lon, r.lat, r.value) for r in tables.read_coupling(spark, str(tmp_path / "h.csv"), "csv").collect()} == {("a", 0.0, 0.0, 1.0), ("b", 5.0, 7.0, 2.0)}
    with pytest.raises(ValueError, match="fmt"):
        tables.read_coupling(spark, str(tmp_path), "xlsx")


def nodes(spark, grid_id, value=lambda i, j: 0.5, n=4, lon=0.0, lat=0.0):
    return spark.createDataFrame([(grid_id, j, i, lat + j, lon + i, float(value(i, j))) for j in range(n) for i in range(n)], NODE)


def test_regrid_errors_and_scale(spark):
    a = nodes(spark, "a")
    with pytest.raises(ValueError, match="do not overlap"):
        spatial.regrid(a, nodes(spark, "far", lon=90.0))
    with pytest.raises(ValueError, match="no finite node"):
        spatial.regrid(nodes(spark, "t", lambda i, j: NAN), a)
    # longitudes are scaled by the cosine of their own latitude: (4, 60) is at 2.0, so of the defined nodes (1, 61) and (4, 62), at 0.48 and 1.88, the latter is nearer
    source = nodes(spark, "s", lambda i, j: 1.0 if (i, j) == (1, 1) else 2.0 if (i, j) == (4, 2) else NAN, 5, lat=60.0)
    target = nodes(spark, "t", lambda i, j: 0.0 if (i, j) == (4, 0) else NAN, 5, lat=60.0)
    got = [r.value for r in spatial.regrid(target, source).collect()]
    t, s = 4 * math.cos(math.radians(60)), {1.0: (math.cos(math.radians(61)), 61), 2.0: (4 * math.cos(math.radians(62)), 62)}
    assert got == [min(s, key=lambda v: (t - s[v][0]) ** 2 + (60 - s[v][1]) ** 2)]


def test_nearest_over_many_tiles(spark):
    rng = np.random.default_rng(3)
    p, q = rng.uniform(-2000, 2000, (60, 2)), rng.uniform(-2000, 2000, (40, 2))
    pts = spark.createDataFrame([(k % 2, k, *map(float, v)) for k, v in enumerate(p)] + [(0, 99, NAN, 1.0)], "event_id int, p int, x_km double, y_km double")
    sub = spark.createDataFrame([(k % 2, 0, k, *map(float, v)) for k, v in enumerate(q)], "event_id int, segment_id int, subfault_id int, x_km double, y_km double")
    got = {r.p: (r.subfault_id, r.distance_km) for r in spatial.closest_subfault(pts, sub, keys=["event_id"], identity=["p"]).collect()}
    want = {k: min((math.dist(v, w), m) for m, w in enumerate(q) if m % 2 == k % 2)[::-1] for k, v in enumerate(p)}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def sphere(lon, lat):
    lon, lat = math.radians(lon), math.radians(lat)
    return np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])


def arc_km(at, a, b):
    """By the arc's places, a thousand to begin with and then closer about the nearest."""
    p, u, v = sphere(*at), sphere(*a), sphere(*b)
    angle, low, high = math.acos(max(-1, min(1, u @ v))), 0.0, 1.0
    for _ in range(8):
        t = np.linspace(low, high, 1001)[:, None]
        q = (np.sin((1 - t) * angle) * u + np.sin(t * angle) * v) / math.sin(angle)
        d = np.sqrt(((q - p) ** 2).sum(1))
        k, w = int(d.argmin()), (high - low) / 500
        low, high = max(0.0, t[k, 0] - w), min(1.0, t[k, 0] + w)
    return 2 * spatial.EARTH_KM * math.asin(d.min() / 2)


def test_boundaries_on_the_sphere(spark):
    """Across the date line, over a pole, far away, beside long arcs; a node without place, a line of one vertex."""
    shape = [(0, 0), (30, 5), (31, 40)], [(179.8, -25), (-179.8, -15), (178, 10)], [(20, 88), (-150, 87)], [(-60, -60), (60, -60)]
    lines = spark.createDataFrame([(k, str(k), "Subduction", j, float(x), float(y)) for k, line in enumerate(shape) for j, (x, y) in enumerate(line)] + [(9, "9", "subduction", 0, 1.0, 1.0), (8, "8", "ridge", 0, 1.0, 1.0), (8, "8", "ridge", 1, 2.0, 1.0)], "line_id int, name string, type string, seq int, lon double, lat double")
    at = [(0, 10.0, 10.0), (1, -60.0, -35.0), (2, 31.0, 50.0), (3, 15.0, 2.5), (4, 179.9, -20.0), (5, -179.9, -20.0), (6, 180.1, -20.0), (7, 100.0, 89.9), (8, 0.0, -75.0), (9, -72.0, -90.0), (10, 540.0, 2.0)]
    df = spark.createDataFrame([*at, (11, NAN, 1.0)], "n int, lon double, lat double")
    got = {r.n: r.distance_km for r in spatial.distance_to_boundaries(df, lines, identity=["n"]).collect()}
    assert set(got) == {n for n, _, _ in at}
    for n, *node in at:
        want = min(arc_km(node, a, b) for line in shape for a, b in zip(line, line[1:]))
        assert got[n] == pytest.approx(want, abs=1e-5), n
    assert got[5] == pytest.approx(got[6], abs=1e-9) and got[4] < 25
    assert spatial.distance_to_boundaries(df, lines, identity=["n"], names=["none"]).count() == 0


def test_nearest_over_empty_space(spark):
    """Sources far away, in one cluster, on tile edges; equal distances go by rank; keys without a source have no row."""
    rng = np.random.default_rng(5)
    have = [*rng.normal((1e6, -3e5), 2.0, (200, 2)), *(np.array([[0, 0], [8, 0], [0, 8], [8, 8]]) * 10.0), *rng.uniform(-3e5, 3e5, (20, 2))]
    asked = [*rng.normal((0, 0), 30.0, (40, 2)), *rng.uniform(-2e6, 2e6, (30, 2)), np.array([40.0, 40.0]), np.array([80.0, 0.0])]
    sub = spark.createDataFrame([(1, 0, k, *map(float, v)) for k, v in enumerate(have)], "event_id int, segment_id int, subfault_id int, x_km double, y_km double")
    pts = spark.createDataFrame([(1, k, *map(float, v)) for k, v in enumerate(asked)] + [(2, 99, 0.0, 0.0)], "event_id int, p int, x_km double, y_km double")
    got = {r.p: (r.subfault_id, r.distance_km) for r in spatial.closest_subfault(pts, sub, keys=["event_id"], identity=["p"], tile=10.0).collect()}
    want = {k: min((math.dist(v, w), m) for m, w in enumerate(have)) for k, v in enumerate(asked)}
    assert set(got) == set(want) and all(got[k] == (want[k][1], pytest.approx(want[k][0])) for k in want)
    with pytest.raises(ValueError, match="extent"):
        spatial.nearest(pts, sub, keys=[], identity=["p"], axes=[("x_km", "x_km")], tile=1.0, distance=F.lit(1.0), rank=[], extent=1.0)


def test_nearest_of_crowded_sources(spark, monkeypatch):
    """Thousands of sources in one tile, many at one place: tiles are made smaller; the same when everything is shuffled."""
    from faultspark.operators import nearest as N

    rng = np.random.default_rng(8)
    have = [*(np.array([(k % 37, k // 37 % 41) for k in range(3000)]) * 0.5), *rng.normal(60, 0.05, (300, 2))]
    asked = [*rng.uniform(-5, 25, (40, 2)), *rng.normal(60, 0.05, (20, 2)), *rng.uniform(-90, 90, (10, 2))]
    sub = spark.createDataFrame([(k % 2, k % 3, k, *map(float, v)) for k, v in enumerate(have)], "event_id int, segment_id int, subfault_id int, x_km double, y_km double")
    pts = spark.createDataFrame([(k % 2, k, *map(float, v)) for k, v in enumerate(asked)], "event_id int, p int, x_km double, y_km double")
    places = sub.select("event_id", "x_km", "y_km").distinct()
    tile = N.fitting_tile(places, ["event_id"], ["x_km", "y_km"], 50.0)
    shared = [r["count"] for r in places.groupBy("event_id", F.floor(F.col("x_km") / tile), F.floor(F.col("y_km") / tile)).count().collect()]
    assert sum(n * n for n in shared) / sum(shared) <= N.CROWD
    want = {k: min((math.dist(v, w), m % 3, m) for m, w in enumerate(have) if m % 2 == k % 2) for k, v in enumerate(asked)}
    for few in (N.FEW, 0):
        monkeypatch.setattr(N, "FEW", few)
        got = {r.p: (r.distance_km, r.segment_id, r.subfault_id) for r in spatial.closest_subfault(pts, sub, keys=["event_id"], identity=["p"]).collect()}
        assert set(got) == set(want) and all(got[k][1:] == want[k][1:] and got[k][0] == pytest.approx(want[k][0], abs=1e-12) for k in want)


def test_boundaries_with_nothing_broadcast(spark, monkeypatch):
    from faultspark.operators import nearest as N

    lines = spark.createDataFrame([(k, str(k), "Subduction", j, x, y) for k, line in enumerate([[(179.8, -25.0), (-179.8, -15.0)], [(20.0, 88.0), (-150.0, 87.0)]]) for j, (x, y) in enumerate(line)], "line_id int, name string, type string, seq int, lon double, lat double")
    df = spark.createDataFrame([(0, 179.9, -20.0), (1, -60.0, -35.0), (2, 100.0, 89.9)], "n int, lon double, lat double")
    far = [{r.n: r.distance_km for r in spatial.distance_to_boundaries(df, lines, identity=["n"], tile=20.0).collect()} for few in (N.FEW, 0) if not monkeypatch.setattr(N, "FEW", few)]
    assert far[0] == pytest.approx(far[1], abs=1e-9) and len(far[0]) == 3


def test_nodes_of_few_boxes_are_not_broadcast(spark, monkeypatch):
    """Spark takes the nodes of a grid for as small as the boxes they are made from."""
    from faultspark.operators import nearest as N

    monkeypatch.setattr(N, "FEW", 0)
    p = np.random.default_rng(2).random((40, 2))
    rows = [(k % 2, float(x), float(y), float(k)) for k, (x, y) in enumerate(p)]
    got = spatial.grid_scatter(spark.createDataFrame(rows, "key int, x double, y double, v double"), ["key"], 30, 30, "nearest")
    found = got.collect()
    assert len(found) == 1800 and "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert all(r.value == min((math.dist((r.x, r.y), (x, y)), v) for k, x, y, v in rows if k == r.key)[1] for r in found)


def hull_area(p):
    """Exact."""
    p = sorted((Fraction(float(x)), Fraction(float(y))) for x, y in p)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    ring = []
    for way in (p, p[::-1]):
        half = []
        for q in way:
            while len(half) > 1 and cross(half[-2], half[-1], q) <= 0:
                half.pop()
            half.append(q)
        ring += half[:-1]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


@pytest.mark.parametrize("shape", ["square", "strip 10", "strip 100", "strip 1e6", "lattice", "sheared", "circle", "duplicates on a line"])
def test_delaunay_covers_the_hull(shape):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        p = rng.random((90, 2))
        if shape.startswith("strip"):
            p = p / [1, float(shape.split()[1])]
            turn = math.radians(37 * seed)
            p = p @ [[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]]
        if shape in ("lattice", "sheared"):
            p = np.array([(i, j) for i in range(9) for j in range(8)], float) @ ([[1, 0], [0, 1]] if shape == "lattice" else [[0.1, 0.3], [0.7, 1.1]])
            p = p[rng.permutation(len(p))]
        if shape == "circle":
            p = np.array([(math.cos(k * math.pi / 20), math.sin(k * math.pi / 20)) for k in range(40)])[rng.permutation(40)]
        if shape.startswith("dup"):
            p = np.array([(k, 0.0) for k in range(30)] + [(7.5, 1.0)])[rng.permutation(31)]
        t = spatial.delaunay(p)
        a, b, c = (p[t[:, k]] for k in range(3))
        areas = [hull_area(p[k]) for k in t]
        assert (spatial._turn(a, b, c) > 0).all() and sum(areas) == hull_area(p)  # to the last bit: no gap, no overlap
        assert all((spatial._in_circle(a, b, c, q) <= 0).all() for q in p)
    assert len(spatial.delaunay(np.array([(k, 2.0 * k) for k in range(5)]))) == 0 and len(spatial.delaunay(p[:2])) == 0


def test_delaunay_of_few_points_is_the_same(spark, monkeypatch):
    """Number by number as by arrays, ties included; nodes of a grid meet no join."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(3, 30))
        p = rng.random((n, 2)) if seed % 2 else np.unique(rng.integers(0, 6, (n, 2)).astype(float), axis=0)
        rng.shuffle(p)
        both = [spatial.delaunay(p).tolist() for few in (40, 0) if not monkeypatch.setattr(spatial, "FEW_POINTS", few)]
        assert both[0] == both[1]
    rows = spark.createDataFrame([(k % 3, float(x), float(y), 1.0) for k, (x, y) in enumerate(rng.random((30, 2)))], "key int, x double, y double, v double")
    plan = spatial.grid_scatter(rows, ["key"], 5, 5)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not any(re.search(r"\bi#", line) for line in joins)


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_grid_scatter_values(spark, method):
    """A plane comes back as itself inside the hull of turned strips; a line has no inside; the least value of a place counts."""
    rows = []
    for key in range(3):
        p = np.random.default_rng(key).random((40, 2)) * [1, 0.01]
        turn = math.radians(25 + 30 * key)
        p = p @ [[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]]
        rows += [(f"k{key}", float(x), float(y), float(3 * x - 2 * y + 1)) for x, y in p]
    rows += [("k0", *rows[0][1:3], 99.0), ("line", 0.0, 0.0, 5.0), ("line", 1.0, 1.0, 6.0), ("odd", NAN, 0.0, 1.0), ("one", 2.0, 3.0, 4.0)]
    got = spatial.grid_scatter(spark.createDataFrame(rows, "key string, x double, y double, v double"), ["key"], 9, 7, method, fill=-1.0).collect()
    assert len(got) == 5 * 63 and {r.key for r in got} == {"k0", "k1", "k2", "line", "one"}
    inside = [r for r in got if r.value != -1]
    if method == "linear":
        assert all(r.value == pytest.approx(3 * r.x - 2 * r.y + 1, abs=1e-6) for r in inside) and len(inside) >= 3 and {r.key for r in inside} <= {"k0", "k1", "k2"}
    else:
        assert len(inside) == len(got) and {r.value for r in got if r.key == "one"} == {4.0} and {r.value for r in got if r.key == "line"} == {5.0, 6.0}
        for r in got:
            assert r.value == min((math.dist((r.x, r.y), (x, y)), x, y, v) for k, x, y, v in rows if k == r.key)[3]
    with pytest.raises(ValueError, match="method"):
        spatial.grid_scatter(spark.createDataFrame(rows, "key string, x double, y double, v double"), ["key"], 3, 3, "cubic")


def test_compare_grids_of_other_shapes(spark):
    a = nodes(spark, "a", lambda i, j: NAN if (i, j) == (3, 1) else 0.5)
    same, moved = nodes(spark, "same", lambda i, j: NAN if (i, j) == (3, 1) else 7), nodes(spark, "moved", lambda i, j: NAN if (i, j) == (2, 1) else 1)
    more, less = nodes(spark, "more", n=5), nodes(spark, "less", n=2)
    others = same.union(moved).union(more).union(less)
    got = {r.grid_id: (r.same_shape, r.same_mask, r.first_difference) for r in grid.compare_grids(a, others).collect()}
    assert got == {"same": (True, True, None), "moved": (True, False, 6), "more": (False, False, 4), "less": (False, False, 2)}


def test_every_grid_counts(spark):
    rows = [(1, 0, k, 1.5, 1.2, 10.0, 30.0, 0.0, 20.0, 10.0, 8.0) for k in range(3)]
    sub = spark.createDataFrame(rows, "event_id long, segment_id int, subfault_id long, lon double, lat double, z double, slip double, strike double, dip double, len_strike_km double, width_dip_km double")
    grids = nodes(spark, "low", lambda i, j: 0.1).union(nodes(spark, "high", lambda i, j: 0.9)).union(nodes(spark, "none", lambda i, j: NAN))
    got = {(r.grid_id, r.x): r.cdf for r in workloads.observed_cdf(sub, grids, 50.0).collect()}
    assert len(got) == 3 * 201 and got["low", 0.5] == 1 and got["high", 0.5] == 0 and got["none", 0.5] == 0
    events = spark.createDataFrame([(1, 1.5, 1.2)], "event_id long, long double, lat double")
    how = {"n_null": 4, "max_tries": 12, "min_finite": 0.5, "kappa": 20.0, "mode": "planar"}
    null = workloads.null_model(events, sub, grids, round_size=5, **how)
    assert {(r.grid_id, r.n_accepted) for r in null.select("grid_id", "n_accepted").distinct().collect()} == {("low", 4), ("high", 4)}
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(null) == key(workloads.null_model(events, sub, grids, round_size=12, **how))  # rounds change nothing
    short = workloads.null_model(events, sub, grids.where("grid_id = 'low'"), **(how | {"n_null": 50})).select("n_accepted").distinct().collect()
    assert short[0][0] <= 12
    with pytest.raises(ValueError, match="mode"):
        workloads.null_model(events, sub, grids, mode="flat")


def test_sample_grid_goes_on_while_short(spark):
    """One node in a large grid: few proposals are accepted; two grids are ready after other rounds; no grid, no samples."""
    peak = nodes(spark, "peak", lambda i, j: 1.0 if (i, j) == (7, 7) else 0.0, 15).union(nodes(spark, "flat", n=15))
    got = sampling.sample_grid(peak, 200)
    assert {r.grid_id: r["count"] for r in got.groupBy("grid_id").count().collect()} == {"peak": 200, "flat": 200}
    assert {r.grid_id for r in got.where("value > 0").select("grid_id").distinct().collect()} == {"peak", "flat"} and got.where("grid_id = 'peak' and (lon < 6 or lon > 8)").count() == 0
    assert sampling.sample_grid(peak.limit(0), 5).count() == 0
    lonely = nodes(spark, "g", lambda i, j: 1.0 if (i, j) == (1, 1) else NAN)
    with pytest.raises(ValueError, match="none of 2000000"):
        sampling.sample_grid(lonely, 5)
    both = lonely.withColumn("grid_id", F.lit("lost")).union(nodes(spark, "flat"))
    assert {r.grid_id: r["count"] for r in sampling.sample_grid(both, 50, strict=False).groupBy("grid_id").count().collect()} == {"flat": 50}


def test_more_names_than_a_plan_holds(spark):
    moves = spark.range(25).select(F.col("id").cast("int").alias("transform_id"))
    rows = spark.createDataFrame([(1,), (2,), (2,)], "p int")
    got = lookup.on_each(rows, "transform_id", moves.union(moves), most=4)
    assert sorted(map(tuple, got.collect())) == sorted((p, k) for p in (1, 2, 2) for k in range(25))
    assert sorted(map(tuple, lookup.on_each(rows, "transform_id", moves, most=25).collect())) == sorted(map(tuple, got.collect()))
    assert lookup.on_each(rows, "transform_id", moves.limit(0), most=4).count() == 0


def test_transforms_and_checks(spark):
    g = nodes(spark, "g", lambda i, j: i + 10 * j)
    meta = grid.grid_meta(g)
    pts = spark.createDataFrame([("g", 1.5, 0.75)], "grid_id string, lon double, lat double")
    back = grid.denormalize_points(grid.normalize_points(pts, meta), meta).first()
    assert (back.lon, back.lat) == pytest.approx((1.5, 0.75))
    turned = grid.apply_map(pts, lambda u, v: (v, 1 - u), meta).first()
    assert (turned.lon, turned.lat) == pytest.approx((0.75, 1.5))
    assert grid.with_monotonic_check(g).count() == 16
    with pytest.raises(Exception, match="monotonic"):
        grid.with_monotonic_check(g.withColumn("lat", F.col("lat") * F.when(F.col("lat_idx") == 2, -1).otherwise(1))).collect()
    with pytest.raises(ValueError, match="base grid"):
        lookup.lookup_many(pts, g.union(nodes(spark, "h", n=3)))
    moves = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.5, 0.0, 0.0)], "transform_id int, angle_deg double, dx double, dy double, px double, py double")
    assert {r.transform_id: r.value for r in lookup.lookup_transformed(pts, g, moves).collect()} == pytest.approx({1: 8.0, 2: 4.0})


def test_count_in_mask_and_histograms(spark):
    df = spark.createDataFrame([("a", 0.2, 1.0), ("a", 0.7, 2.0), ("b", 0.7, 1.0), ("b", NAN, 1.0), ("b", None, 1.0)], "k string, v double, w double")
    assert ecdf.count_in_mask(df, F.col("v") > 0.5).first()[0] == 3  # NaN is above every number
    x = [0.0, 0.5, 1.0]
    parts = [ecdf.histogram(df.where(f"k = '{k}'"), "v", x, ["k"], "w") for k in "ab"]
    whole = ecdf.histogram(df, "v", x, ["k"], "w")
    key = lambda d: sorted(map(tuple, d.select("k", "bucket", "w", "n").collect()))
    assert key(ecdf.merge_histograms(*parts, whole)) == [(k, b, 2 * w, 2 * n) for k, b, w, n in key(whole)]


def test_cdf_per_columns_masks_and_weights(spark):
    rows = [(1, [0.1, 0.9], [1.0, 3.0], True), (2, [0.4, 0.2], [3.0, 1.0], True), (3, [0.0, 0.0], [9.0, 9.0], False)]
    df = spark.createDataFrame(rows, "id int, v array<double>, w array<double>, take boolean")
    got = {(r.k, r.x): r.cdf for r in ecdf.cdf_per_columns(df, [0.25, 1.0], array="v", weight="w", mask=F.col("take")).collect()}
    assert got == pytest.approx({(0, 0.25): 0.25, (0, 1.0): 1.0, (1, 0.25): 0.25, (1, 1.0): 1.0})
    assert {r.k for r in ecdf.cdf_per_columns(df, [1.0], array="v", max_k=1).collect()} == {0}


@pytest.mark.parametrize("kernel", ["gaussian", "epanechnikov", "tophat", "exponential", "linear", "cosine"])
def test_kernels_are_densities(spark, kernel):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,)], "v double")
    x = np.linspace(-12, 14, 1301)
    pdf = [r.pdf for r in kde.kde_pdf(df, ["v"], [(float(v),) for v in x], kernel=kernel, rule=0.8, standardize=False).orderBy("point_idx").collect()]
    assert min(pdf) >= 0 and np.trapezoid(pdf, x) == pytest.approx(1, abs=2e-2)


@pytest.mark.parametrize("mode", ["planar", "geodesic"])
def test_null_model_goes_on_in_rounds(spark, mode):
    """At the default share some events need more rounds, one stays short and one accepts nothing; rounds change nothing."""
    rows = [(e, 0, k, 2.5 + 0.1 * k, 2.5, 10.0, 1.0 + k, 20.0 * e, 20.0, 10.0 if e < 3 else 2000.0, 8.0) for e in (1, 2, 3) for k in range(3)]
    sub = spark.createDataFrame(rows, "event_id long, segment_id int, subfault_id long, lon double, lat double, z double, slip double, strike double, dip double, len_strike_km double, width_dip_km double")
    holes = nodes(spark, "g", lambda i, j: NAN if (i + j) % 3 == 0 or i in (0, 9) or j in (0, 9) else 0.1 * i, 10)
    grids = holes.union(nodes(spark, "h", lambda i, j: NAN if i in (0, 5) or j in (0, 5) else 0.5, 6))
    events = spark.createDataFrame([(e, 2.6, 2.5) for e in (1, 2, 3)], "event_id long, long double, lat double")
    how = {"n_null": 5, "max_tries": 16, "kappa": 30.0, "mode": mode}
    once, rounds = (workloads.null_model(events, sub, grids, round_size=size, **how).collect() for size in (16, 5))
    assert sorted(map(str, once)) == sorted(map(str, rounds))
    counts = {(r.event_id, r.grid_id): r.n_accepted for r in rounds}
    assert len(counts) == 6 and counts[3, "g"] == counts[3, "h"] == 0 and 5 in counts.values()
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()
