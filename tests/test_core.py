import math

import numpy as np
import pytest
from faultspark.functions.geodesy import from_utm, geodesic_direct, geodesic_inverse, to_utm
from faultspark.operators import ecdf, grid, lookup, sampling, spatial
from faultspark.sources.fsp import read_fsp
from pyspark.sql import functions as F

NAN = float("nan")
FSP = """% ---
% Event : Somewhere, Land \t\t03/14/2011 \t\t[Writer (2012) ]
% EventTAG: s2011TEST
%
% Loc  : LAT = -20.5 LON = -70.25 DEP = 30.0
% Size : LEN = 20.0 km WID = 10.0 km Mw = 7.10 Mo = 1e20 Nm
% Mech : STRK = 10.0 DIP = 20.0 RAKE = 90.0 Htop = 5 km
% Invs : Dx = 10.00 km Dz = 5.00 km
% Invs : Ntw = 1 Nsg = 1
% Data : SGM TELE GPS
% Data : 1 2 3
%  LAT LON X==EW Y==NS Z SLIP RAKE TRUP RISE
% ------
 -20.5 -70.2 0 0 5.0 1.5 90.0 2.0 4.0
 -20.4 -70.1 0 0 6.0 0.5 80.0 3.0 2.0
"""


def test_fsp(spark, tmp_path):
    (tmp_path / "a.fsp").write_text(FSP)
    events, segments, subfaults = read_fsp(spark, str(tmp_path))
    e = events.first()
    assert (e["event"], str(e["date_parsed"]), e["mw"], e["reference"]) == ("Somewhere, Land", "2011-03-14", 7.1, "Writer (2012)")
    assert e["data"] == {"SGM": 1, "TELE": 2, "GPS": 3}
    assert segments.select("len_strike_km", "width_dip_km", "strike").first()[:] == (10.0, 5.0, 10.0)
    assert [r[:] for r in subfaults.select("slip", "z", "rake", "trup").orderBy("subfault_id").collect()] == [(1.5, 5.0, 90.0, 2.0), (0.5, 6.0, 80.0, 3.0)]


def test_missing_date_fails(spark, tmp_path):
    (tmp_path / "a.fsp").write_text(FSP.replace("03/14/2011", ""))
    with pytest.raises(Exception, match="no date"):
        read_fsp(spark, str(tmp_path))[0].collect()


def test_geodesy(spark):
    rows = [(-71.5, -30.25, 19), (3.0, 60.0, 31)]
    back = from_utm(to_utm(spark.createDataFrame(rows, "lon0 double, lat0 double, utm_zone int"), "lon0", "lat0"))
    assert all(abs(r.lon - r.lon0) < 1e-9 and abs(r.lat - r.lat0) < 1e-9 for r in back.collect())
    d, a = geodesic_inverse(np.array([-70.0]), np.array([-20.0]), np.array([-72.0]), np.array([-33.0]))
    x, y = geodesic_direct(np.array([-70.0]), np.array([-20.0]), a, d)
    assert abs(x[0] + 72) < 1e-9 and abs(y[0] + 33) < 1e-9


def test_ecdf_cases(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", NAN), ("b", NAN)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = lambda d: {(r.k, r.x): r.cdf for r in d.collect()}
    on = got(ecdf.ecdf_on_grid(df, "v", [1.0, 2.0, 3.0], ["k"], force_endpoints=False))
    assert on["a", 1.0] == pytest.approx(1 / 3) and on["a", 2.0] == 1 and on["b", 3.0] == 0
    left = got(ecdf.ecdf_on_grid(df, "v", [1.0, 2.0, 3.0], ["k"], inclusive=False, force_endpoints=False))
    assert left["a", 2.0] == pytest.approx(1 / 3)
    assert got(ecdf.cdf_chunked(df.where("k = 'a'"), "v", [1.0, 2.5], ["k"]))["a", 2.5] == 0.75
    odd = got(ecdf.ecdf_on_grid(df, "v", [0.5, 1.0, 2.2], ["k"], force_endpoints=False))
    assert odd["a", 1.0] == pytest.approx(1 / 3)


def test_lookup(spark):
    nodes = [("g", j, i, float(j), float(i), NAN if (i, j) == (2, 2) else float(i + 10 * j)) for i in range(3) for j in range(3)]
    g = spark.createDataFrame(nodes, "grid_id string, lat_idx int, lon_idx int, lat double, lon double, value double")
    pts = spark.createDataFrame([("g", 0.5, 0.5), ("g", -5.0, 1.0), ("g", 1.5, 1.5)], "grid_id string, lon double, lat double")
    got = {(r.lon, r.lat): r.value for r in lookup.lookup_grid(pts, g).collect()}
    assert got[0.5, 0.5] == 5.5 and got[-5.0, 1.0] == 10 and math.isnan(got[1.5, 1.5])
    with pytest.raises(Exception, match="not rectilinear"):
        grid.validate_grid(g.where("lat_idx + lon_idx > 0").select("grid_id", "lat", "lon", "value")).collect()


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    assert len(spatial.ear_clip(np.array(ring))) == 3
    df = spark.createDataFrame([(1, ring, 500)], "poly_id int, ring array<struct<x:double,y:double>>, n int")
    pts = sampling.sample_polygons(df, "n")
    inside = pts.join(df.select("poly_id", "ring"), "poly_id").where(spatial.inside_ring(F.col("ring"), F.col("x"), F.col("y")))
    assert pts.count() == 500 and inside.count() >= 498
    assert len(spatial.delaunay(np.random.default_rng(1).random((30, 2)))) > 30
