"""Grids in tiles against the broadcast lookup: edges, holes, many grids, no shuffle of points."""

import pytest
from faultspark.functions.rng import number
from faultspark.operators.ecdf import histogram
from faultspark.operators.lookup import lookup_grid
from faultspark.operators.tiles import raster_tiles, tiled_histogram
from faultspark.plans import workloads
from pyspark.sql import functions as F

NAN = float("nan")
NODE = "grid_id string, lat_idx int, lon_idx int, lat double, lon double, value double"
X = [k / 10 for k in range(11)]


def field(spark, nx=9, ny=7, names="ab"):
    rows = [(g, j, i, -30.0 + j, -72.0 + i / 2, NAN if (i * 7 + j * 3 + k) % 11 == 0 else None if (i, j) == (4, 4) else (i * 13 + j * 29 + k * 5) % 31 / 31) for k, g in enumerate(names) for i in range(nx) for j in range(ny)]
    return spark.createDataFrame(rows, NODE)


def faults(spark, n=40):
    rows = [(i % 4, i % 2, i, -72.5 + (i * 37) % 51 / 10, -30.5 + (i * 17) % 71 / 10, 5.0, (i * 41) % 360 + 0.0, 20.0, 40.0, 30.0, (i % 5) / 2.0) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, segment_id int, subfault_id long, lon double, lat double, z double, strike double, dip double, len_strike_km double, width_dip_km double, slip double")


def as_rows(df):
    return sorted(tuple(r) for r in df.select("event_id", "grid_id", "bucket", "n", F.round("w", 6)).collect())


@pytest.mark.parametrize("tile", [1, 2, 3, 4, 8, 100])
def test_tiles_equal_broadcast(spark, tile):
    args = (faults(spark), field(spark), 60.0, X, ["event_id", "grid_id"])
    assert as_rows(workloads.rupture_histogram(*args, most_nodes=0, tile=tile)) == as_rows(workloads.rupture_histogram(*args))


def test_null_model_in_tiles(spark):
    subs = faults(spark, 12)
    events = subs.groupBy("event_id").agg(F.avg("lon").alias("long"), F.avg("lat").alias("lat"))
    run = lambda **how: sorted(map(str, workloads.null_model(events, subs, field(spark), n_null=2, max_tries=6, min_finite=0.3, kappa=20.0, x=X, round_size=3, **how).collect()))
    assert run(most_nodes=0, tile=3) == run()


def test_hot_tile_places_and_missing_grids(spark):
    """One tile with nearly every point in more copies than one; places that are none and grids that are not there count as undefined. By hand: (18.2 * 0.6 + 16.2 * 0.4) / 31 = 0.561, level 6."""
    rows = [(k, "a" if k else "gone", 0, 5, NAN if k == 3 else -71.3, -29.6) for k in range(200)]
    dealt = spark.createDataFrame(rows, "k long, grid_id string, _from long, _to long, lon double, lat double")
    key = ["grid_id"]
    got = tiled_histogram(dealt, number, field(spark), X, key, 2, blocks=7)
    want = histogram(lookup_grid(number(dealt), field(spark)), "value", X, key)
    rows = lambda d: sorted(tuple(r) for r in d.select("grid_id", "bucket", "n", "w").collect())
    assert rows(got) == rows(want) and [r[:3] for r in rows(got)] == [("a", -1, 5), ("a", 6, 990), ("gone", -1, 5)]


def test_incomplete_grids_fail_and_empty_tables(spark):
    whole = field(spark)
    for bad in (whole.where("not (lat_idx = 3 and lon_idx = 3)"), whole.unionByName(whole.limit(1))):
        with pytest.raises(Exception, match="missing or repeated"):
            raster_tiles(bad, 4).collect()
    assert raster_tiles(whole.limit(0)).isEmpty()
    assert workloads.rupture_histogram(faults(spark).limit(0), whole, 60.0, X, ["event_id", "grid_id"], most_nodes=0).isEmpty()


def test_no_point_is_shuffled(spark):
    """Points arise (Generate) above the last join with tiles, and only their counts go on."""
    plan = workloads.rupture_histogram(faults(spark), field(spark), 60.0, X, ["event_id", "grid_id"], most_nodes=0, tile=4)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode(sequence(_from" in line)
    above = lines[:at]
    first_partial = max(i for i, line in enumerate(above) if "partial_sum" in line)
    assert not any("Exchange hash" in line for line in above[first_partial:])
