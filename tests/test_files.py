"""Written .fsp files and the CDF store."""

import datetime

import pytest
from faultspark.operators.cdf_store import CdfStore
from faultspark.operators.ecdf import ecdf_on_grid
from faultspark.sources.fsp import read_fsp, write_fsp
from pyspark.sql import functions as F

NAN = float("nan")
EVENT = "event_id string, event string, date_parsed date, reference string, lat double, long double, depth double, mw double, nsg int, global_strike double, global_dip double, size_len double, size_wid double, data map<string,int>"
SEGMENT = "event_id string, segment_id int, strike double, dip double, len_strike_km double, width_dip_km double"
SUBFAULT = "event_id string, segment_id int, subfault_id long, lon double, lat double, z double, slip double, rake double, trup double, rise double"


def test_fsp_goes_out_and_comes_back(spark, tmp_path):
    """Two events, one with segments 4 and 9, tiny and huge numbers, a missing rise time, no data counts, ids with blanks."""
    day = datetime.date(2010, 2, 27)
    events = [("s 2010/A", "Far, Away", day, "Someone (2014)", -35.1, -72.7, 35.0, 8.8, 2, 15.0, 18.0, 500.0, 200.0, {"SGM": 3, "GPS": 4}), ("t", "", day, "", 1e-12, 0.1 + 0.2, 0.0, 7.0, 1, 0.0, 0.0, 1.0, 1.0, None)]
    segments = [("s 2010/A", 9, 20.0, 30.0, 11.0, 7.0), ("s 2010/A", 4, 10.0, 15.0, 10.5, 8.75), ("t", 0, 1.0, 2.0, 3.0, 4.0)]
    rows = [("s 2010/A", 9, 5, -72.123456789012345, -35.0, 5.0, 1.5, 90.0, 3.0, None), ("s 2010/A", 4, 1, 1e-300, 1e22, 6.0, 2.5, 80.0, 4.0, 2.0), ("s 2010/A", 4, 0, -1.0, -2.0, 7.0, 0.0, 70.0, 5.0, 1.0)]
    write_fsp(spark.createDataFrame(events, EVENT), spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(rows, SUBFAULT), str(tmp_path / "out"))
    # t has a segment without rows: its table is there and empty
    e, s, f = read_fsp(spark, str(tmp_path / "out"))
    got = {r.event_id: r for r in e.collect()}
    a = got["s 2010/A"]
    assert (a.event, a.date_parsed, a.reference, a.lat, a.long, a.depth, a.mw, a.nsg, a.global_strike, a.global_dip, a.data) == ("Far, Away", day, "Someone (2014)", -35.1, -72.7, 35.0, 8.8, 2, 15.0, 18.0, {"SGM": 3, "GPS": 4})
    assert (got["t"].lat, got["t"].long, got["t"].data, got["t"].reference) == (1e-12, 0.1 + 0.2, None, "")
    assert sorted(tuple(r) for r in s.select("event_id", "segment_id", "strike", "dip", "len_strike_km", "width_dip_km").collect()) == [("s 2010/A", 0, 10.0, 15.0, 10.5, 8.75), ("s 2010/A", 1, 20.0, 30.0, 11.0, 7.0), ("t", 0, 1.0, 2.0, 3.0, 4.0)]
    back = sorted(tuple(r) for r in f.select("segment_id", "subfault_id", "lon", "lat", "z", "slip", "rake", "trup", F.coalesce(F.nanvl("rise", F.lit(-1.0)), F.lit(-2.0))).collect())
    assert back == [(0, 0, -1.0, -2.0, 7.0, 0.0, 70.0, 5.0, 1.0), (0, 1, 1e-300, 1e22, 6.0, 2.5, 80.0, 4.0, 2.0), (1, 0, -72.123456789012345, -35.0, 5.0, 1.5, 90.0, 3.0, -1.0)]


X = [0.0, 1.0, 2.0]
ROWS = [("a", 0.5, 1.0, "d1"), ("a", 1.5, 2.0, "d1"), ("b", NAN, 1.0, "d1"), ("a", 2.5, 4.0, "d2"), (None, 0.5, 1.0, "d2"), ("b", 1.0, 3.0, "d/3"), ("a", 0.1, 1.0, None)]


def batches(spark, *names):
    return spark.createDataFrame([r for r in ROWS if r[3] in names], "k string, v double, weight double, batch string")


def test_batches_sent_again_change_nothing(spark, tmp_path):
    store = CdfStore(spark, str(tmp_path / "s"), X, ["k"])
    store.append(batches(spark, "d1", "d2"), "v", weight="weight")
    first = sorted(map(str, store.cdf().collect()))
    store.append(batches(spark, "d1"), "v", weight="weight")
    store.append(batches(spark), "v", weight="weight")
    assert sorted(map(str, store.cdf().collect())) == first
    again = CdfStore(spark, str(tmp_path / "s"), X, ["k"])
    again.append(batches(spark, "d/3", None), "v", weight="weight")
    whole = ecdf_on_grid(batches(spark, "d1", "d2", "d/3", None), "v", X, ["k"], weight="weight", force_endpoints=False)
    assert sorted(map(str, again.cdf().collect())) == sorted(map(str, whole.collect()))
    assert {r.x: r.cdf for r in whole.where("k is null").collect()} == {0.0: 0.0, 1.0: 1.0, 2.0: 1.0}
    assert {r.batch for r in again.batches().select("batch").distinct().collect()} == {"bd1", "bd2", "bd/3", "null"}
    again.append(batches(spark, "d1").limit(1), "v", weight="weight")  # a batch sent otherwise takes the place of what it was
    assert again.batches().where("batch = 'bd1'").agg(F.sum("n")).first()[0] == 1
    again.drop_batch("d1")
    assert "bd1" not in {r.batch for r in again.batches().collect()}


def test_store_refuses_other_levels(spark, tmp_path):
    CdfStore(spark, str(tmp_path / "s"), X, ["k"])
    for x, keys, how in ((X[:2], ["k"], {}), (X, ["j"], {}), (X, ["k"], {"inclusive": False})):
        with pytest.raises(ValueError, match="other levels"):
            CdfStore(spark, str(tmp_path / "s"), x, keys, **how)
    with pytest.raises(ValueError, match="cannot be called"):
        CdfStore(spark, str(tmp_path / "t"), X, ["batch"])


def test_stream_into_the_store(spark, tmp_path):
    """Files as a stream, one a micro-batch; the last one run again under its number counts once."""
    for k in range(3):
        spark.createDataFrame([("a", 0.5 + k), ("b", k / 2)], "k string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = CdfStore(spark, str(tmp_path / "s"), X, ["k"])
    seen = []

    def run(df, number):
        seen.append(number)
        store.append_stream(df, number, "v")
        if number == 1:
            store.append_stream(df, number, "v")

    stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3
    want = ecdf_on_grid(spark.read.parquet(str(tmp_path / "in")), "v", X, ["k"], force_endpoints=False)
    assert sorted(map(str, store.cdf().collect())) == sorted(map(str, want.collect()))
