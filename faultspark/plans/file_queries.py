"""Queries that go through written files: slip models as .fsp texts, and the CDF store; with their SQL on the tables the files were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stage import folder
from ..operators.cdf_store import CdfStore
from ..sources import adapters as A
from ..sources.fsp import read_fsp, write_fsp


X = [5.0 * k for k in range(21)]


def _read_back(spark, sf_dir):
    path = folder(spark, "fsp") + "/files"
    write_fsp(*A.models(spark, sf_dir), path)
    return read_fsp(spark, path)


def _number(name: str):
    """NaN, as files hold missing numbers, as null; to nine places."""
    return F.round(F.when(~F.isnan(name), F.col(name)), 9).alias(name)


def fsp_events(spark, sf_dir):
    events = _read_back(spark, sf_dir)[0]
    return events.select("event_id", "event", F.col("date_parsed").cast("string").alias("date_parsed"), "reference", *map(_number, ("lat", "long", "depth", "mw", "global_strike", "global_dip")), "nsg", F.col("data")["SGM"].alias("n_sgm"), F.col("data")["GPS"].alias("n_gps"))


def fsp_segments(spark, sf_dir):
    return _read_back(spark, sf_dir)[1].select("event_id", "segment_id", *map(_number, ("strike", "dip", "len_strike_km", "width_dip_km")))


def fsp_subfaults(spark, sf_dir):
    read = _read_back(spark, sf_dir)[2]
    return read.select("event_id", "segment_id", "subfault_id", *map(_number, ("lon", "lat", "z", "slip", "rake", "trup", "rise", "strike", "dip", "len_strike_km", "width_dip_km")))


def cdf_store(spark, sf_dir):
    """CDFs by type of all days, each day a batch; every batch is sent twice, the second time by itself days after others."""
    values = A.values(spark, sf_dir)
    at = folder(spark, "cdf-store") + "/store"
    store = CdfStore(spark, at, X, ["k"])
    days = F.dayofmonth("day")
    batch = values.withColumn("batch", F.col("day").cast("string"))
    store.append(batch.where(days <= 20), "value", weight="weight")
    store.append(batch.where(days > 10), "value", weight="weight")
    store.append(batch.where(days % 2 == 0), "value", weight="weight")
    cdf = store.cdf(total="finite", force_endpoints=True)
    return cdf.withColumn("cdf", F.round("cdf", 9))


QUERIES = {"fsp_events": fsp_events, "fsp_segments": fsp_segments, "fsp_subfaults": fsp_subfaults, "cdf_store": cdf_store}

_MODELS = """rows AS (SELECT o_custkey // 50 AS c, CAST(o_orderkey % 3 AS INTEGER) AS seg, o_orderkey AS k, -72 + (o_orderkey % 97) * 3e-2 AS lon, -30 + (o_orderkey % 211) * 5e-2 AS lat, 5e0 + o_orderkey % 40 AS z, o_totalprice / 125000.0 AS slip,
 CAST(o_orderdate AS DATE) AS day FROM orders),
numbered AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY c ORDER BY seg) - 1 AS INTEGER) AS segment_id FROM rows)"""
_PLANE = "CAST((c * 37 + seg * 20) % 360 AS DOUBLE) AS strike, CAST(10 + (c + seg) % 35 AS DOUBLE) AS dip, 10e0 AS len_strike_km, seg + 8.75e0 AS width_dip_km"

ORACLE_SQL = {
    "fsp_events": f"""WITH {_MODELS} SELECT 's' || c AS event_id, 'Coast ' || c || ', South' AS event, CAST(min(day) AS VARCHAR) AS date_parsed, 'Customer ' || c || ' (2012)' AS reference, round(min(lat), 9) AS lat, round(min(lon), 9) AS "long", max(z) AS depth, round(max(slip), 9) AS mw,
 CAST(c % 360 AS DOUBLE) AS global_strike, CAST(c % 90 AS DOUBLE) AS global_dip, CAST(count(DISTINCT seg) AS INTEGER) AS nsg, CAST(count(*) AS INTEGER) AS n_sgm, CAST(count(DISTINCT seg) AS INTEGER) AS n_gps FROM rows GROUP BY c""",
    "fsp_segments": f"WITH {_MODELS} SELECT DISTINCT 's' || c AS event_id, segment_id, {_PLANE} FROM numbered",
    "fsp_subfaults": f"""WITH {_MODELS} SELECT 's' || c AS event_id, segment_id, CAST(row_number() OVER (PARTITION BY c, seg ORDER BY k) - 1 AS INTEGER) AS subfault_id, round(lon, 9) AS lon, round(lat, 9) AS lat, z, round(slip, 9) AS slip,
 CAST((k * 11) % 180 AS DOUBLE) AS rake, CAST(k % 13 AS DOUBLE) AS trup, CASE WHEN k % 7 <> 0 THEN CAST(k % 5 AS DOUBLE) END AS rise, {_PLANE} FROM numbered""",
    "cdf_store": """WITH v AS (SELECT event_type AS k, value, CAST(user_id % 5 AS DOUBLE) AS weight FROM events WHERE event_id % 50 <> 0)
SELECT k, x_idx, x, CASE x_idx WHEN 0 THEN 0e0 WHEN 20 THEN 1e0 ELSE round(sum(CASE WHEN value <= x THEN weight ELSE 0e0 END) / sum(weight), 9) END AS cdf FROM v, (SELECT CAST(i AS INTEGER) AS x_idx, i * 5e0 AS x FROM range(21) t(i)) GROUP BY k, x_idx, x""",
}
