"""Observed against null distributions, level by level."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.stage import staged
from .ecdf import RANGE, running, same_keys

DRAWS = 1 << 20  # draws of one resample that a task makes in one piece, about
# fixed values: splitmix64's increment and multipliers
GOLDEN, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _both(h: DataFrame, n: DataFrame, keys: list[str]) -> DataFrame:
    return h.select(*keys, "value", F.lit(0).alias("is_n")).unionByName(n.select(*keys, "value", F.lit(1).alias("is_n"))).where(finite(F.col("value")))


def _distinct(h: DataFrame, n: DataFrame, keys: list[str]) -> DataFrame:
    return _both(h, n, keys).groupBy(*keys, "value").agg(F.sum("is_n").alias("nn"), F.sum(1 - F.col("is_n")).alias("nh"))


def p_superiority(h: DataFrame, n: DataFrame, keys: list[str], ties: str = "full") -> DataFrame:
    """Share of pairs with n <= h per key; ties='half' counts equal values as half a win."""
    wins = F.col("nh") * (F.col("_below") - (F.col("nn") / 2 if ties == "half" else F.lit(0)))
    out = running(_distinct(h, n, keys), "value", "nn", keys).groupBy(*keys).agg(F.sum(wins).alias("w"), F.sum("nh").alias("n_h"), F.sum("nn").alias("n_n"))
    return out.select(*keys, F.try_divide(F.col("w").cast("double"), F.col("n_h") * F.col("n_n")).alias("p_gt"), "n_h", "n_n")


def _mixed(base: int, first: int, count: int) -> np.ndarray:
    """Uniforms in [0, 1) numbered from `first`: a counter through splitmix64's finalizer, which 128-bit SQL can follow."""
    z = np.uint64(base) + np.arange(first + 1, first + count + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _drawn(base: int, weights: np.ndarray, first: int, last: int, step: int = 1 << 20) -> np.ndarray:
    """How often draws first..last-1 take each row of weights, a draw taking each of weights.sum() places alike."""
    ends, out = np.cumsum(weights), np.zeros(len(weights), np.int64)
    for at in range(first, last, step):
        places = np.floor(_mixed(base, at, min(step, last - at)) * ends[-1])
        out += np.bincount(np.searchsorted(ends, places, "right"), minlength=len(weights))
    return out


def _base(key: str, resample: int, side: int, part: int) -> int:
    return int(hashlib.md5(f"{key}:{resample}:{side}:{part}".encode()).hexdigest()[:15], 16)


def p_superiority_ci(h: DataFrame, n: DataFrame, keys: list[str], *, resamples: int = 1000, alpha: float = 0.05, seed: int = 0, block: int = 100, size: int = RANGE) -> DataFrame:
    """p_gt with the bootstrap interval: H and N resampled apart, quantiles interpolated linearly.

    Each draw's number comes from (seed, key, resample, side, range, number of the draw), so a lost task draws the same again
    and other engines can repeat it. Draws go in two steps: over a key's ranges of `size` distinct values, then within each
    range, whose wins Spark adds up. No task holds all values of a key or makes more than block * DRAWS draws of the first
    step (or block * 100 for each range of its key). Null keys have an interval of their own. Without values on one side: null.
    """
    ranks = running(_distinct(h, n, keys).withColumn("_one", F.lit(1)), "value", "_one", keys)
    rows = staged(ranks.select(*keys, "value", "nh", "nn", F.floor((F.col("_below") - 1) / size).alias("_range")), "ranks")
    sums = rows.groupBy(*keys, "_range").agg(F.sum("nh").alias("nh"), F.sum("nn").alias("nn"))
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    sides = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", "nh", "nn"))).alias("_s"), F.sum("nh").alias("nh"), F.sum("nn").alias("nn")).where("nh > 0 and nn > 0")
    n_blocks = -(-resamples // block)
    tasks = int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: adaptive merging would make one task of them
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("nh").alias("n"), F.col("_s.nh").alias("c")), F.struct(F.lit(1).alias("side"), F.col("nn").alias("n"), F.col("_s.nn").alias("c"))))
    dealt = sides.select(*keys, text.alias("_key"), side.alias("_d")).withColumn("_step", F.greatest(F.lit(DRAWS), 100 * F.size("_d.c")).cast("long"))
    dealt = dealt.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_d.n") - 1, F.col("_step"))))
    dealt = dealt.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(tasks, *keys, "_d.side", "_from", "_b")

    @F.pandas_udf("array<array<long>>")  # made on the driver, when called
    def totals(key: pd.Series, side: pd.Series, counts: pd.Series, first: pd.Series, last: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for own, s, c, i, j, k in zip(key, side, counts, first, last, b):
            each = range(k * block, min(k * block + block, resamples))
            c = np.asarray(c, np.int64)
            out.append(np.stack([_drawn(_base(own, r, s, -1), c, i, j) for r in each], 1).tolist())
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def draws(key: pd.Series, values: pd.Series, taken: pd.Series, r: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for own, v, t, x, k in zip(key, values, taken, r, b):
            nh, nn = np.array([(y["nh"], y["nn"]) for y in v], np.int64).T
            wins = []
            for y in t:
                mh, mn = (_drawn(_base(own, k * block + y["i"], s, x), w, 0, y[f]) if y[f] else np.zeros(len(v), np.int64) for s, w, f in ((0, nh, "th"), (1, nn, "tn")))
                wins.append(float((mh * (y["before"] + np.cumsum(mn)).astype(float)).sum()))
            out.append(wins)
        return pd.Series(out)

    last = F.least(F.col("_from") + F.col("_step"), F.col("_d.n"))
    first = dealt.select(*keys, "_key", "_b", "_d.side", F.posexplode(totals("_key", "_d.side", "_d.c", "_from", last, "_b")).alias("_range", "_t"))
    first = first.select(*keys, "_key", "_b", "side", F.col("_range").cast("long").alias("_range"), F.posexplode("_t").alias("i", "t"))
    of = lambda s: F.sum(F.when(F.col("side") == s, F.col("t")).otherwise(0))
    taken = first.groupBy(*keys, "_key", "_b", "_range", "i").agg(of(0).alias("th"), of(1).alias("tn"))
    before = F.sum("tn").over(Window.partitionBy(*keys, "_b", "i").orderBy("_range")) - F.col("tn")
    taken = taken.withColumn("before", before).groupBy(*keys, "_key", "_b", "_range").agg(F.array_sort(F.collect_list(F.struct("i", "th", "tn", "before"))).alias("_t"))
    packed = rows.groupBy(*keys, "_range").agg(F.array_sort(F.collect_list(F.struct("value", "nh", "nn"))).alias("_v"))
    each = same_keys(taken, packed, [*keys, "_range"]).repartition(tasks, *keys, "_range", "_b")
    wins = each.select(*keys, "_b", F.posexplode(draws("_key", "_v", "_t", "_range", "_b")).alias("_i", "w")).groupBy(*keys, "_b", "_i").agg(F.sum("w").alias("w"))
    point = p_superiority(h, n, keys)
    p = same_keys(wins, point, keys).withColumn("p", F.col("w") / (F.col("n_h") * F.col("n_n")))
    interval = p.groupBy(*keys).agg(F.percentile("p", alpha / 2).alias("ci_low"), F.percentile("p", 1 - alpha / 2).alias("ci_high"))
    return same_keys(point, interval, keys, "left").select(*keys, "p_gt", "ci_low", "ci_high")


def observed_vs_null(observed: DataFrame, null: DataFrame, keys: list[str], **ci) -> DataFrame:
    """Observed and null CDFs (keys, x_idx, x, cdf) compared at each level; with resamples=..., the interval too."""
    h, n = (d.select(*keys, "x_idx", F.col("cdf").alias("value")) for d in (observed, null))
    by = [*keys, "x_idx"]
    return p_superiority_ci(h, n, by, **ci) if ci.get("resamples") else p_superiority(h, n, by)
