"""Weighted empirical CDFs on fixed levels, without sorting values: buckets, one partial aggregate, running sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite

RANGE = 10_000  # distinct values of a key that one task orders, about
MOST_LEVELS = 100_000  # the levels go into the plan; 201 are usual


def levels(x: list[float]) -> list[float]:
    """Strictly rising levels; sorted and made unique if they are not."""
    out = [float(v) for v in x]
    if any(b <= a for a, b in zip(out, out[1:])):
        out = sorted(set(out))
    if len(out) > MOST_LEVELS:
        raise ValueError(f"{len(out)} levels are more than {MOST_LEVELS}")
    return out


def bucket(value: Column, x: list[float], inclusive: bool = True) -> Column:
    """Index of the first level at or above (above, if not inclusive) a value; len(x) beyond the last, -1 if not finite.

    Even levels are guessed by arithmetic and set right by the two neighbours; others take a binary search.
    """
    m = len(x)
    grid = F.array(*(F.lit(v) for v in x))
    reached = (lambda i: value <= F.element_at(grid, i + 1)) if inclusive else (lambda i: value < F.element_at(grid, i + 1))
    step = (x[-1] - x[0]) / (m - 1) if m > 1 else 0
    even = m > 2 and all(abs(v - (x[0] + k * step)) < step * 1e-6 for k, v in enumerate(x))
    if even:
        guess = F.greatest(F.lit(0), F.least(F.lit(m - 1), F.ceil((F.greatest(F.lit(x[0] - step), F.least(F.lit(x[-1] + step), value)) - x[0]) / step).cast("int")))
        low = F.greatest(guess - 1, F.lit(0))
        found = F.when(reached(low), low).when(reached(guess), guess).when((guess < m - 1) & reached(F.least(guess + 1, F.lit(m - 1))), F.least(guess + 1, F.lit(m - 1))).otherwise(m)
    else:
        rounds = max(1, m.bit_length() + 1)
        begin = F.struct(F.lit(0).alias("a"), F.lit(m).alias("b"))

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
            go = (s["a"] < s["b"]) & reached(F.least(mid, F.lit(m - 1)))
            return F.struct(F.when((s["a"] < s["b"]) & ~go, mid + 1).otherwise(s["a"]).alias("a"), F.when(go, mid).otherwise(s["b"]).alias("b"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, halve)["a"]
    return F.when(finite(value), found).otherwise(-1)


def bucket_arrays(value: Column, x: list[float], inclusive: bool = True) -> Column:
    """bucket by arrays of values. What made the values and what counts them are then two loops in Spark: as one, a loop of over 8,000 bytes after a lookup, Java does not compile it."""
    grid, side = np.array(x), "left" if inclusive else "right"

    @F.arrow_udf("int")
    def find(v: pa.Array) -> pa.Array:
        v = v.to_numpy(zero_copy_only=False)
        return pa.array(np.where(np.isfinite(v), np.searchsorted(grid, v, side), -1).astype(np.int32))

    return find(value)


def histogram(df: DataFrame, value: str, x: list[float], keys: list[str], weight: str | None = None, inclusive: bool = True, arrays: bool = False) -> DataFrame:
    """keys, bucket, w (sum of weights), n (rows). Tables of several batches add up: see merge_histograms. arrays: see bucket_arrays, for values that much code made."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    usable = finite(w) if weight is not None else F.lit(True)
    put = F.when(usable, (bucket_arrays if arrays else bucket)(F.col(value), x, inclusive)).otherwise(-1)
    amount = F.when(usable & (w < 0), F.raise_error(F.lit("weights must be nonnegative")).cast("double")).when(usable, w).otherwise(0.0)
    return df.groupBy(*keys, put.alias("bucket")).agg(F.sum(amount).alias("w"), F.count("*").alias("n"))


def merge_histograms(*tables: DataFrame) -> DataFrame:
    """The histogram of all batches together."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    keys = [c for c in both.columns if c not in ("bucket", "w", "n")]
    return both.groupBy(*keys, "bucket").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))


def from_histogram(hist: DataFrame, x: list[float], keys: list[str], total: str = "finite", force_endpoints: bool = False) -> DataFrame:
    """keys, x_idx, x, cdf from a histogram; a null key is a key.

    total: 'finite' divides by the weight of finite values (no weight: all 0), 'floor' by at least 1.0,
    'all' by the weight of every row, undefined values included (no weight: an error).
    """
    m = len(x)
    w = Window.partitionBy(*keys)
    have = F.sum(F.when(F.col("bucket") >= 0, F.col("w")))
    sums = hist.groupBy(*keys).agg({"finite": F.coalesce(have, F.lit(0.0)), "floor": F.greatest(F.coalesce(have, F.lit(0.0)), F.lit(1.0)), "all": F.sum("w")}[total].alias("_total"))
    spine = sums.select(*keys, "_total", F.posexplode(F.array(*(F.lit(v) for v in x))).alias("x_idx", "x"))
    joined = same_keys(spine, hist.select(*keys, F.col("bucket").alias("x_idx"), "w"), [*keys, "x_idx"], "left")
    run = F.sum(F.coalesce("w", F.lit(0.0))).over(w.orderBy("x_idx"))
    if total == "all":
        bad = F.raise_error(F.lit("the total weight is not positive and finite")).cast("double")
        cdf = run / F.when(finite(F.col("_total")) & (F.col("_total") > 0), F.col("_total")).otherwise(bad)
    else:
        cdf = F.when(F.col("_total") > 0, run / F.when(F.col("_total") > 0, F.col("_total"))).otherwise(0.0)
    if force_endpoints:
        cdf = F.when(F.col("x_idx") == m - 1, 1.0).when(F.col("x_idx") == 0, 0.0).otherwise(cdf)
    return joined.select(*keys, "x_idx", "x", cdf.alias("cdf"))


def ecdf_on_grid(df: DataFrame, value: str, x: list[float], keys: list[str], *, weight: str | None = None, inclusive: bool = True, force_endpoints: bool = True) -> DataFrame:
    """Weighted ECDF at each level; pairs of finite value and weight only; a negative weight is an error."""
    x = levels(x)
    return from_histogram(histogram(df, value, x, keys, weight, inclusive), x, keys, "finite", force_endpoints)


def cdf_per_columns(df: DataFrame, x: list[float], *, array: str | None = None, value: str = "value", keys: list[str] | None = None, weight: str | None = None, mask: Column | None = None, max_k: int | None = None) -> DataFrame:
    """ECDF of every column k. Wide rows (an array column) or long ones (keys, value); total weight at least 1.0.

    weight: a number per row, or an array as long as the values. mask: rows to take.
    """
    x, keys = levels(x), keys or ["k"]
    df = df if mask is None else df.where(mask)
    if array is not None:
        per_element = weight is not None and df.schema[weight].dataType.typeName() == "array"
        values = F.arrays_zip(F.col(array).alias("v"), F.col(weight).alias("w")) if per_element else F.col(array)
        df = df.select(*([weight] if weight and not per_element else []), F.posexplode(values).alias("k", "_e"))
        df = df.withColumns({value: F.col("_e.v").cast("double"), weight: F.col("_e.w").cast("double")}) if per_element else df.withColumn(value, F.col("_e").cast("double"))
    if max_k is not None:
        df = df.where(F.col(keys[-1]) < max_k)
    return from_histogram(histogram(df, value, x, keys, weight), x, keys, "floor")


def cdf_chunked(df: DataFrame, value: str, x: list[float], keys: list[str], weight: str | None = None) -> DataFrame:
    """ECDF whose denominator counts every row, undefined values included."""
    x = levels(x)
    return from_histogram(histogram(df, value, x, keys, weight), x, keys, "all")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys, null keys included."""
    other = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [a[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return (a.join(other, on, how) if keys else a.crossJoin(other)).drop(*(f"_r_{k}" for k in keys))


def ranged(distinct: DataFrame, value: str, keys: list[str], size: int = RANGE) -> DataFrame:
    """Rows with _range: rising ranges of values per key, of about size rows."""
    most = distinct.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    n = -(-most // size)
    if n < 2:
        return distinct.withColumn("_range", F.lit(0))
    cuts = distinct.groupBy(*keys).agg(F.percentile_approx(value, [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("_cuts"))
    return same_keys(distinct, cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def running(distinct: DataFrame, value: str, amount: str, keys: list[str], size: int = RANGE) -> DataFrame:
    """distinct with _below, the amounts up to each value, and _total: sums of ranges first, then within each range."""
    rows = ranged(distinct, value, keys, size)
    sums = rows.groupBy(*keys, "_range").agg(F.sum(amount).alias("_s"))
    whole = Window.partitionBy(*keys)
    before = sums.select(*keys, "_range", (F.sum("_s").over(whole.orderBy("_range")) - F.col("_s")).alias("_before"), F.sum("_s").over(whole).alias("_total"))
    inside = F.sum(amount).over(Window.partitionBy(*keys, "_range").orderBy(value))
    return same_keys(rows.withColumn("_inside", inside), before, [*keys, "_range"]).withColumn("_below", F.col("_before") + F.col("_inside")).drop("_inside", "_before", "_range")


def ecdf_steps(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The raw ECDF: one step for each distinct finite value."""
    counts = df.where(finite(F.col(value))).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running(counts, value, "n", keys).select(*keys, value, "n", (F.col("_below") / F.col("_total")).alias("cdf"))


def count_in_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.agg(F.count_if(mask).alias("n_selected"))
