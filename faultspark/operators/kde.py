"""Weighted moments, bandwidths and kernel densities as sums over partitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite

BLOCK, MOST_POINTS = 4096, 200_000  # query points go to every task: 8 bytes a number

KERNELS = {
    "gaussian": lambda u: np.exp(-0.5 * u * u),
    "tophat": lambda u: (u < 1).astype(float),
    "epanechnikov": lambda u: np.maximum(1 - u * u, 0),
    "exponential": lambda u: np.exp(-u),
    "linear": lambda u: np.maximum(1 - u, 0),
    "cosine": lambda u: np.where(u < 1, np.cos(np.pi / 2 * np.minimum(u, 1)), 0),
}


def kernel_norm(kernel: str, d: int) -> float:
    """Integral of the kernel over d dimensions at bandwidth 1."""
    sphere = 2 * math.pi ** (d / 2) / math.gamma(d / 2)
    if kernel == "gaussian":
        return (2 * math.pi) ** (d / 2)
    if kernel == "exponential":
        return sphere * math.gamma(d)
    r = (np.arange(200_000) + 0.5) / 200_000
    return float(sphere * (KERNELS[kernel](r) * r ** (d - 1)).mean())


def _usable(df: DataFrame, cols: list[str], weight: str | None) -> DataFrame:
    ok = finite(F.col(cols[0]))
    for c in [*cols[1:], *([weight] if weight else [])]:
        ok = ok & finite(F.col(c))
    return df.where(ok)


def weighted_moments(df: DataFrame, cols: list[str], keys: list[str], weight: str | None = None) -> DataFrame:
    """Per key and axis the mean and population variance, in two passes; scale is the deviation, 1 where it is 0."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = _usable(df, cols, weight)
    means = rows.groupBy(*keys).agg(*(F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"mean_{c}") for c in cols))
    both = rows.join(means, keys) if keys else rows.withColumn("_k", F.lit(1)).join(F.broadcast(means.withColumn("_k", F.lit(1))), "_k")
    var = [F.try_divide(F.sum(w * F.pow(F.col(c) - F.col(f"mean_{c}"), 2)), F.sum(w)).alias(f"var_{c}") for c in cols]
    out = both.groupBy(*keys).agg(*(F.first(f"mean_{c}").alias(f"mean_{c}") for c in cols), *var)
    return out.withColumns({f"scale_{c}": F.when(F.col(f"var_{c}") > 0, F.sqrt(f"var_{c}")).otherwise(1.0) for c in cols})


def effective_n(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Kish's effective number: the squared sum over the sum of squares."""
    return df.where(finite(F.col(weight))).groupBy(*keys).agg(F.try_divide(F.pow(F.sum(weight), 2), F.sum(F.col(weight) * F.col(weight))).alias("n_eff"))


def bandwidth(rule: str | float, n_eff: Column, d: int) -> Column:
    if isinstance(rule, (int, float)):
        return F.lit(float(rule))
    if rule not in ("scott", "silverman"):
        raise ValueError("the bandwidth is 'scott', 'silverman' or a number")
    return F.pow(n_eff, F.lit(-1.0 / (d + 4))) * (0.9 if rule == "silverman" else 1.0)


def kde_pdf(df: DataFrame, cols: list[str], points: list[tuple[float, ...]], *, weight: str | None = None, rule: str | float = "scott", kernel: str = "gaussian", standardize: bool = True) -> DataFrame:
    """Density at each query point: point_idx, the coordinates, pdf. Rows stay where they are; a task sends one sum a point."""
    if len(points) > MOST_POINTS:
        raise ValueError(f"{len(points)} query points are more than {MOST_POINTS}")
    d, rows = len(cols), _usable(df, cols, weight)
    m = weighted_moments(rows, cols, [], weight)
    n = effective_n(rows.withColumn("_w", F.col(weight) if weight else F.lit(1.0)), [], "_w").withColumn("_k", F.lit(1))
    one = m.withColumn("_k", F.lit(1)).join(n, "_k").withColumn("h", bandwidth(rule, F.col("n_eff"), d)).first()
    if one is None or one["n_eff"] is None:
        raise ValueError("there is no weight to estimate a density from")
    centre = np.array([one[f"mean_{c}"] if standardize else 0.0 for c in cols])
    scale = np.array([one[f"scale_{c}"] if standardize else 1.0 for c in cols])
    h, at, form = float(one["h"]), np.array(points, float).reshape(-1, d), kernel
    query = (at - centre) / scale / h
    norm = kernel_norm(kernel, d) * h**d * float(np.prod(scale))

    def run(frames):
        total, mass = np.zeros(len(query)), 0.0
        for f in frames:
            x = (f[cols].to_numpy(float) - centre) / scale / h
            w = f["_w"].to_numpy(float)
            mass += w.sum()
            size = max(1, 4_000_000 // max(1, len(query)))
            for k in range(0, len(x), min(BLOCK, size)):
                part = x[k : k + min(BLOCK, size)]
                u = np.sqrt(sum((query[:, None, a] - part[None, :, a]) ** 2 for a in range(d)))
                total += KERNELS[form](u) @ w[k : k + len(part)]
        yield pd.DataFrame({"point_idx": np.arange(len(query)), "s": total, "mass": mass})

    sums = rows.select(*(F.col(c).cast("double").alias(c) for c in cols), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")).mapInPandas(run, "point_idx int, s double, mass double")
    out = sums.groupBy("point_idx").agg((F.sum("s") / F.sum("mass") / norm).alias("pdf"))
    names = [f"x{k}" for k in range(d)] if d > 1 else ["x"]
    asked = df.sparkSession.createDataFrame(pd.DataFrame({"point_idx": np.arange(len(at), dtype=np.int32), **{c: at[:, k] for k, c in enumerate(names)}}))
    return asked.join(out, "point_idx").select("point_idx", *names, "pdf")


def kde_pdf2d(df: DataFrame, x: str, y: str, x_grid: list[float], y_grid: list[float], **how) -> DataFrame:
    """2-D density on the mesh of two axes, x varying fastest."""
    return kde_pdf(df, [x, y], [(a, b) for b in y_grid for a in x_grid], **how)


def pdf_cdf(df: DataFrame, value: str, x: list[float], *, weight: str | None = None, **how) -> DataFrame:
    """Density and chunk-wise ECDF on one grid: x_idx, x, pdf, cdf."""
    from .ecdf import cdf_chunked, levels

    x = levels(x)
    cdf = cdf_chunked(df.withColumn("_g", F.lit(1)), value, x, ["_g"], weight).drop("_g")
    return cdf.join(kde_pdf(df, [value], [(v,) for v in x], weight=weight, **how).select(F.col("point_idx").alias("x_idx"), "pdf"), "x_idx").select("x_idx", "x", "pdf", "cdf")
