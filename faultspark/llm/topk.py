"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Rows are packed into blocks of vectors; the queries, stated by the caller, into blocks of their own.
Every query block meets every vector block. Within a pair, each dimension of the vector block is a
list sorted by value; for a query the lists are read in steps from their better end, rows that a step meets first are
scored, and reading stops once the bound (the sum of the query's weights times the last values
read) falls below the k-th score so far, or every row has been met. The best k of each pair are then ranked over all pairs.
`effort` tells how deep the lists were read and how many rows were scored: with many dimensions of like spread
nearly all rows are met before the bound falls, as the README says.

Cases: null vectors and those with null, NaN or infinite components take no part. Vectors are compared
with those of their own length only; empty vectors score 0. A candidate with the query's own id is
left out; ids repeated with other vectors stay candidates each, and queries each share one ranking.
Equal scores rank by smaller id. Scores are 64-bit integers. An empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

VECTORS, QUERIES, STEP = 8192, 4096, 64


def scaled(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and q = floor(scale * x) of every usable vector."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q")
    )


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows (vec_id, q) as packed blocks: block, dim, ids, values, of at most `most` rows each."""

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            lengths = np.array([len(x) for x in b.column("q").to_pylist()], np.int64)
            flat = b.column("q").flatten().to_numpy(zero_copy_only=False).astype("<i8")
            starts, ids = np.concatenate([[0], np.cumsum(lengths)]), b.column("vec_id").to_numpy().astype("<i8")
            for dim in np.unique(lengths):
                of = np.flatnonzero(lengths == dim)
                for k in range(0, len(of), most):
                    own = of[k : k + most]
                    m = flat[(starts[own][:, None] + np.arange(dim)).ravel()].reshape(len(own), dim)
                    kind = next(t for t in ("<i2", "<i4", "<i8") if not m.size or (np.iinfo(t).min < m.min() and m.max() < np.iinfo(t).max))
                    yield pa.RecordBatch.from_pydict({"block": [part + n], "dim": [int(dim)], "kind": [kind], "ids": [ids[own].tobytes()], "data": [m.astype(kind).tobytes()]})
                    n += 1

    even = rows.repartition(max(1, -(-rows.count() // most)))
    return staged(even.mapInArrow(run, "block long, dim long, kind string, ids binary, data binary"), name)


class Lists:
    """A block of vectors with every dimension's rows sorted by value, read from either end."""

    def __init__(self, values: np.ndarray, ids: np.ndarray):
        self.values, self.ids, self.n = values, ids, len(values)
        self.rows = np.ascontiguousarray(np.argsort(values, 0, kind="stable").T.astype(np.int32))
        self.sorted = np.take_along_axis(values.T, self.rows, 1)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, int, int]:
        """Rows of the k best for one query, the depth read and the rows scored, by the threshold algorithm."""
        n, up, down = self.n, np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        met = self.ids == own
        if not len(up) and not len(down):  # every score is 0
            rows = np.flatnonzero(~met)
            return rows[np.argsort(self.ids[rows], kind="stable")[:k]], 0, 0
        rows, scores, scored, depth, step = np.zeros(0, np.int64), np.zeros(0, query.dtype), 0, 0, max(STEP, n // 64)
        while depth < n and not met.all():
            to = min(n, depth + step)
            read = np.zeros(n, bool)
            read[self.rows[up, depth:to]] = True
            read[self.rows[down, n - to : n - depth]] = True
            new = np.flatnonzero(read & ~met)
            met |= read
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.values[new] @ query])
            scored, depth, step = scored + len(new), to, 2 * step
            if len(rows) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= kth
                rows, scores = rows[keep], scores[keep]
            if len(rows) >= k and scores.min() > self.sorted[up, to - 1] @ query[up] + self.sorted[down, n - to] @ query[down]:
                break  # an unseen row with an equal score could have a smaller id
        return rows[np.lexsort((self.ids[rows], -scores))[:k]], depth, scored


def _answer(k: int, effort: bool):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, asked = np.frombuffer(r["vids"], "<i8"), np.frombuffer(r["qids"], "<i8")
                v, q = (np.frombuffer(r[f"{x}data"], r[f"{x}kind"]).reshape(len(of), r["dim"]) for x, of in (("v", ids), ("q", asked)))
                most = [float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0 for x in (v, q)]
                size = most[0] * most[1] * r["dim"]  # sums under 2^24 are exact in float32, under 2^53 in float64
                exact = np.float32 if size < 2**24 else np.float64 if size < 2**53 else np.int64
                v, q = v.astype(exact), q.astype(exact)
                lists = Lists(v, ids)
                best, depth, scored = zip(*(lists.top(one, i, k) for one, i in zip(q, asked)))
                if effort:
                    cols = asked, np.full(len(asked), len(ids)), depth, scored
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "n_rows", "depth", "n_scored"])
                    continue
                scores = [v[x] @ one for x, one in zip(best, q)]
                cols = np.repeat(asked, [len(x) for x in best]), ids[np.concatenate(best)], np.concatenate(scores).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _met(vectors: DataFrame, is_query: Column) -> DataFrame:
    """Every pair of a query block and a vector block of one length, with their data; dealt out by blocks, not by length."""
    vb = _blocks(vectors, VECTORS, "vectors")
    qb = _blocks(vectors.where(is_query), QUERIES, "queries")
    salts = max(vectors.sparkSession.sparkContext.defaultParallelism, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    side = lambda df, x: df.select(F.col("block").alias(f"{x}block"), F.col("kind").alias(f"{x}kind"), F.col("ids").alias(f"{x}ids"), F.col("data").alias(f"{x}data"))
    asked = qb.select("dim", F.col("block").alias("qblock"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    held = vb.select("dim", F.col("block").alias("vblock"), F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    pairs = asked.join(held, ["dim", "salt"]).drop("salt")
    return pairs.join(side(qb, "q"), "qblock").join(side(vb, "v"), "vblock").repartition(salts)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """vectors: vec_id, q (array of long). query_id, rank, vec_id, score of the k best for each query."""
    found = _met(vectors, is_query).mapInArrow(_answer(k, False), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def effort(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """What top_k does for each query and block: query_id, n_rows of the block, depth read in its lists, n_scored."""
    return _met(vectors, is_query).mapInArrow(_answer(k, True), "query_id long, n_rows long, depth long, n_scored long")
