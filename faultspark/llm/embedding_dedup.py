"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors are one class, the smallest vec_id its representative. A class has a sketch, the signs of random projections.
2. Every pass orders the classes by its own share of projections, concatenated to one number, within ranges of that number, and compares each with the WINDOW next ones.
   Pairs whose sketches differ by more than a pair of the threshold does (but with probability MISS) are dropped, the others are verified on the full vectors in double precision.
   Neighbours whose sketches differ by less than those of any pair under the threshold (but with probability MISS) hang on the first such neighbour; pairs of one such tree need no look.
   There are as many passes as leave a pair at the threshold unseen with probability MISS in a table of this size, were its vectors spread evenly.
3. The verified pairs of all passes are joined to components. Within a component every pair is then settled: members that are nearer than half the threshold's angle
   to the component's first member are linked with each other without a look (their angles add up to less), all others are compared with every member in blocks,
   which gives each vector's number of links, no pair being written.

Cases: null, empty and zero vectors and those that hold null, NaN or infinite components link with nothing and are kept. A null vec_id takes no part either: its component_id
is null. Vectors of other lengths never meet. Copies of rows are vectors each and link with each other; rows that repeat a vec_id with other vectors are one node of the graph.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, staged
from .near_dedup import components

BITS, KEY, WINDOW, MISS, BLOCK = 256, 60, 64, 1e-5, 1024
_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def planes(dim: int, count: int, stream: int) -> np.ndarray:
    return np.random.default_rng([17, stream, dim]).standard_normal((dim, count))


def n_passes(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has stood in one window of n evenly spread vectors, but with probability miss."""
    differ = math.acos(threshold) / math.pi
    together = (1 - differ) ** max(0.0, math.log2(max(1, n) / window))
    return max(4, math.ceil(math.log(miss) / math.log1p(-min(together, 1 - 1e-9))))


def most_differing(threshold: float, miss: float = MISS) -> int:
    """Of BITS signs, more than this differ with probability under miss at the threshold."""
    p, total, k = math.acos(threshold) / math.pi, 0.0, -1
    while total < 1 - miss:
        k += 1
        total += math.exp(math.lgamma(BITS + 1) - math.lgamma(k + 1) - math.lgamma(BITS - k + 1) + k * math.log(p) + (BITS - k) * math.log1p(-p)) if p else 1.0
    return k


def surely_linked(threshold: float, miss: float = MISS) -> int:
    """Of BITS signs, no more than this differ with probability under miss where the similarity is under the threshold; -1 if there is no such number."""
    p, total, k = math.acos(threshold) / math.pi, 0.0, 0
    while p:
        total += math.exp(math.lgamma(BITS + 1) - math.lgamma(k + 1) - math.lgamma(BITS - k + 1) + k * math.log(p) + (BITS - k) * math.log1p(-p))
        if total > miss:
            break
        k += 1
    return k - 1


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def _by_length(b: pa.RecordBatch, name: str):
    lengths = pc.list_value_length(b.column(name))
    for n in pc.unique(lengths).to_pylist():
        yield n, b.filter(pc.equal(lengths, n))


def _sketched(passes: int):
    """dim, rep, sketch and the pass keys of every class."""

    def run(batches):
        for b in batches:
            for dim, part in _by_length(b, "v"):
                v = unit(matrix(part.column("v")))
                sketch = np.packbits(v @ planes(dim, BITS, 0) > 0, axis=1)
                for p in range(passes):
                    key = (v @ planes(dim, KEY, p + 1) > 0) @ (1 << np.arange(KEY, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), dim)), pa.array(np.full(len(v), p)), pa.array(key), part.column("rep"), pa.array([s.tobytes() for s in sketch], pa.binary())], names=["dim", "pass", "key", "rep", "sketch"]
                    )

    return run


def _windows(most: int, sure: int, window: int):
    """Pairs of neighbours in order whose sketches agree well enough: a, b. Of pairs in one tree of sure neighbours only the tree's own."""

    def run(batches):
        tail = None
        for b in batches:
            group = b.column("dim").to_numpy() * (1 << 20) + b.column("pass").to_numpy()
            rep, sketch = b.column("rep").to_numpy(), np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            if tail is not None:
                group, rep, sketch = np.concatenate([tail[0], group]), np.concatenate([tail[1], rep]), np.concatenate([tail[2], sketch])
            held, met, hangs = 0 if tail is None else len(tail[1]), [], np.arange(len(rep))
            for d in range(1, min(window, len(rep) - 1) + 1):
                i = np.flatnonzero(group[:-d] == group[d:])
                differ = _ONES[sketch[i] ^ sketch[i + d]].sum(1)
                close = i[differ <= sure]
                hangs[close + d] = close  # the farthest back comes last
                i = i[(differ <= most) & (i + d >= held)]  # the later one is new
                met.append(np.stack([i, i + d], 1))
            tree = np.stack([hangs, np.arange(len(rep))], 1)[held:]
            root = hangs
            while (root != root[root]).any():
                root = root[root]
            met = np.concatenate([*met, np.zeros((0, 2), np.int64)])
            met = np.concatenate([met[root[met[:, 0]] != root[met[:, 1]]], tree[tree[:, 0] != tree[:, 1]]])
            pairs = np.unique(np.sort(rep[met], 1), axis=0)
            tail = group[-window:], rep[-window:], sketch[-window:]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _verified(threshold: float):
    def run(batches):
        for b in batches:
            for _, part in _by_length(b, "va"):
                keep = pa.array(cosines(matrix(part.column("va")), matrix(part.column("vb"))) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return run


def _angles(batches):
    """rep, component, n, v and the angle to the component's first member."""
    for b in batches:
        for _, part in _by_length(b, "v"):
            angle = np.arccos(np.clip(cosines(matrix(part.column("v")), matrix(part.column("first"))), -1, 1))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("rep", "component", "n", "v")] + [pa.array(angle)], names=["rep", "component", "n", "v", "angle"])


def _linked(threshold: float):
    """rep and the number of rows of others it is linked with, of two blocks (side 0, 1) or one block with itself; pairs of the core are left out."""

    def run(key, t):
        side, core, n, rep = (t.column(c).to_numpy() for c in ("side", "core", "n", "rep"))
        v = matrix(t.column("v").combine_chunks())
        size = np.sqrt((v * v).sum(1))
        left = np.flatnonzero(side == 0)
        right = left if key[1].as_py() == key[2].as_py() else np.flatnonzero(side == 1)
        found = np.zeros(len(rep), np.int64)
        for k in range(0, len(left), 256):
            i = left[k : k + 256]
            hit = (v[i] @ v[right].T) / (size[i][:, None] * size[right]) >= threshold
            hit &= ~(core[i][:, None] & core[right]) & (rep[i][:, None] != rep[right])
            found[i] += hit @ n[right]
            if right is not left:
                found[right] += n[i] @ hit
        some = np.flatnonzero(found)
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "n_links": pa.array(found[some])})

    return run


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """rep, n_links: rows of other classes that each member (rep, component, n, v) of a component is linked with."""
    first = members.where(F.col("rep") == F.col("component")).select("component", F.col("v").alias("first"))
    near = members.join(first, "component").mapInArrow(_angles, "rep long, component long, n long, v array<double>, angle double")
    near = staged(near.withColumn("core", F.col("angle") <= math.acos(threshold) / 2 - 1e-9), "angles")
    sums = near.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("n_core"), F.count_if("core").alias("m"), F.count_if(~F.col("core")).alias("r"))
    sums = staged(sums.select("component", "n_core", F.ceil(F.col("m") / BLOCK).cast("int").alias("m"), F.ceil(F.col("r") / BLOCK).cast("int").alias("r")), "sums")
    sure = near.where("core").join(sums, "component").select("rep", (F.col("n_core") - F.col("n")).alias("n_links"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    rest = near.join(sums.where("r > 0"), "component").withColumn("mine", F.when(F.col("core"), F.col("r") + block("m")).otherwise(block("r")))
    others = F.sequence(F.lit(0), F.when(F.col("core"), F.col("r") - 1).otherwise(F.col("r") + F.col("m") - 1))
    dealt = rest.withColumn("other", F.explode(others)).select(
        "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "n", "core", "v"
    )
    more = dealt.groupBy("component", "i", "j").applyInArrow(_linked(threshold), "rep long, n_links long")
    return sure.unionByName(more).groupBy("rep").agg(F.sum("n_links").alias("n_links"))


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = 0.95, window: int = WINDOW, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.coalesce(F.col(id_col).isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    plain = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, plain).alias("v"))
    digest = F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v").cast("binary"), 256))
    rows = rows.withColumn("digest", digest)
    classes = staged(spread(rows.where("v is not null")).groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")

    passes = n_passes(classes.count(), threshold, window, miss)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = staged(spread(classes.select("rep", "v")).mapInArrow(_sketched(passes), "dim long, pass long, key long, rep long, sketch binary"), "keyed")
    order = ["dim", "pass", "key", "rep"]
    pairs = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_windows(most_differing(threshold, miss), surely_linked(threshold, miss), window), "a long, b long").where("a < b").distinct()
    sides = [classes.select(F.col("rep").alias(x), F.col("v").alias(f"v{x}")) for x in "ab"]
    met = staged(pairs, "pairs").join(sides[0], "a").join(sides[1], "b").where(F.size("va") == F.size("vb"))
    links = staged(met.mapInArrow(_verified(threshold), "a long, b long").distinct(), "links")

    found = components(links).withColumnRenamed("id", "rep")
    members = staged(classes.join(found, "rep").select("rep", "component", "n", "v"), "members")
    counted = staged(_counted(members, threshold), "counted")
    of_class = staged(classes.select("digest", "rep", F.col("n").alias("copies")).join(found.join(counted, "rep", "left"), "rep", "left").drop("v"), "of_class")
    out = rows.select("vec_id", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component", "rep", "vec_id")
    n_links = F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
