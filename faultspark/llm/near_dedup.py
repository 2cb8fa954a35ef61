"""MinHash near-duplicates with sequential Bayesian verification.

1. Each document becomes the set of its distinct word shingles (64-bit hashes), a digest of the set and
   a MinHash signature. Documents with the same set are one class, the smallest doc_id its representative.
2. Signatures are cut in bands; classes that agree in a band share a bucket. Each bucket's smallest
   member is its pivot, and every member is a candidate with the pivot: a group of n gives n-1 pairs.
3. Candidates are compared one batch of the signature at a time. With a uniform prior the similarity
   after m matches in n is Beta(m+1, n-m+1); a pair is dropped once the chance that its similarity
   reaches the threshold is below `miss`. Survivors are verified exactly on the full sets.
4. Components of the verified links. Buckets that still hold several components form clusters, which are
   compared in blocks, banded pairs of different components only, again signatures first and full sets
   for the survivors, in one task of two blocks; a link is given once for two groups. Components are taken once more.

Every banded pair is either tested or already known to be in one component. With 32 bands of 4 rows a
pair of similarity 0.8 misses all bands with probability 5e-8.

Cases: null or empty text, or text without words, has no set, links with nothing and is kept. Texts of fewer words
than a shingle have their whole word sequence as the one shingle. A null doc_id takes no part: its
component_id is null and it is kept. Copies of rows come back as often as they came. Rows with one doc_id are one document: what any of its
texts is linked with is in its component. Very long texts give long sets; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, blocks, spread, staged, strings, word_codes

BANDS, ROWS, BATCH = 32, 4, 32
MISS = 1e-7
BLOCK = 256
_HASH = np.random.default_rng(20).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
_XOR, _MUL = _HASH[0], _HASH[1] | np.uint32(1)
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hash(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, size: int):
        self.size, self.memo = size, WordMemo(_word_hash)

    def sets(self, column: pa.Array):
        for _, texts in blocks(column):
            plain = pc.replace_substring_regex(pc.ascii_lower(texts), "[\\x09-\\x0D]", " ")
            off, codes, words = word_codes(plain)
            one = self.memo.of(strings(words))[codes]
            many = one.copy()
            for k in range(1, self.size):
                many[: len(one) - k] = many[: len(one) - k] * _P + one[k:]
            many = _mix(many)
            for a, b in zip(off, off[1:]):
                if b - a >= self.size:
                    yield np.unique(many[a : b - self.size + 1])
                elif b > a:
                    h = np.uint64(b - a)
                    for w in one[a:b]:
                        h = np.uint64((int(h) * int(_P) + int(w)) & 0xFFFFFFFFFFFFFFFF)
                    yield _mix(np.array([h]))
                else:
                    yield np.zeros(0, np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    x = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(out, ((x[k : k + 2048, None] ^ _XOR) * _MUL).min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band, different bands never sharing one by construction of the mix."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = key * _P + rows[:, k]
    return _mix(key).astype(np.int64)


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n hashes, fewer than m matches leave P(similarity >= threshold) under miss.

    P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Rows of the paired signatures that no batch rules out."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in steps:
        matches = matches + (a[alive, at:n] == b[alive, at:n]).sum(1)
        keep = matches >= m
        alive, matches, at = alive[keep], matches[keep], n
    return alive


def _signed(size: int):
    def run(batches):
        own = Shingler(size)
        for b in batches:
            out = [[], [], [], []]
            for s in own.sets(b.column("text")):
                d = xxhash.xxh3_128_digest(s.tobytes())
                for x, v in zip(out, (len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), signature(s).tobytes() if len(s) else None)):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return run


def _banded(batches):
    for b in batches:
        sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        keys = [band_keys(s) for s in sigs]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("rep").to_numpy(), BANDS)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], names=["rep", "band"])


def _pruned(steps):
    def run(batches):
        for b in batches:
            s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("sig_a", "sig_b"))
            keep = pa.array(surviving(s, t, steps))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], names=["a", "b"])

    return run


def _blockwise(steps, percent: int):
    """Links between different components of two blocks, tested in full there; of each pair of local groups one link is enough."""

    def run(key, t):
        rep, comp, side = (t.column(c).to_numpy() for c in ("rep", "comp", "side"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        bands = sig.reshape(len(sig), BANDS, ROWS)
        own = t.column("own").combine_chunks()
        flat, off = own.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False))])
        sets = [flat[a:b] for a, b in zip(off, off[1:])]
        same_block = key[1].as_py() == key[2].as_py()
        left = np.arange(len(rep)) if same_block else np.flatnonzero(side == 0)
        right = left if same_block else np.flatnonzero(side == 1)
        group, a, b = comp.copy(), [], []
        for i in left:
            others = right[(group[right] != group[i]) & ((rep[right] > rep[i]) if same_block else True)]
            others = others[(bands[others] == bands[i]).all(2).any(1)] if len(others) else others
            others = others[surviving(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others], steps)]
            for j in others[np.argsort(-(sig[others] == sig[i]).sum(1), kind="stable")]:
                if group[j] != group[i]:
                    n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                        group[group == group[j]] = group[i]
                        a.append(min(rep[i], rep[j]))
                        b.append(max(rep[i], rep[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (a, b); labels and jumps, a written table a round."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        lower = staged(lower, "labels")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        now = staged(lower.join(jump, "component").select("id", F.col("further").alias("component"), "was"), "labels")
        if now.where("component != was").isEmpty():
            return now.select("id", "component")
        labels = now.select("id", "component")


def _sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id and own (the full set) of the documents with these doc_ids, written once."""

    def run(batches):
        own = Shingler(size)
        for b in batches:
            sets = [s.astype(np.int64) for s in own.sets(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "own"])

    return staged(docs.join(ids.distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(run, "id long, own array<long>"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b), each given once, whose full sets reach the threshold. Nothing groups by a behind the join, so a pivot of many pairs can be split."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, size)
    left, right = (sets.select(F.col("id").alias(x), F.col("own").alias(f"set_{x}")) for x in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(right, "b").join(left, "a").where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def _between_components(shared: DataFrame, found: DataFrame, sigs: DataFrame, docs: DataFrame, size: int, percent: int, steps) -> DataFrame:
    """Links between components that meet in buckets of three and more, where pivots alone don't settle all pairs.

    Open buckets that share members form clusters. A cluster's members outside its largest component are dealt into blocks, and
    every such block meets every block of the cluster; a task holds two blocks with their sets.
    """
    member = shared.where("n > 2").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    member = staged(member, "members")
    buckets = member.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by("comp", "rep").alias("hub"))
    open_ = staged(buckets.where("low != high").select("band", "hub"), "open")
    still = staged(member.join(open_, "band").select("rep", "comp", "hub").distinct(), "still")
    meet = staged(still.where("comp != hub").select(F.col("comp").alias("a"), F.col("hub").alias("b")).distinct(), "meet")
    clusters = components(meet).select(F.col("id").alias("comp"), F.col("component").alias("cluster"))
    placed = staged(still.select("rep", "comp").distinct().join(clusters, "comp").select("rep", "comp", "cluster"), "placed")
    sizes = placed.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")).where("n_all > n_main")
    main = staged(main.select("cluster", "main", F.ceil(F.col("n_main") / BLOCK).cast("int").alias("m"), F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int").alias("r")), "main")
    ids = placed.join(main.select("cluster"), "cluster", "left_semi").select(F.col("rep").alias("doc_id"))
    rest = placed.join(main, "cluster").withColumn("is_main", F.col("comp") == F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    rest = rest.withColumn("mine", F.when(F.col("is_main"), F.col("r") + block("m")).otherwise(block("r")))
    rest = rest.join(sigs, "rep").join(_sets(ids, docs, size).withColumnRenamed("id", "rep"), "rep")
    others = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("r") - 1).otherwise(F.col("r") + F.col("m") - 1))
    dealt = rest.withColumn("other", F.explode(others)).select(
        "cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "comp", "sig", "own"
    )
    return dealt.groupBy("cluster", "i", "j").applyInArrow(_blockwise(steps, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    steps = least_matches(percent / 100, miss)
    signed = staged(spread(docs).mapInArrow(_signed(shingle), "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "signed")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    classes = staged(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    bands = staged(classes.mapInArrow(_banded, "rep long, band long"), "bands")
    buckets = staged(bands.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = staged(bands.join(buckets, "band"), "shared")
    sigs = classes.select("rep", "sig")

    star = shared.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    signed_b = star.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    signed_ab = signed_b.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    pairs = staged(signed_ab.mapInArrow(_pruned(steps), "a long, b long"), "pairs")
    links = staged(_verified(pairs, docs, shingle, percent), "links")
    found = components(links)

    more = staged(_between_components(shared, found, sigs, docs, shingle, percent, steps), "more")
    if not more.isEmpty():
        found = components(links.union(more))
    of_class = classes.select("d1", "d2", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    of_class = staged(of_class, "components")
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
