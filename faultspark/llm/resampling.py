"""Importance resampling toward a target corpus over hashed n-grams, worked out by Arrow kernels.

1. Texts go through ascii_lower, split_pattern_regex, list_flatten and dictionary_encode, a block of texts at a time. Shifted
   dictionary indices form the n-grams: an (n-1)-gram's index and the next word's are a pair, only distinct pairs become texts and get a CRC,
   and its remainder is the feature's bucket.
2. Every task adds up its buckets; both corpora come down to one number a bucket, from which a bucket's gain follows. The number of buckets is a parameter,
   so the gains have a proven size and are broadcast.
3. A second pass takes the gains by feature and reduces them by document to its weight; keyed noise makes it a score.
4. Ranks come from ranges of (score, doc_id): a range's rows are counted, and only ranges that the draw reaches are ordered.

Cases: null and empty texts have no features and weight 0; a null doc_id has no noise, so its score and rank are null and it is no part of the N documents, but its
words count. Rows with one doc_id are documents each; rows that agree in doc_id and score are told apart by n_features, others are alike. Very long texts
are a block of their own. An empty target gives every bucket t = 0. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, spread, staged, strings

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT, LEAST_WORDS, SEED = 10, 20, 2024


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First word of each text (and the end), each word's index, the words by index."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    coded = pc.list_flatten(lists).dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    index, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    blank = pc.index(words, "").as_py()
    if blank >= 0:
        keep = index != blank
        index, ends = index[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
    return ends, index, words


def _crc(words: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) % buckets for w in strings(words)), np.int64, len(words))


def features(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each feature's text number and bucket, and the number of words by text. A block's words are hashed once each."""
    ends, index, words = word_lists(texts)
    lengths = np.diff(ends)
    left = np.repeat(ends[1:], lengths) - np.arange(len(index))  # words from here to the text's end
    owner = np.repeat(np.arange(len(lengths)), lengths)
    owners, put = [owner], [_crc(words, buckets)[index] if len(index) else index]
    at, grams, names = np.arange(len(index)), index, words
    for k in range(2, n + 1):
        keep = left[at] >= k
        at, grams = at[keep], grams[keep]
        pairs, back = np.unique(grams * len(words) + index[at + k - 1], return_inverse=True)
        names = pc.binary_join_element_wise(names.take(pa.array(pairs // max(1, len(words)))), words.take(pa.array(pairs % max(1, len(words)))), " ")
        grams = back
        owners.append(owner[at])
        put.append(_crc(names, buckets)[grams] if len(grams) else grams)
    return np.concatenate(owners), np.concatenate(put), lengths


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all texts by bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, part in blocks(b.column("text")):
                total += np.bincount(features(part, n, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return spread(texts.select("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Gain of each bucket: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))."""
    s, t = (np.zeros(buckets) for _ in range(2))
    for of, rows in ((s, docs), (t, target)):
        for r in bucket_counts(rows, n, buckets).collect():  # one row a bucket at most
            of[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the features' gains, of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(gains(docs, target, n, buckets))

    def run(batches):
        gain = shipped.value
        for b in batches:
            for at, part in blocks(b.column("text")):
                owner, put, words = features(part, n, buckets)
                order = np.argsort(owner, kind="stable") if n > 1 else slice(None)
                n_features = np.bincount(owner, minlength=len(words))
                upto = np.concatenate([[0], np.cumsum(np.take(gain, put[order]))])
                last = np.cumsum(n_features)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(words)), pa.array(words), pa.array(n_features), pa.array(upto[last] - upto[last - n_features])], names=["doc_id", "n_words", "n_features", "weight"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of docs (doc_id, text) with its n_features, weight, score and its rank in the draw of `percent` percent of those with least_words words; rank null where not drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(weighted(docs, target, n=n, buckets=buckets).withColumn("score", F.col("weight") + noise), "scored")
    long_enough = F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    ranged = staged(scored.where(long_enough).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = dict(ranged.groupBy("_range").count().collect())  # one row a partition
    drawn, base, reached = percent * sum(counts.values()) // 100, 0, []
    for k in sorted(counts):
        if base < drawn:
            reached.append((k, base))
        base += counts[k]
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not reached:
        return scored.select(*out, none)
    bases = F.element_at(F.create_map(*(F.lit(v) for pair in reached for v in pair)), F.col("_range"))
    near = ranged.where(F.col("_range") <= reached[-1][0]).withColumn("_place", (bases + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).cast("long"))
    near = near.select(*out, F.when(F.col("_place") <= drawn, F.col("_place")).alias("rank"))
    far = ranged.where(F.col("_range") > reached[-1][0]).select(*out, none)
    return near.unionByName(far).unionByName(scored.where(~long_enough).select(*out, none))
