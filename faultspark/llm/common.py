"""What the operators of this subpackage share: shared folders, tables, word memos."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is made in local mode only: a cluster's executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="faultspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared one; Spark deletes it when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{fresh_dir(spark, name)}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as the session has cores; large scans pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def crcs(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each stretch of ids, as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
    return np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip((4 * start).tolist(), (4 * end).tolist())), np.int64, len(start))


def blocks(column: pa.Array, most_bytes: int = 2 << 20):
    """Slices (start, texts) of a text column with about most_bytes each, nulls as empty texts."""
    texts = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def strings(texts: pa.Array) -> list[str]:
    """The texts as Python strings, without a scalar object for each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts split at blanks: first word of each text (and the end), each word's code, the words by code."""
    lists = pc.split_pattern(texts, " ")
    off = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    off = off - off[0]
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        keep = codes != empty
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        codes = codes[keep]
    return off, codes, words


class WordMemo:
    """Rows of numbers by word, worked out once for each word seen; at most `most` words are held.

    Natural text repeats its words, so the costly work on a word is done a few times a worker only.
    """

    def __init__(self, work: Callable[[list[str]], np.ndarray], most: int = 100_000):
        self.work, self.most = work, most
        self.at: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def of(self, words: list[str]) -> np.ndarray:
        """The words' rows."""
        places = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(places < 0)
        new = list(dict.fromkeys(words[k] for k in missing))
        if len(self.at) + len(new) > self.most and self.at:
            self.at.clear()
            missing, new = np.arange(len(words)), list(dict.fromkeys(words))
        if new or self.rows is None:
            rows, used = self.work(new), len(self.at)
            need = used + len(new)
            if self.rows is None or need > len(self.rows):
                grown = np.zeros((max(need, 2 * used, 4096), *rows.shape[1:]), rows.dtype)
                if self.rows is not None:
                    grown[:used] = self.rows[:used]
                self.rows = grown
            self.rows[used:need] = rows
            self.at.update(zip(new, range(used, need)))
            places[missing] = np.fromiter((self.at[words[k]] for k in missing), np.int64, len(missing))
        return self.rows[places]
