"""Keyed uniforms: the same key gives the same number whatever the partitioning or retries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 10_000
SOME = 500  # numbers of a row that md5 draws at once, as a batch holds 10,000 rows
LANES = 16_384  # messages hashed side by side: arrays that fit a core's cache
_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINES = [np.uint32(int(abs(np.sin(k + 1)) * 2**32)) for k in range(64)]
_WORDS = [k for k in range(16)] + [(5 * k + 1) % 16 for k in range(16)] + [(3 * k + 5) % 16 for k in range(16)] + [7 * k % 16 for k in range(16)]


def uniform(seed: int, stream: str, *keys: Column | str, rng: str = "xxhash64") -> Column:
    """A number in [0, 1) for the key. rng='md5' gives what other engines can compute, at eight times the cost."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    if rng == "md5":
        text = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *(c.cast("string") for c in cols))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return F.xxhash64(F.lit(seed), F.lit(stream), *cols).bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53)


def deal(df: DataFrame, n: str, keys: list[str], block: int = BLOCK) -> DataFrame:
    """A row for each block of at most `block` of a row's n, dealt out over the tasks: numbers _from up to below _to."""
    some = df.where(F.col(n) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block))))
    low = F.col("_block") * block
    return some.repartition(*keys, "_block").withColumns({"_from": low, "_to": F.least(low + block, F.col(n).cast("long"))}).drop("_block")


def number(dealt: DataFrame, index: str = "sample_idx") -> DataFrame:
    """The numbers of each block as rows."""
    return dealt.withColumn(index, F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))).drop("_from", "_to")


def explode_counts(df: DataFrame, n: str, keys: list[str], index: str = "sample_idx", block: int = BLOCK) -> DataFrame:
    """n rows for each row, numbered from 0. Blocks of rows are dealt out first, so a large n fills many tasks."""
    return number(deal(df, n, keys, block), index)


def _md5_numbers(blocks: np.ndarray) -> np.ndarray:
    """The first 52 bits of the md5 of padded messages of one block (rows of 64 bytes), as numbers in [0, 1)."""
    m = np.ascontiguousarray(blocks.view("<u4").T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(m.shape[1], x) for x in start)
    t = np.empty_like(a)
    for k in range(64):
        if k < 16:
            f = np.bitwise_xor(c, d)
            f &= b
            f ^= d
        elif k < 32:
            f = np.bitwise_xor(b, c)
            f &= d
            f ^= c
        elif k < 48:
            f = np.bitwise_xor(b, c)
            f ^= d
        else:
            f = np.invert(d)
            f |= b
            f ^= c
        f += a
        f += _SINES[k]
        f += m[_WORDS[k]]
        turn = _TURNS[k // 16][k % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        f <<= np.uint32(turn)
        f |= t
        f += b
        a, b, c, d = d, f, b, c
    high, low = (a + start[0]).byteswap().astype(np.uint64), (b + start[1]).byteswap()
    return ((high << np.uint64(20)) | (low >> np.uint32(12))).astype(float) / float(1 << 52)


def _numbers(texts: np.ndarray, sizes: np.ndarray, index: np.ndarray, at: int, streams: list[bytes]) -> list[np.ndarray]:
    """For each stream the numbers of texts (rows of bytes, the stream's name at `at`) with index after them."""
    digits = np.maximum(1, np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), index, side="right") + 1)
    ends = sizes + digits
    if texts.shape[1] < 64 or ends.max(initial=0) > 55:  # more than one block: one by one
        whole = [bytes(t[:n]) + b"%d" % k for t, n, k in zip(texts, sizes, index)]
        return [np.array([int(hashlib.md5(w[:at] + s + w[at + 1 :]).hexdigest()[:13], 16) / (1 << 52) for w in whole]) for s in streams]
    rows = np.arange(len(index))
    for k in range(int(digits.max(initial=0))):
        some = rows[digits > k]
        texts[some, sizes[some] + k] = 48 + index[some] // 10 ** (digits[some] - 1 - k) % 10
    texts[rows, ends] = 0x80
    texts.view("<u4")[:, 14] = ends * 8
    out = []
    for s in streams:
        texts[:, at] = s[0]
        out.append(_md5_numbers(texts))
    return out


def drawer(seed: int, streams: str) -> Callable[..., Column]:
    """A column function of text, low and high: an array with the md5 numbers (see uniform) of low to high - 1 in each one-letter stream. text: see drawn."""
    at = len(f"{seed}:")

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(s, T.DoubleType()) for s in streams])))
    def draws(text: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        text = text.cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
        sizes, low, n = np.diff(offsets), low.to_numpy(), high.to_numpy() - low.to_numpy()
        wide = max(64, int(sizes.max(initial=0)))
        ends = np.cumsum(n)
        parts = [[] for _ in streams]
        for first in range(0, int(ends[-1]) if len(n) else 0, LANES):
            number = np.arange(first, min(first + LANES, int(ends[-1])))
            row = np.searchsorted(ends, number, side="right")
            own, place = np.arange(row[0], row[-1] + 1), row - row[0]
            from_ = offsets[own][:, None] + np.arange(wide)
            texts = np.where(np.arange(wide) < sizes[own][:, None], data[np.minimum(from_, max(0, len(data) - 1))], 0).astype(np.uint8)
            index = number - (ends - n)[row] + low[row]
            for part, x in zip(parts, _numbers(texts[place], sizes[row], index, at, [s.encode() for s in streams])):
                part.append(x)
        flat = [np.concatenate(p) if p else np.zeros(0) for p in parts]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(f) for f in flat], list(streams)))

    return draws


def drawn(dealt: DataFrame, seed: int, streams: str, keys: list[str], index: str = "sample_idx", rng: str = "xxhash64") -> DataFrame:
    """number(dealt) with, for each one-letter stream, uniform(seed, stream, *keys, index) as _ and its name. md5 goes by arrays of numbers, a fifth of its cost row by row."""
    if rng != "md5":
        return number(dealt, index).withColumns({f"_{s}": uniform(seed, s, *keys, index, rng=rng) for s in streams})
    low = F.explode(F.sequence(F.col("_from"), F.col("_to") - 1, F.lit(SOME).cast("long")))
    parts = dealt.withColumn("_low", low).withColumn("_high", F.least(F.col("_low") + SOME, F.col("_to")))
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(streams[0]), *(F.col(k).cast("string") for k in keys), F.lit(""))
    parts = parts.withColumn("_draws", drawer(seed, streams)(text, F.col("_low"), F.col("_high")))
    each = parts.select(*[c for c in parts.columns if c not in ("_from", "_to", "_high", "_draws")], F.posexplode("_draws").alias("_pos", "_draw"))
    return each.withColumns({index: F.col("_low") + F.col("_pos")} | {f"_{s}": F.col(f"_draw.{s}") for s in streams}).drop("_low", "_pos", "_draw")
