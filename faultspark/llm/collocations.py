"""Phrase collocations by sorted count streams.

1. Every word starts one window, the up to four words from it to its piece's end. A task sorts the windows of a run of text by words and adds up equal ones;
   the run is cut where ranges of windows begin and each cut stretch is shipped packed, its words once. A range's task merges its stretches: in this (prefix) order the
   count of any phrase of one to four words is the sum of a contiguous stretch of windows. Counts under the least are dropped there, but for stretches at a range's edges,
   which are added up between ranges first. All windows of a language together are its number of words.
2. The phrases left are ordered twice, by their words and by their words from the last one. A pass over each order holds the phrases that begin the present one: the first
   gives the counts of all first parts and the best extension to the right, the second those of all last parts and the best extension to the left. Both are joined in lockstep.

Ranges are cut at a sample of windows, so a frequent word or pair is dealt over many ranges; what is counted does not depend on the cuts.

Cases: a null or empty text has no words, a null language counts as 'und'. Long texts make long runs, repeated rows count as often as they stand there; ids are not read, so
null or repeated ids change nothing. Words are bytes between the marks, whatever they are. Phrases of equal score and a go by their bytes. An empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, staged

N = 4
RUN, PART, STEP = 8 << 20, 12 << 20, 256 << 10  # bytes of text in a run, in a range, and for each window of the sample
LEAST, COVER, TOP = 30, 80, 2000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_WORD, _BREAK = re.compile(rb"[^ \t.,;:!?\n-\r]+"), re.compile(rb"[.,;:!?\n-\r]")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array and where each begins (and the last ends)."""
    wide = texts.cast(pa.large_binary())
    off = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if not len(wide) or off[0] == off[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(wide.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def _ordered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's place, from 1, among the distinct ones in byte order; and those."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    return place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def windows(texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The window of every word as N columns of places among the words in order, 0 beyond the piece's end; and the words."""
    raw, off = _bytes(texts)
    kind, docs = _KIND[raw], off[:-1][np.diff(off) > 0]
    is_word = kind == 0
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    begins[docs] = is_word[docs]
    ends[:-1] &= ~is_word[1:]
    last = off[1:][np.diff(off) > 0] - 1
    ends[last] = is_word[last]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    piece = np.cumsum(kind == 2)[at] + np.searchsorted(docs, at, "right")
    flat = _LOWER[raw[is_word]]
    where = np.concatenate([[0], np.cumsum(to - at)]).astype(np.int32)
    place, words = _ordered(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(where), pa.py_buffer(flat)]))
    cols = [place]
    for k in range(1, N):
        col = np.zeros(len(place), np.int64)
        col[:-k] = np.where(piece[k:] == piece[:-k], place[k:], 0)
        cols.append(col)
    return cols, words


def tally(cols: list[np.ndarray], amount: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct windows in order and their amounts."""
    if not len(amount):
        return cols, amount
    many = int(max(c.max() for c in cols)) + 1
    high, low = cols[0] * many + cols[1], cols[2] * many + cols[3]
    order = np.argsort(high * many * many + low, kind="stable") if many**4 < 1 << 63 else np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return [c[order[first]] for c in cols], np.add.reduceat(amount[order], first)


def _cut(cols: list[np.ndarray], words: pa.Array, cut: tuple[bytes, ...]) -> int:
    """Where the first window at or after the cut stands."""
    low, high = 0, len(cols[0])
    for col, w in zip(cols, cut):
        k = bisect.bisect_left(words, w, key=lambda x: x.as_py())
        low, high = low + np.searchsorted(col[low:high], k + 1, "left"), low + np.searchsorted(col[low:high], k + 1, "right")
        if k == len(words) or words[k].as_py() != w:
            break
    return int(low)


def _packed(cols: list[np.ndarray], amount: np.ndarray, words: pa.Array, codec: pa.Codec) -> tuple[bytes, str, int, bytes]:
    used = np.zeros(len(words) + 1, bool)
    for c in cols:
        used[c] = True
    used[0] = False
    new = np.cumsum(used)
    new[0] = 0
    kind = "<u2" if new[-1] < 1 << 16 else "<u4"
    raw = b"".join([np.diff(new[cols[0]], prepend=0).astype(kind).tobytes(), *(new[c].astype(kind).tobytes() for c in cols[1:]), amount.astype("<i8").tobytes()])
    return b"\t".join(words.take(pa.array(np.flatnonzero(used) - 1)).to_pylist()), kind, len(amount), codec.compress(raw, asbytes=True)


def _unpacked(kind: str, n: int, raw: bytes, codec: pa.Codec) -> tuple[list[np.ndarray], np.ndarray]:
    size = int(kind[2])
    whole = codec.decompress(raw, (N * size + 8) * n, asbytes=True)
    cols = [np.frombuffer(whole, kind, n, k * size * n).astype(np.int64) for k in range(N)]
    return [np.cumsum(cols[0]), *cols[1:]], np.frombuffer(whole, "<i8", n, N * size * n)


def _by_language(rows: list[pa.RecordBatch]):
    t = pa.Table.from_batches(rows)
    langs = t.column("lang").combine_chunks().dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, t.column("text").filter(pc.equal(langs.indices, k)).combine_chunks()


def _runs(cuts: list[tuple[bytes, tuple[bytes, ...]]], slots: list[int]):
    """Sorted runs of windows cut at the ranges: slot, part, lang, words, kind, n, raw."""

    def run(batches):
        codec, held, size = pa.Codec("zstd"), [], 0

        def flush():
            for lang, texts in _by_language(held):
                cols, words = windows(texts)
                cols, amount = tally(cols, np.ones(len(cols[0]), np.int64))
                name = lang.encode()
                first = bisect.bisect_left(cuts, (name, ()))
                own = [c for _, c in cuts[first : bisect.bisect_left(cuts, (name + b"\0", ()))]]
                at = [0, *(_cut(cols, words, c) for c in own), len(amount)]
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    if a < b:
                        row = slots[first + k], first + k, lang, *_packed([c[a:b] for c in cols], amount[a:b], words, codec)
                        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["slot", "part", "lang", "words", "kind", "n", "raw"])

        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= RUN:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _phrases(lang: str, stretches: list, least: int) -> pa.RecordBatch:
    """Counts of the phrases of one range: complete ones that reach least, and those at its edges; all words as the phrase of none."""
    place, words = _ordered(pa.concat_arrays([w for w, _, _ in stretches]))
    cols, at = [[] for _ in range(N)], 0
    for w, own, _ in stretches:
        of = np.concatenate([[0], place[at : at + len(w)]])
        at += len(w)
        for c, x in zip(cols, own):
            c.append(of[x])
    cols, amount = tally([np.concatenate(c) for c in cols], np.concatenate([m for _, _, m in stretches]))
    found, lengths, counts, new = [], [0], [int(amount.sum())], np.zeros(len(amount), bool)
    new[0] = True
    for k in range(N):
        new[1:] |= cols[k][1:] != cols[k][:-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(amount, first)
        keep = sums >= least
        keep[[0, -1]] = True
        keep &= cols[k][first] > 0
        found.append(np.stack([c[first[keep]] for c in cols[: k + 1]], 1).ravel() - 1)
        lengths += [k + 1] * int(keep.sum())
        counts += sums[keep].tolist()
    flat = words.take(pa.array(np.concatenate(found))).cast(options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), flat), pa.array(counts, pa.int64())], names=["lang", "words", "n"])


def _merged(least: int):
    def run(batches):
        codec, key, held = pa.Codec("zstd"), None, []
        for b in batches:
            for k in range(len(b)):
                part, lang, words, kind, n, raw = (b.column(c)[k].as_py() for c in ("part", "lang", "words", "kind", "n", "raw"))
                if key is not None and key != (part, lang):
                    yield _phrases(key[1], held, least)
                    held = []
                key = part, lang
                held.append((pa.array(words.split(b"\t"), pa.binary()), *_unpacked(kind, n, raw, codec)))
        if held:
            yield _phrases(key[1], held, least)

    return run


def _sampled(batches):
    """A window for every STEP bytes of text, found without reading what lies between."""
    for b in batches:
        raw, off = _bytes(b.column("text"))
        langs, words, places = [], [], []
        for at in range(min(STEP, len(raw)) // 2, len(raw), STEP):
            doc = int(np.searchsorted(off, at, "right")) - 1
            text = _LOWER[raw[at : min(at + 400, int(off[doc + 1]))]].tobytes()
            found = _WORD.search(text, text.find(b" ") + 1)
            if found:
                langs.append(b.column("lang")[doc].as_py())
                words.append(_BREAK.split(text[found.start() :], maxsplit=1)[0].split()[:N])
                places.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.binary())), pa.array(places, pa.int64())], names=["lang", "words", "at"])


def _spaced(rows: list[tuple], parts: int) -> list[tuple]:
    """At most parts - 1 of the rows, evenly spaced in order."""
    rows = sorted(rows)
    return sorted({rows[len(rows) * k // parts] for k in range(1, parts)}) if rows else []


def _slots(spark, parts: int, partitions: int) -> list[int]:
    """A number for each part that hash partitioning puts in the partition where it belongs: parts in order, as many in each."""
    put = F.pmod(F.hash("id"), F.lit(partitions))
    found = dict(spark.range(40 * partitions).groupBy(put.alias("at")).agg(F.min("id")).collect())
    return [found.get(k * partitions // parts, k) for k in range(parts)]


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words (array), n of every phrase of one to N words found at least `least` times; no words: the number of all words."""
    texts = spread(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    samples = staged(texts.mapInArrow(_sampled, "lang string, words array<binary>, at long"), "samples")
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffled, samples.count() * STEP // PART)
    some = samples.orderBy(F.xxhash64("lang", "words", "at")).limit(64 * parts).collect()
    cuts = _spaced([(r["lang"].encode(), tuple(map(bytes, r["words"]))) for r in some], parts)
    slots = _slots(docs.sparkSession, len(cuts) + 1, shuffled)
    runs = texts.mapInArrow(_runs(cuts, slots), "slot long, part long, lang string, words binary, kind string, n long, raw binary")
    merged = runs.repartition(shuffled, "slot").sortWithinPartitions("part", "lang").mapInArrow(_merged(least), "lang string, words array<string>, n long")
    return staged(merged.groupBy("lang", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.size("words") == 0)), "counts")


def _stream(counts: DataFrame, backward: bool) -> DataFrame:
    """lang, words, n, sides (counts of the first 1, 2, ... words, or the last ones) and best, the greatest count of a phrase with one word more at the end (the beginning)."""
    keyed = counts.where(F.size("words") > 0).select("lang", (F.reverse("words") if backward else F.col("words")).alias("key"), "n")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = keyed.orderBy(F.xxhash64("lang", "key")).limit(64 * parts).collect()
    cuts = _spaced([(r["lang"].encode(), tuple(w.encode("utf-8", "surrogatepass") for w in r["key"])) for r in some], parts)
    wanted = {(lang, key[:k]) for lang, key in cuts for k in range(1, len(key))}  # three for each cut at most
    known = {}
    if wanted:
        asked = counts.sparkSession.createDataFrame([(lang.decode(), [w.decode() for w in key]) for lang, key in sorted(wanted)], "lang string, key array<string>")
        known = {(r["lang"].encode(), tuple(w.encode() for w in r["key"])): r["n"] for r in keyed.join(F.broadcast(asked), ["lang", "key"]).collect()}

    def dealt(batches):
        for b in batches:
            rows = zip(b.column("lang").to_pylist(), b.column("key").to_pylist())
            part = [bisect.bisect_right(cuts, (lang.encode(), tuple(w.encode() for w in key))) for lang, key in rows]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns], names=["part", "lang", "key", "n"])

    def passed(batches):
        part, lang, stack, out = None, None, [], []  # of the stack: key, n, sides, best, own

        def pop():
            key, n, sides, best, own = stack.pop()
            if own or best:
                out.append((lang, key, n if own else None, sides if own else None, best))

        def table():
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            kinds = pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "key", "n", "sides", "best"])

        for b in batches:
            for p, name, key, n in zip(*(b.column(c).to_pylist() for c in ("part", "lang", "key", "n"))):
                if p != part or name != lang:
                    while stack:
                        pop()
                    if p != part and p and cuts[p - 1][0] == name.encode():  # what begins the cut was counted in an earlier range
                        begun = cuts[p - 1][1]
                        for k in range(1, len(begun)):
                            stack.append([[w.decode() for w in begun[:k]], known[cuts[p - 1][0], begun[:k]], [], 0, False])
                    part, lang = p, name
                while stack and stack[-1][0] != key[: len(stack[-1][0])]:
                    pop()
                if stack and len(stack[-1][0]) == len(key) - 1:
                    stack[-1][3] = max(stack[-1][3], n)
                stack.append([key, n, [s[1] for s in stack], 0, True])
            yield table()
        while stack:
            pop()
        yield table()

    rows = keyed.mapInArrow(dealt, "part int, lang string, key array<string>, n long").repartition(parts, "part").sortWithinPartitions("part", "lang", "key")
    both = rows.mapInArrow(passed, "lang string, key array<string>, n long, sides array<long>, best long")
    words = (F.reverse("key") if backward else F.col("key")).alias("words")
    return both.groupBy("lang", words).agg(F.max("n").alias("n"), F.max("sides").alias("sides"), F.max("best").alias("best"))


def collocations(docs: DataFrame, *, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """docs (lang, text): lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    counts = phrase_counts(docs, least)
    before, after = _stream(counts, False), _stream(counts, True).select("lang", "words", F.col("sides").alias("ends"), F.col("best").alias("left_best"))
    both = before.join(after.hint("merge"), ["lang", "words"]).where(F.size("words") > 1)
    exact = "cast({} as decimal(20, 0))".format
    open_ = both.where(f"cast(100 as decimal(3, 0)) * {exact('greatest(best, left_best)')} < cast({int(cover)} as decimal(3, 0)) * {exact('n')}")
    left, right = "sides[k - 1]", "ends[size(words) - k - 1]"
    score = f"(cast(2000000 as decimal(7, 0)) * {exact('n')}) div ({exact(left)} + {exact(right)})"
    best = F.expr(f"array_min(transform(sequence(1, size(words) - 1), k -> struct({score} as score, k as k, {left} as l, {right} as r)))")
    scored = open_.withColumn("_b", best).select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("n").alias("a"), F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), F.col("_b.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = scored.withColumn("rank", place).where(F.col("rank") <= top)
    totals = counts.where(F.size("words") == 0).select("lang", "n")
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
