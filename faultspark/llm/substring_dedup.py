"""Substring deduplication by hashing lines, and the content-defined units of long ones.

Lines are cut into units. A line starts a unit, and so does every word of it with the least rank in some
window of WINDOW words: words after a sentence mark rank first, then the hash of the word and the AHEAD next decides.
A unit is compared by the digest of its lower-cased words, and of words of its line behind it up to LOOK in all, so
that equal lines have equal units and so have equal passages inside other lines, wherever they stand: of a passage of n
words at least n - AHEAD - 2 * WINDOW words lie in common units. Digests are grouped over the whole corpus; of each, the
occurrence ranked first (doc_id, row, unit) stays. Runs of neighbouring units that are later occurrences are spans to remove,
if they hold a whole line, of whatever length, or at least `passage` words that are kept in one document. repeated_lines goes by whole lines alone. Offsets are code points of the original text.

Cases: null or empty text has no units; null doc_ids rank last and come back as null; repeated rows and repeated doc_ids
count as later copies, told apart by their row; a long text is cut like any other; an empty table gives no spans; other
columns are left alone (remove_repeats keeps them).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordMemo, blocks, spread, staged, strings

WINDOW, AHEAD, LOOK = 16, 2, 8
PASSAGE = 51 - AHEAD - 2 * WINDOW  # words that a repeated passage of over 50 words has in common units at least
_SPACES = np.array([c for c in range(sys.maxunicode + 1) if chr(c).isspace()], np.uint32)
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSE = np.array([pow(int(p), -1, 1 << 64) for p in _P], np.uint64)
_ROW = "doc_id long, row long, unit int, start int, end int, words int, span int, opens boolean, closes boolean, d1 long, d2 int"


def _digests(words: list[str]) -> np.ndarray:
    """Two hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _P[1]
    return h ^ (h >> np.uint64(32))


class Units:
    """Units of texts and their digests."""

    def __init__(self):
        self.memo = WordMemo(_digests)

    def of(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """text, unit, start, end, own words, compared words, whether it opens and closes its line, two digests: of each unit."""
        text_all = "\n".join(texts)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        points = np.frombuffer(text_all.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], ~np.isin(points, _SPACES), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        n = len(begin)
        if not n:
            return (np.zeros(0, np.int64),) * 10
        hashes = self.memo.of(text_all.lower().split())
        line = np.concatenate([[0], np.cumsum(points == 10)])[begin]
        opens = np.append(True, line[1:] != line[:-1])
        cut = opens | self._least(line, opens | np.append(True, np.isin(points[end[:-1] - 1], (33, 46, 63))), hashes[:, 0])
        first = np.flatnonzero(cut)
        stop = np.append(first[1:], n)
        last_of_line = np.searchsorted(line, line[first], "right")
        upto = np.minimum(np.maximum(stop, first + LOOK), last_of_line)
        both = []
        for k in range(2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, k] * _powers(_P[k], n), dtype=np.uint64)])
            h = (sums[upto] - sums[first]) * _powers(_INVERSE[k], n)[first]
            both.append(_mixed(h + ((stop - first) << 32 | (upto - first)).astype(np.uint64)).view(np.int64))
        text = np.searchsorted(at, begin[first], "right") - 1
        unit = np.arange(len(first)) - np.searchsorted(text, text)
        return text, unit, begin[first] - at[text], end[upto - 1] - at[text], stop - first, upto - first, opens[first], stop == last_of_line, both[0], (both[1] >> 32).astype(np.int32)

    def lines(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """text, line, start, end, words, two digests: of each line that has words."""
        text_all = "\n".join(texts)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        points = np.frombuffer(text_all.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], ~np.isin(points, _SPACES), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end, n = edges[::2], edges[1::2], len(edges) // 2
        if not n:
            return (np.zeros(0, np.int64),) * 7
        hashes, feeds = self.memo.of(text_all.lower().split()), np.concatenate([[0], np.cumsum(points == 10)])
        line = feeds[begin]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        stop = np.append(first[1:], n)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, k] * _powers(_P[k], n), dtype=np.uint64)]) for k in range(2)]
        both = [_mixed((s[stop] - s[first]) * _powers(_INVERSE[k], n)[first] + (stop - first).astype(np.uint64)).view(np.int64) for k, s in enumerate(sums)]
        text = np.searchsorted(at, begin[first], "right") - 1
        return text, line[first] - feeds[at[text]], begin[first] - at[text], end[stop - 1] - at[text], stop - first, *both

    @staticmethod
    def _least(line: np.ndarray, starts: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Words that have the least rank in some window of their line."""
        ahead, n = h.copy(), len(h)
        for k in range(1, AHEAD + 1):
            ahead *= _P[0]
            ahead[:-k] += np.where(line[k:] == line[:-k], h[k:], np.uint64(0))
        rank = np.where(starts, np.uint64(0), np.uint64(1) << np.uint64(63)) | _mixed(ahead) >> np.uint64(1)
        out = np.zeros(n, bool)
        if n >= WINDOW:
            own = np.flatnonzero(line[WINDOW - 1 :] == line[: n - WINDOW + 1])
            for k in range(0, len(own), 1 << 16):
                at = own[k : k + (1 << 16)]
                out[at + np.lib.stride_tricks.sliding_window_view(rank, WINDOW)[at].argmin(1)] = True
        return out


def _unit_rows(with_row: bool):
    def run(batches):
        from pyspark import TaskContext

        row, own = TaskContext.get().partitionId() << 33, Units()
        kinds = [pa.int32()] * 5 + [pa.bool_(), pa.bool_(), pa.int64(), pa.int32()]
        for b in batches:
            for k, texts in blocks(b.column("text")):
                of, *cols = own.of(strings(texts))
                cols = [pa.array(c, t) for c, t in zip(cols, kinds)]
                at = pa.array(k + of)
                rows = b.column("row").take(at) if with_row else pa.array(row + of, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), rows, *cols], names=[c.split()[0] for c in _ROW.split(", ")])
                row += len(texts)

    return run


def repeated_spans(docs: DataFrame, *, min_words: int = 1, passage: int = LOOK, row: str | None = None) -> DataFrame:
    """Spans to remove from docs (doc_id, text): doc_id, row, start, end, n_words, n_units, longest, kept_doc_id, is_passage (1 if longest reaches `passage`).

    longest: words of the longest stretch of the span whose first occurrences are in one document, kept_doc_id. Spans that hold no whole line are left out if they have
    fewer than `passage` words there, others if the span has fewer than min_words. row: a column of docs that numbers its rows, else they are numbered here.
    """
    asked = docs.select(F.col("doc_id").cast("long"), "text", *([F.col(row).cast("long").alias("row")] if row else []))
    found = staged(spread(asked).mapInArrow(_unit_rows(row is not None), _ROW), "units")
    by = ["d1", "d2"]
    first = staged(found.groupBy(*by).agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    met = staged(found.join(first, by), "met")
    own = met.where(F.col("doc_id").eqNullSafe(F.col("kept")))  # in the document that is kept: one of them is the first
    lead = own.groupBy(*by).agg(F.min(F.struct("row", "unit")).alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = own.join(lead, by).where((F.col("row") != F.col("lead.row")) | (F.col("unit") != F.col("lead.unit"))).select(*met.columns)
    later = met.where(~F.col("doc_id").eqNullSafe(F.col("kept"))).unionByName(again)
    order = Window.partitionBy("row").orderBy("unit")
    apart = F.coalesce(F.col("unit") != F.lag("unit").over(order) + 1, F.lit(True))
    other = apart | ~F.col("kept").eqNullSafe(F.lag("kept").over(order))
    marked = later.withColumns({"_apart": apart.cast("int"), "_other": other.cast("int")})
    marked = marked.withColumns({"run": F.sum("_apart").over(order), "stretch": F.sum("_other").over(order)})
    words = F.sum("words") + F.max_by("span", "unit") - F.max_by("words", "unit")
    stretches = marked.groupBy("row", "run", "stretch").agg(
        F.first("doc_id").alias("doc_id"), F.first("kept").alias("kept"), F.min("start").alias("start"), F.max("end").alias("end"), words.alias("longest"),
        F.sum("words").alias("words"), F.max_by(F.col("span") - F.col("words"), "unit").alias("beyond"), F.count("*").alias("n_units"), F.min(F.when(F.col("opens"), F.col("unit"))).alias("opened"), F.max(F.when(F.col("closes"), F.col("unit"))).alias("closed"),
    )
    spans = stretches.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("words") + F.max_by("beyond", "stretch")).alias("n_words"), F.sum("n_units").alias("n_units"),
        F.max("longest").alias("longest"), F.coalesce(F.min("opened") <= F.max("closed"), F.lit(False)).alias("whole"), F.max_by("kept", F.struct("longest", -F.col("stretch"))).alias("kept_doc_id"),
    )
    enough = F.when(F.col("whole"), F.col("n_words") >= min_words).otherwise(F.col("longest") >= max(min_words, passage))
    return spans.where(enough).select("doc_id", "row", "start", "end", "n_words", "n_units", "longest", "kept_doc_id", (F.col("longest") >= passage).cast("int").alias("is_passage"))


def _line_rows(batches):
    from pyspark import TaskContext

    row, own = TaskContext.get().partitionId() << 33, Units()
    for b in batches:
        for k, texts in blocks(b.column("text")):
            of, *cols = own.lines(strings(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(k + of)), pa.array(row + of, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "row", "line", "start", "end", "n_words", "d1", "d2"])
            row += len(texts)


def repeated_lines(docs: DataFrame, *, min_words: int = 1) -> DataFrame:
    """Whole lines of docs (doc_id, text) that stand earlier too: doc_id, row, line, start, end, n_words, kept_doc_id, kept_line.

    Lines are parts between line feeds, equal if their lower-cased words are; the first by doc_id (nulls last), row and line stays. line counts all lines of the text from 0, empty ones too.
    """
    found = staged(spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(_line_rows, "doc_id long, row long, line long, start long, end long, n_words long, d1 long, d2 long").where(F.col("n_words") >= min_words), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "line")
    first = found.groupBy("d1", "d2").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = found.join(staged(first, "firsts"), ["d1", "d2"]).where((F.col("row") != F.col("_first.row")) | (F.col("line") != F.col("_first.line")))
    return later.select("doc_id", "row", "line", "start", "end", "n_words", F.col("_first.doc_id").alias("kept_doc_id"), F.col("_first.line").alias("kept_line"))


def remove_spans(docs: DataFrame, spans: DataFrame, on: str = "doc_id") -> DataFrame:
    """docs with the spans cut out of text. Rows are matched by `on`, whose values must be unique in docs; rows without one are left alone."""
    cuts = spans.where(F.col(on).isNotNull()).groupBy(on).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_cuts"))
    gap = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def cut(acc, x):
        more = F.when(x["start"] > acc["at"], F.substring("text", acc["at"] + 1, x["start"] - acc["at"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["kept"], more).alias("kept"))

    left = F.aggregate("_cuts", gap, cut)
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.concat("_left.kept", F.expr("substring(text, _left.at + 1)")))
    return docs.join(cuts, on, "left").withColumn("_left", left).withColumn("text", text).select(*docs.columns)


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs without what repeats: every row loses its own spans, whatever its doc_id; rows are numbered and written once."""
    numbered = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    spans = repeated_spans(numbered, row="_row", **how).withColumnRenamed("row", "_row")
    return remove_spans(numbered, spans, "_row").select(*docs.columns)
