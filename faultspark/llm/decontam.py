"""Benchmark decontamination by canonical templates and literal windows.

Texts become token sequences in two ways. As a template, numbers, names (capitalised words not at a sentence start) and units
after a number are typed placeholders, runs of one kind of placeholder are one, case and other marks are dropped; windows of
WINDOW tokens with at least LITERALS ordinary words count. Literally, every lower-cased word stands for itself and all windows count.
Items are read in three more or less strict ways as templates: with the sentence rule, with a first word that may be a name (the item stands inside a
sentence), and with every capitalised word a name (sentence marks are lost). Windows of documents meet those of the benchmark in a hash join.

Matches of a document and one reading of an item on diagonals less than BAND / 2 apart belong together. An item matches with NEED windows
of a reading, or all that reading has, if these cover half of the reading's windows or if the slots agree: the item's values
stand for one document value each and the other way round, but for a share of 1 - AGREE. So questions with new numbers or
names are found and chance agreement of placeholders is not. Texts shorter than a window are one window of their own length; items
under SHORTEST tokens match literally where they stand alone between sentence marks or line ends.

Before the join, document windows pass a bitmap of the benchmark's hashes with a fixed size; what it lets through in
error falls out of the join.

Cases: null or empty texts have no windows; a null doc_id is reported as null; repeated rows of a document report
once; repeated items each report under their item_id; an empty benchmark flags nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordMemo, blocks, spread, staged, strings, word_codes

WINDOW, LITERALS, NEED, SHORTEST = 8, 5, 6, 4
BAND, AGREE = 16, 0.5
BITMAP_BITS = 24
# fixed values: units of measure that follow a number
UNITS = frozenset(
    "km m cm mm mi ft in yd kg g mg lb lbs oz t l ml cl gal s sec min h hr hrs ms d day days week weeks month months year years hour hours minute minutes second seconds "
    "meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees mph kmh kw kwh w v a hz khz mhz ghz kb mb gb tb j kj cal kcal n pa kpa c f k".split()
)
MARK = "\x01"
_P = np.uint64(0x9E3779B97F4A7C15)
WORD, CAPITAL, NUMBER, UNIT, BREAK = range(5)
LITERAL, RULE, INSIDE, STRIPPED = range(4)  # readings; documents have the first two
_SLOT = {CAPITAL: np.uint64(0xA1), NUMBER: np.uint64(0xB2), UNIT: np.uint64(0xC3)}


def _classes(words: list[str]) -> np.ndarray:
    """Hash of the lower-cased word and its class."""
    out = np.empty((len(words), 2), np.uint64)
    for k, w in enumerate(words):
        low = w.lower()
        kind = BREAK if w == MARK else NUMBER if w[:1].isnumeric() else UNIT if low in UNITS else CAPITAL if len(w) > 1 and w[:1].isupper() and w[1:].islower() else WORD
        out[k] = xxhash.xxh3_64_intdigest(low), kind
    return out


class Templates:
    """Windows of texts: reading, length, text, position, hash, and the slot values of each."""

    def __init__(self):
        self.memo = WordMemo(_classes)

    def tokens(self, texts: pa.Array):
        """text, class, hash of each token, and whether it starts or ends a sentence."""
        t = pc.replace_substring_regex(texts, r"(\p{N})[.,](\p{N})", r"\1_\2")
        t = pc.replace_substring_regex(t, r"(\p{N})(\p{L})", r"\1 \2")
        t = pc.replace_substring_regex(t, r"[.!?:\n\r]+", f" {MARK} ")
        off, codes, words = word_codes(pc.replace_substring_regex(t, f"[^\\p{{L}}\\p{{N}}_{MARK}]+", " "))
        rows = self.memo.of(strings(words))[codes]
        value, kind = rows[:, 0], rows[:, 1].astype(np.int8)
        doc = np.repeat(np.arange(len(texts)), np.diff(off))
        starts, ends = np.ones(len(kind), bool), np.ones(len(kind), bool)
        starts[1:] = (doc[1:] != doc[:-1]) | (kind[:-1] == BREAK)
        ends[:-1] = (doc[1:] != doc[:-1]) | (kind[1:] == BREAK)
        numbered = np.zeros(len(kind), bool)
        numbered[1:] = (kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])
        kind = np.where((kind == UNIT) & ~numbered, WORD, kind)
        keep = kind != BREAK
        return doc[keep], kind[keep], value[keep], starts[keep], ends[keep]

    @staticmethod
    def _collapsed(doc, kind, value):
        """Runs of one kind of placeholder as one token."""
        more = np.zeros(len(kind), bool)
        more[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != WORD) & (doc[1:] == doc[:-1])
        if not more.any():
            return doc, kind, value
        first = np.flatnonzero(~more)
        place = np.arange(len(kind)) - np.repeat(first, np.diff(np.append(first, len(kind))))
        power = np.full(place.max() + 1, _P, np.uint64)
        power[0] = 1
        return doc[first], kind[first], np.add.reduceat(value * np.cumprod(power, dtype=np.uint64)[place], first)

    def windows(self, texts: pa.Array, wanted: list[tuple[int, int]] | None):
        """Windows of the wanted readings and lengths; None: all readings, each text's windows of WINDOW tokens or its one shorter window."""
        doc0, kind0, value0, starts, ends = self.tokens(texts)
        lengths = {r: [n for q, n in wanted if q == r] for r in (LITERAL, RULE)} if wanted is not None else dict.fromkeys(range(4), range(1, WINDOW + 1))
        for reading, sizes in lengths.items():
            if not sizes or not len(doc0):
                continue
            if reading == LITERAL:
                doc, kind, value = doc0, np.full(len(kind0), WORD, np.int8), value0
            else:
                plain = np.zeros(len(kind0), bool) if reading == STRIPPED else starts.copy()
                if reading == INSIDE:
                    plain[1:] &= doc0[1:] == doc0[:-1]
                    plain[0] = False
                doc, kind, value = self._collapsed(doc0, np.where((kind0 == CAPITAL) & plain, WORD, kind0), value0)
            shown = value.copy()
            for k, h in _SLOT.items():
                shown[kind == k] = h
            at = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
            has = np.bincount(doc, minlength=len(texts))
            literal = np.concatenate([[0], np.cumsum(kind == WORD)])
            for n in sizes:
                if len(doc) < n or reading != LITERAL and n < SHORTEST:
                    continue
                h = np.zeros(len(doc) - n + 1, np.uint64)
                for k in range(n):
                    h = h * _P + shown[k : len(doc) - n + 1 + k]
                h = (h ^ (h >> np.uint64(29))) * _P + np.uint64(n + (WINDOW + 1) * (reading == LITERAL))
                h ^= h >> np.uint64(32)
                ok = doc[: len(h)] == doc[n - 1 :]
                if reading != LITERAL:
                    ok &= literal[n:] - literal[:-n] >= min(LITERALS, n - 1)
                elif n < SHORTEST:
                    ok &= starts[: len(h)] & ends[n - 1 :]
                if wanted is None:
                    ok &= np.minimum(has, WINDOW)[doc[: len(h)]] == n
                own = np.flatnonzero(ok)
                yield reading, n, own, doc[own], at[own], h[own].astype(np.int64), kind, value


def _rows(id_col: str, wanted: list[tuple[int, int]] | None, batches, bitmap: np.ndarray | None):
    mask, templates = np.int64((1 << BITMAP_BITS) - 1), Templates()
    for b in batches:
        for start, texts in blocks(b.column("text"), 4 << 20):
            ids = b.column(id_col).slice(start, len(texts))
            for reading, n, own, doc, at, h, kind, value in templates.windows(texts, wanted):
                if bitmap is not None:
                    bit = h & mask
                    hit = np.flatnonzero(bitmap[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
                    own, doc, at, h = own[hit], doc[hit], at[hit], h[hit]
                places = own[:, None] + np.arange(n)
                slot = kind[places] != WORD if len(own) else np.zeros((0, n), bool)
                off = np.concatenate([[0], np.cumsum(slot.sum(1))]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(off), pa.array(value[places][slot].astype(np.int64) if len(own) else np.zeros(0, np.int64)))
                numbers = (pa.array(np.full(len(at), x, np.int32)) for x in (reading, n))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(at, pa.int64()), *numbers, pa.array(h), values], names=[id_col, "pos", "reading", "n", "hash", "slots"])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """One bit for each hash modulo 2^BITMAP_BITS; at most 2^(BITMAP_BITS - 6) words come to the driver."""
    bit = F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1)
    words = hashes.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast((hash & {(1 << BITMAP_BITS) - 1}) % 64 as int))").alias("b"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, same_slots of each document (doc_id, text) that holds an item (item_id, text)."""
    spark: SparkSession = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    schema = "long, pos long, reading int, n int, hash long, slots array<long>"
    asked = staged(items.mapInArrow(lambda it: _rows("item_id", None, it, None), f"item_id {schema}"), "asked")
    wanted = sorted((r["reading"], r["n"]) for r in asked.select(F.least("reading", F.lit(RULE)).alias("reading"), "n").distinct().collect())
    shipped = spark.sparkContext.broadcast(_bitmap(asked.select("hash")))
    found = spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(lambda it: _rows("doc_id", wanted, it, shipped.value), f"doc_id {schema}").drop("reading")
    of_item = asked.select("item_id", "reading", F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"))
    available = asked.groupBy("item_id", "reading").agg(F.countDistinct("pos").alias("has"))
    met = staged(found, "windows").join(of_item, "hash").where(F.size("slots") == F.size("item_slots"))
    pair = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    shift = F.col("pos") - F.col("item_pos")
    bands = F.explode(F.array(F.floor(shift / BAND) * 2, F.floor((shift + BAND // 2) / BAND) * 2 + 1))
    met = met.select("doc_id", "item_id", "reading", "item_pos", pair.alias("pair"), bands.alias("band"))
    grouped = met.groupBy("doc_id", "item_id", "reading", "band").agg(F.count_distinct("item_pos").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("pair"))).alias("pairs"))
    item_values, doc_values = (F.array_distinct(F.transform("pairs", lambda p: p[x])) for x in ("item", "doc"))
    agree = F.least(F.size(item_values), F.size(doc_values)) >= AGREE * F.size("pairs")
    matched = grouped.join(available, ["item_id", "reading"]).where(F.col("n_windows") >= F.least(F.lit(NEED), F.col("has"))).where(agree | (2 * F.col("n_windows") >= F.col("has")))
    same = ~F.exists("pairs", lambda p: p["item"] != p["doc"])
    best = F.max(F.struct("n_windows", same.alias("same")))
    return matched.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", F.col("best.n_windows").alias("n_windows"), F.col("best.same").alias("same_slots"))
