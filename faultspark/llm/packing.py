"""Packing by length patterns: non-negative least squares, rounding, best fit for the rest.

Documents become ids; longer ones are cut into pieces of `size`. From the histogram of piece lengths
(at most `size` numbers, whatever the corpus) the driver plans whole groups at a time: lengths fall in
classes of width size/CLASSES, rounded up; all patterns of up to FEW classes that fill a sequence are
enumerated; non-negative least squares fits how often each repeats so that their sum meets the
histogram; repeat counts are rounded down (in full and at
smaller parts of the fit, of which the best plan is taken); what is left, and the gaps that rounding lengths up left
in the patterns, are packed best fit, longest first. The plan is a list of runs (length, first rank, count, first
sequence, offset), bounded by the histogram and never by the corpus. Spark ranks the pieces of each length in
two steps (counts by salt, then positions within a salt), so one common length is never in one task,
and each piece finds its run by binary search.

Cases: null or empty text is one piece with the end id; repeated rows are packed each on its own;
equal lengths are interchangeable, ties are by salt, doc_id and piece; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crcs, spread, staged
from .tokens import encoder, vocabulary_path

SIZE = 4096
CLASSES = 128
FEW = 4
PARTS = (1.0, 0.75, 0.5, 0.25)  # of the fitted repeats that are kept; the plan with the fewest sequences wins
MOST_RUNS = 4_000_000  # 40 bytes each; the histogram keeps plans far below it


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, *, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of docs (doc_id, text)."""
    path = tokenizer or vocabulary_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        with encoder(path) as own:
            for b in batches:
                for row, ids, off in own.flat_blocks(b.column("text")):
                    n = np.diff(off)
                    per = -(-n // size)
                    doc = np.repeat(np.arange(len(n)), per)
                    piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                    start = piece * size
                    length = np.minimum(size, n[doc] - start)
                    at = off[doc] + start
                    cols = {"doc_id": b.column("doc_id").take(pa.array(row + doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crcs(ids, at, at + length))}
                    if with_ids:
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(cols)

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, schema)


def patterns(present: np.ndarray, total: int = CLASSES, few: int = FEW) -> np.ndarray:
    """Count vectors (rows) of all multisets of up to `few` of the classes 1..total present with sum `total`."""
    ok = np.zeros(total + 1, bool)
    ok[present] = True
    found: list[list[int]] = []

    def extend(left: int, most: int, chosen: list[int]) -> None:
        if left == 0:
            found.append(chosen)
            return
        room = few - len(chosen)
        if room == 0:
            return
        for c in range(min(most, left), -(-left // room) - 1, -1):
            if ok[c]:
                extend(left - c, c, [*chosen, c])

    extend(total, total, [])
    out = np.zeros((len(found), total + 1), np.float64)
    for row, chosen in zip(out, found):
        np.add.at(row, chosen, 1)
    return out[:, 1:]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with x >= 0 by active sets: the column that gains most enters, those that turn negative leave."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, np.abs(b).max())
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        best = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[best] <= 1e-9 * scale:
            break
        used[best] = True
        while used.any():
            on = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[on] = s
                break
            low = s <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - s[low], 1e-300))
            x[on] += step * (s - x[on])
            drop = on[(x[on] <= 1e-12 * scale) & low]
            drop = drop if len(drop) else on[[int(np.argmin(s))]]
            x[drop], used[drop] = 0, False
    return x


class Plan:
    """Runs of pieces and the free places of the sequences opened so far."""

    def __init__(self, size: int):
        self.size, self.sequences = size, 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.taken: dict[int, int] = defaultdict(int)
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, count)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], count, sequence, offset))
        self.taken[length] += count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            self.free[room].append((sequence, count))


def _by_patterns(plan: Plan, left: dict[int, int], part: float) -> None:
    width = -(-plan.size // CLASSES)
    classes: dict[int, list[int]] = defaultdict(list)
    counts = np.zeros(CLASSES)
    for length in sorted(left, reverse=True):
        classes[-(-length // width)].append(length)
        counts[-(-length // width) - 1] += left[length]
    a = patterns(np.array(sorted(classes), int))
    if not len(a):
        return
    repeats = np.floor(part * nnls(a.T, counts) + 1e-9).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        want = int(repeats[k])
        slots = [int(c) + 1 for c in np.repeat(np.arange(CLASSES), a[k].astype(int))][::-1]
        while want:
            chosen = []
            for c in slots:  # of each class, the longest that the pattern's other places leave over
                use = next((x for x in classes[c] if left[x] > chosen.count(x)), None)
                if use is None:
                    break
                chosen.append(use)
            if len(chosen) < len(slots):
                break
            n = min([want, *(left[x] // chosen.count(x) for x in chosen)])
            first, offset = plan.open(n), 0
            for x in chosen:
                plan.put(x, n, first, offset)
                left[x] -= n
                offset += x
            plan.leave(plan.size - offset, first, n)
            want -= n


def _best_fit(plan: Plan, left: dict[int, int]) -> None:
    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        while n:
            room = min((r for r in plan.free if r >= length and plan.free[r]), default=None)
            if room is not None:
                first, count = plan.free[room].pop()
                use = min(n, count)
                plan.put(length, use, first, plan.size - room)
                plan.leave(room, first + use, count - use)
                plan.leave(room - length, first, use)
                n -= use
                continue
            per = plan.size // length
            whole, rest = divmod(n, per)
            for use, each in ((whole, per), (1, rest)):
                if use and each:
                    first = plan.open(use)
                    for k in range(each):
                        plan.put(length, use, first, k * length)
                    plan.leave(plan.size - each * length, first, use)
            n = 0
        left[length] = 0


def plan_runs(histogram: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Runs sorted by length and first rank, and how many sequences they fill."""
    plan = None
    for part in PARTS:
        own, left = Plan(size), dict(histogram)
        _by_patterns(own, left, part)
        _best_fit(own, left)
        plan = own if plan is None or own.sequences < plan.sequences else plan
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    if len(runs) > MOST_RUNS:
        raise ValueError(f"a plan of {len(runs)} runs is larger than {MOST_RUNS}")
    return runs, plan.sequences


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut: rows with doc_id, piece and length (1 to size); adds sequence_id and offset.

    A column _salt (small numbers, written to a table) may say how rows of one length are dealt out; else the ids do.
    """
    spark = cut.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_runs(histogram, size)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut if "_salt" in cut.columns else cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_base", "_salt")
    shipped = spark.sparkContext.broadcast(runs)
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches):
        own = shipped.value
        keys = own[:, 0] * (1 << 48) + own[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1
            cols = [b.column(c) for c in names] + [pa.array(own[at, 3] + rank - own[at, 1]), pa.array(own[at, 4])]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")  # rows of one null or repeated id spread too
    out = pack(staged(pieces(docs, size).withColumn("_salt", salt), "pieces"), size)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
