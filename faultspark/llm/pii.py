"""Personal data: seed patterns and bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are the matches of four regular expressions. Every seed and every other token with a digit or an
at sign is an occurrence of a value in lexical contexts (the two words before it; the word before and
the word after; words that begin over REACH code points away are not seen). Contexts and values form a graph. In each
round a context scores, by kind, the share of its distinct values that are known; contexts with at least SUPPORT
known values and a share of at least CONFIDENCE are taken, and values get the chance that one of their contexts is
right; values that reach PROMOTE become known. Rounds go on until what is known stays the same (or comes back in a
cycle). What is known at the end and was no seed adds spans where it occurs.

The regular expressions are written so that a Java matcher never retries inside a run it has seen
(possessive, anchored at the start of a run); tests/llm compares them with the plain forms.

Cases: null or empty text has no spans and the digest of the empty string; equal starts sort by kind,
then end; repeated rows, repeated and null ids each get the spans of their own text; added spans never overlap base ones;
very long texts are searched whole, in time that goes with their length (matches, overlaps and surroundings never start again at the text's begin); an empty table gives no rows; redact keeps all columns, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, PROMOTE = 4, 0.8, 0.8
REACH = 64  # code points searched for the words around a value
CHUNK, BLOCK = 256, 256  # code points of a piece of text (REACH at least), items of a block of running states
# fixed values: the four kinds' patterns, and a token with a digit or at sign
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    rev = F.reverse(_digits(c))
    twice = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.sequence(F.lit(1), F.length(rev)), lambda i: twice(F.substring(rev, i, F.lit(1)).cast("int"), i - 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, c: Column) -> Column:
    n = F.length(_digits(c))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(c, r"\."), lambda p: p.try_cast("double") <= 255),
        "card": F.when((n >= 14) & (n <= 19), _luhn(c)).otherwise(False),
        "phone": (n >= 10) & (n <= 15),
    }[kind]


def _once(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, first: Column, step) -> Column:
    """The states that step(state, item) makes along items, from the state first; in blocks, as an array that grows by one item at a time is copied each time."""
    last = lambda states: F.element_at(states, -1)

    def states(own: Column) -> Column:
        of_block = lambda state, i: F.aggregate(F.slice(own, i * BLOCK + 1, BLOCK), F.array(state), lambda a, x: F.array_append(a, step(last(a), x)))
        n = F.ceil(F.size(own) / BLOCK).cast("int")
        blocks = F.aggregate(F.sequence(F.lit(0), n - 1), F.array(F.array(first)), lambda a, i: F.array_append(a, of_block(last(last(a)), i)))
        return F.when(n > 0, F.flatten(F.transform(blocks, lambda b: F.slice(b, F.lit(2), F.size(b) - 1)))).otherwise(F.slice(F.array(first), 1, 0))

    return _once(items, states)


def _below(spans: Column, field: str, limit: Column) -> Column:
    """How many of the spans, whose field rises, have it below limit: by halves."""
    halves = F.transform(F.sequence(F.ceil(F.log2(F.size(spans) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(halves, F.lit(0), lambda at, p: F.when(F.get(spans, at + p - 1)[field] < limit, at + p).otherwise(at))


def _chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points: what reads near a place takes it from there, not from the text's start."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))


def _matches(text: Column, pattern: str, guard: Column) -> Column:
    """start, end and value of each match, as an array; code points from 0."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    kind = "struct<start:int,end:int,value:string>"

    def step(before: Column, x: Column) -> Column:
        start = before["end"] + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

    found = _running(F.filter(pairs, lambda x: x["value"].isNotNull()), F.struct(F.lit(0), F.lit(0), F.lit("")).cast(kind), step)
    return F.when(guard, found).otherwise(F.array().cast(f"array<{kind}>"))


def base_spans(text: Column) -> Column:
    """array of start, rank, end, kind, value of the valid base matches, sorted."""
    guards = {"email": (EMAIL, F.contains(text, F.lit("@"))), "ip": (IP, text.rlike(r"[0-9]\.[0-9]")), "card": (CARD, text.rlike(CARD)), "phone": (PHONE, F.contains(text, F.lit("+")))}

    def of(rank: int, kind: str) -> Column:
        valid = F.filter(_matches(text, *guards[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))

    return F.array_sort(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def _occurrences(text: Column, base: Column, kinds: Column) -> Column:
    """Base spans (kinds has them by kind) and the other tokens with a digit or at sign: start, end, value, kind (null unless base)."""
    of_base = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["kind"].alias("kind")))
    tidy = F.transform(_matches(text, TOKEN, text.rlike("[0-9@]")), lambda m: F.struct(m["start"].alias("start"), F.regexp_replace(m["value"], r"\p{Punct}++$", "").alias("value")))
    tokens = F.transform(tidy, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"), F.lit(None).cast("string").alias("kind")))
    # spans of one kind rise and do not overlap: the last that begins before a token's end tells
    met = lambda spans, m: F.coalesce(F.get(spans, _below(spans, "start", m["end"]) - 1)["end"] > m["start"], F.lit(False))
    return F.concat(of_base, F.filter(tokens, lambda m: ~reduce(or_, (met(F.get(kinds, i), m) for i in range(len(KINDS))))))


def _contexts(chunks: Column, start: Column, end: Column) -> Column:
    words = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\S++"), F.lit(0)), lambda w: F.lower(F.regexp_replace(w, r"^\p{Punct}++|(?<=\w)\p{Punct}++$", "")))
    near = F.greatest(start - REACH, F.lit(0))
    at = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    two_at = lambda place: F.concat(at((place / CHUNK).cast("int")), at((place / CHUNK).cast("int") + 1))
    before, behind = (F.substring(two_at(place), place % CHUNK + 1, n) for place, n in ((near, start - near), (end, F.lit(REACH))))
    left = words(F.when(near > 0, F.regexp_replace(before, r"^\S*+", "")).otherwise(before))  # without a word that is cut
    right = words(F.when(F.length(behind) == REACH, F.regexp_replace(behind, r"(?<!\S)\S++$", "")).otherwise(behind))
    two = F.array_join(F.slice(left, -2, 2), " ")
    one, after = F.try_element_at(left, F.lit(-1)), F.try_element_at(right, F.lit(1))
    both = F.concat(F.lit("<"), one, F.lit("> "), F.coalesce(after, F.lit("")))
    return F.when(F.size(left) >= 2, F.array(two, both)).otherwise(F.array().cast("array<string>"))


def _learned(occurrences: DataFrame) -> DataFrame:
    """value and kind of what the contexts taught; occurrences has value, kind and contexts."""
    edges = staged(occurrences.select("value", F.explode("contexts").alias("context")).distinct(), "edges")
    seeds = occurrences.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")).select("value", "kind", F.lit(1.0).alias("score"))
    known = seeds = staged(seeds, "seeds")
    per_context = staged(edges.groupBy("context").agg(F.count("*").alias("total")), "totals")
    passed: list[tuple] = []
    while True:
        hits = edges.join(known, "value").groupBy("context", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("mass"))
        taken = staged(hits.where(F.col("n") >= SUPPORT).join(per_context, "context").withColumn("share", F.col("mass") / F.col("total")).where(F.col("share") >= CONFIDENCE).select("context", "kind", "share"), "taken")
        if not passed and taken.isEmpty():
            break
        miss = F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-6))))
        scored = edges.join(taken, "context").groupBy("value", "kind").agg((1 - F.exp(miss)).alias("score")).where(F.col("score") >= PROMOTE)
        best = scored.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
        known = staged(seeds.unionByName(best.join(seeds, "value", "left_anti")), "known")
        state = tuple(known.agg(F.count("*"), F.sum(F.xxhash64("value", "kind").cast("decimal(38,0)"))).first())
        if state in passed:
            break
        passed.append(state)
    return known.join(seeds, "value", "left_anti").select("value", "kind")


def scanned(docs: DataFrame, with_doc: tuple[str, ...]) -> DataFrame:
    """row, base, occurrences with contexts and the named columns of docs as `doc`, written once: the texts are searched a single time."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in with_doc)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = whole.withColumn("base", base_spans(F.col("text")))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    found = found.withColumn("kinds", F.array(*map(of_kind, KINDS)))
    found = found.withColumn("found", _occurrences(F.col("text"), F.col("base"), F.col("kinds"))).withColumn("chunks", _chunks(F.col("text")))
    placed = F.transform("found", lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), o["value"].alias("value"), o["kind"].alias("kind"), _contexts(F.col("chunks"), o["start"], o["end"]).alias("contexts")))
    return staged(found.select("doc", F.monotonically_increasing_id().alias("row"), "base", placed.alias("found")), "scanned")


def added_spans(scan: DataFrame) -> DataFrame:
    """row and the added spans of rows that get any."""
    each = scan.select("row", F.explode("found").alias("o")).select("row", "o.*")
    learned = _learned(each)
    rank = F.array_position(F.lit(list(KINDS)), F.col("known")) - 1
    hits = each.where("kind is null").join(learned.withColumnRenamed("kind", "known"), "value")
    span = F.struct("start", rank.cast("int").alias("rank"), "end", F.col("known").alias("kind"), "value")
    return staged(hits.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("added")), "added")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_added."""
    scan = scanned(docs.select(F.col("doc_id").cast("long"), "text"), with_doc=("doc_id",))
    spans = scan.select("row", "doc.doc_id", "base").join(added_spans(scan), "row", "left")
    more = F.coalesce("added", F.slice("base", 1, 0))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets, row by row."""
    scan = scanned(docs, tuple(docs.columns))
    joined = scan.select("row", "doc", "base").join(added_spans(scan), "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.slice("base", 1, 0))))
    kind = "struct<at:int,keep:boolean,start:int,end:int,kind:string>"

    def first_come(before: Column, x: Column) -> Column:
        return F.struct(F.greatest(before["at"], x["end"]).alias("at"), (x["start"] >= before["at"]).alias("keep"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))

    def said(chunk: Column, i: Column) -> Column:
        """The chunk with the labels of spans that begin in it and without what spans cover."""
        low, high = i * CHUNK, i * CHUNK + F.length(chunk)
        passed = _below(F.col("_kept"), "end", low + 1)

        def step(acc: Column, x: Column) -> Column:
            gap = F.substring(chunk, acc["at"] - low + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
            label = F.when(x["start"] >= low, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
            return F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, label).alias("out"))

        cut = lambda acc: F.concat(acc["out"], F.substring(chunk, acc["at"] - low + 1, F.greatest(high - acc["at"], F.lit(0))))
        here = F.slice(F.col("_kept"), passed + 1, _below(F.col("_kept"), "start", high) - passed)
        return F.aggregate(here, F.struct(low.alias("at"), F.lit("").alias("out")), step, cut)

    kept = F.filter(_running(F.col("_spans"), F.struct(F.lit(0), F.lit(False), F.lit(0), F.lit(0), F.lit("")).cast(kind), first_come), lambda x: x["keep"])
    cut = joined.withColumn("_spans", spans).withColumn("_kept", kept).withColumn("_chunks", _chunks(F.col("doc.text")))
    text = F.when(F.size("_kept") > 0, F.array_join(F.transform("_chunks", said), "")).otherwise(F.col("doc.text"))
    return cut.select(*(text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))
