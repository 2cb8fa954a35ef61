"""Finite-fault text files (.fsp) as events, segments and subfaults, read and written. One row a file; all in column functions; reading needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATES = ("MM/dd/yyyy", "M/d/yyyy", "yyyy/MM/dd", "yyyy/M/d", "dd/MM/yyyy", "d/M/yyyy")
DATE = r"(\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{4})"
TABLE = r"(?i)^%\s*LAT\s+LON\b"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and lines of every file under path."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))


def _first(pattern: str) -> Column:
    return F.try_element_at(F.filter("lines", lambda x: x.rlike(pattern)), F.lit(1))


def _number(line: Column, name: str) -> Column:
    return F.regexp_extract(line, rf"(?i)\b{name}\s*=\s*(\S+)", 1).try_cast("double")


def _date(text: Column) -> Column:
    plain = F.replace(text, F.lit("-"), F.lit("/"))
    return F.coalesce(*(F.try_to_date(plain, f) for f in DATES))


def _error(bad: Column, ok: Column, message: str, mode: str, kind: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast(kind)).otherwise(ok) if mode == "raise" else F.when(~bad, ok)


def parse_event_line(line: Column) -> dict[str, Column]:
    """event, date text and reference of an event line's payload."""
    payload = F.regexp_replace(F.regexp_extract(line, r"^[^:]*:(.*)$", 1), r"\s+", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(payload, r"\[[^\]]*\]", ""), r"[()]", ""))
    date = F.regexp_extract(bare, DATE, 1)
    name = F.regexp_replace(F.trim(F.regexp_replace(bare, DATE + r".*$", "")), r"[,\s-]+$", "")
    return {"event": name, "date": F.when(date != "", date), "reference": F.trim(F.regexp_extract(payload, r"\[([^\]]*)\]", 1))}


def parse_data_counts() -> Column:
    """Labels of the first data line with the counts of the next line, to the shorter of the two."""
    tokens = lambda c: F.split(F.trim(F.regexp_extract(c, r":(.*)$", 1)), r"\s+")
    at = F.array_position(F.transform("lines", lambda x: x.rlike(r"^%\s*Data\b")), F.lit(True)).cast("int")
    labels, after = F.try_element_at("lines", at), F.try_element_at("lines", at + 1)
    counts = F.filter(F.transform(tokens(after), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    names = F.filter(tokens(labels), lambda x: x != "")
    n = F.least(F.size(names), F.size(counts))
    return F.when((at > 0) & after.rlike(r"^%\s*(Data|NoS)"), F.map_from_arrays(F.slice(names, 1, n), F.slice(counts, 1, n)))


def parse_events(lines: DataFrame, mode: str = "raise") -> DataFrame:
    """One row a file. mode='raise' fails on a file without a date; 'null' leaves the date null (see bad_files)."""
    loc, size, mech, event = _first(r"^%\s*Loc\b"), _first(r"^%\s*Size\b"), _first(r"^%\s*Mech\b"), parse_event_line(_first(r"^%\s*Event\s*:"))
    step, tag = _first(r"^%\s*Invs.*Dx.*Dz"), F.trim(F.regexp_extract(_first(r"^%\s*EventTAG"), r":(.*)$", 1))
    parsed = _date(event["date"])
    usgs = F.exists("lines", lambda x: x.contains("USGS"))
    third = F.trim(F.regexp_replace(F.try_element_at("lines", F.lit(3)), r"^%\s*", ""))
    return lines.select(
        "file", "lines", tag.alias("event_id"), _number(loc, "LAT").alias("lat"), _number(loc, "LON").alias("long"), _number(loc, "DEP").alias("depth"),
        F.try_element_at(F.split(size, r"\s+"), F.lit(14)).try_cast("double").alias("mw"), _number(_first(r"^%\s*Invs.*Nsg"), "Nsg").cast("int").alias("nsg"),
        _number(step, "Dx").alias("size_len"), _number(step, "Dz").alias("size_wid"), event["event"].alias("event"), event["date"].alias("date"),
        _error(parsed.isNull(), parsed, "an event line has no date", mode, "date").alias("date_parsed"), event["reference"].alias("reference"),
        F.when(usgs, third).otherwise("SRCMOD").alias("webpage"), F.lit("USGS").alias("inv_auth"), _number(mech, "STRK").alias("global_strike"), _number(mech, "DIP").alias("global_dip"), parse_data_counts().alias("data"),
    )


def parse_segments(events: DataFrame, mode: str = "raise") -> DataFrame:
    """One row a segment with its own lines: strike, dip and size from them, the file's, or LEN and WID; an error without a size."""
    numbered = F.transform("lines", lambda x, i: F.when(x.rlike(r"^%\s*SEGMENT"), i))
    heads = F.filter(numbered, lambda i: i.isNotNull())
    starts = F.when(F.size(heads) > 0, heads).otherwise(F.array(F.lit(0)))
    each = events.withColumn("_starts", starts).withColumn("_many", F.size(heads) > 0).select("*", F.posexplode("_starts").alias("segment_id", "_at"))
    to = F.coalesce(F.try_element_at("_starts", F.col("segment_id") + 2), F.size("lines"))
    each = each.withColumn("own", F.slice("lines", F.col("_at") + 1, to - F.col("_at")))
    own = lambda p: F.try_element_at(F.filter("own", lambda x: x.rlike(p)), F.lit(1))
    head, step, lens = F.element_at("own", 1), own(r"Dx\s*=.*Dz\s*="), own(r"LEN\s*=.*WID\s*=")
    many = F.col("_many")
    length = F.coalesce(_number(step, "Dx"), F.col("size_len"), F.when(many, _number(lens, "LEN")))
    width = F.coalesce(_number(step, "Dz"), F.col("size_wid"), F.when(many, _number(lens, "WID")))
    bad = length.isNull() | width.isNull()
    return each.select(
        "file", "event_id", F.col("segment_id").cast("int").alias("segment_id"), F.when(many, _number(head, "STRIKE")).otherwise(F.col("global_strike")).alias("strike"), F.when(many, _number(head, "DIP")).otherwise(F.col("global_dip")).alias("dip"),
        _error(bad, length, "a segment has no size", mode, "double").alias("len_strike_km"), width.alias("width_dip_km"), F.lit("top_center").alias("position"), F.lit(False).alias("surface_projection"), "own",
    )


def parse_subfaults(segments: DataFrame, mode: str = "raise") -> DataFrame:
    """One row a subfault, in file order: from two lines below the table's header to the next comment line."""
    at = F.array_position(F.transform("own", lambda x: x.rlike(TABLE)), F.lit(True)).cast("int")
    names = F.split(F.trim(F.regexp_replace(F.try_element_at("own", at), r"^%\s*", "")), r"\s+")
    rest = F.slice("own", at + 2, F.greatest(F.size("own") - at - 1, F.lit(0)))
    end = F.array_position(F.transform(rest, lambda x: x.startswith("%")), F.lit(True)).cast("int")
    rows = F.filter(F.slice(rest, 1, F.when(end > 0, end - 1).otherwise(F.size(rest))), lambda x: F.trim(x) != "")
    table = segments.withColumn("_at", _error(at == 0, at, "a segment has no data table", mode, "int")).where("_at > 0").withColumn("_names", F.transform(names, lambda x: F.upper(x))).withColumn("_raw", names)
    each = table.select("*", F.posexplode(rows).alias("subfault_id", "_row")).withColumn("_v", F.transform(F.split(F.trim("_row"), r"\s+"), lambda x: x.try_cast("double")))
    col = lambda k: F.try_element_at("_v", F.lit(k))
    has_rake = F.array_contains("_names", "RAKE")
    last = F.when(has_rake, F.array_position("_names", F.lit("RAKE"))).otherwise(F.array_position("_names", F.lit("SLIP"))).cast("int")
    n = F.greatest(F.least(F.size("_names"), F.size("_v")) - last, F.lit(0))
    extra = F.map_from_arrays(F.slice("_raw", last + 1, n), F.slice("_v", last + 1, n))
    named = lambda k: F.try_element_at("_v", F.array_position("_names", F.lit(k)).cast("int"))
    keep = each.withColumn("extra", extra)
    return keep.select(
        "event_id", "segment_id", "subfault_id", col(2).alias("lon"), col(1).alias("lat"), col(5).alias("z"), col(6).alias("slip"), F.when(has_rake, col(7)).otherwise(0.0).alias("rake"),
        F.when(F.array_contains("_names", "TRUP"), named("TRUP")).alias("trup"), F.when(F.array_contains("_names", "RISE"), named("RISE")).alias("rise"), "extra", "strike", "dip", "len_strike_km", "width_dip_km",
    )


def read_fsp(spark: SparkSession, path: str, mode: str = "raise") -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, segments and subfaults of every file under path; mode='null' keeps going, bad_files names the files."""
    events = parse_events(read_lines(spark, path), mode)
    segments = parse_segments(events, mode)
    return events.drop("lines"), segments.drop("own"), parse_subfaults(segments, mode)


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """file and what it lacks."""
    events = parse_events(read_lines(spark, path), "null")
    segments = parse_segments(events, "null")
    table = F.exists("own", lambda x: x.rlike(TABLE))
    return events.where("date_parsed is null").select("file", F.lit("date").alias("lacks")).unionByName(
        segments.where("len_strike_km is null or width_dip_km is null").select("file", F.lit("size").alias("lacks"))
    ).unionByName(segments.where(~table).select("file", F.lit("table").alias("lacks"))).distinct()


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NaN"))


def _joined(*parts: str | Column) -> Column:
    """Plain strings as they are, columns as text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else _text(p) for p in parts))


def header_lines() -> Column:
    """The lines of an event before its first segment."""
    c = F.col
    name = lambda k: F.coalesce(c(k), F.lit(""))
    data = F.when(c("data").isNotNull(), F.array(_joined("% Data : ", F.array_join(F.map_keys("data"), " ")), _joined("% Data : ", F.array_join(F.map_values("data"), " ")))).otherwise(F.array().cast("array<string>"))
    fixed = F.array(
        F.lit("% ---- finite-source rupture model ----"), F.lit("%"),
        _joined("% Event : ", name("event"), " \t", F.coalesce(F.date_format("date_parsed", "MM/dd/yyyy"), F.lit("")), " \t[", name("reference"), "]"),
        _joined("% EventTAG: ", c("event_id")), _joined("% Loc  : LAT = ", c("lat"), " LON = ", c("long"), " DEP = ", c("depth")),
        _joined("% Size : LEN = ", c("size_len"), " km WID = ", c("size_wid"), " km Mw = ", c("mw")), _joined("% Mech : STRK = ", c("global_strike"), " DIP = ", c("global_dip")),
        _joined("% Invs : Nsg = ", c("nsg")),
    )
    return F.concat(fixed, data)


def fsp_texts(events: DataFrame, segments: DataFrame, subfaults: DataFrame) -> DataFrame:
    """event_id and the text of its file: every segment with its table in the order of segment_id and subfault_id.

    Missing numbers are written as NaN, plane coordinates as 0. A file is one row, as it is to read_fsp: an event's subfaults must fit in a task's memory.
    """
    head = events.select("event_id", F.posexplode(header_lines()).alias("_at", "value")).withColumns({"_segment": F.lit(-1), "_part": F.lit(0)})
    own = F.array(
        _joined("% SEGMENT # ", F.col("segment_id") + 1, ": STRIKE = ", F.col("strike"), " deg DIP = ", F.col("dip"), " deg"), _joined("% Dx = ", F.col("len_strike_km"), " km Dz = ", F.col("width_dip_km"), " km"),
        F.lit("%  LAT LON X==EW Y==NS Z SLIP RAKE TRUP RISE"), F.lit("% ----"),
    )
    over = segments.select("event_id", F.col("segment_id").alias("_segment"), F.posexplode(own).alias("_at", "value")).withColumn("_part", F.lit(0))
    row = F.concat_ws(" ", F.lit(""), _text("lat"), _text("lon"), F.lit("0"), F.lit("0"), *(_text(k) for k in ("z", "slip", "rake", "trup", "rise")))
    rows = subfaults.select("event_id", F.col("segment_id").alias("_segment"), F.col("subfault_id").alias("_at"), row.alias("value"), F.lit(1).alias("_part"))
    lines = head.unionByName(over).unionByName(rows)
    ordered = F.array_sort(F.collect_list(F.struct("_segment", "_part", "_at", "value")))
    return lines.groupBy("event_id").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"))


def write_fsp(events: DataFrame, segments: DataFrame, subfaults: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file an event in a folder of its own under path, which read_fsp reads back: numbers to the last bit, segments and subfaults numbered anew from 0."""
    fsp_texts(events, segments, subfaults).write.mode(mode).partitionBy("event_id").text(path)
