"""Files cut into chunks: sections by heading, large sections at blank lines, overlap, type, date, hash.

Everything is columns on arrays of lines: headings and greedy cuts are found as places first and lines
taken by place once, so the work is linear in a file's lines and a file needs no shuffle beyond the read. ``chunk_files`` takes (file_path, text) and gives one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import content_hash, lines, path_date, path_stem
from tidemill.sources.tables import spread

MAX_CHARS, MAX_CHARS_TRANSCRIPT, OVERLAP_SENTENCES = 800, 2000, 2
HEADING = r"^#{1,6}\s+.+"
# Line patterns of each type.
FACT_PATTERNS = (
    r"[-•]\s*\w+.*?:\s*.+", r"[-•]\s*\w+.*?\bis\b\s+.+", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"https?://\S+",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
)
CONFIG_PATTERNS = (
    r"(?i)(?:password|token|key|secret|credential|login|port|host|ip)\s*[:=]", r"(?i)ssh\s+\w+@", r"(?i)(?:API|SSH|URL|IP)\s*:",
)
TODO_PATTERNS = (r"(?i)[-•]\s*\[[ x]\]", r"(?i)\b(?:TODO|FIXME|HACK|XXX)\b")
OVERLAP_MARK = "[...overlap...]"

_PIECE = "array<struct<start:int,stop:int,body:array<string>>>"


def heading_sections(text: Column) -> Column:
    """The sections of a text: each heading line starts one and belongs to it; what comes before is headless."""
    ls = lines(text)
    places = F.transform(ls, lambda line, i: F.when(line.rlike(HEADING), i + 1))
    heads = F.array_compact(places)
    starts = F.when(F.get(heads, F.lit(0)) == 1, heads).otherwise(F.concat(F.array(F.lit(1)), heads))
    return F.transform(starts, lambda at, i: _section(ls, at, F.coalesce(F.get(starts, i + 1), F.size(ls) + 1)))


def _section(ls: Column, at: Column, until: Column) -> Column:
    first = F.element_at(ls, at)
    heading = F.when(first.rlike(HEADING), F.trim(F.regexp_replace(first, r"^#{1,6}\s+", "")))
    return F.struct(heading.alias("heading"), at.cast("int").alias("start"), F.slice(ls, at, until - at).alias("body"))


def large_split(body: Column, start: Column, limit: Column) -> Column:
    """Greedy pieces of a section: cut only at a blank line, once more than ``limit`` characters are held.

    The blank line is dropped; a section without a blank line is never cut.
    """
    none = F.array().cast("array<int>")
    first = F.struct(none.alias("cuts"), F.lit(0).alias("from"), F.lit(0).alias("chars"))
    sizes = F.transform(body, lambda line, i: F.struct(F.length(line).alias("n"), (F.trim(line) == "").alias("blank"), i.alias("at")))

    def step(s, x):
        size = x["n"] + 1
        full = x["blank"] & (s["chars"] + size > limit) & (x["at"] > s["from"])
        cut = F.struct(F.concat(s["cuts"], F.array(x["at"])).alias("cuts"), (x["at"] + 1).alias("from"), F.lit(0).alias("chars"))
        return F.when(full, cut).otherwise(F.struct(s["cuts"].alias("cuts"), s["from"].alias("from"), (s["chars"] + size).alias("chars")))

    cuts = F.aggregate(sizes, first, step, lambda s: F.concat(F.array(F.lit(-1)), s["cuts"], F.array(F.size(body))))
    pieces = F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda c, i: _piece(body, start, c + 1, F.get(cuts, i + 1)))
    return F.filter(pieces, lambda p: F.size(p["body"]) > 0)


def _piece(body: Column, start: Column, begin: Column, end: Column) -> Column:
    """The lines [begin, end) of a section, counted from 0."""
    return F.struct(
        (start + begin).cast("int").alias("start"), (start + end - 1).cast("int").alias("stop"), F.slice(body, begin + 1, end - begin).alias("body")
    )


def sentences(text: Column) -> Column:
    """Sentences at blanks after ``.!?`` before a capital, at line ends, trimmed; the whole text if none."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z])|\n(?=[-*\d])|\n", -1)
    found = F.filter(F.transform(parts, F.trim), lambda s: s != "")
    return F.when(F.size(found) == 0, F.array(text)).otherwise(found)


def chunk_type(text: Column) -> Column:
    """config, todo, fact or narrative by counts of matching (pattern, line) pairs, in that order."""
    ls = lines(text)

    def hits(patterns):
        one = lambda p: F.size(F.filter(ls, lambda x: x.rlike(p)))
        return sum((one(p) for p in patterns), F.lit(0))

    facts = hits(FACT_PATTERNS)
    return (
        F.when(hits(CONFIG_PATTERNS) >= 2, "config")
        .when(hits(TODO_PATTERNS) >= 1, "todo")
        .when((facts >= 3) | ((facts >= 1) & (F.length(text) < 300)), "fact")
        .otherwise("narrative")
    )


def date_prefix(date: Column) -> Column:
    """``Date: Weekday, Month dd, yyyy (iso)``; of an impossible date its raw form alone."""
    day = date.try_cast("date")
    known = F.concat(F.date_format(day, "EEEE, MMMM dd, yyyy"), F.lit(" ("), date, F.lit(")"))
    return F.concat(F.lit("Date: "), F.coalesce(known, date))


def chunk_files(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(file_path, ordinal, line_start, line_end, text, chars, heading, type, hash, has_overlap, file_date, source).

    ``files`` has (file_path, text). Blank and null texts give no chunk. Paths with ``transcript`` in
    them take pieces of up to 2,000 characters. ``hash`` is that of the text before its date line.
    """
    is_transcript = F.lower("file_path").contains("transcript")
    limit = F.when(is_transcript, F.lit(MAX_CHARS_TRANSCRIPT)).otherwise(F.lit(max_chars))
    sections = (
        spread(files.select("file_path", "text")).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")
        .select("file_path", limit.alias("limit"), path_stem(F.col("file_path")).alias("stem"), heading_sections(F.col("text")).alias("ss"))
        .select("file_path", "limit", "stem", F.posexplode("ss").alias("section", "s"))
        .select("file_path", "limit", "stem", "section", "s.*")
        .withColumn("whole", F.trim(F.regexp_replace(F.array_join("body", "\n"), r"^\s+|\s+$", "")))
        .where("whole <> ''")
    )
    label = F.when(
        F.col("heading").isNull() | (F.col("heading") == F.col("stem")), F.concat(F.lit("["), "stem", F.lit("] "))
    ).otherwise(F.concat(F.lit("["), "stem", F.lit(" > "), "heading", F.lit("] ")))
    sections = sections.withColumn("label", label)
    fits = F.length(F.concat("label", "whole")) <= F.col("limit")
    pieces = F.when(
        fits, F.array(F.struct(F.col("start"), (F.col("start") + F.size("body") - 1).alias("stop"), F.col("body")))
    ).otherwise(large_split(F.col("body"), F.col("start"), F.col("limit")))
    # the index counts all pieces; the tail comes from the last piece that is not blank
    trimmed = F.transform(
        pieces.cast(_PIECE),
        lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), F.regexp_replace(F.array_join(p["body"], "\n"), r"^\s+|\s+$", "").alias("raw")),
    )
    rows = sections.withColumn("pieces", trimmed).select("*", F.posexplode("pieces").alias("idx", "p"))
    earlier = F.filter(F.slice("pieces", F.lit(1), F.col("idx")), lambda p: p["raw"] != "")
    before = F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["raw"])
    said = sentences(before)
    tail = F.when(before.isNotNull(), F.array_join(F.slice(said, F.greatest(F.size(said) - OVERLAP_SENTENCES + 1, F.lit(1)), OVERLAP_SENTENCES), " "))
    overlap = F.when(tail.isNotNull(), F.concat(F.lit(OVERLAP_MARK + " "), tail, F.lit("\n"))).otherwise("")
    # from the second piece on a headed section says its name twice, before the overlap
    again = F.concat(F.lit("["), "stem", F.lit(" > "), "heading", F.lit("] [Section: "), "heading", F.lit("]\n"))
    lead = F.when((F.col("idx") > 0) & (F.coalesce("heading", F.lit("")) != ""), again).otherwise(F.col("label"))
    text = F.concat(lead, overlap, F.col("p.raw"))
    date = path_date(F.col("file_path"))
    made = rows.where(F.col("p.raw") != "").select(
        "file_path", "section", "idx", F.col("p.start").alias("line_start"), F.col("p.stop").alias("line_end"), text.alias("body_text"),
        F.nullif("heading", F.lit("")).alias("heading"), tail.isNotNull().alias("has_overlap"), date.alias("file_date"),
        F.when(is_transcript, "transcript").alias("source"),
    )
    dated = F.when(F.col("file_date").isNotNull(), F.concat(date_prefix(F.col("file_date")), F.lit("\n"), "body_text")).otherwise(F.col("body_text"))
    return made.select(
        "file_path", F.struct("section", "idx").alias("ordinal"), "line_start", "line_end", dated.alias("text"), F.length(dated).alias("chars"), "heading",
        chunk_type(F.col("body_text")).alias("type"), content_hash(F.col("body_text")).alias("hash"), "has_overlap", "file_date", "source",
    )
