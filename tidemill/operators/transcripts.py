"""Transcript lines into conversation chunks: filters, blocks, line format, greedy packing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.messages import HEARTBEAT, transcript_session
from tidemill.functions.text import content_hash
from tidemill.functions.timestamps import instant_us

GAP_MIN, MAX_CHARS, MESSAGE_CUT, MIN_LENGTH, MIN_USER_LENGTH = 30, 1200, 2000, 10, 5
# Marks of the metadata envelope and of heartbeat traffic.
ENVELOPE = (
    r"Conversation info \(untrusted metadata\):\s*```json\s*\{[^}]*\}\s*```\s*"
    r"(?:Sender \(untrusted metadata\):\s*```json\s*\{[^}]*\}\s*```\s*)?"
)
SENDER = r'"sender":\s*"([^"]+)"'
HEARTBEAT_PROMPT = "Read HEARTBEAT.md"

CUT_MARK = "... [truncated]"
#: lines of a session that are ordered together; only the ends of such spans meet by session
SPAN = 4096


def parse_lines(raw: DataFrame) -> DataFrame:
    """(file_path, line_num, timestamp, role, text) of raw JSONL lines (file_path, line_num, value).

    Blank and malformed lines are skipped. Content is a string, or an array whose items of type
    ``text`` are joined by line breaks; anything else is empty. What it is, its JSON type says: a string
    that looks like an array or an object is text.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    line = raw.select("file_path", "line_num", F.try_parse_json("value").alias("v"))
    line = line.select("file_path", "line_num", "v", get(F.col("v"), "$.message", "variant").alias("m"))
    content = get(F.col("m"), "$.content", "variant")
    kind = F.schema_of_variant(content)
    items = F.filter(get(content, "$", "array<variant>"), lambda i: get(i, "$.type", "string") == "text")
    said = F.array_join(F.transform(items, lambda i: F.coalesce(get(i, "$.text", "string"), F.lit(""))), "\n")
    text = F.when(kind == "STRING", get(content, "$", "string")).when(kind.startswith("ARRAY"), said).otherwise("")
    return line.where(F.schema_of_variant("m").startswith("OBJECT")).select(
        "file_path", "line_num", get(F.col("v"), "$.timestamp", "string").alias("timestamp"), get(F.col("m"), "$.role", "string").alias("role"), text.alias("text")
    )


def kept_messages(lines: DataFrame) -> DataFrame:
    """Lines of users and assistants that say something: (session_id, line_num, us, role, sender, text).

    Short texts and heartbeat traffic go; a user's envelope is stripped and its sender kept. ``lines``
    has (file_path, line_num, timestamp, role, text) and may have sender.
    """
    role = F.lower(F.trim("role"))
    is_user = role == "user"
    sender = F.when(is_user, F.nullif(F.regexp_extract("text", SENDER, 1), F.lit("")))
    if "sender" in lines.columns:
        sender = F.coalesce(sender, F.col("sender"))
    bare = F.when(is_user, F.trim(F.regexp_replace("text", ENVELOPE, ""))).otherwise(F.trim("text"))
    heartbeat = (F.col("text").contains(HEARTBEAT_PROMPT) & F.col("text").contains(HEARTBEAT)) | (F.trim("text") == HEARTBEAT)
    return (
        lines.where(role.isin("user", "assistant") & (F.length(F.trim("text")) >= MIN_LENGTH) & ~heartbeat)
        .select(
            transcript_session(F.col("file_path")).alias("session_id"), "line_num", instant_us(F.col("timestamp")).alias("us"),
            role.alias("role"), sender.alias("sender"), bare.alias("text"),
        )
        .where((F.col("role") != "user") | (F.length("text") >= MIN_USER_LENGTH))
    )


def blocks(messages: DataFrame, gap_min: int = GAP_MIN) -> DataFrame:
    """``messages`` with ``block``: a new one after more than ``gap_min`` minutes to the line before.

    In order of lines; a missing time and a negative gap never split. Lines are ordered in spans of
    ``SPAN`` line numbers; a span is told the time of the last line before it and the number of blocks
    begun before it, so a long session is spread over many tasks.
    """
    span = F.floor(F.col("line_num") / SPAN).alias("span")
    before, inside = Window.partitionBy("session_id").orderBy("span"), Window.partitionBy("session_id", "span").orderBy("line_num")
    slim = messages.select("session_id", span, "line_num", "us")
    ends = slim.groupBy("session_id", "span").agg(F.max_by("us", "line_num").alias("end_us"))
    ends = ends.select("session_id", "span", F.lag("end_us").over(before).alias("before_us"))
    first = F.row_number().over(inside) == 1
    gap = F.col("us") - F.when(first, F.col("before_us")).otherwise(F.lag("us").over(inside))
    starts = F.coalesce((gap > gap_min * 60_000_000).cast("int"), F.lit(0))
    flagged = lambda df: df.join(ends, ["session_id", "span"]).withColumn("starts", starts)
    begun = flagged(slim).groupBy("session_id", "span").agg(F.sum("starts").alias("n"))
    earlier = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = begun.select("session_id", "span", earlier.alias("earlier"))
    rows = flagged(messages.select("*", span)).join(begun, ["session_id", "span"])
    return rows.withColumn("block", F.col("earlier") + F.sum("starts").over(inside)).drop("starts", "span", "before_us", "earlier")


def message_line(role: Column, sender: Column, text: Column) -> Column:
    """``**Label:** text``; texts of more than 2,000 characters are cut, with a mark."""
    label = F.coalesce(F.nullif(sender, F.lit("")), F.initcap(role))
    cut = F.when(F.length(text) > MESSAGE_CUT, F.concat(F.substring(text, 1, MESSAGE_CUT), F.lit(CUT_MARK))).otherwise(text)
    return F.concat(F.lit("**"), label, F.lit(":** "), cut)


def block_header(us: int | None, session: str) -> str:
    """The date and session lines above a chunk; empty without a time."""
    if us is None:
        return ""
    t = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    return f"Date: {t:%A, %B %d, %Y} ({t:%Y-%m-%d}) at {t:%H:%M} UTC\nSession: {session[:8]}\n\n"


class _Bins:
    """The chunks of one block, line after line: what is held is one bin, and at most one line more."""

    def __init__(self, key: tuple, header: str, max_chars: int) -> None:
        self.key, self.header, self.max_chars = key, header, max_chars
        self.part, self.size, self.lines, self.spare = 0, len(header), [], None

    def add(self, line: tuple, out: list) -> None:
        if self.spare is not None:
            spare, self.spare = self.spare, None
            self._break(spare, out)
        size = len(line[2]) + 2
        if not self.lines or self.size + size <= self.max_chars:
            self.lines.append(line)
            self.size += size
        elif self.part == 0 and self.size + size - 2 <= self.max_chars:
            # a block that fits as a whole is one chunk: whether it does, the next line tells
            self.spare = line
        else:
            self._break(line, out)

    def _break(self, line: tuple, out: list) -> None:
        self._emit(out)
        self.lines, self.size = [line], len(self.header) + len(line[2]) + 2

    def _emit(self, out: list) -> None:
        text = self.header + "\n\n".join(x[2] for x in self.lines)
        first, last = self.lines[0], self.lines[-1]
        out.append((*self.key, self.part, first[0], last[0], text, first[1], last[1]))
        self.part += 1

    def close(self, out: list) -> None:
        if self.spare is not None:
            self.lines.append(self.spare)
        self._emit(out)


def pack(messages: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Conversation chunks: (session_id, block, part, line_start, line_end, text, chars, start_us, end_us, type, source, hash).

    A block that fits is one chunk. The lines of a longer one fill bins: a new bin starts before a line
    that would pass ``max_chars`` if the bin holds one already; a longer line stays whole, its text cut at
    2,000 characters without a mark. Each chunk repeats its block's header. A block passes through its
    task line by line and is never held.
    """
    label = F.coalesce(F.nullif("sender", F.lit("")), F.initcap("role"))
    line = F.concat(F.lit("**"), label, F.lit(":** "), F.substring("text", 1, MESSAGE_CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = None
        for batch in batches:
            out: list[tuple] = []
            for session, block, num, us, said in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bins is None or bins.key != (session, block):
                    if bins is not None:
                        bins.close(out)
                    bins = _Bins((session, block), block_header(us, session or ""), max_chars)
                bins.add((num, us, said), out)
            yield _chunk_batch(out)
        if bins is not None:
            out = []
            bins.close(out)
            yield _chunk_batch(out)

    rows = (
        blocks(messages).select("session_id", "block", "line_num", "us", line.alias("line")).repartition("session_id", "block")
        .sortWithinPartitions("session_id", "block", "line_num").mapInArrow(run, _CHUNK)
    )
    return rows.select(
        "session_id", "block", "part", "line_start", "line_end", "text", F.length("text").alias("chars"), "start_us", "end_us",
        F.lit("conversation").alias("type"), F.lit("transcript").alias("source"), content_hash(F.col("text")).alias("hash"),
    )


_CHUNK = "session_id string, block bigint, part int, line_start int, line_end int, text string, start_us bigint, end_us bigint"
_CHUNK_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_CHUNK_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHUNK_TYPES)], names=[f.split()[0] for f in _CHUNK.split(", ")])
