"""Texts that were cut off: by a field's limit, or anywhere in transfer.

Limits show in the lengths. For each source the discrete hazard of a length is the share, among texts
at least so long, of those exactly so long; at a limit it jumps. ``length_hazards`` computes hazards
with window functions over counts by length, tests each against the pooled hazard of its neighbours
(exact Poisson tail), and keeps the false discovery rate below ``alpha`` (Benjamini and Hochberg). Where
a significant length holds ``LIMIT`` times as many texts as its neighbours lead to expect, it is a limit,
and the excess share of its texts is the probability that one of them was cut there.

Endings show the cut. Some are plain (a mark that says so, a broken character, an open fenced block,
running text without a closing mark). Others are open: list items and short replies often end without
a mark. For those lengths and corpus judge together: how often do the last words end a line or sentence
elsewhere, and how often do they go on? Counts come from all texts, each last line left out, since it
may be cut itself. At a limit an open ending is cut unless its last words end a line more surely than
the limit cuts. Elsewhere a list item is cut only if its last words all but never end a line, and a short
reply if no two other lines of the corpus say the same; where a corpus is so small that most replies are
new, the last words decide for replies too. A text's stored hash plays no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.tables import kept_table

#: lengths on either side whose hazards are pooled
NEIGHBOURS = 25
ALPHA = 0.01
#: how many times as many texts as expected a length must hold to be a limit
LIMIT = 2.0
#: least share of complete endings away from limits: of list items, and of replies of a corpus where this share of replies is new
COMPLETE, NOVEL = 0.0001, 0.5
#: outer blanks of a text
_BLANKS = " \t\n\r\x0b\x0c\x85\u00a0\u2028\u2029\u202f\u3000"
_UNCLEAR = ("item", "reply")
#: longest text of a labelled line that may end without a mark
REPLY_CHARS = 40
#: phrases a task counts before it hands them on
PHRASES_KEPT = 400_000
#: weight of the last word alone against the last two words
BACKOFF = 2.0

_MARK = (
    r"(?:…|\.\.\.|[\[(<{](?:\s*(?:…|\.\.\.)\s*|[^\[\](){}<>]{0,12}(?i:truncated|cut|snip|clipped|continued|abgeschnitten|tronqué|cortado)"
    r"[^\[\](){}<>]{0,12})[\])>}])$"
)
_ITEM = r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+"
_LABEL = r"^\*\*[^*\n]{1,60}:\*\* "
_CLOSED = r"[.!?。！？।؟…]['\"”’»)\]*_`]*$"
_STOPPED = re.compile(r"[.!?]['\"”’»)*_`]*$")
_EDGE = "\"'“”„«»()[]*_`,;:.!?"
#: a full stop after these does not close a sentence
_OPEN_STOP = r"(?iu)(?:^|[\s(])(?:e\.g|i\.e|approx|aprox|ca|env|vs|cf|fig|figs|no|nr|sec|rev|dr|mr|mrs|ms|st|sr|sra|pág|p\.? ?ex|p\.? ?ej|z\.? ?b|d\.? ?h|d|z|p|e|i|jan|feb|m|[A-Z])\.$"
#: but a street's name does, and a link without its end never does
_STREET = r"\d+[A-Za-z]? (?:[NSEW]\. )?(?:[A-Z][\w'’]+ ){1,4}(?:St|Dr|Rd|Ln|Ave|Ct)\.$"
_OPEN_LINK = r"\]\([^)\s]*$"


def family(file_path: Column) -> Column:
    return F.substring_index(file_path, "/", 1)


def length_hazards(lengths: DataFrame, neighbours: int = NEIGHBOURS, alpha: float = ALPHA) -> DataFrame:
    """(source, family, len, n, at_risk, hazard, expected, p_value, excess, significant) from one row per text.

    ``lengths`` has (source, family, len). Rows are counted before anything is ordered; the windows
    run over one row per source and length. A source with one length only has nothing to compare
    with, and is never significant. ``excess`` is the share of a length's texts beyond what its
    neighbours lead to expect.
    """
    counts = lengths.where("len is not null").groupBy("source", "family", "len").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("source", "family")
    longer = group.orderBy(F.col("len").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = group.orderBy("len").rangeBetween(-neighbours, neighbours)
    at_risk = counts.withColumn("at_risk", F.sum("n").over(longer))
    pooled = at_risk.select(
        "*",
        (F.sum("n").over(near) - F.col("n")).alias("near_n"),
        F.avg("at_risk").over(near).alias("near_risk"),
        (
            F.least(F.lit(neighbours), F.col("len") - F.min("len").over(group))
            + F.least(F.lit(neighbours), F.max("len").over(group) - F.col("len"))
        ).alias("near_lengths"),
    )
    # the neighbours' lengths have about near_risk texts at risk each; where few are left to risk anything,
    # hazards rise by themselves, and the neighbours' mean count is the fairer expectation
    per_length = (F.col("near_n") + 0.5) / F.greatest(F.col("near_lengths"), F.lit(1))
    expected = per_length / F.col("near_risk")
    mean = F.when(F.col("near_lengths") > 0, F.greatest(expected * F.col("at_risk"), per_length)).otherwise(F.col("n") * 1.0)

    @F.pandas_udf("double")
    def tail(n: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([_poisson_tail(int(a), float(b)) for a, b in zip(n, mean)], dtype=float)

    tested = pooled.select(
        "source", "family", "len", "n", "at_risk", (F.col("n") / F.col("at_risk")).alias("hazard"),
        expected.alias("expected"), tail("n", mean).alias("p_value"), F.greatest(F.lit(0.0), 1 - mean / F.col("n")).alias("excess"),
    )
    tested = kept_table(tested)
    tests = tested.agg(F.count(F.lit(1)).alias("tests"))
    # only p-values up to alpha can be discoveries: few rows are ranked
    ranked = tested.where(F.col("p_value") <= alpha).withColumn("rank", F.row_number().over(Window.orderBy("p_value")))
    limit = (
        ranked.join(F.broadcast(tests)).where(F.col("p_value") <= F.col("rank") * alpha / F.col("tests"))
        .agg(F.coalesce(F.max("p_value"), F.lit(-1.0)).alias("limit"))
    )
    return tested.join(F.broadcast(limit)).select(
        *[c for c in tested.columns], (F.col("p_value") <= F.col("limit")).alias("significant")
    )


def _poisson_tail(n: int, mean: float) -> float:
    """P(X >= n) for a Poisson variable: the regularised incomplete gamma function P(n, mean)."""
    if n <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    front = math.exp(n * math.log(mean) - mean - math.lgamma(n + 1))
    if mean < n + 1:
        term = total = 1.0
        k = n
        while term > total * 1e-15:
            k += 1
            term *= mean / k
            total += term
        return min(1.0, front * total)
    # beyond the mean: the complement's continued fraction, by Lentz's method
    tiny = 1e-300
    b = mean + 1 - n
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1_000_000):
        a = -i * (i - n)
        b += 2
        d = 1 / (d * a + b or tiny)
        c = a / c + b or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - front * n * h)


def _word(token: str) -> str:
    """A word's class: its letters, or its shape where words of one kind differ in their letters only."""
    if "://" in token:
        return "url/9" if token[-1:].isdigit() and re.search(r"[a-z]/\d+$", token) else "url/a"
    t = re.sub(r"\d", "9", token.strip(_EDGE))
    if t.isalpha():
        return "C~" + t[-3:] if t[0].isupper() and len(t) > 1 else t
    if (at := t.rfind(".")) > 0 and t[:1].isalpha() and t[at + 1 :].isalpha():
        return "." + t[at + 1 :]
    if (at := t.rfind("-")) > 0 and t[:at].isalpha() and t[at + 1 :].isalpha():
        return "-" + t[at + 1 :]
    if t.replace(",", "").replace("$", "").isdigit():
        return re.sub(r"9+$", lambda m: "999" if "," in t else "9", re.sub(r"9+,", "9,", t))
    return re.sub(r"9+(?=[.:])", "9", t)


class _Counts:
    """Counts of words and pairs of words by whether a line or sentence ends with them, over many texts.

    Tokens are classed once each; what is counted are numbers of classes, a batch at a time.
    """

    def __init__(self) -> None:
        self.tokens: dict[str, tuple[int, int]] = {}
        self.numbers: dict[str, int] = {}
        self.words: list[str] = []
        self.replies: Counter = Counter()
        self.counts: Counter = Counter()
        self.flow: list[int] = []

    def classed(self, token: str) -> tuple[int, int]:
        word = _word(token)
        number = self.numbers.setdefault(word, len(self.words))
        if number == len(self.words):
            self.words.append(word)
        stop = token[-1] in _EDGE and (len(word) > 2 or word == "9") and _STOPPED.search(token) is not None
        got = self.tokens[token] = (2 * number, 2 * number + 1) if not stop else (2 * number + 1, 2 * number + 1)
        return got

    def add(self, text: str) -> None:
        tokens, flow = self.tokens, self.flow
        lines = text.split("\n")
        last = len(lines) - 1
        fenced = False
        for at, line in enumerate(lines):
            if "```" in line and line.lstrip().startswith("```"):
                fenced = not fenced
                continue
            words = line.split() if not fenced else None
            if not words:
                continue
            if at == last:
                words.pop()
                for w in words:
                    flow.append((tokens.get(w) or self.classed(w))[0])
            else:
                for w in words:
                    flow.append((tokens.get(w) or self.classed(w))[0])
                flow[-1] |= 1
                # a reply counts by its whole text: the start of a longer line says nothing of a line that ends there
                if line.startswith("**") and (m := re.match(_LABEL, line)):
                    reply = line[m.end() :].strip()
                    if len(reply) <= REPLY_CHARS:
                        self.replies["reply:" + reply] += 1
            flow.append(-1)

    def fold(self) -> None:
        """Counts what has flowed in so far: words, and pairs that a line's end does not part."""
        flow = np.array(self.flow, np.int64)
        self.flow.clear()
        one, n = np.unique(flow[flow >= 0], return_counts=True)
        for k, c in zip(one.tolist(), n.tolist()):
            self.counts[k] += c
        if len(flow) > 1:
            before, after = flow[:-1], flow[1:]
            both = (before >= 0) & (after >= 0)
            two, n = np.unique(((before[both] >> 1) + 1 << 32) | after[both], return_counts=True)
            for k, c in zip(two.tolist(), n.tolist()):
                self.counts[k] += c

    def drain(self) -> pa.RecordBatch:
        self.fold()
        w, mask = self.words, (1 << 32) - 1
        phrases = [(w[(k >> 32) - 1] + " " if k >> 32 else "") + w[(k & mask) >> 1] for k in self.counts]
        stops = [bool(k & 1) for k in self.counts]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(phrases + list(self.replies), pa.string()), pa.array(stops + [True] * len(self.replies), pa.bool_()),
             pa.array(list(self.counts.values()) + list(self.replies.values()), pa.int64())],
            names=["phrase", "stop", "n"],
        )
        self.__init__()
        return batch


def phrase_ends(texts: DataFrame) -> DataFrame:
    """(phrase, ends, goes_on): how often words and pairs of words end a line or sentence, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.add(t)
            counts.fold()
            if len(counts.counts) > PHRASES_KEPT or len(counts.tokens) > PHRASES_KEPT:
                yield counts.drain()
        yield counts.drain()

    return (
        texts.mapInArrow(run, "phrase string, stop boolean, n bigint")
        .groupBy("phrase")
        .agg(F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(~F.col("stop"), F.col("n")).otherwise(0)).alias("goes_on"))
    )


def _last_phrases(lines: pd.Series) -> pd.DataFrame:
    out = []
    for line in lines:
        words = [_word(w) for w in line.split()[-2:]]
        out.append((words[-1] if words else "", " ".join(words) if len(words) > 1 else ""))
    return pd.DataFrame(out, columns=["one", "two"])


def endings(chunks: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """One row per non-null, non-blank text with its ending's kind.

    Kinds: ``mark`` (a mark of truncation, or a broken character), ``fence`` (an open fenced block),
    ``running`` (no closing mark in running text), ``stop`` (a closing mark), ``item`` (a list item
    without one), ``reply`` (a labelled line without one), ``block`` (a closed fenced block). ``line``, the
    whole last line, and ``reply`` are null where the kind needs no second look.
    """
    t = F.rtrim(F.col(text), F.lit(_BLANKS))
    line = F.substring_index(t, "\n", -1)
    fences = F.when(t.contains("```"), F.size(F.split(F.concat(F.lit("\n"), t), r"\n[ \t]*```", -1)) - 1).otherwise(0)
    reply = F.regexp_replace(line, _LABEL, "")
    kind = (
        F.when(line.rlike(_MARK) | line.endswith("�"), "mark")
        .when(fences % 2 == 1, "fence")
        .when(line.rlike(r"^\s*```"), "block")
        .when(line.rlike(_OPEN_STOP) & ~line.rlike(_STREET), "running")
        .when(line.rlike(_OPEN_LINK), "running")
        .when(line.rlike(_CLOSED), "stop")
        .when(line.rlike(_ITEM), "item")
        .when(line.rlike(_LABEL) & (F.length(reply) <= REPLY_CHARS), "reply")
        .otherwise("running")
    )
    rows = chunks.where(F.col(text).rlike(r"(?U)\S")).select(
        F.col(id_col).alias("id"), F.col("metadata")["source"].alias("source"), family(F.col("file_path")).alias("family"),
        F.length(text).alias("len"), kind.alias("kind"), line.alias("line"), F.concat(F.lit("reply:"), F.trim(reply)).alias("reply"),
    )
    unclear = F.col("kind").isin(*_UNCLEAR)
    return rows.withColumn("line", F.when(unclear, F.col("line"))).withColumn("reply", F.when(F.col("kind") == "reply", F.col("reply")))


def truncated(chunks: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, source, family, len, kind, at_limit, is_cut) of every non-null, non-blank text.

    Null and blank texts are no cases. Texts of equal source, family and ending are judged alike. Repeated
    rows give repeated rows; null metadata and paths are a source and a family of their own.
    """
    rows = kept_table(endings(chunks, id_col, text))
    none = F.lit("")
    limits = length_hazards(rows.select("source", "family", "len")).where(F.col("significant") & (F.col("n") * (1 - F.col("excess")) * LIMIT <= F.col("n")))
    marks = limits.select(F.coalesce("source", none).alias("ls"), F.coalesce("family", none).alias("lf"), F.col("len").alias("ll"), "excess")
    at = (F.coalesce("source", none) == F.col("ls")) & (F.coalesce("family", none) == F.col("lf")) & (F.col("len") == F.col("ll"))
    rows = rows.join(marks, at, "left").withColumn("at_limit", F.col("ll").isNotNull()).drop("ls", "lf", "ll")

    split = F.pandas_udf(_last_phrases, "one string, two string")
    unclear = rows.where(F.col("kind").isin(*_UNCLEAR)).withColumn("w", split("line")).select("*", "w.*").drop("w")
    texts = chunks.where(F.col(text).rlike(r"(?U)\S")).select(F.col(text))
    # the phrases of unclear endings are few beside all phrases: only their counts are kept, and those of replies
    asked = unclear.select(F.explode(F.array("one", "two", "reply")).alias("phrase")).distinct().withColumn("asked", F.lit(True))
    known = kept_table(phrase_ends(texts).join(asked, "phrase", "left").where(F.col("asked") | F.col("phrase").startswith("reply:")).drop("asked"))
    # how often a reply is new: of the corpus' replies, the share of those said once
    said = known.where(F.col("phrase").startswith("reply:"))
    novelty = said.agg((F.count_if(F.col("ends") == 1) / F.nullif(F.sum("ends"), F.lit(0))).alias("novelty"))
    one = known.select(F.col("phrase").alias("one"), F.col("ends").alias("e1"), F.col("goes_on").alias("g1"))
    two = known.select(F.col("phrase").alias("two"), F.col("ends").alias("e2"), F.col("goes_on").alias("g2"))
    times = said.select(F.col("phrase").alias("reply"), F.col("ends").alias("times"))
    judged = unclear.join(one, "one", "left").join(two, "two", "left").join(times, "reply", "left").join(F.broadcast(novelty))
    zero = {c: 0 for c in ("e1", "g1", "e2", "g2", "times")}
    alone = (F.col("e1") + 0.5) / (F.col("e1") + F.col("g1") + 1)
    share = (F.col("e2") + BACKOFF * alone) / (F.col("e2") + F.col("g2") + BACKOFF)
    unheard = (F.col("times") < 2) & ((F.coalesce("novelty", F.lit(0.0)) < NOVEL) | (share < NOVEL))
    cut_off = (
        F.when(F.col("at_limit"), F.when(F.col("kind") == "reply", (F.col("times") < 2) | (share < F.col("excess"))).otherwise(share < F.col("excess")))
        .when(F.col("kind") == "reply", unheard)
        .otherwise(share < COMPLETE)
    )
    columns = ["id", "source", "family", "len", "kind", "at_limit"]
    judged = judged.fillna(zero).select(*columns, cut_off.alias("is_cut"))
    plain = rows.where(~F.col("kind").isin(*_UNCLEAR)).select(
        *columns, F.col("kind").isin("mark", "fence", "running").alias("is_cut")
    )
    return judged.unionByName(plain)


def truncation_report(chunks: DataFrame) -> DataFrame:
    """(source, family, n_texts, n_cut, n_at_limit, share_cut): how often each source truncates."""
    return truncated(chunks).groupBy("source", "family").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if("is_cut").alias("n_cut"),
        F.count_if(F.col("is_cut") & F.col("at_limit")).alias("n_at_limit"),
        F.round(F.count_if("is_cut") / F.count(F.lit(1)), 6).alias("share_cut"),
    )
