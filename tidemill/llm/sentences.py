"""Sentence units of every document, whatever its language, script and layout.

Lines are first grouped into blocks: a heading line, a list item with the lines that continue it, a
fenced block, or running text up to a blank line. The first three are one unit each; the levels of open
list items are a stack, so a line that leaves a nested item goes on with the item around it. Running
text is read by a pushdown automaton: openers of quotations and brackets are pushed, closers pop, and a
terminator ends a sentence only at depth zero, so a sentence quoted inside another never splits it.
When a closer empties the stack right after a terminator, what follows decides. A full stop is looked
up in a trie of abbreviations, read backwards from the stop. Openers that are never closed in their
block are ignored in a second pass over it. Offsets count code points. The time is linear in the text's
length, whatever its nesting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations without their last stop, in lower case.
#: a name or more of the phrase follows
NEVER = (
    "dr mr mrs ms prof rev gen capt lt sgt mt gov messrs mme mlle mmes hr fr frau sr sra srta dra "
    "st ste sto sta vs cf approx aprox ca circa env e.g i.e viz resp incl excl dept tel attn p.ex p. ex p.ej p. ej "
    "z.b z. b d.h d. h u.a u. a i.d.r o.ä bzw ggf evtl vgl ee т.е т. е т.к т. к ок см г ул напр д डॉ श्री प्रो د أ"
)
#: a number follows
NUMBER = (
    "no nos nr num fig figs sec secs ch chap vol pp pg abb kap jan feb mar apr jun jul aug sep sept oct nov dec "
    "núm pág págs стр рис табл гл п № str"
)
#: may end a sentence: what follows decides
MAYBE = "inc co ltd corp llc a.m p.m u.s u.k u.n e.u uu ee.uu ee. uu т.п т. п т.д т. д мин руб млн др cía s.a phd ph.d usw o.k no.1"
#: the sentence goes on, or else this ends it
ALWAYS = "etc"

_MONTHS = {
    "januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember",
    "jan", "feb", "jänner", "klasse", "etage", "stock", "quartal", "woche", "tag",
}
_SUFFIXES = {"inc", "ltd", "llc", "corp", "kg", "gmbh", "co"}
_GOES_ON = {"on", "in", "at", "and", "or", "to", "until", "till", "but", "by", "with", "for", "from", "when", "while", "if", "sharp"}

_PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "《": "》", "【": "】", "„": "“”", "‹": "›", "〈": "〉"}
_CLOSERS = {c for v in _PAIRS.values() for c in v} | {'"'}
#: what each closer may close
_OPENS = {c: tuple(o for o, v in [*_PAIRS.items(), ('"', '"')] if c in v) for c in _CLOSERS}
_OPENERS = set(_PAIRS) | {'"', "¿", "¡"}
_BRACKETS = set("([{（【")
_STOPS = ".!?。！？।॥؟۔…｡"
_FULL = set("。！？।॥؟۔｡")
_THAI = "ก-๎"
_SPECIAL = re.compile(
    "[" + re.escape(_STOPS + "".join(sorted(set(_PAIRS) | _CLOSERS))) + "]"
    f"|(?<=[{_THAI}])\\s+(?=[{_THAI}])"
)
_RUN = re.compile("[" + re.escape(_STOPS) + "]+")
_SPACE = re.compile(r"\s*")
_LEAD = re.compile("[ \t\r\n  *_]*")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+\S|[ \t]*$)")
_BULLET = re.compile(r"([ \t ]*)[-*+•‣▪◦·][ \t ]+\S")
_NUMBERED = re.compile(r"([ \t ]*)(\d{1,3})[.)][ \t ]+\S")
_ADDRESS = re.compile(r"\d+[A-Za-z]? (?:[NSEW]\. |(?:North|South|East|West) )?(?:[A-Z][\w'’]+ ){1,3}(?:St|Dr|Ste)$")
_WORD = re.compile(r"[^\W\d_]+")


def _trie() -> dict:
    root: dict = {}
    for kind, words in (("never", NEVER), ("number", NUMBER), ("maybe", MAYBE), ("always", ALWAYS)):
        for w in _abbreviations(words):
            node = root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = kind
    return root


def _abbreviations(words: str) -> list[str]:
    """Words at blanks, but ``p. ex`` and the like (one letter, stop, blank) stay together."""
    return re.findall(r"(?:\w{1,2}\. )+\w+|\S+", words)


_TRIE = _trie()


def _abbreviation(text: str, stop: int, low: int) -> str | None:
    """The kind of the longest abbreviation that ends right before ``stop``."""
    node, at, found = _TRIE, stop - 1, None
    while at >= low:
        c = text[at].lower()
        if c.isspace():
            c = " "
            while at - 1 >= low and text[at - 1].isspace():
                at -= 1
        node = node.get(c)
        if node is None:
            break
        if "" in node and (at == low or not (text[at - 1].isalnum() or text[at - 1] in "_-")):
            found = node[""]
        at -= 1
    return found


def _starts(c: str) -> bool:
    return c.isupper() or c.istitle() or c in _OPENERS


def _ends_sentence(text: str, i: int, j: int, low: int, high: int) -> bool:
    """Does the run of terminators [i, j), at depth zero, end a sentence?"""
    m = _SPACE.match(text, j, high).end()
    while m < high and text[m] in "*_`":
        m += 1
    if m >= high:
        return True
    n, spaced, run, last = text[m], text[j].isspace(), text[i:j], text[j - 1]
    if last in _FULL:
        return True
    if "…" in run:
        return len(run) > 1 or (spaced and _starts(n))
    if len(run) > 1 and set(run) == {"."}:
        return spaced and n != "[" and _starts(n)
    if last in "!?":
        return spaced or _starts(n)
    before = text[i - 1] if i > low else " "
    if not spaced:
        if not (n.isupper() and m == j):
            return False
        k = i - 1
        while k >= low and text[k].isalnum():
            k -= 1
        word = text[k + 1 : i]
        return before in ")]”»%" or (len(word) > 1 or word.isdigit()) and _abbreviation(text, i, low) in (None, "always", "maybe")
    kind = _abbreviation(text, i, low)
    if kind == "never":
        return before in "tr" and _starts(n) and _ADDRESS.search(text, max(low, i - 60), i) is not None
    if kind == "number":
        return _starts(n) and not (m + 1 < high and text[m + 1].isdigit())
    if kind == "always":
        return True
    if kind == "maybe":
        if (word := _WORD.match(text, m, high)) and word[0].lower() in _SUFFIXES:
            return False
        if n.islower() and before == "m":
            return _WORD.match(text, m, high)[0] not in _GOES_ON
        return _starts(n) or (n.isdigit() and before == "m")
    if before.isalpha() and (i - 2 < low or not (text[i - 2].isalnum() or text[i - 2] in "_'’")):
        return False
    if before.isdigit():
        if (word := _WORD.match(text, m, high)) and word[0].lower() in _MONTHS:
            k = i - 1
            while k >= low and text[k].isdigit():
                k -= 1
            return not (i - k <= 3 and (k < low or text[k].isspace()))
    elif n.isdigit() and text[max(low, i - 3) : i].lower() == "str":
        return False
    return True


def _scan(text: str, low: int, high: int, skip: frozenset) -> tuple[list[tuple[int, int]], list[int]]:
    """Sentences of running text in [low, high), and the openers that were not closed."""
    units, stack, start, pos = [], [], low, low
    held: dict[str, int] = {}  # how many of each opener are on the stack
    while m := _SPECIAL.search(text, pos, high):
        i, c = m.start(), text[m.start()]
        pos = i + 1
        if c in _STOPS:
            j = _RUN.match(text, i, high).end()
            pos = j
            if not stack:
                while j < high and text[j] in "*_`":
                    j += 1
                if j > pos and j < high and not text[j].isspace():
                    j = pos
                if _ends_sentence(text, i, pos, start, high):
                    units.append((start, j))
                    start = pos = j
        elif c.isspace():
            pos = m.end()
            if not stack:
                units.append((start, i))
                start = pos
        elif i in skip:
            continue
        elif c in _CLOSERS and any(held.get(o) for o in _OPENS[c]):
            opener = None
            while opener not in _OPENS[c]:
                opener, at = stack.pop()
                held[opener] -= 1
            if not stack and _after_stop(text, at, i) and _ends_after_closer(text, opener, at, start, pos, high):
                units.append((start, pos))
                start = pos
        elif c in _PAIRS or c == '"':
            stack.append((c, i))
            held[c] = held.get(c, 0) + 1
    units.append((start, high))
    return units, [at for _, at in stack]


def _after_stop(text: str, low: int, closer: int) -> bool:
    k = closer - 1
    while k > low and (text[k].isspace() or text[k] in _CLOSERS):
        k -= 1
    return text[k] in _STOPS


def _ends_after_closer(text: str, opener: str, at: int, start: int, pos: int, high: int) -> bool:
    m = _SPACE.match(text, pos, high).end()
    if m >= high:
        return False  # the rest of the block ends here anyway
    if opener in _BRACKETS:
        return _LEAD.match(text, start, at).end() == at and text[m] not in ".,;:!?"
    return _starts(text[m]) and (text[pos].isspace() or text[m] in _OPENERS)


def _running(text: str, low: int, high: int, out: list) -> None:
    units, unclosed = _scan(text, low, high, frozenset())
    if unclosed:
        units, _ = _scan(text, low, high, frozenset(unclosed))
    for s, e in units:
        _put(text, s, e, out)


def _put(text: str, s: int, e: int, out: list) -> None:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    if s < e:
        out.append((s, e))


def _lines(text: str) -> list[tuple[int, int]]:
    at, found = 0, []
    while at < len(text):
        e = _LINE.match(text, at).end()
        found.append((at, e))
        at = e
    return found


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """The units of a text as (start, end), in order."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    kind, begin, end = "", 0, 0  # the open block: "", text or item
    levels: list[int] = []  # the indents of the open list items, the innermost last

    def flush() -> None:
        nonlocal kind
        if kind == "text":
            _running(text, begin, end, out)
        elif kind == "item":
            _put(text, begin, end, out)
        kind = ""

    lines, at = _lines(text), 0
    while at < len(lines):
        s, e = lines[at]
        at += 1
        line = text[s:e]
        if line.isspace() or not line:
            flush()
            levels.clear()
        elif f := _FENCE.match(line):
            flush()
            mark = f[1]
            while at < len(lines):
                s2, e = lines[at]
                at += 1
                body = text[s2:e].strip()
                if body.startswith(mark) and not body.strip(mark[0]):
                    break
            _put(text, s, e, out)
        elif _HEADING.match(line):
            flush()
            _put(text, s, e, out)
        elif _BULLET.match(line) or _is_numbered(line, kind, text, begin, end):
            flush()
            indent = _indent(line)
            while levels and levels[-1] >= indent:
                levels.pop()
            levels.append(indent)
            kind, begin, end = "item", s, e
        elif kind == "item" and not _continues(text, end, line, levels[-1]):
            flush()
            indent = _indent(line)
            while levels and levels[-1] >= indent:
                levels.pop()
            kind, begin, end = "item" if levels else "text", s, e
        elif kind:
            end = e
        else:
            kind, begin, end = "text", s, e
    flush()
    return out


def _is_numbered(line: str, kind: str, text: str, begin: int, end: int) -> bool:
    m = _NUMBERED.match(line)
    if not m:
        return False
    if kind != "text":
        return True
    k = _last(text, begin, end)
    return m[2] == "1" and k >= begin and text[k] in _STOPS + "\"”»)" and (
        text[k] != "." or _abbreviation(text, k, begin) not in ("never", "number")
    )


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _last(text: str, begin: int, end: int) -> int:
    """The place of the last character of [begin, end) that is no blank; before ``begin`` if there is none."""
    k = end - 1
    while k >= begin and text[k].isspace():
        k -= 1
    return k


def _continues(text: str, end: int, line: str, level: int) -> bool:
    """Does a line without a marker belong to the item above it?"""
    if _indent(line) > level:
        return True
    return line.lstrip()[0].islower() and text[_last(text, 0, end)] not in _STOPS


def sentence_units(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos): the sentence units of each row's text, end exclusive.

    Null, empty and blank texts have no unit; a row with a null id keeps it; repeated rows give
    repeated units; other columns are ignored. Texts are read whole, where they lie, without a shuffle.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for s, e in sentence_spans(t):
                    rows.append(r)
                    starts.append(s)
                    ends.append(e)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_pos", "end_pos"]
            )

    kind = dict(documents.dtypes)[doc_id]
    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc_id), F.col(text))
    return rows.mapInArrow(split, f"doc_id {kind}, start_pos bigint, end_pos bigint")
