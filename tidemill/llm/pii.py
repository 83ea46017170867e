"""Personal information inside free text: candidates, boosted trees, calibrated thresholds, redaction.

1. Generators with high recall propose overlapping spans with a type each: e-mail addresses (also
   written out), digit groups (as phone and as identity number), street addresses in several
   conventions, and runs of capitalised words, initials and known given names.
2. Boosted trees, one model a type, score a span by its format (shape, separators, name tables) and
   its context (words around it, line position). Names of tables and contexts are learnt, not listed.
3. Labels are the values that the entities table gives for a chunk. They are incomplete, so a
   probability is that of being labelled; the mean over held-out labelled spans is the labelling
   rate, and thresholds are calibrated as a share of it, low since contexts are labelled at rates
   that differ several times, while spans that are no case score next to nothing.
4. Spans at or above their type's threshold are taken best first, without overlap.

Only the fit sees a bounded sample: the ``sample`` labelled chunks whose ids hash lowest. Every row of
either table is then scored where it lies, in whole, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.boosting import Boosted

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}
#: labelled chunks the models are fitted on, of up to so many characters each and with so many labels in all
SAMPLE_CHUNKS, SAMPLE_CHARS, SAMPLE_LABELS = 6_000, 20_000, 200_000
#: a type's threshold as a share of its labelling rate
SHARE = 0.12
#: entity types and names that label a type
_LABELS = {"email": "email", "phone": "phone", "SSN": "id_number", "address": "street_address", "person_name": "person_name"}

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)*"
_DOT = r"(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)"
# patterns open with a character class, which the engine searches fast; what may not stand before it is
# looked up behind that first character
_EMAIL = re.compile(
    rf"[A-Za-z0-9](?<![\w.+%@/-].)[\w.+%-]*(?:@| ?[\[(] ?(?:at|AT) ?[\])] ?)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}"
)
_DIGITS = re.compile(r"[+(\d](?<![\w@#$€£.].)(?<!\w[-/:].)(?:[ ()./-]{0,2}\d){6,15}(?![\w%]|[-./:]\d)")
_CODE = re.compile(r"[A-Z](?<![\w-].)[A-Z]?-?\d{6,9}(?:-?[A-Z])?(?![\w-])|\d(?<![\w-].)\d{5,8}-?[A-Z](?![\w-])")
_GROUPS = re.compile(r"\d+").findall
_DATE = re.compile(r"\d{4}-\d\d-\d\d$")
_NUMBER_FIRST = re.compile(
    rf"\d(?<![\w.,:/$#-].)\d{{0,4}}[A-Za-z]?(?: bis| ter)?,? (?:(?:[NSEW]\.|North|South|East|West) )?({_CAP}(?: {_CAP}){{0,3}})"
)
_STREET_FR = re.compile(
    rf"\d(?<![\w.,:/$#-].)\d{{0,3}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|quai|chemin|allée|impasse|cours|route|ruelle)"
    rf"(?: (?:de|du|des|la|le|les|aux?))* ?(?:[ld][’'])?{_CAP}(?: {_CAP}){{0,2}}"
)
_STREET_ES = re.compile(
    rf"\b(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Carrera|Travesía|Via|Viale|Piazza)"
    rf"(?: (?:de|del|la|las|los|el))* {_CAP}(?: {_CAP}){{0,3}},? \d{{1,4}}(?!\w)"
)
_STREET_DE = re.compile(
    r"[A-ZÄÖÜ](?<![\w-].)(?:[\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer|ring|steig|hof|markt)"
    r"|[\wäöüß-]+ (?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz)) \d{1,4}[a-z]?(?!\w)"
)
# words without which the pattern of a convention cannot match
_IN_FR = frozenset("rue avenue boulevard place quai chemin allée impasse cours route ruelle".split())
_IN_ES = frozenset("Calle Avenida Avda Avda. Plaza Paseo Camino Ronda Carrera Travesía Via Viale Piazza".split())
_IN_DE = tuple("straße strasse str. weg gasse allee platz damm ufer ring steig hof markt Straße Strasse Str. Weg Gasse Allee Platz".split())
_TOKEN = re.compile(r"[A-ZÀ-ÖØ-Þ](?<![\w@.’'/-].)(?:\.|[\w'’]*(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)*)(?![\w@])")
_LOWER_PAIR = re.compile(r"(?<![\w@.’'/+-])[a-zà-öø-þ]+(?:-[a-zà-öø-þ]+)?(?: [a-z]\.)? [a-zà-öø-þ]{3,}(?:-[a-zà-öø-þ]+)?(?![\w@-])")
_EDGE = "*_()[]{}<>«»“”\"'.,;:!?"


_SHAPES = str.maketrans({c: "9" for c in "0123456789"} | {chr(c): "A" for c in range(65, 91)} | {chr(c): "a" for c in range(97, 123)})


def _shape(s: str) -> str:
    return s.translate(_SHAPES)


def candidates(text: str, givens: dict) -> list[tuple[str, int, int]]:
    """(type, start, end) of all proposed spans; they may overlap."""
    out: list[tuple[str, int, int]] = []
    if "@" in text or "at]" in text or "at)" in text or "AT]" in text or "AT)" in text or "at ]" in text or "at )" in text:
        out += [("email", *m.span()) for m in _EMAIL.finditer(text)]
    for m in _DIGITS.finditer(text):
        s, e = m.span()
        if _DATE.match(text, s, e) or (not text[s].isdigit() and sum(map(str.isdigit, text[s:e])) < 7):
            continue
        if text[s] == "(" and ")" not in text[s:e]:
            s += 1
        out += [("phone", s, e), ("id_number", s, e)]
    out += [("id_number", *m.span()) for m in _CODE.finditer(text)]
    for m in _NUMBER_FIRST.finditer(text):
        s, at, e = m.start(), m.start(1), m.end()
        ends = [at + k.end() for k in re.finditer(_CAP, text[at:e])]
        out += [("street_address", s, x) for x in ends[:4]]
    split = text.split()
    if not _IN_FR.isdisjoint(split):
        out += [("street_address", *m.span()) for m in _STREET_FR.finditer(text)]
    if not _IN_ES.isdisjoint(split):
        out += [("street_address", *m.span()) for m in _STREET_ES.finditer(text)]
    if [w for w in split if w.endswith(_IN_DE)]:
        out += [("street_address", *m.span()) for m in _STREET_DE.finditer(text)]
    words = [m.span() for m in _TOKEN.finditer(text)]
    for i in range(len(words) - 1):
        (s, e), (s2, e2) = words[i], words[i + 1]
        gap = text[e:s2]
        if gap == " " or gap == "\n":
            if text[e2 - 1] != ".":
                out.append(("person_name", s, e2))
            elif i + 2 < len(words) and text[e2 : words[i + 2][0]] == " " and text[e - 1] != "." and text[words[i + 2][1] - 1] != ".":
                out.append(("person_name", s, words[i + 2][1]))
        elif gap == ", " and text[e - 1] != ".":
            out.append(("person_name", s, e2))
            if i + 2 < len(words) and text[e2 : words[i + 2][0]] == " " and text[words[i + 2][1] - 1] == ".":
                out.append(("person_name", s, words[i + 2][1]))
    if givens and not givens.keys().isdisjoint(split):
        for m in _LOWER_PAIR.finditer(text):
            at = m.start()
            for w in m[0].split():
                if w in givens and at == m.start():
                    out.append(("person_name", *m.span()))
                at += len(w) + 1
            # pairs overlap: also the one that starts at the second word
            second = text.find(" ", m.start(), m.end()) + 1
            if text[second : m.end()] in givens and (n := _LOWER_PAIR.match(text, second)):
                out.append(("person_name", *n.span()))
    return out


class _Names:
    """Tables of name parts and of common words, counted over the sample."""

    def __init__(self) -> None:
        self.given, self.family, self.tail, self.lower = Counter(), Counter(), Counter(), Counter()

    def add(self, value: str) -> None:
        first, last = split_name(value)
        for g in first:
            self.given[g] += 1
        for f in last:
            self.family[f] += 1
            self.tail[f[-3:]] += 1

    def freeze(self) -> None:
        """Logarithms of the counts, for fast look-up."""
        self.logs = [{k: math.log1p(n) for k, n in c.items()} for c in (self.given, self.family, self.tail, self.lower)]


def split_name(value: str) -> tuple[list[str], list[str]]:
    """Given and family name parts in lower case, initials left out."""
    if "," in value:
        family, _, given = value.partition(",")
    else:
        given, _, family = value.replace("\n", " ").rpartition(" ")
    first, last = given.lower().replace("-", " ").split(), family.lower().replace("-", " ").split()
    return [p for p in first if p[-1] != "."], [p for p in last if p[-1] != "."]


def _around(text: str, s: int, e: int) -> tuple[str, str, str, bool, bool]:
    """The two words before, the word after, and whether the span starts or ends its line."""
    before = text[max(0, s - 40) : s]
    line = before.rpartition("\n")[2]
    words = line.split()
    p1 = words[-1].strip(_EDGE).lower() if words else ""
    p2 = words[-2].strip(_EDGE).lower() if len(words) > 1 else ""
    after = text[e : e + 24].partition("\n")[0].split(None, 1)
    n1 = after[0].lower() if after else ""
    return p1, p2, n1, not line.strip(_EDGE + "- "), not after


def describe(text: str, kind: str, s: int, e: int, around: tuple) -> tuple[str, ...]:
    """The categories whose label rates are features: words before, words after, shape."""
    p1, p2, n1, _, _ = around
    shape = _shape(text[s:e]) if kind in ("phone", "id_number") else text[s:e].rpartition(" ")[2].lower()
    return p1, p2 + " " + p1, n1.strip(_EDGE), shape


class PiiModel:
    """The fitted models; small enough to be sent to every task."""

    def __init__(self) -> None:
        self.names = _Names()
        self.rates: dict[str, list[dict[str, float]]] = {}
        self.trees: dict[str, Boosted] = {}
        self.thresholds: dict[str, float] = {}

    def features(self, text: str, kind: str, s: int, e: int, blank: bool = False) -> list[float]:
        value = text[s:e]
        around = _around(text, s, e)
        _, _, n1, starts, ends = around
        cats = describe(text, kind, s, e, around)
        rates = [r.get(c, -9.0) for r, c in zip(self.rates[kind], cats)]
        if blank:
            rates[:3] = [-9.0] * 3
            starts = ends = True
        before, after = (" ", " ") if blank else (text[s - 1] if s else " ", text[e] if e < len(text) else " ")
        row = rates + [
            float(starts), float(ends), float(before in "*_"), float(before in "/@.:-_&#"), float(after in ":"),
            float(after in "@/-_&#"), float(after.isspace()), float(n1.startswith("&")), float(len(value)),
        ]
        if kind == "person_name":
            first, last = split_name(value)
            given, family, tail, lower = self.names.logs
            g = [given.get(w, 0.0) for w in first] or [-1.0]
            f = [family.get(w, 0.0) for w in last] or [-1.0]
            row += [
                float("," in value), float("." in value), float(value.isupper()), float(value.islower()), float("-" in value),
                float(len(first)), float("\n" in value), min(g), max(g), min(f), min([tail.get(w[-3:], 0.0) for w in last] or [-1.0]),
                max([lower.get(w, 0.0) for w in first] or [-1.0]), max([lower.get(w, 0.0) for w in last] or [-1.0]),
                max([family.get(w, 0.0) for w in first] or [-1.0]), max([given.get(w, 0.0) for w in last] or [-1.0]),
            ]
        elif kind in ("phone", "id_number"):
            groups = _GROUPS(value)
            digits = "".join(groups)
            row += [
                float(len(digits)), float(len(groups)), float(value[0] == "+"), float("(" in value), float("-" in value),
                float("." in value), float("/" in value), float(" " in value), float(value[0].isalpha()), float(value[-1].isalpha()),
                float(digits[0]), float(len(groups[0])), float(len(groups[-1])), float(digits[-7:-4] == "555"),
            ]
        elif kind == "street_address":
            words = value.split()
            row += [float(len(words)), float(value[0].isdigit()), float(value[-1].isdigit()), float(any(w in ("rue", "de", "del", "la") for w in words)), float(value.isupper()),
                    self.names.logs[3].get(words[-1].lower(), 0.0)]
        else:
            local = re.split(r"@| ?[\[(]", value, maxsplit=1)[0].lower()
            row += [float("@" in value), float(len(local)), float(value.isupper()), float(local == "git"), float(value.count("."))]
        return row

    def score(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """For each text the chosen spans: (start, end, type, probability)."""
        spans: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        rows: dict[str, list[list[float]]] = defaultdict(list)
        for i, t in enumerate(texts):
            for kind, s, e in candidates(t, self.names.given):
                if kind in self.trees and not (kind == "person_name" and self._plain(t[s:e])):
                    spans[kind].append((i, s, e))
                    rows[kind].append(self.features(t, kind, s, e))
        found: list[list] = [[] for _ in texts]
        for kind, at in spans.items():
            p = self.trees[kind].predict(np.array(rows[kind]))
            keep = self.thresholds[kind]
            for (i, s, e), x in zip(at, p):
                if x >= keep:
                    found[i].append((x / keep, s - e, s, e, kind, x))
        return [_without_overlap(f) for f in found]

    def _plain(self, value: str) -> bool:
        """Does neither part of a run point to a name, or is its given name all common words or no word?"""
        first, last = split_name(value)
        given, family, _, lower = self.names.logs
        if not last or any(len(w) < 2 for w in first):
            return True
        if not first:
            return False
        known = [w for w in first if w in given]
        return not known and ("." not in value) and (all(lower.get(w, 0.0) > 1 for w in first) or not any(w in family for w in last))


def _without_overlap(found: list) -> list[tuple[int, int, str, float]]:
    taken: list = []
    for _, _, s, e, kind, x in sorted(found, key=lambda f: (-round(f[0], 3), f[1], f[2])):
        if all(e <= a or s >= b for a, b, _, _ in taken):
            taken.append((s, e, kind, float(x)))
    return sorted(taken)


def fit(chunks: DataFrame, entities: DataFrame, sample: int = SAMPLE_CHUNKS, seed: int = 7) -> PiiModel:
    """Models from the values that ``entities`` gives for a bounded sample of ``chunks``.

    The driver sees at most ``sample`` texts of ``SAMPLE_CHARS`` characters and ``SAMPLE_LABELS`` different
    labels, whatever the tables hold and however often a label is repeated. A type without any labelled span gets no model and is not found.
    """
    named = entities.where("chunk_id is not null and entity_value is not null")
    lowest = F.xxhash64("chunk_id"), F.col("chunk_id")
    picked = F.broadcast(named.select("chunk_id").distinct().orderBy(*lowest).limit(sample))
    texts = (
        chunks.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).join(picked, chunks["id"] == picked["chunk_id"], "left_semi")
        .select("id", "text").dropDuplicates(["id"])
    )
    values = (
        named.where(F.col("entity_name").isin(*_LABELS)).join(picked, "chunk_id", "left_semi")
        .select("chunk_id", "entity_name", F.trim("entity_value").alias("v")).distinct().orderBy(*lowest, "entity_name", "v").limit(SAMPLE_LABELS)
    )
    labels: dict[int, set] = defaultdict(set)
    model, t = PiiModel(), None
    for c, n, v in values.toPandas().itertuples(index=False):
        labels[c].add((_LABELS[n], v.strip()))
    data = sorted(texts.toPandas().itertuples(index=False))
    rng = np.random.default_rng(seed)
    parts = {c: int(rng.integers(3)) for c, _ in data}
    for _, t in data:
        model.names.lower.update(w for w in re.findall(r"(?<![\w@.+-])[a-zà-öø-þ]{2,}(?![\w@-])", t))
    # name tables come from one part only while the trees learn on others: else a span's own label would
    # be among its features
    _add_names(model, labels, [c for c, _ in data if parts[c] == 0])
    cases: dict[str, list] = defaultdict(list)
    for c, t in data:
        for kind, s, e in candidates(t, model.names.given):
            if kind == "person_name" and model._plain(t[s:e]):
                continue
            cases[kind].append((parts[c], t, s, e, (kind, t[s:e]) in labels[c]))
    for kind, rows in cases.items():
        if any(y for *_, y in rows):
            _fit_type(model, kind, rows)
    _add_names(model, labels, [c for c, _ in data if parts[c] > 0])
    return model


def _add_names(model: PiiModel, labels: dict, chunks: list) -> None:
    for c in chunks:
        for kind, v in sorted(labels.get(c, ())):
            if kind == "person_name":
                model.names.add(v)
    for g, n in model.names.given.items():  # names that some write in lower case are no common words
        if n > 2 and model.names.lower[g] < 0.2 * n:
            model.names.lower.pop(g, None)
    model.names.freeze()


def _fit_type(model: PiiModel, kind: str, rows: list) -> None:
    """Label rates from the first part, trees from the second, the threshold from the third."""
    counts: list[dict] = [defaultdict(lambda: [0, 0]) for _ in range(4)]
    total = [1, 2]
    for part, t, s, e, y in rows:
        if part == 0:
            total[0] += y
            total[1] += 1
            for k, c in zip(counts, describe(t, kind, s, e, _around(t, s, e))):
                k[c][0] += y
                k[c][1] += 1
    mean = total[0] / total[1]
    rate = lambda a, n: math.log((a + 2 * mean) / (n - a + 2 * (1 - mean)))
    model.rates[kind] = [{c: rate(a, n) for c, (a, n) in k.items() if n > 1} for k in counts]
    train = [r for r in rows if r[0]]
    x = np.array([model.features(t, kind, s, e) for _, t, s, e, _ in train])
    y = np.array([float(r[4]) for r in train])
    part = np.array([r[0] for r in train])
    # the same spans once more without their context: values of the entities table stand alone
    bare = np.array([model.features(t, kind, s, e, blank=True) for _, t, s, e, _ in train])
    fit = part == 1
    if not y[fit].any() or not y[~fit].any():
        fit = np.ones(len(y), bool)
    weight = np.r_[np.ones(fit.sum()), np.full(fit.sum(), 0.3)]
    trees = Boosted().fit(np.r_[x[fit], bare[fit]], np.r_[y[fit], y[fit]], weight)
    held = ~fit if (~fit).any() else fit
    p = trees.predict(x[held])
    model.trees[kind] = trees
    model.thresholds[kind] = float(np.mean(p[y[held] > 0])) * SHARE


def find_pii(df: DataFrame, model: PiiModel, id_col: str, text: str) -> DataFrame:
    """(row_id, start_pos, end_pos, pii_type, value, score): the spans chosen in each row's text.

    Null and empty texts have none; repeated rows give repeated spans; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = sent.value.score(texts)
            flat = [(i, s, e, k, texts[i][s:e], x) for i, spans in enumerate(found) for s, e, k, x in spans]
            i, s, e, k, v, x = zip(*flat) if flat else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(i, pa.int64())), pa.array(s, pa.int32()), pa.array(e, pa.int32()),
                 pa.array(k, pa.string()), pa.array(v, pa.string()), pa.array(x, pa.float64())],
                names=["row_id", "start_pos", "end_pos", "pii_type", "value", "score"],
            )

    kind = dict(df.dtypes)[id_col]
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(id_col), F.col(text))
    return rows.mapInArrow(run, f"row_id {kind}, start_pos int, end_pos int, pii_type string, value string, score double")


def redact(df: DataFrame, model: PiiModel, id_col: str, text: str) -> DataFrame:
    """(row_id, redacted): each row's text with every chosen span replaced by its type's placeholder.

    All rows are kept; null and empty texts stay as they are, and so does the text around the spans.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[str | None] = []
            for t, spans in zip(texts, sent.value.score([t or "" for t in texts])):
                for s, e, kind, _ in reversed(spans):
                    t = t[:s] + PLACEHOLDERS[kind] + t[e:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row_id", "redacted"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, f"row_id {kind}, redacted string")


def redact_tables(chunks: DataFrame, entities: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """(table_name, row_id, redacted): every row of both tables, its text with typed placeholders."""
    model = model or fit(chunks, entities)
    one = redact(chunks, model, "id", "text").select(F.lit("chunks").alias("table_name"), "row_id", "redacted")
    return one.unionByName(redact(entities, model, "id", "entity_value").select(F.lit("entities").alias("table_name"), "row_id", "redacted"))


def pii_of_tables(chunks: DataFrame, entities: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """(table_name, row_id, pii_type, value): the distinct values found in each row of both tables."""
    model = model or fit(chunks, entities)
    one = find_pii(chunks, model, "id", "text").select(F.lit("chunks").alias("table_name"), "row_id", "pii_type", "value")
    two = find_pii(entities, model, "id", "entity_value").select(F.lit("entities").alias("table_name"), "row_id", "pii_type", "value")
    return one.unionByName(two).distinct()
