"""What a query asks for: intents, dates, time mode, synonyms, names - as columns over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intents with their trigger patterns, boost words and boost patterns (all ignore case).
INTENTS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "age": ((r"\bhow old\b", r"\bage\b", r"\byears? old\b", r"\bbirthday\b", r"\bborn\b"),
            ("old", "age", "years", "born", "birthday"), (r"\d{2,3}\s*years?\s*old", r"at\s+\d{2,3}", r"age\s*\d{2,3}")),
    "location": ((r"\bwhere\s+(?:does|is|do)\b.*\bliv", r"\blocation\b", r"\baddress\b", r"\bcity\b", r"\bstate\b", r"\bwhere.*from\b"),
                 ("living", "located", "lives", "address", "city", "state", "near"), (r"living in|located in|lives in|near\s+\w+",)),
    "relationship": ((r"\bmarried|divorced|spouse|wife|husband|relationship\b", r"\bsingle\b"),
                     ("married", "divorced", "spouse", "wife", "husband", "single"), (r"married|divorced|spouse|wife|husband",)),
    "name": ((r"(?:what(?:'s| is).*(?:full )?name|who is)", r"\bfull name\b"), ("name", "called", "known as"), (r"[A-Z][a-z]+\s+[A-Z][a-z]+",)),
    "children": ((r"\b(?:son|daughter|kid|child|children)(?:'s)?(?:\s+name)?\b", r"\bfamily\b"),
                 ("son", "daughter", "children", "kids", "child", "family"), (r"son|daughter|children|kids",)),
    "credential": ((r"\b(?:password|token|key|secret|credential|login|ssh)\b",),
                   ("password", "token", "key", "secret", "credential", "ssh", "login"), (r"password|token|key|secret|credential",)),
    "config": ((r"\b(?:ip|port|host|server|config|setting|url)\b",),
               ("ip", "port", "host", "server", "config", "address"), (r"\d+\.\d+\.\d+\.\d+|port\s*\d+",)),
    "health": ((r"\b(?:weight|health|medication|diet|exercise|medical|doctor)\b",),
               ("weight", "health", "medication", "diet", "pounds", "doctor"), (r"\d+\s*(?:pounds|lbs|kg)",)),
    "hobby": ((r"\b(?:hobby|hobbies|interest|leisure|fun|enjoy)\b",), ("hobby", "hobbies", "interest", "enjoy"), (r"hobby|hobbies|interest|enjoy|leisure",)),
    "writing": ((r"\b(?:book|novel|writing|fiction|story|character|author)\b",),
                ("book", "novel", "writing", "fiction", "story", "character"), (r"novel|fiction|book|writing",)),
    "financial": ((r"\b(?:money|cost|price|revenue|salary|income|budget|investment)\b",),
                  ("money", "cost", "price", "revenue", "salary", "budget"), (r"\$[\d,]+|\d+\s*(?:dollars|USD)",)),
    "timeline": ((r"\bwhat happened\b", r"\bwhen did\b", r"\btimeline\b"), ("happened", "event", "timeline", "date"), (r"\d{4}-\d{2}-\d{2}",)),
}

# Patterns of the three time modes.
RECENCY = (
    r"\blast\s+time\b", r"\bmost\s+recent\b", r"\blatest\b",
    r"\blast\b.*\b(?:update|change|email|sent|created|published|deployed|fixed|broke|issue|rotated)\b",
    r"\brecently\b", r"\blast\s+(?:week|month|day)\b", r"\bcurrent(?:ly)?\b", r"\bnow\b", r"\btoday\b", r"\bpresent\b",
)
WHEN = (r"\bwhen\s+(?:did|was|were|is|has)\b", r"\bwhat\s+date\b", r"\bwhat\s+day\b", r"\bhow\s+long\s+ago\b", r"\bfirst\s+time\b")
_FULL = "January|February|March|April|May|June|July|August|September|October|November|December"
_ABBR = "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
SPECIFIC_DATE = (
    rf"\bon\s+(?:{_FULL}|{_ABBR})\s+\d{{1,2}}", r"\bon\s+\d{4}-\d{2}-\d{2}\b", r"\bon\s+\d{1,2}/\d{1,2}",
    rf"\b(?:{_FULL})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:[,\s]+\d{{4}})?\b",
)

# The built-in synonyms.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "ip": ("ip", "ip address", "network address", "host"),
    "ssh": ("ssh", "remote access", "secure shell", "login"),
    "password": ("password", "credential", "secret", "passphrase"),
    "token": ("token", "api key", "secret", "credential"),
    "vm": ("vm", "virtual machine", "server", "instance"),
    "gpu": ("gpu", "graphics card", "video card"),
    "dns": ("dns", "domain name", "nameserver"),
    "seo": ("seo", "search engine optimization", "ranking"),
    "brother": ("brother", "sibling", "family"),
    "sister": ("sister", "sibling", "family"),
    "daughter": ("daughter", "child", "kids", "family"),
    "son": ("son", "child", "kids", "family"),
    "kids": ("kids", "children", "son", "daughter"),
    "children": ("children", "kids", "son", "daughter"),
    "family": ("family", "kids", "children", "wife", "brother", "sister"),
    "book": ("book", "novel", "story", "writing", "fiction"),
    "novel": ("novel", "book", "story", "fiction"),
    "veteran": ("veteran", "military", "army", "service"),
    "military": ("military", "army", "veteran", "service"),
    "weight": ("weight", "pounds", "lbs", "weight loss"),
    "boat": ("boat", "jet boat", "boating", "watercraft"),
    "football": ("football", "nfl", "sports"),
}
# Words that hint at a type of chunk; months by their first letters.
CONFIG_WORDS = ("ip", "password", "token", "ssh", "login", "credential")
FACT_WORDS = ("birthday", "name", "address", "phone", "email", "who is")
# Words that are no names, however they are written.
NO_NAMES = frozenset(
    "what who where when how why which is are was were the a an in on at to for of and or but do does did has have had be been being with about tell me "
    "give show find search look up can you i my his her their current status update info data details latest report summary metrics please question any "
    "food last team work person".split()
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = f"{_FULL}|{_ABBR}"


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def has_words(query: Column) -> Column:
    """Is anything left of a query without its punctuation?"""
    return F.trim(F.regexp_replace(query, r"[^\p{L}\p{N}_\s]", "")) != ""


def sanitized(query: Column) -> Column:
    """Punctuation but the underscore as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"[!-/:-@\[-^`{-~]", " "), r"\s+", " "))


def intents(query: Column) -> Column:
    """The names of all intents a query triggers, in the catalogue's order."""
    return F.array_compact(F.array(*[F.when(any_match(query, p), F.lit(n)) for n, (p, _, _) in INTENTS.items()]))


def temporal_mode(query: Column) -> Column:
    return (
        F.when(any_match(query, SPECIFIC_DATE), "specific_date")
        .when(any_match(query, RECENCY), "recency")
        .when(any_match(query, WHEN), "when")
    )


def date_patterns(query: Column, default_year: int | Column) -> Column:
    """The dates a query names, as ``YYYY-MM-DD`` and, if not written so, also ``MM-DD``."""
    year = default_year if isinstance(default_year, Column) else F.lit(str(default_year))
    named = rf"(?i)\b({MONTH_NAMES})\s+(\d{{1,2}})(?:[,\s]+(\d{{4}}))?\b"
    month, day, named_year = (F.regexp_extract(query, named, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(month, 1, 3)))
    md1 = F.concat_ws("-", F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    iso = F.regexp_extract(query, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    slash = r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b"
    m2, d2, y2 = (F.regexp_extract(query, slash, i) for i in (1, 2, 3))
    y2 = F.when(F.length(y2) == 2, F.concat(F.lit("20"), y2)).otherwise(y2)
    md2 = F.concat_ws("-", F.lpad(m2, 2, "0"), F.lpad(d2, 2, "0"))
    full = lambda y, md: F.concat_ws("-", F.coalesce(F.nullif(y, F.lit("")), year), md)
    return F.array_distinct(F.array_compact(F.array(
        F.when(month != "", full(named_year, md1)), F.when(month != "", md1), F.nullif(iso, F.lit("")),
        F.when(m2 != "", full(y2, md2)), F.when(m2 != "", md2),
    )))


def expansion(query: Column, synonyms: dict[str, tuple[str, ...]] | None = None, most: int = 5) -> Column:
    """Up to ``most`` synonyms of the query's words, in the dictionary's order, none equal to its word."""
    found = [
        F.when(query.rlike(rf"(?i)\b{k}\b"), F.array(*[F.lit(s) for s in v if s != k])).otherwise(F.array().cast("array<string>"))
        for k, v in (SYNONYMS if synonyms is None else synonyms).items()
    ]
    return F.slice(F.array_distinct(F.flatten(F.array(*found))), 1, most)


def expanded(query: Column, synonyms: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The query with its synonyms behind it: what is embedded."""
    return F.concat_ws(" ", query, F.array_join(expansion(query, synonyms), " "))


def proper_nouns(query: Column) -> Column:
    """The capitalised words of a query, without signs, that are no common words, in order."""
    words = F.transform(F.split(query, r"\s+"), lambda w: F.regexp_replace(w, r"(?U)[^\w']", ""))
    return F.filter(words, lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*sorted(NO_NAMES)))


def type_hint(query: Column) -> Column:
    """``config`` or ``fact`` if the query holds a word of either group (the first wins), else null."""
    q = F.lower(query)
    return F.when(contains_any(q, CONFIG_WORDS), "config").when(contains_any(q, FACT_WORDS), "fact")
