"""Entities of texts by pattern rules: text -> rows (type, name, value), in one pass where a text lies.

A rule is a row of ``RULES``: a compiled pattern, the words without which it cannot match, and what to
make of a match. A text is looked through for a rule's words before its pattern runs; of a text's rows
that are equal by (type, name, first 50 characters of the value), in lower case, the first stays. No
row leaves its task before the result, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import spread

# The rules' patterns and word lists.
_NAME, _FULL = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*", r"[A-Z][a-z]+\s+[A-Z][a-z]+"
# Where case is ignored and a name comes first, words are taken whole (``++``) and only from their start: what
# follows a name is a blank or a sign, so nothing else could match.
_NAME_FIRST = r"(?<![A-Za-z])[A-Z][a-z]++(?:\s+[A-Z][a-z]++)*"
_FULL_FIRST = r"(?<![A-Za-z])[A-Z][a-z]++\s+[A-Z][a-z]++"
IP_LABELLED = r"(?:IP|ip|address)[:\s]*(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
IP_BARE = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
EMAIL = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b"
PHONE = r"\b(\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b"
URL = r"(https?://[^\s\)\]]+)"
PASSWORD = r"(?i)(?:password|passwd|pwd)[:\s]+[`\"']*([^\s`\"']+)"
TOKEN = r"(?i)(?:token|key|secret|api[_\s]?key)[:\s]+[`\"']*([^\s`\"']{10,})"
EIN = r"(?:EIN)[:\s]*(\d{2}-\d{7})"
SSN = r"(?i)(?:SSN|social)[:\s]*(\d{3}-\d{2}-\d{4})"
ADDRESS = (
    r"(?i)(\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Trail|Street|St|Ave|Avenue|Road|Rd|Blvd|Boulevard|Drive|Dr|Lane|Ln|Way|Court|Ct"
    r"|Place|Pl|Circle|Cir)\s*(?:North|South|East|West|N|S|E|W|NW|NE|SW|SE)?)(?:[,\s]|$)"
)
DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
MONEY = r"(?i)(\$[\d,]+(?:\.\d{2})?(?:/(?:mo|month|year|yr|week|day))?)"
KEY_VALUE = r"(?m)[-•]\s*\*{0,2}([^*:]+?)\*{0,2}\s*:\s*\*{0,2}(.+?)(?:\*{0,2})$"
KEY_TYPES = (
    ("credential", ("password", "token", "key", "secret", "credential")),
    ("config", ("ip", "port", "host", "url", "ssh", "vm", "server")),
    ("person", ("name", "age", "birthday", "phone", "email", "address", "brother", "sister", "son", "daughter", "wife", "husband",
                "father", "mother", "family", "spouse")),
    ("business", ("ein", "llc", "business", "company", "product", "revenue", "sales", "profit", "carrier", "agency")),
    ("seo", ("da", "dr", "seo", "ranking", "keyword", "traffic", "backlink", "domain")),
    ("config", ("model", "version", "cron", "script", "command", "path")),
)
KIN = ("brother", "sister", "daughter", "son", "wife", "husband", "father", "mother", "uncle", "aunt", "cousin", "partner", "girlfriend",
       "boyfriend", "fiancee", "fiance", "ex", "nephew", "niece", "grandpa", "grandma", "grandfather", "grandmother")
_KIN = ("(?:brother|sister|daughter|son|wife|husband|father|mother|uncle|aunt|cousin|nephew|niece|grandpa|grandma|grandfather|grandmother"
        "|partner|girlfriend|boyfriend|fiancee?|ex)")  # fmt: skip
KINSHIP = (
    rf"(?i)({_NAME_FIRST})\s+(?:is|was)\s+(?:(?:\w+)'?s?\s+)?{_KIN}",
    rf"(?i){_KIN}[:\s]+(?:is\s+)?({_NAME})",
    rf"(?i)#+\s*(?:Brother|Sister|Daughter|Son|Wife|Husband|Father|Mother)[:\s]+({_NAME})",
)
AGES = (
    r"(?i)(?:at|age|aged?)\s+(\d{1,3})\s+(?:years?\s+old|yo)",
    r"(?i)(\d{1,3})\s+years?\s+old",
    r"(?i)(?:At|age|aged?)\s+(\d{1,3})[,\s]",
)
ROLE = rf"(?i)({_NAME_FIRST})\s+(?:is|was|works as|serves as)\s+(?:a|an|the)\s+([a-z][a-z\s]+?)(?:\.|,|$)"
STATES = (
    "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas"
    "|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire"
    "|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina"
    "|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming"
)
PRODUCT = r"(?i)((?:SR-?22|FR-?44|non-?owner|broad\s*form)\s+(?:insurance|policy|filing|coverage))"
FICTION = (
    rf"(?i)(?:character|protagonist|antagonist|villain|hero)s?\s*(?:include|are|:)\s*({_NAME})",
    rf"(?i)({_NAME_FIRST}),?\s+(?:a\s+)?(?:former\s+)?(?:police|intelligence|criminal|operative|agent|assassin|hacker|officer)",
    r"(?i)(?:known as|figures? such as|called)\s+([A-Z][a-z]+(?:(?:\s*,\s*|\s+and\s+)[A-Z][a-z]+)*)",
    r"(?i)(?:organization|group|syndicate|gang|cartel)\s+(?:known as|called)\s+(?:the\s+)?([A-Z][A-Za-z\s]+?)(?:\.|,|$)",
)
PERSON = (
    rf"(?i)(?:New hire|new hire|Welcome|welcome)[^.]*?({_FULL})",
    rf"({_FULL})\s*\(?(?:NX-\d+)\)?",
    rf"(?i)(?:Team transfer|transfer|Transfer)[:\s]+({_FULL})",
    rf"(?i)(?:Directory entry|directory)[:\s]+({_FULL})",
    rf"({_FULL})\s+[-—]\s+[A-Z][a-z]",
    rf"(?i)(?:from|by)\s+({_FULL})(?:\s*:|,)",
    rf"(?i)({_FULL_FIRST})\s+(?:is\s+)?(?:allergic|has\s+an?\s+allergy)",
    rf"(?i)({_FULL_FIRST})(?:'s?\s+)(?:pet|hobby|hobbies|birthday|allergy|allergies|diet|favorite|seat|desk)",
    rf"(?i)({_FULL_FIRST})\s+(?:mentioned|said|brought|shared|announced|reported|confirmed|noted)",
)
EMPLOYEE_NEAR = rf"({_FULL})\s*\(?(NX-\d+)\)?"
EMPLOYEE = r"(NX-\d{3,5})"
FACTS = (
    (rf"(?i)({_FULL_FIRST})\s+is\s+allergic\s+to\s+(\w+(?:\s+\w+)?)", "allergy"),
    (rf"(?i)({_FULL_FIRST})\s+has\s+(?:a|an)\s+(\w+)\s+allergy", "allergy"),
    (rf"(?i)({_FULL_FIRST})(?:'s?\s+)(?:pet|dog|cat|bird|fish|rabbit|hamster)\s+(?:is\s+)?(?:named\s+)?(\w+)", "pet"),
    (rf"(?i)({_FULL_FIRST})\s+brought\s+(\w+)\s+\((?:their|his|her)\s+(?:dog|cat|pet)", "pet"),
    (rf"(?i)({_FULL_FIRST})\s+(?:sits?\s+(?:at|in)|desk\s+(?:is|at))\s+([A-Z0-9][\w-]+)", "seat"),
    (rf"(?i)({_FULL_FIRST})(?:'s?\s+hobb(?:y|ies)\s+(?:is|are|include)\s+)(\w+(?:\s+\w+)?)", "hobby"),
    (rf"(?i)({_FULL_FIRST})\s+(?:enjoys?|likes?|into|loves?)\s+(\w+(?:\s+\w+)?)", "hobby"),
    (rf"(?i)({_FULL_FIRST})\s+(?:is\s+)?joining\s+.*?(?:starting|on)\s+(\d{{4}}-\d{{2}}-\d{{2}})", "join_date"),
    (rf"(?i)({_FULL_FIRST}).*?(?:from|based in|lives in|located in)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", "hometown"),
)
STRUCTURED = r"([A-Z][a-z]{1,15}\s+[A-Z][a-z]{1,20})\s+(?:is|was|will|has|from|on the|at|—|-)"
NO_NAMES = ("New Hire", "Team Transfer", "Directory Entry", "Project Mercury", "Account Review", "Sprint Planning", "Security Credential",
            "Date Monday", "Date Tuesday", "Date Wednesday", "Date Thursday", "Date Friday", "Date Saturday", "Date Sunday")


#: how far the rules on money, ages and employees look back
_MONEY_BACK, _AGE_BACK, _EMPLOYEE_BACK = 40, 60, 80
_ONE_NAME, _TWO_NAMES = re.compile(f"({_NAME})"), re.compile(f"({_FULL})")

Row = tuple[str, str, str]


class Rule(NamedTuple):
    """``make`` gives the rows of a match in a text; ``words``, in lower case, are what the pattern needs one of."""

    name: str
    pattern: re.Pattern
    words: tuple[str, ...]
    make: Callable[[re.Match, str], list[Row]]


def _value(kind: str, name: str) -> Callable:
    return lambda m, text: [(kind, name, m[1])]


def _ip(m: re.Match, text: str) -> list[Row]:
    """Named by what stands before the first colon of its line; the last character of a text is not looked at."""
    begin, end = max(0, text.rfind("\n", 0, m.start())), text.find("\n", m.end())
    line = text[begin:end]
    return [("ip", line.partition(":")[0].strip(" -•*") if ":" in line else "ip", m[1])]


def _bare_ip(m: re.Match, text: str) -> list[Row]:
    return [("ip", "ip_address", m[1])] if all(int(part) < 256 for part in m[1].split(".")) else []


def _phone(m: re.Match, text: str) -> list[Row]:
    return [("phone", "phone", m[1])] if sum(c.isdecimal() for c in m[1]) == 10 else []


def _url(m: re.Match, text: str) -> list[Row]:
    return [("url", "url", m[1].rstrip(".,;)"))]


def _money(m: re.Match, text: str) -> list[Row]:
    """Named by the end of what stands before it on its line, or on the line before if nothing does."""
    before = text[max(0, m.start() - _MONEY_BACK) : m.start()].strip().rpartition("\n")[2]
    return [("financial", before[-30:] or "amount", m[1])]


def _key_value(m: re.Match, text: str) -> list[Row]:
    key, value = m[1].strip(), m[2].strip()
    if len(key) >= 50 or len(value) >= 200:
        return []
    low = key.lower()
    return [(next((kind for kind, words in KEY_TYPES if any(w in low for w in words)), "fact"), key, value)]


def _kin(m: re.Match, text: str) -> list[Row]:
    said = m[0].lower()
    return [("person", next((k for k in KIN if k in said), "family"), m[1].strip())]


def _age(m: re.Match, text: str) -> list[Row]:
    owner = _ONE_NAME.search(text[max(0, m.start() - _AGE_BACK) : m.start()])
    return [("person", owner[1] + "_age", m[1])] if owner else [("fact", "age", m[1])]


def _role(m: re.Match, text: str) -> list[Row]:
    who, what = m[1].strip(), m[2].strip()
    return [("person", who + "_role", what)] if len(who) < 40 and len(what) < 60 else []


def _characters(m: re.Match, text: str) -> list[Row]:
    names = (n.strip() for n in re.split(r"\s*,\s*|\s+and\s+", m[1].strip()))
    return [("fiction", "character", n) for n in names if 1 < len(n) < 40]


def _person(m: re.Match, text: str) -> list[Row]:
    name = m[1].strip()
    return [("person", "person_name", name)] if 3 < len(name) < 50 else []


def _badge(m: re.Match, text: str) -> list[Row]:
    return [("person", m[1].strip() + "_employee_id", m[2])]


def _employee(m: re.Match, text: str) -> list[Row]:
    owner = _TWO_NAMES.search(text[max(0, m.start() - _EMPLOYEE_BACK) : m.start()])
    return [("person", owner[1] + "_employee_id" if owner else "employee_id", m[1])]


def _fact(kind: str) -> Callable:
    def make(m: re.Match, text: str) -> list[Row]:
        who, what = m[1].strip(), m[2].strip()
        return [("person", f"{who}_{kind}", what)] if len(who) > 3 and len(what) > 1 else []

    return make


def _structured(m: re.Match, text: str) -> list[Row]:
    name = m[1].strip()
    return [("person", "person_name", name)] if name not in NO_NAMES and len(name) > 4 else []


_KIN_WORDS = ("brother", "sister", "daughter", "son", "wife", "husband", "father", "mother", "uncle", "aunt", "cousin", "nephew", "niece", "grand",
              "partner", "friend", "fianc", "ex")
_PETS = ("pet", "dog", "cat", "bird", "fish", "rabbit", "hamster")
_PERSON_WORDS = (
    ("new hire", "welcome"), ("nx-",), ("transfer",), ("directory",), (" - ", "—"), ("from", "by"), ("allerg",),
    ("pet", "hobb", "birthday", "allerg", "diet", "favorite", "seat", "desk"),
    ("mentioned", "said", "brought", "shared", "announced", "reported", "confirmed", "noted"),
)
_FACT_WORDS = (
    ("allergic",), ("allergy",), _PETS, ("brought",), ("sit", "desk"), ("hobb",), ("enjoy", "like", "into", "love"), ("joining",),
    ("from", "based in", "lives in", "located in"),
)
_FICTION_WORDS = (
    ("character", "protagonist", "antagonist", "villain", "hero"), ("police", "intelligence", "criminal", "operative", "agent", "assassin", "hacker", "officer"),
    ("known as", "such as", "called"), ("known as", "called"),
)


def _rules() -> list[Rule]:
    of = lambda name, pattern, words, make: Rule(name, re.compile(pattern), words, make)
    found = [
        of("ip_labelled", IP_LABELLED, ("ip", "address"), _ip), of("ip_bare", IP_BARE, (".",), _bare_ip), of("email", EMAIL, ("@",), _value("email", "email")),
        of("phone", PHONE, (), _phone), of("url", URL, ("http",), _url), of("password", PASSWORD, ("passw", "pwd"), _value("credential", "password")),
        of("token", TOKEN, ("token", "key", "secret"), _value("credential", "token")), of("ein", EIN, ("ein",), _value("business", "EIN")),
        of("ssn", SSN, ("ssn", "social"), _value("pii", "SSN")), of("address", ADDRESS, (), _value("location", "address")), of("date", DATE, ("-",), _value("date", "date")),
        of("money", MONEY, ("$",), _money), of("key_value", KEY_VALUE, (":",), _key_value),
    ]
    found += [of(f"kinship_{i}", p, _KIN_WORDS, _kin) for i, p in enumerate(KINSHIP)]
    found += [of(f"age_{i}", p, w, _age) for i, (p, w) in enumerate(zip(AGES, (("old", "yo"), ("old",), ("at", "age"))))]
    found.append(of("role", ROLE, (" a", " an", " the", "\na", "\nthe", "\ta", "\tthe"), _role))
    found.append(of("state", rf"(?i)\b({STATES})\b", (), _value("location", "state")))
    found.append(of("product", PRODUCT, ("insurance", "policy", "filing", "coverage"), _value("business", "insurance_product")))
    found += [of(f"fiction_{i}", p, w, _characters) for i, (p, w) in enumerate(zip(FICTION, _FICTION_WORDS))]
    found += [of(f"person_{i}", p, w, _person) for i, (p, w) in enumerate(zip(PERSON, _PERSON_WORDS))]
    found += [of("employee_near", EMPLOYEE_NEAR, ("nx-",), _badge), of("employee", EMPLOYEE, ("nx-",), _employee)]
    found += [of(f"fact_{i}", p, w, _fact(kind)) for i, ((p, kind), w) in enumerate(zip(FACTS, _FACT_WORDS))]
    found.append(of("structured", STRUCTURED, (), _structured))
    return found


RULES = _rules()


def entities_of(text: str, rules: list[Rule] = RULES, skip_urls: tuple[str, ...] = ()) -> list[Row]:
    """The rows of one text, in order of rules and places."""
    low, seen, values, out = text.lower(), set(), set(), []
    for rule in rules:
        if rule.words and not any(w in low for w in rule.words):
            continue
        for m in rule.pattern.finditer(text):
            for kind, name, value in rule.make(m, text):
                if (rule.name == "ip_bare" and value in values) or (rule.name == "url" and any(u in value for u in skip_urls)):
                    continue
                key = kind, name.lower(), value.lower()[:50]
                if key not in seen:
                    seen.add(key)
                    values.add(value.strip())
                    out.append((kind, name.strip(), value.strip()))
    return out


def extract(
    df: DataFrame, id_col: str = "id", text: str = "text", only: tuple[str, ...] | None = None, skip_urls: tuple[str, ...] = ()
) -> DataFrame:
    """(id, entity_type, entity_name, entity_value), distinct by text as said above; ``only`` picks rules by name.

    Null texts have none; repeated rows give repeated entities. URLs that contain one of ``skip_urls`` are left out.
    """
    names = [r.name for r in RULES if only is None or r.name in only]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [r for r in RULES if r.name in names]
        for batch in batches:
            flat = [(i, *e) for i, t in enumerate(batch.column(1).to_pylist()) for e in entities_of(t, rules, skip_urls)]
            i, *columns = zip(*flat) if flat else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(i, pa.int64())), *[pa.array(c, pa.string()) for c in columns]],
                names=["id", "entity_type", "entity_name", "entity_value"],
            )

    kind = dict(df.dtypes)[id_col]
    rows = spread(df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, f"id {kind}, entity_type string, entity_name string, entity_value string")
