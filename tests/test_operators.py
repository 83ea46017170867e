"""Operators without SQL, and edge cases of those with it."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions.text import path_stem, tokens, unaccent
from tidemill.operators import chunking, entities, models, store, transcripts, understand, vector
from tidemill.operators.bm25 import keyword_scores
from tidemill.plans import hybrid, ingest


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


def test_tokens_fold_diacritics_and_split(spark):
    assert one(spark, tokens, "Crème BRÛLÉE_x 9k—Straße") == ["creme", "brulee", "x", "9k", "straße"]
    assert one(spark, unaccent, "é́ñ") == "en"
    assert one(spark, path_stem, "a/b.c/notes.v2.md") == "notes.v2" and one(spark, path_stem, "x") == "x"


def test_bm25_equals_the_formula(spark):
    docs = [(1, "red fox red"), (2, "red dog"), (3, "blue dog barks loud"), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame([(1, "red!"), (2, "DOG red"), (3, "..."), (4, "cat"), (5, None)], "query_id long, query string")
    got = {(r.query_id, r.id): r.score for r in keyword_scores(d, q).collect()}
    avg = (3 + 2 + 4) / 5

    def part(tf, n, size):
        return max(math.log((5 - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg))

    assert set(got) == {(1, 1), (1, 2), (2, 2)}
    assert got[1, 1] == pytest.approx(part(2, 2, 3)) and got[2, 2] == pytest.approx(part(1, 2, 2) * 2)


def test_sections_and_greedy_split(spark):
    text = "intro\n# One\n" + "\n\n".join("a" * 50 for _ in range(5)) + "\n## Two\nshort"
    rows = spark.createDataFrame([("notes/x.md", text), ("b.md", "  \n"), ("c.md", None)], "file_path string, text string")
    got = [r.asDict() for r in chunking.chunk_files(rows, max_chars=120).orderBy("line_start").collect()]
    assert [r["heading"] for r in got] == [None, "One", "One", "Two"]  # a cut at the first blank line past 120
    assert got[0]["text"] == "[x] intro" and got[-1]["text"] == "[x > Two] ## Two\nshort"
    assert got[1]["line_start"] == 2 and got[2]["has_overlap"] and got[2]["text"].startswith("[x > One] [Section: One]\n" + chunking.OVERLAP_MARK)
    assert all(r["chars"] == len(r["text"]) for r in got)


def _greedy(lines, start, limit):
    out, held, size, begin = [], [], 0, start
    for i, x in enumerate(lines):
        if not x.strip() and size + len(x) + 1 > limit and held:
            out.append((begin, start + i - 1, held))
            held, size, begin = [], 0, start + i + 1
        else:
            held = [*held, x]
            size += len(x) + 1
    return out + ([(begin, start + len(lines) - 1, held)] if held else [])


def test_sections_and_pieces_equal_brute_force(spark):
    rng = random.Random(9)
    some = ["# A b", "## C", "", "  ", "word " * 9, "x", "#no heading", "Ends here. Goes on"]
    texts = ["\n".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", F.explode(chunking.heading_sections(F.col("text"))).alias("s")).select("id", "s.*")
    rows = rows.withColumn("p", chunking.large_split(F.col("body"), F.col("start"), F.lit(90))).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.heading, r.start, list(r.body)))
        assert [(p.start, p.stop, list(p.body)) for p in r.p] == _greedy(list(r.body), r.start, 90)
    for i, t in enumerate(texts):
        want = []
        for at, x in enumerate(t.split("\n"), 1):
            m = re.match(r"#{1,6}\s+(.+)", x)
            if m or not want:
                want.append((m and m[1], at, []))
            want[-1][2].append(x)
        assert got[i] == want


def test_section_without_blank_line_is_never_cut(spark):
    text = "# H\n" + "\n".join("word " * 20 for _ in range(30))
    rows = spark.createDataFrame([("a/2024-02-30-x.md", text)], "file_path string, text string")
    got = chunking.chunk_files(rows).collect()
    assert len(got) == 1 and got[0].text.startswith("Date: 2024-02-30\n[2024-02-30-x > H]")


def test_chunk_types(spark):
    kinds = {"password: x\nport: 8\nhello": "config", "- [ ] do it": "todo", "- a: 1\n- b: 2\n- c: 3": "fact", "plain words": "narrative", "- a: 1": "fact"}
    for text, kind in kinds.items():
        assert one(spark, chunking.chunk_type, text) == kind, text


def test_transcript_lines_to_chunks(spark):
    raw = [
        (1, '{"timestamp": "2024-01-01T10:00:00Z", "message": {"role": "user", "content": "hello there friend"}}'),
        (2, "not json"), (3, ""),
        (4, '{"timestamp": "2024-01-01T10:05:00Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "part one here"}, {"type": "image"}, {"type": "text", "text": "two"}]}}'),
        (5, '{"timestamp": "2024-01-01T10:36:00Z", "message": {"role": "user", "content": "after the pause, %s"}}' % ("x" * 1190)),
        (6, '{"timestamp": "bad", "message": {"role": "user", "content": "no time at all"}}'),
        (7, '{"message": {"role": "tool", "content": "some tool output"}}'),
    ]
    df = spark.createDataFrame([("s/abcdefghij.jsonl", n, v) for n, v in raw], "file_path string, line_num int, value string")
    parsed = transcripts.parse_lines(df)
    assert {r.line_num: r.text for r in parsed.collect()}[4] == "part one here\ntwo"
    kept = transcripts.kept_messages(parsed)
    assert sorted(r.line_num for r in kept.collect()) == [1, 4, 5, 6]
    got = sorted(transcripts.pack(kept).collect(), key=lambda r: r.line_start)
    assert [(r.line_start, r.line_end, r.block, r.part) for r in got] == [(1, 4, 0, 0), (5, 5, 1, 0), (6, 6, 1, 1)]
    assert got[0].text.startswith("Date: Monday, January 01, 2024 (2024-01-01) at 10:00 UTC\nSession: abcdefgh\n\n**User:** hello")


def test_envelope_and_heartbeat(spark):
    env = 'Conversation info (untrusted metadata):\n```json\n{"sender": "Kit"}\n```\n'
    rows = [(1, "user", env + "what is new today"), (2, "user", env + "ok"), (3, "assistant", "HEARTBEAT_OK"),
            (4, "user", "Read HEARTBEAT.md now, reply HEARTBEAT_OK when idle."), (5, "user", "x" * 2100)]
    df = spark.createDataFrame([("s/a.jsonl", n, None, r, t) for n, r, t in rows], "file_path string, line_num int, timestamp string, role string, text string")
    got = {r.line_num: r for r in transcripts.kept_messages(df).collect()}
    assert set(got) == {1, 5} and got[1].sender == "Kit" and got[1].text == "what is new today"
    line = transcripts.message_line(F.col("role"), F.col("sender"), F.col("text"))
    assert transcripts.kept_messages(df).where("line_num = 5").select(line.alias("l")).first().l == "**User:** " + "x" * 2000 + "... [truncated]"


def test_content_is_told_by_its_json_type(spark):
    lines = ['"[ERROR] the disk is full"', '"{not an object}"', '[{"type": "text", "text": "a"}, "b", {"type": "image"}, {"type": "text", "text": "c"}]', '{"text": "x"}', "null", "7"]
    df = spark.createDataFrame([("a", i, '{"timestamp": 5, "message": {"role": "user", "content": %s}}' % c) for i, c in enumerate(lines)], "file_path string, line_num int, value string")
    assert [r.text for r in transcripts.parse_lines(df).orderBy("line_num").collect()] == ["[ERROR] the disk is full", "{not an object}", "a\nc", "", "", ""]
    odd = [("a", 1, "[1]"), ("a", 2, '{"message": "x"}'), ("a", 3, None), ("a", 4, "{}")]
    assert transcripts.parse_lines(spark.createDataFrame(odd, "file_path string, line_num int, value string")).count() == 0


def _pack(lines, limit):
    """Brute force: one chunk if the block fits, else greedy bins."""
    head = len(transcripts.block_header(0, "s0x0"))
    if head + sum(map(len, lines)) + 2 * len(lines) - 2 <= limit:
        return [len(lines)]
    bins, size = [], head
    for x in lines:
        if bins and size + len(x) + 2 > limit:
            bins.append(0)
            size = head
        bins = bins or [0]
        bins[-1] += 1
        size += len(x) + 2
    return bins


def test_packing_at_the_limit(spark):
    """Blocks of exactly 1,200 characters and one or two more; long lines; a session over many spans of lines."""
    head, cases = len(transcripts.block_header(0, "s0x0")), {}
    for i, sizes in enumerate([(500, None), (500, None, 30), (400, 300, None), (None,), (900, 900), (50,) * 60, (3000, 20, 3000)]):
        for extra in range(-1, 5):
            known = [s for s in sizes if s]
            rest = 1200 - head - sum(len("**User:** ") + s for s in known) - 2 * (len(sizes) - 1) - len("**User:** ") + extra
            cases[f"s{i}x{extra + 1}"] = [s or max(1, rest) for s in sizes]
    rows = [(s, n, n * 1000, "user", None, "y" * size) for s, sizes in cases.items() for n, size in enumerate(sizes)]
    rows += [("hot", n, n * 60_000_000 * (40 if n == 9000 else 1) if n != 5 else None, "user", None, "z" * 300) for n in range(9500)]
    df = spark.createDataFrame(rows, "session_id string, line_num int, us long, role string, sender string, text string").repartition(4)
    got = {}
    for r in transcripts.pack(df).orderBy("session_id", "block", "part").collect():
        got.setdefault((r.session_id, r.block), []).append((r.line_end - r.line_start + 1, r.text))
    for s, sizes in cases.items():
        lines = ["**User:** " + "y" * min(2000, size) for size in sizes]
        assert [n for n, _ in got[s, 0]] == _pack(["x" * (len("**User:** ") + (size if size <= 2000 else 2015)) for size in sizes], 1200), s
        assert "\n\n".join(t.split("\n\n", 1)[1] for _, t in got[s, 0]) == "\n\n".join(lines)
    assert {b: sum(n for n, _ in v) for (s, b), v in got.items() if s == "hot"} == {0: 9000, 1: 500}


def test_entity_rules(spark):
    text = (
        "Server IP: 10.0.0.7 and 999.1.1.1, 10.0.0.8\nMail a.b@c.org, call (555) 123-4567. Cost is $1,200.50/mo today\n- **Wife**: Ann Lee\n"
        "Bob Stone is the brother of Al. Mary Major, 44 years old. token: abcdefghijkl\nJane Doe (NX-1234) said hi. EIN: 12-3456789\n"
        "Tom Hill is allergic to peanuts. He lives in Texas."
    )
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = {(r.entity_type, r.entity_name, r.entity_value) for r in entities.extract(df).collect()}
    for row in [
        ("ip", "Server IP", "10.0.0.7"), ("ip", "ip_address", "10.0.0.8"), ("phone", "phone", "555) 123-4567"), ("email", "email", "a.b@c.org"),
        ("credential", "token", "abcdefghijkl"), ("business", "EIN", "12-3456789"), ("person", "Wife", "Ann Lee"),
        ("person", "Jane Doe_employee_id", "NX-1234"), ("person", "Tom Hill_allergy", "peanuts"), ("location", "state", "Texas"),
    ]:
        assert row in got, (row, sorted(got))
    assert not any(v == "999.1.1.1" for _, _, v in got)
    assert any(t == "financial" and v == "$1,200.50/mo" for t, _, v in got)


def test_entity_labels_look_back():
    of = lambda t: entities.entities_of(t)
    assert of("Server IP 10.0.0.7\n") == [("ip", "ip", "10.0.0.7")]
    assert of("IP: 10.0.0.1 and IP 10.0.0.2\n") == [("ip", "IP", "10.0.0.1"), ("ip", "IP", "10.0.0.2")]
    assert of("Paid $5 and $6.50") == [("financial", "Paid", "$5"), ("financial", "Paid $5 and", "$6.50")]
    assert of("Cost\n$7/mo") == [("financial", "Cost", "$7/mo")] and of("$8") == [("financial", "amount", "$8")]
    ages = of("Ann Lee turned, at age 44 years old; she is 45 years old")
    assert ("person", "Ann Lee_age", "44") in ages and ("person", "Ann Lee_age", "45") in ages
    assert ("person", "Jo Hill_employee_id", "NX-12345") in of("Jo Hill, as we heard, holds NX-12345")
    assert ("person", "employee_id", "NX-999") in of("NX-999") and ("person", "password", "x") not in of("password: `hunter22`")
    assert ("credential", "password", "hunter22") in of("password: `hunter22`")
    assert entities.entities_of("see http://a.b/c, http://d.e", skip_urls=("a.b",)) == [("url", "url", "http://d.e")]
    assert of("") == [] and len(of("plain. " * 30_000)) == 0


def test_query_understanding(spark):
    assert one(spark, understand.intents, "How old is the server?") == ["age", "config"]
    assert one(spark, understand.temporal_mode, "what changed on March 5") == "specific_date"
    assert one(spark, understand.temporal_mode, "When did it break") == "when" and one(spark, understand.temporal_mode, "hello") is None
    dates = lambda t: one(spark, lambda c: understand.date_patterns(c, 2026), t)
    assert dates("on March 5") == ["2026-03-05", "03-05"] and dates("on 2024-01-02") == ["2024-01-02"] and dates("on 3/4/2025") == ["2025-03-04", "03-04"]
    assert dates("March 15th") == [] and dates("3/4/25") == ["2025-03-04", "03-04"] and dates("March 5,2025") == ["2025-03-05", "03-05"]
    assert one(spark, understand.expansion, "my gpu and dns") == ["graphics card", "video card", "domain name", "nameserver"]
    assert one(spark, understand.has_words, "?!") is False
    assert one(spark, understand.sanitized, 'a-b "c_d"  e') == "a b c_d e"


def test_exact_and_indexed_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    m = centres[rng.integers(12, size=600)] + 0.3 * rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 16)], "id long, vector array<double>").repartition(5)
    q = df.where("id % 20 = 0")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {i: [int(j) for j in np.lexsort((np.arange(600), -np.maximum(u @ u[i], 0)))[:5]] for i in range(0, 600, 20)}
    got = {}
    for r in vector.exact_neighbours(df, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    got.pop(900, None)
    assert got == want
    found = vector.InvertedFile.fit(df.where("id < 900"), lists=12, sample=300).search(df.where("id < 900"), q.where("id < 900"), 5, probes=4)
    hit = sum(r.id in want[r.query_id] for r in found.collect())
    assert hit >= 0.9 * 5 * len(want)


def test_rerank_blend(spark):
    rows = [(1, 10, 0.9, 1), (1, 11, 0.5, 2), (1, 12, 0.1, 3), (2, 20, 0.4, 1)]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, rank int")
    got = {(r.query_id, r.id): (r.blended, r.rank) for r in models.rerank(df, F.lit(0.0), pool=2).collect()}
    assert got == {(1, 10): (pytest.approx(0.7), 1), (1, 11): (pytest.approx(0.3), 2), (2, 20): (pytest.approx(0.7), 1)}


def test_embedding_stand_in(spark):
    df = models.embed(spark.createDataFrame([(1, "quiet harbor"), (2, ""), (3, None)], "id long, text string"), "text")
    got = {r.id: r.vector for r in df.collect()}
    assert len(got[1]) == models.DIM and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and not any(got[2]) and got[3] is None


def test_upsert_twice_is_the_same(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "file_path string, id long")
    new = spark.createDataFrame([("b", 9), ("c", 4)], "file_path string, id long")
    once = store.upsert(old, new)
    want = sorted([("a", 1), ("b", 9), ("c", 4)])
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, store.upsert(once, new).collect())) == want
    assert sorted(r.id for r in store.remove(old, new).collect()) == [1]


def test_hybrid_search_end_to_end(spark):
    t = dt.datetime(2026, 10, 1)
    texts = {1: "The harbor password is kept in the vault.", 2: "Lunch was soup.", 3: "On 2024-05-01 the harbor flooded.", 4: "Boats rest in the bay.", 5: "The harbor password is kept in the vault."}
    rows = [(i, "docs/a.md" if i < 3 else f"notes/2024-05-0{i}.md", i * 10, i * 10 + 5, x, t, "config" if i == 1 else None, None, f"h{min(i, 1) if i in (1, 5) else i}") for i, x in texts.items()]
    corpus = models.embed(spark.createDataFrame(rows, "id long, file_path string, line_start int, line_end int, text string, indexed_at timestamp, kind string, source string, hash string"), "text")
    corpus = corpus.withColumn("vector", F.col("vector").cast("array<double>"))
    ents = spark.createDataFrame([(1, 3, "harbor", "flooded")], "id long, chunk_id long, entity_name string, entity_value string")
    qs = models.embed(spark.createDataFrame([(1, "harbor password"), (2, "?!"), (3, "harbor flooded on 2024-05-03")], "query_id long, query string"), "query")
    qs = qs.withColumn("vector", F.col("vector").cast("array<double>"))
    found = hybrid.search(corpus, ents, qs, F.lit("2026-11-01").cast("timestamp"), max_results=3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got[1][0] in (1, 5) and not {1, 5} <= set(got[1]) and 2 not in got and got[3][0] == 3
    report = hybrid.format_results(found, corpus).where("query_id = 1").first().report
    assert report.startswith("**1. ") and "vault" in report


def test_boolean_queries(spark):
    docs = [(1, "red fox"), (2, "blue dog"), (3, "red dog"), (4, "green cat"), (5, "red dog bites"), (6, "OR")]
    d = spark.createDataFrame(docs, "id long, text string")
    asked = {"red OR blue": {1, 2, 3, 5}, "dog NOT bites": {2, 3}, "red dog OR cat": {3, 4, 5}, "red AND dog": {3, 5}, "red dog NOT bites OR fox": {1, 3}, "red OR": set(),
             "NOT dog": set(), "AND red": set(), "red or fox": set(), "dog NOT red bites": {2, 3}, "ORbit": set()}
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {i: set() for i in range(len(asked))}
    for r in keyword_scores(d, q).collect():
        got[r.query_id].add(r.id)
    assert got == dict(enumerate(asked.values()))


def test_entity_cascade_and_dated_chunks(spark):
    ents = [(1, 5, "Kai Osei", "engineer"), (2, 6, "Kai", "Osei x"), (3, 7, "boss", "Kai"), (4, 8, "port", "443"), (5, 9, None, "Kai")]
    e = spark.createDataFrame(ents, "id long, chunk_id long, entity_name string, entity_value string")
    q = spark.createDataFrame([(1, "who is Kai Osei?"), (2, "port 443"), (3, "Tell Kai about Bob"), (4, "nothing here")], "query_id long, query string")
    got = {}
    for r in hybrid.entity_hits(e, q).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {1: {5, 6}, 2: {8}, 3: {5, 7, 9}}
    asked = hybrid.understood(spark.createDataFrame([(1, "what happened on March 5, 2024"), (2, "notes of 2024-03-05")], "query_id long, query string"), 2026)
    paths = [(1, "n/2024-03-05.md"), (2, "n/x03-05.md"), (3, "n/2024-03-06.md"), (4, None), (5, "n/2023-03-05-a.md")]
    rows = spark.createDataFrame(paths, "id long, file_path string")
    assert sorted((r.query_id, r.id) for r in hybrid.dated_chunks(rows, asked).collect()) == [(1, 1), (1, 2), (1, 5)]
    assert one(spark, understand.expanded, "my gpu") == "my gpu graphics card video card"


def test_ingest_follows_a_folder(spark, tmp_path):
    src, out = tmp_path / "notes", str(tmp_path / "store")
    src.mkdir()
    (src / "a.md").write_text("# A\nMail a.b@c.org about port: 443 now")
    (src / "2024-05-01.md").write_text("Plain words.\n")
    (src / "b.txt").write_text("not asked for")
    tables = lambda: {n: sorted(map(str, ingest.read(spark, out, n).drop("modified").collect())) for n in ingest.TABLES}
    assert ingest.index(spark, str(src), out) == 1
    first = tables()
    assert len(first["files"]) == 2 and len(first["chunks"]) == 2 and len(first["vectors"]) == 2 and any("a.b@c.org" in x for x in first["entities"])
    assert ingest.index(spark, str(src), out) == 1 and ingest.index(spark, str(src), out, force=True) == 2 and tables() == first
    (src / "a.md").write_text("# A\nNothing to name, but a longer text than before, so its size differs")
    assert ingest.index(spark, str(src), out) == 3
    then = tables()
    assert len(then["chunks"]) == 2 and not any("a.b@c.org" in x for x in then["entities"]) and set(first["chunks"]) & set(then["chunks"])
    (src / "a.md").unlink()
    ingest.index(spark, str(src), out)
    assert [len(v) for v in tables().values()][:2] == [1, 1] and len(tables()["vectors"]) == 1
