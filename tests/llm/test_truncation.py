import hashlib
import math
import random

from tidemill.llm.truncation import _poisson_tail, length_hazards, truncated, truncation_report

META = "struct<heading: string, hash: string, source: string>"
SCHEMA = f"id long, file_path string, text string, chars int, metadata {META}"


def rows(texts, whole=None):
    out = []
    for i, t in enumerate(texts):
        h = hashlib.md5((whole or {}).get(i, t or "").encode()).hexdigest()[:12]
        out.append((i, f"docs/f{i}.md", t, len(t or ""), (None, h, None)))
    return out


def test_endings(spark):
    items = "- Plan: quiet harbor\n- Seats: every Monday\n- Port: green kettle\n"
    cases = {
        "A whole sentence.": False,
        "Said she: “done.”": False,
        "The store moved to the": True,
        "It broke off he…": True,
        "It broke off ... [truncated]": True,
        "Plain sentence wr [cut]": True,
        "un caf�": True,
        "```\nkey: value\n": True,
        "```\nkey: value\n```": False,
        "She met Dr.": True,
        "Her new address is 12 Oak St.": False,
        "See [the book](https://wiki.": True,
        items + "- Plan: green harbor": False,
        items + "- Seats: every Monday\n\n": False,
        "**User:** ok thanks\n\n**Assistant:** Fine.\n\n**User:** ok thanks\n\n**Assistant:** Good.": False,
        "**Assistant:** Fine.\n\n**User:** ok thanks": False,
        "**Assistant:** Fine.\n\n**User:** Where is the": True,
        "": None,
        None: None,
    }
    texts = list(cases)
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.id: r.is_cut for r in truncated(df).collect()}
    assert {t: got.get(i) for i, t in enumerate(texts)} == cases


def test_items_and_replies_at_a_limit(spark):
    """Of 200 texts of 120 characters, a limit, those with open endings are cut unless their last words are sure."""
    rng = random.Random(4)
    lead = "- Plan: quiet harbor\n- Seats: every Monday\n"
    texts = [lead + "- Port: " + "k" * rng.randrange(20, 320) + " Monday" for _ in range(400)]
    texts = [t for t in texts if len(t) != 120]
    n = len(texts)
    texts += [("- Plan: quiet harbor\n" * 9)[: 120 - 12] + "- Seats: eve" for _ in range(180)]
    texts += [("- Port: a kettle\n" * 9)[: 120 - 25] + "\n- Seats: quiet at Monday" for _ in range(3)]
    got = {r.id: r for r in truncated(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert all(len(texts[i]) == 120 and got[i].at_limit for i in range(n, n + 183))
    assert [got[i].is_cut for i in range(n, n + 183)] == [True] * 180 + [False] * 3
    assert not any(got[i].is_cut or got[i].at_limit for i in range(n))


def test_a_long_last_line_is_judged_whole(spark):
    item = "- Seats: " + "word " * 200 + "Monday"
    df = spark.createDataFrame(rows([item + "\n" + item, "**User:** " + "word " * 200 + "Monday"]), SCHEMA)
    assert {r.id: (r.kind, r.is_cut) for r in truncated(df).collect()} == {0: ("item", False), 1: ("running", True)}


def test_a_reply_cut_where_longer_replies_go_on(spark):
    cut = "My suggestion is to archive the folders "[:39] + "b"
    assert len(cut) == 40
    base = f"**User:** {cut}y Monday\n\n**Assistant:** Fine.\n\n**User:** {cut}efore noon\n\n**Assistant:** Good."
    whole = cut[:-2]
    df = spark.createDataFrame(rows([base, f"**User:** {cut}", f"**User:** {whole}\n\n" * 2 + "Yes.", f"**User:** {whole}"]), SCHEMA)
    assert {r.id: r.is_cut for r in truncated(df).collect()} == {0: False, 1: True, 2: False, 3: False}


def test_limits_are_found_and_nothing_else(spark):
    rng = random.Random(1)
    lengths = [("a", rng.randrange(200, 1000)) for _ in range(4000)] + [("b", rng.randrange(200, 900)) for _ in range(3000)]
    lengths = [(f, min(n, 700 if f == "a" else 10_000)) for f, n in lengths]
    df = spark.createDataFrame([(None, f, n) for f, n in lengths], "source string, family string, len int")
    got = length_hazards(df)
    assert [(r.family, r.len) for r in got.where("significant").collect()] == [("a", 700)]
    by = {}
    for f, n in lengths:
        by.setdefault(f, []).append(n)
    for r in got.collect():
        assert r.n == by[r.family].count(r.len) and r.at_risk == sum(x >= r.len for x in by[r.family])
    assert length_hazards(df.where("false")).count() == 0


def test_poisson_tail():
    for mean in (0.01, 0.5, 3.0, 20.0, 120.0):
        for n in (0, 1, 2, 5, 30, 119, 150):
            want = 1 - sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(n))
            assert abs(_poisson_tail(n, mean) - want) < 1e-9
    # far beyond a few thousand terms the tail at the mean is still about a half
    assert abs(_poisson_tail(10_000_000, 1e7) - 0.5) < 0.001 and abs(_poisson_tail(99_000, 100_000.0) - 0.9992) < 0.0005


def test_report_and_empty_table(spark):
    df = spark.createDataFrame(rows(["Fine.", "Not fi", "Not fi"]), SCHEMA)
    r = truncation_report(df).collect()
    assert [(x.family, x.n_texts, x.n_cut) for x in r] == [("docs", 3, 2)]
    assert truncated(df.where("false")).count() == 0
    bare = spark.createDataFrame([(1, None, "Cut of", None, None)], SCHEMA)
    assert [x.is_cut for x in truncated(bare).collect()] == [True]
