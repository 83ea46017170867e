import random

from tidemill.llm.conversations import conversation_ends, conversation_fault, resolve_parents, root_to_leaf_paths

COLS = "session_id string, file_path string, line_num int, timestamp string, role string, sender string, text string, ingested_at timestamp"


def nodes(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "id string, parent string, weight bigint")


def test_chains_branches_orphans_and_cycles(spark):
    pairs = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)]
    pairs += [("b1", "c3"), ("b2", "b1")]
    pairs += [("o1", "missing"), ("o2", "o1")]
    pairs += [("x", "y"), ("y", "z"), ("z", "x"), ("tail", "x"), ("self", "self")]
    pairs += [("c5", "c4"), (None, "c1")]
    got = {r.id: (r.root, r.depth, r.state) for r in resolve_parents(nodes(spark, pairs)).collect()}
    assert got["c39"] == ("c0", 39, "ok") and got["b2"] == ("c0", 5, "ok")
    assert got["o2"] == ("o1", 1, "orphan") and got["o1"] == ("o1", 0, "orphan")
    assert {got[k] for k in ("x", "y", "z", "tail", "self")} == {(None, None, "cycle")}
    assert len(got) == 49
    paths = {}
    for r in root_to_leaf_paths(nodes(spark, pairs)).collect():
        paths.setdefault(r.leaf, []).append((r.depth, r.id))
    assert set(paths) == {"c39", "b2"}
    assert [i for _, i in sorted(paths["b2"])] == ["c0", "c1", "c2", "c3", "b1", "b2"]
    assert [d for d, _ in sorted(paths["c39"])] == list(range(40))


def test_random_forest(spark):
    rng = random.Random(3)
    pairs = [(str(i), str(rng.randrange(i)) if i and rng.random() > 0.1 else None) for i in range(200)]
    up = dict(pairs)

    def walk(x):
        d = 0
        while up[x] is not None:
            x, d = up[x], d + 1
        return x, d, "ok"

    assert {r.id: (r.root, r.depth, r.state) for r in resolve_parents(nodes(spark, pairs)).collect()} == {x: walk(x) for x in up}


def test_empty_table(spark):
    assert resolve_parents(nodes(spark, [])).count() == 0
    assert conversation_ends(spark.createDataFrame([], COLS)).count() == 0


def test_faults(spark):
    rows, t = [], "2024-01-01T00:0{}:00Z"

    def add(s, line, ts, role, text):
        rows.append((None, f"sessions/{s}.jsonl", line, ts, role, None, text, None))

    add("sound", 1, t.format(1), " User", "hello")
    add("sound", 2, t.format(2), "ASSISTANT\n", "hi")
    add("sound", 2, t.format(2), "ASSISTANT\n", "hi")
    add("late", 2, t.format(1), "user", "first by time")
    add("late", 1, t.format(2), "assistant", "second by time")
    add("noreply", 1, t.format(1), "user", "anyone?")
    add("noquestion", 1, t.format(1), "assistant", "hi")
    add("broken", 1, "N/A", "user", "when?")
    add("broken", 2, t.format(2), "assistant", "now")
    add("empty", 1, t.format(1), "tool", "x")
    add("empty", 2, t.format(2), "assistant", "HEARTBEAT_OK")
    add("empty", 3, t.format(2), "user", " \n ")
    add("empty", 4, None, None, None)
    df = spark.createDataFrame(rows, COLS)
    got = {r.session_id: r.fault for r in conversation_fault(conversation_ends(df)).collect()}
    assert got == {"sound": None, "late": None, "noreply": "no_reply", "noquestion": "no_question", "broken": "broken", "empty": "empty"}
