import os

from tidemill.functions.messages import transcript_session
from tidemill.sources.files import synonyms, transcript_files, transcript_lines, workspace_files
from tidemill.streaming.pipelines import current, keep_chunks, keep_lines, session_windows

LINE = '{"timestamp": "2024-01-01T10:%02d:00Z", "message": {"role": "user", "content": "message number %d"}}\n'


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_each_complete_line_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    f = src / "s1.jsonl"
    f.write_text(LINE % (1, 1) + LINE % (2, 2) + '{"timestamp": "2024-01-01T10:03:00Z", "mess')
    (src / "s2.jsonl.deleted.1").write_text(LINE % (9, 9))
    run(keep_lines(spark, str(src), out, cp))
    assert sorted(r.line_num for r in spark.read.parquet(out).collect()) == [1, 2]
    f.write_text(LINE % (1, 1) + LINE % (2, 2) + LINE % (3, 3))
    run(keep_lines(spark, str(src), out, cp))
    run(keep_lines(spark, str(src), out, cp))
    assert sorted((r.line_num, r.text) for r in spark.read.parquet(out).collect()) == [(i, f"message number {i}") for i in (1, 2, 3)]


def test_chunks_follow_files(spark, tmp_path):
    src, table, cp = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")
    (src / "sub").mkdir(parents=True)
    a, b = src / "a.md", src / "sub" / "b.txt"
    a.write_text("# A\nfirst text")
    b.write_text("second text")
    (src / ".hidden.md").write_text("no")
    run(keep_chunks(spark, str(src), table, cp))
    names = lambda: sorted((os.path.basename(r.file_path), r.text) for r in current(spark, table).collect())
    assert names() == [("a.md", "[a > A] # A\nfirst text"), ("b.txt", "[b] second text")]
    a.write_text("# A\nchanged text, longer")
    b.unlink()
    run(keep_chunks(spark, str(src), table, cp))
    assert names() == [("a.md", "[a > A] # A\nchanged text, longer")]


def test_session_windows(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    (src / "s1.jsonl").write_text("".join(LINE % (m, m) for m in (0, 5, 9)) + LINE.replace("T10", "T11") % (50, 50))
    run(keep_lines(spark, str(src), out, cp))
    lines = spark.readStream.schema(spark.read.parquet(out).schema).parquet(out)
    q = session_windows(lines).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    run(q)
    assert sorted(r.n_messages for r in spark.table("w").collect()) == [1, 3]


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok \xff text")
    (tmp_path / "x.jsonl").write_text("l1\nl2")
    (tmp_path / "y.jsonl.reset.2024").write_text("l1")
    (tmp_path / "z.jsonl.deleted.2024").write_text("l1")
    assert [r.text for r in workspace_files(spark, str(tmp_path)).collect()] == ["ok  text"]
    active, archived = transcript_files(spark, str(tmp_path)), transcript_files(spark, str(tmp_path), archived=True)
    assert active.count() == 1 and archived.count() == 1
    assert sorted((r.line_num, r.value) for r in transcript_lines(spark, active).collect()) == [(1, "l1"), (2, "l2")]
    assert active.select(transcript_session(active.file_path).alias("s")).first().s == "x"
    (tmp_path / "syn.json").write_text('{"ip": ["addr"], "cat": ["feline"]}')
    assert synonyms(str(tmp_path / "syn.json"))["ip"] == ("addr",) and "gpu" in synonyms(str(tmp_path / "missing"))
