"""Two streaming sources in Python: changed files of a folder, appended lines of transcripts.

``workspace_changes`` gives (path, op, content) for files created, modified or deleted since the last
offset; the built-in file source shows new files only. ``transcript_lines`` gives (file_path,
line_num, value) for complete lines appended to JSONL files; an offset holds each file's byte position
and line count, and advances to the last line break only, so a half-written line is read when whole.
Offsets live in the query's checkpoint: each change and each line is delivered once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TEXT_SUFFIXES = (".md", ".txt")


class _Part(InputPartition):
    def __init__(self, **fields) -> None:
        self.fields = fields


class WorkspaceChanges(DataSource):
    """Options: path (folder, read recursively). Files that begin with ``.`` or ``~`` are left out."""

    @classmethod
    def name(cls) -> str:
        return "workspace_changes"

    def schema(self) -> str:
        return "path string, op string, content string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _WorkspaceReader(self.options["path"])


class _WorkspaceReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = {}
        for folder, _, names in os.walk(self.path):
            for n in names:
                if n.endswith(TEXT_SUFFIXES) and n[0] not in ".~":
                    p = os.path.join(folder, n)
                    try:
                        s = os.stat(p)
                    except OSError:
                        continue
                    found[p] = [s.st_mtime_ns, s.st_size]
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        changed = [_Part(path=p, op="upsert") for p in new if old.get(p) != new[p]]
        return changed + [_Part(path=p, op="delete") for p in old if p not in new]

    def read(self, partition) -> Iterator[tuple]:
        path, op, content = partition.fields["path"], partition.fields["op"], None
        if op == "upsert":
            try:
                with open(path, "rb") as f:
                    content = f.read().decode("utf-8", "ignore")
            except FileNotFoundError:
                op = "delete"
        yield path, op, content


class TranscriptLines(DataSource):
    """Options: path (folder, not recursive), archived (``true`` also reads archived transcripts)."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return "file_path string, line_num int, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TranscriptReader(self.options["path"], self.options.get("archived", "false") == "true")


class _TranscriptReader(DataSourceStreamReader):
    def __init__(self, path: str, archived: bool) -> None:
        self.path, self.archived = path, archived

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _wanted(self, name: str) -> bool:
        if ".deleted." in name:
            return False
        return (".reset." in name and self.archived) or name.endswith(".jsonl")

    def latestOffset(self) -> dict:
        found = {}
        for n in sorted(os.listdir(self.path)):
            p = os.path.join(self.path, n)
            if self._wanted(n) and os.path.isfile(p) and (end := _complete(p)):
                found[p] = end
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        # a file that became shorter was written anew: it is read from its start
        begin = {p: old.get(p, 0) if old.get(p, 0) <= e else 0 for p, e in new.items()}
        return [_Part(path=p, start=begin[p], end=e) for p, e in new.items() if begin[p] < e]

    def read(self, partition) -> Iterator[tuple]:
        f = partition.fields
        with open(f["path"], "rb") as file:
            before = 0
            left = f["start"]
            while left > 0 and (block := file.read(min(left, 1 << 20))):
                before += block.count(b"\n")
                left -= len(block)
            for i, line in enumerate(file.read(f["end"] - f["start"]).split(b"\n")[:-1]):
                yield f["path"], before + i + 1, line.decode("utf-8", "ignore")


def _complete(path: str) -> int:
    """The byte after the last line break of a file, searched from its end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            step = min(at, 1 << 16)
            f.seek(at - step)
            cut = f.read(step).rfind(b"\n")
            if cut >= 0:
                return at - step + cut + 1
            at -= step
    return 0


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkspaceChanges)
    spark.dataSource.register(TranscriptLines)
