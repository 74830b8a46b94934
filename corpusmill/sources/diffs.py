"""Changed and staged source: unified diffs as line ranges, a data source over a git working tree, findings in changes."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.sources.files import as_files

RANGES = "path string, hunk int, start int, stop int"
_RANGES_ARROW = pa.schema([("path", pa.string()), ("hunk", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ESCAPE = re.compile(rb"\\([0-7]{3}|.)")
_ESCAPES = {b"n": b"\n", b"t": b"\t", b'"': b'"', b"\\": b"\\", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"r": b"\r", b"v": b"\v"}


def _path(name: str) -> str | None:
    """The path that a +++ line names: without b/, a time behind a tab, and git's quotes; None if the file is gone."""
    if name.startswith('"'):
        raw = name[1 : name.rfind('"')].encode()
        name = _ESCAPE.sub(lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else _ESCAPES.get(m[1], m[1]), raw).decode("utf-8", "replace")
    else:
        name = name.split("\t")[0].rstrip("\r")
    return None if name == "/dev/null" else name.removeprefix("b/")


def changed_ranges(diff: str) -> Iterator[tuple[str, int, int, int]]:
    """(path, number of the hunk in its file, first line, last line) of each run of added lines, in the new file's lines.

    A hunk's header says how many lines follow, so that added text that looks like a header is text.
    """
    path, hunk, old, new, at, start = None, 0, 0, 0, 0, 0
    for line in (*diff.split("\n"), "@"):
        if start and not (new and line.startswith("+")):
            yield path, hunk, start, at - 1
            start = 0
        if (old or new) and line[:1] in ("+", "-", " ", ""):
            if line.startswith("+"):
                start = start or (at if path is not None else 0)
                new, at = new - 1, at + 1
            elif line.startswith("-"):
                old -= 1
            else:
                old, new, at = old - 1, new - 1, at + 1
        elif (old or new) and line.startswith("\\"):  # no newline at the end of the file
            continue
        elif m := _HUNK.match(line):
            hunk, old, new, at = hunk + 1, int(m[1] or 1), int(m[3] or 1), int(m[2])
        elif line.startswith("+++ "):
            path, hunk, old, new = _path(line[4:]), 0, 0, 0


def ranges(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """path, hunk, start, stop of the added lines of all unified diffs in a column; null diffs have none.

    A diff is read by one task, row by row; a large change is best stored as a diff a file, as most tools can write it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for diff in batch.column(0).to_pylist() for r in changed_ranges(diff or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _RANGES_ARROW.types, strict=True)], schema=_RANGES_ARROW)

    return diffs.select(text).mapInArrow(run, RANGES)


def in_ranges(found: DataFrame, changes: DataFrame, root: str = "") -> DataFrame:
    """Findings on changed lines: a range join on the path and start <= line <= stop.

    Paths of changes are relative to ``root``, those of findings start with it. Ranges of a path that overlap or touch
    are merged first, so that each finding meets at most one and no row repeats. Findings without a line go.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("start", "stop")
    rows = changes.filter("start <= stop").select(F.concat(F.lit(root), F.col("path")).alias("path"), "start", "stop")
    rows = rows.withColumn("reach", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("start") > F.coalesce("reach", F.lit(-1)) + 1, 1).otherwise(0)).over(w))
    merged = rows.groupBy("path", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(F.col("path").alias("c_path"), "start", "stop").hint("merge")
    return found.join(merged, (F.col("path") == F.col("c_path")) & F.col("line").between(F.col("start"), F.col("stop")), "left_semi")


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, "-c", "core.quotepath=on", *args], capture_output=True, check=True).stdout


class GitSource(DataSource):
    """``spark.read.format("git_changes").option("repo", folder)``: path and diff, or path and content, of changed files.

    Options: what = diff (of the working tree), staged_diff (of the index) or staged (files as the index holds them:
    what a commit would contain, whatever the working tree says); against = a commit (default HEAD). A row is a file
    and its read a task, so the folder must be where tasks run.
    """

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return "path string, content string" if self.options.get("what", "diff") == "staged" else "path string, diff string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options["repo"], self.options.get("what", "diff"), self.options.get("against", "HEAD"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _GitReader(DataSourceReader):
    def __init__(self, repo: str, what: str, against: str):
        if what not in ("diff", "staged_diff", "staged"):
            raise ValueError(f"what must be diff, staged_diff or staged, not {what}")
        self.repo, self.what, self.against = repo, what, against
        self.args = ["diff", *(["--cached"] if what != "diff" else []), "--no-color", "--no-ext-diff", "--diff-filter=d", against]

    def partitions(self) -> list[_File]:
        names = _git(self.repo, *self.args[:-1], "--name-only", "-z", self.args[-1]).decode("utf-8", "surrogateescape").split("\0")
        return [_File(n) for n in names if n]

    def read(self, partition: _File) -> Iterator[tuple[str, str]]:
        if self.what == "staged":
            yield partition.path, _git(self.repo, "show", f":{partition.path}").decode("utf-8", "replace")
        else:
            yield partition.path, _git(self.repo, *self.args, "--", partition.path).decode("utf-8", "replace")


def git_ranges(spark: SparkSession, repo: str, staged: bool = False, against: str = "HEAD") -> DataFrame:
    """The added lines of a working tree, or of its index, against a commit."""
    spark.dataSource.register(GitSource)
    rows = spark.read.format("git_changes").option("repo", repo).option("what", "staged_diff" if staged else "diff").option("against", against).load()
    return ranges(rows)


def staged_files(spark: SparkSession, repo: str, against: str = "HEAD") -> DataFrame:
    """The staged files that differ from a commit, with the content that is staged."""
    spark.dataSource.register(GitSource)
    rows = spark.read.format("git_changes").option("repo", repo).option("what", "staged").option("against", against).load()
    return as_files(rows, F.col("path"), F.col("content"))
