"""Diffs as line ranges, against the lines that git itself counts; staged content; locale files of any depth."""

import subprocess

from pyspark.sql import functions as F

from corpusmill.operators.project import locale_keys
from corpusmill.sources import diffs
from corpusmill.sources.files import as_files


def _git(repo, *args):
    return subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], capture_output=True, check=True, text=True).stdout


def _repo(tmp_path):
    _git(tmp_path, "init", "-q")
    (tmp_path / "a.ts").write_text("".join(f"line {i}\n" for i in range(1, 31)))
    (tmp_path / "gone.ts").write_text("x\n")
    (tmp_path / "\u00e9 b.ts").write_text("one\n")
    _git(tmp_path, "add", "-A")
    _git(tmp_path, "commit", "-qm", "first")
    lines = [f"line {i}" for i in range(1, 31)]
    lines[2:4] = ["new 3", "++ b/x.ts", "new 4"]
    lines.insert(20, "put in")
    del lines[27]
    (tmp_path / "a.ts").write_text("\n".join(lines))
    (tmp_path / "gone.ts").unlink()
    (tmp_path / "\u00e9 b.ts").write_text("one\ntwo\n")
    (tmp_path / "fresh.ts").write_text("f\ng\n")
    _git(tmp_path, "add", "-A")
    return lines


def test_ranges_of_a_working_tree(spark, tmp_path):
    lines = _repo(tmp_path)
    rows = diffs.git_ranges(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.path, set()).update(range(r.start, r.stop + 1))
    # The last line lost its end: git counts it as changed.
    assert got == {"a.ts": {3, 4, 5, 21, len(lines)}, "\u00e9 b.ts": {2}, "fresh.ts": {1, 2}}
    assert {r.hunk for r in rows if r.path == "a.ts"} >= {1, 2}


def test_staged_source_is_what_the_index_holds(spark, tmp_path):
    _repo(tmp_path)
    (tmp_path / "fresh.ts").write_text("not staged\n")
    got = {r.path: (r.lang, r.content) for r in diffs.staged_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.ts", "\u00e9 b.ts", "fresh.ts"} and got["fresh.ts"] == ("typescript", "f\ng\n")
    staged = {(r.path, r.start, r.stop) for r in diffs.git_ranges(spark, str(tmp_path), staged=True).collect()}
    assert ("fresh.ts", 1, 2) in staged and ("fresh.ts", 1, 1) in {(r.path, r.start, r.stop) for r in diffs.git_ranges(spark, str(tmp_path)).collect()}


def test_headers_in_text():
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n--- y\n+++ b/y\n+@@ -1 +1 @@\n z\n@@ -9 +10,0 @@\n-q\n--- a/z\t2020\n+++ b/z\t2020\n@@ -0,0 +1 @@\n+n\n\\ No newline at end of file\n--- a/w\n+++ /dev/null\n@@ -1 +0,0 @@\n-w\n"
    assert list(diffs.changed_ranges(diff)) == [("x", 1, 1, 2), ("z", 1, 1, 1)]
    assert list(diffs.changed_ranges("")) == [] and list(diffs.changed_ranges('--- a/x\n+++ "b/\\303\\251 \\"q.ts"\n@@ -0,0 +1,2 @@\n+a\n+b')) == [("\u00e9 \"q.ts", 1, 1, 2)]


def test_findings_in_ranges(spark):
    found = spark.createDataFrame([("r/a.ts", i) for i in range(1, 12)] + [("r/b.ts", 1), (None, 1), ("r/a.ts", None)], "path string, line int")
    changes = spark.createDataFrame([("a.ts", 1, 2, 4), ("a.ts", 2, 3, 3), ("a.ts", 2, 5, 6), ("a.ts", 3, 9, 9), ("a.ts", 4, 12, 11)], diffs.RANGES)
    assert sorted(r.line for r in diffs.in_ranges(found, changes, "r/").collect()) == [2, 3, 4, 5, 6, 9]
    assert diffs.in_ranges(found, changes.limit(0)).count() == 0
    assert diffs.ranges(spark.createDataFrame([(None,), ("",)], "diff string")).count() == 0


def test_locale_keys_of_any_depth(spark):
    deep = "{" + '"k": {' * 30 + '"leaf": 1' + "}" * 30 + "}"
    rows = [("locales/en.json", deep), ("i18n/de.json", '{"a": "{b}", "c": "{\\"d\\": 1}", "e": [{"f": 1}], "g": {}, "h": null, "i.j": {"k": true}}'), ("locales/fr.json", "{"), ("locales/es.json", "[1]"), ("src/en.json", '{"no": 1}'), ("locales/it.json", None)]
    got = {(r.locale, r.name) for r in locale_keys(as_files(spark.createDataFrame(rows, "p string, c string"), F.col("p"), F.col("c"))).collect()}
    assert got == {("en", "k." * 30 + "leaf"), ("de", "a"), ("de", "c"), ("de", "e"), ("de", "h"), ("de", "i.j.k")}
