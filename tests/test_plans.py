"""Overrides, suppression, scores, gates, effort, trends, fixes, reports, project probes, scans and streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.model import SEVERITY_WEIGHT, TIERS
from corpusmill.operators import project, relations, views
from corpusmill.plans import findings as P
from corpusmill.plans import fixes, reports, scan
from corpusmill.sources.files import append_history, as_files, read_history
from corpusmill.streaming import changes

SCHEMA = "path string, rule string, severity string, line int, col int, message string"


def found(spark, *rows):
    return spark.createDataFrame([(*r, "")[:6] if len(r) == 5 else r for r in rows], SCHEMA)


def files(spark, *pairs):
    return as_files(spark.createDataFrame(list(pairs), "p string, c string"), F.col("p"), F.col("c"))


def test_override(spark):
    rows = found(spark, ("a", "x/one", "info", 1, 1), ("a", "x/two", "info", 1, 1), ("a", "y/one", "info", 1, 1), ("a", "z/one", "info", 1, 1))
    got = {r.rule: r.severity for r in P.override(rows, [("x/*", "error"), ("x/two", "warning"), ("x/*", "off"), ("z/*", "off")]).collect()}
    assert got == {"x/one": "error", "x/two": "warning", "y/one": "info"}


def test_suppress(spark):
    text = "// lint-ignore-next x/one\nbad\nbad // lint-ignore-line\nbad\n// lint-ignore-start y/one, x/two\nbad\n// lint-ignore-end\nbad\n// lint-ignore-start\nbad"
    lines = views.lines(files(spark, ("a.ts", text)))
    rows = found(spark, *[("a.ts", rule, "error", n, 1) for n in (2, 3, 4, 6, 8, 10) for rule in ("x/one", "y/one")])
    got = sorted((r.line, r.rule) for r in P.suppress(rows, lines).collect())
    assert got == [(2, "y/one"), (4, "x/one"), (4, "y/one"), (6, "x/one"), (8, "x/one"), (8, "y/one")]


def test_suppress_older_names_and_blocks(spark):
    text = "// lint-disable-next-line x/one\nbad\nbad // lint-disable-line\n/* lint-disable x/one */\nbad\n/* lint-disable y/one */\nbad\n/* lint-enable */\nbad\n/* lint-enable */\nbad"
    lines = views.lines(files(spark, ("a.ts", text)))
    rows = found(spark, *[("a.ts", rule, "error", n, 1) for n in (2, 3, 5, 7, 9, 11) for rule in ("x/one", "y/one")])
    got = sorted((r.line, r.rule) for r in P.suppress(rows, lines).collect())
    # the second start takes the place of the first, so line 5 is not covered
    assert got == [(2, "y/one"), (5, "x/one"), (5, "y/one"), (7, "x/one"), (9, "x/one"), (9, "y/one"), (11, "x/one"), (11, "y/one")]
    ignore = spark.createDataFrame([("x/one # why",), ("file: gen/**",), ("# no",), ("file:a.ts",)], "value string")
    assert [r.glob for r in P.ignored_files(ignore).collect()] == ["gen/**", "a.ts"]


def test_compared_scans(spark):
    a = found(spark, ("a", "x/one", "info", 1, 1), ("a", "x/one", "info", 1, 1), ("a", "x/two", "info", 2, 1))
    b = found(spark, ("a", "x/one", "info", 1, 1), ("a", "x/three", "info", 2, 1))
    assert sorted((r.change, r.rule) for r in P.compared(a, b).collect()) == [("fixed", "x/one"), ("fixed", "x/two"), ("kept", "x/one"), ("new", "x/three")]


def test_translation_gate(spark):
    rows = found(spark, ("a", "i18n-lint/hardcoded-string-jsx", "info", 1, 1), ("a", "x/one", "info", 1, 1))
    assert [r.rule for r in P.translation_gate(rows, files(spark, ("a.ts", "x"))).collect()] == ["x/one"]
    assert P.translation_gate(rows, files(spark, ("a.ts", "import { t } from 'i18next'"))).count() == 2


def test_plugins(spark, tmp_path):
    good = "from types import SimpleNamespace\nfrom corpusmill.operators.context_rules import _found\nplugin = SimpleNamespace(name='my-plugin', description='d', languages=['go'], run=lambda c: _found(c.lines.filter(\"text = 'bad'\"), 'my-plugin/bad', 'error'))\n"
    (tmp_path / "good.py").write_text(good)
    (tmp_path / "bad.py").write_text("class plugin:\n    name = ' '\n    languages = []\n")
    (tmp_path / "broken.py").write_text("1 / 0")
    try:
        assert scan.load_plugin(str(tmp_path / "good.py")) == []
        got = scan.findings(files(spark, ("a.go", "bad"), ("b.ts", "bad")), engines=["my-plugin"]).collect()
        assert [(r.path, r.rule) for r in got] == [("a.go", "my-plugin/bad")]
        with pytest.raises(ValueError, match="registered already"):
            scan.load_plugin(str(tmp_path / "good.py"))
    finally:
        scan.REGISTRY.pop("my-plugin", None)
    assert len(scan.load_plugin(str(tmp_path / "bad.py"))) == 4 and "division" in scan.load_plugin(str(tmp_path / "broken.py"))[0]


def test_config_files(tmp_path):
    (tmp_path / ".lint").mkdir()
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "base.json").write_text('{"extends": "up.yaml", "ci": {"failBelow": 60}, "rules": {"x/one": "off"}}')
    (tmp_path / "up.yaml").write_text("ci:\n  failBelow: 10\n  failOnErrors: false\n")
    text = "# own\nextends: ../base.json\nrules:\n  x/two: 'error'  # why\n  \"y/*\": off\nscoring:\n  smoothing: 1.5\n  mode: linear\nquality: {}\n".replace("quality: {}\n", "")
    (tmp_path / ".lint/config.yml").write_text(text)
    assert project.find_config(str(tmp_path / "a/b")) == (tmp_path / ".lint/config.yml").resolve()
    got = project.load_config(str(tmp_path / "a/b"))
    assert got["rules"] == {"x/one": "off", "x/two": "error", "y/*": "off"} and got["ci"] == {"failBelow": 60, "failOnErrors": False}
    assert got["scoring"]["smoothing"] == 1.5 and got["scoring"]["mode"] == "linear" and got["quality"] == project.DEFAULTS["quality"]
    (tmp_path / "up.yaml").write_text("extends: ./base.json\n")
    with pytest.raises(ValueError, match="extends itself"):
        project.load_config(str(tmp_path))
    (tmp_path / "up.yaml").write_text("extends: ./none.json\n")
    with pytest.raises(ValueError, match="no file"):
        project.load_config(str(tmp_path))
    assert project.parse_yaml("a:\n- 1\n- two\nb: [x, 2]\nc:\n  d:\n    - true\n  e: null\n") == {"a": [1, "two"], "b": ["x", 2], "c": {"d": [True], "e": None}}
    with pytest.raises(ValueError, match="no configuration"):
        project.parse_yaml("just text")


def test_undeclared_imports(spark):
    rows = files(
        spark, ("package.json", '{"dependencies": {"react": "1"}, "optionalDependencies": {"opt": "1"}}'), ("requirements.txt", "numpy==1\n# no\nregex[all]>=2"), ("pyproject.toml", 'polars = "1"'),
        ("tsconfig.json", '{\n// paths\n"compilerOptions": {"paths": {"@app/*": ["src/*"], "lib": ["lib"]}}}'),
        ("a.ts", "import a from 'react'\nimport b from 'gone/part'\nimport c from '@app/x/y'\nimport d from 'lib'\nimport e from 'fs'\nimport f from 'node:fs'\nimport g from '@other/x'\nimport h from 'libs/a'"),
    )
    names = {r.name for r in project.declared(rows).collect()}
    assert {"react", "numpy", "regex", "polars", "fs"} <= names and "no" not in names
    got = relations.undeclared_imports(views.imports(views.lines(rows)), project.declared(rows), project.alias_names(rows)).collect()
    assert sorted((r.line, r.message) for r in got) == [(2, "gone"), (7, "@other/x"), (8, "libs")]


def test_scan_at_once(spark):
    """Detectors side by side find what one plan finds."""
    rows = files(spark, ("src/a.ts", "import { x } from './b'\nimport { y } from 'gone'\nconst z = 1 as any\n"), ("src/b.ts", "import { q } from './a'\nexport const x = 1\n"), ("w.css", "#a { b: c; }\n"))
    names = ["lines", "unused-imports", "undeclared-imports", "cycles", "selectors"]
    key = lambda df: sorted((r.path, r.line, r.rule, r.message) for r in df.collect())
    one = key(scan.findings(rows, engines=names))
    assert one == key(scan.findings(rows, engines=names, at_once=3)) and {"import-intelligence/circular-dependency", "ast-slop/hallucinated-import", "css/unused-selector", "ast-slop/as-any"} <= {r[2] for r in one}


def test_missing_config(spark):
    assert project.missing_config(files(spark, ("a.ts", "x"))).count() == 1
    assert project.missing_config(files(spark, (".lint/config.yml", "x"))).count() == 0


def test_unused_code_sections(spark):
    text = json.dumps({s: {"a.ts": [f"{s}1", f"{s}2"]} for s in reports.UNUSED_SECTIONS})
    got = sorted((r.path, r.rule, r.message) for r in reports.knip(spark.createDataFrame([(text,)], "json string")).collect())
    assert got == sorted(("a.ts", f"knip/{s}", f"{s}{n}") for s in reports.UNUSED_SECTIONS for n in (1, 2))


def _score(rows, n_files, smoothing, most, tiers):
    by, total, capped, bad = {}, 0.0, 0, 0
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[4])):
        by.setdefault(r[1], []).append(r)
        bad += r[2] in ("error", "warning")
    for rule, own in by.items():
        mult, cap = TIERS[tiers.get(rule, "mechanical")]
        run = 0.0
        for i, r in enumerate(own):
            w = SEVERITY_WEIGHT[r[2]] * mult
            if i >= cap:
                capped += 1
                continue
            run += w
            capped += w > 0 and run > most
        total += min(run, most)
    x = total * min(1, bad / (n_files + smoothing))
    return math.floor(max(0, min(100, 100 - 100 * math.log1p(x) / math.log1p(100 + x))) + 0.5), capped


@pytest.mark.parametrize("seed", range(4))
def test_score_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"f{rng.randrange(5)}", f"e/r{rng.randrange(4)}", rng.choice(list(SEVERITY_WEIGHT)), n, 1) for n in range(rng.choice([1, 30, 150]))]
    tiers = {"e/r0": "strict", "e/r1": "advisory"}
    got = P.score(found(spark, *rows), 10, tiers=tiers, smoothing=5.0, max_per_rule=7.0).first()
    assert (got.score, got.n_capped) == _score(rows, 10, 5.0, 7.0, tiers)


def test_score_limits(spark):
    errors = found(spark, *[("a", f"e/{i}", "error", n, 1) for i in range(40) for n in range(40)])
    low, linear = P.score(errors, 0, smoothing=0.0).first(), P.score(errors, 0, mode="linear").first()
    assert 0 <= low.score < 50 and linear.score == 0 and low.label == "critical"
    assert P.score(found(spark, ("a", "e/x", "info", 1, 1)), 1).first().score == 100
    assert P.score(errors, 10**9).first().score == 100


def test_counts_and_ranks(spark):
    rows = found(spark, ("b", "x/a", "info", 2, 1), ("a", "x/a", "error", 1, 1), ("a", "x/a", "warning", 1, 3), ("a", "y/b", "info", 1, 1))
    assert {r.severity: r.n for r in P.severity_counts(rows).collect()} == {"error": 1, "warning": 1, "info": 2, "suggestion": 0}
    assert sorted((r.path, r.rule, r.severity) for r in P.first_of_each(rows).collect()) == [("a", "x/a", "error"), ("a", "y/b", "info"), ("b", "x/a", "info")]
    assert [(r.rule, r.n, r.worst) for r in P.top_rules(rows, 1).collect()] == [("x/a", 3, 0)]
    assert {(r.engine, r.rule): r.n for r in P.engine_rollup(rows).collect()}[(None, None)] == 4
    assert P.at_least(rows, "warning").count() == 2
    assert [r.path for r in P.first_places(rows, 2).filter("rule = 'x/a'").orderBy("r").collect()] == ["a", "a"]


@pytest.mark.parametrize(("errors", "ok", "score", "code"), [(True, False, 10, 1), (False, False, 10, 2), (False, True, 69, 3), (False, True, 70, 0)])
def test_gates(spark, errors, ok, score, code):
    row = spark.createDataFrame([(errors, ok, score)], "has_errors boolean, scoreable boolean, score int")
    assert P.exit_code(row).first().code == code
    assert P.baseline_gate(row, None).first().passed and P.baseline_gate(row, score + 1).first().passed is False


def test_labels(spark):
    row = spark.createDataFrame([(s,) for s in (49, 50, 74, 75)], "s int").select(P.label("s").alias("l"), P.badge("s").alias("b"))
    assert [r.l for r in row.collect()] == ["critical", "needs work", "needs work", "healthy"]


@pytest.mark.parametrize(
    ("category", "severity", "fixable", "suggestion", "confidence", "complexity"),
    [
        ("style", "info", True, "replace", 0.9, "trivial"), ("style", "warning", False, None, None, "simple"), ("style", "error", True, None, None, "moderate"), ("architecture", "info", True, "replace", 0.9, "complex"),
        ("style", "error", False, None, None, "complex"), ("security", "error", True, "replace", 0.9, "complex"), ("security", "warning", True, "replace", 0.9, "moderate"), ("performance", "warning", False, None, None, "moderate"),
        ("style", "warning", True, None, None, "moderate"), ("style", "info", True, "delete", 0.95, "simple"), ("style", "info", True, "replace", 0.8, "simple"), ("style", "suggestion", False, None, None, "simple"),
    ],
)
def test_assess(spark, category, severity, fixable, suggestion, confidence, complexity):
    row = spark.createDataFrame([(category, severity, fixable, suggestion, confidence)], "category string, severity string, fixable boolean, suggestion string, confidence double")
    got = P.assess(row).first()
    assert (got.complexity, got.minutes, got.priority) == (complexity, *{"trivial": (1, 1), "simple": (5, 2), "moderate": (15, 3), "complex": (60, 4)}[complexity])


def test_effort(spark):
    rows = found(spark, ("a", "arch-constraints/god-file", "warning", 1, 1), ("a", "html/missing-alt", "error", 1, 1), ("a", "ast-slop/todo-stub", "info", 1, 1))
    got = P.effort(P.assess(P.described(rows))).first()
    assert (got.n, got.minutes, got.priority, got.effort, got.n_complex, got.n_moderate, got.n_trivial) == (3, 76, 4, "1h 16m", 1, 1, 1)
    assert P.effort(P.assess(P.described(rows.limit(0)))).first().effort == "0 min"
    two = P.effort(P.assess(P.described(found(spark, *[("a", "arch-constraints/god-file", "warning", n, 1) for n in range(2)])))).first()
    assert two.effort == "2h"


def test_described_and_tiers(spark):
    rows = found(spark, ("a", "types/ts-suppress", "warning", 1, 1), ("a", "go-deep/goto-usage", "error", 1, 1), ("a", "own/rule", "info", 1, 1), ("a", "json/deep-nesting", "warning", 1, 1))
    got = {r.rule: (r.engine, r.category, r.fixable, r.suggestion, r.confidence) for r in P.described(rows).collect()}
    assert got == {"types/ts-suppress": ("types", "types", True, "delete", 0.7), "go-deep/goto-usage": ("go-deep", "syntax", False, None, None), "own/rule": ("own", "style", False, None, None), "json/deep-nesting": ("json", "architecture", False, None, None)}
    tiers = {r.rule: (r.mult, r.cap) for r in P.with_tiers(rows).collect()}
    assert tiers == {"types/ts-suppress": (0.5, 16), "go-deep/goto-usage": (1.0, 40), "own/rule": (0.5, 16), "json/deep-nesting": (0.75, 24)}
    # 50 strict errors of one rule: all of the rule's five points, 49 of them capped; twice as many files, half the density
    many = found(spark, *[("a", "go-deep/goto-usage", "error", n, 1) for n in range(50)])
    one = P.score(many, 0, smoothing=100.0).first()
    assert (one.total, one.density, one.n_capped) == (5.0, 0.5, 50) and P.score(many, 100, smoothing=100.0).first().density == 0.25
    assert [r.rule for r in P.catalogue(rows).collect()] == ["go-deep/goto-usage", "json/deep-nesting", "own/rule", "types/ts-suppress"]


def test_manifest_audit(spark):
    rows = files(spark, ("a/package.json", '{"engines": {"node": ">=20"}}'), ("a/yarn.lock", ""), ("b/package.json", "{}"), ("c/package.json", '{"engines": {"npm": "1"}}'), ("c/pnpm-lock.yaml", ""))
    got = sorted((r.path, r.rule, r.severity) for r in reports.manifest_audit(rows).collect())
    assert got == [("b/package.json", "dep-audit/missing-engines", "info"), ("b/package.json", "dep-audit/missing-lockfile", "error"), ("c/package.json", "dep-audit/missing-engines", "info")]
    deps = spark.createDataFrame([("a", "dependencies", "glob", "1"), ("a", "devDependencies", "core-js", "2.1"), ("b", "dependencies", "core-js", "3.1"), ("b", "peerDependencies", "request", "1"), ("b", "dependencies", "moment", "1")], "path string, kind string, name string, version string")
    assert sorted((r.path, r.message) for r in reports.dependency_audit(deps).collect() if r.rule == "dep-audit/deprecated") == [("a", "core-js"), ("a", "glob")]


def test_trend_and_history(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{i}", s) for i, s in enumerate((80, 69, 65, 72, 71, None), 1)], "d string, score int").select(F.to_timestamp("d").alias("timestamp"), "score")
    append_history(rows, f"file://{tmp_path}/h")
    (tmp_path / "h" / "broken.json").write_text("{not json\n")
    got = P.trend(read_history(spark, f"file://{tmp_path}/h")).orderBy("timestamp").collect()
    assert [r.kind for r in got if r.timestamp] == [None, "severe-regression", "degrading", "improving", "stable", None]
    assert read_history(spark, f"file://{tmp_path}/h", 2).filter("timestamp is not null").count() == 2
    assert "5 scans" in scan.html_trend(rows) and P.sparkline([0, 7]) == "▁█"
    a, b = (spark.createDataFrame(x, "engine string, n long") for x in ([("x", 20), ("new", 11)], [("x", 10), ("gone", 5)]))
    assert [r.engine for r in P.spikes(a, b).collect()] == ["new"]
    old = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 02:30:00' AS b").select(P.age(F.col("a"), F.col("b")).alias("x"))
    assert old.first().x == "2h ago"


def test_fixes(spark):
    f = files(spark, ("a.py", "try:\n    x()\nexcept:\n    y()  \n# =====\nz()"))
    lines = views.lines(f)
    rows = scan.findings(f, engines=["lines"])
    steps = fixes.plan(fixes.propose(rows, lines))
    assert [(r.line, r.step) for r in steps.orderBy("step").collect()] == [(5, 1), (4, 2), (3, 3)]
    fixed = fixes.apply(f, lines, steps).first().content
    assert fixed == "try:\n    x()\nexcept Exception:\n    y()\nz()"
    left = {r.rule for r in fixes.remaining(rows, steps).collect()}
    assert {r.rule for r in scan.findings(files(spark, ("a.py", fixed)), engines=["lines"]).collect()} - {"python-deep/broad-exception"} == left
    stale = steps.withColumn("old", F.lit("something else"))
    assert fixes.apply(f, lines, stale).first().content == f.first().content


def test_reports(spark):
    rows = found(spark, ("a.ts", "x/a", "error", 3, 2, "mail me@site.org"), ("a.ts", "x/b", "suggestion", 1, 1, ""))
    got = {r.rule: json.loads(r.json) for r in reports.sarif_results(rows).collect()}
    assert got["x/a"]["level"] == "error" and got["x/b"]["level"] == "note" and got["x/a"]["message"]["text"] == "mail [email]"
    assert got["x/a"]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "startColumn": 2}
    assert reports.by_file(rows).first().text == "  3 error x/a\n  1 suggestion x/b"
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "json string")
    assert reports.ruff(one([{"code": "F401", "message": "m", "filename": "a.py", "location": {"row": 2, "column": 3}}])).first()[:5] == ("a.py", "lint-external/ruff/F401", "error", 2, 3)
    assert reports.golangci(one({"Issues": [{"FromLinter": "errcheck", "Text": "t", "Severity": "", "Pos": {"Filename": "a.go", "Line": 1, "Column": 2}}]})).first().rule == "lint-external/golangci/errcheck"
    assert reports.clippy(one({"reason": "compiler-message", "message": {"message": "m", "level": "warning", "code": {"code": "clippy::needless"}, "spans": [{"file_name": "a.rs", "line_start": 4, "column_start": 5, "is_primary": True}]}})).first()[:4] == ("a.rs", "lint-external/clippy/needless", "warning", 4)
    assert reports.npm_audit(one({"vulnerabilities": {"a": {"name": "a", "severity": "high", "range": "<1"}}})).first().severity == "error"
    assert {r.rule for r in reports.knip(one({"files": ["u.ts"], "issues": [{"file": "p", "dependencies": [{"name": "d"}], "exports": [{"name": "e", "line": 1, "col": 2}], "types": [], "classMembers": {"C": [{"name": "m", "line": 3, "col": 1}]}, "enumMembers": {"E": [{"name": "k"}]}}]})).collect()} == {"knip/files", "knip/dependencies", "knip/exports", "knip/classMembers", "knip/enumMembers"}
    assert json.loads(reports.as_json(rows).first().json)["rule"] in ("x/a", "x/b")


def test_verify_and_speed(spark):
    a, b = (spark.createDataFrame([(s,)], "score int") for s in (60, 59))
    assert P.verified(a, b).first().holds is False and P.verified(b, a).first().holds is True
    runs = spark.createDataFrame([("x", 10.0), ("x", 30.0)], "engine string, ms double")
    now, before = scan.timings(runs), scan.timings(runs.withColumn("ms", F.col("ms") * 1.25))
    assert P.slower(now, before).first().change == pytest.approx(-20)
    rows = found(spark, ("a", "x/a", "error", 1, 1), ("a", "y/b", "info", 1, 1))
    assert {r.engine for r in P.category_scores(rows, 1, smoothing=0.0).collect()} == {"x", "y"}


def test_marks(spark):
    from corpusmill.sources.files import byte_order_marks

    raw = spark.createDataFrame([("a", bytearray(b"\xef\xbb\xbfx")), ("b", bytearray(b"x"))], "path string, content binary")
    assert [r.path for r in byte_order_marks(raw).collect()] == ["a"]


def test_project(spark):
    f = files(spark, ("package.json", '{"dependencies": {"next": "1"}, "scripts": {"build": "", "test": "", "lint": ""}}'), (".eslintrc.json", "{}"), ("pnpm-lock.yaml", ""), ("tsconfig.json", '{"compilerOptions": {"strict": true, "target": "es2022"}}'))
    assert {(r.kind, r.name) for r in project.detect(f).collect()} == {("framework", "nextjs"), ("package-manager", "pnpm"), ("linter", "eslint")}
    assert {r.rule for r in project.config_lint(f).collect()} == {"config-lint/missing-prettier", "config-lint/missing-editorconfig"}
    cfg = project.config({"extends": "strict", "quality": {"maxNesting": 2}})
    assert cfg["ci"] == {"failBelow": 85, "failOnErrors": True} and cfg["quality"]["maxNesting"] == 2
    with pytest.raises(ValueError, match="preset"):
        project.config({"extends": "none"})
    with pytest.raises(ValueError, match="kind"):
        project.config({"ci": {"failBelow": "much"}})


def test_scan_and_plugins(spark):
    f = files(spark, ("a.ts", "eval(x)\nx as any\n"), ("b.py", "except:\n"))
    got = scan.findings(f, {"rules": {"types/*": "off", "ast-slop/as-any": "error"}}, engines=["lines"])
    assert sorted((r.rule, r.severity) for r in got.collect()) == [("ast-slop/as-any", "error"), ("python-deep/bare-except", "error"), ("security-deep/eval-usage", "error")]
    row = scan.result(f, got, 2, {"scoring": {"smoothing": 0}}).first()
    assert row.n_error == 3 and row.score < 100
    assert scan.result(f, got.limit(0), 2).first().score == 100

    @scan.detector("own")
    def own(c):
        return c.lines.filter("text = ''").select("path", F.lit("own/empty").alias("rule"), F.lit("info").alias("severity"), F.col("num").cast("int").alias("line"), F.lit(1).alias("col"), F.lit("").alias("message"))

    try:
        assert scan.findings(f, engines=["own"]).count() == 2
        with pytest.raises(ValueError, match="registered"):
            scan.detector("own")(own)
    finally:
        del scan.REGISTRY["own"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("".join(json.dumps({"path": p, "ts": t, "ext": "ts", "lang": "typescript", "content": c}) + "\n" for p, t, c in [("a.ts", "2024-01-01T00:00:00", "eval(x)"), ("a.ts", "2024-01-01T00:00:01", "fine()"), ("b.ts", "2024-01-01T00:00:30", "eval(y)")]))
    schema = "path string, ts timestamp, ext string, lang string, content string"
    got = []
    stream = spark.readStream.schema(schema).json(f"file://{src}")
    q = changes.rescan(stream, lambda f: scan.findings(f, engines=["lines"]), lambda rows, n: got.extend((r.path, r.rule) for r in rows.collect()), f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got == [("b.ts", "security-deep/eval-usage")]
    rows = spark.read.schema(schema).json(f"file://{src}")
    assert sorted(r.n_changes for r in changes.quiet(rows).collect()) == [1, 2]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.json").write_text("".join(json.dumps(x) + "\n" for x in [{"path": "a", "scan": 1, "found": ["r:1", "r:2"]}, {"path": "a", "scan": 2, "found": ["r:2", "s:3"]}]))
    latest = changes.latest_findings(spark.readStream.schema("path string, scan long, found array<string>").json(f"file://{tmp_path}/f"))
    q = latest.writeStream.format("memory").queryName("latest").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.finding, r.change) for r in spark.table("latest").collect()) == [("r:1", "added"), ("r:1", "removed"), ("r:2", "added"), ("s:3", "added")]
    assert changes.repair_steps([50, 60, 55, 90, 95], 90, 5) == [(1, "keep"), (2, "rollback"), (3, "keep"), (3, "stop")]


def test_base_imports_without_the_other_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "corpusmill"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "corpusmill.llm" not in p.read_text(), p


def test_plans_stay_lean(spark, tmp_path):
    """Line rules read the columns that they need and move nothing; corpus joins do not nest loops."""
    from corpusmill import queries

    root = f"file://{tmp_path}"
    spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, "n") for i in range(40)], "p_partkey long, p_name string").write.parquet(f"{root}/part.parquet")
    plan = lambda name: queries.QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
    lean = plan("max_line_length")
    assert "Exchange" not in lean and "ReadSchema: struct<doc_id:bigint,text:string>" in lean
    for name in ("unused_exports", "unused_imports", "repeated_constants", "copied_functions", "suppressed", "first_of_each", "score_log"):
        assert "NestedLoop" not in plan(name) and "CartesianProduct" not in plan(name), name


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot(spark, monkeypatch, how):
    from corpusmill.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    left = spark.createDataFrame([(i, 1 if i % 2 else i % 11) for i in range(100)] + [(200, None)], "id int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(9)], "k int, v string")
    got = sorted(map(str, skew.join_hot(left, right, "k", 100, how).select("id", "k", "v").collect()))
    assert got == sorted(map(str, left.join(right, "k", how).select("id", "k", "v").collect()))
