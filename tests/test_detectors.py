"""Detectors on literal lines: what they find, what they leave alone, and their thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import context_rules as C
from corpusmill.operators import folds, line_rules, relations, views
from corpusmill.sources.files import as_files, collect, glob_regex

EXT = {"typescript": "ts", "javascript": "js", "python": "py", "go": "go", "rust": "rs", "html": "html", "css": "css", "markdown": "md", "yaml": "yaml", "json": "json"}


def files(spark, *pairs):
    return as_files(spark.createDataFrame(list(pairs), "p string, c string"), F.col("p"), F.col("c"))


def rules(rows):
    return sorted({(r.rule, r.line) for r in rows.collect()})


# rule, a line that it finds, a line that it leaves
LINES = [
    ("ast-slop/narrative-comment", "// Initialize it", "// because of x"),
    ("ast-slop/decorative-comment", "// =====", "// a = b"),
    ("ast-slop/meta-comment", "// Auto-generated", "// by hand"),
    ("ast-slop/todo-stub", "// TODO later", "// TODO(#12) later"),
    ("ast-slop/generic-name", "const tmp = 1", "const total = 1"),
    ("ast-slop/as-any", "x as any", "x as unknown as any2"),
    ("ast-slop/double-assertion", "x as unknown as string", "x as unknown as Row"),
    ("ast-slop/hardcoded-config", "u = 'https://api.net/x'", "u = 'http://localhost/x'"),
    ("types/ts-suppress", "// @ts-ignore", "// ts is fine"),
    ("types/generic-any", "x: Array<any>", "x: Array<string>"),
    ("types/double-assertion", "x as unknown as Row", "x as Row"),
    ("html/missing-lang", "<html>", "<html lang='en'>"),
    ("syntax-deep/unicode-anomaly", "x\u200b = 1", "x = 1"),
    ("types/non-null-assertion", "a.b!.c", "a != b"),
    ("security-deep/eval-usage", "eval(x)", "// eval(x)"),
    ("security-deep/sql-injection", "db.query('SELECT 1 ' + x)", "db.query('find ' + x)"),
    ("security-deep/shell-injection", "exec(`rm ${x}`)", "exec('ls')"),
    ("security-deep/xss-risk", "<div v-html=\"x\"", "<div>"),
    ("security-deep/ssrf-risk", "fetch(url)", "fetch('/a')"),
    ("security-deep/prototype-pollution", "a.__proto__ = b", "a.proto = b"),
    ("security-deep/hardcoded-secret", "password = 'longenough'", "password = 'short'"),
    ("dead-flow/dead-conditional", "if (false) {", "if (x) {"),
    ("nextjs/next-router-vs-navigation", "import { r } from 'next/router'", "import { r } from 'next/link'"),
    ("python-deep/bare-except", "except:", "except ValueError:"),
    ("python-deep/star-import", "from a import *", "from a import b"),
    ("python-deep/mutable-default", "def f(a=[]):", "def f(a=None):"),
    ("python-deep/no-return-type", "def f(a):", "def f(a) -> int:"),
    ("python-deep/f-string-in-log", "logger.info(f'x')", "logger.info('x')"),
    ("go-deep/goto-usage", "goto end", "// goto end"),
    ("go-deep/empty-interface", "x interface{}", "x any"),
    ("rust-deep/unwrap-in-prod", "x.unwrap()", "x.unwrap_or(1)"),
    ("rust-deep/todo-macro", "todo!()", "// todo!()"),
    ("html/missing-alt", "<img src='a'>", "<img alt='a'>"),
    ("html/deprecated-tag", "<center>", "<section>"),
    ("md/broken-link", "[a](#)", "[a](b)"),
    ("yaml/tab-indent", "\ta: 1", "  a: 1"),
    ("css/universal-selector", "* {", ".a {"),
    ("syntax-deep/trailing-whitespace", "a ", "a"),
    ("syntax-deep/mixed-indent-line", " \ta", "\ta"),
]


def test_line_rules(spark):
    rows = []
    for n, (rule, hit, miss) in enumerate(LINES):
        lang = next(r for r in line_rules.RULES if r.id == rule).langs[0]
        rows.append((f"a{n}.{EXT[lang]}", f"{hit}\n{miss}"))
    found = {(r.path, r.rule, r.line) for r in line_rules.detect(views.lines(files(spark, *rows))).collect()}
    for n, (rule, _, _) in enumerate(LINES):
        own = {line for p, r, line in found if r == rule and p.startswith(f"a{n}.")}
        assert own == {1}, rule


@pytest.mark.parametrize(("n", "hit"), [(119, False), (120, False), (121, True)])
def test_line_length(spark, n, hit):
    rows = line_rules.detect(views.lines(files(spark, ("a.ts", "x" * n))), [r for r in line_rules.RULES if r.id == "format-lint/max-line-length"])
    assert (rows.count() == 1) == hit


def test_rules_off_and_tests(spark):
    ls = views.lines(files(spark, ("src/a.test.ts", "eval(x)\ndebugger"), ("b.ts", "eval(x)")))
    assert {(r.path, r.rule) for r in line_rules.detect(ls).collect()} == {("b.ts", "security-deep/eval-usage")}
    assert line_rules.detect(ls, disabled={"security-deep/eval-usage"}).count() == 0


def test_repartitioning_changes_nothing(spark):
    from corpusmill import synthetic

    rows = [(f"{a}/f{i}.{b}", c.replace("$K", str(i))) for i, (a, b, c) in enumerate(synthetic.SNIPPETS)]
    f = files(spark, *rows)
    one = sorted(map(str, C.all_rules(f.repartition(1), views.lines(f.repartition(1))).collect()))
    assert one == sorted(map(str, C.all_rules(f, views.lines(f.repartition(16))).collect())) and len(one) > 40


@pytest.mark.parametrize(("blank", "hit"), [(2, False), (3, True)])
def test_blank_lines(spark, blank, hit):
    got = rules(C.blank_line_cluster(views.lines(files(spark, ("a.ts", "x" + "\n" * (blank + 1) + "y")))))
    assert got == ([("format-lint/blank-line-cluster", 2)] if hit else [])


def test_votes(spark):
    text = "\n".join(["const a = 'x'"] * 3 + ['const b = "y"'] * 2)
    assert ("format-lint/inconsistent-quotes", 4) in rules(C.styles(views.lines(files(spark, ("a.js", text)))))
    many = "\n".join(["  a()"] * 20 + ["\tb()"] * 9)
    got = [r for r in rules(C.styles(views.lines(files(spark, ("a.js", many))))) if r[0].endswith("indent")]
    assert [n for _, n in got] == [21, 22, 23, 24, 25]


def test_nesting_matches_a_loop(spark):
    rng = random.Random(3)
    texts = ["\n".join("".join(rng.choice("{}a") for _ in range(rng.randrange(4))) for _ in range(30)) for _ in range(20)]
    got = {(r.path, r.num): r.depth for r in C.nesting(views.lines(files(spark, *[(f"{i}.ts", t) for i, t in enumerate(texts)]))).collect()}
    for i, t in enumerate(texts):
        depth = 0
        for n, line in enumerate(t.split("\n"), 1):
            step = line.count("{") - line.count("}")
            depth = max(0, depth + step)
            assert got[(f"{i}.ts", n)] == depth


def test_comment_state_matches_a_loop(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["a", "/*", "*/", "/* x */", "b /* c", "d */ e"]) for _ in range(25)) for _ in range(10)]
    got = {(r.path, r.num): r.in_comment for r in folds.comment_lines(views.lines(files(spark, *[(f"{i}.ts", t) for i, t in enumerate(texts)]))).collect()}
    for i, t in enumerate(texts):
        inside = False
        for n, line in enumerate(t.split("\n"), 1):
            assert got[(f"{i}.ts", n)] == inside
            a, b = line.rfind("/*"), line.rfind("*/")
            inside = True if a > b else False if b > a else inside


def _inside(text, at):
    """As a loop over characters says it."""
    counts = dict.fromkeys("'\"`", 0)
    i = 0
    while i < at:
        if text[i] == "\\":
            i += 2
            continue
        if text[i] in counts:
            counts[text[i]] += 1
        i += 1
    if any(n % 2 for n in counts.values()):
        return True
    for i in range(1, at):
        if text[i] == "/" and text[i - 1] in "=(:,;[!&|?{}+-~^%<> ":
            j, in_class = i + 1, False
            while j < len(text) and (text[j] != "/" or in_class):
                if text[j] == "\\":
                    j += 1
                elif text[j] == "[":
                    in_class = True
                elif text[j] == "]":
                    in_class = False
                j += 1
            if j < len(text) and at < j:
                return True
    return False


def test_inside_string(spark):
    from corpusmill.functions.text import inside_string

    lines = ["eval(1)", "x = 'eval(1)'", 'x = "eval(1)"', "x = `eval(1)`", "x = 'it' + eval(1)", r"x = 'it\'s' + eval(1)", "x = /eval(1)/", "x = /a[/]eval(1)/", "x = a / eval(1) / b", r"x = /a\/eval(1)/", "x = a/eval(1)/b", "x = /a/ + eval(1)"]
    rows = spark.createDataFrame([(x, x.index("eval") + 1) for x in lines], "text string, at int").select("text", "at", inside_string(F.col("text"), F.col("at")).alias("inside"))
    assert {r.text: r.inside for r in rows.collect()} == {x: _inside(x, x.index("eval")) for x in lines}
    got = line_rules.detect(views.lines(files(spark, ("a.js", "\n".join(lines)))), [r for r in line_rules.RULES if r.id == "security-deep/eval-usage"]).collect()
    assert sorted(r.line for r in got) == [n for n, x in enumerate(lines, 1) if not _inside(x, x.index("eval"))]


def test_go_imports(spark):
    text = 'package x\nimport "fmt"\nimport (\n\tio "a/b/files"\n\t. "c/d"\n\n\t_ "e"\n)\nvar x = "not/this"\n'
    got = sorted((r.num, r.source, r.name) for r in views.go_imports(views.lines(files(spark, ("a.go", text)))).collect())
    assert got == [(2, "fmt", "fmt"), (4, "a/b/files", "io"), (5, "c/d", "."), (7, "e", "_")]


def test_word_edges():
    """Edges by one look mean what an edge on both sides means, in every rule and on made-up texts."""
    import re

    from corpusmill.functions import text

    rng = random.Random(7)
    patterns = [p for r in line_rules.RULES for p in (r.pattern, r.but) if r"\b" in p]
    patterns += [r"\b(?:a|bc)\b", r"\b(?:a|\.b)", r"x?\b", r"\ba*", r"(?:a|b)\b", r"(?:a|b)?\bc", r"\w+\b", r"\w*\b", r"\b\w+", r"\b\d+", r"=\b", r"\b\(a"]
    bits = ["as", " ", "any", "é", "eval", "(", ")", ".", "_", "x", "unknown", "type", ":", "=", "TODO", "interface", "{", "}", "goto", "a1", "document", "write", "-", "中"]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    python = lambda p: p.replace(r"\z", r"\Z").replace(r"\x{", r"\u{")
    assert text.java(r"\beval\s*\(") == r"(?<![A-Za-z0-9_])eval\s*\(" and text.java(r"\bas\s+any\b").endswith("any(?![A-Za-z0-9_])")
    for p in patterns:
        one, both = re.compile(python(text.java(p)), re.A), re.compile(python(p.replace(r"\b", text._EDGE)), re.A)
        for line in lines:
            assert [m.span() for m in one.finditer(line)] == [m.span() for m in both.finditer(line)], (p, line)


def test_every_match_counts(spark):
    text = ["a = [x as unknown as Left, y as unknown as Right]", "let m: Map<string, any>, p: Promise<any>", "a\u0001b\u007f\u2066\ufff9\ufeff"]
    html = "<img src='a'> <img src='b' alt='b'> <IMG src='c'>\n<html data-x><html lang='de'>\n<center><b onclick='a()' onblur='b()'>"
    got = sorted((r.path, r.line, r.rule, r.message) for r in line_rules.detect(views.lines(files(spark, ("a.ts", "\n".join(text)), ("b.html", html)))).collect() if r.rule.split("/")[0] in ("types", "html") or "unicode" in r.rule)
    want = [("a.ts", 1, "types/double-assertion", f"as unknown as {x}") for x in ("Left", "Right")]
    want += [("a.ts", 2, "types/generic-any", x) for x in ("Map<string, any>", "Promise<any>", "Promise<any>")]  # as a Promise, and as any T<any>
    want += [("a.ts", 3, "syntax-deep/unicode-anomaly", x) for x in "\u0001\u007f\u2066\ufeff\ufff9"]
    want += [("b.html", 1, "html/missing-alt", "<img src='a'>"), ("b.html", 1, "html/missing-alt", "<IMG src='c'>"), ("b.html", 2, "html/missing-lang", "<html data-x>")]
    want += [("b.html", 3, "html/deprecated-tag", "<center"), ("b.html", 3, "html/inline-event-handler", "onclick="), ("b.html", 3, "html/inline-event-handler", "onblur=")]
    assert got == sorted(want)


def test_hints_are_implied(spark):
    """Rules that look for a string first find the same without."""
    from dataclasses import replace

    rows = [(f"a{n}.{EXT[next(r for r in line_rules.RULES if r.id == rule).langs[0]]}", f"{hit}\n{miss}") for n, (rule, hit, miss) in enumerate(LINES)]
    lines = views.lines(files(spark, *rows))
    key = lambda rules: sorted(map(str, line_rules.detect(lines, rules).collect()))
    assert key(line_rules.RULES) == key([replace(r, has=()) for r in line_rules.RULES])


def test_meta_comments(spark):
    text = "// Generated by x\n# Created with GPT\n# Written by GPT\n/* Created with GPT */\n// written by copilot\n/* AI assisted */\n// generic"
    assert rules(line_rules.detect(views.lines(files(spark, ("a.ts", text))), [r for r in line_rules.RULES if r.id == "ast-slop/meta-comment"])) == [("ast-slop/meta-comment", n) for n in (1, 2, 5, 6)]


@pytest.mark.parametrize(("number", "lost"), [("9007199254740993", True), ("100000000000000000", False), ("9007199254740992", False), ("12345678901234567", True), ("0.1234567890123456789", True), ("123", False), ("0xFFFFFFFFFFFFFFFFF", False), ("1234567890.1234567", False), ("1.0000000000000000", True), ("1234567890123456e3", True)])
def test_precision_loss(spark, number, lost):
    got = line_rules.precision_loss(views.lines(files(spark, ("a.ts", f"x = {number}")))).collect()
    assert [(r.message, r.line, r.col) for r in got] == ([(number, 1, 5)] if lost else [])


def test_swallowed(spark):
    js = ["try {} catch (e) {}", "} catch (e) {", "", "  // nothing", "}", "} catch {", "  log()", "}", "} catch (e) {", "", "", "", "", "}"]
    py = ["except ValueError as e:", "    # why", "    pass", "except:", "    ...", "except (A, B):", "    pass", "except X:", "", "", "    pass"]
    ls = views.lines(files(spark, ("a.js", "\n".join(js)), ("b.py", "\n".join(py))))
    assert sorted((r.path, r.line) for r in C.swallowed(ls).collect()) == [("a.js", 1), ("a.js", 2), ("b.py", 1), ("b.py", 4)]


def test_function_bodies(spark):
    js = "export async function one(a,\n  b) {\n  go() // x\n\n  if (a) {\n    stop({ b })\n  }\n  return a\n}\nconst two = (a) => {\n  go()\n  if (a) {\n    stop({ b })\n  }\n  return a\n}\nclass K {\n  three(x): void {\n    return a_long_enough_name(x)\n  }\n}\nif (x) {\n}\nfunction open() {\n  never closed in this file at all\n"
    got = folds.function_bodies(js, "typescript")
    same = "go()\nif (a) {\nstop({ b })\n}\nreturn a"
    assert got[:3] == [(1, 9, "one", 6, "b) {\n" + same), (10, 16, "two", 5, same), (18, 20, "three", 1, "return a_long_enough_name(x)")]
    assert got[3][:3] == (24, 26, "open")
    py = "def f(a):\n    x = 1  # one\n\n    return a + x + 12345\n\ndef g():\n    pass\n"
    assert folds.function_bodies(py, "python") == [(1, 4, "f", 2, "x = 1\nreturn a + x + 12345")]
    body = "".join(f"  step{i}(value)\n" for i in range(6))
    rows = [("a.ts", f"function one() {{\n{body}}}\nfunction two() {{\n{body}}}\n"), ("b.ts", f"function three() {{\n{body}  // end\n}}\nfunction one() {{\n{body.replace('step0', 'other')}}}\nfunction init() {{\n{body}}}\n")]
    got = relations.copied_functions(folds.functions(files(spark, *rows))).collect()
    assert [(r.n, r.n_names, r.path, r.line, r.name) for r in got] == [(3, 3, "a.ts", 1, "one")]


def test_layers(spark):
    rows = [("src/ui/a.ts", "import { a } from '../x/data/models/b'"), ("src/api/b.ts", "import { a } from '../x/db/c'"), ("src/api/c.ts", "import { a } from '../services/db/c'"), ("src/pages/d.ts", "import { a } from './entities/c'"), ("src/pages/e.ts", "import { a } from './entity/c'")]
    got = relations.layer_violation(views.imports(views.lines(files(spark, *rows)))).collect()
    assert sorted(r.path for r in got) == ["src/api/b.ts", "src/pages/d.ts", "src/ui/a.ts"]


def test_windows(spark):
    py = "def a():\n    pass\ndef b():\n    '''doc'''\ntry:\n    x()\nexcept ValueError:\n    pass\n"
    ls = views.lines(files(spark, ("a.py", py)))
    assert rules(C.first_body_line(ls)) == [("python-deep/missing-docstring", 1), ("python-deep/pass-stub", 1)]
    assert rules(C.swallowed(ls)) == [("ast-slop/swallowed-exception", 7)]
    js = "function f() {\n  return 1;\n  late()\n}\nif (a) {\n  return 1;\n} else {\n  return 2;\n}\nnever()\n"
    ls = views.lines(files(spark, ("a.js", js)))
    assert rules(C.unreachable(ls)) == [("dead-flow/unreachable-after-terminator", 3)]
    assert rules(C.both_branches_end(ls)) == [("dead-flow/unreachable-after-if-else-return", 10)]
    assert rules(C.trivial_comment(views.lines(files(spark, ("a.js", "// increment the counter value\ncounter = value + 1\n// why not\nx()"))))) == [("ast-slop/trivial-comment", 1)]


def test_more_context(spark):
    f = files(
        spark,
        ("a.ts", "interface One {}\nclass A implements One {}\nlet s: string = x\nif (typeof s === 'string') {}\nfunction f() {\n  // TODO implement\n  return null;\n}\n"),
        ("b.js", "console.log(1)\ntry {\n  a()\n} catch (e) {\n  console.log(e)\n}\n"),
        ("c.js", "try {\n  a()\n} catch (e) {\n\n}\n"),
    )
    assert rules(C.more_rules(f, views.lines(f))) == [("ast-slop/console-leftover", 1), ("ast-slop/overdefensive-type", 4), ("ast-slop/placeholder-impl", 5), ("ast-slop/silent-recovery", 3), ("ast-slop/unnecessary-abstraction", 1)]


def test_line_endings(spark):
    f = files(spark, ("a.ts", "a\r\nb\r\n"), ("b.ts", "a\r\nb\nc\nd\n"), ("c.ts", "a\n"))
    assert rules(C.line_endings(views.lines(f))) == [("syntax-deep/crlf-line-endings", 1), ("syntax-deep/mixed-line-endings", 1)]
    assert {r.path: r.line_ending for r in views.encoding(f).collect()} == {"a.ts": "crlf", "b.ts": "mixed", "c.ts": "lf"}


def test_folds(spark):
    f = files(
        spark,
        ("a.json", '{"a": 1, "b": {"a": 2, "a": 3}}'), ("a.yaml", "a:\n  b: 1\n  b: 2\nc:\n  b: 1\n- x: 1\n- x: 2\n"),
        ("a.ts", "for (const x of y) {\n  const r = await db.find(x)\n  s += `a`\n  new Array(500)\n}\nasync function g() {\n  readFileSync('a')\n}\nconst p = '\\d'\nconst q = /[\\.]/\n"),
        ("a.go", "func f() {\n\tfor {\n\t\tdefer g()\n\t}\n}\n"), ("a.py", "def f(a=[]):\n    pass\nclass C:\n    pass\n"), ("bad.py", "def ("),
        ("a.rs", "enum E {\n    A,\n    B(String, Vec<u8>, HashMap<u8, u8>),\n}\n"), ("b.js", "switch (a) {\n  case 1:\n    break;\n    x()\n  default:\n    y()\n  case 2:\n    z()\n}\n"),
    )
    got = {(r.rule, r.line) for r in folds.all_folds(f).collect()}
    assert {("json/duplicate-keys", 1), ("yaml/duplicate-keys", 3), ("perf-hints/n-plus-one", 2), ("perf-hints/string-concat-in-loop", 3), ("perf-hints/large-loop-allocation", 4), ("perf-hints/sync-in-async", 7), ("syntax-deep/regex-escape-in-string", 9), ("syntax-deep/unnecessary-regex-class-escape", 10), ("go-deep/defer-in-loop", 3), ("python-deep/mutable-default", 1), ("ast-slop/py-stub-function", 1), ("ast-slop/py-empty-class", 3), ("rust-deep/large-enum-variant", 1), ("dead-flow/dead-switch-code", 4), ("dead-flow/dead-switch-case-after-default", 7)} <= got
    assert ("yaml/duplicate-keys", 7) not in got


def test_imports(spark):
    text = "import a, { b as c, type D } from './x'\nimport type { E } from 'y'\nconst z = require('w')\nimport('v')\nimport 'side'\nuse(c)\n"
    f = files(spark, ("src/m.ts", text), ("n.py", "from os import path\nimport sys\n"), ("src/x.ts", "export const b = 1\nexport function unused() {}\n"))
    imports = views.imports(views.lines(f))
    assert sorted((r.source, tuple(r.symbols), r.type_only) for r in imports.filter("lang <> 'python'").collect()) == [("./x", ("a", "c", "D"), False), ("v", (), False), ("w", (), False), ("y", ("E",), True)]
    assert sorted(r.source for r in imports.filter("lang = 'python'").collect()) == ["os", "sys"]
    got = {(r.rule, r.line, r.message) for r in relations.unused_imports(imports, views.lines(f)).collect()}
    assert got == {("import-intelligence/unused-symbol", 1, "D,a"), ("import-intelligence/unused-import", 2, "E")}
    assert [(r.src, r.dst) for r in relations.import_edges(imports, f).collect()] == [("src/m.ts", "src/x.ts")]
    assert {r.message for r in relations.unused_exports(views.exports(views.lines(f)), imports).collect()} == {"b", "unused"}
    declared = spark.createDataFrame([("w",)], "name string")
    assert {r.message for r in relations.undeclared_imports(imports, declared).collect()} == {"v", "y"}


@pytest.mark.parametrize("deepest", [2, 3, 5])
def test_cycles(spark, deepest):
    rng = random.Random(deepest)
    edges = {(str(rng.randrange(8)), str(rng.randrange(8))) for _ in range(18)}
    want = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0]:
                    want.add(" > ".join(path))
                elif b > path[0] and b not in path and len(path) < deepest:
                    walk([*path, b])

    for v in {a for a, _ in edges}:
        walk([v])
    got = {r.cycle for r in relations.cycles(spark.createDataFrame(list(edges), "src string, dst string"), deepest).collect()}
    assert got == want


def test_circular_dependency(spark):
    from corpusmill.plans import scan

    ring = [(f"src/m{i}/f.ts", f"const k = {i}\nimport {{ a }} from '../m{(i + 1) % 5}/f'\n") for i in range(5)]
    f = files(spark, *ring, ("src/x.ts", "import { a } from './y'\n"), ("src/y.ts", "import { a } from './m0/f'\n"), ("src/z.ts", "import z from './z'\n"))
    got = {(r.path, r.line, r.message) for r in scan.REGISTRY["cycles"](scan.Context(f, scan.read_config(None))).filter("rule = 'import-intelligence/circular-dependency'").collect()}
    assert got == {("src/m0/f.ts", 2, " > ".join(p for p, _ in ring)), ("src/z.ts", 1, "src/z.ts")}


def test_cycles(spark, tmp_path):
    from corpusmill import queries

    spark.createDataFrame([(i, i * 7 % 25 - 7) for i in range(7, 20)] + [(k, n) for n, k in ((0, 18), (1, 11), (2, 4), (3, 22), (4, 0))], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    edges = {(str(r.s_nationkey), str(r.s_suppkey * 7 % 25)) for r in spark.read.parquet(f"{tmp_path}/supplier.parquet").collect()}
    want = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0]:
                    want.add(" > ".join(path))
                elif b > path[0] and b not in path and len(path) < 5:
                    walk([*path, b])

    for v in {a for a, _ in edges}:
        walk([v])
    assert {r.cycle for r in queries.QUERIES["cycles"](spark, str(tmp_path)).collect()} == want and "0 > 1 > 2 > 3 > 4" in want


def test_similar_sets(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(30)]
    sets = [(i, sorted({*base[: 28 - i % 3], *(f"u{rng.randrange(40)}" for _ in range(i % 4))})) for i in range(25)] + [(99, ["only"])]
    got = {(r.a, r.b) for r in relations.similar_sets(spark.createDataFrame(sets, "id int, tokens array<string>")).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len({*x} & {*y}) >= 90 * len({*x} | {*y})}
    assert got == want and want


def test_similar_groups(spark):
    rng = random.Random(6)
    base = [f"t{i}" for i in range(30)]
    sets = [(i, rng.sample(own, len(own))) for i in range(60) for own in [sorted({*base[: 28 - i % 3], *(f"u{rng.randrange(9)}" for _ in range(i % 4))})]] + [(99, ["only"]), (100, []), (101, [])]
    got = relations.similar_groups(spark.createDataFrame([*sets, (102, None)], "id int, tokens array<string>")).collect()
    same = {r.b: r.a for r in got if r.n_both == r.n_either}
    near = {(r.a, r.b) for r in got if r.n_both < r.n_either}
    first = lambda i: same.get(i, i)
    want = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len({*x} & {*y}) >= 90 * len({*x} | {*y})}
    assert {(a, b) for a, _ in sets for b, _ in sets if a < b and (first(a) == first(b) or tuple(sorted((first(a), first(b)))) in near)} == want
    assert same and near and len(got) == len(same) + len(near) < len(want)


def test_similar_files(spark, tmp_path):
    import re

    from corpusmill import queries, synthetic

    spark.range(1, 121).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    sets = {r.path: {*re.findall("[A-Za-z_]+", r.content)} for r in synthetic.files(spark, str(tmp_path)).collect()}
    got = queries.QUERIES["similar_files"](spark, str(tmp_path)).collect()
    same = {r.b: r.a for r in got if r.n_both == r.n_either}
    near = {(r.a, r.b) for r in got if r.n_both < r.n_either}
    first = lambda i: same.get(i, i)
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and 100 * len(x & y) >= 90 * len(x | y)}
    assert {(a, b) for a in sets for b in sets if a < b and (first(a) == first(b) or tuple(sorted((first(a), first(b)))) in near)} == want and want


def test_blocks(spark):
    shared = "\n".join(f"statement number {i}" for i in range(24))
    f = files(spark, ("a.ts", shared + "\nx"), ("b.ts", shared + "\ny"), ("c.ts", "short"))
    blocks = relations.blocks(f)
    assert {r.n_files for r in relations.identical_blocks(blocks).collect()} == {2}
    assert sorted((r.path, r.start, r.stop) for r in relations.merged_regions(blocks).collect()) == [("a.ts", 1, 24), ("b.ts", 1, 24)]


@pytest.mark.parametrize(("n", "hit"), [(14, False), (15, True)])
def test_spread_imports(spark, n, hit):
    f = files(spark, *[(f"f{i}.ts", "import { a } from 'pkg'") for i in range(n)])
    got = relations.spread_imports(views.imports(views.lines(f))).collect()
    assert [(r.source, r.n_files, r.symbols) for r in got] == ([("pkg", n, "a")] if hit else [])


def test_sources(spark):
    import re

    fits = lambda glob, path: re.match(glob_regex(glob).replace(r"\z", r"\Z"), path)
    assert fits("src/**/*.ts", "src/a/b.ts") and fits("src/**/*.ts", "src/b.ts") and not fits("*.ts", "a/b.ts")
    f = files(spark, ("src/a.ts", ""), ("node_modules/b.ts", ""), ("src/c.py", "\ufeffx"), ("src/gen/d.ts", ""))
    assert {r.path for r in collect(f, langs=["typescript"], ignore=["**/gen/**"]).collect()} == {"src/a.ts"}
    assert f.filter("lang = 'python'").first().content == "x"


def test_import_quality(spark):
    f = files(
        spark, ("src/a.ts", "import { T, v } from './t'\nimport { O } from './o'\nimport { w } from './lib/index'\nimport { far } from '../../x/y'\nimport { no } from '@/missing'\nconst x: T = v\nlet o: O\n"),
        ("src/lib/index.ts", "export { w } from './w'\n"), ("a/m.go", "package a\nimport \"x/b\"\n"), ("b/m.go", "package b\nimport \"x/a\"\n"),
    )
    ls = views.lines(f)
    imports = views.imports(ls)
    assert {r.message for r in relations.type_only_imports(imports, ls).collect()} == {"./o"}
    assert {r.message for r in relations.barrel_bypass(imports, relations.reexports(ls)).collect()} == {"w ./w"}
    assert {r.rule for r in relations.aliases(imports, f).collect()} == {"import-intelligence/alias-canonical", "import-intelligence/broken-alias"}
    assert [r.cycle for r in relations.cycles(relations.package_edges(ls)).collect()] == ["a > b"]
