"""Lexical states against a letter-by-letter walk; tokens, blocks and statements against literal expectations."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import syntax, views
from corpusmill.sources.files import as_files


def _files(spark, *texts, ext="ts"):
    return as_files(spark.createDataFrame([(f"f{i}.{ext}", t) for i, t in enumerate(texts)], "p string, c string"), F.col("p"), F.col("c"))


def walk(lines):
    """The state that each line starts in, a letter at a time."""
    state, out = 0, []
    for line in lines:
        out.append(state)
        i = 0
        while i < len(line):
            two, c = line[i : i + 2], line[i]
            if state == 1:
                if two == "*/":
                    state, i = 0, i + 1
            elif state in (2, 3, 4):
                if c == "\\":
                    i += 1
                elif c == {2: "`", 3: "'", 4: '"'}[state]:
                    state = 0
            elif two == "//":
                break
            elif two == "/*":
                state, i = 1, i + 1
            elif c in "`'\"":
                state = {"`": 2, "'": 3, '"': 4}[c]
            i += 1
        state = 0 if state > 2 else state
    return out


def test_states_by_letters(spark, monkeypatch):
    monkeypatch.setattr(syntax, "CHUNK", 3)
    r = random.Random(4)
    parts = ["a", " b;", "/*", "*/", "`", "'", '"', "\\'", "\\\\", "//", "x*", "é", "$", "{}"]
    texts = ["\n".join("".join(r.choice(parts) for _ in range(r.randrange(6))) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    got = {}
    for row in syntax.states(views.lines(_files(spark, *texts)).repartition(5)).collect():
        got.setdefault(row.path, {})[row.num] = row.state
    for i, t in enumerate(texts):
        lines = t.split("\n")
        assert [got[f"f{i}.ts"][n + 1] for n in range(len(lines))] == walk(lines), t


def test_states_of_long_lines_and_files(spark):
    texts = ["x = '" + "\\'a" * 10**5 + "`", "/*" + "* " * 10**5 + "\n" + "`" * 10**5 + "*/ `\nq", "`" + "\\`" * 10**5 + "\nz`", "// `\n" * 70_000 + "/*\nx", None, ""]
    rows = syntax.states(views.lines(_files(spark, *texts))).filter("state > 0").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("num", "state"))).alias("s")).collect()
    assert {r.path: [tuple(x) for x in r.s] for r in rows} == {"f1.ts": [(2, 1), (3, 2)], "f2.ts": [(2, 2)], "f3.ts": [(70_002, 1)]}


def test_findings_that_stay(spark):
    ls = views.lines(_files(spark, "/*\neval(x)\n*/ eval(y)"))
    found = spark.createDataFrame(
        [("f0.ts", "security-deep/eval-usage", "error", 2, 1, ""), ("f0.ts", "security-deep/eval-usage", "error", 3, 4, ""), ("f0.ts", "ast-slop/narrative-comment", "info", 2, 1, ""), ("f0.py", "security-deep/eval-usage", "error", 2, 1, ""), ("f0.ts", "dead-flow/unused-export", "info", 999_999, 1, ""), ("f0.ts", None, "info", 2, 1, "")],
        "path string, rule string, severity string, line int, col int, message string",
    )
    assert sorted((r.path, r.rule or "", r.line) for r in syntax.in_code(found, ls).collect()) == [("f0.py", "security-deep/eval-usage", 2), ("f0.ts", "", 2), ("f0.ts", "ast-slop/narrative-comment", 2), ("f0.ts", "dead-flow/unused-export", 999_999), ("f0.ts", "security-deep/eval-usage", 3)]


def test_tokens(spark):
    text = "const a = /[/`]x/g.test(b) ? c / d / e : `t${ {k: `u${v}`} }w` // end\nlet s = 'it\\'s', n = 1e-5 /* } */ ?? 0x1F;"
    rows = syntax.tokens(_files(spark, text)).orderBy("seq").collect()
    assert [r.text for r in rows] == ["const", "a", "=", "/[/`]x/g", ".", "test", "(", "b", ")", "?", "c", "/", "d", "/", "e", ":", "`t${", "{", "{", "k", ":", "`u${", "{", "v", "}", "}`", "}", "}", "}w`", "let", "s", "=", "'it\\'s'", ",", "n", "=", "1e-5", "??", "0x1F", ";"]
    assert [(r.line, r.col) for r in rows if r.text in ("let", "1e-5")] == [(2, 1), (2, 22)]
    opened = {r.seq: r.mate for r in rows if r.text in ("(", "{") and r.kind == "mark"}
    assert all(rows[b].mate == a for a, b in opened.items()) and len(opened) == 4
    by = {r.text: r for r in rows}
    assert rows[by["b"].parent].text == "(" and by["let"].parent == -1


def test_tokens_of_odd_files(spark):
    texts = [None, "", "}}) ( [ {", "`never ${ closed", "'open\nx", "/* open", "{" * 3000 + "}" * 3000, "\x00 é 中 #", "a" * 10**6]
    rows = syntax.tokens(_files(spark, *texts)).groupBy("path").agg(F.count("*").alias("n"), F.count("mate").alias("mates")).collect()
    assert {r.path: (r.n, r.mates) for r in rows} == {"f2.ts": (6, 0), "f3.ts": (3, 0), "f4.ts": (2, 0), "f6.ts": (6000, 6000), "f7.ts": (4, 0), "f8.ts": (1, 0)}
    assert syntax.tree_rules(_files(spark, *texts)).collect() == []


DEAD = [
    ("function f() {\n  return a\n\n  // c\n\n  b()\n}", [("dead-flow/dead-after-return", 6)]),
    ("function f() {\n  return (\n    a\n  )\n}", []),
    ("function f() {\n  return a\n    .b()\n    .c()\n}", []),
    ("function f() {\n  return a ||\n    b\n}", []),
    ("function f() {\n  if (x) return\n  b()\n}", []),
    ("function f() {\n  if (x) {\n    return\n  } else {\n    throw e\n  }\n  b()\n}", []),
    ("const f = () => {\n  list.map((x) => {\n    return x\n  })\n  return 1\n}\ng()", []),
    ("while (x) {\n  break; y()\n}", [("dead-flow/dead-after-break", 2)]),
    ("switch (x) {\n  case 1: return a\n  case 2: { break }\n  default: throw b\n}", []),
    ("switch (x) {\n  case 1:\n    break\n    lost()\n}", [("dead-flow/dead-after-break", 4)]),
    ("function f() {\n  throw new E()\n  function g() {}\n}", []),
    ("try { a() } catch (e) {\n  throw e\n  b()\n}", []),
    ("const o = {\n  return: 1,\n  b: 2\n}", []),
    ("class A {\n  return() { return 1 }\n  b() { }\n}", []),
    ("function f() { return { a: 1 }; b() }", [("dead-flow/dead-after-return", 1)]),
    ("function f() {\n  return\n  a()\n}", [("dead-flow/dead-after-return", 3)]),
    ("do {\n  continue\n} while (x)\ny()", []),
]


def test_unreachable(spark):
    rows = syntax.unreachable(syntax.tokens(_files(spark, *[t for t, _ in DEAD]))).collect()
    got = {}
    for r in rows:
        got.setdefault(int(r.path[1:-3]), []).append((r.rule, r.line))
    assert [sorted(got.get(i, [])) for i in range(len(DEAD))] == [want for _, want in DEAD]


SLOP = [
    ("try { a() } catch {}", ["ast-slop/swallowed-exception"]),
    ("try { a() } catch (e) { /* why */ }", ["ast-slop/swallowed-exception"]),
    ("try { a() } catch (e) { b(e) }", []),
    ("p.catch(() => {})", []),
    ("try { a() } catch (e) { console.log(e); const x = y as any }", []),
    ("const x = y.as.any; const s = 'z as any'", []),
    ("const x = y as any // ok", ["ast-slop/as-any"]),
    ("function f() { supabaseClient(); return () => x as any }", ["ast-slop/as-any"]),
    ("function f() { return supabaseClient(x as any) }", []),
    ("function f() { const g = (y) => y as any\n  return supabaseClient() }", ["ast-slop/as-any"]),
    ("log.console.log(1); window?.console; consoles.log(2)", []),
    ("if (x) { console\n  .debug(1) }", ["ast-slop/console-leftover"]),
    ("const x = y as unknown as string; const z = y as unknown as Thing", ["ast-slop/double-assertion"]),
]


def test_tree_slop(spark):
    rows = syntax.tree_slop(syntax.tokens(_files(spark, *[t for t, _ in SLOP]))).collect()
    got = {}
    for r in rows:
        got.setdefault(int(r.path[1:-3]), []).append(r.rule)
    assert [sorted(got.get(i, [])) for i in range(len(SLOP))] == [want for _, want in SLOP]


@pytest.mark.parametrize("name", ["tests/a.ts", "src/a.test.ts", "src/a.spec.js"])
def test_console_in_tests(spark, name):
    files = as_files(spark.createDataFrame([("x/" + name, "console.log(1)")], "p string, c string"), F.col("p"), F.col("c"))
    assert syntax.tree_slop(syntax.tokens(files)).collect() == []


def test_columns_of_equal_matches_and_fine_names(spark):
    from corpusmill.operators import line_rules

    lines = ["f(a as unknown as T, b as unknown as T)", "\u200bx\u200b y", "const foo = f(x => 1)", "const foo = (a, x=>y)", "const foo = handler(", "const foo = handler[0]", "const { foo } = api.get(1); let bar = 1", "let bar = { q: 1 }", "const foo = id"]
    ls = views.lines(_files(spark, "\n".join(lines)))
    got = sorted((r.rule, r.line, r.col) for r in line_rules.detect(ls).collect() if r.rule in ("types/double-assertion", "syntax-deep/unicode-anomaly", "ast-slop/generic-name"))
    want = [("types/double-assertion", 1, 5), ("types/double-assertion", 1, 24), ("syntax-deep/unicode-anomaly", 2, 1), ("syntax-deep/unicode-anomaly", 2, 3)]
    assert got == sorted(want + [("ast-slop/generic-name", n, lines[n - 1].index("let bar" if "let bar" in lines[n - 1] else "const foo") + 1) for n in (3, 5, 6, 8, 9)])


def test_split_balanced(spark):
    from corpusmill.operators.headers import split_balanced

    cases = {"f(a, b)": ["a", " b"], "f()": [], "f( )": [], "f(a=(1, 2), b=[x, {y: (z,)}], c='),')": ["a=(1, 2)", " b=[x, {y: (z,)}]", " c='),'"], "f(a,": ["a"], "no": [], "f(a) -> (b, c)": ["a"], 'f("\\"(", x,)': ['"\\"("', " x"], "f(" + "a, " * 3000 + "b)": ["a", *[" a"] * 2999, " b"]}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("t", split_balanced(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


def test_python_parameters(spark):
    from corpusmill.operators.headers import python_parameters

    text = "x = (\n  1,\ndef f(a: 'x=(', b=1 == 2,\n      c: D[int] = {  # no\n      }) :\n  g(h,\n    i)\ndef g(\nasync def h(self, *, k: int): ..."
    rows = python_parameters(views.lines(_files(spark, text, ext="py"))).orderBy("num", "place").collect()
    assert [(r.num, r.name, r.value.replace(" ", ""), r.hinted) for r in rows] == [(3, "a", "", True), (3, "b", "1==2", False), (3, "c", "{}", True), (9, "k", "", True)]
