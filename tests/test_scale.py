"""Plans that hold at any size: what is made of files is not sent through the driver, not left to one task, and compiled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill import synthetic
from corpusmill.operators import context_rules, line_rules, relations, syntax, views
from corpusmill.plans import fixes, scan
from corpusmill.plans import findings as P
from corpusmill.queries import QUERIES
from corpusmill.sources import diffs, files


@pytest.fixture(scope="module")
def keys(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("part")
    spark.range(3 * files.ROWS).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{at}/part.parquet")
    return str(at)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


MADE = {
    "unused_variable": lambda f, ls: context_rules.unused_variable(ls),
    "unused_imports": lambda f, ls: relations.unused_imports(views.imports(ls), ls),
    "type_only_imports": lambda f, ls: relations.type_only_imports(views.imports(ls), ls),
    "lexical_states": lambda f, ls: syntax.states(ls),
    "findings_in_code": lambda f, ls: syntax.in_code(line_rules.detect(ls, line_rules.RULES[:3]), ls),
    "tree_slop": lambda f, ls: syntax.tree_slop(syntax.tokens(f)),
    "tree_unreachable": lambda f, ls: syntax.unreachable(syntax.tokens(f)),
    "unguarded_merges": lambda f, ls: syntax.deep_merges(syntax.tokens(f), syntax.blocks(syntax.tokens(f)), f, ls),
    "suppressed": lambda f, ls: P.suppress(line_rules.detect(ls, line_rules.RULES[:3]), ls),
    "fix_apply": lambda f, ls: fixes.apply(f, ls, fixes.plan(fixes.propose(line_rules.detect(ls, line_rules.RULES[:3]), ls))),
    "changed_findings": lambda f, ls: diffs.in_ranges(line_rules.detect(ls, line_rules.RULES[:3]), diffs.ranges(f.select(F.col("content").alias("diff")))),
}


@pytest.mark.parametrize("name", MADE)
def test_tables_of_a_corpus_are_not_broadcast(spark, keys, name):
    f = synthetic.files(spark, keys)
    assert "Broadcast" not in plan(MADE[name](f, views.lines(f)))


def test_blocks_take_no_join(spark, keys):
    assert "Join" not in plan(syntax.blocks(syntax.tokens(synthetic.files(spark, keys, synthetic.MODULES))))


def test_files_of_a_narrow_table_are_many_tasks(spark, keys):
    f = synthetic.files(spark, keys)
    assert f.rdd.getNumPartitions() == 3
    assert f.select("path").distinct().count() == 3 * files.ROWS
    small = spark.range(files.ROWS).withColumnRenamed("id", "k").coalesce(1)
    assert files.spread(small, "k").rdd.getNumPartitions() == 1


def test_line_rules_are_compiled(spark, keys):
    """The tests of a line are a column, not the argument of a generator, which would be interpreted."""
    text = plan(line_rules.detect(views.lines(synthetic.files(spark, keys))))
    assert re.search(r"explode\(hits#\d+\)", text) and "size(flatten" not in text


def test_lines_without_the_strings_of_a_rule_do_not_match(spark):
    """Each string that a rule asks for beforehand stands in all that its pattern matches: with and without it, rules find alike."""
    rows = [(f"{folder}/f{i}.{ext}", text) for i, (folder, ext, text) in enumerate([*synthetic.SNIPPETS, *synthetic.MODULES, *synthetic.ODD])]
    extra = "let foo = 1\nif (a) { }\nfetch(url)\nhttps.request(url)\na!.b\nel.outerHTML = x\nconst f = (a) => {\nlet x = b! \nprocess.env.DEBUG\n/* We need to */\nexport const getStaticProps = 1\n \tx\n// AI assisted\n"
    rows += [(f"x/e.{e}", extra + "except:\nexcept Exception:\nprint (1)\n\"\"\" We need to\n# XXX\n* todo\nv, _ = f()\n\tt: 1\n*{\n[a]( # )\n~~~\n<IMG>\n<HTML>\n<tt>\nonload =\n") for e in ("ts", "js", "py", "go", "rs", "html", "css", "md", "yaml")]
    ls = views.lines(files.as_files(spark.createDataFrame(rows, "p string, c string"), F.col("p"), F.col("c")))
    from dataclasses import replace

    bare = [replace(r, has=()) for r in line_rules.RULES]
    assert sorted(line_rules.detect(ls).collect()) == sorted(line_rules.detect(ls, bare).collect())


def test_quick_tests_of_rules_spare_no_finding(spark):
    """also, low, ends, least and gate stand before a pattern that finds the same without them."""
    from dataclasses import replace

    text = "db.Query('select * from t where id=' + id)\ndb.all(`Drop ${x}`)\nconst API_KEY = \"abcdefghijk\"\nconst Apikey = 'abcdefghijk'\nPassWord: 'abcdefghijk'\n// fixMe\n# Hack\n* xxx\n"
    text += "let x: Promise < any > = 1 as Map<string, any>\nimport x from './locales/en.json'\nend \nend\t\nend \u00a0\na\u200bb\ufeff\u007f\u0001\né ß 漢\n" + "é" * 121 + "\n" + "y" * 120 + "\n" + "z" * 121 + "\n \n\t\n\n"
    ls = views.lines(files.as_files(spark.createDataFrame([(f"x/e.{e}", text) for e in ("ts", "js", "py", "go", "rs", "html", "css", "md", "yaml")], "p string, c string"), F.col("p"), F.col("c")))
    bare = [replace(r, also=(), low=(), ends=(), least=0, gate="") for r in line_rules.RULES]
    found = sorted(line_rules.detect(ls).collect())
    assert found == sorted(line_rules.detect(ls, bare).collect())
    assert {r.rule for r in found} >= {r.id for r in line_rules.RULES if r.also or r.low or r.ends or r.least or r.gate}


def test_a_language_is_asked_once_for_all_its_rules(spark, keys):
    """A line meets one test for the rules of the same languages, not one a rule."""
    same = [r for r in line_rules.RULES if r.langs == line_rules.JS][:8]
    hits = [x for x in plan(line_rules.detect(views.lines(synthetic.files(spark, keys)), same)).split("\n") if "AS hits#" in x]
    assert len(re.findall(r"lang#\d+ IN", hits[0])) == 1


def test_compared_scans_read_each_scan_once(spark, keys):
    rows = line_rules.detect(views.lines(synthetic.files(spark, keys)), line_rules.RULES[:3])
    text = plan(P.compared(rows, P.override(rows, [("ast-slop/todo-stub", "error")])))
    assert len(re.findall(r"Generate explode\(hits#", text)) + len(re.findall(r"Generate explode_outer\(hits#", text)) <= 4


def test_fix_steps_read_the_lines_once(spark, keys):
    """Findings bring the text of their line, and only rules that can be fixed are tested; the steps are those of a join with all findings."""
    text = plan(QUERIES["fix_plan"](spark, keys))
    assert "Join" not in text and len(re.findall(r"Generate explode\(hits#", text)) == 1 and len(re.findall(r"Exchange hashpartitioning\(path#", text)) == 1
    assert "ast-slop/decorative-comment" in text and "security-deep/" not in text
    ls = views.lines(synthetic.files(spark, keys))
    joined = fixes.plan(fixes.propose(line_rules.detect(ls), ls))
    carried = fixes.plan(fixes.propose(line_rules.detect(ls, with_text=True)))
    steps = QUERIES["fix_plan"](spark, keys)
    assert steps.columns == joined.columns == carried.columns and steps.count() > 1000
    for other in (joined, carried):
        assert steps.exceptAll(other).isEmpty() and other.exceptAll(steps).isEmpty()


@pytest.mark.parametrize(("by", "mode"), [(("engine",), "logarithmic"), ((), "linear")])
def test_a_score_makes_its_findings_once(spark, keys, by, mode):
    """Ranking and counting read the same exchange, whichever columns each needs."""
    rows = line_rules.detect(views.lines(synthetic.files(spark, keys)), line_rules.RULES[:3]).withColumn("engine", P.engine())
    out = P.score(rows, 100, by=by, mode=mode)
    out.collect()
    final = plan(out).split("Initial Plan")[0]
    assert "ReusedExchange" in final and len(re.findall(r"Generate explode(?:_outer)?\(hits#", final)) == 1


def test_kept_lines_are_dealt_by_their_text(spark, keys, monkeypatch):
    """A scan keeps its lines in as many parts as their text needs, not in the session's number of shuffle partitions."""
    f = synthetic.files(spark, keys)
    n_chars = f.agg(F.sum(F.length("content"))).first()[0]
    for parts in (1, 7):
        monkeypatch.setattr(scan, "CHARS", -(-n_chars // parts))
        context = scan.Context(f, scan.read_config(None))
        assert context.lines.rdd.getNumPartitions() == parts
        assert context.lines.count() == views.lines(f).count()
        context.release()
    empty = scan.Context(f.filter("path IS NULL"), scan.read_config(None))
    assert empty.lines.count() == 0
    empty.release()


def test_frequent_tokens_make_no_candidates(spark):
    """Sets that share most of their tokens one by one, but are not similar, do not meet; all similar ones do."""
    rng = random.Random(5)
    sets = [(i, rng.sample(range(90), rng.randint(1, 60))) for i in range(600)]
    sets += [(1000 + i, sorted(set(s) - set(rng.sample(s, len(s) // 20)) | set(rng.sample(range(90), len(s) // 25)))) for i, s in sets]
    like = {(a, b) for a, x in sets for b, y in sets if a < b and 10 * len(set(x) & set(y)) >= 9 * len(set(x) | set(y))}
    rows = spark.createDataFrame([*sets, (5000, []), (5001, []), (5002, None)], "id int, tokens array<int>")
    near = {(r.a, r.b) for r in relations.set_candidates(rows).collect()}
    assert like <= near and len(like) > 300 and len(near) < len(sets) ** 2 // 2 // 50
    assert {(r.a, r.b) for r in relations.similar_sets(rows).collect()} == like


def test_tasks_of_large_tables_take_more_rows(spark, monkeypatch):
    monkeypatch.setattr(files, "ROWS", 10)
    monkeypatch.setattr(files, "TASKS", 4, raising=False)
    for n, tasks in ((10, 1), (40, 4), (100, 4), (400, 10)):
        rows = files.spread(spark.range(n).coalesce(1), "id")
        assert rows.rdd.getNumPartitions() == tasks and rows.count() == n


def _lexed(text):
    return len(re.findall(r"MapInArrow run\(path", text))


@pytest.mark.parametrize(("name", "rules"), [("tree_slop", ("slop",)), ("tree_unreachable", ("dead",)), ("unguarded_merges", ("merges",))])
def test_tree_rules_lex_a_file_once(spark, keys, name, rules):
    """No join, no tokens moved; the findings are those in a table of tokens, also of files that are not lexed."""
    text = plan(QUERIES[name](spark, keys))
    assert "Join" not in text and "hashpartitioning(path" not in text and _lexed(text) == 1
    snippets = [*synthetic.SNIPPETS, *synthetic.MODULES, *synthetic.ODD]
    f = files.as_files(spark.createDataFrame([(f"{folder}/f{i}.{ext}", t) for i, (folder, ext, t) in enumerate(snippets)], "p string, c string"), F.col("p"), F.col("c"))
    found = sorted(syntax.tree_rules(f, rules).collect())
    assert found == sorted(MADE[name](f, views.lines(f)).collect()) and found


def test_a_scan_lexes_a_file_once(spark, keys):
    text = plan(syntax.tree_rules(synthetic.files(spark, keys, synthetic.MODULES)))
    assert "Join" not in text and _lexed(text) == 1


def test_windows_of_files_of_any_length(spark, monkeypatch):
    """Windows are cut in stretches, none is left out, and none is made without most_lines alone."""
    monkeypatch.setattr(relations, "WINDOWS", 3, raising=False)
    texts = {f"f{n}.ts": "\n".join(f"line {n} of {i}" for i in range(n)) for n in (13, 14, 18, 19, 28, 29, 33, 34, 100, 2501)}
    f = files.as_files(spark.createDataFrame(list(texts.items()), "p string, c string"), F.col("p"), F.col("c"))
    want = {(p, s + 1, s + 14, "\n".join(ls[s : s + 14])) for p, t in texts.items() for ls in [t.split("\n")] for s in range(0, len(ls) - 13, 5)}
    got = relations.blocks(f, most_lines=None).select("path", "start", "stop", "text").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r) for r in relations.blocks(f).select("path", "start", "stop", "text").collect()} == {w for w in want if w[0] != "f2501.ts"}


def test_similar_blocks_of_long_files_and_of_one_first_file(spark, tmp_path):
    """Files of more than 2,000 lines take part, and so do texts whose first places are in one file, but others are not."""
    block = lambda odd, name="v": "\n".join([f"{name}{i} = call{i}(x{i}, y{i})" for i in range(13)] + [odd])
    fill = lambda n, name: "\n".join(f"{name}_{i} {name}__{i} = {name}___{i}" for i in range(n))
    rows = [(1, fill(2500, "p") + "\n" + block("one")), (2, block("two"))]
    # 3 has both texts, of which another file has the second, then the first one; 6 alone has both of its texts.
    near = (block("u", "w"), block("t", "w"))
    rows += [(3, near[0] + "\n" + fill(1, "q") + "\n" + near[1]), (4, near[1])]
    rows += [(6, block("u", "z") + "\n" + fill(1, "s") + "\n" + block("t", "z"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {frozenset({(r.path_a, r.start_a), (r.path_b, r.start_b)}) for r in QUERIES["similar_blocks"](spark, str(tmp_path)).collect()}
    assert {frozenset({("docs/1.ts", 2501), ("docs/2.ts", 1)}), frozenset({("docs/3.ts", 1), ("docs/4.ts", 1)})} <= got
    assert all(len({p for p, _ in pair}) == 2 for pair in got) and not any(p == "docs/6.ts" for pair in got for p, _ in pair)


def test_cycles_make_their_edges_once(spark, keys):
    """Edges and steps are written: the plan that is left reads them, and does not make lines, edges and steps anew for each step."""
    f = synthetic.files(spark, keys)
    ls = views.lines(f)
    for found in (relations.circular_dependency(views.imports(ls), f), relations.package_cycles(ls)):
        text = plan(found)
        assert len(re.findall(r"\w+Join\b", text)) <= 2 and len(re.findall(r"Generate posexplode", text)) <= 1
