"""The registered queries of the library itself and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import synthetic
from corpusmill.functions.text import redact
from corpusmill.operators import context_rules, folds, headers, line_rules, relations, syntax, views
from corpusmill.plans import findings as P
from corpusmill.plans import fixes, reports
from corpusmill.sources.files import as_files, language_counts, manifest_dependencies, spread
from corpusmill.streaming.changes import quiet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the table part, dealt to many tasks, since each stands for some files."""
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown-free source files, so that code rules read them."""
    rows = table(spark, sf_dir, "documents")
    return as_files(rows, F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".ts")), F.col("text"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return as_files(rows, F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))


DOCS = """files AS (SELECT 'docs/' || doc_id || '.ts' AS path, 'typescript' AS lang, coalesce(text, '') AS content FROM documents),
lines AS (SELECT path, lang, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS num FROM files)"""
PAGES = DOCS.replace("'docs/' || doc_id || '.ts'", "'pages/' || page_id || '.html'").replace("'typescript'", "'html'").replace("coalesce(text, '')", "coalesce(html, '')").replace("FROM documents", "FROM pages")
SYN = synthetic.sql()
OUT = "path, '{rule}' AS rule, '{sev}' AS severity, {line}::INT AS line, 1 AS col, {msg}::VARCHAR AS message"


def out(rule: str, sev: str, line: str = "num", msg: str = "''") -> str:
    return OUT.format(rule=rule, sev=sev, line=line, msg=msg)


def syn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = synthetic.files(spark, sf_dir)
    return f, views.lines(f)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["max_line_length"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- sources and views


@query(f"WITH {DOCS} SELECT path, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, max(length(text))::INT AS longest FROM lines GROUP BY path")
def line_stats(spark, sf_dir):
    return views.lines(doc_files(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("text").cast("long")).alias("n_chars"), F.max(F.length("text")).alias("longest"))


@query(f"WITH {SYN} SELECT lang, count(*) AS n_files FROM files WHERE lang IS NOT NULL GROUP BY lang")
def languages(spark, sf_dir):
    return language_counts(synthetic.files(spark, sf_dir))


@query(f"WITH {SYN} SELECT path, num::INT AS num, regexp_extract(text, '{views.EXPORT}', 1) AS name FROM lines WHERE lang IN ('typescript', 'javascript') AND regexp_extract(text, '{views.EXPORT}', 1) <> ''")
def exports(spark, sf_dir):
    return views.exports(syn(spark, sf_dir)[1])


@query(f"WITH {SYN}, w AS (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM lines) SELECT word, count(*) AS n, count(DISTINCT path) AS n_files FROM w GROUP BY word")
def word_counts(spark, sf_dir):
    return views.words(syn(spark, sf_dir)[1]).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


def _imports_sql() -> str:
    q = lambda s: s.replace("'", "''")
    js = f"coalesce(nullif(regexp_extract(text, '{q(views.IMPORT_TS)}', 1), ''), nullif(regexp_extract(text, '{q(views.IMPORT_CALL)}', 1), ''))"
    py = f"coalesce(nullif(regexp_extract(text, '{q(views.IMPORT_PY)}', 1), ''), nullif(regexp_extract(text, '{q(views.IMPORT_PY)}', 2), ''))"
    return rf"""imp AS (SELECT path, lang, num, text, CASE WHEN lang IN ('typescript', 'javascript') THEN {js} WHEN lang = 'python' THEN {py} END AS source FROM lines),
imports AS (SELECT path, lang, num, source, regexp_matches(text, '^\s*import\s+type\s') AS type_only,
  list_filter(list_concat([coalesce(nullif(regexp_extract(text, '^\s*import\s+(?:type\s+)?(?:\*\s+as\s+)?(\w+)\s*(?:,\s*\{{[^}}]*\}}\s*)?from\b', 1), ''), '')],
    CASE WHEN regexp_matches(text, '^\s*import\b') THEN list_transform(string_split(regexp_extract(text, '\{{([^}}]*)\}}', 1), ','), lambda s: trim(regexp_replace(s, '^.*\s+as\s+', ''), ' ')) ELSE [] END), lambda s: s <> '') AS symbols
  FROM imp WHERE source IS NOT NULL)"""


IMPORTS = f"{SYN}, {_imports_sql()}"


@query(f"WITH {IMPORTS} SELECT path, num::INT AS num, source, array_to_string(symbols, ',') AS symbols, type_only FROM imports")
def imports(spark, sf_dir):
    return views.imports(syn(spark, sf_dir)[1]).select("path", "num", "source", F.array_join("symbols", ",").alias("symbols"), "type_only")


@query(f"WITH {SYN} SELECT path, strpos(content, chr(13) || chr(10)) > 0 AS has_crlf, 'lf' AS line_ending, strpos(content, chr(65279)) > 0 AS has_zwnbsp FROM files")
def encoding(spark, sf_dir):
    return views.encoding(synthetic.files(spark, sf_dir))


# ---- line rules


@query(f"WITH {DOCS} " + line_rules.sql([r for r in line_rules.RULES if r.id == "format-lint/max-line-length"]))
def max_line_length(spark, sf_dir):
    return line_rules.detect(views.lines(doc_files(spark, sf_dir)), [r for r in line_rules.RULES if r.id == "format-lint/max-line-length"])


@query(f"WITH {PAGES} " + line_rules.sql([r for r in line_rules.RULES if "html" in r.langs]))
def html_rules(spark, sf_dir):
    return line_rules.detect(views.lines(page_files(spark, sf_dir)), [r for r in line_rules.RULES if "html" in r.langs])


def _line_query(prefix: str) -> None:
    own = [r for r in line_rules.RULES if r.id.startswith(prefix + "/")]
    query(f"WITH {SYN} {line_rules.sql(own)}", f"rules_{prefix.replace('-', '_')}")(lambda spark, sf_dir: line_rules.detect(syn(spark, sf_dir)[1], own))


for _prefix in dict.fromkeys(r.id.split("/")[0] for r in line_rules.RULES):
    _line_query(_prefix)


# ---- context rules

_TRIM = r"regexp_replace(text, '^[\t-\r ]+|[\t-\r ]+\z', '', 'g')"
_W = "(PARTITION BY path ORDER BY num)"


@query(f"WITH {SYN}, b AS (SELECT path, num, num - row_number() OVER {_W} AS island FROM lines WHERE {_TRIM} = '') SELECT {out('format-lint/blank-line-cluster', 'suggestion', 'min(num)', 'count(*)')} FROM b GROUP BY path, island HAVING count(*) >= 3")
def blank_line_cluster(spark, sf_dir):
    return context_rules.blank_line_cluster(syn(spark, sf_dir)[1])


@query(f"WITH {DOCS} SELECT {out('syntax-deep/missing-final-newline', 'info', 'len(string_split(content, chr(10)))')} FROM files WHERE length(content) > 0 AND NOT ends_with(content, chr(10))")
def missing_final_newline(spark, sf_dir):
    return context_rules.missing_final_newline(doc_files(spark, sf_dir))


def _vote_sql(rule: str, sev: str, one: str, other: str, source: str = "lines") -> str:
    q = lambda s: s.replace("'", "''")
    return f"""SELECT {out(rule, sev)} FROM (
  SELECT path, num, side, minor, row_number() OVER (PARTITION BY path, side ORDER BY num) AS r FROM (
    SELECT path, num, side, CASE WHEN count(*) FILTER (side = 1) OVER (PARTITION BY path) <= count(*) FILTER (side = 2) OVER (PARTITION BY path) THEN 1 ELSE 2 END AS minor,
           count(*) FILTER (side = 1) OVER (PARTITION BY path) AS n1, count(*) FILTER (side = 2) OVER (PARTITION BY path) AS n2
    FROM (SELECT path, num, CASE WHEN regexp_matches(text, '{q(one)}') THEN 1 WHEN regexp_matches(text, '{q(other)}') THEN 2 END AS side FROM {source}) WHERE side IS NOT NULL)
  WHERE n1 > 0 AND n2 > 0) WHERE side = minor AND r <= 5"""


_JS = "lang IN ('typescript', 'javascript')"


@query(f"""WITH {SYN}, js AS (SELECT * FROM lines WHERE {_JS}),
last AS (SELECT * FROM (SELECT *, lead(text) OVER {_W} AS nxt FROM js) WHERE regexp_matches(nxt, '^\\s*[}}\\]]'))
{_vote_sql('format-lint/inconsistent-indent', 'warning', context_rules.INDENT_SPACE, context_rules.INDENT_TAB)}
UNION ALL {_vote_sql('format-lint/inconsistent-quotes', 'info', context_rules.QUOTE_ONE, context_rules.QUOTE_TWO, 'js')}
UNION ALL {_vote_sql('format-lint/inconsistent-semicolons', 'info', context_rules.SEMI, context_rules.NO_SEMI, 'js')}
UNION ALL {_vote_sql('format-lint/trailing-comma-inconsistency', 'info', context_rules.COMMA, context_rules.NO_COMMA, 'last')}""")
def style_votes(spark, sf_dir):
    return context_rules.styles(syn(spark, sf_dir)[1])


_DEPTH = f"""steps AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*(?://|\\*|/\\*)') THEN 0 ELSE len(regexp_extract_all(text, '{{open}}')) - len(regexp_extract_all(text, '{{close}}')) END AS step FROM lines WHERE lang IN ({{langs}})),
sums AS (SELECT *, sum(step) OVER (PARTITION BY path ORDER BY num) AS s FROM steps),
deep AS (SELECT path, num, text, (s - least(0, min(s) OVER (PARTITION BY path ORDER BY num)))::INT AS depth FROM sums)"""


def _depth(langs: str, open_: str = r"\{", close: str = r"\}") -> str:
    return _DEPTH.format(langs=langs, open=open_, close=close)


@query(f"WITH {SYN}, {_depth(chr(39) + 'typescript' + chr(39) + ', ' + chr(39) + 'javascript' + chr(39))} SELECT path, num::INT AS num, depth FROM deep")
def nesting(spark, sf_dir):
    return context_rules.nesting(syn(spark, sf_dir)[1].filter(F.col("lang").isin("typescript", "javascript"))).select("path", "num", "depth")


def _deep_sql(rule: str, most: int, langs: str, *brackets: str) -> str:
    return f"WITH {SYN}, {_depth(langs, *brackets)}, worst AS (SELECT path, max(depth) AS d FROM deep GROUP BY path HAVING max(depth) > {most}) SELECT {out(rule, 'warning', 'min(num)', 'd')} FROM deep JOIN worst USING (path) WHERE depth = d GROUP BY path, d"


@query(_deep_sql("arch-constraints/deep-nesting", 4, "'typescript', 'javascript', 'go', 'rust'"))
def deep_nesting(spark, sf_dir):
    return context_rules.deep_nesting(syn(spark, sf_dir)[1])


@query(_deep_sql("json/deep-nesting", 5, "'json'", r"[{\[]", r"[}\]]"))
def json_depth(spark, sf_dir):
    return context_rules.deep_nesting(syn(spark, sf_dir)[1], 5, "json/deep-nesting", ("json",), r"[{\[]", r"[}\]]")


@query(rf"""WITH {SYN}, n AS (SELECT *, [x for x in [lead(text, 1) OVER w, lead(text, 2) OVER w, lead(text, 3) OVER w, lead(text, 4) OVER w] if x IS NOT NULL AND NOT regexp_matches(x, '^\s*(?://|\z)')][1] AS js,
  [x for x in [lead(text, 1) OVER w, lead(text, 2) OVER w] if x IS NOT NULL AND NOT regexp_matches(x, '^\s*(?:#|\z)')][1] AS py FROM lines WINDOW w AS {_W})
SELECT {out('ast-slop/swallowed-exception', 'info')} FROM n
WHERE (lang <> 'python' AND (regexp_matches(text, 'catch\s*(?:\(\s*\w+\s*\))?\s*\{{\s*\}}\s*\z') OR (regexp_matches(text, 'catch\s*(?:\(\s*\w+\s*\))?\s*\{{\s*\z') AND trim(js) = '}}')))
   OR (lang = 'python' AND regexp_matches(text, '^\s*except\s*(?:\w+(?:\s+as\s+\w+)?)?\s*:') AND trim(py) IN ('pass', '...'))""")
def swallowed_exception(spark, sf_dir):
    return context_rules.swallowed(syn(spark, sf_dir)[1])


@query(rf"""WITH {SYN}, n AS (SELECT *, coalesce(lead(text) OVER {_W}, '') AS nxt, regexp_extract(text, '^\s*(?:def|class)\s+([A-Za-z_]\w*).*:\s*(?:#.*)?\z', 1) AS name FROM lines WHERE lang = 'python')
SELECT {out('python-deep/pass-stub', 'warning', msg='name')} FROM n WHERE name <> '' AND regexp_matches(nxt, '^\s*(?:pass|\.\.\.)\s*(?:#.*)?\z')
UNION ALL SELECT {out('python-deep/missing-docstring', 'suggestion', msg='name')} FROM n WHERE name <> '' AND NOT starts_with(name, '_') AND NOT regexp_matches(nxt, '^\s*(?:r|u|b|br|rb)?(?:"|'')')""")
def first_body_line(spark, sf_dir):
    return context_rules.first_body_line(syn(spark, sf_dir)[1])


@query(rf"""WITH {SYN}, n AS (SELECT *, coalesce(lag(text) OVER {_W}, '') AS prv, regexp_extract(text, '^(?:func|type|var|const)\s+(?:\([^)]*\)\s*)?([A-Z]\w*)', 1) AS name FROM lines)
SELECT {out('go-deep/exported-no-doc', 'warning', msg='name')} FROM n WHERE lang = 'go' AND name <> '' AND NOT starts_with(prv, '// ' || name)
UNION ALL SELECT {out('rust-deep/unsafe-usage', 'error')} FROM n WHERE lang = 'rust' AND regexp_matches(text, '\bunsafe\s*\{{') AND NOT regexp_matches(prv, '(?i)(?://|/\*)\s*SAFETY[:\s]')""")
def undocumented(spark, sf_dir):
    return context_rules.undocumented(syn(spark, sf_dir)[1])


@query(rf"""WITH {SYN}, v AS (SELECT path, num, regexp_extract(text, '^\s*(?:const|let|var)\s+(\w+)', 1) AS name, text FROM lines WHERE {_JS}),
seen AS (SELECT path, word AS name FROM (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM lines WHERE {_JS}) GROUP BY path, word HAVING count(*) <= 1)
SELECT {out('dead-flow/unused-variable', 'suggestion', msg='name')} FROM v SEMI JOIN seen USING (path, name) WHERE name <> '' AND NOT starts_with(name, '_') AND NOT (regexp_matches(name, '^[A-Z]') AND regexp_matches(text, '=>|function'))""")
def unused_variable(spark, sf_dir):
    return context_rules.unused_variable(syn(spark, sf_dir)[1])


@query(rf"""WITH {SYN}, css AS (SELECT *, sum(CASE WHEN contains(text, '{{') THEN 1 ELSE 0 END) OVER {_W} AS block, regexp_extract(text, '^\s*([a-z-]+)\s*:', 1) AS prop FROM lines WHERE lang = 'css'),
again AS (SELECT *, row_number() OVER (PARTITION BY path, block, prop ORDER BY num) AS r FROM css WHERE prop <> '')
SELECT {out('css/duplicate-property', 'warning', msg='prop')} FROM again WHERE r > 1
UNION ALL SELECT {out('css/important-overuse', 'warning', 'min(num)', 'count(*)')} FROM css WHERE regexp_matches(text, '(?i)!important\b') GROUP BY path HAVING count(*) > 3""")
def css_blocks(spark, sf_dir):
    return context_rules.css_blocks(syn(spark, sf_dir)[1])


@query(rf"""WITH {SYN}, md AS (SELECT *, coalesce(lead(text) OVER {_W}, '') AS nxt, regexp_matches(text, '^\s*#{{1,6}}\s') AS atx FROM lines WHERE lang = 'markdown')
SELECT {out('md/inconsistent-heading', 'info')} FROM md WHERE NOT atx AND regexp_matches(text, '\S') AND regexp_matches(nxt, '^\s*(?:=+|-+)\s*\z') AND path IN (SELECT path FROM md WHERE atx)""")
def headings(spark, sf_dir):
    return context_rules.headings(syn(spark, sf_dir)[1])


@query(rf"""WITH {SYN}, js AS (SELECT * FROM lines WHERE lang = 'json'), f AS (SELECT *, lead(text) OVER {_W} AS nxt FROM js WHERE regexp_matches(text, '\S')),
c AS (SELECT *, regexp_matches(text, '^\s*"[^"]+"\s*:\s*[^,]+,\s*"[^"]+"\s*:') AS compact, regexp_matches(text, '^\s*"[^"]+"\s*:\s*[^,]+\s*,?\s*\z') AS single FROM js),
m AS (SELECT path FROM c GROUP BY path HAVING count(*) FILTER (compact) >= 2 AND count(*) FILTER (single AND NOT compact) >= 2)
SELECT {out('json/trailing-comma', 'error')} FROM f WHERE regexp_matches(text, ',\s*\z') AND regexp_matches(nxt, '^\s*[}}\]]')
UNION ALL SELECT {out('json/inconsistent-spacing', 'info')} FROM c SEMI JOIN m USING (path) WHERE compact""")
def json_lines(spark, sf_dir):
    return context_rules.json_lines(syn(spark, sf_dir)[1])


@query(rf"""WITH {SYN}, y AS (SELECT * FROM lines WHERE lang = 'yaml'),
a AS (SELECT path, name, min(num) AS num FROM (SELECT path, num, regexp_extract(text, '&(\w+)', 1) AS name FROM y) WHERE name <> '' GROUP BY ALL),
u AS (SELECT path, name FROM (SELECT path, unnest(regexp_extract_all(text, '\*(\w+)', 1)) AS name FROM y) GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT path, num, num - lag(num) OVER {_W} AS gap FROM y WHERE regexp_matches(text, '^[A-Za-z_][\w-]*\s*:')),
p AS (SELECT path, min(num) AS num FROM t GROUP BY path HAVING count(*) >= 4 AND count(*) FILTER (gap > 2) >= 2)
SELECT {out('yaml/complex-anchor', 'info', msg='name')} FROM a JOIN u USING (path, name)
UNION ALL SELECT {out('yaml/multi-doc-unseparated', 'warning')} FROM p WHERE path NOT IN (SELECT path FROM y WHERE regexp_matches(text, '^---'))""")
def yaml_files(spark, sf_dir):
    return context_rules.yaml_files(syn(spark, sf_dir)[1])


def _by_snippet(rows: list[tuple], snippets: list[tuple[str, str, str]] = synthetic.SNIPPETS) -> str:
    """Findings written down by hand for each snippet (its place, rule, severity, line, column, message) as SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(snippets[i][0])}, {quote(snippets[i][1])}, {quote(rule)}, {quote(sev)}, {line}, {quote(str(col))}, {quote(msg)})" for i, rule, sev, line, col, msg in rows)
    col = "CASE WHEN col LIKE '%+key' THEN replace(col, '+key', '')::INT + length(p_partkey::VARCHAR) ELSE try_cast(col AS INT) END"
    return f"""SELECT folder || '/f' || p_partkey || '.' || ext AS path, rule, severity, line::INT AS line, ({col})::INT AS col, replace(message, '$K', p_partkey::VARCHAR) AS message
FROM part JOIN (VALUES {values}) AS t(i, folder, ext, rule, severity, line, col, message) ON p_partkey % {len(snippets)} = i"""


@query(_by_snippet([
    (0, "nextjs/image-missing-dimensions", "warning", 1, 1, '<Image src="a.png" />'), (0, "nextjs/metadata-in-client", "error", 1, 1, ""), (0, "tailwind/duplicate-utilities", "warning", 10, 1, ""), (0, "tailwind/incomplete-flex", "info", 10, 1, ""),
    (1, "types/as-any-json-parse", "warning", 16, 1, ""), (3, "dead-flow/unreachable-after-terminator", "warning", 16, 1, ""), (3, "syntax-deep/inconsistent-indent-style", "info", 15, 1, ""),
    (10, "syntax-deep/inconsistent-indent-style", "info", 14, 1, ""), (11, "md/todo-in-doc", "info", 3, 1, ""), (12, "syntax-deep/inconsistent-indent-style", "info", 5, 1, ""),
]))
def other_context_rules(spark, sf_dir):
    f, ls = syn(spark, sf_dir)
    out_ = context_rules.trivial_comment(ls)
    for d in (context_rules.line_endings, context_rules.indent_styles, context_rules.as_any_context, context_rules.class_lists, context_rules.first_marks, context_rules.unreachable):
        out_ = out_.unionByName(d(ls))
    for d in (context_rules.marks, context_rules.god_file, context_rules.next_client, context_rules.tags):
        out_ = out_.unionByName(d(f))
    return out_


@query(_by_snippet([
    (0, "perf-hints/react-missing-memo", "info", 7, 1, "Widget$K"), (1, "perf-hints/n-plus-one", "info", 9, 1, 'const row = await db.query("SELECT * FROM t WHERE id=" + id)'), (1, "perf-hints/string-concat-in-loop", "warning", 10, 1, "total"),
    (4, "ast-slop/py-bare-except", "warning", 9, 5, "except"), (4, "ast-slop/py-empty-class", "info", 15, 1, "Empty$K"), (4, "ast-slop/py-print", "warning", 6, 5, "print"), (4, "ast-slop/py-stub-function", "warning", 12, 1, "stub$K"),
    (4, "ast-slop/py-wildcard-import", "info", 2, 1, "sys"), (4, "python-deep/mutable-default", "error", 5, "14+key", "run$K"), (5, "go-deep/defer-in-loop", "error", 12, 1, "defer close(i)"), (6, "rust-deep/large-enum-variant", "warning", 13, 1, "Big$K"),
    (9, "json/duplicate-keys", "error", 3, 3, "a"), (10, "yaml/duplicate-keys", "error", 3, 3, "k"),
]))
def fold_rules(spark, sf_dir):
    return folds.all_folds(synthetic.files(spark, sf_dir))


@query(f"""WITH {SYN}, m AS (SELECT path, num, CASE WHEN instr(reverse(text), '*/') = 0 AND instr(reverse(text), '/*') = 0 THEN NULL WHEN instr(reverse(text), '/*') = 0 THEN true WHEN instr(reverse(text), '*/') = 0 THEN false ELSE instr(reverse(text), '*/') < instr(reverse(text), '/*') END AS mark FROM lines)
SELECT path, num::INT AS num, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_comment FROM m""")
def block_comment_state(spark, sf_dir):
    return folds.comment_lines(syn(spark, sf_dir)[1])


# ---- relations


_BLOCKS = r"""blocks AS (SELECT path, s + 1 AS start, array_to_string(list_filter(list_transform(ls[s + 1:s + 14], lambda x: regexp_replace(regexp_replace(x, '(?://|#).*\z', ''), '^[\t-\r ]+|[\t-\r ]+\z', '', 'g')), lambda x: x <> ''), chr(10)) AS text
  FROM (SELECT path, ls, unnest(range(0, len(ls) - 13, 5)) AS s FROM (SELECT path, string_split(content, chr(10)) AS ls FROM files) WHERE len(ls) BETWEEN 14 AND 2000))"""


@query(f"""WITH {DOCS}, {_BLOCKS}, k AS (SELECT path, start, md5(text) AS key FROM blocks WHERE length(text) >= 10)
SELECT key, count(DISTINCT path) AS n_files, count(*) AS n, arg_min(path, (path, start)) AS first_path, arg_min(start, (path, start))::INT AS first_line FROM k GROUP BY key HAVING count(DISTINCT path) >= 2""")
def identical_blocks(spark, sf_dir):
    return relations.identical_blocks(relations.blocks(doc_files(spark, sf_dir)))


@query()
def merged_block_regions(spark, sf_dir):
    return relations.merged_regions(relations.blocks(doc_files(spark, sf_dir)))


# tested by brute force: SQL would compare all pairs
@query()
def similar_files(spark, sf_dir):
    f = synthetic.files(spark, sf_dir)
    return relations.similar_groups(f.select(F.col("path").alias("id"), F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Za-z_]+)"), 1)).alias("tokens")))


@query(rf"""WITH {SYN}, s AS (SELECT path, num, unnest(list_concat(regexp_extract_all(text, '''([^''\n]*)''', 1), regexp_extract_all(text, '"([^"\n]*)"', 1))) AS value FROM lines),
u AS (SELECT * FROM s WHERE length(value) >= 8 AND NOT regexp_matches(value, '^(?:https?://|\.{{1,2}}/|@|use )') AND NOT regexp_matches(value, '^[a-z-]+/[a-z0-9/_-]+\z') AND regexp_matches(value, '[A-Za-z]'))
SELECT value, count(*) AS n, count(DISTINCT path) AS n_files, arg_min(path, (path, num)) AS path, arg_min(num, (path, num))::INT AS line, array_to_string(list_sort(list(DISTINCT path || ':' || num))[1:10], ',') AS places
FROM u GROUP BY value HAVING count(*) >= 3 AND count(DISTINCT path) >= 3""")
def repeated_constants(spark, sf_dir):
    return relations.repeated_constants(views.strings(syn(spark, sf_dir)[1]))


@query(f"WITH {DOCS} SELECT text, count(*) AS n, count(DISTINCT path) AS n_files FROM lines WHERE length(text) >= 8 GROUP BY text HAVING count(DISTINCT path) >= 3")
def repeated_lines(spark, sf_dir):
    return views.lines(doc_files(spark, sf_dir)).filter(F.length("text") >= 8).groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files")).filter("n_files >= 3")


_FUNCS = rf"""fs AS (SELECT path, num, regexp_extract(text, '^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)', 1) AS name, regexp_extract(text, '^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)', 2) AS params, regexp_replace(coalesce(lead(text) OVER {_W}, ''), '\s+', ' ', 'g') AS body FROM lines),
funcs AS (SELECT path, num, name, body, array_to_string(list_transform(string_split(params, ','), lambda p: trim(regexp_replace(p, '^[^:]*:?', ''), ' ')), ',') AS types FROM fs WHERE name <> '')"""


# bodies that functions of several names have, worked out by hand: snippet, lines, first line and name, functions a file
_COPIED = [
    (13, ("let sum = 0", "for (const item of items) {", "sum += item.price", "sum += item.tax", "audit(item.name)", "}", "return sum"), 2, "alpha", 2),
    (13, ("if (flag) {", "log(flag)", "return 1", "} else {", "return 2", "}", "done()"), 27, "pick", 1),
    (1, ("for (const id of req.ids) {", 'const row = await db.query("SELECT * FROM t WHERE id=" + id)', "total += `x${id}`", "}", 'eval("1")', "return load(total)", "res.end()"), 7, "handler", 1),
]


def _copied_sql() -> str:
    arms = []
    for at, body, line, name, n in _COPIED:
        folder, ext, _ = synthetic.SNIPPETS[at]
        text = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in body)
        path = f"'{folder}/f' || p_partkey || '.{ext}'"
        arms.append(f"SELECT md5({text}) AS key, {n} * count(*)::BIGINT AS n, {n} * count(*)::BIGINT AS n_names, min({path}) AS path, {line} AS line, '{name}' || arg_min(p_partkey, {path}) AS name FROM part WHERE p_partkey % {len(synthetic.SNIPPETS)} = {at} HAVING {n} * count(*) > 1")
    return " UNION ALL ".join(arms)


@query(_copied_sql())
def copied_functions(spark, sf_dir):
    return relations.copied_functions(folds.functions(synthetic.files(spark, sf_dir)))


@query(rf"""WITH {SYN}, n AS (SELECT path, num, text, unnest(regexp_extract_all(text, '\b(?:0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\b')) AS v FROM lines WHERE lang IN ('typescript', 'javascript', 'python', 'go', 'rust')),
d AS (SELECT *, ltrim(replace(regexp_extract(v, '^[^eE]*'), '.', ''), '0') AS digits, rtrim(ltrim(replace(regexp_extract(v::DOUBLE::VARCHAR, '^[^e]*'), '.', ''), '0'), '0') AS back FROM n WHERE NOT regexp_matches(v, '^0[xXoObB]'))
SELECT path, 'syntax-deep/precision-loss' AS rule, 'warning' AS severity, num::INT AS line, strpos(text, v)::INT AS col, v AS message FROM d WHERE length(digits) > 15 AND (rtrim(digits, '0') <> back OR regexp_matches(v, '[eE]|^\.|\..*0$'))""")
def precision_loss(spark, sf_dir):
    return line_rules.precision_loss(syn(spark, sf_dir)[1])


@query(f"WITH {SYN}, {_FUNCS} SELECT a.path, a.types, a.name AS a, b.name AS b FROM funcs a JOIN funcs b ON a.path = b.path AND a.types = b.types AND a.num < b.num AND a.name <> b.name WHERE length(a.types) >= 4")
def copied_signatures(spark, sf_dir):
    return relations.copied_signatures(relations.one_line_functions(syn(spark, sf_dir)[1]))


@query(f"""WITH {IMPORTS}, f AS (SELECT source, count(DISTINCT path) AS n_files FROM imports GROUP BY source HAVING count(DISTINCT path) >= 15),
s AS (SELECT source, symbol, count(DISTINCT path) AS n FROM (SELECT source, path, unnest(symbols) AS symbol FROM imports) GROUP BY ALL),
c AS (SELECT source, array_to_string(list_sort(list(symbol)), ',') AS symbols FROM s JOIN f USING (source) WHERE n >= 0.3 * n_files GROUP BY source)
SELECT source, n_files, coalesce(symbols, '') AS symbols FROM f LEFT JOIN c USING (source)""")
def spread_imports(spark, sf_dir):
    return relations.spread_imports(views.imports(syn(spark, sf_dir)[1]))


@query(f"""WITH {IMPORTS}, l AS (SELECT path, word, max(num) AS last FROM (SELECT path, num, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM lines) GROUP BY ALL),
i AS (SELECT path, num, source, len(symbols) AS n, unnest(symbols) AS word FROM imports WHERE lang <> 'python'),
u AS (SELECT path, num, source, n, count(*) AS k, array_to_string(list_sort(list(DISTINCT word)), ',') AS symbols FROM i LEFT JOIN l USING (path, word) WHERE last IS NULL OR last <= num GROUP BY ALL)
SELECT path, CASE WHEN k = n THEN 'import-intelligence/unused-import' ELSE 'import-intelligence/unused-symbol' END AS rule, 'warning' AS severity, num::INT AS line, 1 AS col, symbols AS message FROM u""")
def unused_imports(spark, sf_dir):
    ls = syn(spark, sf_dir)[1]
    return relations.unused_imports(views.imports(ls), ls)


@query(f"WITH {IMPORTS} SELECT {out('import-intelligence/duplicate-import', 'suggestion', 'min(num)', 'source')} FROM imports WHERE lang <> 'python' GROUP BY path, source HAVING count(*) >= 2")
def duplicate_imports(spark, sf_dir):
    return relations.duplicate_imports(views.imports(syn(spark, sf_dir)[1]))


@query(f"WITH {IMPORTS} SELECT {out('import-intelligence/tree-shakeable', 'suggestion', msg='source')} FROM imports WHERE source IN ('lodash', 'moment', 'rxjs', 'antd', 'date-fns', 'ramda', '@mui/material') AND len(symbols) > 0")
def tree_shakeable(spark, sf_dir):
    return relations.tree_shakeable(views.imports(syn(spark, sf_dir)[1]))


@query(rf"""WITH {IMPORTS}, p AS (SELECT *, CASE WHEN starts_with(source, '@') THEN regexp_extract(source, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(source, '^([^/]+)', 1) END AS name FROM imports WHERE lang <> 'python' AND NOT regexp_matches(source, '^(?:[./]|node:|@/|~/)'))
SELECT {out('ast-slop/hallucinated-import', 'error', msg='name')} FROM p WHERE name NOT IN ('react', 'fs', 'path')""")
def undeclared_imports(spark, sf_dir):
    declared = spark.createDataFrame([("react",), ("fs",), ("path",)], "name string")
    return relations.undeclared_imports(views.imports(syn(spark, sf_dir)[1]), F.broadcast(declared))


@query(f"""WITH {IMPORTS}, e AS (SELECT path, num, regexp_extract(text, '{views.EXPORT}', 1) AS name FROM lines WHERE {_JS}),
taken AS (SELECT DISTINCT unnest(symbols) AS name FROM imports)
SELECT {out('dead-flow/unused-export', 'info', msg='name')} FROM e ANTI JOIN taken USING (name) WHERE name <> '' AND NOT regexp_matches(name, '^[A-Z]|Engine\\z')""")
def unused_exports(spark, sf_dir):
    ls = syn(spark, sf_dir)[1]
    return relations.unused_exports(views.exports(ls), views.imports(ls))


@query(f"WITH {IMPORTS} SELECT {out('arch-constraints/high-coupling', 'warning', 'min(num)', 'count(DISTINCT source)')} FROM imports WHERE NOT type_only GROUP BY path HAVING count(DISTINCT source) > 2")
def high_coupling(spark, sf_dir):
    return relations.high_coupling(views.imports(syn(spark, sf_dir)[1]), 2)


@query(rf"""WITH {IMPORTS}, l AS (SELECT *, regexp_matches(source, '(?i)(?:^|\.\./|\./)(?:db|database|models?|repositories?|entities?|knex|prisma|drizzle|sequelize|typeorm|mongoose)/') OR contains(lower(source), '/db/') OR regexp_matches(source, '(?i)/data/(?:models?|repositories?|entities?)/') AS db,
  regexp_matches(path, '(?i)/(?:components?|views?|pages?|ui|screens?)/') OR regexp_matches(path, '(?i)\.[tj]sx$') AS ui, regexp_matches(path, '(?i)/(?:api|routes?|controllers?|handlers?|endpoints?)/') AS api, regexp_matches(source, '(?i)/(?:services?|use-?cases?|business|domain)/') AS service FROM imports)
SELECT {out('arch-constraints/layer-violation', 'warning', msg='source')} FROM l WHERE db AND (ui OR (api AND NOT service))""")
def layer_violation(spark, sf_dir):
    return relations.layer_violation(views.imports(syn(spark, sf_dir)[1]))


@query(rf"""WITH {IMPORTS} SELECT {out('arch-rules/no-lodash', 'error', msg='source')} FROM imports WHERE regexp_matches(path, '^src/(?:[^/]*/)*[^/]*\.ts\z') AND source = 'lodash'
UNION ALL SELECT {out('arch-rules/export-something', 'info', 'min(num)', "'^export '")} FROM lines WHERE regexp_matches(path, '^src/') AND path NOT IN (SELECT path FROM lines WHERE regexp_matches(text, '^export ')) GROUP BY path""")
def user_rules(spark, sf_dir):
    ls = syn(spark, sf_dir)[1]
    rules = [{"name": "no-lodash", "type": "forbid_import", "forbid": "lodash", "severity": "error", "where": "src/**/*.ts"}, {"name": "export-something", "type": "require_pattern", "pattern": "^export ", "severity": "info", "where": "src/**"}]
    return relations.user_rules(rules, views.imports(ls), ls)


# tested by brute force: SQL would walk all paths
@query()
def cycles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return relations.cycles(s.select(F.col("s_nationkey").cast("string").alias("src"), (F.col("s_suppkey") * 7 % 25).cast("string").alias("dst")).distinct())


@query()
def import_cycles(spark, sf_dir):
    f, ls = syn(spark, sf_dir)
    return relations.cycles(relations.import_edges(views.imports(ls), f))


# file n imports ./f<n>, ./c<n>, ./prices, ../wide and others; only the first names a file, its own
@query("SELECT 'src/util/f' || p_partkey || '.ts' AS src, 'src/util/f' || p_partkey || '.ts' AS dst FROM part WHERE p_partkey % " + str(len(synthetic.SNIPPETS)) + " = 2")
def import_graph(spark, sf_dir):
    f, ls = syn(spark, sf_dir)
    return relations.import_edges(views.imports(ls), f)


@query(rf"""WITH {SYN}, css AS (SELECT path, num, '.' || unnest(regexp_extract_all(text, '\.([A-Za-z_][\w-]*)\s*[,{{:]', 1)) AS name FROM lines WHERE lang = 'css' UNION ALL SELECT path, num, '#' || unnest(regexp_extract_all(text, '#([A-Za-z_][\w-]*)\s*[,{{:]', 1)) FROM lines WHERE lang = 'css'),
own AS (SELECT text FROM lines WHERE lang IN ('html', 'typescript', 'javascript')),
used AS (SELECT DISTINCT '.' || unnest(string_split_regex(l, '\s+')) AS name FROM (SELECT unnest(list_concat(regexp_extract_all(text, 'class(?:Name)?\s*=\s*"([^"]*)"', 1), regexp_extract_all(text, 'class(?:Name)?\s*=\s*''([^'']*)''', 1))) AS l FROM own)
  UNION SELECT DISTINCT '#' || unnest(regexp_extract_all(text, '\bid\s*=\s*["'']([^"'']*)["'']', 1)) FROM own)
SELECT {out('css/unused-selector', 'info', msg='name')} FROM css ANTI JOIN used USING (name)""")
def unused_selectors(spark, sf_dir):
    return relations.unused_selectors(syn(spark, sf_dir)[1])


@query(rf"""WITH {SYN}, used AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\bt\(\s*[''"]([\w.-]+)[''"]', 1)) AS name FROM lines WHERE {_JS}),
keys AS (SELECT * FROM (VALUES ('en', 'menu.open'), ('en', 'menu.other'), ('de', 'menu.open'), ('fr', 'menu.other')) AS t(locale, name)), ls AS (SELECT DISTINCT locale FROM keys)
SELECT 'i18n-lint/missing-translation-key' AS rule, name, locale FROM used CROSS JOIN ls ANTI JOIN keys USING (name, locale)
UNION ALL SELECT 'i18n-lint/untranslated-locale', name, locale FROM (SELECT DISTINCT name FROM keys) CROSS JOIN ls ANTI JOIN keys USING (name, locale)""")
def translations(spark, sf_dir):
    keys = spark.createDataFrame([("en", "menu.open"), ("en", "menu.other"), ("de", "menu.open"), ("fr", "menu.other")], "locale string, name string")
    return relations.translations(relations.translation_keys(syn(spark, sf_dir)[1]), keys)


# ---- findings


def found(spark, sf_dir) -> DataFrame:
    return line_rules.detect(syn(spark, sf_dir)[1])


FOUND = f"{SYN}, found AS MATERIALIZED ({line_rules.sql()})"
_RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 WHEN 'suggestion' THEN 3 ELSE 4 END"
_OVERRIDES = [("ast-slop/todo-stub", "error"), ("types/*", "off"), ("ast-slop/*", "info"), ("ast-slop/as-any", "off")]


@query(f"""WITH {FOUND} SELECT path, rule, CASE WHEN rule = 'ast-slop/todo-stub' THEN 'error' WHEN starts_with(rule, 'ast-slop') THEN 'info' ELSE severity END AS severity, line, col, message FROM found WHERE NOT starts_with(rule, 'types') AND rule <> 'ast-slop/as-any'""")
def rule_override(spark, sf_dir):
    return P.override(found(spark, sf_dir), _OVERRIDES)


_MARK = r"(?://|#|/\*|<!--)\s*lint-(ignore-next|ignore-line|ignore-start|ignore-end|ignore|disable-next-line|disable-line|disable|enable)\b[ ]*([A-Za-z0-9_/*, -]*)"


@query(rf"""WITH {FOUND}, m AS (SELECT path, num, regexp_extract(text, '{_MARK}', 1) AS word, list_filter(string_split_regex(regexp_replace(regexp_extract(text, '{_MARK}', 2), '\*/|--.*\z|-->', '', 'g'), '[, ]+'), lambda x: x NOT IN ('', '*')) AS rules FROM lines),
d AS (SELECT path, num, rules, CASE WHEN word IN ('ignore-next', 'ignore', 'disable-next-line') THEN 'next' WHEN word IN ('ignore-line', 'disable-line') THEN 'line' WHEN word IN ('ignore-start', 'disable') THEN 'start' ELSE 'end' END AS kind FROM m WHERE word <> ''),
e AS (SELECT *, lead(kind) OVER {_W} AS nxt, lead(num) OVER {_W} AS stop FROM d WHERE kind IN ('start', 'end')),
s AS (SELECT path, CASE kind WHEN 'line' THEN num ELSE num + 1 END AS a, CASE kind WHEN 'line' THEN num ELSE num + 1 END AS b, rules FROM d WHERE kind IN ('next', 'line') UNION ALL SELECT path, num, coalesce(stop, 999999), rules FROM e WHERE kind = 'start' AND (nxt IS NULL OR nxt = 'end'))
SELECT f.* FROM found f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = f.path AND f.line BETWEEN a AND b AND (len(rules) = 0 OR list_contains(rules, f.rule)))""")
def suppressed(spark, sf_dir):
    return P.suppress(found(spark, sf_dir), syn(spark, sf_dir)[1])


@query(f"WITH {FOUND} SELECT path, rule, severity, line, col, message FROM (SELECT *, row_number() OVER (PARTITION BY path, line, rule ORDER BY {_RANK}, col, message) AS r FROM found) WHERE r = 1")
def first_of_each(spark, sf_dir):
    return P.first_of_each(found(spark, sf_dir))


@query(f"WITH {FOUND} SELECT * FROM found WHERE {_RANK} <= 1")
def severity_floor(spark, sf_dir):
    return P.at_least(found(spark, sf_dir), "warning")


@query(f"WITH {FOUND}, d AS (SELECT * FROM (VALUES (0, 'error'), (1, 'warning'), (2, 'info'), (3, 'suggestion')) AS t(rank, severity)) SELECT severity, rank, count(path) AS n FROM d LEFT JOIN found USING (severity) GROUP BY ALL")
def severity_counts(spark, sf_dir):
    return P.severity_counts(found(spark, sf_dir))


@query(f"WITH {FOUND} SELECT split_part(rule, '/', 1) AS engine, rule, count(*) AS n FROM found GROUP BY ROLLUP (split_part(rule, '/', 1), rule)")
def engine_rollup(spark, sf_dir):
    return P.engine_rollup(found(spark, sf_dir))


@query(f"WITH {FOUND} SELECT rule, count(*) AS n, min({_RANK})::INT AS worst FROM found GROUP BY rule ORDER BY n DESC, rule LIMIT 10")
def top_rules(spark, sf_dir):
    return P.top_rules(found(spark, sf_dir))


@query(f"WITH {FOUND} SELECT rule, r::INT AS r, path, line FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line, col, message) AS r FROM found) WHERE r <= 3")
def first_places(spark, sf_dir):
    return P.first_places(found(spark, sf_dir))


# written down here by hand, apart from the rule table that the engine reads
_TIER = """CASE WHEN rule IN ('ast-slop/narrative-comment', 'security-deep/eval-usage', 'security-deep/sql-injection', 'security-deep/shell-injection', 'security-deep/prototype-pollution', 'security-deep/ssrf-risk', 'security-deep/hardcoded-secret', 'security-deep/xss-risk',
    'security-deep/unsafe-html', 'html/missing-alt', 'yaml/tab-indent', 'python-deep/bare-except', 'python-deep/mutable-default', 'go-deep/goto-usage') THEN 'strict'
  WHEN rule IN ('dead-flow/dead-conditional', 'syntax-deep/unicode-anomaly', 'rust-deep/unwrap-in-prod', 'rust-deep/todo-macro', 'rust-deep/unimplemented-macro', 'python-deep/global-variable', 'python-deep/star-import', 'go-deep/unchecked-error', 'go-deep/empty-interface') THEN 'standard'
  WHEN rule IN ('nextjs/pages-router-in-app', 'nextjs/next-router-vs-navigation', 'tailwind/apply-anti-pattern', 'tailwind/inline-style-conflict', 'html/missing-lang', 'html/inline-event-handler', 'python-deep/no-type-hint', 'python-deep/no-return-type') THEN 'maintainability'
  WHEN rule IN ('ast-slop/decorative-comment', 'arch-constraints/unstable-dependency', 'format-lint/max-line-length', 'tailwind/important-modifier', 'python-deep/print-statement') THEN 'style'
  WHEN rule IN ('tailwind/magic-values', 'css/universal-selector', 'md/missing-fenced-lang') THEN 'advisory' ELSE 'mechanical' END"""


def _score_sql(by: str = "", log: bool = True, n: int = 100, smoothing: int = 20) -> str:
    keys, only = f"{by}, " if by else "", f"PARTITION BY {by}, rule" if by else "PARTITION BY rule"
    raw = "100.0 - 100.0 * ln(1 + total * density) / ln(1 + 100.0 + total * density)" if log else "100.0 - total"
    return f"""WITH {FOUND}, f AS (SELECT *, split_part(rule, '/', 1) AS engine, {_TIER} AS tier FROM found),
c AS (SELECT *, CASE tier WHEN 'strict' THEN 40 WHEN 'standard' THEN 30 WHEN 'maintainability' THEN 24 WHEN 'mechanical' THEN 16 ELSE 8 END AS cap, CASE tier WHEN 'strict' THEN 1.0 WHEN 'standard' THEN 1.0 WHEN 'maintainability' THEN 0.75 WHEN 'advisory' THEN 0.25 ELSE 0.5 END AS mult FROM f),
r AS (SELECT *, row_number() OVER ({only} ORDER BY path, line, col, message) AS r FROM c),
w AS (SELECT *, (CASE WHEN r <= cap THEN mult * CASE severity WHEN 'error' THEN 10.0 WHEN 'warning' THEN 1.0 ELSE 0.0 END ELSE 0.0 END)::DOUBLE AS w FROM r),
u AS (SELECT *, sum(w) OVER ({only} ORDER BY r) AS run FROM w),
g AS (SELECT {keys}rule, sum(w) AS w, count(*) FILTER (r > cap {'OR (w > 0 AND run > 5)' if log else ''}) AS capped, count(*) FILTER (severity IN ('error', 'warning')) AS bad FROM u GROUP BY ALL),
t AS (SELECT {keys}sum({'least(w, 5.0)' if log else 'w'})::DOUBLE AS total, sum(capped)::BIGINT AS n_capped, least(1.0, sum(bad) / {n + smoothing}.0)::DOUBLE AS density FROM g {'GROUP BY ' + by if by else ''}),
s AS (SELECT *, floor(greatest(0.0, least(100.0, {raw})) + 0.5)::INT AS score FROM t)
SELECT {keys}score, CASE WHEN score >= 75 THEN 'healthy' WHEN score >= 50 THEN 'needs work' ELSE 'critical' END AS label, round(density, 9) AS density, round(total, 6) AS total, n_capped FROM s"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("density", F.round("density", 9)).withColumn("total", F.round("total", 6))


@query(_score_sql())
def score_log(spark, sf_dir):
    return _rounded(P.score(found(spark, sf_dir), 100, smoothing=20.0))


@query(_score_sql(log=False))
def score_linear(spark, sf_dir):
    return _rounded(P.score(found(spark, sf_dir), 100, smoothing=20.0, mode="linear"))


@query(_score_sql("engine"))
def score_by_engine(spark, sf_dir):
    return _rounded(P.score(found(spark, sf_dir).withColumn("engine", P.engine()), 100, smoothing=20.0, by=("engine",)))


@query("SELECT o_orderkey, (o_orderkey % 101)::INT AS score, o_orderkey % 7 = 0 AS has_errors, o_orderkey % 5 <> 0 AS scoreable, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 101 < 70 THEN 3 ELSE 0 END AS code, o_orderkey % 101 >= 60 AS passed FROM orders")
def gates(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 101).cast("int").alias("score"), (k % 7 == 0).alias("has_errors"), (k % 5 != 0).alias("scoreable"))
    return P.baseline_gate(P.exit_code(rows), 60)


@query(f"WITH {SYN} SELECT round(count(*) FILTER (lang NOT IN ('typescript', 'javascript', 'python')) / count(*), 6) AS unsupported, count(*) FILTER (lang NOT IN ('typescript', 'javascript', 'python')) / count(*) < 0.8 AS scoreable FROM files WHERE lang IS NOT NULL")
def scoreable(spark, sf_dir):
    return P.scoreable(synthetic.files(spark, sf_dir), ("typescript", "javascript", "python")).withColumn("unsupported", F.round("unsupported", 6))


# by hand: which findings are complex (architecture, security, errors without a fix), moderate, or trivial
_ASSESS = """SELECT *, CASE WHEN starts_with(rule, 'arch-constraints/') OR (severity = 'error' AND rule NOT IN ('html/missing-alt', 'yaml/tab-indent')) THEN 'complex'
  WHEN severity = 'error' OR rule IN ('ast-slop/hardcoded-config', 'html/inline-event-handler') OR (severity = 'warning' AND starts_with(rule, 'security-deep/')) THEN 'moderate'
  WHEN rule IN ('ast-slop/todo-stub', 'syntax-deep/unicode-anomaly') THEN 'trivial' ELSE 'simple' END AS complexity FROM found"""


@query(f"""WITH {FOUND}, a AS ({_ASSESS}), t AS (SELECT count(*) AS n, count(*) FILTER (complexity = 'trivial') AS n_trivial, count(*) FILTER (complexity = 'simple') AS n_simple, count(*) FILTER (complexity = 'moderate') AS n_moderate, count(*) FILTER (complexity = 'complex') AS n_complex,
  max(CASE complexity WHEN 'trivial' THEN 1 WHEN 'simple' THEN 2 WHEN 'moderate' THEN 3 ELSE 4 END)::INT AS priority FROM a), m AS (SELECT *, (n_trivial + 5 * n_simple + 15 * n_moderate + 60 * n_complex)::BIGINT AS minutes FROM t)
SELECT *, CASE WHEN minutes < 60 THEN minutes || ' min' WHEN minutes % 60 > 0 THEN (minutes // 60) || 'h ' || (minutes % 60) || 'm' ELSE (minutes // 60) || 'h' END AS effort FROM m""")
def effort_summary(spark, sf_dir):
    return P.effort(P.assess(P.described(found(spark, sf_dir))))


@query(f"WITH {FOUND}, a AS ({_ASSESS}) SELECT path, rule, severity, line, col, message, complexity FROM a")
def assessed_findings(spark, sf_dir):
    return P.assess(P.described(found(spark, sf_dir))).select("path", "rule", "severity", "line", "col", "message", "complexity")


_DAILY = "days AS (SELECT date_trunc('day', ts) AS day, (count(*) % 100)::INT AS score FROM events GROUP BY 1)"


@query(f"""WITH {_DAILY}, c AS (SELECT *, lag(score) OVER (ORDER BY day) AS before FROM days)
SELECT strftime(day, '%Y-%m-%d') AS day, score, before, score - before AS change, CASE WHEN score - before < -10 THEN 'severe-regression' WHEN score - before < -3 THEN 'degrading' WHEN score - before > 5 THEN 'improving' WHEN before IS NOT NULL THEN 'stable' END AS kind, least(floor(score / 100.0 * 8), 7)::INT AS level FROM c""")
def score_trend(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.count("*") % 100).cast("int").alias("score"))
    return P.trend(days, "day")


@query("""WITH n AS (SELECT event_type AS engine, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT event_type AS engine, count(*) AS before FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT engine, coalesce(n, 0)::BIGINT AS n, coalesce(before, 0)::BIGINT AS before FROM n FULL JOIN b USING (engine) WHERE coalesce(n, 0) - coalesce(before, 0) > 10""")
def engine_spikes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("engine", F.col("event_type"))
    count = lambda c: e.filter(c).groupBy("engine").agg(F.count("*").alias("n"))
    return P.spikes(count("ts >= TIMESTAMP '2024-01-16'"), count("ts < TIMESTAMP '2024-01-16'"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_changes FROM s GROUP BY user_id, session""")
def change_sessions(spark, sf_dir):
    return quiet(table(spark, sf_dir, "events"), "30 minutes", by=("user_id",))


@query(f"WITH {FOUND} SELECT DISTINCT rule, split_part(rule, '/', 1) AS engine, {_TIER} AS tier FROM found")
def rule_catalogue(spark, sf_dir):
    return P.catalogue(found(spark, sf_dir))


@query(f"""WITH {FOUND}, c AS (SELECT DISTINCT rule, split_part(rule, '/', 1) AS engine, 'mechanical' AS tier FROM found)
SELECT *, CASE WHEN rule = 'python' THEN 10 WHEN starts_with(rule, 'python') THEN 8 WHEN contains(rule, 'python') THEN 5 WHEN contains(engine, 'python') THEN 2 ELSE 0 END AS fit, levenshtein(rule, 'python')::INT AS distance FROM c""")
def rule_search(spark, sf_dir):
    return P.search(P.catalogue(found(spark, sf_dir), {"x": "strict"}), "python")


# ---- reports and fixes


@query(f"WITH {FOUND} SELECT rule, CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line, col, message) AS r FROM found) WHERE r = 1")
def sarif_rules(spark, sf_dir):
    return reports.sarif_rules(found(spark, sf_dir)).select("rule", "level")


@query(f"""WITH {FOUND} SELECT path, line, rule, CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, path AS uri, greatest(line, 1) AS start_line, greatest(col, 1) AS start_col FROM found""")
def sarif_results(spark, sf_dir):
    rows = reports.sarif_results(found(spark, sf_dir))
    place = "$.locations[0].physicalLocation."
    field = lambda name: F.get_json_object("json", name)
    return rows.select("path", "line", field("$.ruleId").alias("rule"), field("$.level").alias("level"), field(place + "artifactLocation.uri").alias("uri"), field(place + "region.startLine").cast("int").alias("start_line"), field(place + "region.startColumn").cast("int").alias("start_col"))


@query(f"""WITH {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {_RANK}, line, rule, col, message) AS r, count(*) OVER (PARTITION BY path) AS n FROM found)
SELECT path, n, string_agg('  ' || line || ' ' || severity || ' ' || rule, chr(10) ORDER BY r) AS text FROM r WHERE r <= 50 GROUP BY path, n""")
def report_by_file(spark, sf_dir):
    return reports.by_file(found(spark, sf_dir))


@query(f"WITH {FOUND} SELECT path, rule, greatest(line - 1, 0) AS start_line, greatest(col - 1, 0) AS start_char, ({_RANK}) + 1 AS severity FROM found")
def lsp_ranges(spark, sf_dir):
    return reports.lsp(found(spark, sf_dir))


def _redact_sql() -> str:
    from corpusmill.functions.text import REDACTIONS

    s = "coalesce(text, '')"
    for pattern, mask in REDACTIONS:
        s = f"regexp_replace({s}, '{pattern}', '{mask}', 'g')"
    return f"SELECT doc_id, md5({s}) AS redacted FROM documents"


@query(_redact_sql())
def redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redact(F.coalesce("text", F.lit("")))).alias("redacted"))


_FIX_SURE = " ".join(f"WHEN '{r}' THEN {c}" for r, c in fixes.DELETE.items()) + " " + " ".join(f"WHEN '{r}' THEN {v[2]}" for r, v in fixes.REPLACE.items())
_FIX_NEW = " ".join(f"WHEN '{r}' THEN regexp_replace(text, '{v[0]}', '{v[1]}', 'g')" for r, v in fixes.REPLACE.items())
_STEPS = f"""{FOUND}, steps AS (SELECT f.path, f.line, rule, CASE WHEN rule IN ({', '.join(repr(r) for r in fixes.DELETE)}) THEN 'delete' ELSE 'replace' END AS kind, text AS old, CASE rule {_FIX_NEW} ELSE '' END AS new, (CASE rule {_FIX_SURE} END)::DOUBLE AS confidence
  FROM found f JOIN lines l ON f.path = l.path AND f.line = l.num WHERE rule IN ({', '.join(repr(r) for r in [*fixes.DELETE, *fixes.REPLACE])})),
one AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY confidence DESC, rule) AS r FROM steps WHERE confidence >= 0.8),
plan AS MATERIALIZED (SELECT path, line, rule, kind, old, new, confidence, row_number() OVER (PARTITION BY path ORDER BY line DESC)::INT AS step FROM one WHERE r = 1)"""


def _steps(spark, sf_dir) -> DataFrame:
    own = [r for r in line_rules.RULES if r.id in fixes.FIXABLE]
    return fixes.plan(fixes.propose(line_rules.detect(syn(spark, sf_dir)[1], own, with_text=True)))


@query(f"WITH {_STEPS} SELECT * FROM plan")
def fix_plan(spark, sf_dir):
    return _steps(spark, sf_dir)


@query(f"""WITH {_STEPS} SELECT l.path, string_agg(CASE WHEN p.path IS NULL THEN l.text ELSE p.new END, chr(10) ORDER BY l.num) AS content FROM lines l LEFT JOIN plan p ON l.path = p.path AND l.num = p.line
WHERE l.path IN (SELECT path FROM plan) AND (p.kind IS NULL OR p.kind <> 'delete') GROUP BY l.path""")
def fix_apply(spark, sf_dir):
    f, ls = syn(spark, sf_dir)
    return fixes.apply(f, ls, _steps(spark, sf_dir))


@query(f"WITH {_STEPS} SELECT f.path, f.rule, f.line, f.severity, f.col, f.message FROM found f LEFT JOIN (SELECT path, rule, line, 1 AS planned FROM plan) p USING (path, rule, line) WHERE planned IS NULL")
def fix_remaining(spark, sf_dir):
    return fixes.remaining(found(spark, sf_dir), _steps(spark, sf_dir))


@query(f"WITH {_STEPS} SELECT path, line, '-' || old AS before, CASE WHEN kind <> 'delete' THEN '+' || new END AS after FROM plan")
def fix_preview(spark, sf_dir):
    return fixes.preview(_steps(spark, sf_dir))


_MANIFEST = '{"dependencies": {"react": "^18.0.0", "request": "*"}, "devDependencies": {"react": "17.1.0"}, "peerDependencies": {"react": "x"}}'


@query("""SELECT 'a' || p_partkey || '/package.json' AS path, rule, severity, 1 AS line, 1 AS col, message FROM part, (VALUES ('dep-audit/unpinned', 'warning', 'request'), ('dep-audit/unpinned', 'warning', 'react'), ('dep-audit/cross-listed', 'warning', 'react'), ('dep-audit/peer-in-deps', 'warning', 'react'), ('dep-audit/deprecated', 'warning', 'request'), ('dep-audit/missing-engines', 'info', ''), ('dep-audit/missing-lockfile', 'error', ''), ('dep-audit/major-outdated', 'warning', 'react'), ('dep-audit/minor-outdated', 'info', 'react')) AS t(rule, severity, message)""")
def dependency_audit(spark, sf_dir):
    f = as_files(parts(spark, sf_dir), F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit("/package.json")), F.lit(_MANIFEST))
    latest = spark.createDataFrame([("react", "18.2.0")], "name string, version string")
    return reports.dependency_audit(manifest_dependencies(f), F.broadcast(latest)).unionByName(reports.manifest_audit(f))


# ---- whole scans and probes


def _result(spark, sf_dir) -> DataFrame:
    from corpusmill.plans import scan

    return scan.findings(synthetic.files(spark, sf_dir), at_once=8)


@query(f"""WITH {FOUND}, w AS (SELECT rule, count(*) AS n, min({_RANK}) AS worst_rank FROM found GROUP BY rule), o AS (SELECT rule, path || ':' || line || ':' || col AS place, row_number() OVER (PARTITION BY rule ORDER BY path, line, col, message) AS r FROM found),
p AS (SELECT rule, string_agg(place, chr(10) ORDER BY r) AS places FROM o WHERE r <= 3 GROUP BY rule)
SELECT split_part(rule, '/', 1) AS engine, rule, n, CASE worst_rank WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'suggestion' END AS worst, places FROM w JOIN p USING (rule)""")
def report_by_rule(spark, sf_dir):
    return reports.by_rule(found(spark, sf_dir))


@query(f"""WITH {FOUND} SELECT path, count(*) AS n, '## ' || path || chr(10) || string_agg('- Line ' || line || ': [' || upper(severity) || '] ' || rule || chr(10) || '  ' || message, chr(10) ORDER BY line, rule, col, '- Line ' || line || ': [' || upper(severity) || '] ' || rule || chr(10) || '  ' || message) AS text
FROM found WHERE rule NOT IN ('security-deep/hardcoded-secret') GROUP BY path""")
def agent_prompt(spark, sf_dir):
    # messages with secrets are masked, as the query redaction shows; here are those of all other rules
    return reports.agent_prompt(found(spark, sf_dir).filter("rule <> 'security-deep/hardcoded-secret'"))


@query(f"""WITH {FOUND}, a AS (SELECT * FROM found WHERE NOT starts_with(rule, 'types/')), b AS (SELECT path, rule, CASE WHEN rule = 'ast-slop/todo-stub' THEN 'error' ELSE severity END AS severity, line, col, message FROM found WHERE NOT starts_with(rule, 'html/'))
SELECT *, 'new' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'fixed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'kept' FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)""")
def compared_scans(spark, sf_dir):
    rows = found(spark, sf_dir)
    after = P.override(rows, [("ast-slop/todo-stub", "error"), ("html/*", "off")])
    return P.compared(rows.filter("NOT startswith(rule, 'types/')"), after)


@query(f"SELECT 'cmd/f' || p_partkey || '.go' AS path, num, source, name FROM part JOIN (VALUES (3, 'fmt', 'fmt'), (6, 'example.org/x/files', 'io'), (7, 'os', 'os')) AS t(num, source, name) ON p_partkey % {len(synthetic.SNIPPETS)} = 5")
def go_imports(spark, sf_dir):
    return views.go_imports(syn(spark, sf_dir)[1])


@query()
def scan_findings(spark, sf_dir):
    return _result(spark, sf_dir)


@query(_by_snippet([
    (3, "ast-slop/console-leftover", "suggestion", 13, 1, ""), (3, "ast-slop/silent-recovery", "info", 8, 1, ""), (4, "ast-slop/console-leftover", "suggestion", 6, 1, ""), (13, "dead-flow/unreachable-after-if-else-return", "warning", 34, 1, ""),
]))
def more_context_rules(spark, sf_dir):
    f, ls = syn(spark, sf_dir)
    return context_rules.more_rules(f, ls)


@query(_by_snippet([(13, "import-intelligence/type-only-import", "suggestion", 1, 1, "./prices")]))
def type_only_imports(spark, sf_dir):
    ls = syn(spark, sf_dir)[1]
    return relations.type_only_imports(views.imports(ls), ls)


# ---- syntax over lines: states, tokens, blocks, statements

MODULES = synthetic.sql(synthetic.MODULES)


def modules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = synthetic.files(spark, sf_dir, synthetic.MODULES)
    return f, views.lines(f)


@query(f"WITH RECURSIVE {MODULES}, {syntax.states_sql()} SELECT path, num::INT AS num, state FROM states")
def lexical_states(spark, sf_dir):
    return syntax.states(modules(spark, sf_dir)[1])


@query(f"WITH RECURSIVE {DOCS}, {syntax.states_sql()} SELECT state, count(*) AS n_lines, count(DISTINCT path) AS n_files, sum(num)::BIGINT AS places FROM states GROUP BY state")
def document_states(spark, sf_dir):
    rows = syntax.states(views.lines(doc_files(spark, sf_dir)))
    return rows.groupBy("state").agg(F.count("*").alias("n_lines"), F.countDistinct("path").alias("n_files"), F.sum(F.col("num").cast("long")).alias("places"))


@query(_by_snippet([
    (0, "ast-slop/as-any", "warning", 16, 17, "as any"), (0, "types/double-assertion", "warning", 18, 13, "as unknown as number"), (0, "types/double-assertion", "warning", 19, 13, "as unknown as Shape"),
    (1, "security-deep/eval-usage", "error", 9, 1, "eval("), (1, "security-deep/inner-html", "error", 14, 3, ".innerHTML ="), (1, "security-deep/unsafe-html", "error", 14, 3, ".innerHTML ="),
    (3, "ast-slop/as-any", "warning", 2, 34, "as any"), (3, "ast-slop/as-any", "warning", 6, 27, "as any"), (3, "ast-slop/as-any", "warning", 9, 22, "as any"), (3, "ast-slop/as-any", "warning", 10, 15, "as any"), (3, "types/as-any-json-parse", "warning", 6, 10, "JSON.parse(text) as any"),
], synthetic.MODULES))
def findings_in_code(spark, sf_dir):
    """Line rules about code, quiet in comments, strings and templates over lines."""
    ls = modules(spark, sf_dir)[1]
    return syntax.in_code(line_rules.detect(ls), ls).filter(F.col("rule").rlike(r"^security-deep/|^types/(?:as-any|double)|^ast-slop/as-any\z"))


@query(_by_snippet([
    (0, "ast-slop/swallowed-exception", "info", 4, 5, "catch"), (0, "ast-slop/swallowed-exception", "info", 7, 16, "catch"), (0, "ast-slop/as-any", "warning", 16, 17, "as any"), (0, "ast-slop/console-leftover", "suggestion", 17, 1, "console.debug"),
    (0, "ast-slop/double-assertion", "warning", 18, 13, "as unknown as number"), (3, "ast-slop/as-any", "warning", 9, 22, "as any"), (3, "ast-slop/as-any", "warning", 10, 15, "as any"), (4, "ast-slop/console-leftover", "suggestion", 1, 1, "console.log"),
], synthetic.MODULES))
def tree_slop(spark, sf_dir):
    return syntax.tree_rules(modules(spark, sf_dir)[0], ("slop",))


@query(_by_snippet([
    (2, "dead-flow/dead-after-return", "warning", 11, 3, "return 6"), (2, "dead-flow/dead-after-break", "error", 20, 5, "continue 18"), (2, "dead-flow/dead-after-throw", "error", 25, 3, "throw 22"), (2, "dead-flow/dead-after-return", "warning", 33, 5, "return 32"),
    (3, "dead-flow/dead-after-return", "warning", 15, 5, "return 14"), (3, "dead-flow/dead-after-return", "warning", 18, 34, "return 18"), (4, "dead-flow/dead-after-return", "warning", 9, 1, "return 8"),
], synthetic.MODULES))
def tree_unreachable(spark, sf_dir):
    return syntax.tree_rules(modules(spark, sf_dir)[0], ("dead",))


@query(f"""SELECT folder || '/f' || p_partkey || '.ts' AS path, kind, n FROM part JOIN (VALUES (0, 'src/core', 'function', 1), (0, 'src/core', 'try', 3), (0, 'src/core', 'catch', 3),
(2, 'src/flow', 'function', 3), (2, 'src/flow', 'if', 1), (2, 'src/flow', 'object', 1), (2, 'src/flow', 'for', 1), (2, 'src/flow', 'arrow', 1), (2, 'src/flow', 'switch', 1), (2, 'src/flow', 'try', 1), (2, 'src/flow', 'finally', 1),
(3, 'src/data', 'arrow', 2), (3, 'src/data', 'function', 3), (3, 'src/data', 'class', 1), (3, 'src/data', 'object', 1), (3, 'src/data', 'block', 2), (4, 'tests', 'for', 1), (4, 'tests', 'if', 1), (4, 'tests', 'else', 1), (4, 'tests', 'block', 2)) AS t(i, folder, kind, n) ON p_partkey % {len(synthetic.MODULES)} = i""")
def block_kinds(spark, sf_dir):
    return syntax.blocks(syntax.tokens(modules(spark, sf_dir)[0])).groupBy("path", "kind").agg(F.count("*").cast("int").alias("n"))


def _only(rows: DataFrame, sql: str) -> DataFrame:
    """Findings of the rules that an expectation names."""
    import re

    return rows.filter(F.col("rule").isin(*set(re.findall(r"'([a-z-]+/[a-z-]+)', '(?:error|warning|info|suggestion)'", sql))))


_ODD_CONTEXT = _by_snippet([
    (0, "ast-slop/trivial-comment", "suggestion", 1, 1, "// the user account balance"), (0, "ast-slop/overdefensive-type", "info", 5, 1, "name"), (0, "ast-slop/unnecessary-abstraction", "info", 8, 1, "Shape"),
    (1, "types/as-any-orm", "suggestion", 1, 1, ""), (2, "types/as-any-window", "warning", 1, 1, ""), (3, "types/as-any-param", "warning", 1, 1, ""), (4, "types/as-any", "warning", 1, 1, ""),
    (5, "ast-slop/placeholder-impl", "warning", 1, 1, ""), (6, "arch-constraints/god-file", "warning", 1, 1, "307"), (7, "syntax-deep/crlf-line-endings", "warning", 1, 1, ""), (8, "syntax-deep/mixed-line-endings", "warning", 1, 1, ""),
    (9, "syntax-deep/zwnbsp-mid-file", "warning", 2, 1, ""), (10, "nextjs/misplaced-use-client", "warning", 1, 1, ""), (11, "nextjs/missing-use-client", "error", 1, 1, ""), (12, "nextjs/link-without-aria", "suggestion", 1, 1, '<Link href="/a"></Link>'),
], synthetic.ODD)
_ODD_FOLDS = _by_snippet([
    (13, "syntax-deep/regex-escape-in-string", "warning", 1, 12, "\\d"), (13, "syntax-deep/invalid-escape-sequence", "warning", 2, 12, "\\q"), (13, "syntax-deep/unnecessary-regex-class-escape", "info", 3, 13, "\\."),
    (14, "dead-flow/dead-switch-code", "warning", 4, 1, "lost();"), (14, "dead-flow/dead-switch-case-after-default", "warning", 7, 1, "case 2:"),
    (15, "go-deep/init-side-effect", "warning", 2, 1, "func init() {"), (15, "go-deep/context-missing", "warning", 5, 1, "Load$K"), (15, "go-deep/deep-copy-missing", "warning", 8, 1, "CloneThing"),
], synthetic.ODD)


@query(_ODD_CONTEXT)
def odd_context_rules(spark, sf_dir):
    f = synthetic.files(spark, sf_dir, synthetic.ODD)
    ls = views.lines(f)
    return _only(context_rules.all_rules(f, ls).unionByName(context_rules.more_rules(f, ls)), _ODD_CONTEXT)


@query(_by_snippet([
    (16, "security-deep/prototype-pollution", "warning", 1, 1, "unsafe deepMerge"), (16, "security-deep/prototype-pollution", "warning", 2, 31, "deepMerge"), (16, "security-deep/prototype-pollution", "warning", 10, "11+key", "deepMerge"),
    (17, "security-deep/prototype-pollution", "warning", 3, 1, "unsafe mergeDeep"),
], synthetic.ODD))
def unguarded_merges(spark, sf_dir):
    return syntax.tree_rules(synthetic.files(spark, sf_dir, synthetic.ODD), ("merges",))


@query("""SELECT folder || p_partkey || file AS path, 'go-deep/package-cycle' AS rule, 'error' AS severity, 1 AS line, 1 AS col, 'a' || p_partkey || ' -> b' || p_partkey || tail AS message
FROM part, (VALUES ('pkgA', '/foo.go', false), ('pkgB', '/bar.go', false), ('pkgA', '/foo.go', true), ('pkgB', '/bar.go', true), ('pkgC', '/c.go', true)) AS t(folder, file, long), (VALUES (false, ''), (true, 'c')) AS u(far, part)
, LATERAL (SELECT CASE WHEN far THEN ' -> c' || p_partkey ELSE '' END AS tail) WHERE far = long AND (NOT far OR p_partkey % 3 = 0)""")
def go_package_cycles(spark, sf_dir):
    """Go packages made from part: a and b import each other; of every third key a, b and c stand in a circle too."""
    key = F.col("p_partkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    back = F.when(F.col("p_partkey") % 3 == 0, text('\n\t"c', key, '"')).otherwise(F.lit(""))
    made = F.array(
        F.struct(text("pkgA", key, "/foo.go").alias("p"), text("package a", key, '\n\nimport "x/b', key, '"\n').alias("c")),
        F.struct(text("pkgB", key, "/bar.go").alias("p"), text("package b", key, '\n\nimport (\n\t"fmt"\n\t"a', key, '"', back, "\n)\n").alias("c")),
        F.struct(text("pkgC", key, "/c.go").alias("p"), text("package c", key, '\nimport "a', key, '"\n').alias("c")),
    )
    rows = parts(spark, sf_dir).select(F.explode(made).alias("x"))
    return relations.package_cycles(views.lines(as_files(rows, F.col("x.p"), F.col("x.c"))))


@query(_by_snippet([
    (18, "python-deep/no-type-hint", "warning", 1, 1, "a"), (18, "python-deep/no-type-hint", "warning", 1, 1, "c"), (18, "python-deep/no-type-hint", "warning", 5, 1, "second"), (18, "python-deep/no-type-hint", "warning", 5, 1, "fourth"),
    (18, "python-deep/mutable-default", "warning", 5, 1, "first"), (18, "python-deep/mutable-default", "warning", 5, 1, "fourth"),
], synthetic.ODD))
def parameter_rules(spark, sf_dir):
    return headers.parameter_rules(views.lines(synthetic.files(spark, sf_dir, synthetic.ODD)))


@query(_ODD_FOLDS)
def odd_fold_rules(spark, sf_dir):
    return _only(folds.all_folds(synthetic.files(spark, sf_dir, synthetic.ODD)), _ODD_FOLDS)


_PROJECT = [
    ("package.json", '{"dependencies": {"next": "14.0.0", "react": "18.0.0"}, "scripts": {"build": "x"}, "workspaces": ["packages/*", "gone/*"]}'),
    ("tsconfig.json", '{"compilerOptions": {"target": "es5"}}'), ("yarn.lock", ""), ("packages/a/index.ts", "export { one } from './one'\n"), ("next.config.js", "module.exports = {}"),
    ("src/locales/en.json", '{"menu": {"open": "Open", "sub": {"deep": "x"}}, "title": "T"}'), ("src/locales/de.json", '{"menu": {"open": "Auf"}}'),
]


def _project(spark, sf_dir) -> DataFrame:
    """A project for each row of part, its files below a folder of its own."""
    made = F.array(*[F.struct(F.concat(F.lit("r"), F.col("p_partkey").cast("string"), F.lit("/" + p)).alias("p"), F.lit(c).alias("c")) for p, c in _PROJECT])
    rows = parts(spark, sf_dir).select(F.explode(made).alias("x"))
    return as_files(rows, F.col("x.p"), F.col("x.c"))


@query("SELECT DISTINCT t.* FROM part, (VALUES ('framework', 'nextjs'), ('framework', 'react'), ('package-manager', 'yarn')) AS t(kind, name)")
def project_tools(spark, sf_dir):
    from corpusmill.operators.project import detect

    return detect(_project(spark, sf_dir))


@query("""SELECT 'r' || p_partkey || '/' || path AS path, rule, severity, 1 AS line, 1 AS col, message FROM part, (VALUES ('tsconfig.json', 'config-lint/tsconfig-strict', 'warning', ''), ('tsconfig.json', 'config-lint/tsconfig-target', 'info', 'es5'), ('package.json', 'config-lint/missing-eslint', 'info', ''),
('package.json', 'config-lint/missing-prettier', 'info', ''), ('package.json', 'config-lint/missing-editorconfig', 'info', ''), ('package.json', 'config-lint/package-json-scripts', 'info', 'test,lint'), ('next.config.js', 'config-lint/next-config', 'info', ''), ('package.json', 'ast-slop/workspace-misconfig', 'warning', 'gone/*')) AS t(path, rule, severity, message)""")
def config_rules(spark, sf_dir):
    from corpusmill.operators.project import config_lint

    return config_lint(_project(spark, sf_dir)).unionByName(relations.workspaces(_project(spark, sf_dir)))


_DEPTH = 20


@query(f"""SELECT locale, name FROM (SELECT 'en' AS locale, '{'k.' * _DEPTH}p' || p_partkey AS name FROM part UNION ALL SELECT 'en', 'p' || p_partkey || '.flat' FROM part
UNION ALL SELECT 'en', 'p' || p_partkey || '.text' FROM part UNION ALL SELECT 'de', 'p' || p_partkey || '.flat' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'de', 'p' || p_partkey || '.list' FROM part WHERE p_partkey % 2 = 0)""")
def locale_key_rows(spark, sf_dir):
    """Keys of locale files made from part, 20 levels deep; a text that looks like JSON is a leaf."""
    from corpusmill.operators.project import locale_keys

    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    deep = text("{" + '"k": {' * _DEPTH + '"', key, '": "{x}"' + "}" * _DEPTH + ', "', key, '": {"flat": "A", "text": "{\\"b\\": {}}", "none": {}}}')
    flat = text('{"', key, '": {"flat": "B", "list": [{"x": 1}]}}')
    part = parts(spark, sf_dir)
    rows = part.select(text("app/", key, "/locales/en.json").alias("p"), deep.alias("c")).unionByName(part.filter("p_partkey % 2 = 0").select(text("app/", key, "/locales/de.json").alias("p"), flat.alias("c")))
    rows = rows.unionByName(part.filter("p_partkey % 7 = 0").select(text("app/", key, "/locales/fr.json").alias("p"), F.lit('{"broken": ').alias("c")))
    return locale_keys(as_files(rows, F.col("p"), F.col("c")))


@query(f"WITH {FOUND} SELECT f.* FROM found f JOIN part ON f.path = 'src/api/f' || p_partkey || '.ts' AND p_partkey % {len(synthetic.SNIPPETS)} = 1 WHERE f.line BETWEEN 5 AND 7 OR f.line BETWEEN 12 AND 13 OR f.line = 16")
def changed_findings(spark, sf_dir):
    """Findings on lines that diffs (made from part) add."""
    from corpusmill.sources import diffs

    path = F.concat(F.lit("src/api/f"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    body = "@@ -4,3 +4,5 @@ x\n y\n+a\n+++ b/src/not/a/header.ts\n+c\n-d\n-e\n y\n@@ -10,2 +11,3 @@\n y\n-z\n+z\n+z\n@@ -15 +16 @@\n-q\n+q\n\\ No newline at end of file\n"
    diff = F.concat(F.lit("diff --git a/x b/x\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n" + body))
    rows = parts(spark, sf_dir).filter(F.col("p_partkey") % len(synthetic.SNIPPETS) == 1).select(diff.alias("diff"))
    return diffs.in_ranges(found(spark, sf_dir), diffs.ranges(rows))


@query("SELECT event_type AS engine, count(*) AS n, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, round(sum(value), 4) AS total_ms FROM events GROUP BY 1")
def engine_timings(spark, sf_dir):
    from corpusmill.plans.scan import timings

    rows = timings(table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("value").alias("ms")))
    return rows.withColumn("avg_ms", F.round("avg_ms", 6)).withColumn("total_ms", F.round("total_ms", 4))


@query()
def similar_blocks(spark, sf_dir):
    return relations.similar_blocks(relations.blocks(doc_files(spark, sf_dir), most_lines=None))


@query("SELECT 1.0::DOUBLE * count(DISTINCT l) FILTER (l IN ('typescript', 'python')) / count(DISTINCT l) AS share, count(DISTINCT l) FILTER (l IN ('typescript', 'python')) / count(DISTINCT l) >= 0.3 AS covered FROM (SELECT lang AS l FROM (" + f"WITH {SYN} SELECT lang FROM files" + "))")
def language_coverage(spark, sf_dir):
    return P.coverage(synthetic.files(spark, sf_dir), ("typescript", "python"))


_OTHER_TOOLS = {
    "ruff": '[{"code": "F401", "message": "unused", "filename": "a$K.py", "location": {"row": 2, "column": 3}}, {"code": "W291", "message": "space", "filename": "b$K.py", "location": {"row": 1, "column": 9}}]',
    "pip_audit": '{"dependencies": [{"name": "pkg$K", "version": "1", "vulns": [{"id": "V-1", "fix_versions": []}, {"id": "V-2", "fix_versions": []}]}]}',
    "cargo_audit": '{"vulnerabilities": {"list": [{"advisory": {"id": "R-$K", "title": "t"}, "package": {"name": "c", "version": "1"}}]}}',
    "govulncheck": '{"finding": {"osv": "GO-$K", "fixed_version": "v2"}}',
    "npm_audit": '{"vulnerabilities": {"a": {"name": "a$K", "severity": "high", "range": "<1"}, "b": {"name": "b$K", "severity": "low", "range": "<2"}}}',
}


@query("""SELECT replace(path, '$K', p_partkey::VARCHAR) AS path, rule, severity, line::INT AS line, col::INT AS col, replace(message, '$K', p_partkey::VARCHAR) AS message FROM part, (VALUES ('a$K.py', 'lint-external/ruff/F401', 'error', 2, 3, 'unused'), ('b$K.py', 'lint-external/ruff/W291', 'warning', 1, 9, 'space'),
('requirements.txt', 'security-deep/dependency-vulnerability', 'error', 1, 1, 'pkg$K V-1'), ('requirements.txt', 'security-deep/dependency-vulnerability', 'error', 1, 1, 'pkg$K V-2'), ('Cargo.toml', 'security-deep/dependency-vulnerability', 'error', 1, 1, 'c R-$K'),
('go.mod', 'security-deep/dependency-vulnerability', 'error', 1, 1, 'GO-$K'), ('package.json', 'security-deep/dependency-vulnerability', 'error', 1, 1, 'a$K <1'), ('package.json', 'security-deep/dependency-vulnerability', 'info', 1, 1, 'b$K <2')) AS t(path, rule, severity, line, col, message)""")
def other_tools(spark, sf_dir):
    part = parts(spark, sf_dir)
    rows = [getattr(reports, name)(part.select(F.replace(F.lit(text), F.lit("$K"), F.col("p_partkey").cast("string")).alias("json"))) for name, text in _OTHER_TOOLS.items()]
    out_ = rows[0]
    for r in rows[1:]:
        out_ = out_.unionByName(r)
    return out_
