"""Detectors that look at neighbouring lines, whole files, or running state, with window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusmill.functions.text import extract, matches, trim_all

def _by_file() -> WindowSpec:
    return Window.partitionBy("path").orderBy("num")


def _found(rows: DataFrame, rule: str, severity: str, message: Column | None = None, line: str = "num") -> DataFrame:
    return rows.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(line).cast("int").alias("line"), F.lit(1).alias("col"), (message if message is not None else F.lit("")).cast("string").alias("message"))


def blank_line_cluster(lines: DataFrame, least: int = 3) -> DataFrame:
    """Runs of blank lines: gaps and islands."""
    blank = lines.filter(trim_all(F.col("text")) == "").withColumn("island", F.col("num") - F.row_number().over(_by_file()))
    runs = blank.groupBy("path", "island").agg(F.min("num").alias("num"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return _found(runs, "format-lint/blank-line-cluster", "suggestion", F.col("n"))


def missing_final_newline(files: DataFrame) -> DataFrame:
    rows = files.filter((F.length("content") > 0) & ~F.endswith("content", F.lit("\n"))).withColumn("num", F.regexp_count("content", F.lit("\n")) + 1)
    return _found(rows, "syntax-deep/missing-final-newline", "info")


def line_endings(lines: DataFrame) -> DataFrame:
    """Files with CR LF: mixed if lone line feeds outnumber them, at the first CR."""
    has = F.endswith("text", F.lit("\r"))
    by = lines.groupBy("path").agg(F.count(F.when(has, 1)).alias("crlf"), (F.count("*") - 1).alias("all"), F.min(F.when(has, F.col("num"))).alias("num")).filter("crlf > 0")
    rows = by.withColumn("mixed", F.col("all") - F.col("crlf") > F.col("crlf"))
    return _found(rows.filter("mixed"), "syntax-deep/mixed-line-endings", "warning").unionByName(_found(rows.filter("NOT mixed"), "syntax-deep/crlf-line-endings", "warning"))


def marks(files: DataFrame) -> DataFrame:
    """Zero-width no-break spaces behind the start of a file."""
    rows = files.withColumn("at", F.instr("content", "﻿")).filter("at > 0").withColumn("num", F.regexp_count(F.expr("substring(content, 1, at)"), F.lit("\n")) + 1)
    return _found(rows, "syntax-deep/zwnbsp-mid-file", "warning")


def vote(lines: DataFrame, rule: str, severity: str, one: Column, other: Column, first: int = 5) -> DataFrame:
    """Majority vote of a file between two styles; the first lines of the minority. On a tie ``one`` is the minority."""
    marked = lines.withColumn("side", F.when(one, 1).when(other, 2)).filter("side IS NOT NULL")
    counts = marked.groupBy("path").agg(F.count(F.when(F.col("side") == 1, 1)).alias("n1"), F.count(F.when(F.col("side") == 2, 1)).alias("n2")).filter("n1 > 0 AND n2 > 0")
    minority = F.when(F.col("n1") <= F.col("n2"), 1).otherwise(2)
    rows = marked.join(counts.withColumn("minor", minority).select("path", "minor"), "path").filter("side = minor")
    return _found(rows.withColumn("r", F.row_number().over(_by_file())).filter(F.col("r") <= first), rule, severity)


INDENT_SPACE, INDENT_TAB = r"^ {2,}\S", r"^\t+\S"
QUOTE_ONE, QUOTE_TWO = r"^[^'\"]*'[^'\"]*'[^'\"]*\z", r"^[^'\"]*\"[^'\"]*\"[^'\"]*\z"
SEMI, NO_SEMI = r";\s*\z", r"^\s*(?:const|let|var|return|this\.|[a-zA-Z_$][\w$]*\s*(?:=[^>=]|\()).*[^;{(\[,\s]\s*\z"
COMMA, NO_COMMA = r"^\s+[\w'\"].*,\s*\z", r"^\s+[\w'\"]+\s*:\s*[^,;{(\[]+\z"


def styles(lines: DataFrame) -> DataFrame:
    js = lines.filter(F.col("lang").isin("typescript", "javascript"))
    m = lambda p: matches(F.col("text"), p)
    out = vote(lines, "format-lint/inconsistent-indent", "warning", m(INDENT_SPACE), m(INDENT_TAB))
    out = out.unionByName(vote(js, "format-lint/inconsistent-quotes", "info", m(QUOTE_ONE), m(QUOTE_TWO)))
    out = out.unionByName(vote(js, "format-lint/inconsistent-semicolons", "info", m(SEMI), m(NO_SEMI)))
    # a comma behind the last entry, against none: the next line closes
    close = F.lead("text").over(_by_file())
    last = js.withColumn("closes", F.coalesce(matches(close, r"^\s*[}\]]"), F.lit(False))).filter("closes").drop("closes")
    return out.unionByName(vote(last, "format-lint/trailing-comma-inconsistency", "info", m(COMMA), m(NO_COMMA)))


def indent_styles(lines: DataFrame) -> DataFrame:
    """Files without lines that mix tabs and spaces, but with lines of either."""
    t = F.col("text")
    by = lines.groupBy("path").agg(F.count(F.when(matches(t, r"^(?: +\t|\t+ )"), 1)).alias("both"), F.min(F.when(matches(t, r"^\t"), F.col("num"))).alias("tab"), F.min(F.when(matches(t, r"^ "), F.col("num"))).alias("space"))
    rows = by.filter("both = 0 AND tab IS NOT NULL AND space IS NOT NULL").withColumn("num", F.greatest("tab", "space"))
    return _found(rows, "syntax-deep/inconsistent-indent-style", "info")


def trivial_comment(lines: DataFrame) -> DataFrame:
    """Comments most of whose words (at least two, and 60%) the next line of code holds."""
    text, after = F.col("text"), F.lead("text").over(_by_file())
    body = F.lower(extract(text, r"^\s*(?://|#)\s*(.*)\z", 1))
    body = F.regexp_replace(body, r"^(?:set|get|create|update|delete|add|remove|check|return|call|initialize|define|increment|loop)\s+(?:the\s+|a\s+|an\s+)?", "")
    words = F.filter(F.split(F.regexp_replace(body, r"[^a-z0-9_ ]", ""), " +"), lambda w: F.length(w) > 2)
    rows = lines.withColumn("after", F.lower(after)).withColumn("words", words).filter("size(words) > 0 AND after IS NOT NULL").filter(~matches(F.col("after"), r"^\s*(?://|#|\z)"))
    rows = rows.withColumn("hits", F.size(F.filter("words", lambda w: F.contains(F.col("after"), w)))).filter("hits >= 2 AND hits >= 0.6 * size(words)")
    return _found(rows, "ast-slop/trivial-comment", "suggestion", F.trim(text))


CATCH_EMPTY, CATCH_OPEN = r"catch\s*(?:\(\s*\w+\s*\))?\s*\{\s*\}\s*\z", r"catch\s*(?:\(\s*\w+\s*\))?\s*\{\s*\z"
EXCEPT = r"^\s*except\s*(?:\w+(?:\s+as\s+\w+)?)?\s*:"


def swallowed(lines: DataFrame, js_reach: int = 4, py_reach: int = 2) -> DataFrame:
    """Exceptions that are caught and dropped.

    Python: of the lines behind an except, within reach, the first that is neither blank nor a comment is pass or an
    ellipsis. Elsewhere: an empty catch, or one whose next line, blank ones and comments aside, closes it within reach.
    """
    near = F.collect_list("text").over(_by_file().rowsBetween(1, js_reach))
    t, py = F.col("text"), F.col("lang") == "python"
    rows = lines.withColumn("near", near).filter(F.contains(t, F.lit("catch")) | F.contains(t, F.lit("except")))
    first = lambda n, comment: F.try_element_at(F.filter(F.slice("near", 1, n), lambda x: ~matches(x, rf"^\s*(?:{comment}|\z)")), F.lit(1))
    dropped = py & matches(t, EXCEPT) & F.coalesce(matches(first(py_reach, "#"), r"^\s*(?:pass|\.\.\.)\s*\z"), F.lit(False))
    closed = matches(t, CATCH_OPEN) & F.coalesce(matches(first(js_reach, "//"), r"^\s*\}\s*\z"), F.lit(False))
    return _found(rows.filter(dropped | (~py & (matches(t, CATCH_EMPTY) | closed))), "ast-slop/swallowed-exception", "info")


def first_body_line(lines: DataFrame) -> DataFrame:
    """Python stubs (a body of pass or ...) and public definitions without a docstring."""
    t, after = F.col("text"), F.coalesce(F.lead("text").over(_by_file()), F.lit(""))
    rows = lines.filter("lang = 'python'").withColumn("after", after).withColumn("name", extract(t, r"^\s*(?:def|class)\s+([A-Za-z_]\w*).*:\s*(?:#.*)?\z", 1)).filter("name <> ''")
    stub = _found(rows.filter(matches(F.col("after"), r"^\s*(?:pass|\.\.\.)\s*(?:#.*)?\z")), "python-deep/pass-stub", "warning", F.col("name"))
    bare = rows.filter(~F.startswith("name", F.lit("_")) & ~matches(F.col("after"), r"^\s*(?:r|u|b|br|rb)?(?:\"|')"))
    return stub.unionByName(_found(bare, "python-deep/missing-docstring", "suggestion", F.col("name")))


def undocumented(lines: DataFrame) -> DataFrame:
    """Go: exported declarations whose line before is no comment that starts with their name. Rust: unsafe without SAFETY."""
    before = F.coalesce(F.lag("text").over(_by_file()), F.lit(""))
    rows = lines.withColumn("before", before).withColumn("name", extract(F.col("text"), r"^(?:func|type|var|const)\s+(?:\([^)]*\)\s*)?([A-Z]\w*)", 1))
    go = rows.filter("lang = 'go' AND name <> ''").filter(~F.startswith("before", F.concat(F.lit("// "), F.col("name"))))
    rust = rows.filter("lang = 'rust'").filter(matches(F.col("text"), r"\bunsafe\s*\{") & ~matches(F.col("before"), r"(?i)(?://|/\*)\s*SAFETY[:\s]"))
    return _found(go, "go-deep/exported-no-doc", "warning", F.col("name")).unionByName(_found(rust, "rust-deep/unsafe-usage", "error"))


# Calls that query a database, in their order.
ORM_CALLS = [
    r"\.\s*findFirst\s*\(", r"\.\s*findMany\s*\(", r"\.\s*findUnique\s*\(", r"\.\s*create\s*\(", r"\.\s*update\s*\(", r"\.\s*delete\s*\(", r"\.\s*upsert\s*\(",
    r"\.\s*query\s*\(", r"\.\s*execute\s*\(", r"prisma\.", r"drizzle\.", r"\.\s*select\s*\(", r"\.\s*from\s*\(", r"\.\s*where\s*\(", r"db\.\s*\(",
]


def as_any_context(lines: DataFrame, reach: int = 5) -> DataFrame:
    """`as any`, named by the first context that its line or the lines around it show."""
    near = F.concat_ws("\n", F.collect_list("text").over(_by_file().rowsBetween(-reach, reach)))
    t = F.col("text")
    rows = lines.filter("lang = 'typescript'").withColumn("near", near).filter(matches(t, r"\bas\s+any\b"))
    orm = matches(F.col("near"), "|".join(ORM_CALLS))
    rule = F.when(orm, "types/as-any-orm").when(matches(t, r"\b(?:window|document|navigator|globalThis)\b"), "types/as-any-window").when(matches(F.col("near"), r"JSON\.parse\s*\("), "types/as-any-json-parse").when(matches(t, r"(?:param|arg|option|config|ctx|event)\w*\s*:\s*any"), "types/as-any-param").otherwise("types/as-any")
    rows = rows.withColumn("rule", rule)
    return rows.select("path", "rule", F.when(F.col("rule") == "types/as-any-orm", "suggestion").otherwise("warning").alias("severity"), F.col("num").cast("int").alias("line"), F.lit(1).alias("col"), F.lit("").alias("message"))


def nesting(lines: DataFrame, opens: str = r"\{", closes: str = r"\}") -> DataFrame:
    """path, num, depth behind each line, never under 0: a running sum, raised by how far it has been under 0."""
    step = F.regexp_count("text", F.lit(opens)) - F.regexp_count("text", F.lit(closes))
    run = _by_file().rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("step", F.when(matches(F.col("text"), r"^\s*(?://|\*|/\*)"), 0).otherwise(step)).withColumn("sum", F.sum("step").over(run))
    return rows.withColumn("depth", (F.col("sum") - F.least(F.lit(0), F.min("sum").over(run))).cast("int")).drop("step", "sum")


def deep_nesting(lines: DataFrame, most: int = 4, rule: str = "arch-constraints/deep-nesting", langs: tuple[str, ...] = ("typescript", "javascript", "go", "rust"), opens: str = r"\{", closes: str = r"\}") -> DataFrame:
    """Files whose deepest line is nested more than ``most`` deep, at the first such line."""
    deep = nesting(lines.filter(F.col("lang").isin(*langs)), opens, closes).groupBy("path").agg(F.max("depth").alias("depth"), F.max_by("num", F.struct("depth", -F.col("num"))).alias("num"))
    return _found(deep.filter(F.col("depth") > most), rule, "warning", F.col("depth"))


def god_file(files: DataFrame, most_lines: int = 300, most_exports: int = 5) -> DataFrame:
    """Long files with many exports; .tsx may be half as long again, declaration files have no limit."""
    limit = F.when(F.col("path").rlike(r"\.tsx\z"), most_lines * 1.5).otherwise(most_lines * 1.0)
    exports = F.regexp_count("content", F.lit(r"(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:function|const|let|var|class|interface|type|enum)\s"))
    n = F.regexp_count("content", F.lit("\n")) + 1
    rows = files.filter(F.col("lang").isin("typescript", "javascript") & ~F.col("path").rlike(r"\.d\.ts\z")).withColumn("n", n).withColumn("num", F.lit(1)).filter((n > limit) & (exports > most_exports))
    return _found(rows, "arch-constraints/god-file", "warning", F.col("n"))


# What only runs in a browser, and what of it needs the mark, in their order.
CLIENT_NAMES = [
    "useState", "useEffect", "useRef", "useCallback", "useMemo", "useReducer", "useContext", "useLayoutEffect", "useSyncExternalStore", "onClick", "onChange", "onSubmit", "onKeyDown",
    "onMouseOver", "onFocus", "onBlur", "onInput", "addEventListener", "window", "document", "localStorage", "sessionStorage", "fetch", "IntersectionObserver", "ResizeObserver",
    "MutationObserver",
]
CLIENT_HOOKS = ["useState", "useEffect", "useRef", "useCallback", "useMemo", "useReducer", "useLayoutEffect"]
CLIENT_EVENTS = ["onClick", "onChange", "onSubmit", "onKeyDown"]


def next_client(files: DataFrame) -> DataFrame:
    """Files for the client marked without need, not marked in need, or marked while they export metadata."""
    c = F.col("content")
    marked = matches(c, r"^\s*['\"]use client['\"]")
    uses = matches(c, r"\b(?:" + "|".join(CLIENT_NAMES) + r")\b")
    needs = matches(c, r"\b(?:" + "|".join(CLIENT_HOOKS) + r")\b|\b(?:" + "|".join(CLIENT_EVENTS) + r")\s*=")
    meta = matches(c, r"\bexport\s+(?:const\s+(?:metadata|generateMetadata)|(?:async\s+)?function\s+generateMetadata)\b")
    rows = files.filter(F.col("lang").isin("typescript", "javascript")).withColumn("num", F.lit(1))
    out = _found(rows.filter(marked & ~uses), "nextjs/misplaced-use-client", "warning")
    out = out.unionByName(_found(rows.filter(~marked & needs & F.col("ext").isin("tsx", "jsx")), "nextjs/missing-use-client", "error"))
    return out.unionByName(_found(rows.filter(marked & meta), "nextjs/metadata-in-client", "error"))


def tags(files: DataFrame) -> DataFrame:
    """Components of a page that lack what they need: dimensions of an image, words for a link."""
    rows = files.filter(F.col("lang").isin("typescript", "javascript")).withColumn("num", F.lit(1))
    image = rows.select("*", F.explode(F.regexp_extract_all("content", F.lit(r"(<Image\b[^>]*>)"), 1)).alias("tag"))
    image = image.filter(~matches(F.col("tag"), r"\bfill\b") & ~(matches(F.col("tag"), r"\bwidth\s*=") & matches(F.col("tag"), r"\bheight\s*=")))
    link = rows.select("*", F.explode(F.regexp_extract_all("content", F.lit(r"(<Link\b[^>]*>\s*</Link>)"), 1)).alias("tag")).filter(~matches(F.col("tag"), r"\baria-label\s*="))
    return _found(image, "nextjs/image-missing-dimensions", "warning", F.col("tag")).unionByName(_found(link, "nextjs/link-without-aria", "suggestion", F.col("tag")))


def class_lists(lines: DataFrame, most: int = 15) -> DataFrame:
    """className lists that are long, that say a thing twice, or that make a flex box without alignment."""
    list_ = extract(F.col("text"), r"className\s*=\s*[\"'`]([^\"'`]+)[\"'`]", 1)
    rows = lines.withColumn("classes", F.filter(F.split(list_, r"\s+"), lambda c: c != "")).filter("size(classes) > 0")
    long = rows.filter(F.size("classes") >= most)
    bare = F.transform("classes", lambda c: F.regexp_replace(c, r"^(?:sm|md|lg|xl|2xl|hover|focus|active|disabled|dark):", ""))
    kinds = F.filter(F.transform(bare, lambda c: F.regexp_extract(c, r"^(p|px|py|pt|pb|pl|pr|m|mx|my|mt|mb|ml|mr|w|h|gap|rounded|z|opacity)-", 1)), lambda k: k != "")
    twice = rows.withColumn("kinds", kinds).filter(F.size("kinds") > F.size(F.array_distinct("kinds")))
    flex = rows.filter(F.array_contains("classes", "flex") & ~F.exists("classes", lambda c: c.startswith("items-") | c.startswith("justify-")))
    out = _found(long, "tailwind/overloaded-classname", "suggestion", F.size("classes"))
    return out.unionByName(_found(twice, "tailwind/duplicate-utilities", "warning")).unionByName(_found(flex, "tailwind/incomplete-flex", "info"))


def css_blocks(lines: DataFrame, most_important: int = 3) -> DataFrame:
    """Style sheets: properties repeated in a rule block, and files with much !important."""
    css = lines.filter("lang = 'css'")
    block = F.sum(F.when(F.contains("text", F.lit("{")), 1).otherwise(0)).over(_by_file().rowsBetween(Window.unboundedPreceding, 0))
    props = css.withColumn("block", block).withColumn("prop", extract(F.col("text"), r"^\s*([a-z-]+)\s*:", 1)).filter("prop <> ''")
    again = props.withColumn("r", F.row_number().over(Window.partitionBy("path", "block", "prop").orderBy("num"))).filter("r > 1")
    many = css.filter(matches(F.col("text"), r"(?i)!important\b")).groupBy("path").agg(F.count("*").alias("n"), F.min("num").alias("num")).filter(F.col("n") > most_important)
    return _found(again, "css/duplicate-property", "warning", F.col("prop")).unionByName(_found(many, "css/important-overuse", "warning", F.col("n")))


def headings(lines: DataFrame) -> DataFrame:
    """Underlined headings in documents that also have marked ones."""
    md = lines.filter("lang = 'markdown'").withColumn("after", F.coalesce(F.lead("text").over(_by_file()), F.lit("")))
    atx = matches(F.col("text"), r"^\s*#{1,6}\s")
    under = ~atx & matches(F.col("text"), r"\S") & matches(F.col("after"), r"^\s*(?:=+|-+)\s*\z")
    has = md.groupBy("path").agg(F.bool_or(atx).alias("atx")).filter("atx")
    return _found(md.filter(under).join(has, "path", "left_semi"), "md/inconsistent-heading", "info")


def first_marks(lines: DataFrame, first: int = 10) -> DataFrame:
    rows = lines.filter("lang = 'markdown'").filter(matches(F.col("text"), r"\b(?:TODO|FIXME|HACK|XXX)\b")).withColumn("r", F.row_number().over(_by_file()))
    return _found(rows.filter(F.col("r") <= first), "md/todo-in-doc", "info")


def json_lines(lines: DataFrame) -> DataFrame:
    """Commas before a closing bracket; and entries on one line where others stand alone."""
    js = lines.filter("lang = 'json'")
    filled = js.filter(matches(F.col("text"), r"\S")).withColumn("after", F.lead("text").over(_by_file()))
    comma = filled.filter(matches(F.col("text"), r",\s*\z") & matches(F.col("after"), r"^\s*[}\]]"))
    compact, single = matches(F.col("text"), r"^\s*\"[^\"]+\"\s*:\s*[^,]+,\s*\"[^\"]+\"\s*:"), matches(F.col("text"), r"^\s*\"[^\"]+\"\s*:\s*[^,]+\s*,?\s*\z")
    mixed = js.groupBy("path").agg(F.count(F.when(compact, 1)).alias("c"), F.count(F.when(single & ~compact, 1)).alias("s")).filter("c >= 2 AND s >= 2")
    return _found(comma, "json/trailing-comma", "error").unionByName(_found(js.filter(compact).join(mixed, "path", "left_semi"), "json/inconsistent-spacing", "info"))


def yaml_files(lines: DataFrame) -> DataFrame:
    """Anchors with three aliases or more; many top keys in groups without a document mark."""
    y = lines.filter("lang = 'yaml'")
    anchors = y.withColumn("name", extract(F.col("text"), r"&(\w+)", 1)).filter("name <> ''").groupBy("path", "name").agg(F.min("num").alias("num"))
    uses = y.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\*(\w+)"), 1)).alias("name")).groupBy("path", "name").agg(F.count("*").alias("n")).filter("n >= 3")
    top = y.filter(matches(F.col("text"), r"^[A-Za-z_][\w-]*\s*:")).withColumn("gap", F.col("num") - F.lag("num").over(_by_file()))
    parts = top.groupBy("path").agg(F.count("*").alias("n"), F.count(F.when(F.col("gap") > 2, 1)).alias("gaps"), F.min("num").alias("num")).filter("n >= 4 AND gaps >= 2")
    marked = y.filter(matches(F.col("text"), r"^---")).select("path").distinct()
    return _found(anchors.join(uses, ["path", "name"]), "yaml/complex-anchor", "info", F.col("name")).unionByName(_found(parts.join(marked, "path", "left_anti"), "yaml/multi-doc-unseparated", "warning"))


def unused_variable(lines: DataFrame) -> DataFrame:
    """Declared names that stand once in their file; exported ones, ones with _ and components are exempt."""
    js = lines.filter(F.col("lang").isin("typescript", "javascript"))
    names = js.withColumn("name", extract(F.col("text"), r"^\s*(?:const|let|var)\s+(\w+)", 1)).filter("name <> '' AND NOT startswith(name, '_')")
    names = names.filter(~(matches(F.col("name"), r"^[A-Z]") & matches(F.col("text"), r"=>|function"))).select("path", "num", "name")
    seen = js.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name")).groupBy("path", "name").agg(F.count("*").alias("n")).filter("n <= 1")
    return _found(names.join(seen, ["path", "name"], "left_semi"), "dead-flow/unused-variable", "suggestion", F.col("name"))


def unreachable(lines: DataFrame) -> DataFrame:
    """A statement behind a return, throw, break or continue at the same depth, in the same block."""
    rows = nesting(lines.filter(F.col("lang").isin("typescript", "javascript"))).filter(matches(F.col("text"), r"\S") & ~matches(F.col("text"), r"^\s*(?://|\*|/\*)"))
    before, depth = F.lag("text").over(_by_file()), F.lag("depth").over(_by_file())
    ended = matches(before, r"^\s*(?:return\b[^({\[]*;|throw\b.*;|break\s*;|continue\s*;)\s*\z")
    live = matches(F.col("text"), r"^\s*(?:[})\]]|case\b|default\b|else\b|catch\b|finally\b|function\b|export\b)")
    hit = rows.withColumn("hit", ended & (depth == F.col("depth")) & ~live & ~matches(F.lag("text", 2, "").over(_by_file()), r"^\s*(?:if|for|while|else)\b[^{]*\z")).withColumn("soft", matches(before, r"^\s*return\b")).filter("hit")
    rule = "dead-flow/unreachable-after-terminator"
    return _found(hit.filter("soft"), rule, "warning").unionByName(_found(hit.filter("NOT soft"), rule, "error"))


def all_rules(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every detector of this module as one relation."""
    by_line = [blank_line_cluster, line_endings, styles, indent_styles, trivial_comment, swallowed, first_body_line, undocumented, as_any_context, deep_nesting, class_lists, css_blocks, headings, first_marks, json_lines, yaml_files, unused_variable, unreachable]
    out = deep_nesting(lines, 5, "json/deep-nesting", ("json",), r"[{\[]", r"[}\]]")
    for detector in by_line:
        out = out.unionByName(detector(lines))
    for detector in (missing_final_newline, marks, god_file, next_client, tags):
        out = out.unionByName(detector(files))
    return out


def console_leftover(lines: DataFrame) -> DataFrame:
    """Printing left in code: not in tests, not in a catch block close by, not below a main guard."""
    t = F.col("text")
    near = F.concat_ws("\n", F.collect_list("text").over(_by_file().rowsBetween(-5, -1)))
    rows = lines.withColumn("near", near).filter(~matches(F.col("path"), r"(?:\.(?:test|spec)\.[a-z]+\z|(?:^|/)(?:tests?|__tests__)/)"))
    caught = matches(F.col("near"), r"catch\s*(?:\([^)]*\))?\s*\{[^}]*\z")
    js = F.col("lang").isin("typescript", "javascript") & matches(t, r"console\.(?:log|debug)\s*\(") & ~caught
    py = (F.col("lang") == "python") & matches(t, r"^\s*print\s*\(") & ~F.contains("near", F.lit("if __name__"))
    return _found(rows.filter(js | py), "ast-slop/console-leftover", "suggestion")


def silent_recovery(lines: DataFrame, reach: int = 7) -> DataFrame:
    """Catches whose next lines, up to the one that closes, hold neither code nor comment."""
    after = F.collect_list("text").over(_by_file().rowsBetween(1, reach))
    rows = lines.filter(F.col("lang").isin("typescript", "javascript", "go", "rust")).withColumn("after", after).filter(matches(F.col("text"), r"catch\s*(?:\([^)]*\))?\s*\{\s*\z"))
    first = F.element_at(F.filter("after", lambda x: matches(x, r"\S")), 1)
    rows = rows.withColumn("first", F.when(F.size(F.filter("after", lambda x: matches(x, r"\S"))) > 0, first))
    return _found(rows.filter(matches(F.col("first"), r"^\s*\}")), "ast-slop/silent-recovery", "info")


def placeholder_impl(lines: DataFrame) -> DataFrame:
    """Functions with a marker and a stub of a return in their first lines."""
    near = F.concat_ws("\n", F.collect_list("text").over(_by_file().rowsBetween(1, 9)))
    rows = lines.withColumn("near", near).filter(matches(F.col("text"), r"(?:\bfunction\s+\w+\s*\(|=>\s*\{\s*\z|^\s*def\s+\w+)"))
    hit = matches(F.col("near"), r"(?i)(?://|#)\s*(?:TODO|FIXME|implement)") & matches(F.col("near"), r"(?m)^\s*(?:return\s+(?:null|None|undefined|\[\]|\{\}|''|\"\"|0|false|False)?\s*;?|pass|throw new Error\(.*not implemented.*)\s*$")
    return _found(rows.filter(hit), "ast-slop/placeholder-impl", "warning")


def overdefensive_type(lines: DataFrame) -> DataFrame:
    """typeof tests of a variable against the type that it is declared with; the last declaration counts."""
    ts = lines.filter("lang = 'typescript'")
    declared = ts.withColumn("name", extract(F.col("text"), r"\b(\w+)\s*:\s*(?:string|number|boolean)\b", 1)).withColumn("type", extract(F.col("text"), r"\b\w+\s*:\s*(string|number|boolean)\b", 1)).filter("name <> ''").filter(~matches(F.col("text"), r":\s*\w+\s*\|"))
    declared = declared.groupBy("path", "name").agg(F.max_by("type", "num").alias("type"))
    tests = ts.withColumn("name", extract(F.col("text"), r"typeof\s+(\w+)\s*[!=]==?\s*['\"]\w+['\"]", 1)).withColumn("type", extract(F.col("text"), r"typeof\s+\w+\s*[!=]==?\s*['\"](\w+)['\"]", 1)).filter("name <> ''")
    return _found(tests.join(declared, ["path", "name", "type"], "left_semi"), "ast-slop/overdefensive-type", "info", F.col("name"))


def unnecessary_abstraction(lines: DataFrame) -> DataFrame:
    """Interfaces with one implementor and abstract classes with one subclass in their file."""
    ts = lines.filter("lang = 'typescript'")
    made = ts.withColumn("name", extract(F.col("text"), r"\b(?:interface|abstract\s+class)\s+(\w+)", 1)).filter("name <> ''")
    used = ts.select("path", F.explode(F.concat(F.regexp_extract_all("text", F.lit(r"\bimplements\s+(\w+)"), 1), F.regexp_extract_all("text", F.lit(r"\bclass\s+\w+\s+extends\s+(\w+)"), 1))).alias("name")).groupBy("path", "name").agg(F.count("*").alias("n")).filter("n = 1")
    return _found(made.join(used, ["path", "name"], "left_semi"), "ast-slop/unnecessary-abstraction", "info", F.col("name"))


def both_branches_end(lines: DataFrame) -> DataFrame:
    """Statements behind an if and an else whose last statements both end the function, at the depth of the if.

    Blocks may be of any length: of each depth, the last statement inside the block that closes is carried along.
    """
    rows = nesting(lines.filter(F.col("lang").isin("typescript", "javascript"))).filter(matches(F.col("text"), r"\S") & ~matches(F.col("text"), r"^\s*(?://|\*|/\*)"))
    before = F.lag("text", 1, "").over(_by_file())
    rows = rows.withColumn("ends", matches(before, r"^\s*(?:return\b.*|throw\b.*);?\s*\z"))
    # Inside: the depth of the block that a line closes or parts.
    inside = F.col("depth") + F.when(matches(F.col("text"), r"^\s*\}\s*else\s*\{\s*\z"), 0).otherwise(1)
    marks = F.when(matches(F.col("text"), r"^\s*if\s*\(.*\)\s*\{\s*\z"), "if").when(matches(F.col("text"), r"^\s*\}\s*else\s*\{\s*\z"), F.when(F.col("ends"), "else")).when(matches(F.col("text"), r"^\s*\}\s*\z"), F.when(F.col("ends"), "end"))
    rows = rows.withColumn("mark", marks).withColumn("level", F.when(F.col("mark").isin("if", "else"), F.col("depth")).otherwise(inside))
    # Of one level, the lines that open, part and close blocks, in order; a statement behind the close comes next.
    edges = rows.filter(matches(F.col("text"), r"[{}]")).withColumn("kind", F.coalesce("mark", F.lit("other")))
    own = Window.partitionBy("path", "level").orderBy("num")
    shut = edges.withColumn("before1", F.lag("kind", 1, "").over(own)).withColumn("before2", F.lag("kind", 2, "").over(own)).filter("kind = 'end' AND before1 = 'else' AND before2 = 'if'").select("path", F.col("num").alias("at"))
    nxt = rows.withColumn("at", F.lag("num").over(_by_file()))
    return _found(nxt.join(shut, ["path", "at"], "left_semi").filter(~matches(F.col("text"), r"^\s*[})\]]")), "dead-flow/unreachable-after-if-else-return", "warning")


def more_rules(files: DataFrame, lines: DataFrame) -> DataFrame:
    out = console_leftover(lines)
    for detector in (silent_recovery, placeholder_impl, overdefensive_type, unnecessary_abstraction, both_branches_end):
        out = out.unionByName(detector(lines))
    return out
