"""Detectors that look at one line: a table of rules, compiled to one pass over the lines, and to SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import extract, inside_string, inside_string_sql, java, matches

JS, PY, GO, RS = ("typescript", "javascript"), ("python",), ("go",), ("rust",)
TS, HTML, CSS, MD, YAML, CODE = ("typescript",), ("html",), ("css",), ("markdown",), ("yaml",), (*JS, *PY, *GO, *RS)
LONG_LINE = 20_000
TEST_PATH = r"(?:\.(?:test|spec)\.[a-z]+\z|(?:^|/)(?:tests?|__tests__)/)"
COMMENT = r"^\s*(?://|/\*|\*|#)"


@dataclass(frozen=True)
class Rule:
    """Lines of the languages that match, unless they match ``but``, or their path matches ``off``.

    but may be several tests, each of patterns that must all match; one such test is enough.

    each: every match of a line is a finding, and ``but`` is held against the match. code: a match that begins in a
    string or literal pattern is none, and neither are lines of more than LONG_LINE characters, which tools have written.

    What follows spares lines the pattern, and changes no finding. has, also, low: a match holds one of these strings,
    one of those, and in lower case one of the last. ends: a line that matches ends so. least: it has so many
    characters. gate: it matches this quicker pattern.
    """

    id: str
    severity: str
    langs: tuple[str, ...]
    pattern: str
    but: str | tuple[tuple[str, ...], ...] = ""
    off: str = ""
    each: bool = False
    has: tuple[str, ...] = ()
    code: bool = False
    also: tuple[str, ...] = ()
    low: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    least: int = 0
    gate: str = ""


# Comments that name how code came about, in their order.
META_COMMENTS = [
    r"//\s*Generated\s+by",
    r"//\s*AI[- ]?assisted",
    r"//\s*Created\s+with\s+(?:Claude|GPT|ChatGPT|Copilot|Gemini|AI)",
    r"//\s*Auto[- ]?generated",
    r"//\s*Written\s+by\s+(?:Claude|GPT|ChatGPT|Copilot|Gemini|AI)",
    r"/\*\s*Generated\s+by",
    r"/\*\s*AI[- ]?assisted",
    r"/\*\s*Auto[- ]?generated",
    r"#\s*Generated\s+by",
    r"#\s*AI[- ]?assisted",
    r"#\s*Auto[- ]?generated",
    r"#\s*Created\s+with\s+(?:Claude|GPT|ChatGPT|Copilot|Gemini|AI)",
]
# Names that say nothing, in their order.
GENERIC_NAMES = ["var1", "var2", "var3", "temp", "tmp", "retval", "foo", "bar", "baz", "qux", "quux", "x", "y", "z", "a", "b", "c", "stuff", "thing", "something", "whatever", "misc", "obj", "itm"]
# Type parameters that are any, in their order; each counts.
GENERIC_ANY = [
    r"Array\s*<\s*any\s*>",
    r"ReadonlyArray\s*<\s*any\s*>",
    r"Promise\s*<\s*any\s*>",
    r"Record\s*<\s*[^,]+\s*,\s*any\s*>",
    r"Map\s*<\s*[^,]+\s*,\s*any\s*>",
    r"Set\s*<\s*any\s*>",
    r"Partial\s*<\s*any\s*>",
    r"Omit\s*<\s*any\s*,",
    r"Pick\s*<\s*any\s*,",
    r"ReturnType\s*<\s*any\s*>",
    r"\w+\s*<\s*any\s*>",
]
# Control and invisible characters, as ranges in their order.
UNICODE_ANOMALIES = [(0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x7F), (0x200B, 0x200B), (0x200C, 0x200D), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB)]
# Tests of lines on which such a name is in order; of a test with two patterns both must match.
GENERIC_FINE = (
    (r"\b(?:name|id)\s*=\s*[\"']",),
    (r"\b(?:function|=>|callback|handler)\b", r"\(\s*\w*\s*,?\s*\b"),
    (r"\b(?:query|params|req|request|ctx|context)\s*[.\[]\s*",),
    (r"\{\s*[^}]*\b\w+\b[^}]*\}\s*=", r"\b(?:response|res|result|axios|fetch|api)\b"),
    (r"\b(?:FormData|event|CustomEvent)\b",),
    (r"\b(?:useQuery|useMutation|useSWR|useFetch)\b",),
)

# What each rule looks for. Patterns are RE2-safe.
RULES: list[Rule] = [
    # AI patterns
    Rule("ast-slop/narrative-comment", "suggestion", JS + GO + RS, r"(?i)(?://\s*(?:Initialize|Set up|Handle|Process|Create|Update|Calculate|Check if|Define)|/\*\s*(?:We need to|This function))", has=("//", "/*")),
    Rule("ast-slop/narrative-comment", "suggestion", PY, r"(?i)(?:#\s*(?:Initialize|Set up|Handle|Process|Create|Update|Calculate|Check if|Define)|\"\"\"\s*(?:We need to|This function))", has=("#", '"""')),
    Rule("ast-slop/decorative-comment", "info", CODE, r"(?:(?://|#)\s*(?:={3,}|[─━]{3,}|\*{3,}|~{3,}|-{3,}\s*\z))", has=("//", "#")),
    Rule("ast-slop/meta-comment", "info", CODE, "(?i)(?:" + "|".join(META_COMMENTS) + ")", has=("//", "/*", "#")),
    Rule("ast-slop/todo-stub", "info", CODE, r"(?i)^\s*(?://|/\*|\*|#).*\b(?:TODO|FIXME|HACK|XXX)\b", r"(?i)(?:#\d+|@[a-zA-Z0-9_-]+|\(\d{4}-\d{2}-\d{2}\)|https?://|TODO/FIXME)", has=("//", "*", "#"), low=("todo", "fixme", "hack", "xxx")),
    Rule("ast-slop/generic-name", "suggestion", (*JS, *GO, *RS), r"(?:const|let|var)\s+(?:" + "|".join(GENERIC_NAMES) + r")\b", GENERIC_FINE, has=("const", "let", "var")),
    Rule("ast-slop/generic-name", "suggestion", PY, r"(?:^|\s)(?:" + "|".join(GENERIC_NAMES) + r")\s*=", GENERIC_FINE, has=("=",)),
    Rule("ast-slop/as-any", "warning", TS, r"\bas\s+any\b", r"\bas\s+unknown\s+as\s+\w+", has=("any",)),
    Rule("ast-slop/double-assertion", "warning", TS, r"\bas\s+unknown\s+as\s+(?:string|number|boolean)\b", has=("unknown",)),
    Rule("ast-slop/defensive-typeof", "info", TS, r"typeof\s+\w+\s*(?:===|!==)\s*['\"]undefined['\"]", has=("typeof",)),
    Rule("ast-slop/defensive-isinstance", "info", PY, r"isinstance\s*\(.*#\s*type:\s*ignore", has=("isinstance",)),
    Rule("ast-slop/hardcoded-config", "warning", CODE, r"['\"]https?://[^'\"]+['\"]", r"(?:localhost|127\.0\.0\.1|example\.(?:com|org)|\.(?:png|svg|css|js)['\"]|^\s*(?://|#|\*|import\b))", has=("http",)),
    Rule("ast-slop/debug-path", "warning", JS, r"^\s*debugger\s*;?", "", TEST_PATH, has=("debugger",)),
    Rule("ast-slop/debug-path", "info", JS, r"process\.env\.DEBUG\b", "", TEST_PATH, has=("process.env.DEBUG",)),
    Rule("ast-slop/barrel-wildcard-import", "info", JS, r"^\s*import\s+\*\s+as\s+\w+\s+from\s+['\"][^'\"]*(?:/index)['\"]", has=("import",)),
    Rule("ast-slop/barrel-type-import", "info", TS, r"^\s*import\s+type\s+.*from\s+['\"][^'\"]*(?:/index)['\"]", has=("import",)),
    Rule("ast-slop/suspicious-alias", "info", JS, r"\bas\s+(?:data|temp|tmp|obj|item|helper|utils?|stuff|thing|foo|bar|x|y)\b.*\bfrom\b", has=("from",)),
    # types
    Rule("types/ts-suppress", "warning", TS, r"//\s*@ts-(?:ignore|expect-error)", has=("@ts-",)),
    Rule("types/double-assertion", "warning", TS, r"\bas\s+unknown\s+as\s+\w+", each=True, has=("unknown",)),
    *[Rule("types/generic-any", "warning", TS, p, each=True, has=("any",), also=("<",)) for p in GENERIC_ANY],
    Rule("types/non-null-assertion", "warning", TS, r"[A-Za-z0-9_)\]]!(?:\.|;|,|\)|\]|\z)", r"^\s*(?://|\*)|['\"`]", has=("!",)),
    Rule("types/missing-return-type", "info", TS, r"(?:function\s+\w+\s*\([^)]*\)\s*\{|(?:const|let|var)\s+\w+\s*=\s*(?:\([^)]*\)|\w+)\s*=>\s*\{)", r"function\s+(?:constructor|render|componentDidMount|useEffect|useState)", has=("function", "=>")),
    Rule("types/as-any-window", "warning", TS, r"\b(?:window|document|navigator|globalThis)\b.*\bas\s+any\b", has=("any",)),
    Rule("types/as-any-json-parse", "warning", TS, r"JSON\.parse\s*\(.*\bas\s+any\b", has=("JSON.parse",)),
    # security
    Rule("security-deep/eval-usage", "error", JS, r"(?:\beval\s*\(|\bnew\s+Function\s*\(|\b(?:setTimeout|setInterval)\s*\(\s*['\"`])", COMMENT, TEST_PATH, has=("eval", "Function", "setTimeout", "setInterval"), code=True),
    Rule("security-deep/inner-html", "error", JS, r"(?:\.innerHTML\s*=|\bdocument\s*\.\s*write\s*\()", COMMENT, TEST_PATH, has=("innerHTML", "write"), code=True),
    Rule("security-deep/unsafe-html", "error", JS, r"(?:\.(?:innerHTML|outerHTML)\s*=|\bdocument\s*\.\s*writeln?\s*\()", COMMENT, has=("innerHTML", "outerHTML", "write")),
    Rule("security-deep/xss-risk", "error", JS, r"(?:dangerouslySetInnerHTML\s*=|v-html\s*=|\.innerHTML\s*=\s*(?:`[^`]*\$\{|['\"`][^'\"`]*['\"`]\s*\+)|\.insertAdjacentHTML\s*\(|\bdocument\s*\.\s*write\s*\([^)]*\+)", COMMENT, has=("dangerouslySetInnerHTML", "v-html", "innerHTML", "insertAdjacentHTML", "write")),
    Rule("security-deep/sql-injection", "error", JS, r"(?i)\b(?:query|execute|raw|run|all|exec|execSql)\s*\(\s*(?:['\"`][^'\"`]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b[^'\"`]*['\"`]\s*\+|`[^`]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b[^`]*\$\{)", COMMENT, TEST_PATH, has=("'", '"', "`"), code=True, also=("(",), low=("select", "insert", "update", "delete", "drop")),
    Rule("security-deep/shell-injection", "error", JS, r"\b(?:exec|execSync)\s*\(\s*(?:['\"`][^'\"`]*['\"`]\s*\+|`[^`]*\$\{)", COMMENT, TEST_PATH, has=("exec",), code=True),
    Rule("security-deep/prototype-pollution", "warning", JS, r"(?:\bObject\s*\.\s*assign\s*\(\s*\w+\s*,\s*\w+|__proto__)", COMMENT, TEST_PATH, has=("Object", "__proto__"), code=True),
    Rule("security-deep/ssrf-risk", "warning", JS, r"\b(?:fetch|axios|axios\s*\.\s*(?:get|post|put|delete|patch|request)|https?\s*\.\s*request)\s*\(\s*(?:\w+\s*[,)]|`[^`]*\$\{)", COMMENT, TEST_PATH, has=("fetch", "axios", "http")),
    # our own definition: a name that speaks of a secret is given a literal of eight characters or more
    Rule("security-deep/hardcoded-secret", "error", CODE, r"(?i)(?:password|passwd|secret|api_?key|token)['\"]?\s*[:=]\s*['\"][^'\"]{8,}['\"]", r"(?i)(?:process\.env|os\.environ|example|placeholder)", TEST_PATH, has=("'", '"'), low=("password", "passwd", "secret", "api_key", "apikey", "token")),
    # python
    Rule("python-deep/bare-except", "error", PY, r"^\s*except\s*:\s*(?:#.*)?\z", has=("except",)),
    Rule("python-deep/broad-exception", "warning", PY, r"^\s*except\s+(?:Exception|BaseException)\s*:", has=("except",)),
    Rule("python-deep/global-variable", "error", PY, r"^\s*global\s+\w+", has=("global",)),
    Rule("python-deep/star-import", "error", PY, r"^\s*from\s+\S+\s+import\s+\*", has=("import",)),
    Rule("python-deep/print-statement", "info", PY, r"^\s*print\s*\(", "", TEST_PATH, has=("print",)),
    Rule("python-deep/f-string-in-log", "warning", PY, r"\b(?:logging|logger|log)\.(?:debug|info|warning|error|critical|exception)\s*\(\s*f['\"]", has=("log",)),
    Rule("python-deep/mutable-default", "error", PY, r"^\s*def\s+\w+\s*\(.*=\s*(?:\[\s*\]|\{\s*\})", has=("def",)),
    Rule("python-deep/no-return-type", "warning", PY, r"^\s*def\s+[a-zA-Z_]\w*\s*\([^)]*\)\s*:", has=("def",)),
    Rule("python-deep/no-type-hint", "warning", PY, r"^\s*def\s+\w+\s*\(\s*(?:self\s*,\s*|cls\s*,\s*)?[a-zA-Z_]\w*\s*[,)=]", r"\(\s*(?:self|cls)?\s*\)", has=("def",)),
    # go
    Rule("go-deep/empty-interface", "error", GO, r"\binterface\s*\{\s*\}", COMMENT, has=("interface",)),
    Rule("go-deep/goto-usage", "error", GO, r"\bgoto\s+[A-Za-z_]\w*", COMMENT, has=("goto",)),
    Rule("go-deep/unchecked-error", "error", GO, r"^\s*(?:_|[A-Za-z_]\w*\s*,\s*_)\s*:?=\s*[\w.]+\s*\(", r"\berr\b", has=("_",)),
    # rust
    Rule("rust-deep/unwrap-in-prod", "error", RS, r"\.unwrap\s*\(\s*\)", COMMENT, TEST_PATH, has=("unwrap",)),
    Rule("rust-deep/expect-in-prod", "warning", RS, r"\.expect\s*\(", COMMENT, TEST_PATH, has=("expect",)),
    Rule("rust-deep/todo-macro", "error", RS, r"\btodo!\s*\(", COMMENT, TEST_PATH, has=("todo!",)),
    Rule("rust-deep/unimplemented-macro", "error", RS, r"\bunimplemented!\s*\(", COMMENT, TEST_PATH, has=("unimplemented!",)),
    Rule("rust-deep/clone-on-copy", "warning", RS, r"(?:\b\d+|\btrue|\bfalse|'.')\.clone\s*\(\)", COMMENT, has=("clone",)),
    Rule("rust-deep/redundant-clone", "warning", RS, r"\breturn\s+\w+\.clone\s*\(\)", COMMENT, has=("clone",)),
    Rule("rust-deep/wildcard-catch", "warning", RS, r"^\s*_\s*=>", COMMENT, has=("=>",)),
    # frameworks
    Rule("nextjs/hardcoded-env", "info", JS, r"['\"]https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0):\d+['\"]|['\"]https?://[a-z0-9-]+\.example\.com(?:/|['\"])", has=("http",)),
    Rule("nextjs/pages-router-in-app", "warning", JS, r"\bexport\s+(?:(?:async\s+)?function|const)\s+(?:getServerSideProps|getStaticProps|getStaticPaths)\b", has=("getServerSideProps", "getStaticProps", "getStaticPaths")),
    Rule("nextjs/next-router-vs-navigation", "warning", JS, r"from\s+['\"]next/router['\"]", has=("next/router",)),
    Rule("tailwind/apply-anti-pattern", "warning", CSS, r"@apply\s+\S+", has=("@apply",)),
    Rule("tailwind/important-modifier", "info", JS, r"className\s*=\s*[\"'`](?:[^\"'`]*\s)?![^\"'`]+[\"'`]", has=("className",)),
    Rule("tailwind/inline-style-conflict", "warning", JS, r"<\w+[^>]*\bclassName\s*=[^>]*\bstyle\s*=\s*\{", has=("className",)),
    Rule("tailwind/magic-values", "suggestion", JS, r"className\s*=\s*[\"'`][^\"'`]*-\[\d+(?:\.\d+)?(?:px|rem|em|%)?\]", has=("className",)),
    # imports, architecture, dead code, translation
    Rule("import-intelligence/side-effect-import", "info", JS, r"^\s*import\s+['\"][^'\"]+['\"]", "", r"(?:^|/)(?:main|index|entry|setup)\.[a-z]+\z", has=("import",)),
    Rule("import-intelligence/react-auto-jsx", "suggestion", JS, r"^\s*import\s+React\s+from\s+['\"]react['\"]", has=("React",)),
    Rule("arch-constraints/unstable-dependency", "info", JS, r"(?i)from\s+['\"]\.[^'\"]*\b(?:internal|private|temp|hack|wip|experimental|unstable|prototype)\b[^'\"]*['\"]", has=("from",)),
    Rule("dead-flow/dead-conditional", "warning", JS, r"^\s*if\s*\(\s*(?:true|false|0|1|null|undefined|!0|!1)\s*\)", has=("if",)),
    Rule("dead-flow/empty-block", "warning", JS, r"catch\s*(?:\([^)]*\))?\s*\{\s*\}", has=("catch",)),
    Rule("dead-flow/empty-block", "info", JS, r"^\s*(?:if|for|while|switch)\s*\([^)]*\)\s*\{\s*\}", has=("if", "for", "while", "switch")),
    Rule("i18n-lint/hardcoded-string-props", "warning", JS, r"\b(?:title|label|placeholder|alt|aria-label)\s*=\s*\"[A-Z][a-z]+ [^\"]+\"", has=('"',)),
    Rule("i18n-lint/hardcoded-string-jsx", "info", JS, r">\s*[A-Z][a-z]+(?: [A-Za-z]+)+\s*</", has=("</",)),
    Rule("i18n-lint/locale-mismatch", "warning", JS, r"(?:from|require\()\s*['\"][^'\"]*(?:locales?|i18n)/[a-z]{2}\.json['\"]", has=(".json",)),
    # syntax and formatting
    Rule("syntax-deep/trailing-whitespace", "info", (*CODE, "css", "html", "yaml"), r"[ \t]+\z", ends=(" ", "\t")),
    Rule("syntax-deep/mixed-indent-line", "warning", CODE, r"^(?: +\t|\t+ )", has=("\t",)),
    Rule("syntax-deep/unicode-anomaly", "warning", CODE, "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in UNICODE_ANOMALIES) + "]", each=True, gate=r"[^ -~\t]"),
    Rule("format-lint/max-line-length", "info", CODE, r"^.{121,}", r"^\s*(?:import\s+|https?://)", least=121),
    # markup
    Rule("html/missing-alt", "error", HTML, r"(?i)<img\b[^>]*>", r"(?i)\balt\s*=", each=True, has=("<",)),
    Rule("html/missing-lang", "warning", HTML, r"(?i)<html\b[^>]*>", r"(?i)\blang\s*=", each=True, has=("<",)),
    Rule("html/deprecated-tag", "warning", HTML, r"(?i)<(?:center|font|marquee|blink|strike|big|tt|frame|frameset|acronym|applet|basefont|dir)\b", each=True, has=("<",)),
    Rule("html/inline-event-handler", "warning", HTML, r"(?i)\bon(?:click|change|submit|load|mouseover|mouseout|keydown|keyup|focus|blur|input)\s*=", each=True, has=("=",)),
    Rule("md/broken-link", "warning", MD, r"\[[^\]]*\]\(\s*#?\s*\)", has=("](",)),
    Rule("md/missing-fenced-lang", "suggestion", MD, r"^\s*(?:```+|~~~+)\s*\z", has=("```", "~~~")),
    Rule("yaml/tab-indent", "error", YAML, r"^\t", has=("\t",)),
    Rule("css/universal-selector", "info", CSS, r"^\s*\*\s*(?:[,:{]|\z)", has=("*",)),
]


def _tests(but: str | tuple[tuple[str, ...], ...]) -> tuple[tuple[str, ...], ...]:
    return ((but,),) if isinstance(but, str) else but


def _place(found: Column, i: Column) -> Column:
    """Where in the line (column ``text``) the match of a place in ``found`` stands: equal matches before it are passed."""
    m = F.get(found, i)
    before = F.size(F.filter(F.slice(found, 1, i), lambda x: x == m))
    return F.length(F.call_function("substring_index", F.col("text"), m, before + 1)) + 1


def detect(all_lines: DataFrame, rules: list[Rule] | None = None, disabled: set[str] = frozenset(), with_text: bool = False) -> DataFrame:
    """path, rule, severity, line, col, message (the matched text), and on demand text (the line): one pass, whichever rules are on."""
    on = [r for r in (RULES if rules is None else rules) if r.id not in disabled]
    text, path = F.col("text"), F.col("path")

    def any_of(c: Column, strings: tuple[str, ...]) -> Column:
        return reduce(Column.__or__, [F.contains(c, F.lit(x)) for x in strings])

    def hit(r: Rule) -> Column:
        test = matches(text, r.pattern)
        if r.but and not r.each:
            test &= ~reduce(Column.__or__, [reduce(Column.__and__, [matches(text, p) for p in all_]) for all_ in _tests(r.but)])
        if r.code:
            test &= (F.length(text) <= LONG_LINE) & ~inside_string(text, F.instr(text, extract(text, r.pattern)))
        if r.off:
            test &= ~matches(path, r.off)
        row = lambda m, col: F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), m.alias("message"), col.alias("col"))
        if r.each:
            found = F.regexp_extract_all(text, F.lit(java(r.pattern)), F.lit(0))
            hits = F.transform(found, lambda m, i: row(m, _place(found, i)))
        else:
            found = extract(text, r.pattern)
            hits = F.array(row(found, F.instr(text, found)))
        # Within the first test, patterns are not taken for what every line needs and shared between rules.
        hits = F.when(test, F.filter(hits, lambda h: ~matches(h["message"], r.but)) if r.but and r.each else hits).otherwise(none)
        may = [any_of(text, r.also)] if r.also else []
        may += [any_of(F.col("low"), r.low)] if r.low else []
        may += [reduce(Column.__or__, [F.endswith(text, F.lit(x)) for x in r.ends])] if r.ends else []
        may += [F.length(text) >= r.least] if r.least else []
        may += [matches(text, r.gate)] if r.gate else []
        return F.when(reduce(Column.__and__, may), hits).otherwise(none) if may else hits

    def all_of(columns: list[Column]) -> Column:
        return columns[0] if len(columns) == 1 else F.flatten(F.array(*columns))

    def held(rules_: list[Rule], key: str, test: Callable[[tuple[str, ...]], Column], inner: Callable[[list[Rule]], Column]) -> Column:
        """The hits of rules, a test for all that share it: lines that it stops ask none of them."""
        by: dict[tuple[str, ...], list[Rule]] = {}
        for r in rules_:
            by.setdefault(getattr(r, key), []).append(r)
        return all_of([F.when(test(k), inner(v)).otherwise(none) if k else inner(v) for k, v in by.items()])

    # The hits are a column of their own, and no higher-order function stands around the tests: as a generator's
    # argument, or within such a function, they would be interpreted, not compiled. The outer explode keeps Spark from
    # asking whether there are hits by a filter that makes them once more.
    none = F.array().cast("array<struct<rule:string,severity:string,message:string,col:int>>")
    seen = sorted({lang for r in on for lang in r.langs})
    tests = held(on, "langs", lambda k: F.col("lang").isin(*k), lambda own: held(own, "has", lambda k: any_of(text, k), lambda same: all_of([hit(r) for r in same])))
    kept = ["text"] if with_text else []
    found = all_lines.filter(F.col("lang").isin(*seen)).select("path", "lang", "num", "text", F.lower("text").alias("low")).select("path", "num", *kept, tests.alias("hits"))
    found = found.select("path", "num", *kept, F.explode_outer("hits").alias("d")).filter("d IS NOT NULL")
    return found.select("path", "d.rule", "d.severity", F.col("num").cast("int").alias("line"), F.col("d.col").cast("int").alias("col"), "d.message", *kept)


#: Numbers as source text writes them; hexadecimal, octal and binary ones are matched whole, and have no digits to lose.
NUMBER = r"\b(?:0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\b"


def precision_loss(all_lines: DataFrame) -> DataFrame:
    """Decimal literals of more than 15 significant digits that a double gives back as another number or notation."""
    n = F.col("message")
    rows = all_lines.filter(F.col("lang").isin(*CODE)).filter(matches(F.col("text"), r"\d{8}")).select("path", "num", "text", F.explode(F.regexp_extract_all("text", F.lit(java(NUMBER)), F.lit(0))).alias("message"))
    # Leading zeros and the point are no significant digits; trailing zeros are.
    digits = F.regexp_replace(F.replace(F.regexp_extract(n, r"^[^eE]*", 0), F.lit("."), F.lit("")), r"^0+", "")
    back = F.regexp_replace(F.regexp_replace(F.replace(F.regexp_extract(n.cast("double").cast("string"), r"^[^E]*", 0), F.lit("."), F.lit("")), r"^0+", ""), r"0+\z", "")
    same = (F.regexp_replace(digits, r"0+\z", "") == back) & ~matches(n, r"[eE]|^\.|\..*0\z")
    rows = rows.filter(~matches(n, r"^0[xXoObB]")).filter((F.length(digits) > 15) & ~same)
    return rows.select("path", F.lit("syntax-deep/precision-loss").alias("rule"), F.lit("warning").alias("severity"), F.col("num").cast("int").alias("line"), F.instr("text", n).cast("int").alias("col"), "message")


def sql(rules: list[Rule] | None = None) -> str:
    """The same as a SELECT over a relation lines(path, lang, num, text)."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    arms = []
    for r in RULES if rules is None else rules:
        test = f"lang IN ({', '.join(map(quote, r.langs))}) AND regexp_matches(text, {quote(r.pattern)})"
        if r.but and not r.each:
            test += " AND NOT (" + " OR ".join("(" + " AND ".join(f"regexp_matches(text, {quote(p)})" for p in all_) + ")" for all_ in _tests(r.but)) + ")"
        test += f" AND NOT regexp_matches(path, {quote(r.off)})" if r.off else ""
        first = f"strpos(text, regexp_extract(text, {quote(r.pattern)}))"
        test += f" AND length(text) <= {LONG_LINE} AND NOT {inside_string_sql('text', first)}" if r.code else ""
        m, source = f"regexp_extract(text, {quote(r.pattern)})", "lines"
        col = f"strpos(text, {m})"
        if r.each:
            every = f"SELECT *, regexp_extract_all(text, {quote(r.pattern)}) AS ms FROM lines"
            m, source = "m", f"(SELECT *, ms[i] AS m, len(list_filter(ms[1:i], lambda x: x = ms[i])) AS nth FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({every})))"
            col = "list_sum(list_transform(string_split(text, m)[1:nth], lambda p: length(p))) + (nth - 1) * length(m) + 1"
            test += f" AND NOT regexp_matches(m, {quote(r.but)})" if r.but else ""
        arms.append(f"SELECT path, {quote(r.id)} AS rule, {quote(r.severity)} AS severity, num::INT AS line, ({col})::INT AS col, {m} AS message FROM {source} WHERE {test}")
    return "\nUNION ALL ".join(arms)
