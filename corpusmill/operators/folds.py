"""Detectors with state over one file that windows cannot express: scopes, block kinds, escapes, Python syntax trees.

Each is a function of one file's text, run over Arrow batches; files do not meet.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OUT = "path string, rule string, severity string, line int, col int, message string"
_ARROW = pa.schema([("path", pa.string()), ("rule", pa.string()), ("severity", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("message", pa.string())])
Found = Iterator[tuple[str, str, int, int, str]]


def run(files: DataFrame, langs: tuple[str, ...], *folds: Callable[[str], Found]) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *hit) for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for fold in folds for hit in fold(content or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _ARROW.types, strict=True)], schema=_ARROW)

    return files.filter(F.col("lang").isin(*langs)).select("path", "content").mapInArrow(each, _OUT)


def json_keys(content: str) -> Found:
    """Keys that repeat in their own object."""
    scopes: list[set[str]] = [set()]
    for num, line in enumerate(content.split("\n"), 1):
        for m in re.finditer(r'"((?:[^"\\]|\\.)*)"(\s*:)?|[{}\[\]]', line):
            if m[0] in "{[":
                scopes.append(set())
            elif m[0] in "}]":
                if len(scopes) > 1:
                    scopes.pop()
            elif m[2]:
                if m[1] in scopes[-1]:
                    yield "json/duplicate-keys", "error", num, m.start() + 1, m[1]
                scopes[-1].add(m[1])


def yaml_keys(content: str) -> Found:
    """Keys that repeat at their indentation, below the same parent."""
    scopes: list[tuple[int, set[str]]] = [(-1, set())]
    for num, line in enumerate(content.split("\n"), 1):
        m = re.match(r"^(\s*)(?:-\s+)?([A-Za-z_][\w-]*)\s*:", line)
        if not m:
            if line.startswith("---"):
                scopes = [(-1, set())]
            continue
        indent = len(m[1]) + (2 if "- " in line[: m.start(2)] else 0)
        fresh = "- " in line[: m.start(2)]
        while scopes[-1][0] > indent or (fresh and scopes[-1][0] >= indent):
            scopes.pop()
        if scopes[-1][0] < indent:
            scopes.append((indent, set()))
        if m[2] in scopes[-1][1]:
            yield "yaml/duplicate-keys", "error", num, m.start(2) + 1, m[2]
        scopes[-1][1].add(m[2])


def _kind(header: str) -> str:
    for kind, pattern in (("async-function", r"\basync\b"), ("for", r"\bfor\b"), ("while", r"\bwhile\b"), ("do", r"\bdo\b"), ("forEach", r"\.forEach\b"), ("map", r"\.map\b"), ("sync-function", r"\bfunction\b|=>\s*$")):
        if re.search(pattern, header):
            return kind
    return "other"


def brace_blocks(content: str) -> list[tuple[int, int, str]]:
    """(first line, last line, kind) of all brace blocks; strings and comments do not count."""
    stack, out, in_comment = [], [], False
    lines = content.split("\n")
    for num, line in enumerate(lines, 1):
        i, quote, header = 0, "", ""
        while i < len(line):
            two, c = line[i : i + 2], line[i]
            if in_comment:
                if two == "*/":
                    in_comment, i = False, i + 1
            elif quote:
                if c == "\\":
                    i += 1
                elif c == quote:
                    quote = ""
            elif two == "//":
                break
            elif two == "/*":
                in_comment, i = True, i + 1
            elif c in "'\"`":
                quote = c
            elif c == "{":
                stack.append((num, _kind(header if header.strip() else lines[num - 2] if num > 1 else "")))
                header = ""
            elif c == "}":
                if stack:
                    a, kind = stack.pop()
                    out.append((a, num, kind))
                header = ""
            else:
                header += c
            i += 1
    return sorted(out)


# Calls that reach a database, and calls that wait.
_DB_CALL = re.compile(r"\.(?:find|findOne|findMany|findUnique|findFirst|query|execute|select|insert|update|delete|save|create)\s*\(")
_SYNC = re.compile(r"\b(\w+Sync)\s*\(")


def loops(content: str) -> Found:
    """What should not stand in a loop, or in an async function: a join of lines and the blocks that hold them."""
    blocks, lines, seen, adds = brace_blocks(content), content.split("\n"), set(), {}
    for num, line in enumerate(lines, 1):
        inside = [b for b in blocks if b[0] < num < b[1]]
        loop = next((b for b in reversed(inside) if b[2] in ("for", "while", "do")), None)
        any_loop = next((b for b in reversed(inside) if b[2] in ("for", "while", "do", "forEach", "map")), None)
        if loop and re.search(r"\bawait\b", line) and _DB_CALL.search(line) and loop not in seen:
            seen.add(loop)
            yield "perf-hints/n-plus-one", "info", num, 1, line.strip()
        if any(b[2] == "async-function" for b in inside) and (m := _SYNC.search(line)):
            yield "perf-hints/sync-in-async", "warning", num, m.start() + 1, m[1]
        if any_loop and (m := re.search(r"\bnew\s+(Array\s*\(\s*(\d+)|(?!Map\b|Set\b|WeakMap\b|WeakSet\b|Array\b)[A-Z]\w*Array\b)", line)) and (not m[2] or int(m[2]) > 100):
            yield "perf-hints/large-loop-allocation", "suggestion", num, m.start() + 1, m[0]
        if any_loop and (m := re.match(r"\s*(\w+)\s*\+=\s*(['\"`])", line)):
            adds.setdefault((m[1], any_loop), []).append((num, m[2]))
    for (name, _), places in sorted(adds.items(), key=str):
        if any(q == "`" for _, q in places) or len(places) >= 3:
            yield "perf-hints/string-concat-in-loop", "warning", places[0][0], 1, name


def react_memo(content: str) -> Found:
    for a, b, kind in brace_blocks(content):
        body = content.split("\n")[a - 1 : b]
        m = re.match(r"\s*(?:export\s+)?(?:const|function)\s+([A-Z]\w*)", body[0])
        if m and kind in ("sync-function", "async-function") and re.search(r"return\s*\(?\s*<", "\n".join(body)) and not re.search(rf"memo\(\s*{m[1]}\b|React\.memo", content):
            yield "perf-hints/react-missing-memo", "info", a, 1, m[1]


def escapes(content: str) -> Found:
    """Escapes that strings do not have, those of patterns in strings, and needless ones in classes."""
    for num, line in enumerate(content.split("\n"), 1):
        if re.match(r"\s*(?://|\*)", line):
            continue
        for s in re.finditer(r"""(["'])((?:[^"'\\]|\\.)*)\1""", line):
            for m in re.finditer(r"\\(.)", s[2]):
                at = s.start(2) + m.start() + 1
                if m[1] in "sdwDWSbBgpP" and m[1] != "b":
                    yield "syntax-deep/regex-escape-in-string", "warning", num, at, m[0]
                elif m[1] not in "'\"`\\nrtbfv0xu\n":
                    yield "syntax-deep/invalid-escape-sequence", "warning", num, at, m[0]
        for p in re.finditer(r"/((?:[^\\/\n]|\\.)+)/[gimsuy]*", line):
            for c in re.finditer(r"\[(?:[^\]\\]|\\.)*\]", p[1]):
                for m in re.finditer(r"\\([.*+?(){}|$])", c[0]):
                    yield "syntax-deep/unnecessary-regex-class-escape", "info", num, p.start(1) + c.start() + m.start() + 1, m[0]


def switches(content: str) -> Found:
    """Code behind a break or return of a case, and cases behind the default one."""
    ended, default = False, False
    for num, line in enumerate(content.split("\n"), 1):
        t = line.strip()
        if re.match(r"switch\b", t):
            ended, default = False, False
        elif re.match(r"(?:case\b|default\s*:)", t):
            if default and t.startswith("case"):
                yield "dead-flow/dead-switch-case-after-default", "warning", num, 1, t
            ended, default = False, default or t.startswith("default")
        elif t.startswith("}"):
            ended = False
        elif ended and t and not t.startswith("//"):
            yield "dead-flow/dead-switch-code", "warning", num, 1, t
            ended = False
        elif re.match(r"(?:break\s*;?|return\b.*;)\s*$", t):
            ended = default is not None and bool(re.search(r"switch\b", content))


def go_loops(content: str) -> Found:
    """Deferred calls in loops; init functions that reach out; exported functions that call out without a context."""
    blocks = brace_blocks(content)
    for num, line in enumerate(content.split("\n"), 1):
        if re.match(r"\s*defer\b", line) and any(b[0] < num <= b[1] and b[2] == "for" for b in blocks):
            yield "go-deep/defer-in-loop", "error", num, 1, line.strip()
    lines = content.split("\n")
    for a, b, _ in blocks:
        body = "\n".join(lines[a:b])
        if re.match(r"\s*func\s+init\s*\(\s*\)", lines[a - 1]) and re.search(r"\b(?:http|os|sql|net|log)\.\w+\(", body):
            yield "go-deep/init-side-effect", "warning", a, 1, lines[a - 1].strip()
        if (m := re.match(r"\s*func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)\s*\(([^)]*)\)", lines[a - 1])) and "context.Context" not in m[2] and re.search(r"\b(?:http\.(?:Get|Post)|\w+\.(?:Query|Exec))\(", body):
            yield "go-deep/context-missing", "warning", a, 1, m[1]
        if (m := re.match(r"\s*func\s+(?:\([^)]*\)\s*)?(\w*(?:Copy|Clone)\w*)\s*\(", lines[a - 1])) and re.search(r"return\s+\*?\w+\s*$", body, re.M) and "copy(" not in body:
            yield "go-deep/deep-copy-missing", "warning", a, 1, m[1]


def rust_enums(content: str) -> Found:
    """Enums of which a variant holds much more than the others."""
    lines = content.split("\n")
    for a, b, _ in brace_blocks(content):
        if m := re.match(r"\s*(?:pub\s+)?enum\s+(\w+)", lines[a - 1]):
            held = [len(re.findall(r"\b(?:String|Vec|HashMap|BTreeMap|HashSet|PathBuf)\b", x)) for x in lines[a : b - 1] if x.strip()]
            if held and max(held) >= 3 and min(held) == 0:
                yield "rust-deep/large-enum-variant", "warning", a, 1, m[1]


def python_tree(content: str) -> Found:
    """Python rules on the syntax tree; texts that do not parse give none."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler) and node.type is None:
            yield "ast-slop/py-bare-except", "warning", node.lineno, node.col_offset + 1, "except"
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            body = [x for x in node.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str))]
            if all(isinstance(x, ast.Pass) or (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and x.value.value is ...) for x in body):
                yield "ast-slop/py-stub-function", "warning", node.lineno, node.col_offset + 1, node.name
            for default in [*node.args.defaults, *[d for d in node.args.kw_defaults if d]]:
                if isinstance(default, ast.List | ast.Dict | ast.Set):
                    yield "python-deep/mutable-default", "error", default.lineno, default.col_offset + 1, node.name
        elif isinstance(node, ast.ClassDef) and all(isinstance(x, ast.Pass) for x in node.body):
            yield "ast-slop/py-empty-class", "info", node.lineno, node.col_offset + 1, node.name
        elif isinstance(node, ast.ImportFrom) and any(a.name == "*" for a in node.names):
            yield "ast-slop/py-wildcard-import", "info", node.lineno, node.col_offset + 1, node.module or ""
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "print":
            yield "ast-slop/py-print", "warning", node.lineno, node.col_offset + 1, "print"


def comment_lines(lines: DataFrame) -> DataFrame:
    """path, num, in_comment: whether a line starts inside a block comment: what the last mark before it says."""
    t = F.col("text")
    last_open, last_close = F.length(t) - F.length(F.substring_index(t, "/*", -1)), F.length(t) - F.length(F.substring_index(t, "*/", -1))
    mark = F.when(last_open > last_close, True).when(last_close > last_open, False)
    before = Window.partitionBy("path").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("path", "num", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)).alias("in_comment"))


# Names that many functions share, and how many lines a body must be longer than to count as copied.
COMMON_NAMES = ("run", "fix", "constructor", "get", "set", "init", "handle", "process", "execute", "dispose", "close", "open", "start", "stop", "reset", "validate")
COPIED_LINES = 5
# How functions begin.
_JS_HEADS = [
    re.compile(r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\("),
    re.compile(r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>"),
    re.compile(r"^(?!if|for|while|switch|catch|class|constructor)(?:(?:public|private|protected|static|async|abstract)\s+)*(\w+)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{"),
]
_PY_HEAD = re.compile(r"^(\s*)def\s+(\w+)\s*\(")
_FUNCTION = pa.schema([("path", pa.string()), ("num", pa.int32()), ("stop", pa.int32()), ("name", pa.string()), ("n_lines", pa.int32()), ("body", pa.string())])


def function_bodies(content: str, lang: str) -> list[tuple[int, int, str, int, str]]:
    """(first line, last line, name, filled lines of the body, body without comments and outer white space) of functions.

    In Python a body is what stands deeper than its header; elsewhere it is what stands between the line of the first
    brace and that of its match, all found in one pass over the braces. Bodies of 20 characters or less are left out.
    """
    lines, out = content.split("\n"), []
    mark = "#" if lang == "python" else "//"
    if lang == "python":
        heads = [(i, m[2], len(m[1])) for i, line in enumerate(lines) if (m := _PY_HEAD.match(line))]
        indents = [len(line) - len(line.lstrip()) if line.strip() else None for line in lines]
        spans = []
        for i, name, indent in heads:
            j, last = i + 1, i
            while j < len(lines) and (indents[j] is None or indents[j] > indent):
                last = j if indents[j] is not None else last
                j += 1
            spans.append((i, last, name, i + 1, j))
    else:
        braces = [(i, c) for i, line in enumerate(lines) for c in line if c in "{}"]
        match, stack = {}, []
        for k, (_, c) in enumerate(braces):
            if c == "{":
                stack.append(k)
            elif stack:
                match[stack.pop()] = k
        opens = [k for k, (_, c) in enumerate(braces) if c == "{"]
        at_line = [braces[k][0] for k in opens]
        spans = []
        for i, line in enumerate(lines):
            if m := next((m for head in _JS_HEADS if (m := head.match(line.strip()))), None):
                k = bisect_left(at_line, i)
                if k < len(opens):
                    close = match.get(opens[k])
                    last = braces[close][0] if close is not None else len(lines) - 1
                    spans.append((i, last, m[1], max(i + 1, at_line[k]), last if close is not None else len(lines)))
    for i, last, name, a, b in spans:
        body = [line.split(mark, 1)[0].strip() if mark in line else line.strip() for line in lines[a:b]]
        text = "\n".join(x for x in body if x)
        if len(text) > 20:
            out.append((i + 1, last + 1, name, sum(bool(x.strip()) for x in lines[a:b]), text))
    return out


def functions(files: DataFrame) -> DataFrame:
    """path, num, stop, name, n_lines, body of the functions of a corpus."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *f) for path, lang, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for f in function_bodies(content or "", lang)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _FUNCTION.types, strict=True)], schema=_FUNCTION)

    return files.filter(F.col("lang").isin("typescript", "javascript", "python")).select("path", "lang", "content").mapInArrow(each, "path string, num int, stop int, name string, n_lines int, body string")


def all_folds(files: DataFrame) -> DataFrame:
    out = run(files, ("typescript", "javascript"), loops, react_memo, escapes, switches)
    for langs, folds in ((("json",), (json_keys,)), (("yaml",), (yaml_keys,)), (("go",), (go_loops,)), (("rust",), (rust_enums,)), (("python",), (python_tree,))):
        out = out.unionByName(run(files, langs, *folds))
    return out
