"""Syntax of JavaScript and TypeScript as relations: lexical state of lines, tokens, brackets as a nested set, statements.

A lexer turns each file into tokens; that is all that a file's text is read for. Each bracket knows its mate, so that
brackets are a nested set: a token lies in a bracket if its place lies between the two. What rules ask (what encloses,
what follows in the same block) are searches in these intervals and folds over tokens with the same parent, file by file.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGS = ("typescript", "javascript")
#: What a line, or a part of one, ends in.
CODE, COMMENT, TEMPLATE, STRING, LINE_COMMENT = range(5)
#: States that a line hands to the next, and so many lines or chunks that are composed at once.
HANDED, CHUNK = 3, 256

# ---- lexical state: every line is a function from the state it starts in to the state it ends in ----

#: Pieces of code that hide what stands in them, the closed ones before those that the line does not close. Repeats
#: are possessive, so that the regex engine loops instead of recursing; without that (for SQL) they match the same.
_HIDES = r"""//.*|/\*(?:[^*]|\*+[^*/])*+\*+/|/\*.*|"(?:\\.|[^"\\])*+"?|'(?:\\.|[^'\\])*+'?|`(?:\\.|[^`\\])*+`?|(?:^|[=(:,;\[!&|?{}+\-~^%<> ])/(?:\\.|\[(?:\\.|[^\]\\])*+\]|[^ */\[\\])(?:\\.|\[(?:\\.|[^\]\\])*+\]|[^/\[\\])*+/"""
_TO_TEMPLATE_END = r"^(?:\\.|[^`\\])*+`"


def _ends_in(code: Column) -> Column:
    """The state that text ends in which starts as code: what its last hiding piece leaves open."""
    last = F.try_element_at(F.regexp_extract_all(code, F.lit(_HIDES), F.lit(0)), F.lit(-1))
    tail = F.endswith(code, last)
    closed = lambda q: last.rlike(rf"^{q}(?:\\.|[^{q}\\])*+{q}\z")
    return (
        F.when(last.isNull(), CODE)
        .when(F.startswith(last, F.lit("//")), LINE_COMMENT)
        .when(F.startswith(last, F.lit("/*")), F.when((F.length(last) < 4) | ~F.endswith(last, F.lit("*/")), COMMENT).otherwise(CODE))
        .when(F.startswith(last, F.lit("`")), F.when(tail & ~closed("`"), TEMPLATE).otherwise(CODE))
        .when(F.startswith(last, F.lit("'")), F.when(tail & ~closed("'"), STRING).otherwise(CODE))
        .when(F.startswith(last, F.lit('"')), F.when(tail & ~closed('"'), STRING).otherwise(CODE))
        .otherwise(CODE)
    )


def _passes(text: Column, state: int, last: bool = False) -> Column:
    """The state at the end of text that starts in a state; at a line's end strings and line comments are over."""
    over = lambda s: s if last else F.when(s < HANDED, s).otherwise(CODE)
    if state == CODE:
        return F.when(text.rlike("[\"'`/]"), over(_ends_in(text))).otherwise(CODE)
    if state == COMMENT:
        at = F.instr(text, "*/")
        return F.when(at == 0, COMMENT).otherwise(over(_ends_in(F.substring(text, at + 2, F.length(text)))))
    rest = F.regexp_replace(text, _TO_TEMPLATE_END, "")
    return F.when(~text.rlike(_TO_TEMPLATE_END), TEMPLATE).otherwise(over(_ends_in(rest)))


def _composed(functions: Column) -> Column:
    return F.aggregate(functions, F.array(*map(F.lit, range(HANDED))), lambda all_, f: F.transform(all_, lambda s: F.get(f, s)))


def _running(start: Column, rows: Column, key: str) -> Column:
    """Each row's key with the state that it starts in."""
    step = lambda acc, r: F.struct(F.get(r["f"], acc["s"]).alias("s"), F.concat(acc["out"], F.array(F.struct(r[key].alias(key), acc["s"].alias("start")))).alias("out"))
    return F.aggregate(rows, F.struct(start.alias("s"), F.array().cast(f"array<struct<{key}:bigint,start:int>>").alias("out")), step, lambda acc: acc["out"])


def states(all_lines: DataFrame) -> DataFrame:
    """path, num, state (CODE, COMMENT or TEMPLATE) that each line starts in.

    Lines are functions of three states, and functions compose: CHUNK lines make one, CHUNK chunks make one, and a
    file's are few. So the states of a file's chunks, then of their lines, are known without reading the file in
    order: a file of any length is read by many tasks, and no group holds more than CHUNK rows but the last, which has
    one for each 65,536 lines. What stands in ${} counts as its template.
    """
    t = F.col("text")
    f = F.when(t.rlike("`|/\\*|\\*/"), F.array(*[_passes(t, s) for s in range(HANDED)])).otherwise(F.array(*map(F.lit, range(HANDED))))
    rows = all_lines.filter(F.col("lang").isin(*LANGS)).select("path", F.col("num").cast("long").alias("num"), f.alias("f")).withColumn("chunk", F.expr(f"(num - 1) div {CHUNK}"))
    gathered = lambda df, by, key: df.groupBy("path", *by).agg(F.sort_array(F.collect_list(F.struct(key, "f"))).alias("rows"))
    chunks = gathered(rows, ["chunk"], "num")
    spans = gathered(chunks.select("path", "chunk", _composed(F.transform("rows", lambda r: r["f"])).alias("f"), F.expr(f"chunk div {CHUNK}").alias("span")), ["span"], "chunk")
    files = gathered(spans.select("path", "span", _composed(F.transform("rows", lambda r: r["f"])).alias("f")), [], "span")
    opened = lambda df, start, key: df.select("path", F.explode(_running(start, F.col("rows"), key)).alias("r")).select("path", f"r.{key}", F.col("r.start").alias("start"))
    by_span = opened(files, F.lit(CODE), "span")
    by_chunk = opened(spans.join(by_span, ["path", "span"]), F.col("start"), "chunk")
    by_line = opened(chunks.join(by_chunk, ["path", "chunk"]), F.col("start"), "num")
    return by_line.select("path", F.col("num").cast("int").alias("num"), F.col("start").alias("state"))


def states_sql() -> str:
    """The same for DuckDB, over lines(path, lang, num, text): a recursive walk, line by line."""
    hides, to_end = (x.replace("*+", "*").replace("'", "''") for x in (_HIDES, _TO_TEMPLATE_END))

    def ends(code: str) -> str:
        last = f"list_extract(regexp_extract_all({code}, '{hides}'), -1)"
        closed = lambda q: f"regexp_matches({last}, '^{q}(?:\\\\.|[^{q}\\\\])*{q}$')"
        return f"CASE WHEN {last} IS NULL THEN 0 WHEN starts_with({last}, '/*') AND (length({last}) < 4 OR NOT ends_with({last}, '*/')) THEN 1 WHEN starts_with({last}, '`') AND ends_with({code}, {last}) AND NOT {closed('`')} THEN 2 ELSE 0 END"

    return f"""fs AS MATERIALIZED (SELECT path, num, {ends('text')} AS f0, CASE WHEN strpos(text, '*/') = 0 THEN 1 ELSE {ends("substr(text, strpos(text, '*/') + 2)")} END AS f1,
  CASE WHEN NOT regexp_matches(text, '{to_end}') THEN 2 ELSE {ends(f"regexp_replace(text, '{to_end}', '')")} END AS f2 FROM lines WHERE lang IN ('typescript', 'javascript')),
walk AS (SELECT path, num, 0 AS state FROM fs WHERE num = 1 UNION ALL
  SELECT fs.path, fs.num + 1, CASE w.state WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END FROM walk w JOIN fs ON fs.path = w.path AND fs.num = w.num),
states AS (SELECT walk.path, walk.num, walk.state FROM walk JOIN fs USING (path, num))"""


#: Rules about code: what stands in comments, strings and templates is none.
ABOUT_CODE = r"^(?:security-deep/|types/(?!ts-suppress)|dead-flow/|ast-slop/(?:as-any|console-leftover|double-assertion|defensive-typeof)\z)"


def in_code(found: DataFrame, all_lines: DataFrame, about: str = ABOUT_CODE) -> DataFrame:
    """Findings without those of rules about code that begin within a comment, a string or a template.

    The state at a finding's column is that of its line, passed through the text before the column. Findings of other
    rules and languages, and those without a line, stay. Each finding meets one line: an equi-join on path and number.
    """
    facts = all_lines.filter(F.col("lang").isin(*LANGS)).select("path", "num", "text").join(states(all_lines), ["path", "num"])
    facts = facts.select(F.col("path").alias("at_path"), F.col("num").alias("at_num"), F.col("text").alias("at_text"), "state")
    asked = found.filter(F.col("rule").rlike(about))
    before = F.substring(F.col("at_text"), F.lit(1), F.col("col") - 1)
    here = F.when(F.col("state") == CODE, _passes(before, CODE, True)).when(F.col("state") == COMMENT, _passes(before, COMMENT, True)).otherwise(_passes(before, TEMPLATE, True))
    kept = asked.join(facts, (F.col("path") == F.col("at_path")) & (F.col("line") == F.col("at_num")), "left").filter(F.col("state").isNull() | (here == CODE)).select(*found.columns)
    return kept.unionByName(found.filter(~F.coalesce(F.col("rule").rlike(about), F.lit(False))))


# ---- tokens and the nested set of their brackets ----

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*+|/\*.*?(?:\*/|\Z))|(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*+)|(?P<number>\.?[0-9](?:[eE][+-]|[\w.])*+)"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?)|(?P<tick>`)|(?P<mark>=>|\.\.\.|\?\.|[=!]==?|[<>]=|&&=?|\|\|=?|\?\?=?|\+\+|--|[-+*/%&|^]=|\*\*|.)",
    re.DOTALL,
)
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*+(?P<end>`|\$\{|\Z)", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\[\\\n])++/[a-z]*+")
#: After these a slash divides.
_VALUE_ENDS = re.compile(r"[\w$)\]}\"'`]\Z")
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())
_MATES = {")": "(", "]": "[", "}": "{"}
TOKENS = "path string, seq int, kind string, text string, line int, col int, parent int, mate int, mate_line int, head string, head_seq int, h_line int, h_col int, h_kind string, h_before string"
_TOKENS_ARROW = pa.schema([(name, pa.string() if kind == "string" else pa.int32()) for name, kind in (c.split() for c in TOKENS.split(", "))])


def _lex(content: str) -> Iterator[tuple[str, str, int]]:
    """kind, text and place of each token; comments are left out. Templates are cut where ${ and } stand."""
    at, last, braces = 0, "", []
    while at < len(content):
        if (braces and content[at] == "}" and not braces[-1]) or content[at] == "`":
            if content[at] == "}":
                braces.pop()
                yield "mark", "}", at
            m = _TEMPLATE.match(content, at + 1)
            yield "template", content[at : m.end()], at
            last, at = "`", m.end()
            if m["end"] == "${":
                braces.append(0)
                yield "mark", "{", at - 1
                last = "{"
            continue
        m = content[at] == "/" and not (last and _VALUE_ENDS.search(last) and last not in _BEFORE_VALUE) and _REGEX.match(content, at) or _TOKEN.match(content, at)
        kind = m.lastgroup or "regex"
        if braces and m[0] in "{}":
            braces[-1] += 1 if m[0] == "{" else -1
        if kind not in ("space", "comment"):
            last = m[0]
            yield kind, last, at
        at = m.end()


def _file_tokens(path: str, content: str) -> list[tuple]:
    starts, low = [0], content.find("\n")
    while low >= 0:
        starts.append(low + 1)
        low = content.find("\n", low + 1)
    rows, open_, line = [], [], 0
    for seq, (kind, text, at) in enumerate(_lex(content)):
        while line + 1 < len(starts) and starts[line + 1] <= at:
            line += 1
        row = [path, seq, kind, text, line + 1, at - starts[line] + 1, open_[-1] if open_ else -1, *[None] * 8]
        if kind == "mark" and text in _MATES:
            if open_ and rows[open_[-1]][3] == _MATES[text]:
                mate = rows[open_.pop()]
                row[6], row[7:9], row[9:] = mate[6], (mate[1], mate[4]), mate[9:]
                mate[7:9] = seq, row[4]
        elif kind == "mark" and text in "([{":
            # The word before a bracket; before a brace behind brackets, the word before these.
            head = seq - 1
            if text == "{" and head >= 0 and rows[head][3] == ")" and rows[head][7] is not None:
                head = rows[head][7] - 1
            at, named = rows[head] if head >= 0 else None, head > 0 and rows[head - 1][2] == "word"
            row[9:] = [at[3], head, at[4], at[5], at[2], rows[head - 1][3] if named else None] if at else ["", -1, *[None] * 4]
            open_.append(seq)
        rows.append(row)
    return rows


def tokens(files: DataFrame) -> DataFrame:
    """path, seq, kind (word, number, string, template, regex, mark), text, line, col of all tokens but comments.

    parent is the place of the innermost open bracket (-1: none), mate that of a bracket's other half (null where it
    has none) and mate_line its line. A bracket, like its mate, also has what stands before the opening one: head (a word
    or mark), head_seq, h_line, h_col and h_kind are that token, h_before is the word before it. Texts of any length are
    read whole; null is empty; a file is lexed by one task, and only by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _file_tokens(path, content or "")
                for a in range(0, len(rows), 1 << 16):
                    part = rows[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _TOKENS_ARROW.types, strict=True)], schema=_TOKENS_ARROW)

    return files.filter(F.col("lang").isin(*LANGS)).select("path", "content").mapInArrow(run, TOKENS)


_FLOW = ("if", "for", "while", "switch", "catch", "with")
_OWN_WORDS = (*_FLOW, "finally", "try", "else", "do")
_CLASS_WORDS = ("class", "interface", "enum", "extends", "implements", "namespace", "module")
_BEFORE_OBJECT = ("=", "(", ",", ":", "[", "?", "return", "&&", "||", "??", "...", "in", "of", "new", "yield", "await", "default", "as", "import", "export", "${")


def _block_kind() -> Column:
    """The kind of a block, by what stands before its opening brace; the closing one knows that too."""
    head, opened = F.col("head"), F.least("seq", "mate")
    return (
        F.when(head.isin(*_OWN_WORDS), head)
        .when(head == "=>", "arrow")
        .when(F.col("h_before").isin(*_CLASS_WORDS), "class")
        .when((F.col("head_seq") + 1 < opened) & (F.col("h_kind") == "word"), "function")
        .when(head.isin(*_BEFORE_OBJECT), "object")
        .otherwise("block")
    )


def blocks(toks: DataFrame) -> DataFrame:
    """path, a and b (places of the two braces), parent, kind, line and col (of what begins the block), first and last line.

    kind: catch, finally, arrow, if, for, while, switch, try, else, do, function, class, object or block.
    """
    rows = toks.filter("text = '{' AND kind = 'mark' AND mate IS NOT NULL")
    return rows.select("path", F.col("seq").alias("a"), F.col("mate").alias("b"), "parent", _block_kind().alias("kind"), F.coalesce("h_line", "line").alias("line"), F.coalesce("h_col", "col").alias("col"), "head_seq", F.col("line").alias("first"), F.col("mate_line").alias("last"))


# ---- rules over the tokens of one file: folds, so that a file is lexed once and no token leaves its task ----

Token = namedtuple("Token", _TOKENS_ARROW.names)
#: rule, severity, line, col, message
Finding = tuple[str, str, int, int, str]


def _kind_of(t: Token) -> str:
    """_block_kind of one bracket."""
    if t.head in _OWN_WORDS:
        return t.head
    if t.head == "=>":
        return "arrow"
    if t.h_before in _CLASS_WORDS:
        return "class"
    if t.head_seq + 1 < (t.seq if t.mate is None else min(t.seq, t.mate)) and t.h_kind == "word":
        return "function"
    return "object" if t.head in _BEFORE_OBJECT else "block"


def _spans(toks: list[Token]) -> list[tuple[Token, str]]:
    """The opening braces that have a mate, with the kinds of their blocks."""
    return [(t, _kind_of(t)) for t in toks if t.text == "{" and t.kind == "mark" and t.mate is not None]


def _covered(spans: Iterable[tuple[int, int]]) -> Callable[[int], bool]:
    """Whether a place lies within one of the spans: they are merged, so that each question is a binary search."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def inside(seq: int) -> bool:
        i = bisect_left(starts, seq) - 1
        return i >= 0 and seq < merged[i][1]

    return inside


# What a function that talks to a database names, and types that a cast by way of unknown hides.
_ORM = r"(?i)prisma|drizzle|sequelize|mongoose|typeorm|knex|supabase"
_PRIMITIVE = ("string", "number", "boolean", "bigint", "symbol", "undefined", "null", "never", "void")
_TEST_PATH = r"(?i:[/_]tests?[/_])|\.(?:test|spec)\.(?:ts|tsx|js|jsx)\z"
_IN_TEST, _EXCUSES = re.compile(_TEST_PATH.replace(r"\z", r"\Z"), re.ASCII), re.compile(_ORM, re.ASCII)
_OWN_CASTS = re.compile(r"/src/(?:config|cli)/|/engines/[^/]+/rules/")


def _slop(path: str, toks: list[Token]) -> Iterator[Finding]:
    """Findings that need the tree: empty catch blocks, as any, console calls, casts by way of unknown.

    Calls and casts in catch blocks are left out, and casts to any in functions that talk to a database or parse JSON
    (the innermost function around the cast tells). Comments do not fill a catch block. Console calls count outside tests.
    """
    spans = _spans(toks)
    catches = [t for t, kind in spans if kind == "catch"]
    caught = _covered((t.seq, t.mate) for t in catches)
    for t in catches:
        if t.mate == t.seq + 1:
            yield "ast-slop/swallowed-exception", "info", t.line if t.h_line is None else t.h_line, t.col if t.h_col is None else t.h_col, "catch"
    seen = [t for t in toks if t.kind in ("word", "mark")]
    texts = [t.text for t in seen] + [None] * 3
    calls, anys, parses = not _IN_TEST.search(path), [], []
    for i, t in enumerate(seen):
        if t.kind == "word" and (i == 0 or texts[i - 1] != "."):
            if t.text == "console" and calls and texts[i + 1] == "." and texts[i + 2] in ("log", "debug") and texts[i + 3] == "(" and not caught(t.seq):
                yield "ast-slop/console-leftover", "suggestion", t.line, t.col, "console." + texts[i + 2]
            elif t.text == "as" and texts[i + 1] == "any" and not caught(t.seq):
                anys.append(t)
            elif t.text == "as" and texts[i + 1] == "unknown" and texts[i + 2] == "as" and texts[i + 3] in _PRIMITIVE and not _OWN_CASTS.search(path):
                yield "ast-slop/double-assertion", "warning", t.line, t.col, "as unknown as " + texts[i + 3]
        if texts[i + 1] == "(" and t.text.lower().endswith("parse"):
            parses.append(t.seq)
    if not anys:
        return
    # The innermost function around each cast, and whether it holds a word that excuses the cast.
    excuses = sorted({*parses, *(t.seq for t in toks if t.kind == "word" and _EXCUSES.search(t.text))})
    bodies = sorted([(t.seq, t.mate) for t, kind in spans if kind in ("function", "arrow")] + _bare_arrows(toks, spans))
    around, at = [], 0
    for t in anys:
        # Bodies nest: those that have ended stand last, and enclose nothing that follows.
        while at < len(bodies) and bodies[at][0] < t.seq:
            while around and around[-1][1] <= bodies[at][0]:
                around.pop()
            around.append(bodies[at])
            at += 1
        while around and around[-1][1] <= t.seq:
            around.pop()
        if around:
            i = bisect_right(excuses, around[-1][0])
            if i < len(excuses) and excuses[i] < around[-1][1]:
                continue
        yield "ast-slop/as-any", "warning", t.line, t.col, "as any"


_GOES_ON = r"^(?:[.,;:?)\]}=<>&|^%*]|[-+]=|\+(?!\+)|-(?!-)|=>|&&|\|\||\?\?|[(\[`]|in\z|of\z|instanceof\z|as\z|satisfies\z)"
_WAITS = r"(?:[,.:?(\[{=<>&|^%*+/!~-]|=>|\b(?:in|of|instanceof|as|new|typeof|void|delete|await|const|let|var|else|do|case|extends))\z"
_BLOCK_KINDS = ("if", "for", "while", "switch", "try", "catch", "finally", "else", "do", "function", "class", "block")
_CONTINUED, _WAITING = (re.compile(p.replace(r"\z", r"\Z")) for p in (_GOES_ON, _WAITS))


def _statements(toks: list[Token], spans: list[tuple[Token, str]]) -> dict[int, list[Token]]:
    """The first tokens of the statements of each block, by the block's place (-1: the file), in order.

    Tokens with the same parent stand in one block; a statement ends at ; or with a block of its own, or with its line
    if neither its last token nor the next one carries it on. Labels of a switch end like statements. Blank lines,
    comments, brackets over several lines and nested functions are nothing to it: they have other parents or no tokens.
    """
    closes = {t.mate: kind for t, kind in spans if kind in _BLOCK_KINDS}
    last: dict[int, Token] = {}
    label: dict[int, str] = {}
    heads: dict[int, list[Token]] = {}
    for t in toks:
        prev, own, text = last.get(t.parent), label.get(t.parent), t.text
        last[t.parent] = t
        if prev is None:
            begins = True
        else:
            below, closed = t.line > prev.line, closes.get(prev.seq)
            begins = (
                prev.text == ";" and text != "}"
                # return, break and the like end with their line whatever follows.
                or below and prev.text in ("return", "break", "continue")
                or closed is not None and text not in (")", ",", ";", ".", "(", "else", "catch", "finally") and not (text == "while" and closed == "do")
                or below and not _CONTINUED.search(text) and (prev.kind in ("string", "template", "regex") or not _WAITING.search(prev.text))
            )
        if begins:
            label[t.parent] = text
        if (begins or prev.text == ":" and own in ("case", "default")) and text not in ("}", ")", "]", ";"):
            heads.setdefault(t.parent, []).append(t)
    return heads


def _bare_arrows(toks: list[Token], spans: list[tuple[Token, str]]) -> list[tuple[int, int]]:
    """The places of arrow functions without braces: up to a comma, semicolon or new statement, or its block's end."""
    arrows = [t for t, after in zip(toks, [*toks[1:], None], strict=True) if t.text == "=>" and (after is None or after.text != "{")] if toks else []
    if not arrows:
        return []
    ends = {parent: [t.seq for t in heads] for parent, heads in _statements(toks, spans).items()}
    for t in toks:
        if t.kind == "mark" and t.text in (",", ";"):
            ends.setdefault(t.parent, []).append(t.seq)
    ends = {parent: sorted(seqs) for parent, seqs in ends.items()}
    out = []
    for t in arrows:
        own = ends.get(t.parent, [])
        # An arrow that begins a statement ends where it begins: nothing stands before it.
        i = bisect_left(own, t.seq)
        mate = toks[t.parent].mate if t.parent >= 0 else None
        out.append((t.seq, own[i] if i < len(own) else (1 << 31) - 1 if mate is None else mate))
    return out


def _dead(path: str, toks: list[Token]) -> Iterator[Finding]:
    """The first statement behind a throw, return, break or continue of the same block, which nothing can reach.

    A throw or return in a catch or finally block is not asked. Functions and types that follow are declared, not
    reached, and labels of a switch are reached from elsewhere.
    """
    spans = _spans(toks)
    kinds = {-1: "file"} | {t.seq: kind for t, kind in spans}
    caught = _covered((t.seq, t.mate) for t, kind in spans if kind in ("catch", "finally"))
    for parent, heads in _statements(toks, spans).items():
        if kinds.get(parent, "object") in ("object", "class"):
            continue
        for ended, t in zip(heads, heads[1:]):
            if ended.text not in _ENDS or t.text in ("case", "default", "function", "interface", "type") or ended.text in ("throw", "return") and caught(t.seq):
                continue
            yield f"dead-flow/dead-after-{_ENDS[ended.text]}", "warning" if ended.text == "return" else "error", t.line, t.col, f"{ended.text} {ended.line}"


#: What ends a block, and its name in rules.
_ENDS = {"throw": "throw", "return": "return", "break": "break", "continue": "break"}


# Names of merge functions, what makes one safe, and the import of a safe one.
MERGES = ("deepMerge", "deepExtend", "mergeDeep", "defaultsDeep")
_KEYS = "(?:__proto__|constructor|prototype)"
_QUOTED_KEY = "(?:" + "|".join(f"{q}{_KEYS}{q}" for q in ("'", '"', "`")) + ")"
MERGE_GUARDS = [
    r"\bObject\s*\.\s*(?:hasOwnProperty|hasOwn)\s*\(",
    r"\bhasOwnProperty\s*\(",
    r"Object\s*\.\s*create\s*\(\s*null\s*\)",
    r"Object\s*\.\s*keys\s*\(",
    rf"\b(?:key|prop|k|name)\s*(?:===|!==|==|!=)\s*{_QUOTED_KEY}",
    rf"\.\s*(?:includes|indexOf|some)\s*\(\s*{_QUOTED_KEY}",
    rf"{_KEYS}\s*in\s+\w+",
]
SAFE_MERGE = r"\bimport\s*\{[^}]*\bdeepMerge\b[^}]*\}\s*from\s*['\"][^'\"]*deep-merge[^'\"]*['\"]"


def _merges(path: str, toks: list[Token], guards: list[int], safe_import: bool) -> Iterator[Finding]:
    """Merge functions without a check of their keys, and calls of merge functions that nothing guards.

    A merge function is safe if a line within its body holds a guard (``guards``: their numbers, in order). Calls within
    a safe body, on the line of a definition, and in files that import a safe merge are safe too; of a line the first
    call counts.
    """
    rule, texts = "security-deep/prototype-pollution", [t.text for t in toks] + [None] * 2
    named = [i for i, t in enumerate(toks) if t.kind == "word" and t.text in MERGES]
    opened: dict[int, list[int]] = {}
    for t, _ in _spans(toks) if named else []:
        opened.setdefault(t.parent, []).append(t.seq)
    defined, safe = set(), []
    for i in named:
        t, lead = toks[i], toks[i - 1] if i else None
        if lead is None or not (lead.text == "function" or lead.text in ("const", "let", "var") and texts[i + 1] in ("=", ":") and texts[i + 2] == "function"):
            continue
        defined.add(lead.line)
        own = opened.get(t.parent, [])
        j = bisect_right(own, t.seq)
        if j < len(own):
            body = toks[own[j]]
            g = bisect_left(guards, lead.line)
            if g < len(guards) and guards[g] <= body.mate_line:
                safe.append((t.seq, body.mate))
            else:
                yield rule, "warning", lead.line, lead.col, "unsafe " + t.text
    if safe_import:
        return
    guarded, called = _covered(safe), set()
    for i in named:
        t = toks[i]
        if texts[i + 1] == "(" and not (i and texts[i - 1] == ".") and t.line not in defined and t.line not in called and not guarded(t.seq):
            called.add(t.line)
            yield rule, "warning", t.line, t.col, t.text


FINDINGS = "path string, rule string, severity string, line int, col int, message string"
_FINDINGS_ARROW = pa.schema([(name, pa.string() if kind == "string" else pa.int32()) for name, kind in (c.split() for c in FINDINGS.split(", "))])


def _rows(found: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * len(_FINDINGS_ARROW), _FINDINGS_ARROW.types, strict=True)]


def _toks(table: pa.Table) -> list[Token]:
    return [Token(*t) for t in zip(*(c.to_pylist() for c in table.sort_by("seq").columns), strict=True)]


def _by_file(toks: DataFrame, fold: Callable[[str, list[Token]], Iterator[Finding]]) -> DataFrame:
    """A fold over the tokens of each file, wherever they stand."""

    def run(table: pa.Table) -> pa.Table:
        all_ = _toks(table)
        return pa.Table.from_arrays(_rows([(all_[0].path, *f) for f in fold(all_[0].path, all_)]), schema=_FINDINGS_ARROW)

    return toks.groupBy("path").applyInArrow(run, FINDINGS)


def tree_slop(toks: DataFrame) -> DataFrame:
    """The findings of _slop in a table of tokens; tree_rules finds them in files, without moving tokens."""
    return _by_file(toks, _slop)


def unreachable(toks: DataFrame) -> DataFrame:
    """The findings of _dead in a table of tokens; tree_rules finds them in files, without moving tokens."""
    return _by_file(toks, _dead)


def _guard(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(MERGE_GUARDS))


def deep_merges(toks: DataFrame, spans: DataFrame, files: DataFrame, all_lines: DataFrame) -> DataFrame:
    """The findings of _merges in a table of tokens, whose blocks tell themselves; guards are lines of ``all_lines``, and
    files that import a safe merge those of ``files``. tree_rules finds them in files, without moving tokens.
    """
    guards = all_lines.filter(F.col("lang").isin(*LANGS) & _guard(F.col("text"))).select("path", F.col("num").cast("int").alias("num"))
    facts = guards.unionByName(files.filter(F.col("content").rlike(SAFE_MERGE)).select("path", F.lit(0).alias("num")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        all_, nums = _toks(left), sorted(right["num"].to_pylist())
        found = [(all_[0].path, *f) for f in _merges(all_[0].path, all_, [n for n in nums if n], 0 in nums)] if all_ else []
        return pa.Table.from_arrays(_rows(found), schema=_FINDINGS_ARROW)

    return toks.groupBy("path").cogroup(facts.groupBy("path")).applyInArrow(run, FINDINGS)


#: Strings that a file with findings has, per rule family: each of a group stands for the group.
_NEEDS = {
    "slop": [["catch"], ["console"], ["as", "any"], ["as", "unknown"]],
    "dead": [["throw"], ["return"], ["break"], ["continue"]],
    "merges": [[name] for name in MERGES],
}


def tree_rules(files: DataFrame, rules: tuple[str, ...] = ("slop", "dead", "merges")) -> DataFrame:
    """All findings of this module that read tokens, or those of some rules: one pass, in which each file is lexed once.

    Files without the strings that findings need are not lexed. Findings leave a task, tokens do not.
    """
    content = F.col("content")
    may = {r: reduce(Column.__or__, [reduce(Column.__and__, [content.contains(x) for x in group]) for group in _NEEDS[r]]) for r in rules}
    texts = F.split("content", "\n", -1)
    guards = F.filter(F.transform(texts, lambda x, i: F.when(_guard(x), i + 1)), lambda n: n.isNotNull())
    merges = may.get("merges", F.lit(False))
    facts = F.when(merges, guards).alias("guards"), F.when(merges, content.rlike(SAFE_MERGE)).alias("safe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, text, nums, safe, *asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                toks = [Token(*t) for t in _file_tokens(path, text)]
                for r in (r for r, x in zip(rules, asked, strict=True) if x):
                    found += [(path, *f) for f in (_slop(path, toks) if r == "slop" else _dead(path, toks) if r == "dead" else _merges(path, toks, nums, safe))]
            yield pa.RecordBatch.from_arrays(_rows(found), schema=_FINDINGS_ARROW)

    asked = files.filter(F.col("lang").isin(*LANGS) & reduce(Column.__or__, may.values()))
    return asked.select("path", "content", *facts, *[may[r].alias(r) for r in rules]).mapInArrow(run, FINDINGS)
