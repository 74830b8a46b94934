"""Personal data behind disguises: transducers rewrite text, detectors read what comes out, spans go back to the source.

A transducer rewrites pieces of a text and keeps, for each character of its output, the piece of the source that it
stands for. The first one (homoglyphs, letters and digits of other alphabets and widths, invisible characters) maps
character to character and runs over whole texts as a table; the others (spelled digits, at and dot) run around the
places where they could matter. The same detectors read plain text and rewritten text.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import kernels as K

KINDS = ("email", "ip", "card", "phone")
#: Bytes of texts that are read at once.
STEP = 1 << 21
#: So far apart may digits of one number stand, and so many parts may a disguised local name and a domain have.
NEAR, PARTS = 10, 64
Span = tuple[int, int]

# ---- detectors: leftmost, non-overlapping, one pass whatever the text ----

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Each @ is looked at once: the name before it (behind the last match), the domain behind it."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", low)
    return out


def _digits(codes: np.ndarray) -> np.ndarray:
    return (codes >= 48) & (codes <= 57)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ips(codes: np.ndarray) -> list[Span]:
    """Runs of digits with single dots between them, taken four by four from the left."""
    starts, ends = _runs(_digits(codes))
    if len(starts) < 4:
        return []
    tied = (starts[1:] == ends[:-1] + 1) & (codes[np.minimum(ends[:-1], len(codes) - 1)] == 46)
    first = np.flatnonzero(np.append(True, ~tied))
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    four = np.flatnonzero(tied[:-2] & tied[1:-1] & tied[2:] & (place[:-3] % 4 == 0))
    fits = lambda a, b: int(chars.lstrip("0") or 0) < 256 if len((chars := bytes(codes[a:b].astype(np.uint8)).decode()).lstrip("0")) < 4 else False
    return [(int(starts[i]), int(ends[i + 3])) for i in four if all(fits(starts[j], ends[j]) for j in range(i, i + 4))]


def luhn(digits: list[int]) -> bool:
    twice = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def cards(codes: np.ndarray) -> list[Span]:
    """Runs of 14 to 19 digits, at most one space or hyphen between two, that pass Luhn."""
    at = np.flatnonzero(_digits(codes))
    if len(at) < 14:
        return []
    gap, behind = np.diff(at), codes[at[:-1] + 1]
    first = np.flatnonzero(np.append(True, ~((gap == 1) | ((gap == 2) & ((behind == 32) | (behind == 45))))))
    size = np.diff(np.append(first, len(at)))
    found = ((int(i), int(n)) for i, n in zip(first, size, strict=True) if 14 <= n <= 19)
    return [(int(at[i]), int(at[i + n - 1]) + 1) for i, n in found if luhn([int(c) - 48 for c in codes[at[i : i + n]]])]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]


# ---- the first transducer: character to character ----

# Letters of other alphabets that look like Latin ones.
_ALIKE = {
    **dict(zip("аеорсухіјѕһԁԛԝӏѵкмт", "aeopcyxijshdqwlvkmt", strict=True)),  # Cyrillic
    **dict(zip("АВЕЅІЈКМНОРСТУХԚԜ", "ABESIJKMHOPCTYXQW", strict=True)),
    **dict(zip("αορνικυχε", "aopvikuxe", strict=True)),  # Greek
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True)),
    **dict(zip("օոսհցıɑɡ", "onuhgiag", strict=True)),  # Armenian, Latin
    **dict(zip("。｡·•∙⋅․‐‑‒–—―−", ".......-------", strict=True)),
}
#: Characters that nobody sees, and what stands for them until they are dropped.
_UNSEEN, GONE = [0xAD, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF], 0xFFFF
#: Blocks with wide, small, styled and enclosed forms of ASCII characters.
_FORMS = [(0x2000, 0x2500), (0x3000, 0x3001), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x1F100, 0x1F190)]


@functools.cache
def _table() -> np.ndarray:
    """What each code point is read as."""
    out = np.arange(0x110000, dtype=np.uint32)
    for a, b in _FORMS:
        for c in range(a, b):
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1 and " " <= plain <= "~":
                out[c] = ord(plain)
    out[0xA0] = 32
    for c in range(0x660, 0x1FBFA):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            out[c] = 48 + d
    for c, plain in _ALIKE.items():
        out[ord(c)] = ord(plain)
    out[_UNSEEN] = GONE
    return out


# ---- words that stand for characters ----

# Digits in English, Spanish, French and German, accents left out; words for other characters.
SPELLED = {
    "0": "zero cero null oh", "1": "one uno un une eins ein", "2": "two dos deux zwei", "3": "three tres trois drei",
    "4": "four cuatro quatre vier", "5": "five cinco cinq funf fuenf", "6": "six seis sechs", "7": "seven siete sept sieben",
    "8": "eight ocho huit acht", "9": "nine nueve neuf neun",
}
_AT, _DOT, _PLUS = ("at", "arroba", "arobase"), ("dot", "punto", "point", "punkt"), ("plus", "mas")
# Last labels that a domain may have where only plain words tell of it.
TLDS = frozenset("com org net edu gov mil int info biz name io co me tv ai app dev xyz online site us uk ca au nz ie in de fr es it nl be ch pt pl se no dk fi eu ru br mx ar cl jp cn kr za example test".split())
_DIGIT_OF = {w: d for d, words in SPELLED.items() for w in words.split()}


@functools.cache
def _letters() -> np.ndarray:
    """The number of a letter (accents left out), 63 for other letters beyond ASCII, 0 for what parts words."""
    out = np.full(0x110000, 63, np.uint8)
    out[:128] = 0
    for c in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(c))[0].lower()
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[GONE] = 0
    return out


def _key(word: str) -> int:
    return sum((ord(c) - 96) << 6 * i for i, c in enumerate(word))


#: Known words, by key: what a word is.
_ROLE = {**{_key(w): 1 for w in _DIGIT_OF}, **{_key(w): 2 for w in _AT}, **{_key(w): 3 for w in (*_DOT, *_PLUS, "double", "triple")}}
_KEYS = np.array(sorted(_ROLE), np.int64)
_ROLES = np.array([_ROLE[k] for k in _KEYS.tolist()], np.int8)


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and roles of the known words: runs of letters, as one number of six bits a letter."""
    letter = _letters()[codes]
    starts, ends = _runs(letter > 0)
    own = np.flatnonzero(ends - starts <= 10)
    starts, ends = starts[own], ends[own]
    key = np.zeros(len(starts), np.int64)
    for i in range(10):
        own = own[ends[own] - starts[own] > i] if i else np.flatnonzero(ends > starts)
        key[own] |= letter[starts[own] + i].astype(np.int64) << 6 * i
    at = np.minimum(np.searchsorted(_KEYS, key), len(_KEYS) - 1)
    known = _KEYS[at] == key
    return starts[known], ends[known], _ROLES[at[known]]


class Rewritten:
    """What a transducer made of a piece of text, and where each character of it comes from."""

    def __init__(self, pattern: re.Pattern, output, text: str, at: int):
        parts, self.starts, self.ends, low = [], [], [], 0

        def plain(a: int, b: int) -> None:
            parts.append(text[a:b])
            self.starts += range(at + a, at + b)
            self.ends += range(at + a + 1, at + b + 1)

        for m in pattern.finditer(text):
            plain(low, m.start())
            got = output(m)
            parts.append(got)
            self.starts += [at + m.start()] * len(got)
            self.ends += [at + m.end()] * len(got)
            low = m.end()
        plain(low, len(text))
        self.text = "".join(parts)

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


_NO_LETTER, _SPACE = r"(?![^\W\d_])", r"[\x20\t]{0,8}"
_SPELL = "|".join(sorted((w.replace("e", "[eéè]").replace("u", "[uü]") for w in _DIGIT_OF), key=lambda w: (-len(w), w)))
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOT_WORD = "|".join(_DOT)
_INNER = rf"{_SPACE}{_OPEN}{_SPACE}(?:{_DOT_WORD}|\.){_SPACE}{_CLOSE}{_SPACE}"
_ENTITY_DOT, _ENTITY_AT = r"&#0{0,6}46;|&#x0{0,6}2e;|&period;", r"&#0{0,6}64;|&#x0{0,6}40;|&commat;|%40"
_NEXT = rf"(?:[\x20\t,-]{{1,3}}(?=(?:{_SPELL}|double|triple){_NO_LETTER}|[0-9]))?"
_NUMBER = re.compile(
    rf"(?P<gone>\uffff)|(?<![^\W\d_])(?P<times>double|triple)[\x20-]{{1,2}}(?P<of>{_SPELL}|[0-9]){_NO_LETTER}{_NEXT}|(?<![^\W\d_])(?P<digit>{_SPELL}){_NO_LETTER}{_NEXT}"
    rf"|(?P<plus>{_OPEN}?(?<![^\W\d_])(?:plus|m[aá]s){_NO_LETTER}{_CLOSE}?[\x20\t]{{0,3}}|\+[\x20\t]{{1,3}}(?=(?:{_SPELL}){_NO_LETTER}))|(?P<dot>{_INNER}|[\x20\t]{{1,8}}(?:{_DOT_WORD})[\x20\t]{{1,8}}|{_ENTITY_DOT})",
    re.IGNORECASE,
)
#: Stripped of accents, for a spelled digit.
_BARE = str.maketrans("éèü", "eeu")


def _number(m: re.Match) -> str:
    if word := m["digit"] or m["of"]:
        word = word.lower().translate(_BARE)
        return _DIGIT_OF.get(word, word) * {"double": 2, "triple": 3}.get((m["times"] or "").lower(), 1)
    return "+" if m["plus"] else "." if m["dot"] else ""


_AT_WORD = "|".join(_AT)
#: An at in disguise: bracketed, as an entity, spaced; or as a plain word, which proves nothing by itself.
_AT_TOKEN = re.compile(rf"(?P<strong>{_SPACE}{_OPEN}{_SPACE}(?:{_AT_WORD}|@){_SPACE}{_CLOSE}{_SPACE}|{_ENTITY_AT}|(?-i:(?<=[a-z0-9])AT(?=[a-z0-9]))|[\x20\t]{{1,8}}@{_SPACE}|@[\x20\t]{{1,8}})|(?P<weak>[\x20\t]{{1,8}}(?:{_AT_WORD})[\x20\t]{{1,8}}|[_-](?:{_AT_WORD})[_-])|(?P<plain>@)", re.IGNORECASE)
_DOT_TOKEN = re.compile(rf"(?P<strong>{_INNER}|{_ENTITY_DOT}|(?-i:(?<=[a-z0-9])DOT(?=[a-z0-9])))|(?P<weak>[\x20\t]{{1,8}}(?:{_DOT_WORD})[\x20\t]{{1,8}}|[_-](?:{_DOT_WORD})[_-])|(?P<spaced>[\x20\t]\.[\x20\t])|(?P<plain>\.)", re.IGNORECASE)
_DOT_END = re.compile(rf"(?:{_DOT_TOKEN.pattern})\Z", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9\uffff-]+?(?=[_-](?:dot|punto|point|punkt)[_-]|(?-i:DOT[a-z])|[^A-Za-z0-9\uffff-]|\Z)", re.IGNORECASE)
_MAIL = re.compile(rf"(?P<gone>\uffff)|(?P<at>{_AT_TOKEN.pattern.replace('strong', 'at1').replace('weak', 'at2').replace('plain', 'at3')})|(?P<dot>{_DOT_TOKEN.pattern.replace('strong', 'dot1').replace('weak', 'dot2').replace('spaced', 'dot3').replace('plain', 'dot4')})", re.IGNORECASE)


def _mail(m: re.Match) -> str:
    return "@" if m["at"] else "." if m["dot"] else ""


def _domain(flat: str, at: int, how: str) -> tuple[int, list[str]] | None:
    """Where the domain behind an at ends, and how its dots are written; None if nothing tells that it is one."""
    m = _LABEL.match(flat, at)
    ends, dots = [], []
    while m and len(dots) < PARTS:
        dot = _DOT_TOKEN.match(flat, m.end())
        if not dot or dot.lastgroup == "spaced" and how == "weak":
            break
        # One who writes dots as words writes all of them so; a plain @ with a real dot is complete.
        if dot.lastgroup == "weak" and "plain" in dots or dot.lastgroup == "plain" and "weak" in dots:
            break
        m = _LABEL.match(flat, dot.end())
        if not m or m.start() == m.end():
            break
        dots.append(dot.lastgroup)
        ends.append((m.end(), m[0].replace("\uffff", "").lower()))
    while ends:
        last = ends[-1][1]
        if last in TLDS or dots[-1] in ("strong", "plain") and how != "weak" and len(last) > 1 and last.isalpha() and last.isascii():
            return ends[-1][0], dots
        ends.pop()
        dots.pop()
    return None


def _name(flat: str, end: int, floor: int, how: str) -> int:
    """Where the local name before an at starts; dots in it may be disguised if the at is."""
    start = end
    for _ in range(PARTS):
        lo = start
        while lo > floor and (flat[lo - 1] in _LOCAL or flat[lo - 1] == "\uffff"):
            lo -= 1
        if lo == start:
            return start if start == end else start + len(m[0])
        m = _DOT_END.search(flat, max(floor, lo - 40), lo)
        if not m or m.lastgroup not in ("strong", "weak") or m.lastgroup == "weak" and (how == "plain" or "." in flat[lo:end]) or m.start() <= floor:
            return lo
        start = m.start()
    return lo


def _hidden_mails(flat: str, source: str, sites: Iterator[Span]) -> Iterator[Span]:
    """sites: places of an at, whatever its form, with the start of its text."""
    done = -1
    for site, floor in sites:
        lo = site
        while lo > max(floor, site - 9) and flat[lo - 1] in " \t":
            lo -= 1
        if lo > floor and flat[lo - 1] in "[({<":
            lo -= 1
            for _ in range(8):
                lo -= lo > floor and flat[lo - 1] in " \t"
        elif lo == site and lo > floor and flat[lo - 1] in "_-" and flat[site] != "@":
            lo -= 1
        m = _AT_TOKEN.match(flat, lo)
        if not m or m.end() <= site or lo < done:
            continue
        how = m.lastgroup
        got = _domain(flat, m.end(), how)
        if not got:
            continue
        start = _name(flat, lo, floor, how)
        name = flat[start:lo].replace("\uffff", "")
        if start == lo or not any(c.isalnum() for c in name):
            continue
        end, dots = got
        # A plain word at proves an address only with plain words for all dots, or before a name that is no word.
        if how == "weak" and "plain" in dots and not (re.search(r"[0-9._%+]", name.strip("._%+-")) and name[-1] not in "._%+-"):
            continue
        own = Rewritten(_MAIL, _mail, flat[start:end], start)
        for span in emails(own.text):
            a, b = own.source(span)
            if source[a:b] != own.text[span[0] : span[1]]:
                yield a, b
        done = end


def _hidden_numbers(codes: np.ndarray, flat: np.ndarray, text: str, words: tuple, doc_starts: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Numbers with spelled or odd digits, and with dots and signs in disguise."""
    starts, ends, role = words
    plain, odd = _digits(flat), flat != codes
    # Letters that pass for digits, in runs of digits and such letters alone.
    look = np.isin(flat, np.frombuffer("OolI".encode("utf-32-le"), np.uint32))
    run_a, run_b = _runs(plain | look | (_letters()[flat] > 0))
    if len(run_a):
        sums = [np.append(0, np.cumsum(x, dtype=np.int64)) for x in (plain, look)]
        n_plain, n_look = (s[run_b] - s[run_a] for s in sums)
        good = (n_plain > 0) & (n_look > 0) & (n_plain + n_look == run_b - run_a)
        inside = K.cover(run_a[good], run_b[good], len(flat)) & look
        if inside.any():
            flat = flat.copy()
            flat[inside & (flat == 79) | inside & (flat == 111)] = 48
            flat[inside & (flat == 108) | inside & (flat == 73)] = 49
            plain, odd = plain | inside, odd | inside
    spelled = role == 1
    at = np.flatnonzero(plain)
    a, b = np.concatenate([at, starts[spelled]]), np.concatenate([at + 1, ends[spelled]])
    rewritten = np.concatenate([odd[at], np.ones(int(spelled.sum()), bool)])
    order = np.argsort(a, kind="stable")
    a, b, rewritten = a[order], b[order], rewritten[order]
    if len(a) < 4:
        return
    doc = np.searchsorted(doc_starts, a, "right")
    first = np.flatnonzero(np.append(True, (a[1:] - b[:-1] > NEAR) | (doc[1:] != doc[:-1])))
    last = np.append(first[1:], len(a)) - 1
    # What else may be a disguise: words for dots and signs, brackets around a dot, odd and unseen characters.
    dots = np.flatnonzero(flat == 46)
    dots = dots[(dots > 0) & (dots + 1 < len(flat))]
    dots = dots[np.isin(flat[dots - 1], [40, 60, 91, 123, 32]) & np.isin(flat[dots + 1], [41, 62, 93, 125, 32])]
    signs = np.sort(np.concatenate([np.flatnonzero(odd), starts[role == 3], dots, np.flatnonzero(flat == 38)]))
    floor = np.maximum(a[first] - 12, doc_starts[doc[first] - 1])
    n_signs = np.searchsorted(signs, b[last]) - np.searchsorted(signs, floor)
    n_spelled = np.add.reduceat(rewritten.astype(np.int64), first)
    wanted = np.flatnonzero((last - first >= 3) & (n_signs + n_spelled > 0))
    letter, said = _letters(), starts[spelled]
    for g in wanted.tolist():
        lo, hi = int(floor[g]), int(b[last[g]])
        while 0 < lo < a[first[g]] and letter[flat[lo - 1]] and letter[flat[lo]]:
            lo += 1
        own = Rewritten(_NUMBER, _number, flat[lo:hi].tobytes().decode("utf-32-le"), lo)
        made = np.frombuffer(own.text.encode("utf-32-le"), np.uint32)
        for kind, found in (("ip", ips(made)), ("card", cards(made)), ("phone", phones(own.text))):
            for span in found:
                s, e = own.source(span)
                if text[s:e] == own.text[span[0] : span[1]]:
                    continue
                spoken = int(np.searchsorted(said, e) - np.searchsorted(said, s))
                if kind == "ip" or not 0 < spoken < 3:  # one or two such words beside digits are words
                    yield kind, s, e


def find(texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """Of each text its spans: start, kind (a place in KINDS), end, whether it is plain (found without a rewrite)."""
    text = "\x00".join(texts)
    doc_starts = np.cumsum([0, *(len(t) + 1 for t in texts)], dtype=np.int64)[:-1]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    base = [(emails(text)), ips(codes), cards(codes), phones(text)]
    flat = _table()[codes]
    words = _words(flat)
    read = text if text.isascii() or np.array_equal(flat, codes) else flat.tobytes().decode("utf-32-le", "surrogatepass")
    # Sites of an at: words, the sign, entities, and capitals inside a word.
    sites = [words[0][words[2] == 2], np.flatnonzero(flat == 64)]
    sites += [np.array([m.start() for m in re.finditer(_ENTITY_AT, read, re.IGNORECASE)], np.int64)] if "&" in read or "%40" in read else []
    sites += [np.array([m.start() for m in re.finditer("(?<=[a-z0-9])AT(?=[a-z0-9])", read)], np.int64)] if "DOT" in read else []
    at = np.sort(np.concatenate(sites).astype(np.int64))
    # A name stands before it and a label behind it, but for what a disguise puts between.
    floors = doc_starts[np.searchsorted(doc_starts, at, "right") - 1]
    hidden = {("email", *s) for s in _hidden_mails(read, text, zip(at.tolist(), floors.tolist(), strict=True))}
    numbers = sorted(s for spans in base[1:] for s in spans)
    starts = np.array([s for s, _ in numbers] or [len(text) + 1])
    ends = np.maximum.accumulate(np.array([e for _, e in numbers] or [len(text) + 1]))
    for kind, s, e in _hidden_numbers(codes, flat, text, words, doc_starts) if len(codes) else ():
        i = int(np.searchsorted(starts, e)) - 1
        if i < 0 or ends[i] <= s:  # what stands beside a plain number is not part of it
            hidden.add((kind, s, e))
    plain = {(kind, *s) for kind, spans in zip(KINDS, base, strict=True) for s in spans}
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    every = [(s, KINDS.index(k), e, (k, s, e) in plain) for k, s, e in plain | hidden]
    for (s, k, e, p), d in zip(every, (np.searchsorted(doc_starts, [x[0] for x in every], "right") - 1).tolist(), strict=True):
        low = int(doc_starts[d])
        out[d].append((s - low, k, e - low, p))
    for spans in out:
        spans.sort()
    return out


SPANS = "array<struct<kind: string, start: int, end: int, plain: boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())])


def scan(docs: DataFrame, *, text: str = "text", out: str = "spans") -> DataFrame:
    """All columns of docs and ``out``: the personal data of each text, by start, then kind as in KINDS.

    A span is (kind, start, end in code points, plain). Plain spans are those of the detectors on the text as it is;
    each stays. The others come from rewritten text and differ from what stands there: letters and digits of other
    alphabets or widths, unseen characters, O and l in numbers, spelled digits (English, Spanish, French, German; also
    double and triple), words, brackets, entities or spaces for at, dot and plus. The plain words at and dot prove an
    address only together, with a usual last label, or behind a name that is no word. Spelled digits make cards and
    phones from three on. A number that touches a plain one is not read anew.

    Null text: as empty, no spans. Texts of any length are read whole, in time that grows as the text does. Rows do not
    meet, repeated ones give repeated rows, null ids stay. A column named as ``out`` is replaced. Empty table: no rows.
    """
    rows = docs.drop(out)
    at = rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T._parse_datatype_string(SPANS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = K.flatten(batch.column(at))[1]
            for a, b in K.slices(offsets, STEP):
                part = batch.slice(a, b - a)
                found = find([t or "" for t in part.column(at).to_pylist()])
                flat = [s for spans in found for s in spans]
                fields = [pa.array([KINDS[k] for _, k, _, _ in flat], pa.string()), pa.array([s for s, *_ in flat], pa.int32()), pa.array([e for _, _, e, _ in flat], pa.int32()), pa.array([p for *_, p in flat], pa.bool_())]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(_SPAN)))
                yield pa.RecordBatch.from_arrays([*part.columns, spans], names=[*batch.schema.names, out])
        K.give_back()

    return rows.mapInArrow(run, schema)


def masked(docs: DataFrame, *, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs from ``scan`` with each text's spans (those that overlap as one) replaced by the kind in brackets."""
    one = F.coalesce(F.col(text), F.lit(""))
    step = lambda acc, s: F.struct(
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(one, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    whole = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(one, acc["at"] + 1, F.length(one))))
    return docs.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text)))


def listed(spans, kept=lambda s: F.lit(True)):
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(F.filter(spans, kept), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
