"""Personal data: the plain detectors by regular expressions, disguises by literal spans."""

import random
import re
import time

import pytest

from corpusmill.llm import private, queries


def plain(t):
    """The contract's four expressions, word for word."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@pytest.mark.parametrize("letters", ["a1.@ -", "01.+() -@a", "0123456789 -", "1.2345@é", "+12 ().-x", "0.25"])
def test_plain_spans_by_expressions(letters):
    r = random.Random(letters)
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(3000)]
    for t, found in zip(texts, private.find(texts), strict=True):
        assert sorted((s, k, e) for s, k, e, p in found if p) == plain(t)


HIDDEN = [
    ("email", "hein.19 [at] mail5 [dot] example [dot] com"),
    ("email", "hein.19 at mail5 dot example dot com"),
    ("email", "hein.19(at)mail5.example.com"),
    ("email", "hein dot doe AT example DOT com"),
    ("email", "hein[.]19[@]mail5[.]example[.]com"),
    ("email", "hein.19 at mail5.example.com"),
    ("email", "hein.19 arroba example punto com"),
    ("email", "j\u043ehn@example.com"),
    ("email", "john@ex\u0430mple.c\u043em"),
    ("email", "john\uff20example\uff0ecom"),
    ("email", "j\u200bohn@exam\u200bple.com"),
    ("email", "john&#64;example&#46;com"),
    ("email", "johnATexampleDOTcom"),
    ("email", "john_at_example_dot_com"),
    ("email", "john @ example . com"),
    ("phone", "plus one five two three five five five one zero five five"),
    ("phone", "+1 (five two three) five five five one zero five five"),
    ("phone", "(plus) four nine double three zero one two three four five"),
    ("phone", "plus cuatro cuatro uno dos tres cuatro cinco seis siete ocho"),
    ("phone", "\uff0b1 (743) 555\u20133824"),
    ("card", "four one one one one one one one one one one one one one one one"),
    ("card", "4lll 1111 1111 1111"),
    ("card", "\uff14\uff11\uff11\uff11 1111 1111 1111"),
    ("card", "4111-1111-1111-one one one one"),
    ("ip", "192[.]168[.]1[.]10"),
    ("ip", "192 dot 168 dot 1 dot 10"),
    ("ip", "one nine two dot one six eight dot one dot one"),
    ("ip", "1O.0.0.1"),
    ("ip", "\u0661\u0669\u0662.\u0661\u0666\u0668.\u0661.\u0661"),
]


@pytest.mark.parametrize(("kind", "text"), HIDDEN)
def test_disguises(kind, text):
    before = "Reha thon \u00e9 for. "
    found = private.find(["x", before + text + " thedn, at ing. Es", ""])
    assert [(s, private.KINDS[k], e) for s, k, e, p in found[1] if not p] == [(len(before), kind, len(before) + len(text))]
    assert not found[0] and not found[2]


CLEAN = [
    "And at eraton. Then, look at the point. Meet at example.com today.", "one two three four", "+1 (743) 555-0216 un point", "un six un deux, six at sept dot huit",
    "Price 12 at 3.50 dot 7", "version 1.2.3 at 4", "a @ b", "4111 1111 1111 111 one", "\u043f\u0440\u0438\u0432\u0435\u0442 at \u0434\u043e\u043c", "Plus 10 000 un", "x@y.com one dot two", "\u00e9cole.19@mail.com",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_get_nothing_beside_plain_spans(text):
    assert [s for s in private.find([text])[0] if not s[3]] == []


@pytest.mark.parametrize("text", ["1" * 10**6, "1.1.1" * 10**5, "@" * 10**5, "a" * 10**6 + "@", "at dot " * 10**5, "x at y dot " * 10**5, " " * 10**6, "+1" + " " * 10**6, "one " * 10**5, "[at] " * 10**5, "1 - - one dot " * 10**5, "\u200b" * 10**6, "a dot " * 10**5 + "at x dot com", "1O" * 10**5])
def test_long_runs_take_time_as_they_are_long(text):
    began = time.time()
    private.find([text])
    assert time.time() - began < 15


ROWS = [(1, "a@b.co and 4111 1111 1111 1111"), (2, None), (3, ""), (None, "call +1 (743) 555-0216"), (1, "a@b.co and 4111 1111 1111 1111"), (4, "me [at] b [dot] org \U0001f600 10.0.0.1"), (5, "x " * 200_000 + "z@y.de")]


def test_scan_and_mask(spark):
    docs = spark.createDataFrame([(d, t, "s", [1]) for d, t in ROWS], "doc_id long, text string, spans string, start array<int>")
    rows = private.scan(docs)
    assert rows.columns == ["doc_id", "text", "start", "spans"]
    got = {(r.doc_id, r.text): [tuple(s) for s in r.spans] for r in rows.collect()}
    assert got[1, ROWS[0][1]] == [("email", 0, 6, True), ("card", 11, 30, True)]
    assert got[2, None] == [] and got[3, ""] == [] and got[None, ROWS[3][1]] == [("phone", 5, 22, True)]
    assert got[4, ROWS[5][1]] == [("email", 0, 19, False), ("ip", 22, 30, True)]
    assert got[5, ROWS[6][1]] == [("email", 400_000, 400_006, True)]
    hidden = {r.doc_id: r.text for r in private.masked(rows).collect()}
    assert hidden[1] == "[email] and [card]" and hidden[2] is None and hidden[4] == "[email] \U0001f600 [ip]" and hidden[5].endswith("x [email]")
    assert private.scan(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    import hashlib

    spark.createDataFrame([(d, t, "en") for d, t in ROWS], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op11_private"](spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t or "" for d, t in ROWS if d == r.doc_id)
        own = plain(text)
        names = ",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in own)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in own) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert set(names.split(",")) <= set(r.spans.split(","))
