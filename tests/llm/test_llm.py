"""Each operator against a plain restatement, on small tables with the awkward cases."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import kernels as K
from corpusmill.llm import licenses, mixing, ngram_join, packing, quality, substring, suffix, topk, toxicity, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, lang string, chunk int, n int, kept string"


def _rows(seed=1, n=60):
    """Documents with copies, near copies, shared passages, ties, nulls, empty, very long and odd texts."""
    rng = np.random.default_rng(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["é", "ß", "中文", "A", "a", "#x", "B."]
    text = lambda k: " ".join(rng.choice(vocabulary, k))
    base = [text(int(k)) for k in rng.integers(0, 200, n)]
    passage = text(40)
    rows = []
    for i, t in enumerate(base):
        words = t.split(" ")
        if i % 5 == 1:
            t = base[i - 1]
        elif i % 5 == 2 and len(words) > 30:
            words[3] = "changed%d" % i
            t = " ".join(words[:25]) + "\n" + passage + "\t" + " ".join(words[25:])
        elif i % 5 == 3:
            near = base[i - 3].split(" ")
            if len(near) > 60:
                near[7] = "other%d" % i
            t = " ".join(near)
        elif i % 5 == 4:
            t = passage + " " + passage + " " + t
        rows.append((int(i * 7 % (n + 1)), t))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "one two"), (1005, "x" * 3000), (1006, "x" * 3000 + "y")]
    rows += [(1007, text(6000)), (1008, ("ab " * 70).strip()), (1009, "ONE two"), (1010, "\x00 nul\x00 " * 30)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "s%d" % (i % 3), None, 1, 2, "k") for i, (d, t) in enumerate(rows)], SCHEMA).repartition(3)


def test_substring(spark):
    rows = [*_rows(), (None, _rows()[4][1]), (None, "solo " * 30)]
    got = substring.dedup(_frame(spark, rows)).collect()
    assert "n" in got[0].asDict() and got[0]["chunk"] == 1
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted((-1 if d is None else d, *x) for d, *x in brute.substring(rows))


def test_substring_leaves_clean_texts_whole(spark):
    rows = [(1, "a  b\n c"), (2, " ".join(f"w{i}" for i in range(30))), (3, "x  y " + " ".join(f"w{i}" for i in range(20)))]
    got = {r.doc_id: r.kept for r in substring.dedup(_frame(spark, rows), whole=True).collect()}
    assert got == {1: "a  b\n c", 2: rows[1][1], 3: "x y"}


def test_substring_repeated_rows(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(30)))] * 3
    assert [r.n_removed for r in substring.dedup(_frame(spark, rows)).collect()] == [0, 0, 0]


def _thue_morse(n=1024):
    """Two words that polynomial hashes modulo powers of two cannot tell apart."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_of_thue_morse_words():
    for n in (8, 64, 1024, 1 << 17):
        data = np.frombuffer("".join(_thue_morse(n)).encode(), np.uint8)
        a, b = K.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
    own = quality.statistics(data, np.array([0, len(data)]))
    text = "\n".join(_thue_morse())
    data = np.frombuffer(text.encode(), np.uint8)
    own = quality.statistics(data, np.array([0, len(data)]))
    assert own["n_dup_lines"].tolist() == [0] and own["n_distinct"].tolist() == [2]


def _repeated():
    w, u, v = (" ".join(f"{x}{i}" for i in range(30)) for x in "wuv")
    return [(1, w), (2, w), (2, u), (3, u), (4, v), (4, w), (5, u + " " + v), (2, w), (6, " \n "), (7, " \n "), (7, u), (None, u), (None, u)]


def test_repeated_ids_with_different_texts(spark):
    rows = _repeated()
    got = substring.dedup(_frame(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted((-1 if d is None else d, *x) for d, *x in brute.substring(rows))
    for hot in (suffix.HOT, 0):
        got = suffix.dedup(_frame(spark, rows), width=40, hot=hot).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((-1 if d is None else d, *x) for d, *x in brute.suffix(rows, 40))
    got = ngram_join.join(_frame(spark, rows)).collect()
    # 1 and 2 share w, 4 has w too, 2 and 3 share u, and so has 7: one component.
    want = [(1, 26, 1), (2, 26, 1), (2, 26, 1), (2, 26, 1), (3, 26, 1), (4, 26, 1), (4, 26, 1), (5, 56, 5), (6, 0, 6), (7, 0, 7), (7, 26, 1), (-1, 26, -1), (-1, 26, -1)]
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted(want)


def test_dedup_of_empty_tables(spark):
    none = _frame(spark, [(1, "x")]).limit(0)
    assert [x.count() for x in (substring.dedup(none), suffix.dedup(none), ngram_join.join(none), licenses.scan(none))] == [0] * 4


@pytest.mark.parametrize("hot", [suffix.HOT, 3, 0])
def test_suffix(spark, hot):
    rows = [*_rows(2), (None, _rows(2)[4][1] * 3)]
    rows += [(2000 + i, f"{i} before {'common passage of some eighty letters that many texts hold, in other places too'} {i * 7} behind") for i in range(12)]
    got = suffix.dedup(_frame(spark, rows), width=40, hot=hot).collect()
    want = brute.suffix(rows, 40)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((-1 if d is None else d, *x) for d, *x in want)


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    parts = [rng.integers(1, letters + 1, k) for k in rng.integers(1, 60, 25)]
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint8)
    zero = np.flatnonzero(text == 0)
    key = lambda i: [*[(int(c), 0) for c in text[i : zero[np.searchsorted(zero, i)]]], (0, int(np.searchsorted(zero, i)))]
    order = suffix.suffix_array(text, max(map(len, parts)))
    assert order.tolist() == sorted(range(len(text)), key=key)
    shared = suffix.common_prefixes(text, order, 8)
    for i in range(1, len(order)):
        a, b = text[order[i - 1] :][:8], text[order[i] :][:8]
        assert shared[i] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


@pytest.mark.parametrize("tile", [ngram_join.TILE, 300])
def test_ngram_join(spark, tile):
    rows = _rows(3, 80)
    original = " ".join(f"t{i}" for i in range(60))
    for i in range(40):  # a large group of near copies and, among them, of copies of near copies
        words = original.split(" ")
        words[i % 60] = f"e{i // 2}"
        rows.append((2000 + i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(_frame(spark, rows), tile=tile).collect()}
    assert got == brute.jaccard(rows)


def test_ngram_join_null_ids(spark):
    got = ngram_join.join(_frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (3, 3)]


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(230)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0]), (340, [float("nan")] * 5), (360, [float("inf")] * 5), (380, []), (None, [1.0] * 5), (400, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name, value in (("SHARD", 7), ("TILE", 3), ("STEP", 2), ("LEAST", 1), ("PARTS", 1)):
        monkeypatch.setattr(topk, name, value)
    got = topk.search(frame, F.col("id") % 20 == 0, k=6).collect()
    good = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows[:230]}
    want = []
    for q in range(0, 230, 20):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:6]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    assert topk.search(frame.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("shard", [7, 1000])
def test_topk_repeated_queries(spark, monkeypatch, shard):
    rng = np.random.default_rng(13)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(60)]
    rows += [rows[0], rows[20], rows[20], (40, [3.0, -3.0, 3.0, -3.0, 3.0]), rows[7]]
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "LEAST", 1)
    monkeypatch.setattr(topk, "PARTS", 1)
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0, k=6).collect()
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for q in (0, 20, 40):  # as the SQL: all pairs of a query id, cut to k
        pairs = sorted((-int(a @ v), i) for o, a in whole if o == q for i, v in whole if i != q)[:6]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(pairs, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_topk_large_components(spark):
    rows = [(i, [i % 3 / 64, -1 / 64, i % 5 / 64]) for i in range(30)] + [(40, [1e16, 1.0, 2.0]), (41, [3 / 64, -3 / 64, 3e7]), (60, [1.0, -1e16, -1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=6).collect()
    exact = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 20, 40, 60):
        best = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)[:6]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    with pytest.raises(Exception, match="64-bit integer"):
        topk.search(spark.createDataFrame([(0, [1e16]), (1, [1e16])], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    with pytest.raises(Exception, match="64-bit integer"):
        topk.search(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()


def test_mixing(spark):
    rows = [(i, "w " * (i % 40)) for i in range(300)] + [(None, "a b"), (900, None)]
    frame = spark.createDataFrame([(d, t, None if i % 7 == 6 else "s%d" % (i % 7)) for i, (d, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.plan(frame).collect()
    assert len(got) == len(rows) and all(0 <= r.mix_taken <= 2 * r.mix_size for r in got)
    by = {}
    for r in got:
        own = by.setdefault(r.source, [0, 0, r.mix_target, r.mix_source_size])
        own[0] += r.mix_size
        own[1] += r.mix_taken
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([by[s][0] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    assert sum(want) == pytest.approx(1.5 * sum(v[0] for v in by.values()))
    for s, w in zip(names, want, strict=True):
        assert by[s][2] == pytest.approx(w) and by[s][3] == by[s][0] and abs(by[s][1] - w) <= 1
    again = mixing.plan(frame.repartition(7)).collect()
    assert sorted(str((r.doc_id, r.mix_taken)) for r in got) == sorted(str((r.doc_id, r.mix_taken)) for r in again)
    drawn = mixing.mix(frame, whole=True).collect()
    assert {r.mix_words for r in drawn if r.doc_id == 39} <= {39}
    clash = frame.selectExpr("*", "1 AS sid", "2 AS blocks", "3 AS mix_size", "4 AS row", "5 AS key", "6 AS mix_draw")
    assert sorted(str((r.doc_id, r.mix_taken, r.sid, r.row)) for r in mixing.plan(clash).collect()) == sorted(str((r.doc_id, r.mix_taken, 1, 4)) for r in got)
    assert mixing.mix(clash).columns == [*frame.columns, "sid", "blocks", "row", "key", "mix_draw", "mix_shard", "mix_epoch", "mix_words", "mix_place"]
    assert mixing.plan(frame.limit(0)).count() == 0


def test_split_tree():
    quotas, spare = np.array([17, 0, 40, 3]), np.array([3, 0, 0, 9])
    tree = mixing.Tree(quotas, spare, 7, 5)
    leaves = [tree.leaf(i) for i in range(7)]
    dealt = np.stack([x[1] for x in leaves])
    assert dealt.sum(axis=0).tolist() == quotas.tolist() and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 3
    for f in range(4):  # disjoint places, all of them
        places = [p for start, own, rest in leaves for p in range(start[f], start[f] + own[f] + rest[f])]
        assert sorted(places) == list(range(quotas[f] + spare[f]))
    for i in (6, 0, 3):  # any shard alone
        assert all((a == b).all() for a, b in zip(mixing.Tree(quotas, spare, 7, 5).leaf(i), leaves[i], strict=True))


def test_split_tree_is_hypergeometric():
    left = np.array([mixing.Tree(np.array([30, 10]), np.zeros(2), 2, seed).leaf(0)[1] for seed in range(400)])
    assert (left.sum(axis=1) == 20).all() and abs(left[:, 0].mean() - 15) < 0.3
    assert abs(left[:, 0].var() - 20 * 0.75 * 0.25 * 20 / 39) < 0.5


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permuted(n):
    a, b = (mixing.permuted(np.arange(n), n, key) for key in ([1, 2], [1, 3]))
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 17 or (a != b).any())


def test_mixing_by_brute_force(spark, monkeypatch):
    """Every rule of the contract on many small blocks, from counts and targets that are worked out here."""
    monkeypatch.setattr(mixing, "UNIT", 40)
    monkeypatch.setattr(mixing, "BLOCKS_A_SHARD", 6)
    rng = np.random.default_rng(16)
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(0, 30, 700), rng.choice(["a", "b", "c", "Z", None], 700, p=[0.6, 0.2, 0.1, 0.06, 0.04]), strict=True))]
    rows += [(None, "x y", "a"), (None, "x y", "a"), (5, "q " * 500, "b"), (800, None, "b"), (801, "", "empty")]
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = ["Z", "a", "b", "c", "empty", None]
    weight = dict(zip(order, (3, 1, 2, 3, 1, 2), strict=True))
    due, left, open_ = {}, 1.5 * sum(size.values()), list(order)
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * size[s]]
        if not over:
            break
        for s in over:
            due[s] = 2 * size[s]
        left -= sum(due[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    due |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.taken(frame.withColumn("mix_words", F.lit(1))).collect()
    total = {}
    for r in mixing.plan(frame).collect():
        assert r.mix_source_size == size[r.source] and r.mix_target == pytest.approx(due[r.source])
        total[r.source] = total.get(r.source, 0) + r.mix_taken
        assert r.mix_taken <= 2 * r.mix_size and len({d.epoch for d in r.mix_draws}) == len(r.mix_draws)
    assert all(abs(total[s] - due[s]) <= 2 for s in order)
    assert len(got) == len(rows)
    mixed = mixing.mix(frame).collect()
    own = {}
    for r in mixed:
        own.setdefault(r.mix_shard, []).append(r)
    assert len(own) > 10 and max(sum(r.mix_words for r in v) for v in own.values()) < 6 * 40 * 6
    for v in own.values():  # places are 1, 2, ... and not in the order of ids
        assert sorted(r.mix_place for r in v) == list(range(1, len(v) + 1))
    ordered = [r.doc_id or 0 for r in sorted(mixed, key=lambda r: (r.mix_shard, r.mix_place))]
    assert ordered != sorted(ordered)
    # also where nobody reads the places: rows come shard by shard, in the shards' order
    bare = mixing.mix(frame).select("doc_id", "mix_shard").collect()
    by_shard = {}
    for r in bare:
        by_shard.setdefault(r.mix_shard, []).append(r.doc_id)
    assert by_shard == {k: [r.doc_id for r in sorted(v, key=lambda r: r.mix_place)] for k, v in own.items()}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.mix_words
    by = {}
    for r in got:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.mix_taken
        assert len(r.mix_places) == len(r.mix_draws)
    assert {d: n for d, n in by.items() if n} == {d: n for d, n in taken.items() if n}


def test_mixing_follows_the_tree(spark, monkeypatch):
    """Other quotas of the shards draw other documents."""
    monkeypatch.setattr(mixing, "UNIT", 40)
    monkeypatch.setattr(mixing, "BLOCKS_A_SHARD", 6)
    frame = spark.createDataFrame([(i, "w " * (i % 40), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    a = {r.doc_id: r.mix_taken for r in mixing.plan(frame).collect()}
    monkeypatch.setattr(mixing, "BLOCKS_A_SHARD", 1 << 20)
    b = {r.doc_id: r.mix_taken for r in mixing.plan(frame).collect()}
    assert a != b


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*_rows(5), (1, "again 's  it's 12,345 \n\n x y <|endoftext|> 😀 "), (None, "no id"), (1200, " ".join(f"n{i}" for i in range(3000)))]
    rows += [(1300, "x" + " " * 1_000_000 + "y"), (1301, "\n" * 1_000_000), (1302, "a <|endoftext|> b"), (1302, "a <|endoftext|> b"), (1303, "\u3000" * 5000 + "z" * 100_000)]
    saved, packing.GROUP_ITEMS, packing.FAN_IN = (packing.GROUP_ITEMS, packing.FAN_IN), 7, 3
    try:
        got = packing.pack(_frame(spark, rows), path, most=256).collect()
        assert packing.pack(_frame(spark, rows).limit(0), path).count() == 0
    finally:
        packing.GROUP_ITEMS, packing.FAN_IN = saved
    t = Tokenizer.from_file(path)
    want = []
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 256 or 256
        cuts = [0, *range(head, len(ids) + 1, 256)]
        want += [(-1 if d is None else d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) * 1.1 + 2


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, t = packing.Encoder(path), Tokenizer.from_file(path)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(15)
    tokens = [t.decode([i]) for i in range(50_256)]
    texts = ["".join(f"a{c}1{c}{c}! {c}a  {c}\n" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    texts += ["".join(tokens[i] for i in rng.integers(0, 50_256, 200)) for _ in range(500)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "x" + " " * 200_000 + "y"]
    for text in texts:
        assert fast.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert fast.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_best_fit():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 101, 500)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and max(sizes[b].sum() for b in bins) <= 100
    assert len(bins) <= sizes.sum() / 100 * 1.1 + 1


def test_warc(spark):
    import base64
    import hashlib

    rows = [(1, "u", "<a>"), (2, None, "<a>"), (3, "x\r\ny", None), (4, "u", ""), (5, "u", "é" * 10), (None, "u", "<a>"), (7, "u", "z" * 100_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(frame).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [(i, got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, None)] == [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (None, "revisit", 1)]
    few = {r.page_id: r.record_type for r in warc.round_trip(frame, least=5).collect()}
    assert few[2] == "response"
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PER_SHELF", 3)
    rows = [(1, "http://a/", "<p>é</p>"), (2, "b\r\nc", ""), (2, "b\r\nc", ""), (None, None, None)] + [(10 + i, f"u{i}", "same " * 9) for i in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS payload", "3 AS shelf", "4 AS header")
    warc.write_archive(frame, f"file://{tmp_path}/a", date="2026-01-02T03:04:05Z")
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 3
    got = warc.read_archive(spark, f"file://{tmp_path}/a").collect()
    assert len(got) == len(rows)
    for r in got:
        url, html = next((u, h) for i, u, h in rows if i == r.page_id)
        data = (html or "").encode()
        head = f"WARC/1.1\r\nWARC-Type: {r.record_type}\r\nWARC-Record-ID: <urn:page:{'' if r.page_id is None else r.page_id}>\r\nWARC-Date: 2026-01-02T03:04:05Z\r\n"
        assert bytes(r.record).startswith(head.encode()) and bytes(r.record).endswith(b"\r\n\r\n" + data + b"\r\n\r\n")
        assert bytes(r.payload) == data and r.payload_bytes == len(data) and f"Content-Length: {len(data)}\r\n\r\n".encode() in bytes(r.record)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (2, "response", None), (None, "revisit", 2), (10, "response", None), *((10 + i, "revisit", 10) for i in range(1, 20))}
    warc.read_archive(spark, f"file://{tmp_path}/a").select("payload_digest", F.lit(1)).collect()
    damaged = spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    damaged.write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archive(spark, f"file://{tmp_path}/b").collect()


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. X. The above copyright notice and this permission notice shall be included in all copies."
    rows = [(1, "Released under the MIT License."), (2, mit), (3, None), (4, ""), (5, "no licence, but the word license."), (6, "Licensed under CC BY-NC 4.0.\n" + mit), (7, "Released under the MIT License. " * 3000)]
    got = {r.doc_id: r for r in licenses.scan(_frame(spark, rows)).collect()}
    assert got[1].license == "MIT" and got[2].sentence_ids == "mit_grant,mit_keep" and got[2].licenses == "MIT"
    assert got[3].n_sentences == 0 and got[4].license is None and got[5].licenses == ""
    assert got[6].licenses == "CC-BY-NC-4.0,MIT" and got[6].kind == "noncommercial" and got[7].n_sentences == 3000
    plan = licenses.scan(_frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_verbatim(spark):
    mit = """MIT License

Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
    bsd = """Copyright (c) 2009, {who}
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
"""
    names = "   * Neither the name of {who} nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"
    apache = """Copyright 2020 Some One. All rights reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
    gpl3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY.
"""
    gpl2 = gpl3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
    lgpl = gpl2.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    hashes = lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines())
    stars = lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\r\n" for x in t.splitlines()) + " */\nint x;\n"
    slashes = lambda t: "".join(f"//\t{x}\n" for x in t.splitlines()) + "package x\n"
    texts = {"MIT": mit, "BSD-2-Clause": bsd.format(who="Some One"), "BSD-3-Clause": (bsd + names).format(who="the University of\nSomewhere"), "Apache-2.0": apache, "GPL-3.0": gpl3, "GPL-2.0": gpl2, "LGPL-2.1": lgpl, "AGPL-3.0": gpl3.replace("GNU General", "GNU Affero General"), "MPL-2.0": mpl}
    texts["CC-BY-NC-SA-4.0"] = "This work is licensed under a\nCreative Commons Attribution-NonCommercial-ShareAlike 4.0\nInternational License."
    cases = [(name, wrap(t)) for name, t in texts.items() for wrap in (str, hashes, stars, slashes)]
    cases += [("BSD-3-Clause", (bsd + names).format(who="Google Inc.")), ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n"), ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n")]
    cases += [("", "All rights\n\nreserved."), ("", "We met Permission is hereby granted"), ("MIT,Apache-2.0", mit + "\n" + apache)]
    got = {r.doc_id: r.licenses for r in licenses.scan(_frame(spark, [(i, t) for i, (_, t) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_licenses_tags(spark):
    cases = [
        ("MIT", "// SPDX-License-Identifier: MIT\nint x;"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\n"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
        ("MIT,Apache-2.0", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nx = 1"), ("GPL-3.0", "SPDX-License-Identifier:\tGPL-3.0-or-later"), ("", "SPDX-License-Identifier: Own-1.0"),
        ("BSD-3-Clause,MIT,ISC,Zlib", " * SPDX-License-Identifier: BSD-3-Clause AND MIT AND ISC AND Zlib\n"), ("", "spdx-license-identifier"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(_frame(spark, [(i, t) for i, (_, t) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_licenses_more_notices(spark):
    cases = [
        ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented."),
        ("EPL-2.0", "/*\n * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/\n */"),
        ("EPL-2.0", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM"),
        ("BSL-1.0", "//          Copyright Joe Coder 2004 - 2006.\n// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt)"),
        ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted"),
        # A sentence that hides in the lines of a longer one does not count beside it.
        ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either\nversion 2 of the License\nor at your option any later version."),
        ("MIT", "-- /*** Released under the MIT License. ***/"), ("MIT", "# # # released under the mit license"), ("MIT", "rem Released under the MIT License"), ("MIT", "<!-- Released under the MIT License -->"), ("", "x /* Released under the MIT License"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(_frame(spark, [(i, t) for i, (_, t) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_licenses_long_runs(spark):
    import time

    runs = ["x" + " " * 10**6 + "y", "." * 10**6 + "x", "# " * 10**6, "-" * 10**6 + "x", "\n" * 10**6 + "x", " \n" * 10**6, "*/ " * 10**6, "-->  " * 10**5, "permission " * 10**5, "the\n" * 10**4, "neither the name of " * 10**4, "\"'" * 10**6, "\r" * 10**6]
    began = time.time()
    got = licenses.scan(_frame(spark, [(i, text + "\n\nReleased under the MIT License.") for i, text in enumerate(runs)])).collect()
    assert [r.license for r in got] == ["MIT"] * len(runs) and time.time() - began < 120
    tags = licenses.scan(_frame(spark, [(1, "spdx-license-identifier: mit or " * 10**4)])).first()
    assert tags.licenses == "MIT"


def test_licenses_hint(spark):
    texts = ["All rights  reserved.", "All rights\treserved.", "All rights res\"erved.", "This program is \"free\" software.", "This is free and unencumbered software released into the public  domain."]
    got = {r.doc_id: r.n_sentences for r in licenses.scan(_frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict.fromkeys(range(len(texts)), 1)


def test_quality_statistics(spark):
    rows = [*_rows(7), (None, "a\na\nb \n\na"), (5000, "x y z " * 40)]
    frame = _frame(spark, rows)
    labels = spark.createDataFrame([(d, int(i % 3 > 0)) for i, (d, _) in enumerate(rows[:60])], "doc_id long, quality int")
    got = quality.score(frame, quality.fit(frame, labels)).collect()
    want = sorted((-1 if d is None else d, *brute.statistics(t)) for d, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.score(frame.limit(0), quality.fit(frame.limit(0), labels)).count() == 0


def test_quality_verdict_by_brute_force(spark):
    """Features from plain counts, trees walked node by node, and the verdict, on rows that nothing was fitted on too."""
    rng = np.random.default_rng(18)
    rows = []
    for i in range(300):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        if i % 3 == 0:
            words = [w.upper() + "!!" if rng.random() < 0.4 else w for w in words]
        rows.append((i, " ".join(words) + (".\nend of it\n" if i % 2 else "")))
    rows += [(1000, None), (1001, "A! " * 30), (1002, "short"), (1003, "x\n" * 40), (1001, "A! " * 30)]
    frame = _frame(spark, rows).selectExpr("*", "1 AS n_words", "2 AS score", "3 AS label", "4 AS l_id", "5 AS base_failed")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(frame, labels)

    def features(t):
        n_words, word_chars, n_symbols, n_dup, n_repeat = brute.statistics(t)
        t = t or ""
        words = brute.WORD.findall(t)
        n_lines = sum(bool(brute.WORD.search(x)) for x in t.split("\n"))
        letters = sum(c.isascii() and c.isalpha() for c in t)
        share = lambda a, b: a / max(1, b)
        return [
            share(word_chars, n_words), share(n_symbols, n_words), share(sum(any(c in "#*$%&|<>" for c in w) for w in words), n_words), share(n_dup, n_lines), share(n_repeat, n_words),
            share(sum("A" <= c <= "Z" for c in t), letters), share(sum("0" <= c <= "9" for c in t), word_chars), share(t.count("!"), n_words), share(sum(c in ".,;:?" for c in t), n_words),
            share(n_words, n_lines), share(len(set(words)), n_words),
        ]

    def walk(x):
        raw = model.base
        for at in model.roots.tolist():
            while model.feature[at] >= 0:
                at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
            raw += model.value[at]
        return 1 / (1 + math.exp(-raw))

    assert len(model.roots) == 60 and [f[0] for f in quality.FEATURES][5] == "upper"
    got = sorted(quality.score(frame, model).collect(), key=lambda r: r.doc_id)
    right = 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        n_words, _, _, _, n_repeat = brute.statistics(t)
        failed = n_words < 20 or 100 * n_repeat > 30 * n_words
        score = walk(features(t))
        assert r.doc_id == d and r.score == pytest.approx(score, abs=1e-9) and r.base_failed == failed and r.kept == (not failed and r.score >= 0.5)
        right += d < 300 and d % 2 == 1 and (r.score >= 0.5) == (d % 3 > 0)
    assert right > 140  # of 150 rows that have no label


def test_clashing_columns_and_repeated_rows(spark):
    """Columns that operators name themselves, and rows that stand twice, change no result."""
    import public_tokenizers

    rows = [(i, f"Released under the MIT License. {'word ' * i}{i}") for i in range(25)] + [(None, None), (30, "")]
    plain = _frame(spark, rows)
    clash = plain.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(("row", "key", "size", "n_sentences", "licenses", "hits", "piece", "start", "sequence_id", "d_id", "d_text", "c_0", "tokens", "gp", "component_id", "n_removed", "digest"))])
    path = public_tokenizers.path("byte_bpe_50k.json")
    ops = {
        "licenses": lambda d: licenses.scan(d), "packing": lambda d: packing.pack(d, path).select("doc_id", "piece", "start", "length", "ids_crc32"), "ngram": lambda d: ngram_join.join(d),
        "substring": lambda d: substring.dedup(d, carry=[]), "suffix": lambda d: suffix.dedup(d, carry=[]),
    }
    for name, op in ops.items():
        want = sorted(map(str, op(plain).collect()))
        assert sorted(map(str, op(clash).collect())) == want, name
        if name in ("licenses", "packing"):  # no rows meet
            assert sorted(map(str, op(clash.union(clash)).collect())) == sorted(want * 2), name
    carried = substring.dedup(clash).first().asDict()
    assert carried["row"] == 0 and carried["c_0"] == 11 and carried["digest"] == 16 and substring.dedup(clash).columns.count("n_removed") == 1


def test_trees_are_monotonic():
    rng = np.random.default_rng(8)
    x = rng.random((2000, len(quality.FEATURES)))
    y = (x[:, 1] + 0.3 * rng.random(2000) + 0.4 * np.sin(9 * x[:, 1]) < 0.7).astype(float)
    model = quality.Trees().fit(x, y, [f[3] for f in quality.FEATURES])
    assert ((model.score(x) > 0.5) == y).mean() > 0.8
    for f in [i for i, f in enumerate(quality.FEATURES) if f[3]]:
        grid = np.repeat(rng.random((20, x.shape[1])), 50, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 50), 20)
        assert (np.diff(model.score(grid).reshape(20, 50), axis=1) <= 1e-12).all()


def test_toxicity(spark):
    rng = np.random.default_rng(9)
    bad = ["vilest", "gnarl", "rotten", "grubby"]
    rows, marks = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.zipf(1.3, 60) % 500]
        toxic = i % 6 == 0
        if toxic:
            for w in rng.choice(bad, 2):
                words[int(rng.integers(60))] = str(w)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "rotten " * 5), (1002, "rotten gnarl " * 20_000)]
    frame, labels = _frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    index, names = toxicity.fit(frame, labels.filter(~toxicity.held_out()))
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in names)
    got = {r.doc_id: r for r in toxicity.score(frame, index, names).collect()}
    held = [(i, t) for i, t in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i].score >= 0.3) == (t == 1) for i, t in held) / len(held) > 0.95
    assert got[1000].score == got[1001].score < 0.3 <= got[1002].score and got[None].score > 0.3 and got[1000].evidence == []
    # Calibrated on rows apart: scores are near the shares that they promise, on rows that nothing was learnt from.
    mean = sum(got[i].score for i, _ in held) / len(held)
    assert abs(mean - sum(t for _, t in held) / len(held)) < 0.08
    # Every text with words has evidence, clean ones too; no evidence is held out, and none calibrates.
    assert all(got[i].evidence for i, _ in held) and {e for r in got.values() for e in r.evidence} <= set(names)
    none, no_names = toxicity.fit(frame, labels.limit(0))
    assert {r.score for r in toxicity.score(frame, none, no_names, carry=True).collect()} == {0.0}
    clash = frame.selectExpr("*", "1 AS score", "2 AS evidence", "3 AS toxic", "4 AS l_id")
    carried = toxicity.score(clash, index, names, carry=True)
    assert carried.columns == [*frame.columns, "toxic", "l_id", "score", "evidence"] and carried.filter("score > 1 OR toxic <> 3 OR l_id <> 4").count() == 0
    assert toxicity.score(frame.limit(0), index, names).count() == 0
    twice = toxicity.score(frame.union(frame), index, names).collect()
    assert len(twice) == 2 * len(rows) and all(r.score == got[r.doc_id].score for r in twice)


def test_toxicity_by_brute_force(spark):
    """Scores and evidence against dense vectors, made here from words and stems."""
    rng = np.random.default_rng(17)
    words = [f"word{i}" for i in range(300)] + ["it", "of"]
    # Odd rows have words of their own, which no example has.
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 30)))).upper() + (" foulest" if i % 7 == 0 else "") + " ".join(f" own{i}x{j} own{i}x{j}" for j in range(i % 5 if i % 2 else 0))) for i in range(300)]
    labels = [(i, int(i % 7 == 0)) for i in range(0, 300, 2)]
    frame = _frame(spark, rows)
    index, names = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))

    def terms(text):
        out = {}
        for w in text.lower().split():
            for t in (w, *((n, w[:n]) for n in (4, 5, 6) if len(w) > n)):
                out[t] = out.get(t, 0) + 1
        return out

    bags = {d: terms(t) for d, t in rows}
    marks = dict(labels)
    space = {t for d in names for t in bags[d]}
    assert len(space) == len(index.vocabulary) and set(names) < set(marks)
    df = {t: sum(t in b for b in bags.values()) for t in space}
    learnt, seen = [], set()
    for d in names:  # no near copies here but equal texts
        learnt.append(d)
    prior = sum(marks[d] for d in learnt) / len(learnt)
    log = lambda k, x: k * math.log(x) if k else 0.0

    def say(t):
        own = [marks[d] for d in learnt if t in bags[d]]
        k, n = sum(own), len(own)
        gain = log(k, k / n / prior if k else 1) + log(n - k, (n - k) / n / (1 - prior) if n > k else 1)
        return math.log((1 + len(rows)) / df[t]) * (1 + toxicity.GAIN * max(0.0, gain))

    says = {t: say(t) for t in space}

    def vector(d):
        v = {t: (1 + math.log(n)) * says.get(t, math.log(1 + len(rows))) for t, n in bags[d].items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {d: vector(d) for d in names}
    got = {r.doc_id: r for r in toxicity.score(frame, index, names).collect()}
    assert index.prior == pytest.approx(prior)
    for d, _ in rows[:120]:
        own = vector(d)
        cosine = {e: sum(x * v.get(t, 0.0) for t, x in own.items()) for e, v in vectors.items()}
        near = sorted((e for e in cosine if cosine[e] > 1e-12), key=lambda e: -cosine[e])[:15]
        votes = {e: cosine[e] / (1.05 - min(cosine[e], 1.0)) for e in near}
        share = (sum(v for e, v in votes.items() if marks[e]) + 0.05 * prior) / (sum(votes.values()) + 0.05) if near else prior / 2
        least = cosine[near[-1]] if near else 0
        assert {e for e in near if cosine[e] > least + 1e-9} <= set(got[d].evidence) and all(cosine[e] >= least - 1e-9 for e in got[d].evidence)
        assert got[d].score == pytest.approx(float(index.calibrated(np.array([share]))[0]), abs=0.02)


def test_unknown_words_lower_the_cosine(spark):
    rows = [(i, f"vile gnarl foul{i % 9}" if i % 2 else f"kind mild good{i % 9}") for i in range(200)] + [(900, "vile gnarl"), (901, "vile gnarl " + " ".join(f"x{i}" for i in range(3000))), (902, "kind mild")]
    frame = _frame(spark, rows)
    index, names = toxicity.fit(frame, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    text = {d: t for d, t in rows}
    share = lambda d: float(index.shares(np.frombuffer(text[d].encode(), np.uint8), np.array([0, len(text[d].encode())]), {})[0][0])
    got = {r.doc_id: r.score for r in toxicity.score(frame, index, names).filter("doc_id >= 900").collect()}
    assert share(900) > share(901) > share(902) and got[900] > got[901] > got[902]


def test_nearest_is_exact():
    rng = np.random.default_rng(10)
    vocabulary = np.sort(rng.integers(1, 1 << 49, 300).astype(np.uint64))
    of = rng.integers(0, 10, 700)
    order = np.argsort(of)  # ten themes, side by side
    rows = np.repeat(np.arange(700), 6)
    terms = np.concatenate([np.sort(30 * int(of[i]) + rng.choice(30, 6, replace=False)) for i in order])
    index = toxicity.Index(vocabulary, rng.random(300) + 0.5, rows, terms, rng.integers(1, 4, len(rows)), (rng.random(700) < 0.3).astype(float), 0.3)
    dense, postings = np.zeros((700, 300)), 0
    for t in range(300):
        for e in range(index.entry[t], index.entry[t + 1]):
            at = slice(index.post[e], index.post[e + 1])
            dense[index.rows[at], t] = index.weight[at]
            assert index.most[e] == index.weight[at].max() and (index.rows[at] // toxicity.BLOCK == index.block[e]).all()
    for _ in range(40):
        own = np.sort(np.append(rng.choice(30, 4, replace=False), rng.integers(30, 300)))
        w = index._weights(np.zeros(5, np.int64), own, np.ones(5), 1)
        all_ = dense[:, own] @ w
        postings += int((dense[:, own] > 0).sum())
        want = np.lexsort((np.arange(700), -np.round(all_, 12)))[:15]
        at, cosine = index.nearest(own, w, 15)
        assert at.tolist() == [i for i in want.tolist() if all_[i] > 0] and np.allclose(cosine, all_[at])
    assert index.read < 0.95 * postings  # blocks whose bound is too low are not read


def test_toxicity_reads_all_postings_where_bounds_spare_few(monkeypatch):
    """Bounds that spare little are no longer asked, and the nearest are the same."""
    rng = np.random.default_rng(12)
    rows, terms = np.repeat(np.arange(700), 6), np.concatenate([np.sort(rng.choice(300, 6, replace=False)) for _ in range(700)])
    make = lambda: toxicity.Index(np.arange(1, 301, dtype=np.uint64), np.ones(300), rows, terms, np.ones(len(rows)), np.zeros(700), 0.3)
    queries = [np.sort(rng.choice(300, 20, replace=False)) for _ in range(30)]
    bounded, free = make(), make()
    want = [bounded.nearest(q, np.full(20, 0.2), 15) for q in queries]
    monkeypatch.setattr(toxicity, "TRIED", 1)
    for q, (at, cosine) in zip(queries, want, strict=True):
        got = free.nearest(q, np.full(20, 0.2), 15)
        assert got[0].tolist() == at.tolist() and np.allclose(got[1], cosine)
    assert 2 * bounded.read > bounded.met and 0 < free.read < bounded.read / 10


def test_kernels():
    rng = np.random.default_rng(11)
    for v in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64)), np.arange(5, dtype=np.uint64)):
        assert (K.unpack_ints(K.pack_ints(v, rising=True)) == v).all()
    v = np.array([-5, 0, 1 << 62, -(1 << 62)])
    assert (K.unpack_ints(K.pack_ints(v)).view(np.int64) == v).all()
    assert K.unbundle(K.bundle(b"a", b"", b"ccc")) == [b"a", b"", b"ccc"]
    bits = rng.random(77) < 0.4
    assert (K.unpack_bits(K.pack_bits(bits), 77) == bits).all()


@pytest.mark.parametrize(("most", "seed"), [(2, 1), (10, 2), (1 << 20, 3)])
def test_components(spark, monkeypatch, most, seed):
    from corpusmill.llm import components as C
    from corpusmill.plans.storage import Scratch

    monkeypatch.setattr(C, "ONE_TASK", most)
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)]
    root = {}
    find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    frame = spark.createDataFrame(edges, "v long, root long").repartition(6)
    got = {r.v: r.root for r in C.components(frame, Scratch(spark, "test"), "t").collect()}
    assert got == {v: find(v) for v in list(root) if find(v) != v}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, "en" if i % 9 else None, f"s{i % 4}" if i % 11 else None, len(t or ""), i, "c") for i, (d, t) in enumerate(_rows(12, 100))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:50]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    alive = {r[0]: r[1] for r in rows}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        got = docs.collect()
        if i < 4:
            assert docs.columns == before.columns, name
        if name == "ngram_join":
            want = brute.jaccard(list(alive.items()))
            assert {r.doc_id for r in got} == {d for d, (_, c) in want.items() if c == d}
        if name == "substring_dedup":
            want = {d: (n, k, kept) for d, n, k, kept in brute.substring(list(alive.items()))}
            assert {r.doc_id: r.text for r in got} == {d: kept if k else alive[d] or "" for d, (n, k, kept) in want.items() if k < n or not n}
        if name == "mixing":
            assert {r.doc_id for r in got} <= set(alive) and all(r.text == alive[r.doc_id] for r in got)
        if name == "packing":
            assert sum(r.piece == 0 for r in got) == before.count()
        else:
            alive = {r.doc_id: r.text for r in got}


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """No rows; and rows that repeat, without ids, texts or sources: each stage gives what its docstring says."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, shard int"
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, None, None, None, None, "r", 1), (None, None, None, None, None, "r", 1), (1, text, "en", "s", 9, "r", 1), (1, text, "en", "s", 9, "r", 1), (None, text, "en", "s", 9, "r", 1), (2, "", "en", "s", 0, "r", 1)]
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, data in (("none", []), ("few", rows)):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = {}
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, docs, str(tmp_path))
            kept[stage] = out.collect()
            if stage in ("toxicity", "ngram_join", "substring_dedup"):
                docs = spark.createDataFrame(kept[stage], out.schema)
                assert docs.columns == spark.read.parquet(f"{tmp_path}/{name}").columns
        if not data:
            assert not any(kept.values())
        else:
            assert [len(kept[s]) for s in ("toxicity", "ngram_join")] == [6, 6]
            # the row without id loses all its words to document 1, and goes
            assert sorted(str(r.text)[:5] for r in kept["substring_dedup"]) == ["", "", "", "w0 w1", "w0 w1"]
            assert {r.row for r in kept["mixing"]} <= {"r"} and len(kept["packing"]) == 5
