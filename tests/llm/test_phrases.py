"""Collocations and centroids against plain restatements."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import centroids, phrases
from corpusmill.plans.storage import Scratch
from tests.llm.brute import lower_az


def collocations(rows, longest=4, least=30, covered=80, most=2000):
    """rows: (text, lang)"""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower_az(text or "")):
            ws = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    out = {}
    every = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in every.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(g == lang and len(v) > len(w) and 100 * b >= covered * a and inside(v) for (g, v), b in every.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((g, i + 1, p.decode(), -a, l, r, n[g], -s) for g, rs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rs)[:most]))


def _texts(seed=3, n=80):
    rng = np.random.default_rng(seed)
    vocabulary = ["w%d" % i for i in range(12)] + ["É", "A", "a", "\u4e2d", "#x", "z."]
    rows = []
    for i in range(n):
        words = rng.choice(vocabulary, int(rng.integers(0, 120)), p=np.arange(18, 0, -1) / 171)
        t = " ".join(words).replace("w3 w4", "w3, w4") + (" p q r s" * 3 + "\tp\nq" if i % 2 else "")
        rows.append((t, (None, "en", "de", "und")[i % 4]))
    return [*rows, (None, "en"), ("", "en"), (" \t\n.", None), ("only dots ... ", "fr"), ("k " * 500, "xx"), *[("same text here", "en")] * 40]


@pytest.mark.parametrize(("least", "longest", "most", "size"), [(30, 4, 2000, 4 << 20), (5, 4, 7, 300), (3, 5, 2000, 1), (2, 2, 2000, 1000), (12, 3, 2000, 700)])
def test_collocations(spark, monkeypatch, least, longest, most, size):
    monkeypatch.setattr(phrases, "SHARD_BYTES", size)
    monkeypatch.setattr(phrases, "RANKED", 50)
    rows = _texts()
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, shard int, phrase string").repartition(3)
    got = phrases.collocations(docs, least=least, longest=longest, most=most).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == collocations(rows, longest, least, 80, most)


def test_collocations_of_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_automaton_states():
    import pyarrow as pa

    text = "a b c a b d, b c a b c"
    _, names, counts, blob = phrases._shard(pa.array([text]), ["en"])
    assert (names, counts) == (["en"], [11])
    auto = phrases.Automaton(blob)
    for _ in range(3):
        auto.deepen(None)
    pieces = [p.split() for p in text.split(",")]
    want = Counter(" ".join(p[i : i + m]) for p in pieces for m in range(1, 5) for i in range(len(p) - m + 1))
    got = {}
    for level in range(1, 5):
        node, n = auto.phrases(level)
        got |= dict(zip(auto.texts(level, node), n.tolist(), strict=True))
    assert got == want
    # A state is a class of phrases with the same ends: "c a" and "c a b" do not end alike, "c a" and "b c a" do.
    longest = [auto.texts(d + 1, node) for d, (node, _) in enumerate(auto.states())]
    assert "c a" not in longest[1] and "b c a" in longest[2]
    assert sum(len(node) for node, _ in auto.states()) < len(want)


def lloyd(rows, k=8, rounds=10, dims=4, scale=1024):
    """rows: (id, vector) -> (id, cluster, distance, cluster_inertia, inertia, digest)"""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    if not c:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(v[d] for (_, v), o in zip(kept, own, strict=True) if o == j) // own.count(j) for d in range(dims)] if j in own else x for j, x in enumerate(c)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, o, d in got if o == j) for j in range(len(c))}
    return sorted((-1 if i is None else i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got)


def _check(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(3)
    got = centroids.cluster(frame, dims=4, **options).collect()
    want = lloyd(rows, **options)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == want


def test_centroids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) + i % 5]) for i in range(300)]
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [float("inf")] * 4), (None, [0.5, -0.5, 0.1, 9.0]), (7, rows[7][1]), (7, rows[8][1])]
    _check(spark, rows + odd)
    _check(spark, rows[:3] + odd, k=8)
    _check(spark, rows, k=40, rounds=3)
    _check(spark, odd[:5])
    _check(spark, [(None, [1.0, 2.0, 3.0, 4.0])])


def test_centroids_with_ties_and_repeated_rows(spark):
    # All on a ring: every centroid has the same norm, so that each annulus holds them all, and many distances tie.
    ring = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0], [0.0, -1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]]
    _check(spark, [(i, ring[i % 5]) for i in range(100)], k=6)
    _check(spark, [(5, ring[0])] * 30, k=3)


def test_annuli_compare_few_and_exactly():
    rng = np.random.default_rng(2)
    found = rng.integers(-50, 50, (64, 3)) * np.geomspace(1, 1e6, 64)[:, None].astype(np.int64)
    vectors = rng.integers(-50, 50, (500, 3)) * np.geomspace(1, 1e6, 500)[:, None].astype(np.int64)
    annuli = centroids.Annuli(found.tolist())
    number, gap = annuli.nearest(vectors)
    every = ((vectors[:, None, :] - found[None]) ** 2).sum(axis=2)
    assert number.tolist() == every.argmin(axis=1).tolist() and gap.tolist() == every.min(axis=1).tolist()
    assert annuli.compared < 0.6 * every.size


def test_distances_beyond_64_bits():
    big = np.array([[1 << 40, 3]]), np.array([[-(1 << 29), 5]])
    assert centroids.squared(np.array([[1 << 30, 3]]), np.array([[-(1 << 30), 5]])).tolist() == [(1 << 62) + 4]
    with pytest.raises(OverflowError):
        centroids.squared(*big)


def test_scratch_is_where_the_session_says(spark):
    assert Scratch(spark, "x").root.startswith(("file:", "/"))
