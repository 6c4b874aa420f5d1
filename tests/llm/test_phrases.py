import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import phrases

SCHEMA = "text string, lang string, phrase string, f long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, most):
    counts, total = Counter(), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i:i + n])] += 1
    return counts, total


def plain(rows, top, most, least):
    counts, total = plain_counts(rows, most)
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], score)

    def inside(p, q):
        return len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))

    kept = {x: v for x, v in found.items() if not any(l == x[0] and inside(x[1], q) and 100 * found[l, q][0] >= 50 * v[0] for l, q in found)}
    out = []
    for lang in {x[0] for x in kept}:
        mine = sorted((-v[3], -v[0], " ".join(p).encode(), v) for (l, p), v in kept.items() if l == lang)
        out += [(lang, i + 1, p.decode(), v[0], v[1], v[2], total[lang], v[3]) for i, (_, _, p, v) in enumerate(mine[:top])]
    return sorted(out)


def run(spark, rows, top=2000, most=3, least=10, shard=phrases.SHARD_WORDS, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in phrases.top_collocations(docs, top, most, least, shard).collect())


def texts(seed, n):
    r = np.random.default_rng(seed)
    words = ["the", "a", "São", "Paulo", "New", "york", "City", "ß", "x\x00y", "\u00a0", "of"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b"]
    return [("".join(words[min(int(r.zipf(1.4)), 11) - 1] + marks[min(int(r.zipf(1.5)), 9) - 1] for _ in range(int(r.integers(0, 60)))), [None, "en", "und", ""][int(r.integers(4))], "p", 1) for _ in range(n)]


def test_matches_plain_counting(spark):
    rows = texts(0, 400)
    rows += [rows[0]] * 200  # a group of copies
    for most, least, top, shard in ((3, 10, 2000, 1 << 19), (3, 2, 7, 50), (2, 3, 2000, 100), (4, 2, 2000, 300)):
        assert run(spark, rows, top, most, least, shard) == plain(rows, top, most, least)


def test_odd_rows(spark):
    assert run(spark, [], parts=1) == []
    rows = [(None, None, None, None), ("", "en", None, None), (" \t\n.", None, None, None), ("one", "en", None, None)] * 20
    assert run(spark, rows) == []
    assert run(spark, [("A b", None, None, None)] * 9) == [] and len(run(spark, [("A b", None, None, None)] * 10)) == 1
    ties = [("p q. r s. t u v", "en", None, None)] * 12  # equal scores and counts
    assert run(spark, ties) == plain(ties, 2000, 3, 10) and [r[2] for r in run(spark, ties)] == ["p q", "r s", "t u v"]


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 64)
    import pyarrow as pa

    for seed in range(5):
        rows = texts(seed, 30)
        whole = ["".join(t for t, *_ in rows), "", "word " * 100, *[t for t, *_ in rows]]
        got = []
        for row, data, starts in phrases._slices(pa.array(whole)):
            words, piece, at = phrases._words(data, starts)
            names = words.to_pylist()
            for i in range(len(names) - 1):
                if piece[i] == piece[i + 1]:
                    got.append((row + at[i], names[i], names[i + 1]))
        want = [(i, a, b) for i, t in enumerate(whole) for p in re.split("[.,;:!?\n-\r]", t.translate(LOWER)) for w in [re.findall("[^ \t]+", p)] for a, b in zip(w, w[1:])]
        assert Counter(got) == Counter(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=8), max_size=8), st.integers(1, 5))
def test_lcp_intervals(pieces, depth):
    ids = np.array([w for p in pieces for w in p], dtype=np.int64)
    piece = np.array([i for i, p in enumerate(pieces) for _ in p], dtype=np.int64)
    got = {tuple(ids[at:at + n].tolist()): int(c) for n, places, counts in phrases.lcp_intervals(ids, piece, depth) for at, c in zip(places, counts)}
    want = Counter(tuple(p[i:i + n]) for p in pieces for n in range(1, depth + 1) for i in range(len(p) - n + 1))
    assert got == dict(want)


def test_large_products_are_exact(spark):
    big = 10**14
    rows = [("en", "a", 3 * big + 1), ("en", "b", 3 * big), ("en", "a b", 3 * big - 1), ("en", "c", 7), ("en", "d", 7), ("en", "c d", 7), ("en", "", 10**15)]
    got = {r.phrase: r.score for r in phrases.collocations(spark.createDataFrame(rows, "lang string, phrase string, f long")).collect()}
    assert got == {"a b": 10**6 * (3 * big - 1) ** 2 // ((3 * big + 1) * 3 * big), "c d": 10**6} and got["a b"] == 999999


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    rows = texts(3, 200)
    assert run(spark, rows, least=2) == plain(rows, 2000, 3, 2)
