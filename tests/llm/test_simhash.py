import random

import numpy as np
import pytest
import xxhash

from kinweave.llm import simhash

SCHEMA = "doc_id long, text string, fp int"


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints):
    ids = list(range(len(prints)))
    root = ids[:]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def texts():
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(80)]
    docs = [None, "", " \t\n", "one", "One  TWO", "one two", "x y É é", "a b c"]
    for _ in range(12):
        words = [r.choice(base) for _ in range(r.randint(150, 400))]
        docs.append(" ".join(words))
        for _ in range(3):
            changed = words[:]
            changed[r.randrange(len(changed))] = "CHANGED"
            docs.append("\n".join(changed))
        docs.append(" ".join(words).upper())
    return docs


@pytest.mark.parametrize("max_trie,blocks", [(1024, None), (2, 3), (16, 3), (2, 4)])
def test_matches_brute_force(spark, max_trie, blocks):
    docs = texts()
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(docs)], SCHEMA).repartition(5)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(df, max_trie=max_trie, blocks=blocks).collect()}
    prints = [brute_print(t) for t in docs]
    comps = brute_components(prints)
    assert got == {i: (prints[i], comps[i]) for i in range(len(docs))}
    assert len(set(comps)) < len(comps)
    kept = simhash.keep_one(df, max_trie=max_trie)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comps))


def test_trie_pairs_against_all_pairs():
    r = np.random.default_rng(5)
    groups = []
    for n in (1, 2, 60, 200):
        centre = r.integers(0, 2**63, dtype=np.uint64)
        values = {int(centre)}
        while len(values) < n:
            values.add(int(centre) ^ sum(1 << int(b) for b in r.integers(0, 64, r.integers(0, 4))))
        groups.append(np.array(sorted(values, key=lambda _: r.random()), dtype=np.uint64))
    a, b = simhash.trie_pairs(groups)
    got = sorted((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()))
    want = sorted((min(x, y), max(x, y)) for g in groups for i, x in enumerate(g.tolist()) for y in g.tolist()[:i] if bin(x ^ y).count("1") <= 2)
    assert got == want


def test_pairs_between_two_groups():
    r = np.random.default_rng(6)
    centre = int(r.integers(0, 2**63, dtype=np.uint64))
    near = [{centre ^ sum(1 << int(b) for b in r.integers(0, 64, 3)) for _ in range(n)} for n in (80, 30)]
    one, two = np.array(sorted(near[0] - near[1]), dtype=np.uint64), np.array(sorted(near[1]), dtype=np.uint64)
    a, b = simhash.trie_pairs([one, two], [two, None])
    want = [(x, y) for x in one.tolist() for y in two.tolist() if bin(x ^ y).count("1") <= 2]
    want += [(min(x, y), max(x, y)) for i, x in enumerate(two.tolist()) for y in two.tolist()[:i] if bin(x ^ y).count("1") <= 2]
    inside = set(two.tolist())
    assert sorted((min(x, y), max(x, y)) if x in inside else (x, y) for x, y in zip(a.tolist(), b.tolist())) == sorted(want)


@pytest.mark.parametrize("max_trie", [2, 16, 1024])
def test_large_groups_split_along_node_pairs(spark, max_trie):
    """A dense ball, its far copy and strangers: the links connect what all pairs connect."""
    r = random.Random(11)
    centre, far = r.getrandbits(64), r.getrandbits(64)
    values = {c ^ sum(1 << b for b in r.sample(range(64), k)) for c, k in [(centre, r.choice([0, 1, 2, 4, 6])) for _ in range(150)] + [(far, 3) for _ in range(30)]}
    values = sorted(values | {r.getrandbits(64) for _ in range(40)})
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"), max_trie=max_trie).collect()
    back = {s: i for i, s in enumerate(signed.values())}
    roots = list(range(len(values)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for e in edges:
        a, b = find(back[e.a]), find(back[e.b])
        roots[max(a, b)] = min(a, b)
    assert [find(i) for i in roots] == brute_components(values)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " \n".join(f"Word{i % 997} x" for i in range(3000))
    monkeypatch.setattr(simhash, "_PIECE", 100)
    for t in (text, "one two", " one", "", " " * 500, "a" * 1000 + " b c d"):
        assert simhash.fingerprint(t.encode()) == brute_print(t)


def test_one_of_each_group_stays(spark):
    schema = "doc_id long, text string, fp int, comp string, d_0 int, copies int, row_doc long"
    rows = [(None, "p q r s", 1), (None, "p q r s", 1), (4, "a b c d", 1), (4, "A b c d", 2), (4, "A b c d", 2), (7, "a b c d", 1), (None, "a b c d", 1), (8, None, 1), (9, "", 1), (10, "t u v", 5)]
    df = spark.createDataFrame([(d, t, k, "x", 0, 3, 1) for d, t, k in rows], schema).repartition(3)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str)
    assert [d for d, _ in got] == [0, 10, 4, 8] and (0, "p q r s") in got and len(got) == 4
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c d", 1), (5, "a b c d", 1), (None, "a b c d", 1), (9, None, 1)], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, 5), (5, 5), (5, 5), (9, 9)]
    assert sorted(r.doc_id for r in simhash.keep_one(rows).collect()) == [5, 9]
