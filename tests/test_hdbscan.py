import numpy as np
import pytest

from kinweave.operators import hdbscan, neighbours, spanning


def table(spark, x, parts=3):
    rows = [(3 * i + (1 << 40) * (i % 2), [float(v) for v in row], "a", 1) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, core string, part int").repartition(parts), [r[0] for r in rows]


def reachability(x, samples, p=2):
    d = np.linalg.norm(x[:, None] - x[None], ord=p, axis=2)
    core = np.sort(d, 1)[:, min(samples, len(x)) - 1]
    return np.maximum(np.maximum(d, core[:, None]), core[None])


def plain_tree(m):
    """Weights of a minimum spanning tree, by growing one part."""
    inside, out, near = [0], [], m[0].copy()
    while len(inside) < len(m):
        near[inside] = np.inf
        i = int(near.argmin())
        out.append(near[i])
        inside.append(i)
        near = np.minimum(near, m[i])
    return sorted(out)


def parts(m, rows, w):
    """Parts of ``rows`` linked below w."""
    left, out = set(rows), []
    while left:
        part, stack = set(), [left.pop()]
        while stack:
            i = stack.pop()
            part.add(i)
            near = {j for j in left if m[i, j] < w}
            left -= near
            stack += near
        out.append(sorted(part))
    return out


def plain_hdbscan(m, least, single):
    """{row: cluster} by the definition: walk down the levels, note what falls out and what splits."""

    def walk(rows, birth):
        stability, current = 0.0, rows
        for w in sorted({m[i, j] for i in rows for j in rows if i < j}, reverse=True):
            big = [p for p in parts(m, current, w) if len(p) >= least]
            if len(big) == 1:
                stability += (len(current) - len(big[0])) * (1 / max(w, 1e-12) - birth)
                current = big[0]
                continue
            stability += len(current) * (1 / max(w, 1e-12) - birth)
            return rows, stability, [walk(p, 1 / max(w, 1e-12)) for p in big]
        return rows, stability, []

    def pick(node, root):
        rows, stability, kids = node
        inside = [pick(k, False) for k in kids]
        total = sum(t for t, _ in inside)
        if (root and not single) or (kids and total > stability + 1e-12):
            return total, [c for _, cs in inside for c in cs]
        return stability, [rows]

    if len(m) < least:
        return {}
    return {i: min(c) for c in pick(walk(list(range(len(m))), 0.0), True)[1] for i in c}


def shapes():
    r = np.random.default_rng(0)
    blobs = np.concatenate([r.normal(size=(14, 2)) * s + c for s, c in ((0.3, (0, 0)), (0.6, (6, 0)), (0.2, (3, 5)), (0.2, (3.9, 5)))] + [r.uniform(-4, 9, (8, 2))])
    grid = np.array([[i, j] for i in range(5) for j in range(4)] + [[i + 40, j] for i in range(4) for j in range(4)], dtype=float)
    copies = np.concatenate([np.zeros((20, 2)), np.ones((9, 2)) * 5, blobs[:12], blobs[30:40]])
    chain = np.cumsum(np.linspace(1, 2, 30))[:, None]
    return {"blobs": blobs, "grid": grid, "copies": copies, "chain": chain, "two": np.array([[0.0], [1.0]])}


@pytest.mark.parametrize("name", list(shapes()))
def test_matches_the_definition(spark, name):
    x = shapes()[name]
    df, ids = table(spark, x)
    spread = {"broadcast_bytes": 0, "block_rows": 11, "dense_rows": 0}
    cases = [(4, None, False, {})] + ([(5, 2, True, spread)] if name == "blobs" else [(3, 4, False, {"dense_rows": 0})] if name == "grid" else [])
    for least, samples, single, blocks in cases:
        m = reachability(x, (samples or least) + 1)
        tree = spanning.reachability_tree(df, (samples or least) + 1, listed=3, **blocks).collect()
        assert len(tree) == len(x) - 1 and np.allclose(sorted(e.w for e in tree), plain_tree(m), atol=1e-9)
        got = {r.id: r.comp for r in hdbscan.hdbscan(df, least, samples, single=single, **blocks).collect()}
        want = plain_hdbscan(np.round(m, 9), least, single)
        assert got == {ids[i]: (ids[want[i]] if i in want else None) for i in range(len(x))} or {frozenset(k for k in got if got[k] == c) for c in set(got.values()) - {None}} == {frozenset(ids[i] for i in want if want[i] == c) for c in set(want.values())}


def test_tree_of_a_large_part_that_never_searches(spark, monkeypatch):
    """Exact where many rows make up one part that no other is nearest to for some rounds; its rows do not search again."""
    r = np.random.default_rng(3)
    far = [r.normal(size=(n, 3)) * 0.05 + c for n, c in ((6, (40, 0, 0)), (6, (41, 0, 0)), (7, (0, 60, 0)), (5, (0, 61.5, 0)), (4, (40, 2, 0)))]
    x = np.concatenate([r.normal(size=(90, 3)), *far, far[0][:3], far[0][:2], [far[2][0]] * 9])
    df, ids = table(spark, x)
    big, searched, plain = {ids[i] for i in range(90)}, [], neighbours._searched

    def search(rows, lists, block_rows, broadcast_bytes, queries):
        searched.append({q.id for q in queries.collect()})
        return plain(rows, lists, block_rows, broadcast_bytes, queries)

    monkeypatch.setattr(neighbours, "_searched", search)
    for metric, p in (("l2", 2), ("l1", 1), ("linf", np.inf)):
        for spread in ({"broadcast_bytes": 0, "block_rows": 17}, {}):
            searched.clear()
            tree = spanning.reachability_tree(df, 4, metric, listed=4, dense_rows=0, **spread).collect()
            assert len(tree) == len(x) - 1 and np.allclose(sorted(e.w for e in tree), plain_tree(reachability(x, 4, p)), atol=1e-9)
            assert searched and not any(len(asked & big) > 45 for asked in searched)


def test_odd_rows(spark):
    x = shapes()["blobs"][:14]
    df, ids = table(spark, x)
    odd = spark.createDataFrame([(5, None, "", 1), (7, [], "", 1), (8, [float("nan"), 0.0], "", 1)], df.schema)
    got = {r.id: r.comp for r in hdbscan.hdbscan(df.unionByName(odd), 3, single=True).collect()}
    assert set(got) == {*ids, 5, 7, 8} and got[5] is got[7] is got[8] is None and got[ids[0]] is not None
    assert hdbscan.hdbscan(df.limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        hdbscan.hdbscan(df, 1)


def test_core_levels(spark):
    r = np.random.default_rng(4)
    n = 60
    edges = [(int(r.integers(0, i)) if i % 3 else 0, i, float(r.integers(1, 30))) for i in range(1, n)]  # a hub, long paths and ties
    tree = spark.createDataFrame(edges, "a long, b long, w double")
    m = np.full((n, n), np.inf)
    for a, b, w in edges:
        m[a, b] = m[b, a] = w
    for least in (2, 7, 60, 61):
        got = {x.id: x.level for x in hdbscan.core_levels(tree, least).collect()}
        for i in range(n):
            want = next((w for w in range(1, 31) if len(next(p for p in parts(m, range(n), w + 0.5) if i in p)) >= least), None)
            assert got[i] == want


def test_deep_hierarchies():
    n = 20_000  # dense parts joined one after another, far deeper than the recursion limit
    p, q, w = np.arange(n), np.arange(1, n + 1), np.linspace(1, 2, n)
    part = np.arange(n + 1)
    found = hdbscan.choose_clusters(p, q, w, part, np.full(n + 1, -1.0), np.full(n + 1, 5), np.full(n + 1, 5 / 0.5), part * 10)
    assert len(found) == n + 1 and (found % 10 == 0).all()
    assert hdbscan.choose_clusters(p[:0], q[:0], w[:0], part[:1], np.array([-1.0]), np.array([5]), np.array([5.0]), part[:1]).tolist() == [-1]
