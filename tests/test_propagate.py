import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kinweave.functions.forest import min_roots, star_forest
from kinweave.operators import components, labels, propagate
from kinweave.operators.propagate import diffuse, rounds_within
from kinweave.sources.shared import recorded


def plain_components(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, left = [], set(nodes)
    while left:
        stack, group = [left.pop()], set()
        while stack:
            n = stack.pop()
            group.add(n)
            stack += [m for m in near[n] if m not in group]
        left -= group
        out.append(group)
    return out


def plain_propagation(edges, max_sz, step, max_iter):
    nodes = {n for a, b, _ in edges for n in (a, b)}
    th, found, done = min(s for *_, s in edges), [], 0
    keep = edges
    while True:
        groups = plain_components(nodes, [(a, b) for a, b, _ in keep])
        found += [g for g in groups if len(g) <= max_sz]
        nodes = set().union(*[g for g in groups if len(g) > max_sz])
        if not nodes or done and done >= max_iter:  # the round with all edges does not count
            break
        th, done = th + (1 - th) * step, done + 1
        keep = [e for e in edges if e[2] >= th and e[0] in nodes and e[1] in nodes]
    if nodes:
        found.append(nodes)
    return {n: min(g) for g in found for n in g}


FIXTURES = {
    "chain_ok": ([(0, 1, .9), (1, 2, .8), (4, 5, .7)], dict(max_sz=3), [{0, 1, 2}, {4, 5}]),
    "chain_split": ([(0, 1, .9), (1, 2, .6), (2, 3, .9)], dict(max_sz=2, step=.5), [{0, 1}, {2, 3}]),
    "late_singletons": ([(0, 1, .6), (1, 2, .6), (2, 3, .9)], dict(max_sz=2, step=.5), [{0}, {1}, {2, 3}]),
    "inclusive_edge": ([(0, 1, .75), (1, 2, .5), (2, 3, .75)], dict(max_sz=2, step=.5), [{0, 1}, {2, 3}]),
    "leftover_merge": ([(0, 1, 1.), (1, 2, 1.), (0, 2, 1.), (3, 4, 1.), (4, 5, 1.), (3, 5, 1.)], dict(max_sz=2, max_iter=3), [{0, 1, 2, 3, 4, 5}]),
    "bound_one": ([(0, 1, .9)], dict(max_sz=1, max_iter=1, step=.5), [{0}, {1}]),
    "no_threshold_left_out": ([(0, 1, .9)], dict(max_sz=1, max_iter=0, step=.5), [{0}, {1}]),
    "merged_after_one": ([(0, 1, .9), (2, 3, .96), (4, 5, .97)], dict(max_sz=1, max_iter=1, step=.5), [{0}, {1}, {2, 3, 4, 5}]),
}


@pytest.mark.parametrize("name", FIXTURES)
@pytest.mark.parametrize("local_edges", [500_000, 0])
def test_fixtures(spark, name, local_edges):
    edges, options, want = FIXTURES[name]
    df = spark.createDataFrame(edges, "a long, b long, score double")
    got = {r.id: r.comp for r in propagate.propagate(df, local_edges=local_edges, **options).collect()}
    assert got == {n: min(g) for g in want for n in g}


def test_no_pairs_and_labels(spark):
    none = propagate.propagate(spark.createDataFrame([], "a long, b long, score double"), 5)
    assert none.count() == 0
    items = spark.range(3)
    assert [r.label for r in labels.label_items(items, none).collect()] == [-1, -1, -1]
    comps = spark.createDataFrame([(4, 4), (5, 4), (0, 0), (2, 2), (3, 2)], "id long, comp long")
    got = {r.id: r.label for r in labels.label_items(spark.range(7), comps).collect()}
    assert got == {0: 0, 1: -1, 2: 1, 3: 1, 4: 2, 5: 2, 6: -1}
    kept = {r.id: r.label for r in labels.keep_singletons(labels.label_items(spark.range(7), comps)).collect()}
    assert kept == {0: 0, 1: 3, 2: 1, 3: 1, 4: 2, 5: 2, 6: 4}
    mixed = spark.createDataFrame([(0, 7), (1, -1), (2, 3), (3, 7)], "id long, label int")
    assert {r.id: r.label for r in labels.relabel(mixed).collect()} == {0: 0, 1: -1, 2: 1, 3: 0}
    far = spark.createDataFrame([(10**12,), (-5,), (3,), (70_000,), (3,)], "k long")
    assert [tuple(r) for r in labels.dense_index(far, "k").orderBy("k").collect()] == [(-5, 0), (3, 1), (70_000, 2), (10**12, 3)]


edge_lists = st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14), st.integers(1, 20)), min_size=1, max_size=40)


@settings(max_examples=150, deadline=None)
@given(edge_lists, st.integers(1, 6), st.integers(1, 30))
def test_local_rounds_match_plain_search(raw, max_sz, max_iter):
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), s / 20) for a, b, s in raw if a != b}.values())
    if not edges:
        return
    a, b, s = (np.array(x) for x in zip(*edges))
    nodes = np.unique(np.concatenate([a, b]))
    linked, roots = min_roots(a, b)
    assert dict(zip(linked.tolist(), roots.tolist())) == {n: min(g) for g in plain_components(nodes.tolist(), [(x, y) for x, y, _ in edges]) for n in g}
    sizes = {r: int((roots == r).sum()) for r in roots.tolist()}
    got = {n: r for n, r in zip(linked.tolist(), roots.tolist()) if sizes[r] <= max_sz}
    left = []
    for root in {r for r in roots.tolist() if sizes[r] > max_sz}:
        inside = np.isin(a, linked[roots == root])
        ids, comps, leftover = rounds_within(a[inside], b[inside], s[inside], float(s.min()), 0, max_sz, 0.1, max_iter)
        got.update(zip(ids[~leftover].tolist(), comps[~leftover].tolist()))
        left += ids[leftover].tolist()
    got.update(dict.fromkeys(left, min(left, default=None)))
    assert got == plain_propagation(edges, max_sz, 0.1, max_iter)


@settings(max_examples=60, deadline=None)
@given(edge_lists)
def test_star_forest_keeps_components(raw):
    u, v = np.array([a for a, _, _ in raw]), np.array([b for _, b, _ in raw])
    a, b = star_forest(u, v)
    nodes = set(u.tolist()) | set(v.tolist())
    assert sorted(map(sorted, plain_components(nodes, zip(u.tolist(), v.tolist())))) == sorted(map(sorted, plain_components(nodes, zip(a.tolist(), b.tolist()))))
    assert (a > b).all() and len(a) == len(set(a.tolist()))


@pytest.mark.parametrize("local_edges", [10**6, 0])
def test_components_of_paths_stars_and_cliques(spark, local_edges):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(300, 360)] + [(a, b) for a in range(400, 412) for b in range(400, a)] + [(900, 900), (None, 3), (5, 6), (6, 5)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {x.id: x.comp for x in components.connected_components(df, local_edges=local_edges).collect()}
    real = [(a, b) for a, b in edges if a is not None]
    assert got == {n: min(g) for g in plain_components({n for e in real for n in e}, real) for n in g}


def test_soft_labels(spark):
    edges = [(0, 1, .9), (1, 2, .5), (2, 3, .9)]
    df = spark.createDataFrame(edges, "a long, b long, score double")
    membership, soft = propagate.propagate_soft(df, 2, step=.5, max_depth=1)
    assert {r.id: r.comp for r in membership.collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    got = {(r.id, r.label): r.weight for r in soft.collect()}
    raw = {1: {0: 1 + .9 * .6, 2: .5 * .6}, 0: {0: 1 + .9 * .6}}
    assert got[0, 0] == pytest.approx(1) and got[1, 0] == pytest.approx(raw[1][0] / sum(raw[1].values())) and got[1, 2] == pytest.approx(raw[1][2] / sum(raw[1].values()))
    assert (0, 2) not in got


def test_diffusion_writes_no_row_of_a_root_and_a_node(spark):
    """Sums by label leave the tasks; the form by joins gives the same and deletes its levels."""
    r = np.random.default_rng(2)
    edges = {tuple(sorted(e)) for e in r.integers(0, 60, (150, 2)).tolist() if e[0] != e[1]}
    pairs = spark.createDataFrame([(a, b, float(r.uniform(0.3, 1))) for a, b in sorted(edges)], "a long, b long, score double")
    membership = spark.createDataFrame([(i, i // 7 * 7) for i in range(62)], "id long, comp long").persist()
    roots = membership.filter("id % 3 <> 0").select("id")
    found = []
    for options in ({}, {"local_links": 0, "lot_rows": 500}):
        with recorded() as paths:
            found.append({(x.id, x.label): x.weight for x in diffuse(pairs, membership, roots, **options).collect()})
        left = [p for p in paths if "/level-" in p and os.path.exists(p.removeprefix("file://"))]
        assert left == []
    assert found[0].keys() == found[1].keys() and len(found[0]) > 400
    assert all(found[1][at] == pytest.approx(w, rel=1e-12) for at, w in found[0].items())


def test_soft_labels_are_not_shuffled(spark):
    """Each node's sums are made where the node is, also over many levels, weak links and negative scores (by joins)."""
    r = np.random.default_rng(5)
    edges = {tuple(sorted(e)) for e in r.integers(0, 80, (110, 2)).tolist() if e[0] != e[1]} | {(200 + i, 201 + i) for i in range(9)}
    for least in (0.0, -1.0):
        rows = [(a, b, float(r.integers(0, 5)) / 4 if least == 0 else float(r.uniform(least, 1))) for a, b in sorted(edges)]
        pairs = spark.createDataFrame(rows, "a long, b long, score double")
        comp = {i: i // 7 * 7 for i in sorted({x for e in edges for x in e} | {500})}
        membership = spark.createDataFrame(list(comp.items()), "id long, comp long").persist()
        links: dict[int, list[tuple[int, float]]] = {}
        for a, b, s in rows:
            links.setdefault(a, []).append((b, s))
            links.setdefault(b, []).append((a, s))
        want = {(i, c): 1.0 for i, c in comp.items()}
        for root in comp:
            if root % 3:
                seen, level = {root}, {root: 1.0}
                for _ in range(5):
                    step: dict[int, float] = {}
                    for p, value in level.items():
                        for v, s in links.get(p, []):
                            if v not in seen:
                                step[v] = max(step.get(v, -np.inf), value * s * 0.6)
                    seen |= step.keys()
                    level = step
                    for v, value in step.items():
                        want[v, comp[root]] = want.get((v, comp[root]), 0) + value
        soft = diffuse(pairs, membership, membership.filter("id % 3 <> 0").select("id"), normalise=False)
        found = {(x.id, x.label): x.weight for x in soft.collect()}
        assert found.keys() == want.keys() and all(found[at] == pytest.approx(w, rel=1e-12, abs=1e-15) for at, w in want.items())
        if least == 0:
            assert soft._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
