import numpy as np
import pytest

from kinweave.operators import birch, exemplars, lloyd, modes, neighbours, spectral

SCHEMA = "id long, embedding array<double>, n string, v int"


def table(spark, x, parts=3):
    return spark.createDataFrame([(2 * i, [float(v) for v in row], "", i) for i, row in enumerate(x)], SCHEMA).repartition(parts)


def odd(spark):
    return spark.createDataFrame([(101, None, "", 0), (103, [], "", 0), (105, [float("nan"), 0.0], "", 0)], SCHEMA)


def blobs(seed=0, n=25):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=(n, 2)) * 0.5 + c for c in ((0, 0), (8, 0), (0, 9))])


def groups(rows, column):
    out = {}
    for r in rows:
        out.setdefault(r[column], set()).add(r.id)
    return {frozenset(g) for g in out.values()}


def test_lloyd_steps_and_losses(spark):
    x = np.concatenate([blobs(), np.random.default_rng(1).normal(size=(20, 2)) * 6])
    start = np.array([[0.0, 0.0], [0.5, 0.0], [100.0, 100.0], [3.0, 3.0]])
    found, centre, trace = lloyd.lloyd(table(spark, x).unionByName(odd(spark)), 4, start=start, steps=4)
    want, losses = start.copy(), []
    for _ in range(4):
        d = ((x[:, None] - want[None]) ** 2).sum(2)
        near = d.argmin(1)
        losses.append(d.min(1).sum())
        size = np.bincount(near, minlength=4)
        total = np.array([x[near == j].sum(0) for j in range(4)])
        want = lloyd.moved(want, size.astype(float), total)
    losses.append(((x[:, None] - want[None]) ** 2).sum(2).min(1).sum())
    assert np.allclose(centre, want) and np.allclose(trace, losses) and trace[-1] < trace[0]
    labels = {r.id: r.label for r in found.collect()}
    assert labels == {2 * i: int(j) for i, j in enumerate(((x[:, None] - want[None]) ** 2).sum(2).argmin(1))}
    assert np.bincount(list(labels.values()), minlength=4).min() > 0  # the far centre was given rows
    none, _, trace = lloyd.lloyd(odd(spark), 3)
    assert none.collect() == [] and trace == []


def plain_shift(x, radius, binned):
    seeds = np.unique(np.round(x / radius) * radius, axis=0) if binned else np.unique(x, axis=0)
    ends = []
    for s in seeds:
        for _ in range(300):
            near = np.linalg.norm(x - s, axis=1) <= radius
            if not near.any():
                break
            now = x[near].mean(0)
            done = np.linalg.norm(now - s) <= 1e-3 * radius
            s = now
            if done:
                ends.append((-int((np.linalg.norm(x - s, axis=1) <= radius).sum()), tuple(s)))
                break
    kept = []
    for n, s in sorted(set(ends)):
        if all(np.linalg.norm(np.array(s) - np.array(c)) > radius for c in kept):
            kept.append(s)
    return np.linalg.norm(x[:, None] - np.array(kept)[None], axis=2).argmin(1)


@pytest.mark.parametrize("options", [{}, {"binned": False, "broadcast_bytes": 0, "block_rows": 30}])
def test_mean_shift(spark, options):
    x = blobs(3)
    want = plain_shift(x, 2.5, options.get("binned", True))
    got = modes.mean_shift(table(spark, x).unionByName(odd(spark)), 2.5, **options).collect()
    assert groups(got, "label") == {frozenset((2 * np.flatnonzero(want == c)).tolist()) for c in set(want)} and len(got) == len(x)
    if not options:
        assert modes.bandwidth(table(spark, x), 0.3) == pytest.approx(np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), 1)[:, int(len(x) * 0.3) - 1].mean())
        assert modes.mean_shift(odd(spark), 1.0).collect() == []


def test_places_are_kept_in_order(spark):
    r = np.random.default_rng(5)
    n, pairs = r.integers(1, 6, 40), {(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 40, (70, 2)) if a != b}
    kept = []
    for i in sorted(range(40), key=lambda i: (-n[i], i)):
        if not any((min(i, j), max(i, j)) in pairs for j in kept):
            kept.append(i)
    places = spark.createDataFrame([(i, int(n[i])) for i in range(40)], "id long, n long")
    got = modes._keep_first(places, spark.createDataFrame(list(pairs), "a long, b long"))
    assert sorted(x.id for x in got.collect()) == sorted(kept)


def dense_messages(s, damping, rounds):
    n = len(s)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        new = np.array([[s[i, k] - max((a[i, j] + s[i, j] for j in range(n) if j != k)) for k in range(n)] for i in range(n)])
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        new = np.array([[p[:, k].sum() - p[k, k] if i == k else min(0, r[k, k] + p[:, k].sum() - p[k, k] - p[i, k]) for k in range(n)] for i in range(n)])
        a = damping * a + (1 - damping) * new
    return a + r


def test_affinity_propagation(spark):
    x = np.random.default_rng(6).normal(size=(14, 2)) + np.repeat([[0, 0], [7, 0]], 7, axis=0)
    df = table(spark, x)
    edges = exemplars.similarities(df, None, -9.0).toPandas()
    i, k = edges.i.to_numpy() // 2, edges.k.to_numpy() // 2
    order = np.lexsort((k, i))
    s = np.zeros((14, 14))
    s[i, k] = edges.s
    assert len(edges) == 196 and np.allclose(s, -((x[:, None] - x[None]) ** 2).sum(2) - 9 * np.eye(14), atol=1e-9)
    total, _ = exemplars.messages(i[order], k[order], edges.s.to_numpy()[order], 0.7, 12, 99)
    assert np.allclose(total.reshape(14, 14), dense_messages(s, 0.7, 12))
    near = exemplars.similarities(df, 5, -6.0)
    one = exemplars.propagate_affinity(near, 0.6, 8, 99).collect()
    two = exemplars.propagate_affinity(near, 0.6, 8, 99, local_edges=0).collect()  # the same by joins
    assert sorted(one) == sorted(two) and len(one) == 14
    got = groups(exemplars.affinity_propagation(df.unionByName(odd(spark)), 0.7, -20.0, None).collect(), "comp")
    assert got == {frozenset(range(0, 14, 2)), frozenset(range(14, 28, 2))}
    assert exemplars.affinity_propagation(odd(spark)).collect() == []


def test_spectral(spark):
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    circles = table(spark, np.concatenate([np.c_[np.cos(t), np.sin(t)], 0.5 * np.c_[np.cos(t), np.sin(t)]]))
    lists = neighbours.knn(circles, 8, "l2").persist()
    want = {frozenset(range(0, 120, 2)), frozenset(range(120, 240, 2))}
    assert groups(spectral.spectral(lists, 2).collect(), "label") == want
    x = np.random.default_rng(7).normal(size=(30, 3))
    lists = neighbours.knn(table(spark, x), 7, "l2").persist()
    edges = spectral.graph(lists)
    held = edges.collect()
    m = np.zeros((30, 30))
    for e in held:
        m[e.u // 2, e.v // 2] = e.w
    values, vectors = np.linalg.eigh(m)
    u, v, w, d = (np.array([e[c] for e in held]) for c in ("u", "v", "w", "du"))
    assert np.allclose(spectral.local_labels(u, v, w, d, 4, 1e-12, 60)[2], values[::-1][:4], atol=1e-7)
    got, x = spectral.eigenvectors(edges, 3, 1e-4, 3)  # by joins
    assert np.allclose(got, values[::-1][:3], atol=1e-3)
    own = x.orderBy("id").toPandas()[["x0", "x1", "x2"]].to_numpy()
    assert np.allclose(own.T @ own, np.eye(3), atol=1e-6)
    assert np.abs(own[:, 0] @ vectors[:, -1]) > 0.999
    alone = spark.createDataFrame([(1, 1, 1, 0.0), (2, 1, 2, 0.0)], "id long, rank int, nbr long, dist double")
    assert sorted(tuple(r) for r in spectral.spectral(alone, 2).collect()) == [(1, 0), (2, 0)]


def test_birch(spark):
    x = blobs(8, 60)
    df = table(spark, x, 4).unionByName(odd(spark))
    for threshold, most in ((0.5, 5000), (0.01, 12)):
        held = birch.features(df, threshold, most=most).collect()
        assert sum(f.n for f in held) == len(x) and np.allclose(np.sum([f.s for f in held], axis=0), x.sum(0)) and sum(f.q for f in held) == pytest.approx((x * x).sum())
        assert len(held) < len(x) and len(held) <= most * 4
    want = {frozenset(range(120 * c, 120 * c + 120, 2)) for c in range(3)}
    assert groups(birch.birch(df, 3).collect(), "comp") == want
    assert birch.birch(odd(spark), 3).collect() == []


def test_features_are_within_the_threshold():
    r = np.random.default_rng(9)
    x = r.normal(size=(300, 2))
    held = birch.Features(2, 0.4)
    held.add(np.ones(300), x, (x * x).sum(1))
    n, s, q = held.n[: held.size], held.s[: held.size], held.q[: held.size]
    assert (q / n - ((s / n[:, None]) ** 2).sum(1) <= 0.16 + 1e-12).all() and 5 < held.size < 100


def test_parts_of_similarities_send_each_other_sums(spark, monkeypatch):
    """One written table a round, and the exemplars of one task, whatever the parts; a candidate of all rows among them."""
    r = np.random.default_rng(11)
    x = r.normal(size=(90, 3))
    near = exemplars.similarities(table(spark, x), 6, -3.0)
    hub = spark.createDataFrame([(2 * i, 0, -float(r.random() * 4)) for i in range(1, 90)], "i long, k long, s double")
    near = near.unionByName(hub.join(near.select("i", "k"), ["i", "k"], "left_anti")).persist()
    one = exemplars.propagate_affinity(near, 0.6, 8, 5).collect()
    written = []
    monkeypatch.setattr(exemplars, "materialize", lambda df, name, plain=exemplars.materialize: written.append(name) or plain(df, name))
    for edges in (100, 1 << 18):
        monkeypatch.setattr(exemplars, "PART_EDGES", edges)
        written.clear()
        assert sorted(exemplars.propagate_affinity(near, 0.6, 8, 5, local_edges=0).collect()) == sorted(one)
        assert len({r.exemplar for r in one}) > 3 and "responsibilities" not in written and written.count("messages") <= 9


def test_products_do_not_go_through_the_driver(spark, monkeypatch):
    """Small tables of rows are shuffled; a broadcast would send them through the driver once a product."""
    x = np.random.default_rng(12).normal(size=(40, 3))
    plans = []

    def kept(df, name, plain=spectral.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(spectral, "materialize", kept)
    summed = spectral._summed
    monkeypatch.setattr(spectral, "_summed", lambda table, *a: plans.append(table._jdf.queryExecution().executedPlan().toString()) or summed(table, *a))
    edges = spectral.materialize(spectral.graph(neighbours.knn(table(spark, x), 6, "l2")), "normalised")
    spectral.eigenvectors(edges, 2, 1e-9, 1)
    assert len([p for p in plans if "Join" in p]) > 4 and not any("Broadcast" in p for p in plans)
