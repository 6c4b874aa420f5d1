import numpy as np
import pytest

from kinweave.operators import ann, neighbours


def table(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in row], i) for i, row in enumerate(x)], "id long, embedding array<double>, rank int").repartition(parts)


def share(found, exact, k):
    return neighbours.recall(found, exact, k).first().recall


@pytest.mark.parametrize("strategy", ["descent", "kd"])
def test_lists_find_most_neighbours(spark, strategy):
    x = np.random.default_rng(0).normal(size=(2500, 12))
    x[100:140] = x[100]  # a group of copies
    df = table(spark, x)
    for metric in ("cosine", "l2")[: 1 if strategy == "descent" else 2]:
        found = neighbours.knn(df, 10, metric, strategy=strategy).persist()
        exact = neighbours.knn(df, 10, metric)
        assert share(found, exact, 10) >= 0.9
        real = {(r.id, r.nbr): r.dist for r in exact.collect()}
        ranks = {}
        for r in found.collect():
            ranks.setdefault(r.id, []).append((r["rank"], r.dist, r.nbr))
            assert (r.id, r.nbr) not in real or abs(real[r.id, r.nbr] - r.dist) < 1e-7
        assert len(ranks) == 2500
        for rows in ranks.values():
            rows.sort()
            assert [r[0] for r in rows] == list(range(1, 11)) and [r[1] for r in rows] == sorted(r[1] for r in rows) and len({r[2] for r in rows}) == 10


@pytest.mark.parametrize("strategy", ["descent", "kd"])
def test_small_and_odd_tables(spark, strategy):
    x = np.random.default_rng(1).normal(size=(9, 3))
    df = table(spark, x).unionByName(spark.createDataFrame([(90, None, 0), (91, [], 0), (92, [float("nan")] * 3, 0)], "id long, embedding array<double>, rank int"))
    got = sorted((r.id, r["rank"], r.nbr) for r in neighbours.knn(df, 4, "l2", strategy=strategy).collect())
    assert got == sorted((r.id, r["rank"], r.nbr) for r in neighbours.knn(df, 4, "l2").collect())
    assert neighbours.knn(df.limit(0), 4, strategy=strategy).collect() == []
    one = neighbours.knn(table(spark, x[:1]), 4, "l2", strategy=strategy).collect()
    assert [(r.id, r["rank"], r.nbr) for r in one] == [(0, 1, 0)]


def test_leaf_bounds():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 4))
    axis, value = ann.grow(x, 3, 5)
    bound = ann.leaf_bounds(x, axis, value)
    assert bound.shape == (200, 8) and (np.sort(bound, 1)[:, 0] == 0).all() and (np.sort(bound, 1)[:, 1] > 0).all()
    for i in range(20):
        node, leaf = 0, 0
        while node < 7:
            right = x[i, axis[node]] > value[node]
            leaf, node = 2 * leaf + right, 2 * node + 1 + right
        assert bound[i].argmin() == leaf
        for other in range(8):  # the bound by walking down to that leaf
            node, total = 0, 0.0
            for bit in (2, 1, 0):
                right = bool(other >> bit & 1)
                off = x[i, axis[node]] - value[node]
                total += off * off if right != (off > 0) else 0
                node = 2 * node + 1 + right
            assert bound[i, other] == pytest.approx(total)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        neighbours.knn(table(spark, np.eye(3)), 2, strategy="magic")


def test_refined_lists_get_longer_until_they_know_enough(spark):
    """In many dimensions settled lists of a fixed length miss neighbours, the more the larger the table."""
    x = np.random.default_rng(3).normal(size=(2500, 40))
    df = table(spark, x).select("id", "embedding")
    found = ann.descent(df.withColumnRenamed("embedding", "v"), 10, "l2", listed=10)
    assert share(found, neighbours.knn(df, 10, "l2"), 10) >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1", "hamming"])
def test_lists_of_asked_cells(spark, monkeypatch, metric):
    """The k nearest among rows of asked cells, each vector copied once a group of queries and not once a query's cell."""
    r = np.random.default_rng(4)
    x = r.integers(-1000, 1000, size=(700, 5))
    x[50:90] = x[50]
    df = table(spark, x).select("id", "embedding")
    rows = neighbours._plain(df, "id", "embedding", metric)
    own = lambda m: np.stack([np.abs(m[:, 0]).astype(np.int64) % 3, 3 + np.abs(m[:, 1]).astype(np.int64) % 4], axis=1)
    asked = lambda m: np.stack([np.abs(m[:, 2] + j).astype(np.int64) % 3 == 0 for j in range(7)], axis=1)
    copied = []
    monkeypatch.setattr(neighbours, "_met", lambda asking, blocks, groups, plain=neighbours._met: copied.append(groups) or plain(asking, blocks, groups))
    monkeypatch.setattr(neighbours, "TILE_ROWS", 64)
    got = {}
    for f in neighbours.cell_lists(rows, 2, 7, own, asked, 6, metric, 100).collect():
        got.setdefault(f.id, []).append((f["rank"], f.dist, f.nbr))
    assert copied and copied[0] <= 4
    held = x.astype(np.int64 if metric == "hamming" else float)
    d = np.stack([neighbours._pair_distances(*(neighbours._unit(m) if metric == "cosine" else m for m in (np.repeat(held[i:i + 1], 700, 0), held)), metric) for i in range(700)])
    meets = np.stack([asked(held[i:i + 1])[0][own(held)].any(1) for i in range(700)])
    for i in range(700):
        near = sorted((d[i, j], j) for j in np.flatnonzero(meets[i]))[:6]
        assert [n for _, _, n in sorted(got.get(i, []))] == [j for _, j in near] and np.allclose([w for _, w, _ in sorted(got.get(i, []))], [w for w, _ in near])
