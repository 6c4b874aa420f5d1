import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.functions import vectors
from kinweave.operators import centroids, density, neighbours, rank_order, spanning, transform
from kinweave.sources import toys

METRICS = ["cosine", "l1", "l2", "linf", "angular", "hamming"]


def data(spark, n=60, d=5, hamming=False, seed=3):
    r = np.random.default_rng(seed)
    x = r.integers(0, 200, (n, d)) if hamming else r.normal(size=(n, d)).round(3)
    x[10] = x[11]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, f"id long, embedding array<{'long' if hamming else 'double'}>").repartition(3)


def plain(x, y, metric):
    if metric == "hamming":
        return sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(x, y))
    if metric in ("cosine", "angular"):
        c = float(x @ y / math.sqrt((x @ x) * (y @ y)))
        return 1 - c if metric == "cosine" else math.acos(max(-1, min(1, c)))
    return {"l1": np.abs(x - y).sum(), "l2": math.sqrt(((x - y) ** 2).sum()), "linf": np.abs(x - y).max()}[metric]


@pytest.mark.parametrize("metric", METRICS)
def test_knn_and_column_distances(spark, metric):
    x, df = data(spark, hamming=metric == "hamming")
    lists = {}
    for r in neighbours.knn(df, 4, metric).collect():
        lists.setdefault(r.id, []).append((r.rank, r.nbr, r.dist))
    for i in range(len(x)):
        got = sorted(lists[i])
        assert [r for r, _, _ in got] == [1, 2, 3, 4]
        assert [d for *_, d in got] == pytest.approx(sorted(plain(x[i], v, metric) for v in x)[:4], abs=2e-7)
        assert all(d == pytest.approx(plain(x[i], x[j], metric), abs=2e-7) for _, j, d in got)
    a, b = df.select(F.col("id").alias("i"), F.col("embedding").alias("x")), df.select(F.col("id").alias("j"), F.col("embedding").alias("y"))
    some = a.filter("i < 5").join(b.filter("j < 5"), F.col("i") <= F.col("j")).select("i", "j", vectors.distance(F.col("x"), F.col("y"), metric).alias("d"))
    assert all(float(r.d) == pytest.approx(plain(x[r.i], x[r.j], metric), abs=2e-7) for r in some.collect())


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e20])
def test_screened_lists_are_those_of_all_distances(metric, scale):
    """Over several tiles, with copies, negative codes and a wide range of sizes; equal rows tie and go to the smaller id."""
    r = np.random.default_rng(5)
    x = r.normal(size=(2600, 12)) * scale
    x[900:1000], x[2500:] = x[7], x[7]
    x = np.floor(r.normal(size=(2600, 12)) * 100).astype(np.int64) if metric == "hamming" else x
    ids = np.arange(2600) * 3
    got_id, rank, nbr, dist = neighbours._nearest(ids[:60], x[:60], ids, x, 20, metric)
    assert (got_id == np.repeat(ids[:60], 20)).all() and (rank == np.tile(np.arange(20) + 1, 60)).all()
    for i in range(60):
        if metric == "hamming":
            d = np.array([sum(bin((int(a) ^ int(b)) % (1 << 64)).count("1") for a, b in zip(x[i], v)) for v in x])
        else:
            u = x / np.sqrt((x * x).sum(1, keepdims=True)) if metric in ("cosine", "angular") else x
            off = u - u[i]
            cos = np.einsum("ij,ij->i", np.broadcast_to(u[i], u.shape).copy(), u)
            d = {"cosine": 1 - cos, "angular": np.arccos(np.clip(cos, -1, 1)), "l1": np.abs(off).sum(1), "l2": np.sqrt(np.einsum("ij,ij->i", off, off)), "linf": np.abs(off).max(1)}[metric]
        want = np.lexsort((ids, d))[:20]
        assert (nbr[i * 20:(i + 1) * 20] == ids[want]).all()
        assert dist[i * 20:(i + 1) * 20] == pytest.approx(d[want], rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 16, "broadcast_bytes": 0}])
def test_lists_within_a_distance_are_the_heads_of_whole_lists(spark, blocks):
    _, df = data(spark, 150)
    key = lambda lists: sorted(map(tuple, lists.select("id", "rank", "nbr").collect()))
    whole = neighbours.knn(df, 6, **blocks)
    assert key(neighbours.knn(df, 6, within=0.1, **blocks)) == key(whole.filter("dist <= 0.1"))
    assert whole.filter("dist > 0.1").count() > 0


def test_groups_of_queries_meet_the_whole_table(spark):
    """Radius graphs of a table too large to give to every task: the join of block pairs is gone, and no group waits behind another."""
    _, df = data(spark, 150)
    for blocks in ({}, {"block_rows": 8, "broadcast_bytes": 0}):
        found = density.dbscan(df, 1.2, 4, **blocks).orderBy("id").collect()
        want = found if not blocks else want
        assert found == want
        counts = neighbours.radius_counts(df, 1.2, **blocks)
        if blocks:
            assert "BroadcastHashJoin" not in counts._jdf.queryExecution().toString() and "SortMergeJoin" not in counts._jdf.queryExecution().toString()
    keys = neighbours._even_keys(spark, 12)
    dealt = spark.createDataFrame([(k,) for k in keys], "k long").repartition(12, "k").select(F.spark_partition_id().alias("p"))
    assert dealt.distinct().count() == 12


def test_strategies_agree(spark):
    _, df = data(spark, 150)
    want = sorted(map(tuple, neighbours.knn(df, 6).select("id", "rank", "nbr").collect()))
    assert sorted(map(tuple, neighbours.knn(df, 6, block_rows=16, broadcast_bytes=0).select("id", "rank", "nbr").collect())) == want
    exhaustive = neighbours.knn(df, 6, strategy="ivf", cells=4, probes=4, block_rows=20)
    assert sorted(map(tuple, exhaustive.select("id", "rank", "nbr").collect())) == want
    few = neighbours.knn(df, 6, strategy="ivf", cells=4, probes=2)
    assert neighbours.recall(few, neighbours.knn(df, 6), 6).first().recall > 0.5


def test_ivf_recall_over_many_cells(spark):
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(r.normal(size=(1500, 32)).tolist())], "id long, embedding array<double>").repartition(3).cache()
    exact = neighbours.knn(df, 10)
    assert neighbours.recall(neighbours.knn(df, 10, strategy="ivf", cells=40), exact, 10).first().recall >= 0.9
    assert neighbours.knn(df.limit(3), 10, strategy="ivf").count() == 9


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert sorted((r.id, r.nbr) for r in neighbours.knn(df, 9).collect()) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    assert [(r.id, r.nbr) for r in neighbours.knn(df, 1).orderBy("id").collect()] == [(0, 0), (4, 4)]
    assert neighbours.knn(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        neighbours.knn(df, 3, "nope")
    with pytest.raises(ValueError):
        neighbours.knn(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, embedding array<double>"), 3)


def plain_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= eps
    core = near.sum(1) >= least
    comp = [None] * len(x)
    for i in range(len(x)):
        if core[i] and comp[i] is None:
            stack = [i]
            while stack:
                j = stack.pop()
                if comp[j] is None:
                    comp[j] = i
                    stack += [k for k in np.flatnonzero(near[j] & core).tolist() if comp[k] is None]
    return [comp[i] if core[i] else min([comp[j] for j in np.flatnonzero(near[i] & core)], default=None) for i in range(len(x))], core.tolist()


def test_dbscan_and_single_linkage(spark):
    x, df = data(spark, 80, 2)
    comp, core = plain_dbscan(x, 0.35, 4)
    got = {r.id: (r.comp, r.core) for r in density.dbscan(df, 0.35, 4).collect()}
    assert got == {i: (comp[i], core[i]) for i in range(len(x))}
    link, _ = plain_dbscan(x, 0.3, 1)
    assert {r.id: r.comp for r in density.single_linkage(df, 0.3).collect()} == dict(enumerate(link))


def test_spanning_forest():
    r = np.random.default_rng(6)
    for n, m in ((2, 1), (30, 60), (80, 400), (50, 30)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        a, b = np.minimum(a, b), np.maximum(a, b)
        real = a != b
        a, b, w = a[real] * 7, b[real] * 7, r.integers(0, 9, int(real.sum())).astype(float)
        parent, want = {int(x): int(x) for x in np.concatenate([a, b])}, 0.0

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        count = 0
        for k in np.lexsort((b, a, w)).tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                parent[x], want, count = y, want + w[k], count + 1
        got = spanning.spanning_forest(a, b, w)
        assert len(got) == count and w[got].sum() == want and (np.diff(w[got]) >= 0).all()


def test_rank_order_fixtures(spark):
    def lists(*rows):
        return spark.createDataFrame([(i, k + 1, n, 0.0) for i, row in enumerate(rows) for k, n in enumerate(row)], "id long, rank int, nbr long, dist double")

    got = {(r.id, r.nbr): r.d for r in rank_order.rank_order_distance(lists([0, 1, 2], [1, 0, 2], [2, 0, 1])).collect()}
    assert got[0, 1] == 0
    far = {(r.id, r.nbr): r.d for r in rank_order.rank_order_distance(lists([0, 1], [1, 2], [2, 1])).collect()}
    assert far[0, 1] == 9999 and far[1, 2] == 0
    assert {r.id: r.comp for r in rank_order.rank_order_clusters(lists([0, 1], [1, 2], [2, 1]), 1).collect()} == {0: 0, 1: 1, 2: 1}


def test_centroid_methods_recover_blobs(spark):
    blobs = toys.blobs(spark, 240).cache()
    truth = {r.id: r.label for r in blobs.collect()}

    def pure(found):
        groups = {}
        for r in found.collect():
            groups.setdefault(r.label, []).append(truth[r.id])
        return sum(max(map(g.count, set(g))) for g in groups.values()) / len(truth), len(groups)

    labels, cost = centroids.kmeans(blobs, 3)
    for found in (labels, centroids.minibatch_kmeans(blobs, 3, batch_rows=100), centroids.bisecting(blobs, 3), centroids.gaussian_mixture(blobs, 3)):
        share, n = pure(found)
        assert share > 0.9 and n == 3
    assert cost > 0


def test_transforms(spark):
    x, df = data(spark, 90, 6)
    unit = transform.unit_rows(df.unionByName(spark.createDataFrame([(99, [0.0] * 6)], "id long, embedding array<double>")))
    for r in unit.collect():
        assert (r.embedding[0] is None) if r.id == 99 else np.allclose(r.embedding, x[r.id] / np.linalg.norm(x[r.id]))
    got = np.array([r.embedding for r in transform.standardise(df).orderBy("id").collect()])
    assert np.allclose(got, (x - x.mean(0)) / x.std(0))
    mean, projection = transform.fit_whitening(df, dims=6)
    assert np.allclose(np.cov((x - mean) @ projection, rowvar=False, bias=True), np.eye(6))
    white = np.array([r.embedding for r in transform.whiten(df, mean, projection).orderBy("id").collect()])
    y = (x - x.mean(0)) @ np.linalg.inv(np.cov(x, rowvar=False, bias=True)) @ (x - x.mean(0)).T
    assert np.allclose(white @ white.T, y / np.sqrt(np.outer(y.diagonal(), y.diagonal())))


def test_toy_shapes(spark):
    for made in (toys.circles, toys.moons, toys.blobs, toys.uniform, toys.anisotropic):
        rows = made(spark, 100).collect()
        assert len(rows) == 100 and all(len(r.embedding) == 2 for r in rows)
        assert rows == made(spark, 100).collect()


def test_few_pairs_are_measured_exactly_while_lists_are_young(monkeypatch):
    r = np.random.default_rng(4)
    x, seen, real = r.normal(size=(8192, 24)), [], neighbours._pair_distances
    monkeypatch.setattr(neighbours, "_pair_distances", lambda a, b, metric: (seen.append(len(a)), real(a, b, metric))[1])
    for metric in ("cosine", "l2", "l1"):
        seen.clear()
        ids, rank, nbr, _ = neighbours._nearest(np.arange(200), x[:200], np.arange(8192), x, 15, metric)
        assert (nbr.reshape(200, 15) == np.argsort(neighbours._distances(x[:200], x, metric), axis=1, kind="stable")[:, :15]).all()
        assert sum(seen) <= 200 * 15 * 12  # before: 256 of the first rows and 120 of the next tile for each list


def test_a_larger_table_does_not_go_through_the_driver(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(3000, 400))  # 9.6 MB
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>").repartition(4)

    def refused(self):
        raise AssertionError("the table was collected")

    monkeypatch.setattr(type(df), "toArrow", refused)
    found = neighbours.knn(df, 3).filter("id % 100 = 0").orderBy("id", "rank").collect()
    want = np.argsort(neighbours._distances(x[::100], x, "cosine"), axis=1, kind="stable")[:, :3]
    assert [r.nbr for r in found] == want.ravel().tolist()
    assert neighbours.radius_counts(df, 1.0).filter("n < 1").count() == 0


def test_squared_distances_take_two_tiles():
    import tracemalloc

    x, y = np.random.default_rng(8).normal(size=(600, 8)), np.random.default_rng(9).normal(size=(700, 8))
    tracemalloc.start()
    d = neighbours._distances(x, y, "l2")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * d.nbytes
    assert np.array_equal(d, np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)))


def test_queries_become_lots_as_they_come():
    """A group's queries are taken batch by batch, so that they are not held twice."""
    started = []

    def batches():
        for i in range(3):
            assert sum(started) == 2048 * i
            x = np.ones((2048, 2))
            yield pa.RecordBatch.from_arrays([pa.array([7]), pa.array([0]), pa.array([np.arange(2048) + 2048 * i]), pa.array([x.ravel()])], ["group", "kind", "ids", "vs"])
        for kind, n in ((0, 100), (0, 50), (1, 30)):
            yield pa.RecordBatch.from_arrays([pa.array([7]), pa.array([kind]), pa.array([np.arange(n) + 10_000 * n]), pa.array([np.ones(2 * n)])], ["group", "kind", "ids", "vs"])

    lots = list(neighbours._streams(batches(), lambda ids, x: started.append(len(ids)) or (ids, x), lambda lot, ids, y: [(len(lot[0]), len(ids), lot[1].shape)], lambda lots: [len(lots)]))
    assert started == [2048, 2048, 2048, 150] and lots == [(2048, 30, (2048, 2))] * 3 + [(150, 30, (150, 2)), 4]


@pytest.mark.parametrize("metric", ["l2", "l1", "linf", "cosine", "angular"])
def test_radius_pairs_are_screened(monkeypatch, metric):
    """Of a tile with few pairs within the radius, those alone are measured."""
    r = np.random.default_rng(3)
    x, y = r.normal(size=(300, 32)), r.normal(size=(3000, 32))
    y[:40] = x[:40] * (1 + 1e-6)
    d = neighbours._distances(x, y, metric)
    radius = float(np.sort(d.ravel())[60])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d < radius * (1 - 1e-9)))}
    monkeypatch.setattr(neighbours, "_distances", None)
    ids, _, nbr, dist = neighbours._within(np.arange(300), x, np.arange(3000), y, radius, metric)
    found = set(zip(ids.tolist(), nbr.tolist()))
    assert want <= found and len(found) <= 62 and np.allclose(dist, d[ids, nbr], atol=1e-6)


def test_links_ask_core_rows_only(spark, monkeypatch):
    """The table that streams through the tasks has the core rows; a few of them still deal the queries to many tasks."""
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    core = spark.createDataFrame([(i,) for i in range(0, 400, 10)], "id long")
    tables, met, groups = [], neighbours._met, []
    monkeypatch.setattr(neighbours, "_met", lambda asked, blocks, n: tables.append(blocks.selectExpr("sum(size(ids))").first()[0]) or groups.append(n) or met(asked, blocks, n))
    links = neighbours.radius_links(df, core, 0.7, broadcast_bytes=0, block_rows=64).collect()
    assert tables == [40] and groups[0] > 1
    d = neighbours._distances(x, x, "l2")
    want = {(i, j) for i in range(400) for j in range(0, 400, 10) if i % 10 and d[i, j] <= 0.7}
    assert {(e.id, e.nbr) for e in links if e.border} == want and len(want) > 20
    assert all(e.id % 10 == 0 and e.nbr % 10 == 0 for e in links if not e.border)


def test_unit_rows_work_out_their_length_once(spark):
    """No lambda over the elements holds the sum over all elements."""
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id long, v array<double>")
    got = {r.id: r for r in df.select("id", vectors.normalise(F.col("v")).alias("u"), vectors.softmax(F.col("v")).alias("s")).collect()}
    assert got[1].u == [0.6, 0.8] and got[2].u == [None, None] and got[3].u is None and got[4].u == []
    assert got[1].s == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)]) and got[2].s == [0.5, 0.5] and got[3].s is None and got[4].s == []
    for f in (vectors.normalise, vectors.softmax):
        wide = spark.range(1).select(F.array(*[F.rand(i) for i in range(3)]).alias("v")).select(f(F.col("v")).alias("u"))
        plan = wide._jdf.queryExecution().analyzed().toString()
        inner = [part.split("namedlambdavariable")[0] for part in plan.split("/ ")[1:]]
        assert inner and all(not part.lstrip("(").startswith(("aggregate", "nullif", "sqrt", "if")) for part in inner)
