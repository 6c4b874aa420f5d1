import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import delta_lloyd

SCHEMA = "vec_id long, embedding array<float>, q string, cluster string"


def plain(rows, clusters, rounds, dims, scale=64):
    """(id, vector) rows to the result, by comparing everything in every round with Python's integers."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            if sum((x * scale) ** 2 for x in v) < 2**60:
                kept.append((i, [math.floor(x * scale) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centre = [q for _, q in first[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min((square(q, c), k) for k, c in enumerate(centre))
    for _ in range(rounds):
        owners = [near(q)[1] for _, q in kept]
        for k in range(len(centre)):
            mine = [q for (_, q), o in zip(kept, owners) if o == k]
            if mine:
                centre[k] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [near(q) for _, q in kept]
    inertia = [sum(d for d, o in last if o == k) for k in range(len(centre))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted((repr(i), k, d, inertia[k], sum(inertia), digest[k]) for (i, _), (d, k) in zip(kept, last))


def run(spark, rows, clusters, rounds, dims):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ints = delta_lloyd.quantise(table, dims)
    got = delta_lloyd.cluster_digests(delta_lloyd.delta_lloyd(ints, clusters, rounds), ints).collect()
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def test_matches_plain_lloyd(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(0, 1 + i % 3, 5)], "a", "b") for i in range(300)]
    rows += [(7, rows[7][1], "a", "b")] * 150  # one vector holds a third of the rows
    for rounds in (0, 1, 3, 50):
        assert run(spark, rows, 6, rounds, 5) == plain(rows, 6, rounds, 5)


def test_odd_rows(spark):
    ok = [0.5, -0.25]
    rows = [
        (1, ok, None, None), (None, [0.1, 0.2], None, None), (2, None, None, None), (3, [], None, None), (4, [1.0], None, None), (5, [1.0, None], None, None),
        (6, [float("nan"), 1.0], None, None), (7, [float("inf"), 1.0], None, None), (8, [1e30, 0.0], None, None), (9, [-3.0, 2.0], None, None), (9, [-3.0, 2.0], None, None), (1, [4.0, 4.0], None, None),
    ]
    for clusters in (1, 2, 16):
        assert run(spark, rows, clusters, 3, 2) == plain(rows, clusters, 3, 2)
    assert run(spark, rows, 16, 3, 2)[0][0] == "1"
    assert run(spark, [], 4, 3, 2) == []
    same = [(i, ok, None, None) for i in range(20)]  # all in one place: later centroids stay empty
    got = run(spark, same, 4, 3, 2)
    assert got == plain(same, 4, 3, 2) and {g[1] for g in got} == {0}


def test_only_moved_centroids_and_owners_are_compared(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.normal(size=4)], None, None) for i in range(400)]
    ints = delta_lloyd.quantise(spark.createDataFrame(rows, SCHEMA), 4)
    found = delta_lloyd.delta_lloyd(ints, 12, 60)
    assert found.changed[0] == list(range(12)) and len(found.changed) < 61  # settled: no round was left to do
    assert any(0 < len(c) < 12 for c in found.changed)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.booleans())
def test_reassignment_equals_a_full_one(seed, k, large):
    r = np.random.default_rng(seed)
    top = 1 << 26 if large else 3
    x, centre = r.integers(-top, top, (40, 3)), r.integers(-top, top, (k, 3))
    d = delta_lloyd.squared_distances(x, centre)
    assert (d == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in centre] for p in x]).all()
    moved = r.random(k) < 0.5
    after = np.where(moved[:, None], r.integers(-top, top, (k, 3)), centre)
    cluster, distance = delta_lloyd.reassigned(x, d.argmin(1), d.min(1), after, moved)
    full = delta_lloyd.squared_distances(x, after)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_distances_beyond_exact_floats(scale):
    x = np.array([[int(5e8 * scale) % (1 << 29), 3], [-(1 << 29), 7]])
    got = delta_lloyd.squared_distances(x, x)
    assert got.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in x] for p in x]
