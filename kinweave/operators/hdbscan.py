"""HDBSCAN: the stablest clusters of the hierarchy of mutual reachability.

The exact spanning tree comes from ``spanning.reachability_tree``. Of each row,
``core_levels`` finds the level at which its part reaches ``min_size`` rows: the
``min_size``-th smallest of the row's minimax distances along the tree, which are
found by doubling the reach of short sorted lists. An edge whose ends were both
in such parts before is a split of the condensed tree; all other edges only bring
rows into one dense part. So the hierarchy falls apart into dense parts, of which
every row needs its part and its level, and the few splits between them. One task
gets the splits, a total for each part of the rows that came before its first
split, and the distinct levels of those that came later; it names the cluster
that each of these belongs to.

Levels of equal weight are one level, so the result does not depend on the order
of equal distances. Clusters are chosen by excess of mass; the whole hierarchy is
no cluster of its own unless ``single`` allows it.

Defined cases: rows without a vector and rows of no cluster have no comp; fewer
rows than ``min_size`` are all noise; equal vectors share all levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.operators.components import connected_components
from kinweave.operators.spanning import reachability_tree
from kinweave.sources.shared import discard, materialize

_EVENTS = "kind int, p long, q long, w double, n long, s double, low long"


def core_levels(tree: DataFrame, min_size: int) -> DataFrame:
    """(id, level) of the tree's nodes: the least weight at which a node reaches ``min_size`` nodes, itself counted; null if it never does."""
    nearest = Window.partitionBy("id").orderBy("t", "to")

    def shortest(reach: DataFrame) -> DataFrame:
        least = reach.groupBy("id", "to").agg(F.min("t").alias("t"))
        return materialize(least.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= min_size).drop("r"), "reach")

    both = tree.select(F.col("a").alias("id"), F.col("b").alias("to"), F.col("w").alias("t"))
    both = both.unionByName(tree.select(F.col("b").alias("id"), F.col("a").alias("to"), F.col("w").alias("t")))
    own = both.select("id", F.col("id").alias("to"), F.lit(-1.0).alias("t")).distinct()
    reach = shortest(both.unionByName(own))
    hops = 1
    while hops < min_size - 1:
        onward = reach.select(F.col("id").alias("to"), F.col("to").alias("end"), F.col("t").alias("t2"))
        before, reach = reach, shortest(reach.join(onward, "to").select("id", F.col("end").alias("to"), F.greatest("t", "t2").alias("t")))
        discard(before)
        hops *= 2
    return reach.groupBy("id").agg(F.when(F.count(F.lit(1)) >= min_size, F.greatest(F.max("t"), F.lit(0.0))).alias("level"))


def choose_clusters(p: np.ndarray, q: np.ndarray, w: np.ndarray, part: np.ndarray, level: np.ndarray, n: np.ndarray, s: np.ndarray, low: np.ndarray, single: bool = False) -> np.ndarray:
    """The cluster (its smallest row, or -1) of each event.

    Splits (p, q, w) join dense parts at level w. An event is ``n`` rows, ``low``
    the smallest, that are in ``part`` from ``level`` on (negative: before the
    part's first split); ``s`` sums their densities 1 / level.
    """
    names, ends = np.unique(np.concatenate([part, p, q]), return_inverse=True)
    at, a, b = ends[: len(part)], ends[len(part): len(part) + len(p)], ends[len(part) + len(p):]
    levels = np.unique(w)
    slot = np.where(level < 0, 0, np.searchsorted(levels, level, side="right"))  # splits at or below the event's level
    # nodes of the condensed tree: the dense parts, then one for each joining
    owner = list(range(len(names)))  # of parts
    node = list(range(len(names)))  # of owners
    size, mass = [0] * len(names), [0.0] * len(names)  # rows so far; densities of those that fall out here
    smallest, falls = [np.iinfo(np.int64).max] * len(names), [0] * len(names)
    kids: list[list[int]] = [[] for _ in names]
    top = [np.inf] * len(names)

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    event_node = np.zeros(len(part), dtype=np.int64)
    by_slot = np.argsort(slot, kind="stable")
    edges = np.argsort(w, kind="stable")
    e_at = k_at = 0
    for step in range(len(levels) + 1):
        while e_at < len(by_slot) and slot[by_slot[e_at]] == step:
            e = by_slot[e_at]
            x = node[find(int(at[e]))]
            event_node[e] = x
            size[x] += int(n[e])
            falls[x] += int(n[e])
            mass[x] += float(s[e])
            smallest[x] = min(smallest[x], int(low[e]))
            e_at += 1
        if step == len(levels):
            break
        joined: dict[int, set[int]] = {}
        while k_at < len(edges) and w[edges[k_at]] == levels[step]:
            i, j = find(int(a[edges[k_at]])), find(int(b[edges[k_at]]))
            k_at += 1
            if i != j:
                both = joined.pop(i, {node[i]}) | joined.pop(j, {node[j]})
                owner[j] = i
                joined[i] = both
        for i, parts in joined.items():
            new = len(size)
            size.append(sum(size[x] for x in parts))
            smallest.append(min(smallest[x] for x in parts))
            mass.append(sum(size[x] for x in parts) / max(levels[step], 1e-12))
            falls.append(sum(size[x] for x in parts))
            kids.append(sorted(parts))
            top.append(np.inf)
            node[i] = new
            for x in parts:
                top[x] = levels[step]
    stability = [mass[x] - falls[x] / max(top[x], 1e-12) if np.isfinite(top[x]) else mass[x] for x in range(len(size))]
    best, chosen = list(stability), [False] * len(size)
    for x in range(len(size)):  # parts come before what joins them
        inside = sum(best[y] for y in kids[x])
        root = not np.isfinite(top[x])
        chosen[x] = not (root and not single) and not (kids[x] and inside > stability[x])
        best[x] = stability[x] if chosen[x] else inside
    cluster = np.full(len(size), -1, dtype=np.int64)
    for x in range(len(size) - 1, -1, -1):
        if cluster[x] < 0 and chosen[x]:
            cluster[x] = smallest[x]
        for y in kids[x]:
            cluster[y] = cluster[x]
    return cluster[event_node]


def _events(batches: Iterator[pd.DataFrame], single: bool) -> Iterator[pd.DataFrame]:
    e = pd.concat(list(batches))
    splits, events = e[e.kind == 0], e[e.kind == 1]
    found = choose_clusters(*(splits[c].to_numpy() for c in ("p", "q", "w")), *(events[c].to_numpy() for c in ("p", "w", "n", "s", "low")), single)
    yield pd.DataFrame({"part": events.p.to_numpy(), "level": events.w.to_numpy(), "comp": found})[found >= 0]


def hdbscan(df: DataFrame, min_size: int, min_samples: int | None = None, id_col: str = "id", vec: str = "embedding", metric: str = "l2", single: bool = False, **blocks) -> DataFrame:
    """(id, comp): HDBSCAN clusters of at least ``min_size`` rows, named by their smallest row (null: noise).

    A row's core distance is that to its ``min_samples``-th nearest other row (by
    default ``min_size``).
    """
    if min_size < 2:
        raise ValueError("min_size must be at least 2")
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    tree = materialize(reachability_tree(df, (min_samples or min_size) + 1, metric, id_col, vec, **blocks), "spanning-tree")
    levels = materialize(core_levels(tree, min_size).filter("level is not null"), "core-levels")
    of = lambda end: levels.select(F.col("id").alias(end), F.col("level").alias(f"l{end}"))
    edges = tree.join(of("a"), "a").join(of("b"), "b").withColumn("split", F.expr("la < w and lb < w"))
    loops = levels.select("id", F.col("id").alias("to"))
    inside = edges.filter("not split").select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(loops)
    parts = materialize(connected_components(inside, "id", "to"), "dense-parts")
    name = lambda end: parts.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_part"))
    splits = materialize(edges.filter("split").join(name("a"), "a").join(name("b"), "b").select(F.col("a_part").alias("p"), F.col("b_part").alias("q"), "w"), "splits")
    firsts = splits.select("p", "w").unionByName(splits.select(F.col("q").alias("p"), "w")).groupBy("p").agg(F.min("w").alias("first"))
    rows = parts.join(levels, "id").join(firsts.withColumnRenamed("p", "comp"), "comp", "left")
    early = F.col("first").isNull() | (F.col("level") < F.col("first"))
    rows = materialize(rows.select("id", F.col("comp").alias("part"), "level", F.when(early, -1.0).otherwise(F.col("level")).alias("event")), "levels")
    density = 1 / F.greatest("level", F.lit(1e-12))
    events = rows.groupBy("part", "event").agg(F.count(F.lit(1)).alias("n"), F.sum(density).alias("s"), F.min("id").alias("low"))
    nothing = F.lit(0)
    all_ = splits.select(nothing.alias("kind"), "p", "q", "w", nothing.cast("long").alias("n"), F.lit(0.0).alias("s"), nothing.cast("long").alias("low"))
    all_ = all_.unionByName(events.select(F.lit(1).alias("kind"), F.col("part").alias("p"), F.col("part").alias("q"), F.col("event").alias("w"), "n", "s", "low"))
    if rows.isEmpty():
        return ids.withColumn("comp", F.lit(None).cast("long"))
    chosen = all_.coalesce(1).mapInPandas(lambda b: _events(b, single), "part long, level double, comp long")
    found = rows.join(chosen.withColumnRenamed("level", "event"), ["part", "event"]).select("id", "comp")
    return ids.join(found, "id", "left")
