"""Size-bounded clusters of scored pairs under a rising threshold.

At each threshold the components of at most ``max_sz`` nodes are final; the
nodes of larger ones go on to the next threshold t + (1 - t) step, starting from
the smallest score. A first round uses all edges and is not counted; what is
left after ``max_iter`` rounds with a threshold (one at least) becomes one
cluster, connected or not.

Oversized components are independent of one another, so all whose edges number
at most ``local_edges`` finish their remaining rounds inside grouped tasks; only
larger ones take distributed rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.forest import min_roots
from kinweave.operators.components import LOCAL_EDGES, connected_components
from kinweave.sources.shared import discard, materialize

#: Links (both ways) that every task may hold: 12 bytes each.
LOCAL_LINKS = 4_000_000
BATCH_ROWS = 1 << 16
#: (root, node) rows of a lot of roots on the disk, by joins.
LOT_ROWS = 100_000_000


def bounded_components(pairs: DataFrame, max_sz: int, th: float | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, comp, size, kept): components of edges with ``score >= th``; kept if of at most ``max_sz`` nodes.

    Every node of ``pairs`` is listed, also one whose edges are all below ``th``.
    """
    edges = pairs if th is None else pairs.filter(F.col("score") >= th)
    found = connected_components(edges.select("a", "b"), local_edges=local_edges)
    if th is not None:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        found = nodes.join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    found = materialize(found, "components")
    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "comp").select("id", "comp", "size", (F.col("size") <= max_sz).alias("kept"))


def rounds_within(a: np.ndarray, b: np.ndarray, score: np.ndarray, th: float, done: int, max_sz: int, step: float, max_iter: int):
    """(ids, comps, leftover) after the thresholds ``done + 1`` to ``max_iter``; ``th`` is the last one used."""
    nodes = np.unique(np.concatenate([a, b]))
    ids, comps = [], []
    while len(nodes) and done < max_iter:
        done, th = done + 1, th + (1 - th) * step
        strong = score >= th
        linked, roots = min_roots(a[strong], b[strong])
        comp = nodes.copy()
        comp[np.searchsorted(nodes, linked)] = roots
        _, group, size = np.unique(comp, return_inverse=True, return_counts=True)
        small = size[group] <= max_sz
        ids.append(nodes[small])
        comps.append(comp[small])
        nodes = nodes[~small]
        inside = np.isin(a, nodes) & strong  # an edge once below the threshold stays below
        a, b, score = a[inside], b[inside], score[inside]
    return np.concatenate([*ids, nodes]), np.concatenate([*comps, nodes]), np.repeat([False, True], [sum(map(len, ids)), len(nodes)])


def propagate(pairs: DataFrame, max_sz: int, step: float = 0.1, max_iter: int = 100, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, comp) of every node of ``pairs`` (a, b, score); comp is the smallest member.

    Pairs must be unique. With ``max_iter`` 0 or 1 a single threshold follows the first round.
    """
    columns = "id long, comp long, leftover boolean"
    pairs = materialize(pairs.select("a", "b", F.col("score").cast("double").alias("score")).filter("a <> b"), "scored-pairs")
    th = pairs.agg(F.min("score")).first()[0]
    if th is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    final, current, done = [], pairs, 0
    last = max(max_iter, 1)
    while True:
        found = materialize(bounded_components(current, max_sz, th if done else None, local_edges), "bounded")
        final.append(found.filter("kept").select("id", "comp", F.lit(False).alias("leftover")))
        large = found.filter("not kept").select("id", "comp")
        if large.isEmpty():
            break
        if done >= last:
            final.append(large.withColumn("leftover", F.lit(True)))
            break
        ends = large.select(F.col("id").alias("a"), "comp").join(current, "a").filter(F.col("score") >= th)
        ends = materialize(ends.join(large.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b").filter("comp = cb").select("comp", "a", "b", "score"), "oversized")
        edges = ends.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        fit = edges.filter(F.col("n") <= local_edges).select("comp")
        at, so_far = th, done

        def finish(rows: pd.DataFrame) -> pd.DataFrame:
            ids, comps, leftover = rounds_within(rows.a.to_numpy(), rows.b.to_numpy(), rows.score.to_numpy(), at, so_far, max_sz, step, last)
            return pd.DataFrame({"id": ids, "comp": comps, "leftover": leftover})

        final.append(ends.join(fit, "comp", "left_semi").groupBy("comp").applyInPandas(finish, columns))
        rest = edges.filter(F.col("n") > local_edges)
        if rest.isEmpty():
            break
        current = materialize(ends.join(rest.select("comp"), "comp", "left_semi").select("a", "b", "score"), "oversized-rest")
        th, done = th + (1 - th) * step, done + 1
    every = final[0]
    for part in final[1:]:
        every = every.unionByName(part)
    every = materialize(every, "propagated")
    merged = every.filter("leftover").agg(F.min("id").alias("all_left"))
    return every.crossJoin(F.broadcast(merged)).select("id", F.when(F.col("leftover"), F.col("all_left")).otherwise(F.col("comp")).alias("comp"))  # one row


def _reached(root: int, heads: np.ndarray, to: np.ndarray, score: np.ndarray, max_depth: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, values) that a root reaches over the links of node i at heads[i] to heads[i + 1], which go both ways; a node takes the largest value of the level that reaches it first.

    Where the nodes left have fewer links than the level, these look for parents in it.
    """
    n = len(heads) - 1
    degree = np.diff(heads)
    left, best, fresh = len(to), np.full(n, -1.0), np.zeros(n, dtype=bool)
    value = np.full(n, np.nan)  # nan: not reached
    level, value[root], found = np.array([root]), 1.0, []
    left -= degree[root]

    def links(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = degree[nodes]
        ends = np.cumsum(size)
        return np.arange(ends[-1]) + np.repeat(heads[nodes] - (ends - size), size), size

    for _ in range(max_depth):
        if not left:
            break
        if degree[level].sum() <= left:
            at, size = links(level)
            v = to[at]
            new = np.isnan(value[v])
            v, x = v[new], (np.repeat(value[level], size)[new] * score[at[new]]) * decay
            fresh[v] = True
            np.maximum.at(best, v, x)
            level = np.flatnonzero(fresh)
            value[level] = best[level]
        else:
            fresh[level] = True
            nodes = np.flatnonzero(np.isnan(value) & (degree > 0))
            at, size = links(nodes)
            v = to[at]
            x = np.where(fresh[v], (value[v] * score[at]) * decay, -1.0)
            x = np.maximum.reduceat(x, np.cumsum(size) - size)
            fresh[level] = False
            level, x = nodes[x >= 0], x[x >= 0]
            value[level] = x
        fresh[level] = False
        if not len(level):
            break
        left -= degree[level].sum()
        found.append(level)
    nodes = np.concatenate(found) if found else np.zeros(0, np.int64)
    return nodes, value[nodes]


def _spread_local(links: DataFrame, starts: DataFrame, membership: DataFrame, max_depth: int, decay: float, normalise: bool) -> DataFrame:
    """Final (id, label, weight) of each node by itself; every task has the links and the roots (label, id).

    Links go both ways and have no negative scores, so what a root carries to a node
    is what the node would carry to the root, and a node's task needs no other's sums.
    """
    table = links.select("u", "v", "score").toArrow()  # LOCAL_LINKS rows at most
    u, v, score = (table.column(c).to_numpy() for c in range(3))
    nodes = np.unique(np.concatenate([u, v]))
    order = np.argsort(u, kind="stable")
    heads = np.searchsorted(u[order], np.append(nodes, np.iinfo(np.int64).max))
    to, score = np.searchsorted(nodes, v[order]).astype(np.int32), score[order].astype(np.float64)
    table = starts.select("id", "label").toArrow()  # of the links' nodes
    root, label = (table.column(c).to_numpy() for c in range(2))
    at = np.minimum(np.searchsorted(nodes, root), max(len(nodes) - 1, 0))
    linked = nodes[at] == root if len(nodes) else np.zeros(len(root), dtype=bool)
    labels, of = np.unique(label[linked], return_inverse=True)
    node, of = at[linked].astype(np.int32), of.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in zip(*held)], ["id", "label", "weight"])

        for batch in batches:
            for own, comp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = int(np.searchsorted(nodes, own))
                names, weight = np.array([comp]), np.ones(1)
                if at < len(nodes) and nodes[at] == own:
                    value = np.full(len(nodes), np.nan)
                    reached, carried = _reached(at, heads, to, score, max_depth, decay)
                    value[reached] = carried
                    value = value[node]
                    met = ~np.isnan(value)
                    if met.any():
                        some = np.zeros(len(labels), dtype=bool)
                        some[of[met]] = True
                        names, weight = labels[some], np.bincount(of[met], value[met], len(labels))[some]
                        place = int(np.searchsorted(names, comp))
                        if place < len(names) and names[place] == comp:
                            weight[place] += 1
                        else:
                            names, weight = np.append(names, comp), np.append(weight, 1.0)
                held.append((np.full(len(names), own), names, weight / weight.sum() if normalise else weight))
                rows += len(names)
                if rows >= BATCH_ROWS:
                    yield packed()
                    held, rows = [], 0
        if held:
            yield packed()

    dealt = membership.select("id", "comp").repartition(4 * links.sparkSession.sparkContext.defaultParallelism, "id")
    return dealt.mapInArrow(run, "id long, label long, weight double")


def _spread_joined(links: DataFrame, starts: DataFrame, max_depth: int, decay: float, lot_rows: int) -> list[DataFrame]:
    """The same by joins, level by level, for lots of labels whose roots may reach ``lot_rows`` rows; a lot's levels are deleted."""
    lots = max(1, -(-starts.count() * links.select("u").distinct().count() // lot_rows))
    out = []
    for lot in range(lots):
        own = starts.filter(F.pmod(F.xxhash64("label"), F.lit(lots)) == lot)
        level = materialize(own.select(F.col("id").alias("root"), "label", "id", F.lit(1.0).alias("value")), "level")
        levels = [level]
        for _ in range(max_depth):
            seen = levels[0].select("root", "id")
            for part in levels[1:]:
                seen = seen.unionByName(part.select("root", "id"))
            step = level.join(links, level.id == links.u).groupBy("root", "label", F.col("v").alias("id")).agg(F.max(F.col("value") * F.col("score") * decay).alias("value"))
            level = materialize(step.join(seen, ["root", "id"], "left_anti").select("root", "label", "id", "value"), "level")
            levels.append(level)
            if level.isEmpty():
                break
        reached = levels[1].select("id", "label", "value") if len(levels) > 1 else level.limit(0).select("id", "label", "value")
        for part in levels[2:]:
            reached = reached.unionByName(part.select("id", "label", "value"))
        out.append(materialize(reached.groupBy("id", "label").agg(F.sum("value").alias("weight")), "spread"))
        discard(*levels)
    return out


def diffuse(pairs: DataFrame, membership: DataFrame, roots: DataFrame, max_depth: int = 5, decay: float = 0.6, normalise: bool = True, local_links: int = LOCAL_LINKS, lot_rows: int = LOT_ROWS) -> DataFrame:
    """(id, label, weight): labels carried from the roots along all links.

    Level by level: a node first reached at a depth gets the largest of
    parent value * score * decay over its parents there; each node starts with
    weight 1 for its own label. ``membership`` has one row an id. Where the links (both
    ways) number at most ``local_links``, each node's labels are summed by the task that has
    the node, so no row of the result is shuffled; above, or with negative scores, by joins.
    """
    links = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "score")
    links = materialize(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "score")), "links")
    starts = materialize(roots.select("id").join(membership, "id").select(F.col("comp").alias("label"), "id"), "roots")
    size = links.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.count("score").alias("scores")).first()
    if size.n <= local_links and size.scores == size.n and decay >= 0 and (size.least or 0) >= 0:
        return _spread_local(links, starts, membership, max_depth, decay, normalise)
    out = membership.select("id", F.col("comp").alias("label"), F.lit(1.0).alias("weight"))
    for part in _spread_joined(links, starts, max_depth, decay, lot_rows):
        out = out.unionByName(part)
    out = out.repartition("id").groupBy("id", "label").agg(F.sum("weight").alias("weight"))
    if normalise:
        out = out.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("id")))
    return out


def propagate_soft(pairs: DataFrame, max_sz: int, step: float = 0.1, max_iter: int = 100, **diffusion) -> tuple[DataFrame, DataFrame]:
    """(membership, soft labels): propagation, then diffusion from the nodes that the first round did not settle."""
    membership = materialize(propagate(pairs, max_sz, step, max_iter), "membership")
    roots = bounded_components(pairs, max_sz).filter("not kept").select("id")
    return membership, diffuse(pairs, membership, roots, **diffusion)
