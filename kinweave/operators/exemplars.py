"""Affinity propagation over a table of similarities.

Rows tell their candidate exemplars how well these serve them (responsibility),
candidates tell rows how much support they have (availability); both are damped
and go on until the exemplars stay the same for ``settled`` rounds. Similarities
are dealt by row to parts of about ``PART_EDGES``, packed as arrays. A round is one
job: parts send the sums of their responsibilities to the part that a candidate is
at home in, which adds them up in order of the parts and answers those that asked,
so a candidate of many rows is a sum of few. Tables of at most ``LOCAL_EDGES``
similarities run in one task, in numpy.

Defined cases: every row is a candidate for itself at ``preference`` (by default
the median similarity); where no row becomes an exemplar, the row of the smallest
id is one; rows that know no exemplar become one of themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import neighbours
from kinweave.sources.shared import discard, materialize

LOCAL_EDGES = 2_000_000
PART_EDGES = 1 << 18
#: The arrays of a part: its rows, its candidates by (home, id), and of each similarity, by row and candidate, the places of both.
_ARRAYS = {"nodes": np.int64, "i": np.int32, "targets": np.int64, "home": np.int32, "k": np.int32, "s": np.float64, "r": np.float64, "a": np.float64, "chosen": np.bool_}
_HELD = ", ".join(f"{c} binary" for c in _ARRAYS)
_SUMS = "key long, source int, ids binary, sums binary, own binary"


def _responsibilities(i: np.ndarray, heads: np.ndarray, s: np.ndarray, r: np.ndarray, a: np.ndarray, damping: float) -> np.ndarray:
    """The next responsibilities of edges that are sorted by i and k."""
    both = a + s
    top = np.maximum.reduceat(both, heads)
    is_top = both == top[i]
    first = np.full(len(heads), len(s))
    np.minimum.at(first, i[is_top], np.flatnonzero(is_top))
    rest = both.copy()
    rest[first] = -np.inf
    second = np.maximum.reduceat(rest, heads)
    best = np.where(np.arange(len(s)) == first[i], second[i], top[i])
    return damping * r + (1 - damping) * (s - np.where(np.isfinite(best), best, 0.0))


def messages(i: np.ndarray, k: np.ndarray, s: np.ndarray, damping: float, rounds: int, settled: int) -> tuple[np.ndarray, np.ndarray]:
    """(responsibilities + availabilities, rounds taken) of edges (i, k, s) with one loop a node; i and k count from 0, sorted by i."""
    n, loop = int(i.max()) + 1, i == k
    heads = np.searchsorted(i, np.arange(n))
    r, a, last, same = np.zeros(len(s)), np.zeros(len(s)), None, 0
    for step in range(rounds):
        r = _responsibilities(i, heads, s, r, a, damping)
        good = np.where(loop, 0.0, np.maximum(r, 0))
        support = np.bincount(k, good, n)
        own = np.zeros(n)
        own[i[loop]] = r[loop]
        new = np.where(loop, support[k], np.minimum(0, own[k] + support[k] - good))
        a = damping * a + (1 - damping) * new
        chosen = (a + r)[loop] > 0
        same = same + 1 if last is not None and (chosen == last).all() else 0
        last = chosen
        if same >= settled and chosen.any():
            break
    return a + r, np.array(step + 1)


def _exemplars(i: np.ndarray, k: np.ndarray, s: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The exemplar of each node, given a + r."""
    n, loop = int(i.max()) + 1, i == k
    chosen = np.zeros(n, dtype=bool)
    chosen[i[loop]] = total[loop] > 0
    if not chosen.any():
        chosen[0] = True
    out = np.arange(n)
    reach = np.flatnonzero(chosen[k] & ~chosen[i])
    order = reach[np.lexsort((k[reach], -s[reach], i[reach]))]
    node, first = np.unique(i[order], return_index=True)
    out[node] = k[order[first]]
    return out


def similarities(df: DataFrame, k: int | None = 30, preference: float | None = None, id_col: str = "id", vec: str = "embedding", **options) -> DataFrame:
    """(i, k, s): minus squared distances of each row to its ``k`` nearest others, or to all with ``k`` None, and the preference of itself."""
    rows = materialize(neighbours._plain(df, id_col, vec, "l2"), "rows")
    n = rows.count()
    lists = neighbours.knn(rows, n if k is None else k + 1, "l2", "id", "v", **options).filter("id <> nbr") if n else rows.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("dist"))
    pairs = materialize(lists.select(F.col("id").alias("i"), F.col("nbr").alias("k"), (-F.col("dist") * F.col("dist")).alias("s")), "similarities")
    if preference is None:
        preference = pairs.agg(F.percentile("s", F.lit(0.5))).first()[0]
    own = rows.select(F.col("id").alias("i"), F.col("id").alias("k"), F.lit(float(preference or 0.0)).alias("s"))
    return pairs.unionByName(own)


def _told(part: int, held: dict, keys: list[int]) -> Iterator[dict]:
    """Rows of a part after its responsibilities: its arrays, and to each home the sums for the candidates there."""
    r, k, targets, home = held["r"], held["k"], held["targets"], held["home"]
    loop = held["nodes"][held["i"]] == targets[k]
    marks = held["nodes"][held["chosen"]]
    yield {"key": keys[part], "source": part, "n": len(marks), "h": zlib.crc32(marks.tobytes()), **{c: x.astype(_ARRAYS[c]).tobytes() for c, x in held.items()}}
    sums, own = np.bincount(k, np.where(loop, 0.0, np.maximum(r, 0)), len(targets)), np.zeros(len(targets))
    own[k[loop]] = r[loop]
    for h in np.unique(home):
        at = slice(*np.searchsorted(home, [h, h + 1]))
        yield {"key": keys[h], "source": part, "ids": targets[at].tobytes(), "sums": sums[at].tobytes(), "own": own[at].tobytes() if h == part else None}


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each key, by source."""
    found: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            found.setdefault(row["key"], []).append(row)
    while found:
        yield sorted(found.pop(next(iter(found))), key=lambda row: row["source"])


def _rows(rows, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(list(rows), pa.schema([(c, kinds[kind]) for c, kind in map(str.split, schema.split(", "))]))


def _distributed(edges: DataFrame, n: int, damping: float, rounds: int, settled: int) -> DataFrame:
    """(k) of the exemplars over ``n`` similarities (i, k, s), in parts that send each other sums."""
    spark, told = edges.sparkSession, f"n long, h long, {_SUMS}, {_HELD}"
    parts = max(-(-n // PART_EDGES), min(n, spark.sparkContext.defaultParallelism))
    keys = neighbours._even_keys(spark, parts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        part, i, k, home, s = (c.to_numpy() for c in table.columns)
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            at = at[np.lexsort((k[at], i[at]))]
            nodes, row = np.unique(i[at], return_inverse=True)
            ids, one, place = np.unique(k[at], return_index=True, return_inverse=True)
            order = np.lexsort((ids, home[at][one]))
            rank = np.argsort(order)
            nothing = np.zeros(len(at))
            r = _responsibilities(row, np.searchsorted(row, np.arange(len(nodes))), s[at], nothing, nothing, damping)
            held = {"nodes": nodes, "i": row, "targets": ids[order], "home": home[at][one][order], "k": rank[place], "s": s[at], "r": r, "a": nothing, "chosen": np.zeros(len(nodes), dtype=bool)}
            yield _rows(_told(int(p), held, keys), told)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asking in _by_key(batches):
            asking = [(row, np.frombuffer(row["ids"], np.int64)) for row in asking]
            (home, ids), = [(row, ids) for row, ids in asking if row["own"] is not None]  # every candidate lists itself
            own, total = np.frombuffer(home["own"]), np.zeros(len(ids))
            for row, some in asking:
                total[np.searchsorted(ids, some)] += np.frombuffer(row["sums"])
            for row, some in asking:
                at = np.searchsorted(ids, some)
                yield _rows([{"key": keys[row["source"]], "source": home["source"], "sums": total[at].tobytes(), "own": own[at].tobytes()}], _SUMS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            (mine,) = [row for row in rows if row["nodes"] is not None]
            support, own = (np.concatenate([np.frombuffer(row[c]) for row in rows if row["nodes"] is None]) for c in ("sums", "own"))
            held = {c: np.frombuffer(mine[c], kind) for c, kind in _ARRAYS.items()}
            i, k, r, a = held["i"], held["k"], held["r"], held["a"]
            loop = held["nodes"][i] == held["targets"][k]
            new = np.where(loop, support[k], np.minimum(0, own[k] + support[k] - np.maximum(r, 0)))
            a = damping * a + (1 - damping) * new
            held |= {"a": a, "chosen": (a + r)[loop] > 0, "r": _responsibilities(i, np.searchsorted(i, np.arange(len(held["nodes"]))), held["s"], r, a, damping)}
            yield _rows(_told(mine["source"], held, keys), told)

    place = lambda end: F.pmod(F.xxhash64(end), F.lit(parts)).cast("int")
    dealt = edges.select(place("i").alias("part"), "i", "k", place("k").alias("home"), "s")
    dealt = dealt.repartition(parts, F.element_at(F.array(*[F.lit(x).cast("long") for x in keys]), F.col("part") + 1))
    state, last, same = materialize(dealt.mapInArrow(first, told), "messages"), None, 0
    for _ in range(rounds):
        sums = state.filter("ids is not null").select("key", "source", "ids", "sums", "own").repartition(parts, "key").mapInArrow(answers, _SUMS)
        mine = state.filter("n is not null").select("key", "source", *_ARRAYS)
        both = mine.unionByName(sums.drop("ids"), allowMissingColumns=True).repartition(parts, "key")
        before, state = state, materialize(both.mapInArrow(step, told), "messages")
        discard(before)
        mark = sorted(tuple(m) for m in state.filter("n is not null").select("source", "n", "h").collect())  # a row a part
        same = same + 1 if mark == last else 0
        last = mark
        if same >= settled and sum(m[1] for m in mark):
            break

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["nodes"], np.int64)[np.frombuffer(row["chosen"], np.bool_)])], ["k"])

    return state.filter("n is not null").select("nodes", "chosen").mapInArrow(marked, "k long")


def propagate_affinity(edges: DataFrame, damping: float = 0.5, rounds: int = 200, settled: int = 15, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, exemplar) over similarities (i, k, s) with one loop a row."""
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and below 1")
    edges = materialize(edges.select("i", "k", "s"), "similarities")
    n = edges.count()
    if n <= local_edges:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = list(batches)
            if not sum(map(len, held)):
                return
            e = pd.concat(held).sort_values(["i", "k"])
            ids, i = np.unique(e.i.to_numpy(), return_inverse=True)
            k, s = np.searchsorted(ids, e.k.to_numpy()), e.s.to_numpy()
            total, _ = messages(i, k, s, damping, rounds, settled)
            yield pd.DataFrame({"id": ids, "exemplar": ids[_exemplars(i, k, s, total)]})

        return materialize(edges.coalesce(1).mapInPandas(run, "id long, exemplar long"), "exemplars")
    chosen = materialize(_distributed(edges, n, damping, rounds, settled), "exemplars")
    if chosen.isEmpty():
        chosen = materialize(edges.agg(F.min("i").alias("k")), "exemplars")
    ids = edges.filter("i = k").select("i")
    others = edges.join(chosen, "k", "left_semi").join(chosen.withColumnRenamed("k", "i"), "i", "left_anti")
    nearest = others.groupBy("i").agg(F.max(F.struct("s", (-F.col("k")).alias("k"))).alias("m")).select("i", (-F.col("m.k")).alias("exemplar"))
    return ids.join(nearest, "i", "left").select(F.col("i").alias("id"), F.coalesce("exemplar", "i").alias("exemplar"))


def affinity_propagation(df: DataFrame, damping: float = 0.5, preference: float | None = None, k: int | None = 30, id_col: str = "id", vec: str = "embedding", rounds: int = 200, settled: int = 15, local_edges: int = LOCAL_EDGES, **options) -> DataFrame:
    """(id, comp): each row's exemplar by its smallest row; rows without a vector are left out."""
    found = propagate_affinity(similarities(df, k, preference, id_col, vec, **options), damping, rounds, settled, local_edges)
    name = found.groupBy("exemplar").agg(F.min("id").alias("comp"))
    return found.join(name, "exemplar").select("id", "comp")
