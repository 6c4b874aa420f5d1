"""k-nearest-neighbour lists and radius graphs of vectors.

Vectors are packed into blocks (ids and a matrix as arrays), and pairs of blocks
are compared by matrix products in Arrow functions, ``TILE_ROWS`` by
``TILE_ROWS`` distances at once. Where the packed table is at most
``BROADCAST_BYTES`` (its size is counted first), every task gets all of it and
each query block meets all vectors in one step; beyond, lists of the k
nearest are made in groups of queries of at most ``GROUP_BYTES``: the task of a
group keeps their lists while all blocks of the table (about ``BLOCK_BYTES`` each)
stream through it, so a vector is copied once a group and lists leave a task
final. Radius graphs stream in the same way. Coarse numbers (single precision,
16-bit levels, bits) tell which pairs may enter a list; those are measured exactly.

``strategy="ivf"`` is the approximate form for large tables: vectors are dealt
to the cells of centroids fitted on a bounded sample, and every query meets the
rows of the ``probes`` nearest cells only. The table streams through groups of
queries as for exact lists, and a vector is copied once a group, not once a query's
cell; lots of queries that lie together leave out the rows of cells that none of
them asks. Where ``probes`` is not
given, it is the least number with which ``QUERY_ROWS`` rows find ``RECALL`` of
their exact neighbours among all rows.

``descent`` (refined neighbour lists) and ``kd`` (randomised trees) are the forms of
``kinweave.operators.ann``.

Rank counts from 1 and includes the vector itself; ties go to the smaller id.
Zero or null vectors, and ones with NaN, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.forest import star_forest
from kinweave.functions.vectors import METRICS
from kinweave.sources.shared import discard, materialize

TILE_ROWS = 2048
FIRST_ROWS = 256  # of the table, before a row has a full list
FOLD_ROWS = 64
PAIR_ROWS = 1 << 16
HAMMING_BITS = 1024
DENSE = 16  # a share of pairs, above which all of a tile are measured
BLOCK_BYTES = 16 << 20
BROADCAST_BYTES = 8 << 20  # goes through the driver, and to every Python worker of an executor
GROUP_BYTES = 128 << 20
SAMPLE_ROWS = 20_000
QUERY_ROWS = 256
RECALL = 0.93  # of the queries, so that all rows are above 0.9


def _plain(df: DataFrame, id_col: str, vec: str, metric: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    kind = "array<long>" if metric == "hamming" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast(kind).alias("v")).filter("id is not null and size(v) > 0")
    if metric == "hamming":
        return rows
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    return rows.filter(F.exists("v", lambda x: x != 0)) if metric in ("cosine", "angular") else rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """All distances of rows of x to rows of y."""
    if metric in ("cosine", "angular"):
        unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
        cos = unit(x) @ unit(y).T
        return 1 - cos if metric == "cosine" else np.arccos(np.clip(cos, -1, 1))
    if metric == "l2":
        square, cross = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :], x @ y.T  # two tiles, worked on in place
        cross *= 2
        square -= cross
        del cross
        return np.sqrt(np.maximum(square, 0, out=square))
    out = np.zeros((len(x), len(y)), dtype=np.int64 if metric == "hamming" else np.float64)
    for j in range(x.shape[1]):
        if metric == "hamming":
            out += np.bitwise_count((x[:, j, None] ^ y[None, :, j]).view(np.uint64))
        elif metric == "l1":
            out += np.abs(x[:, j, None] - y[None, :, j])
        else:
            np.maximum(out, np.abs(x[:, j, None] - y[None, :, j]), out=out)
    return out


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of each row, ties to the earlier column."""
    if k >= d.shape[1]:
        return tuple(a.ravel() for a in np.indices(d.shape))
    edge = np.partition(d, k - 1, axis=1)[:, k - 1:k]
    near = d <= edge
    many = np.flatnonzero(near.sum(1) > 2 * k)  # rows with many ties at the edge
    if len(many):
        near[many] = False
        near[many[:, None], np.argsort(d[many], axis=1, kind="stable")[:, :k]] = True
    return np.nonzero(near)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _pair_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of x to the same rows of y (unit rows for cosine and angular); equal rows get equal values."""
    if metric in ("cosine", "angular"):
        cos = np.einsum("ij,ij->i", x, y)
        return 1 - cos if metric == "cosine" else np.arccos(np.clip(cos, -1, 1))
    if metric == "hamming":
        return np.bitwise_count((x ^ y).view(np.uint64)).sum(1).astype(np.float64)  # of signed numbers it would count the absolute value's
    off = x - y
    if metric == "l2":
        return np.sqrt(np.einsum("ij,ij->i", off, off))
    return np.abs(off).sum(1) if metric == "l1" else np.abs(off).max(1)


def _folded(x: np.ndarray, y: np.ndarray, fold: Callable) -> np.ndarray:
    """``fold`` (add or maximum) of the components' differences of rows of x to rows of y, in parts that stay in the cache."""
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    out = np.zeros((len(x), len(y)), dtype=x.dtype)
    room = np.empty((FOLD_ROWS, len(y)), dtype=x.dtype)
    for at in range(0, len(x), FOLD_ROWS):
        part = out[at:at + FOLD_ROWS]
        off = room[:len(part)]
        for j in range(len(xt)):
            np.subtract(xt[j, at:at + FOLD_ROWS, None], yt[j], out=off)
            np.abs(off, out=off)
            fold(part, off, out=part)
    return out


def _candidates(x: np.ndarray, y: np.ndarray, cut: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, column), by rows, of all pairs whose distance may be at most the row's ``cut``."""
    return _places(_near(x, y, cut, metric))


def _near(x: np.ndarray, y: np.ndarray, cut: np.ndarray, metric: str) -> np.ndarray:
    """Flags of all pairs: whether the distance may be at most the row's ``cut``; coarse numbers with their error allowed for.

    Rows are unit rows for cosine and angular.
    """
    width, small = x.shape[1], float(np.finfo(np.float32).eps)
    if metric in ("cosine", "angular"):
        least = 1 - cut if metric == "cosine" else np.where(cut >= np.pi, -np.inf, np.cos(np.minimum(cut, np.pi)))
        near = x.astype(np.float32) @ y.astype(np.float32).T >= (least - 2 * small * (width + 8)).astype(np.float32)[:, None]
    elif metric == "hamming":
        varying = np.bitwise_or.reduce(x ^ x[0], axis=0) | np.bitwise_or.reduce(y ^ x[0], axis=0)
        at, bit = np.nonzero((varying[:, None] >> np.arange(64)) & 1)
        if len(at) > HAMMING_BITS:
            near = _distances(x, y, metric) <= cut[:, None]
        else:
            bits = lambda m: ((m[:, at] >> bit) & 1).astype(np.float32)
            ones = bits(x)
            near = (1 - 2 * ones) @ bits(y).T <= (cut - ones.sum(1)).astype(np.float32)[:, None]
    elif metric == "l2":
        own, other = (x * x).sum(1), (y * y).sum(1)
        error = 4 * small * (width + 8) * (own + other.max(initial=0))
        if own.max(initial=0) + other.max(initial=0) > 1e30:
            near = _distances(x, y, metric) <= cut[:, None] * (1 + 1e-6) + np.sqrt(error)[:, None]
        else:
            wide = lambda m, last: np.concatenate([m, last[:, None]], axis=1).astype(np.float32)
            near = wide(x, np.ones(len(x))) @ wide(y, -other / 2).T >= ((own - cut * cut - error) / 2).astype(np.float32)[:, None]
    else:
        low, levels = min(x.min(), y.min()), 32767 // (width if metric == "l1" else 1) - 1
        step = (max(x.max(), y.max()) - low) / max(levels, 1)
        if levels < 64 or not step > 1e-290:
            near = _distances(x, y, metric) <= cut[:, None] * (1 + 1e-9)
        else:
            coarse = [np.floor((m - low) / step).astype(np.int16) for m in (x, y)]
            terms = width if metric == "l1" else 1  # a difference of floors is at most one above that of the numbers
            most = np.minimum(np.ceil(cut / step * (1 + 1e-9)) + 2 * terms, 32767).astype(np.int16)
            near = _folded(*coarse, np.add if metric == "l1" else np.maximum) <= most[:, None]
    return near


def _places(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column), by rows, of the true ones, which are few: eight flags are looked at together."""
    flat = np.ascontiguousarray(near).ravel()
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    word, bit = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    at = np.concatenate([some[word] * 8 + bit, whole + np.flatnonzero(flat[whole:])])
    return at // near.shape[1], at % near.shape[1]


def _first_cut(x: np.ndarray, y: np.ndarray, k: int, metric: str) -> np.ndarray:
    """Of each row of x a distance that at least k rows of y (k or more) are within, rounding allowed for."""
    edge = np.partition(_distances(x, y, metric), k - 1, axis=1)[:, k - 1].astype(np.float64)
    if metric == "l2":  # by squares, whose error is of the lengths' size
        edge = np.sqrt(edge * edge + 1e-12 * ((x * x).sum(1) + (y * y).sum(1).max(initial=0)))
    edge = edge * (1 + 1e-9) + (1e-6 if metric == "angular" else 1e-12 if metric == "cosine" else 0)
    return np.where(np.isnan(edge), np.inf, edge)


class _Lists:
    """The ``k`` nearest of each row of ``x``, as far as it has met the table."""

    def __init__(self, x: np.ndarray, k: int, metric: str, within: float = np.inf) -> None:
        self.k, self.metric, self.within, self.x = k, metric, within, _unit(x) if metric in ("cosine", "angular") else x
        self.value, self.nbr = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        self.filled, self.seen = np.zeros(len(x), dtype=np.int64), 0

    def placed(self, y: np.ndarray) -> np.ndarray:
        """Rows of the table as ``add`` takes them."""
        return _unit(y) if self.metric in ("cosine", "angular") else y

    def add(self, base_ids: np.ndarray, y: np.ndarray) -> None:
        at = 0
        while at < len(base_ids):
            # lists are poor at first: a lot as large as all before it brings about k rows that may enter
            lot = TILE_ROWS if np.isfinite(self.within) else min(TILE_ROWS, max(FIRST_ROWS, self.k, self.seen))
            tile = slice(at, at + lot)
            cut = np.where(self.filled < self.k, self.within, self.value[:, -1])
            if len(y[tile]) >= self.k and not self.filled.any() and not np.isfinite(self.within):
                cut = _first_cut(self.x, y[tile], self.k, self.metric)
            self._take(*_candidates(self.x, y[tile], cut, self.metric), base_ids[tile], y[tile])
            at += lot
            self.seen += lot

    def _take(self, row: np.ndarray, col: np.ndarray, base_ids: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(row), PAIR_ROWS):
            r, c = row[at:at + PAIR_ROWS], col[at:at + PAIR_ROWS]
            self._enter(r, base_ids[c], _pair_distances(self.x[r], y[c], self.metric))

    def _enter(self, r: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
        wins = (d < self.value[r, -1]) | (self.filled[r] < self.k) | ((d == self.value[r, -1]) & (i < self.nbr[r, -1]))
        wins &= d <= self.within
        if wins.any():
            self._merge(r[wins], i[wins], d[wins])

    def _merge(self, r: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
        own, count = np.unique(r, return_counts=True)
        held = np.arange(self.k) < self.filled[own, None]
        row, nbr = np.concatenate([np.repeat(own, held.sum(1)), r]), np.concatenate([self.nbr[own][held], i])
        value = np.concatenate([self.value[own][held], d])
        order = np.lexsort((nbr, value, row))
        row, nbr, value = row[order], nbr[order], value[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < self.k
        self.value[row[kept], rank[kept]], self.nbr[row[kept], rank[kept]] = value[kept], nbr[kept]
        self.filled[own] = np.minimum(self.filled[own] + count, self.k)

    def found(self) -> tuple:
        """(row, rank, neighbour, distance) arrays."""
        row, at = np.nonzero(np.arange(self.k) < self.filled[:, None])
        return row, at + 1, self.nbr[row, at], self.value[row, at]


class _CellLists(_Lists):
    """The ``k`` nearest of each row among those that lie in a cell that it asks; ``asked`` has a bit for each row and cell."""

    def __init__(self, x: np.ndarray, k: int, metric: str, asked: np.ndarray) -> None:
        super().__init__(x, k, metric)
        self.asked, self.some = asked, np.unpackbits(np.bitwise_or.reduce(asked, axis=0)) > 0

    def add(self, base_ids: np.ndarray, y: np.ndarray, cells: np.ndarray) -> None:
        """Rows of the table and the cells that they lie in, one a column."""
        kept = self.some[cells].any(1)
        if not kept.all():
            base_ids, y, cells = base_ids[kept], y[kept], cells[kept]
        at = 0
        while at < len(base_ids):
            lot = min(TILE_ROWS, max(FIRST_ROWS, self.k, self.seen))
            tile = slice(at, at + lot)
            row, col = _candidates(self.x, y[tile], np.where(self.filled < self.k, np.inf, self.value[:, -1]), self.metric)
            for some in range(0, len(row), PAIR_ROWS):
                r, c = row[some:some + PAIR_ROWS], col[some:some + PAIR_ROWS]
                cell = cells[tile][c]
                met = (self.asked[r[:, None], cell >> 3] >> (7 - (cell & 7)) & 1).any(1)
                self._take(r[met], c[met], base_ids[tile], y[tile])
            at += lot
            self.seen += lot


def _nearest(ids: np.ndarray, x: np.ndarray, base_ids: np.ndarray, y: np.ndarray, k: int, metric: str, within: float = np.inf):
    """(id, rank, neighbour, distance) arrays of the k nearest."""
    lists = _Lists(x, min(k, len(base_ids)), metric, within)
    lists.add(base_ids, lists.placed(y))
    row, rank, nbr, value = lists.found()
    return ids[row], rank, nbr, value


def _inside(x: np.ndarray, y: np.ndarray, radius: float, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, distance) of all pairs within the radius, by tiles of y; coarse numbers screen the pairs unless most pass."""
    if metric in ("cosine", "angular"):
        x, y = _unit(x), _unit(y)
    cut = np.full(len(x), radius * (1 + 1e-9) + (1e-6 if metric == "angular" else 1e-12 if metric == "cosine" else 0))
    for at in range(0, len(y), TILE_ROWS):
        tile = y[at:at + TILE_ROWS]
        near = _near(x, tile, cut, metric)
        if np.count_nonzero(near) * DENSE > near.size:
            d = _distances(x, tile, metric)
            row, col = np.nonzero(d <= radius)
            yield row, at + col, d[row, col].astype(np.float64)
            continue
        row, col = _places(near)
        for lot in range(0, len(row), PAIR_ROWS):
            r, c = row[lot:lot + PAIR_ROWS], col[lot:lot + PAIR_ROWS]
            d = _pair_distances(x[r], tile[c], metric)
            kept = d <= radius
            yield r[kept], at + c[kept], d[kept]


def _within(ids, x, base_ids, y, radius: float, metric: str):
    """(id, 0, neighbour, distance) of all pairs within the radius."""
    found = [(ids[:0], np.zeros(0, dtype=np.int64), base_ids[:0], np.zeros(0))]
    for row, col, d in _inside(x, y, radius, metric):
        found.append((ids[row], np.zeros(len(row), dtype=np.int64), base_ids[col], d))
    return tuple(np.concatenate(part) for part in zip(*found))


_LIST = "id long, rank int, nbr long, dist double"


def _list_batch(found) -> pa.RecordBatch:
    ids, rank, nbr, dist = found
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rank, pa.int32()), pa.array(nbr, pa.int64()), pa.array(dist, pa.float64())], ["id", "rank", "nbr", "dist"])


def _against(base_ids: np.ndarray, base: np.ndarray, compare: Callable, pack: Callable = _list_batch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                yield pack(compare(part.column(0).to_numpy(), _matrix(part.column(1)), base_ids, base))

    return run


def _blocks(rows: DataFrame, n: int, block_rows: int) -> DataFrame:
    """(block, ids, vs) with about ``block_rows`` vectors each, ids ascending."""
    count = max(1, -(-n // block_rows))
    packed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count))).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("m"))
    return packed.select("block", F.col("m.id").alias("ids"), F.flatten("m.v").alias("vs"))


def _pair_batches(compare: Callable, pack: Callable = _list_batch):
    def matrix(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values.reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vs, base_ids, base_vs = (batch.column(c)[i].values.to_numpy() for c in range(4))
                x, y = matrix(ids, vs), matrix(base_ids, base_vs)
                for at in range(0, len(ids), TILE_ROWS):
                    yield pack(compare(ids[at:at + TILE_ROWS], x[at:at + TILE_ROWS], base_ids, y))

    return run


def _even_keys(spark, n: int) -> list[int]:
    """A key for each of n partitions by hash, so that none of them gets two."""
    found = spark.range(40 * n + 200, numPartitions=1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("key")).collect() if n > 1 else []
    keys = {r.p: r.key for r in found}  # n rows
    return [keys.get(p, 40 * n + 200 + p) for p in range(n)]


def _met(asked: DataFrame, blocks: DataFrame, groups: int) -> DataFrame:
    """Rows (group, kind, ids, vs): in each of ``groups`` partitions a share of the asked blocks (kind 0), then all blocks of the table (kind 1)."""
    keys = F.array(*[F.lit(k).cast("long") for k in _even_keys(blocks.sparkSession, groups)])
    asking = asked.select(F.element_at(keys, (F.pmod("block", F.lit(groups)) + 1).cast("int")).alias("group"), F.lit(0).alias("kind"), "ids", "vs")
    base = blocks.select(F.explode(keys).alias("group"), F.lit(1).alias("kind"), "ids", "vs")
    return asking.unionByName(base).repartition(groups, "group").sortWithinPartitions("group", "kind")


def _streams(batches: Iterator[pa.RecordBatch], start: Callable, meet: Callable, end: Callable, order: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Goes through rows of ``_met``: ``start`` takes lots of queries (ids, matrix), in the order that ``order`` gives, ``meet`` runs of the table, ``end`` closes a group; each yields batches."""
    group, asked, base, lots = None, [], [], None

    def start_lots(whole: bool) -> None:
        """Lots of the queries at hand; what is no whole lot waits for more, unless it is all there is."""
        nonlocal asked, lots
        if not asked:
            return
        ids, x = (np.concatenate(part) for part in zip(*asked))  # a copy: the batch that they came in may go
        asked, lots = [], lots or []
        if order:
            place = order(x)
            ids, x = ids[place], x[place]
        full = len(ids) if whole else len(ids) // TILE_ROWS * TILE_ROWS
        for at in range(0, full, TILE_ROWS):
            lots.append(start(ids[at:at + TILE_ROWS].copy(), x[at:at + TILE_ROWS].copy()))
        if full < len(ids):
            asked.append((ids[full:].copy(), x[full:].copy()))

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal base
        start_lots(True)
        if base and lots:
            ids, y = base[0] if len(base) == 1 else (np.concatenate(part) for part in zip(*base))
            base = []
            for lot in lots:
                yield from meet(lot, ids, y)
        base = []

    for batch in batches:
        groups, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at in range(batch.num_rows):
            if groups[at] != group:
                yield from flush()
                if lots:
                    yield from end(lots)
                group, lots = groups[at], None
            own, vs = batch.column(2)[at].values.to_numpy(), batch.column(3)[at].values.to_numpy()
            (base if kinds[at] else asked).append((own, vs.reshape(len(own), -1)))
            if kinds[at] and sum(len(i) for i, _ in base) >= TILE_ROWS:
                yield from flush()
            elif not order and sum(len(i) for i, _ in asked) >= TILE_ROWS:
                start_lots(False)
    yield from flush()
    if lots:
        yield from end(lots)


def _compared(rows: DataFrame, compare: Callable, block_rows: int | None, broadcast_bytes: int, queries: DataFrame | None = None, pack: Callable = _list_batch, schema: str = _LIST) -> tuple[DataFrame, bool]:
    """(lists, whether each list is already final) of ``queries``, by default all, against ``rows``."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("values"), F.count_distinct(F.size("v")).alias("widths")).first()
    asking = rows if queries is None else queries
    if size.n == 0:
        return rows.sparkSession.createDataFrame([], schema), True
    if size.widths != 1:
        raise ValueError("vectors differ in width")
    n = size.n if queries is None else max(1, queries.count())
    if size["values"] * 8 <= broadcast_bytes:
        table = rows.orderBy("id").toArrow()
        base_ids, base = table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks())
        lots = min(-(-n // TILE_ROWS), 4 * rows.sparkSession.sparkContext.defaultParallelism)
        asking = asking.repartition(lots, "id") if lots > 1 else asking  # a file may be one split
        return asking.mapInArrow(_against(base_ids, base, compare, pack), schema), True
    block_rows = block_rows or _block_rows(rows, size)
    blocks = materialize(_blocks(rows, size.n, block_rows), "vector-blocks")
    own_rows = min(block_rows, -(-n // (2 * rows.sparkSession.sparkContext.defaultParallelism)))  # queries may outnumber the table
    asked = blocks if queries is None else materialize(_blocks(queries, n, own_rows), "vector-blocks")
    groups = _groups(rows, size, block_rows) if queries is None else min(-(-n // own_rows), max(-(-n * (size["values"] // size.n) * 8 // GROUP_BYTES), rows.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _streams(batches, lambda ids, x: (ids, x), lambda lot, ids, y: [pack(compare(*lot, ids, y))], lambda lots: [])

    return _met(asked, blocks, groups).mapInArrow(run, schema), False


def _block_rows(rows: DataFrame, size) -> int:
    """Rows of a block: of ``BLOCK_BYTES`` at most, and few enough for every core to get two."""
    even = -(-size.n // (2 * rows.sparkSession.sparkContext.defaultParallelism))
    return max(1, min(BLOCK_BYTES // max(8 * (size["values"] // size.n), 1), max(TILE_ROWS, even)))


def _groups(rows: DataFrame, size, block_rows: int) -> int:
    return min(-(-size.n // block_rows), max(-(-size["values"] * 8 // GROUP_BYTES), rows.sparkSession.sparkContext.defaultParallelism))


def _ended(lots: list) -> Iterator[pa.RecordBatch]:
    """The lists of lots (ids, lists)."""
    for own, held in lots:
        row, rank, nbr, value = held.found()
        yield _list_batch((own[row], rank, nbr, value))


def _exact(rows: DataFrame, k: int, metric: str, block_rows: int | None, broadcast_bytes: int, within: float = np.inf) -> DataFrame:
    """Exact lists of all rows."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("values"), F.count_distinct(F.size("v")).alias("widths")).first()
    if size.n == 0 or size.widths != 1 or size["values"] * 8 <= broadcast_bytes:
        return _compared(rows, lambda i, x, j, y: _nearest(i, x, j, y, k, metric, within), block_rows, broadcast_bytes)[0]
    block_rows = block_rows or _block_rows(rows, size)
    blocks = materialize(_blocks(rows, size.n, block_rows), "vector-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_of = [None, None]  # of the table, and the same as lists take it

        def meet(lot, ids: np.ndarray, y: np.ndarray) -> list:
            if run_of[0] is not y:
                run_of[:] = y, lot[1].placed(y)
            lot[1].add(ids, run_of[1])
            return []

        yield from _streams(batches, lambda ids, x: (ids, _Lists(x, min(k, size.n), metric, within)), meet, _ended)

    return _met(blocks, blocks, _groups(rows, size, block_rows)).mapInArrow(run, _LIST)


def _searched(rows: DataFrame, lists: Callable, block_rows: int | None, broadcast_bytes: int, queries: DataFrame) -> DataFrame:
    """Entries (rank from 1) of the lists that ``lists`` starts for lots of ``queries`` and that meet all ``rows``, and (rank 0) each list's last value, infinite where it is not full."""

    def ended(ids: np.ndarray, held: _Lists) -> tuple:
        row, rank, nbr, value = held.found()
        return np.concatenate([ids[row], ids]), np.concatenate([rank, np.zeros(len(ids), rank.dtype)]), np.concatenate([nbr, ids]), np.concatenate([value, held.value[:, -1]])

    def compare(ids: np.ndarray, x: np.ndarray, base_ids: np.ndarray, y: np.ndarray) -> tuple:
        held = lists(x)
        held.add(base_ids, y)
        return ended(ids, held)

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("values"), F.count_distinct(F.size("v")).alias("widths")).first()
    if size.n == 0 or size.widths != 1 or size["values"] * 8 <= broadcast_bytes:
        return materialize(_compared(rows, compare, block_rows, broadcast_bytes, queries)[0], "searched")
    block_rows = block_rows or _block_rows(rows, size)
    n = max(1, queries.count())
    lot = min(block_rows, max(FIRST_ROWS, -(-n // max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * (size["values"] // size.n) * 8 // GROUP_BYTES)))))
    blocks, asked = materialize(_blocks(rows, size.n, block_rows), "vector-blocks"), materialize(_blocks(queries, n, lot), "asked-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meet(lot, ids: np.ndarray, y: np.ndarray) -> list:
            lot[1].add(ids, y)
            return []

        yield from _streams(batches, lambda ids, x: (ids, lists(x)), meet, lambda lots: (_list_batch(ended(*lot)) for lot in lots))

    found = materialize(_met(asked, blocks, min(-(-n // lot), _groups(rows, size, block_rows))).mapInArrow(run, _LIST), "searched")
    discard(blocks, asked)
    return found


def _cut(lists: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("id").orderBy("dist", "nbr")
    return lists.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)


def knn(
    df: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vec: str = "embedding", strategy: str = "exact",
    block_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, cells: int | None = None, probes: int | None = None, scaled: bool = False, within: float = np.inf,
) -> DataFrame:
    """(id, rank, nbr, dist): the k nearest of each vector, itself included.

    ``scaled`` divides distances by the largest one (for non-cosine metrics).
    ``within`` leaves out entries of the exact lists that are farther.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        raise ValueError("k must be positive")
    rows = _plain(df, id_col, vec, metric)
    if strategy == "ivf":
        lists = _ivf(rows, k, metric, cells, probes, block_rows)
    elif strategy in ("descent", "kd"):
        from kinweave.operators import ann

        lists = ann.descent(rows, k, metric) if strategy == "descent" else ann.kd_forest(rows, k, metric)
    elif strategy != "exact":
        raise ValueError(f"unknown strategy {strategy!r}")
    else:
        lists = _exact(rows, k, metric, block_rows, broadcast_bytes, within)
    if scaled:
        lists = materialize(lists, "knn")
        top = lists.agg(F.max("dist").alias("top"))
        lists = lists.crossJoin(F.broadcast(top)).withColumn("dist", F.col("dist") / F.nullif("top", F.lit(0.0))).drop("top")  # one row
    return lists.select("id", "rank", "nbr", "dist")


def radius_pairs(df: DataFrame, radius: float, metric: str = "l2", id_col: str = "id", vec: str = "embedding", block_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, nbr, dist) of all directed pairs within ``radius``, self included."""
    lists, _ = _compared(_plain(df, id_col, vec, metric), lambda i, x, j, y: _within(i, x, j, y, radius, metric), block_rows, broadcast_bytes)
    return lists.select("id", "nbr", "dist")


def radius_counts(df: DataFrame, radius: float, metric: str = "l2", id_col: str = "id", vec: str = "embedding", block_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n): how many vectors are within ``radius`` of each, itself included; pairs do not leave their task."""

    def count(ids, x, base_ids, y):
        n = np.zeros(len(ids), dtype=np.int64)
        for row, _, _ in _inside(x, y, radius, metric):
            n += np.bincount(row, minlength=len(ids))
        return ids, np.zeros(len(ids)), n, np.zeros(len(ids))

    lists, _ = _compared(_plain(df, id_col, vec, metric), count, block_rows, broadcast_bytes)
    return lists.groupBy("id").agg(F.sum("nbr").alias("n"))


def radius_links(df: DataFrame, core: DataFrame, radius: float, metric: str = "l2", id_col: str = "id", vec: str = "embedding", block_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, nbr, border): edges that connect what pairs of ``core`` rows within ``radius`` connect, and of every other row the core rows near it.

    All rows meet the core rows; each run of tiles leaves a spanning forest of its core pairs.
    """
    rows = _plain(df, id_col, vec, metric)
    flag = F.when(F.col("core"), 1).otherwise(0).cast("long" if metric == "hamming" else "double")
    rows = rows.join(core.select("id", F.lit(True).alias("core")), "id", "left").select("id", F.concat("v", F.array(flag)).alias("v"))
    rows = materialize(rows, "flagged")

    def link(ids, x, base_ids, y):
        found, forest, held = [], [], 0
        inner = x[:, -1] > 0
        x, y = np.ascontiguousarray(x[:, :-1]), np.ascontiguousarray(y[:, :-1])
        for row, col, _ in _inside(x, y, radius, metric):
            inside = inner[row]
            found.append((ids[row[~inside]], base_ids[col[~inside]], np.ones(int((~inside).sum()))))
            forest.append((ids[row[inside]], base_ids[col[inside]]))
            held += len(forest[-1][0])
            if held > TILE_ROWS * TILE_ROWS:
                forest = [star_forest(*(np.concatenate(part) for part in zip(*forest)))]
                held = len(forest[0][0])
        if forest:
            u, v = star_forest(*(np.concatenate(part) for part in zip(*forest)))
            found.append((u, v, np.zeros(len(u))))
        if not found:
            return ids[:0], np.zeros(0), ids[:0], np.zeros(0)
        u, v, border = (np.concatenate(part) for part in zip(*found))
        return u, np.zeros(len(u)), v, border

    lists, _ = _compared(rows.filter(F.element_at("v", -1) > 0), link, block_rows, broadcast_bytes, rows)
    return lists.select("id", "nbr", (F.col("dist") > 0).alias("border"))


def _closest(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` centres nearest to each row, nearest first, in tiles of rows."""
    rows = max(1, (TILE_ROWS * TILE_ROWS) // len(centre))
    found = [np.argsort(_distances(x[at:at + rows], centre, "l2"), axis=1, kind="stable")[:, :n] for at in range(0, len(x), rows)]
    return np.concatenate(found) if found else np.zeros((0, n), dtype=np.int64)


def _centroids(sample: np.ndarray, cells: int, steps: int = 8) -> np.ndarray:
    r = np.random.default_rng(11)
    centre = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)].astype(np.float64)
    for _ in range(steps):
        near = _closest(sample, centre, 1)[:, 0]
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


def _enough_probes(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, shape: Callable, k: int, metric: str) -> int:
    """Least number of probed cells with which the queries find ``RECALL`` of their exact neighbours."""
    nearest = _closest(shape(queries), centre, len(centre))
    place = np.argsort(nearest, axis=1)  # of each cell in each query's order

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                base, x = part.column(0).to_numpy(), _matrix(part.column(1))
                cell = _closest(shape(x), centre, 1)[:, 0]
                order = np.argsort(base, kind="stable")
                row, _, at_base, dist = _nearest(np.arange(len(ids)), queries, np.arange(len(base)), x[order], k, metric)
                need = place[row, cell[order][at_base]] + 1
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(base[order][at_base]), pa.array(dist), pa.array(need)], ["id", "nbr", "dist", "need"])

    found = _cut(rows.mapInArrow(exact, "id long, nbr long, dist double, need long"), k).groupBy("need").agg(F.count(F.lit(1)).alias("n")).orderBy("need").collect()
    reached = np.cumsum([r.n for r in found])
    return found[int(np.searchsorted(reached, RECALL * reached[-1]))].need


def _ivf(rows: DataFrame, k: int, metric: str, cells: int | None, probes: int | None, block_rows: int | None) -> DataFrame:
    """Lists from the cells nearest to each vector."""
    n = rows.count()
    if n == 0:
        return rows.select("id", F.lit(0).alias("rank"), F.col("id").alias("nbr"), F.lit(0.0).alias("dist"))
    cells = cells or max(1, int(n**0.5) // 4)
    taken = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 20)) + 1).limit(2 * SAMPLE_ROWS).toArrow()
    sample = _matrix(taken.column(1).combine_chunks()).astype(np.float64)
    unit = metric in ("cosine", "angular")
    shape = (lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))) if unit else (lambda m: m.astype(np.float64))
    centre = _centroids(shape(sample), cells)
    if probes is None:
        some = np.sort(np.random.default_rng(12).choice(len(sample), min(QUERY_ROWS, len(sample)), replace=False))
        queries = taken.take(pa.array(some)).combine_chunks()
        probes = _enough_probes(rows, queries.column(0).to_numpy(), _matrix(queries.column(1).combine_chunks()), centre, shape, k, metric)
    probes = min(probes, len(centre))

    def asked(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(centre)), dtype=bool)
        np.put_along_axis(out, _closest(shape(x), centre, probes), True, axis=1)
        return out

    return cell_lists(rows, 1, len(centre), lambda x: _closest(shape(x), centre, 1), asked, k, metric, block_rows)


def cell_lists(rows: DataFrame, each: int, cells: int, own: Callable, asked: Callable, k: int, metric: str, block_rows: int | None = None) -> DataFrame:
    """Final lists of all rows (id, v) among those that lie in a cell they ask.

    Of a matrix of rows, ``own`` gives the ``each`` cells they lie in (one of each set of
    cells, numbered through) and ``asked`` whether they ask each of ``cells``.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("values"), F.count_distinct(F.size("v")).alias("widths")).first()
    if size.widths != 1:
        raise ValueError("vectors differ in width")
    block_rows, few = block_rows or _block_rows(rows, size), max(16, (1 << 21) // cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, few):
                part = batch.slice(at, few)
                x = _matrix(part.column(1))
                wide = np.concatenate([x, own(x).astype(x.dtype)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(len(wide) + 1, dtype=np.int32) * wide.shape[1], wide.ravel())], ["id", "v"])

    blocks = materialize(_blocks(rows.mapInArrow(place, f"id long, v {rows.schema['v'].dataType.simpleString()}"), size.n, block_rows), "vector-blocks")

    def start(ids: np.ndarray, x: np.ndarray) -> tuple:
        x = np.ascontiguousarray(x[:, :-each])
        bits = [np.packbits(asked(x[at:at + few]), axis=1) for at in range(0, len(x), few)]
        return ids, _CellLists(x, min(k, size.n), metric, np.concatenate(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_of = [None, None, None]  # of the table, and the same as lists take it

        def meet(lot, ids: np.ndarray, y: np.ndarray) -> list:
            if run_of[0] is not y:
                run_of[:] = y, lot[1].placed(np.ascontiguousarray(y[:, :-each])), y[:, -each:].astype(np.int64)
            lot[1].add(ids, *run_of[1:])
            return []

        # queries of a lot lie in cells that are near in number
        yield from _streams(batches, start, meet, _ended, lambda x: np.argsort(x[:, -each], kind="stable"))

    return _met(blocks, blocks, _groups(rows, size, block_rows)).mapInArrow(run, _LIST)


def knn_models(df: DataFrame, k: int, model: str = "model", metric: str = "cosine", **options) -> DataFrame:
    """(model, id, rank, nbr, dist): the lists of every model of a long table."""
    names = sorted(r[0] for r in df.select(model).distinct().collect())
    lists = [knn(df.filter(F.col(model) == m), k, metric, **options).select(F.lit(m).alias("model"), "*") for m in names]
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out


def wide(lists: DataFrame, k: int | None = None, fill: int = -1) -> DataFrame:
    """(id, nbrs): neighbours by rank, padded with ``fill`` to ``k``."""
    nbrs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda x: x["nbr"])
    out = lists.groupBy("id").agg(nbrs.alias("nbrs"))
    if k is None:
        return out
    return out.select("id", F.concat("nbrs", F.array_repeat(F.lit(fill).cast("long"), k - F.size("nbrs"))).alias("nbrs"))


def recall(lists: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(recall): neighbours that both lists have, over n k."""
    hits = lists.filter(F.col("rank") <= k).select("id", "nbr").join(exact.filter(F.col("rank") <= k).select("id", "nbr"), ["id", "nbr"], "left_semi")
    n = exact.agg(F.count_distinct("id").alias("n"))
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(n)).select((F.col("hits") / F.nullif(F.col("n") * k, F.lit(0))).alias("recall"))


def hubness(lists: DataFrame) -> DataFrame:
    """(nbr, n): in how many lists each vector is."""
    return lists.groupBy("nbr").agg(F.count(F.lit(1)).alias("n"))


def connectivity(lists: DataFrame, symmetric: bool = False) -> DataFrame:
    """(a, b, w) without self: 1 per list entry, or the mean of both directions."""
    edges = lists.filter("id <> nbr").select(F.col("id").alias("a"), F.col("nbr").alias("b"), F.lit(1.0).alias("w"))
    if not symmetric:
        return edges
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum(F.col("w") * 0.5).alias("w"))


def floor_graph(lists: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, nbr, dist) of entries with similarity 1 - dist of at least ``least``, self left out."""
    return lists.filter((1 - F.col("dist") >= least) & (F.col("id") != F.col("nbr"))).select("id", "nbr", "dist")
