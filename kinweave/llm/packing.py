"""Packing of documents into token windows by lexical retrieval.

1. Every text is encoded whole; ids (with the end id 0) are written once to the
   shared folder, beside document frequencies of ids per batch.
2. The document frequencies of the whole corpus are one vector of vocabulary
   length (bounded); it and the mean length are given to every task. Ids that
   more than a tenth of the documents have are stop ids.
3. Documents are routed by content: the key of a document is its least id under
   each of ``LEVELS`` random orders of the ids (min-hashes), stop ids left out.
   Rows are range-partitioned and sorted by key, so copies meet and documents
   that share rare ids tend to; the later levels split what shares the earlier
   ones, and the position splits equal keys, so no key is too large for a task.
   Runs of at most ``shard_docs`` documents and about ``shard_tokens`` ids are
   shards.
4. Each task packs its shards. A shard has a BM25 inverted index (all ids but
   stop ids, corpus statistics). The first unused document is the seed; all its
   indexed ids retrieve the unused neighbours, which fill the window in order
   of their scores. The document that crosses the end of a window is cut there
   and goes on as the next window's seed.

Only neighbours of the seed's own shard are retrieved (the README has the
measured share of all neighbours). ``position`` is a document's place in the
input's order (``order``, by default as read); seeds are taken in that order, so
sequences sorted by the position at their offset 0 follow it. Only a task's
last window is padded; its length is the only one below ``window``. Sequence
ids are the range's number and a count, and positions are numbered before
routing, so a retried task makes the same rows.

Defined cases: null or empty text is the single end id; repeated rows are
packed again; a text of any length is cut into as many pieces as it needs;
ties of scores go to the earlier position; empty table, empty result; extra
columns are unused, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.arrow import slices, tree_sum
from kinweave.llm.bpe import encoder
from kinweave.sources.shared import materialize

WINDOW = 1024
SHARD_DOCS = 2048
SHARD_TOKENS = 4 << 20
END = 0
K1, B = 1.2, 0.75
LEVELS = 8
RANGE_BYTES = 12 << 20
#: One id in so many documents tells them apart.
STOP_SHARE = 10


def _token_batches(path: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            frequency = np.zeros(vocabulary)
            total = 0
            for part in slices(batch, 1):
                ids = [np.append(x, np.uint32(END)) for x in encode.batch(part.column(1))]
                for x in ids:
                    frequency[np.unique(x)] += 1
                    total += len(x)
                blobs = pa.array([x.astype("<u2").tobytes() if vocabulary <= 65536 else x.tobytes() for x in ids], pa.binary())
                rows = part.column(2) if part.column(2).null_count == 0 else pa.array(row + np.arange(part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column(0), blobs, pa.nulls(part.num_rows, pa.binary()), pa.nulls(part.num_rows, pa.int64())], _STORED)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([frequency.tobytes()], pa.binary()), pa.array([total])], _STORED)
            pa.default_memory_pool().release_unused()

    return run


_STORED = ["row", "doc_id", "ids", "frequency", "total"]


def corpus_frequencies(stored: DataFrame, vocabulary: int) -> tuple[np.ndarray, int]:
    """(document frequency of each id, number of ids): per-batch vectors summed in a tree of tasks."""
    frequency, total = tree_sum(stored.filter("frequency is not null").select(F.col("frequency").alias("vector"), "total"))
    return (np.zeros(vocabulary), 0) if frequency is None else (frequency, total)


def stop_ids(frequency: np.ndarray, n: int) -> np.ndarray:
    """Which ids more than a tenth of ``n`` documents have (never those of a single one)."""
    return frequency > max(n // STOP_SHARE, 1)


def orders(stop: np.ndarray) -> np.ndarray:
    """(levels, ids): places of the ids in random orders; stop ids share the last."""
    r = np.random.default_rng(5)
    places = np.array([r.permutation(len(stop)) for _ in range(LEVELS)], dtype=np.uint32)
    places[:, stop] = len(stop)
    return places


def routes(ids: list[np.ndarray], places: np.ndarray) -> list[bytes]:
    """Keys of documents (each of at least one id): the least place on each level, as sortable bytes."""
    flat = np.concatenate(ids)
    start = np.cumsum([0, *map(len, ids[:-1])])
    least = np.stack([np.minimum.reduceat(level[flat], start) for level in places], axis=1)
    return [key.tobytes() for key in least.astype(">u4")]


def _route_batches(places: np.ndarray, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                ids = [np.frombuffer(blob.as_buffer(), "<u4" if wide else "<u2") for blob in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(routes(ids, places), pa.binary())], ["row", "doc_id", "ids", "route"])

    return run


class Shard:
    """BM25 inverted index of some documents' ids, under the corpus's statistics and without stop ids."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float, stop: np.ndarray):
        self.lengths = np.array([len(x) for x in ids])
        self.n, flat = len(ids), np.concatenate(ids)
        used = ~stop[flat]
        docs = np.repeat(np.arange(self.n, dtype=np.int64), self.lengths)[used]
        pairs, counts = np.unique(flat[used].astype(np.int64) * self.n + docs, return_counts=True)
        term = (pairs // self.n).astype(np.int32)
        self.doc = (pairs % self.n).astype(np.int32)
        norm = K1 * (1 - B + B * self.lengths / mean_length)
        self.weight = idf[term] * counts * (K1 + 1) / (counts + norm[self.doc])
        self.start = np.searchsorted(term, np.arange(len(idf) + 1))
        by_doc = np.argsort(self.doc, kind="stable")
        self.own_term, self.own_at = term[by_doc], np.searchsorted(self.doc[by_doc], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Of every document, the seed's indexed ids being the query."""
        terms = self.own_term[self.own_at[seed]:self.own_at[seed + 1]]
        first, sizes = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)

    def neighbours(self, seed: int, unused: np.ndarray, room: int | None = None) -> np.ndarray:
        """Unused documents that share an indexed id with the seed, best first; only as many as fill ``room`` ids."""
        scores = self.scores(seed)
        found = np.flatnonzero((scores > 0) & unused)
        few = 32
        while room is not None and len(found) > 4 * few:
            best = scores[found]
            near = found[best >= np.partition(best, len(best) - few)[len(best) - few]]
            if self.lengths[near].sum() >= room:
                found = near
                break
            few *= 8
        found = found[np.argsort(-scores[found], kind="stable")]
        return found if room is None else found[:int(np.searchsorted(np.cumsum(self.lengths[found]), room)) + 1]


class Packer:
    """Windows filled one after another; ``rows`` are the pieces so far."""

    def __init__(self, split: int, window: int):
        self.window, self.sequence, self.used = window, split << 32, 0
        self.rows: list[tuple] = []

    def add(self, position: int, doc_id, ids: np.ndarray) -> bool:
        """Put a whole document; True if a window ended inside or at its end."""
        at, n, ended = 0, len(ids), False
        while at < n:
            length = min(n - at, self.window - self.used)
            self.rows.append((doc_id, at, length, zlib.crc32(ids[at:at + length].astype("<u4").tobytes()), n, self.sequence, self.used, position))
            at, self.used = at + length, self.used + length
            if self.used == self.window:
                self.sequence, self.used, ended = self.sequence + 1, 0, True
        return ended

    def shard(self, positions: list[int], doc_ids: list, ids: list[np.ndarray], index: Shard) -> None:
        unused = np.ones(len(ids), dtype=bool)
        first, queue, seed = 0, iter(()), None
        left = len(ids)
        while left:
            doc = next((d for d in queue if unused[d]), None)
            if doc is None:
                while not unused[first]:
                    first += 1
                doc = seed = first
                queue = iter(())
            unused[doc] = False
            left -= 1
            ended = self.add(positions[doc], doc_ids[doc], ids[doc])
            if ended:
                seed = doc  # its rest begins the new window
            if ended and not self.used:
                queue = iter(())  # a full window: the next one has a new seed
            elif left and (ended or doc == seed):
                queue = iter(index.neighbours(seed, unused, self.window - self.used).tolist())


def _pack_batches(idf: np.ndarray, mean_length: float, stop: np.ndarray, wide: bool, window: int, shard_docs: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), window)
        held, tokens = [], 0

        def flush() -> pa.RecordBatch:
            positions, doc_ids, ids = zip(*sorted(held, key=lambda x: x[0]))
            packer.shard(positions, doc_ids, ids, Shard(ids, idf, mean_length, stop))
            columns = [pa.array(c, pa.int64()) for c in zip(*packer.rows)]
            packer.rows = []
            held.clear()
            return pa.RecordBatch.from_arrays(columns, _PIECE)

        for batch in batches:
            for row, doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append((row, doc, np.frombuffer(blob.as_py(), "<u4" if wide else "<u2")))
                tokens += len(held[-1][2])
                if len(held) >= shard_docs or tokens >= shard_tokens:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return run


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "position"]


def file_order(docs: DataFrame) -> Column | None:
    """Place of each row of a table written as Parquet: number of its part, then row of the file; None for other tables."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018  resolved here
    except AnalysisException:
        return None
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    return F.shiftleft(F.coalesce(part, F.lit(0)), 33) + F.col("_metadata.row_index")


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", order: Column | None = None, window: int = WINDOW,
    shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS, vocabulary: int = 50_257,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, position), one row per piece.

    ``order`` is a column of distinct longs without nulls that orders ``docs``; by default they are in order as read.
    """
    place = F.lit(None).cast("long") if order is None else order
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), place.alias("place"))
    stored = materialize(plain.mapInArrow(_token_batches(tokenizer, vocabulary), "row long, doc_id long, ids binary, frequency binary, total long"), "token-ids")
    frequency, total = corpus_frequencies(stored, vocabulary)
    n = max(int(frequency[END]), 1)  # every document has the end id
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    stop = stop_ids(frequency, n)
    wide = vocabulary > 65536
    ranges = max(1, -(-total * (4 if wide else 2) // RANGE_BYTES))
    routed = stored.filter("ids is not null").select("row", "doc_id", "ids").mapInArrow(_route_batches(orders(stop), wide), "row long, doc_id long, ids binary, route binary")
    near = routed.repartitionByRange(ranges, "route", "row").sortWithinPartitions("route", "row").select("row", "doc_id", "ids")
    run = _pack_batches(idf, max(total / n, 1.0), stop, wide, window, shard_docs, shard_tokens)
    return near.mapInArrow(run, ", ".join(f"{c} long" for c in _PIECE))
