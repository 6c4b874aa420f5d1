"""Log-likelihoods of whole documents under a gated recurrent language model.

Tokens: words after lower-casing A-Z, then one end per document. Documents
whose crc32(id as text) mod 7 is not 2 are for training.

1. Words of all training documents are counted (partial counts per batch, then
   an aggregate); the table of counts grows with the corpus and stays a table.
2. At most ``head_words`` of the most frequent words (of at most
   ``head_bytes`` bytes) go to every task with their counts.
3. Every document becomes the numbers of its words, written once. The words
   outside the head are few and distinct: they leave as (row, word, n) and meet
   their counts in a join.
4. The model learns in rounds. In each, every task trains a copy on its own
   documents by truncated backpropagation and the copies are averaged, weighted
   by tokens, in a tree of tasks. A round takes ``1/train_parts`` of the
   training documents, by a hash of the id; together the rounds take every
   training document (``rounds`` is at least ``train_parts``).
5. Every document is scored whole; its state runs through all its windows.

A word's probability is p(class | state) p(word | class): inside the classes of
the ``classes * width`` most frequent words the second factor depends on the
state; in the class of all other words it is (c + 1) / (N' + V' + 1) with the
class's own count and types, the last 1 being for unseen words.

Defined cases: null or empty text is the end token alone; a null id counts as
the empty text (training); no training documents leave an untrained model with
zero counts; repeated rows give repeated result rows; empty table, empty
result; extra columns are unused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm import gru
from kinweave.llm.arrow import slices, tree_sum, unsliced
from kinweave.sources.shared import materialize

HEAD_WORDS = 262_144
HEAD_BYTES = 64
CLASSES = 64
WIDTH = 64
EMBED = 16
STATE = 32
ROUNDS = 2
TRAIN_PARTS = 2
RATE = 0.1
SLICE = 4 << 20
SLICE_TOKENS = 1 << 19
END = ""  # no word is empty


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == 2


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order, index of its text)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(unsliced(pc.fill_null(texts.cast(pa.large_string()), ""))))
    coded = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(split.offsets.to_numpy()))
    index = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, END).as_py()  # leading and trailing white space
    if empty >= 0:
        index, doc = index[index != empty], doc[index != empty]
    return coded.dictionary, index, doc


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0, SLICE):
            words, index, _ = _words(part.column(0))
            n = np.bincount(index, minlength=len(words))
            seen = np.flatnonzero(n)
            words = pa.concat_arrays([words.take(pa.array(seen)).cast(pa.string()), pa.array([END])])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n[seen], part.num_rows))], ["word", "n"])


@dataclass(frozen=True)
class Head:
    """Frequent words with their counts, and the corpus's totals."""

    words: pa.Array  # the end, then by count
    counts: np.ndarray
    known: int  # of them in the network's classes
    tokens: int
    types: int
    other_number: int  # the network's number for all other words

    @property
    def base(self) -> float:
        return self.tokens + self.types + 1.0

    @property
    def other_tokens(self) -> int:
        """Of words outside the classes."""
        return self.tokens - int(self.counts[:self.known].sum())

    @property
    def other(self) -> float:
        return self.other_tokens + self.types - int((self.counts[:self.known] > 0).sum()) + 1.0

    def places(self, words: pa.Array) -> np.ndarray:
        """Of each word among the head's; -1 outside."""
        found = pc.index_in(words.cast(pa.string()), value_set=self.words)
        return pc.fill_null(found, -1).to_numpy()


def count_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(word, c) over all training documents."""
    plain = docs.filter(~held_out(F.col(doc_id))).select(F.col(text).cast("string").alias("text"))
    counted = plain.mapInArrow(_count_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    return materialize(counted, "word-counts")


def frequent(counts: DataFrame, head_words: int = HEAD_WORDS, head_bytes: int = HEAD_BYTES, known: int = CLASSES * WIDTH) -> Head:
    """The head: all words above the count that leaves at most ``head_words`` of them."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    short = counts.filter(F.octet_length("word") <= head_bytes)
    by_count = short.groupBy("c").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("c")).limit(head_words).collect()
    taken, least = 0, None
    for row in by_count:
        if taken + row.words > head_words:
            least = row.c
            break
        taken += row.words
    rows = (short if least is None else short.filter(F.col("c") > least)).filter(F.col("word") != END).select("word", "c").toArrow()
    rows = rows.sort_by([("c", "descending"), ("word", "ascending")])
    ends = counts.filter(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    words = pa.concat_arrays([pa.array([END]), *(c.cast(pa.string()) for c in rows.column("word").chunks)])
    return Head(words, np.append(np.int64(ends), rows.column("c").to_numpy()), min(known, len(words)), total.n or 0, total.v, known)


def _numbers(number: np.ndarray, index: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Word numbers of all texts, each with the end, whose number is 0."""
    cut = np.searchsorted(doc, np.arange(1, n))
    return np.insert(number[index], np.append(cut, len(index)), 0)


_PARTS = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, more double, ids array<int>, word string, n long"


def _number_batches(head: Head):
    """Rows (doc_id, held_out, text) as the network's word numbers and what counts alone decide; words outside the head leave as (row, word, n)."""
    names = [c.split()[0] for c in _PARTS.split(", ")]
    facts = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        end, base, other = int(head.counts[0]), math.log10(head.base), math.log10(head.other)
        value = np.log10(head.counts + 1.0)
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                n = part.num_rows
                words, index, doc = _words(part.column(2))
                place = head.places(words)
                held = place >= 0
                outside = (place < 0) | (place >= head.known)
                worth = np.where(held, value[place], 0)  # of each distinct word

                def per_text(of_word: np.ndarray) -> np.ndarray:
                    return np.bincount(doc, weights=of_word[index], minlength=n)

                known = per_text(held).astype(np.int64) + (end > 0)
                bases = per_text(np.where(held, worth - base, 0)) + math.log10(end + 1) - base
                more = per_text(np.where(held & outside, worth - other, 0))
                rare = ~held[index]
                pairs, times = np.unique(doc[rare].astype(np.int64) * len(words) + index[rare], return_counts=True)
                if len(pairs):
                    at, word = np.divmod(pairs, len(words))
                    blank = [pa.nulls(len(pairs), t) for t in facts]
                    yield pa.RecordBatch.from_arrays([pa.array(at + row), *blank, words.take(pa.array(word)).cast(pa.string()), pa.array(times)], names)
                sizes = np.bincount(doc, minlength=n) + 1
                ids = _numbers(np.where(outside, head.other_number, place).astype(np.int32), index, doc, n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
                columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(known), pa.array(bases), pa.array(more), lists]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), *columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names)
                row += n
            pa.default_memory_pool().release_unused()

    return run


def numbered(docs: DataFrame, head: Head) -> DataFrame:
    """All documents as word numbers, written once for training and scoring."""
    plain = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return materialize(plain.mapInArrow(_number_batches(head), _PARTS), "word-numbers")


def _runs(batch: pa.RecordBatch, column: int, limit: int = SLICE_TOKENS) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """``batch`` in runs of rows whose lists hold about ``limit`` numbers (one row at least), with the lists."""
    offsets = batch.column(column).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        part = batch.slice(at, end - at)
        flat = part.column(column).flatten().to_numpy().astype(np.int64)
        yield part, np.split(flat, (offsets[at + 1:end] - offsets[at]))
        at = end


def _train_batches(weights: gru.Weights, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru.Trainer(gru.Model(weights.from_vector(weights.vector())), rate)
        for batch in batches:
            for _, docs in _runs(batch, 0):
                trainer.add(docs)
            pa.default_memory_pool().release_unused()
        trainer.add([], final=True)
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([(trainer.model.w.vector() * trainer.seen).tobytes()], pa.binary()), pa.array([trainer.seen])], ["vector", "total"])

    return run


def train(numbers: DataFrame, head: Head, classes: int = CLASSES, width: int = WIDTH, embed: int = EMBED, state: int = STATE, rounds: int = ROUNDS, train_parts: int = TRAIN_PARTS, rate: float = RATE) -> gru.Weights:
    """Weights averaged over the tasks after each round."""
    if rounds < train_parts:
        raise ValueError("the rounds must cover every part of the training documents")
    counts = np.zeros(classes * width)
    counts[:head.known] = head.counts[:head.known]
    weights = gru.initial(counts, head.other_tokens, classes, width, embed, state)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(train_parts))
    for k in range(rounds):
        chosen = numbers.filter(F.col("word").isNull() & ~F.col("held_out") & (part == k % train_parts)).select("ids")
        total, tokens = tree_sum(chosen.mapInArrow(_train_batches(weights, rate / (1 + k)), "vector binary, total long"))
        if tokens:
            weights = weights.from_vector(total / tokens)
    return weights


_FACTS = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"


def _score_batches(weights: gru.Weights):
    names = [c.split()[0] for c in _FACTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def scored(done: list[tuple], facts_of: dict) -> pa.RecordBatch:
        rows = [(row, *first, more + log / math.log(10)) for row, log in done for *first, more in [facts_of.pop(row)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, facts_of = gru.Scorer(gru.Model(weights)), {}
        for batch in batches:
            for part, docs in _runs(batch, batch.num_columns - 1):
                row, *facts = (c.to_pylist() for c in part.columns[:-1])
                facts_of.update(zip(row, zip(*facts)))
                if done := scorer.add(row, docs):
                    yield scored(done, facts_of)
            pa.default_memory_pool().release_unused()
        if done := scorer.add([], [], final=True):
            yield scored(done, facts_of)

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS, classes: int = CLASSES, width: int = WIDTH, **training) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = count_words(docs, "doc_id", "text")
    head = frequent(counts, head_words, known=classes * width)
    parts = numbered(docs, head)
    weights = train(parts, head, classes, width, **training)
    texts = parts.filter("word is null").select("row", "doc_id", "held_out", "n_tokens", "known", "base", "more", "ids")
    found = texts.mapInArrow(_score_batches(weights), _FACTS)
    c = F.coalesce("c", F.lit(0)) + 1
    rare = (
        parts.filter("word is not null").select("row", "word", "n").join(counts, "word", "left").groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * (F.log10(c) - math.log10(head.base))).alias("more_base"),
            F.sum(F.col("n") * (F.log10(c) - math.log10(head.other))).alias("more_score"),
        )
    )
    whole = found.join(rare, "row", "left")

    def added(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return whole.select(
        "doc_id", "held_out", "n_tokens", added("known", "more_known").alias("n_known"), F.lit(head.tokens).cast("long").alias("train_tokens"),
        added("base", "more_base").alias("base_score"), added("score", "more_score").alias("score"),
    )
