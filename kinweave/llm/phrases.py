"""Collocations: phrases whose words occur together more often than their parts suggest.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and
into words at spaces and tabs. Tasks collect shards of about ``SHARD_WORDS``
words, number the words of each shard, and build its word-id suffix array by
prefix doubling in numpy. Runs of the array whose longest common prefixes reach
n (its LCP intervals) are the shard's n-grams with their counts; they are merged
by (lang, phrase) in one shuffle.

Two passes keep the shuffle small. The first counts words and word pairs. The
second counts longer n-grams, at positions whose word pairs may be frequent: a
bitmap of the hashes of all frequent pairs (``MOST_BITS`` bits at most, whatever
the corpus) says so. A phrase is at most as frequent as the pairs inside it, and
equal hashes only let more through, so no candidate is lost.

Candidates of at least ``min_count`` occurrences are scored at every cut by
joins with the counts of their parts, which are frequent too. Products are
decimals: exact for counts up to 10^15.

Defined cases: null texts are empty, a null language is ``und``; repeated rows
count again; an empty table has no phrases; extra columns are unused. Long texts
are cut at separators into slices, so memory follows the slice (a piece without
any separator is held whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.arrow import slices, unsliced
from kinweave.sources.shared import materialize

SHARD_WORDS = 1 << 18
SLICE_BYTES = 1 << 20
MOST_BITS = 1 << 29
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_COUNTS = "lang string, phrase string, f long"

# kinds of bytes: 0 inside words, 1 between words, 2 between pieces
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in SEPARATORS]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cuts(data: np.ndarray, limit: int) -> list[int]:
    """Ends of slices of ``data`` of about ``limit`` bytes, each at a separator or at the end."""
    ends, at = [], 0
    while len(data) - at > limit:
        size, found = limit, np.zeros(0, dtype=np.int64)
        while not len(found) and at + size < len(data):
            found = np.flatnonzero(_KIND[data[at:at + size]] == 2)
            size *= 2
        if not len(found):
            break
        at += int(found[-1]) + 1
        ends.append(at)
    return [*ends, len(data)]


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts that begin at ``starts`` in ``data``, each word's piece (counted through all texts) and its text."""
    kind = _KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = starts[starts < len(data)]
    first[begin] = inside[begin]  # a text begins a word of its own
    at = np.flatnonzero(first)
    breaks = np.sort(np.concatenate([np.flatnonzero(kind == 2), begin]))
    piece = np.searchsorted(breaks, at, side="right")
    letters = np.flatnonzero(inside)
    offsets = np.append(np.searchsorted(letters, at), len(letters)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[letters]])), piece, np.searchsorted(starts, at, side="right") - 1


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts of texts) of runs of rows; a long text comes in slices of its own."""
    texts = unsliced(texts.cast(pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        part = data[offsets[row]:offsets[end]]
        if end == row + 1:
            at = 0
            for cut in _cuts(part, SLICE_BYTES):
                yield row, part[at:cut], np.zeros(1, dtype=np.int64)
                at = cut
        else:
            yield row, part, offsets[row:end] - offsets[row]
        row = end


def suffix_ranks(ids: np.ndarray, piece: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``depth`` words or more, by prefix doubling; a suffix ends with its piece."""
    rank, h = np.unique(ids, return_inverse=True)[1] + 1, 1
    while h < depth:
        after = np.zeros(len(ids), dtype=np.int64)
        if len(ids) > h:
            same = piece[h:] == piece[:-h]
            after[:-h][same] = rank[h:][same]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        rank, h = np.unique(key, return_inverse=True)[1] + 1, 2 * h
    return rank


def lcp_intervals(ids: np.ndarray, piece: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts) for n = 1 .. ``depth``: one place of every distinct n-gram and how often it occurs."""
    if not len(ids):
        return
    suffix = np.argsort(suffix_ranks(ids, piece, depth), kind="stable")
    same = np.ones(len(ids), dtype=bool)  # with the suffix before, up to the words seen so far
    same[0] = False
    for n in range(1, depth + 1):
        at = suffix + n - 1
        there = at < len(ids)
        at = np.minimum(at, len(ids) - 1)
        there &= piece[at] == piece[suffix]  # suffixes with n words
        word = np.where(there, ids[at], -1)
        same[1:] &= there[1:] & there[:-1] & (word[1:] == word[:-1])
        heads = np.flatnonzero(~same)
        counts = np.diff(np.append(heads, len(ids)))
        real = there[heads]
        yield n, suffix[heads[real]], counts[real]


def _mixed(lang: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Places in a bitmap of word pairs, from 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (lang * np.uint64(0x9E3779B97F4A7C15) + left) * np.uint64(0xC2B2AE3D27D4EB4F) + right
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], dtype=np.uint64)


class _Shard:
    """Words of many texts with their languages and pieces."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.lang: list[np.ndarray] = []
        self.piece: list[np.ndarray] = []
        self.names: dict[str, int] = {}
        self.size = self.pieces = 0

    def add(self, words: pa.Array, piece: np.ndarray, lang: np.ndarray, names: list[str]) -> None:
        """``lang`` has each word's place in ``names``."""
        own = np.array([self.names.setdefault(x, len(self.names)) for x in names], dtype=np.int64)
        self.words.append(words)
        self.lang.append(own[lang])
        self.piece.append(piece + self.pieces)
        self.pieces += int(piece[-1]) + 1 if len(piece) else 0
        self.size += len(words)

    def counts(self, low: int, high: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, f) of all n-grams of ``low`` to ``high`` words; with ``low`` 1, also each language's number of words under an empty phrase."""
        coded = pa.chunked_array(self.words, pa.large_string()).combine_chunks().dictionary_encode()
        words, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        lang, piece = np.concatenate(self.lang), np.concatenate(self.piece)
        names = pa.array(list(self.names), pa.large_string())
        if low == 1:
            total = np.bincount(lang, minlength=len(names))
            yield _rows(names, pa.array([""] * len(names), pa.large_string()), total)
        if bitmap is not None:
            h, spoken = _hashes(words.to_pylist()), _hashes(list(self.names))
            pair = np.zeros(len(word), dtype=bool)  # may begin a frequent pair
            place = _mixed(spoken[lang[:-1]], h[word[:-1]], h[word[1:]], 64 * len(bitmap))
            pair[:-1] = (piece[1:] == piece[:-1]) & ((bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            # words in runs of such pairs; a run is a piece of its own
            keep = pair.copy()
            keep[1:] |= pair[:-1]
            opens = np.append(True, ~pair[:-1])
            piece = np.cumsum(opens)[keep]
            word, lang = word[keep], lang[keep]
        ids = lang * len(words) + word
        for n, at, counts in lcp_intervals(ids, piece, high):
            if n >= low:
                parts = [words.take(pa.array(word[at + j])) for j in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
                yield _rows(names.take(pa.array(lang[at])), phrase, counts)


def _rows(lang: pa.Array, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    # large to plain strings: a batch of n-grams of one shard may pass 2 GB in theory, so it goes out in runs
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(f, pa.int64())], ["lang", "phrase", "f"])


def _split(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1).cast(pa.string()), part.column(2)], ["lang", "phrase", "f"])


def _count_batches(low: int, high: int, shard_words: int, bitmap=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        shard = _Shard()
        for batch in batches:
            for part in slices(batch, 1):
                langs = part.column(0).dictionary_encode()
                index, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
                for row, data, starts in _slices(part.column(1)):
                    words, piece, at = _words(data, starts)
                    shard.add(words, piece, index[row + at], names)
                    del words, piece, at, data
                    if shard.size >= shard_words:
                        for found in shard.counts(low, high, bits):
                            yield from _split(found)
                        shard = _Shard()
                        pa.default_memory_pool().release_unused()
        if shard.size:
            for found in shard.counts(low, high, bits):
                yield from _split(found)

    return run


def _counted(docs: DataFrame, low: int, high: int, min_count: int, shard_words: int, bitmap=None) -> DataFrame:
    found = docs.mapInArrow(_count_batches(low, high, shard_words, bitmap), _COUNTS)
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(f"f >= {int(min_count)} or phrase = ''")


def _pair_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs = [p.split(" ") for p in batch.column(1).to_pylist()]
                place = _mixed(_hashes(batch.column(0).to_pylist()), _hashes([p[0] for p in pairs]), _hashes([p[1] for p in pairs]), bits)
                at, inverse = np.unique(place >> 6, return_inverse=True)
                value = np.zeros(len(at), dtype=np.uint64)
                np.bitwise_or.at(value, inverse, np.uint64(1) << (place & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value.view(np.int64))], ["at", "value"])

    return run


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """A bit set for each frequent word pair, in 64-bit words; at most ``MOST_BITS`` bits reach the driver."""
    bits = min(MOST_BITS, max(64, 1 << (16 * pairs.count()).bit_length()))
    found = pairs.mapInArrow(_pair_bits(bits), "at long, value long").groupBy("at").agg(F.bit_or("value").alias("value"))
    table = found.select(F.col("at").cast("int"), "value").toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy().view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10, lang: str = "lang", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, f) of every phrase of up to ``max_words`` words that occurs ``min_count`` times or more; under '' each language's number of words."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    short = materialize(_counted(docs, 1, min(2, max_words), min_count, shard_words), "phrases")
    if max_words < 3:
        return short
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(short.filter("instr(phrase, ' ') > 0")))  # MOST_BITS bits at most
    long = materialize(_counted(docs, 3, max_words, min_count, shard_words, bitmap), "phrases")
    return short.unionByName(long.filter("phrase <> ''"))


def collocations(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the candidates among ``phrase_counts`` that no longer candidate covers.

    The lowest-scoring cut counts, ties go to the earlier one. A candidate goes
    when a longer one with at least half its count holds its words.
    """
    named = counts.filter("phrase <> ''")
    found = named.withColumn("w", F.split("phrase", " ")).filter("size(w) > 1").withColumnRenamed("f", "a")
    words = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("first"), words(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    cut = cut.join(named.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(named.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    score = F.expr("(a_ * a_ * cast(1000000 as decimal(7,0))) div (l_ * r_)")
    scored = cut.withColumns({f"{c}_": v for c, v in wide.items()}).withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # the largest count of a longer candidate around each shorter one
    longer = found.filter("size(w) > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
    inner = longer.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").filter("around is null or 100 * around < 50 * a")
    return kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def top_collocations(docs: DataFrame, top: int = 2000, max_words: int = 3, min_count: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language.

    The window's limit is taken in every task before rows meet, so the task of a
    language holds ``top`` rows of each task at most.
    """
    counts = phrase_counts(docs, max_words, min_count, shard_words=shard_words)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(counts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    totals = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, array_to_string(w[s:s + n - 1], ' ') AS phrase, n FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, range(1, 4) AS a(n))),
f AS MATERIALIZED (SELECT lang, phrase, n, count(*) AS f FROM grams GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, phrase, n, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.n, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score FROM c, range(1, 3) AS t(k)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ') WHERE k < c.n),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE n = 3),
around AS (SELECT lang, phrase, max(a) AS top FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON b.lang = o.lang AND b.phrase = o.phrase WHERE o.top IS NULL OR 100 * o.top < 50 * b.a),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score::BIGINT AS score
FROM kept k JOIN total t ON k.lang = t.lang QUALIFY rank <= 2000
"""
