"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: 64-bit majority of XXH64 (seed 42) over three-word shingles.
Equal fingerprints meet by aggregation, so groups of copies never pair up.
Distinct fingerprints link at ``max_bits`` or fewer differing bits. The 64 bits
form ``blocks`` blocks, of which any two linked fingerprints share
``blocks - max_bits``; every choice of shared blocks is the root of a forest of
tries. Inside a trie, pairs of nodes descend together from bit to bit, their
differing bits add up, and a pair ends once they exceed the budget.

A task takes a pair of nodes whose product of sizes is at most ``max_trie``
squared. Larger pairs (first a large root with itself) descend ``STEP`` bits as
a table: every fingerprint goes to the pairs of child nodes that it is part of
and whose differing bits the budget allows, pairs without a partner are
dropped, and so on until all fit. Components come from distributed star rounds.

Defined cases: null or wordless text has fingerprint zero, linked like any
other; repeated rows give repeated result rows; a null id is never a
component's id unless all its ids are null; empty table, empty result; extra
columns are unused by ``near_duplicates`` and kept by ``keep_one``, whatever
their names. A text is read in pieces, so its length does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.forest import star_forest
from kinweave.operators.components import connected_components
from kinweave.sources.shared import materialize

MAX_BITS = 2
MAX_TRIE = 1024
#: Fingerprints of one pair of nodes that a task may hold, whatever their product.
MAX_ROWS = 1 << 20
#: Bits by which large pairs of nodes descend at once.
STEP = 4
#: Fingerprints that share a root, on average at most.
ROOT_ROWS = 64
_PAIRS = 4_000_000
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_hash = xxhash.xxh64_intdigest


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space into pieces of about a megabyte."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + _PIECE)
        end = space.start() if space else len(text)
        yield text[at:end] if at or space else text
        at = end


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    ones, n, words = np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces(text):
        words = words[-2:] + piece.lower().split()  # of bytes: A-Z and ASCII white space only
        shingles = [b"%b %b %b" % s for s in zip(words, words[1:], words[2:])]
        if shingles:
            hashes = np.fromiter((_hash(s, 42) for s in shingles), dtype="<u8", count=len(shingles))
            ones += np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
            n += len(shingles)
    if not n:
        return _hash(b" ".join(words), 42) if words else 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py() or b"") for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["doc", "fp", "tie"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp, tie) of every row; tie is a hash of the text."""
    content = F.col(f"`{text}`")
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), content.cast("binary").alias("text"), F.xxhash64(content).alias("tie"))
    return plain.mapInArrow(_fingerprint_batches, "doc long, fp long, tie long")


def trie_pairs(groups: list[np.ndarray], others: list[np.ndarray | None] | None = None, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (a, b) inside each group of distinct uint64 fingerprints, or between it and its other group.

    The sorted values are the trie: a node is a range of equal leading bits.
    """
    others = others or [None] * len(groups)
    sorted_, starts, n = [], [], 0
    for group, other in zip(groups, others):
        ranges = []
        for values in (group,) if other is None else (group, other):
            sorted_.append(np.sort(values))
            ranges.append((n, n + len(values)))
            n += len(values)
        starts.append((*ranges[0], *ranges[-1]))
    values = np.concatenate(sorted_)
    a0, a1, b0, b1 = np.array(starts, dtype=np.int64).T
    errors = np.zeros(len(groups), dtype=np.int8)
    left, right = [], []
    for bit in range(63, -1, -1):
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        cross = ~same
        nodes = [  # zeros together, ones together, and the two ways to differ here (one for a node with itself)
            (a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, errors + 1),
            (am[cross], a1[cross], b0[cross], bm[cross], errors[cross] + 1),
        ]
        a0, a1, b0, b1, errors = (np.concatenate(x) for x in zip(*nodes))
        alive = (a1 > a0) & (b1 > b0) & (errors <= max_bits)
        alive &= ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))  # a value with itself
        a0, a1, b0, b1, errors = (x[alive] for x in (a0, a1, b0, b1, errors))
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():  # two leaves: the rest of their paths at once
            x, y = values[a0[single]], values[b0[single]]
            linked = np.bitwise_count(x ^ y) <= max_bits
            left.append(x[linked])
            right.append(y[linked])
            a0, a1, b0, b1, errors = (x[~single] for x in (a0, a1, b0, b1, errors))
        if not len(a0):
            break
    if not left:
        return values[:0], values[:0]
    return np.concatenate(left), np.concatenate(right)


def _trie_batches(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, others, work = [], [], 0
            for i in range(batch.num_rows):
                group, other = (column[i].values.to_numpy().view(np.uint64) for column in batch.columns)
                groups.append(group)
                others.append(other if len(other) else None)
                work += len(group) * (len(other) or len(group))
                if work >= _PAIRS or i + 1 == batch.num_rows:
                    a, b = trie_pairs(groups, others, max_bits)
                    u, v = star_forest(a.view(np.int64), b.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])
                    groups, others, work = [], [], 0

    return run


def _met(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links of the pairs of nodes in ``rows`` (node, side, fp); side 1 is the second node of a pair of two."""
    pairs = rows.groupBy("node").agg(F.collect_list(F.when(F.col("side") != 1, F.col("fp"))).alias("a"), F.collect_list(F.when(F.col("side") == 1, F.col("fp"))).alias("b"))
    return pairs.select("a", "b").mapInArrow(_trie_batches(max_bits), "a long, b long")


def _children(rows: DataFrame, places: list[list[int]]) -> DataFrame:
    """``rows`` (t, node, side, budget, fp) at the pairs of child nodes by the bits ``places[t]`` (-1: none)."""
    at = F.array(*[F.array(*[F.lit(p) for p in row]) for row in places])
    rows = rows.withColumn("at", F.get(at, F.col("t")))
    bits = [F.expr(f"IF(at[{k}] < 0, 0, CAST(shiftright(fp, greatest(at[{k}], 0)) & 1 AS INT) << {k})") for k in range(STEP)]
    child = sum(bits[1:], bits[0])
    masks = F.filter(F.array(*[F.lit(m) for m in range(1 << STEP)]), lambda m: F.bit_count(m) <= F.col("budget"))
    rows = rows.select("t", "node", "side", "budget", "fp", child.alias("own"), F.explode(masks).alias("mask")).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    itself = F.col("side") == 2
    first = F.when(itself, F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    second = F.when(itself, F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    side = F.when(itself & (F.col("mask") != 0), (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side"))
    return rows.select("t", F.xxhash64("node", first, second).alias("node"), side.alias("side"), (F.col("budget") - F.bit_count("mask")).alias("budget"), "fp")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, max_trie: int = MAX_TRIE) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints ``fp`` which ``max_bits`` links connect.

    ``blocks`` are by default so many that roots hold ``ROOT_ROWS`` fingerprints or fewer on average.
    """
    if blocks is None:
        blocks, n = max_bits + 1, distinct.count()
        while n >> (64 * (blocks - max_bits) // blocks) > ROOT_ROWS and blocks < 2 * max_bits + 4:
            blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    tables, rest = [], []
    for t, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        tables.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("block")))
        rest.append([p for p in range(63, -1, -1) if not mask >> p & 1])
    keys = distinct.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.t", F.xxhash64("k.t", "k.block").alias("node"), F.lit(2).alias("side"), F.lit(max_bits).alias("budget"))
    found, level = [], 0
    while True:
        small = F.col("work") <= max_trie * max_trie
        size = keys.groupBy("node").agg(*[F.count_if(F.col("side") == s).alias(f"n{s}") for s in range(3)])
        work = F.when(F.col("n2") > 0, F.col("n2") * F.col("n2")).otherwise(F.col("n0") * F.col("n1"))
        size = size.filter("n2 > 1 or n0 > 0 and n1 > 0").select("node", work.alias("work"), (F.col("n0") + F.col("n1") + F.col("n2") <= MAX_ROWS).alias("held"))
        met = materialize(keys.join(size, "node").withColumn("small", small & F.col("held")).drop("work", "held"), "trie-nodes")
        found.append(_met(met.filter("small"), max_bits))
        large = met.filter("not small")
        if large.isEmpty():
            break
        places = [(row[level:level + STEP] + [-1] * STEP)[:STEP] for row in rest]
        keys, level = _children(large, places), level + STEP
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _classes(prints: DataFrame, max_bits: int, blocks: int | None, max_trie: int) -> DataFrame:
    """(fp, component_id) of every fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc").alias("first")), "distinct-fingerprints")
    comps = connected_components(links(distinct.select("fp"), max_bits, blocks, max_trie), local_edges=0)
    rooted = materialize(distinct.join(comps, distinct.fp == comps.id, "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp")), "near-roots")
    # written first, so that the join may split a large component
    smallest = materialize(rooted.groupBy("comp").agg(F.min("first").alias("component_id")), "near-first")
    return rooted.join(smallest, "comp").select("fp", "comp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, blocks: int | None = None, max_trie: int = MAX_TRIE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    prints = materialize(fingerprints(docs, doc_id, text).drop("tie"), "fingerprints")
    by_print = _classes(prints, max_bits, blocks, max_trie)
    return prints.join(by_print, "fp").select(
        F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, blocks: int | None = None, max_trie: int = MAX_TRIE) -> DataFrame:
    """``docs`` with one row per component: the smallest id's (nulls last), ties by a hash of the text; all columns kept.

    Of repeated rows with the id and the text of a survivor, any one stays.
    """
    prints = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    rows = prints.groupBy("fp", "doc", "tie").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows.join(_classes(prints, max_bits, blocks, max_trie).select("fp", "comp"), "fp"), "near-classes")
    rank = F.struct(F.col("doc").isNull(), "doc", "tie")
    best = materialize(rows.groupBy("comp").agg(F.min(rank).alias("best")), "near-best")
    decided = materialize(rows.join(best, "comp").select("doc", "tie", "copies", rank.eqNullSafe(F.col("best")).alias("stays")), "near-decided")

    hidden = {c: f"d_{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*[F.col(f"`{c}`").alias(d) for c, d in hidden.items()], F.col(f"`{doc_id}`").cast("long").alias("row_doc"), F.xxhash64(F.col(f"`{text}`")).alias("row_tie"))

    def which(chosen: DataFrame) -> tuple[DataFrame, Column]:
        return chosen.select("doc", "tie"), F.col("row_doc").eqNullSafe(F.col("doc")) & (F.col("row_tie") == F.col("tie"))

    kept = keyed.join(*which(decided.filter("not stays")), "left_anti")
    repeated = decided.filter("stays and copies > 1")
    if not repeated.isEmpty():
        one = kept.join(*which(repeated), "left_semi").groupBy("row_doc", "row_tie").agg(F.any_value(F.struct(*hidden.values())).alias("one"))
        kept = kept.join(*which(repeated), "left_anti").select(*hidden.values()).unionByName(one.select("one.*"))
    return kept.select(*[F.col(d).alias(c) for c, d in hidden.items()])
