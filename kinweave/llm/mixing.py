"""Interleaving of sources to target weights by Pfair scheduling.

Native: DataFrame functions only. Each source's documents form blocks of
``block_docs``. With integer weights r out of R = sum(r), block i (from 1) of a
source gets release floor((i-1)R/r) and deadline ceil(iR/r); earliest deadline
first among released blocks fills one slot after another (ties go to the
smaller source name), and each source's count of slots differs from its share
by less than one block at every time. The schedule repeats after R slots, so
one period is computed and every block's slot follows by arithmetic. Sources of
one weight have the same releases and deadlines and take turns by name, so the
fold over the R slots holds one counter per distinct weight, not per source.

A source that runs out leaves its further slots empty; they are skipped, and
all documents appear exactly once. Within a source, documents go in order of
md5(doc_id), doc_id, hash of text: ranks come from per-prefix counts and windows over
(source, prefix), so a source with a third of all rows is ranked by many tasks.
Blocks are made in ranges of ``RANGE_BLOCKS``, and positions come from sums of
about as many slots as there are sums, so no task holds all blocks.

Defined cases: a null source is a source of its own; null or repeated ids are
kept as they are; empty table, empty result; extra columns pass through, and
where one has the name of a column that ``schedule`` adds, the added one is
called ``mix_<name>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.sources.shared import materialize

BLOCK_DOCS = 8
RESOLUTION = 64
RANK_ROWS = 50_000
RANGE_BLOCKS = 1 << 16
#: Rows of a period (of some 50 bytes) that go to every task; longer ones are joined.
BROADCAST_ROWS = 500_000
_NONE = "\u0000"
_ADDED = ("block", "release", "deadline", "slot", "position")


def tempered_weights(counts: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """(src, weight): square roots of the document counts, the largest scaled to ``resolution``."""
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select(  # one row
        "src", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n").cast("double")) * resolution / F.sqrt(F.col("top").cast("double")))).cast("long").alias("weight")
    )


def _period(weights: DataFrame) -> DataFrame:
    """(src, weight, period, turn, slot): slots of each source's turns within one period."""
    alike = weights.groupBy("weight").agg(F.array_sort(F.collect_list("src")).alias("members"))
    # weights by their greatest common divisor: the same schedule, and the shortest period
    euclid = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("x"), b.alias("y")), lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % F.nullif(p["y"], F.lit(0))).alias("y"))))["x"]
    gathered = alike.agg(F.array_sort(F.collect_list(F.struct("weight", "members"))).alias("s"))
    shared = gathered.select("s", F.aggregate("s", F.lit(0).cast("long"), lambda g, x: euclid(g, x["weight"])).alias("g"))
    one = shared.select(F.transform("s", lambda x: F.struct((x["weight"] / F.col("g")).cast("long").alias("weight"), x["members"].alias("members"))).alias("s")).select(
        "s", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["weight"] * F.size(x["members"])).alias("period")
    ).filter("period > 0")
    s, total, far = F.col("s"), F.col("period"), F.lit(2**62)
    run = F.ceil(F.sqrt(total.cast("double"))).cast("long")

    def pick(state: Column, t: Column) -> Column:
        # of each weight: turns taken by all its sources so far; the next one's release and deadline
        def due(x: Column, taken: Column, k: Column) -> Column:
            size = F.size(x["members"]).cast("long")
            turn = F.floor(taken / size).cast("long")
            released = F.floor(turn * total / x["weight"]) <= t
            deadline = F.when(released, F.ceil((turn + 1) * total / x["weight"]).cast("long")).otherwise(far)
            return F.struct(deadline.alias("deadline"), F.get(x["members"], (taken % size).cast("int")).alias("src"), k.alias("k"), turn.alias("turn"))

        places = F.transform(s, lambda x, k: F.struct(x["weight"].alias("weight"), x["members"].alias("members"), k.alias("k")))
        first = F.array_min(F.zip_with(places, state["taken"], lambda x, n: due(x, n, x["k"])))
        return F.struct(
            F.transform(state["taken"], lambda n, k: F.when(k == first["k"], n + 1).otherwise(n)).alias("taken"),
            F.concat(state["picked"], F.array(F.struct(first["src"].alias("src"), first["turn"].alias("turn"), F.get(s, first["k"])["weight"].alias("weight")))).alias("picked"),
        )

    kind = "array<struct<src:string,turn:bigint,weight:bigint>>"
    none = F.array().cast(kind)

    def pick_run(state: Column, i: Column) -> Column:
        # short lists are appended to one by one, then whole ones to the list of lists
        inner = F.aggregate(F.sequence(i * run, F.least((i + 1) * run, total) - 1), F.struct(state["taken"].alias("taken"), none.alias("picked")), pick)
        return F.transform(F.array(inner), lambda x: F.struct(x["taken"].alias("taken"), F.concat(state["runs"], F.array(x["picked"])).alias("runs")))[0]

    start = F.struct(F.transform(s, lambda x: F.lit(0).cast("long")).alias("taken"), F.array().cast(f"array<{kind}>").alias("runs"))
    runs = F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(total / run) - 1), start, pick_run)["runs"]
    return one.select(total, F.posexplode(F.flatten(runs)).alias("slot", "one")).select("one.src", "one.weight", "period", "one.turn", F.col("slot").cast("long").alias("slot"))


def _ranked(docs: DataFrame, doc_id: str, text: str, source: str, weights: dict[str, int] | None, block_docs: int, resolution: int):
    """(rows with their slots, counts, period): columns d_0, d_1, ... of ``docs``, src, rank, block, release, deadline, slot."""
    spark, src = docs.sparkSession, F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(_NONE))
    digest = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    counts = materialize(docs.groupBy(src.alias("src")).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if weights is None:
        weighted = tempered_weights(counts, resolution)
    else:
        given = spark.createDataFrame([(str(k), int(v)) for k, v in weights.items()], "src string, weight long")
        weighted = counts.join(given, "src", "left").select("src", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("long").alias("weight"))
    period = materialize(_period(weighted), "mix-period")

    # rank within the source, from counts by md5 prefix and windows over (source, prefix)
    digits = max(1, math.ceil(math.log(max(total, 1) / RANK_ROWS, 16))) if total > RANK_ROWS else 1
    at = {c: f"d_{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*[F.col(f"`{c}`").alias(d) for c, d in at.items()], src.alias("src"), digest.alias("digest"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    keyed = keyed.withColumn("prefix", F.substring("digest", 1, digits))
    by_prefix = keyed.groupBy("src", "prefix").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_prefix.select("src", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("src", "prefix").orderBy("digest", at[doc_id], "tie")
    ranked = keyed.withColumn("k", F.row_number().over(order) - 1).join(offsets, ["src", "prefix"])
    ranked = ranked.withColumn("rank", F.col("k") + F.col("offset")).withColumn("block", F.floor(F.col("rank") / block_docs))
    return _slotted(ranked, period).drop("digest", "tie", "prefix", "k", "offset"), counts, period, at


def _slotted(rows: DataFrame, period: DataFrame) -> DataFrame:
    """``rows`` (src, block) with release, deadline, slot; the period has at most resolution * sources rows."""
    per = period.filter("turn = 0").select("src", "weight", "period")
    turns = period.select("src", "turn", F.col("slot").alias("in_period"))
    if period.count() <= BROADCAST_ROWS:
        per, turns = F.broadcast(per), F.broadcast(turns)
    return (
        rows.join(per, "src").withColumn("turn", F.col("block") % F.col("weight")).join(turns, ["src", "turn"])
        .withColumns({
            "release": F.expr("block * period div weight"),
            "deadline": F.expr("((block + 1) * period + weight - 1) div weight"),
            "slot": (F.expr("block div weight") * F.col("period") + F.col("in_period")).cast("long"),
        })
        .drop("weight", "period", "turn", "in_period")
    )


def _block_starts(counts: DataFrame, period: DataFrame, block_docs: int) -> DataFrame:
    """(src, block, first): documents before each block in the order of slots."""
    ends = F.floor((F.col("n") - 1) / block_docs)
    ranges = counts.withColumn("last", ends).select("src", "n", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / RANGE_BLOCKS))).alias("range"))
    in_range = F.sequence(F.col("range") * RANGE_BLOCKS, F.least(F.col("last"), (F.col("range") + 1) * RANGE_BLOCKS - 1))
    blocks = ranges.repartition("src", "range").select("src", "n", F.explode(in_range).alias("block"))
    blocks = _slotted(blocks, period).select("src", "block", "slot", F.least(F.lit(block_docs), F.col("n") - F.col("block") * block_docs).cast("long").alias("size"))
    made = counts.agg(F.sum(ends + 1)).first()[0] or 0
    chunk = max(16, math.isqrt(made))
    blocks = blocks.withColumn("chunk", F.expr(f"slot div {chunk}"))
    chunks = blocks.groupBy("chunk").agg(F.sum("size").alias("n"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # about the square root of the blocks
    chunks = chunks.select("chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("chunk").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("in_chunk", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(chunks, "chunk")
    return blocks.select("src", "block", (F.col("start") + F.col("in_chunk")).alias("first"))


def schedule(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS, resolution: int = RESOLUTION,
) -> DataFrame:
    """(docs' columns, block, release, deadline, slot, position), one row per row of ``docs``.

    ``weights`` maps sources to integer targets (absent sources weigh 1); by
    default they are the tempered ones. ``position`` counts from 0 over all rows.
    """
    ranked, counts, period, at = _ranked(docs, doc_id, text, source, weights, block_docs, resolution)
    placed = ranked.join(_block_starts(counts, period, block_docs), ["src", "block"])
    placed = placed.withColumn("position", F.col("first") + F.col("rank") % block_docs)
    added = []
    for name in _ADDED:
        free = name
        while free in docs.columns:
            free = f"mix_{free}"
        added.append(F.col(name).cast("long").alias(free))
    return placed.select(*[F.col(d).alias(c) for c, d in at.items()], *added)


def interleave(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS, resolution: int = RESOLUTION,
) -> DataFrame:
    """``docs`` with its own columns, in the order of the schedule's positions."""
    ranked, *_, at = _ranked(docs, doc_id, text, source, weights, block_docs, resolution)
    return ranked.orderBy("slot", "rank").select(*[F.col(d).alias(c) for c, d in at.items()])


ORACLE = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce(source, chr(0)) AS src, count(*) AS n FROM documents GROUP BY 1),
weights AS (
  SELECT src, n, greatest(1, floor(sqrt(n::DOUBLE) * {RESOLUTION} / sqrt((SELECT max(n) FROM counts)::DOUBLE)))::BIGINT AS w,
         row_number() OVER (ORDER BY src) AS i FROM counts),
a AS (SELECT list(w ORDER BY i) AS ws, sum(w)::BIGINT AS period, count(*)::BIGINT AS k FROM weights),
sim(t, cnt, pick) AS (
  SELECT -1::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT FROM a
  UNION ALL
  SELECT t + 1, list_transform(cnt, lambda n, j: CASE WHEN j = p THEN n + 1 ELSE n END), p FROM (
    SELECT t, cnt, period, list_min(list_transform(cnt, lambda n, j: CASE WHEN (n * period) // ws[j] <= t + 1
        THEN (((n + 1) * period + ws[j] - 1) // ws[j]) * 100000 + j ELSE 900000000000000000 END)) % 100000 AS p
    FROM sim, a WHERE t + 1 < period)),
turns AS (
  SELECT pick AS i, t AS in_period, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM sim WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, coalesce(source, chr(0)) AS src,
         row_number() OVER (PARTITION BY coalesce(source, chr(0)) ORDER BY md5(doc_id::VARCHAR), doc_id, text) - 1 AS rank
  FROM documents),
placed AS (
  SELECT r.doc_id, r.source, r.rank // {BLOCK_DOCS} AS block, r.rank % {BLOCK_DOCS} AS k, w.w, a.period, w.i
  FROM ranked r JOIN weights w ON r.src = w.src CROSS JOIN a),
slotted AS (
  SELECT p.*, (block // w) * period + t.in_period AS slot
  FROM placed p JOIN turns t ON t.i = p.i AND t.turn = p.block % p.w)
SELECT doc_id, source, block::BIGINT AS block, ((block * period) // w)::BIGINT AS release,
       (((block + 1) * period + w - 1) // w)::BIGINT AS deadline, slot::BIGINT AS slot,
       (row_number() OVER (ORDER BY slot, k) - 1)::BIGINT AS position
FROM slotted
"""
