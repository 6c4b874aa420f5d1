"""Cross-site line removal by the spread of each line over distinct sites.

Native: DataFrame functions only. Each line with a word is hashed; HyperLogLog
sketches of the sites per line hash are merged by aggregation (partial sketches
are built before the shuffle, so a line that a third of all rows share arrives
as one sketch per task). Lines whose estimate is clearly under or over
``min_sites`` are decided by the sketch; those within ``sigmas`` standard
errors get an exact distinct count.

Where lines meet a table of hashes, the hot ones (more than ``HOT_ROWS`` rows
and more than one in ``HOT_LINES``, so at most ``HOT_LINES`` of them) go to
every task and stay where they are; only the others are shuffled. What is
gathered per document are the places of its cut lines.

Defined cases: null text stays null with 0 lines; lines without a word are
never removed; a null site counts as one unnamed site; repeated rows count as
rows of one site; the document with the smallest id that holds a line keeps all
its own occurrences, so no line leaves the corpus; an empty table gives an
empty result; extra columns pass through ``remove_lines`` untouched, whatever
their names, but one with the name of a count column gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.sources.shared import materialize

MIN_SITES = 5
LG_K = 12
SIGMAS = 4.0
HOT_ROWS = 10_000
HOT_LINES = 10_000
_WORD = r"[^\x20\x09-\x0D]"


def _lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """(doc, text_hash, pos, line_hash, site) of every line with a word."""
    content = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(content).alias("text_hash"),
        F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("")).alias("site"),
        F.posexplode(_lines_of(content)).alias("pos", "line"),
    )
    return rows.filter(F.col("line").rlike(_WORD)).select("doc", "text_hash", "pos", "site", F.xxhash64("line").alias("line_hash"))


def _meet(lines: DataFrame, chosen: DataFrame, hot_rows: int) -> DataFrame:
    """``lines`` joined with ``chosen`` (line_hash, n, ...), those with more than ``hot_rows`` rows without a shuffle."""
    hot = chosen.filter(F.col("n") > hot_rows).drop("n")
    rest = lines.join(chosen.filter(F.col("n") <= hot_rows).drop("n"), "line_hash")
    return rest if hot.isEmpty() else rest.unionByName(lines.join(F.broadcast(hot), "line_hash"))  # at most HOT_LINES rows


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, sigmas: float = SIGMAS, hot_rows: int | None = None) -> DataFrame:
    """(line_hash, n_sites, first_doc, n) of lines on at least ``min_sites`` distinct sites; n counts their rows."""
    hot_rows = _hot_rows(lines) if hot_rows is None else hot_rows
    sketched = (
        lines.groupBy("line_hash")
        .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min("doc").alias("first_doc"))
        .filter(F.col("n") >= min_sites)  # a line has no more sites than rows
        .select("line_hash", "first_doc", "n", F.hll_sketch_estimate("sketch").alias("estimate"))
    )
    band = sigmas * 1.04 / math.sqrt(2**lg_k)
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    candidates = materialize(sketched.filter(F.col("estimate") >= math.floor(low)), "line-spread")
    sure = candidates.filter(F.col("estimate") > math.ceil(high)).select("line_hash", F.col("estimate").alias("n_sites"))
    near = candidates.filter(F.col("estimate") <= math.ceil(high)).select("line_hash", "n")
    exact = (
        _meet(lines.select("line_hash", "site"), near, hot_rows)
        .groupBy("line_hash", "site").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_sites"))
        .filter(F.col("n_sites") >= min_sites)
    )
    return sure.unionByName(exact).join(candidates.select("line_hash", "first_doc", "n"), "line_hash")


def _hot_rows(lines: DataFrame) -> int:
    return max(HOT_ROWS, lines.count() // HOT_LINES)


def remove_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
    min_sites: int = MIN_SITES, lg_k: int = LG_K, sigmas: float = SIGMAS, hot_rows: int | None = None,
    n_lines: str | None = None, n_removed: str | None = None,
) -> DataFrame:
    """``docs`` with cross-site boilerplate lines taken out of ``text``.

    Same rows and columns; ``n_lines`` and ``n_removed`` name count columns to add.
    """
    lines = materialize(line_table(docs, doc_id, text, site), "lines")
    hot_rows = _hot_rows(lines) if hot_rows is None else hot_rows
    spread = materialize(spread_lines(lines, min_sites, lg_k, sigmas, hot_rows).select("line_hash", "first_doc", "n"), "spread-lines")
    cuts = (
        _meet(lines.drop("site"), spread, hot_rows).filter(~F.col("doc").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc").alias("cut_doc"), F.col("text_hash").alias("cut_hash")).agg(F.sort_array(F.collect_set("pos")).alias("cuts"))  # a set: repeated rows
    )
    hidden = {c: f"d_{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*[F.col(f"`{c}`").alias(d) for c, d in hidden.items()])
    content, found = F.col(hidden[text]), F.col("cuts")
    joined = keyed.join(cuts, F.col(hidden[doc_id]).eqNullSafe(F.col("cut_doc")) & (F.xxhash64(content) == F.col("cut_hash")), "left")

    def without(body: Column) -> Column:
        # the runs of lines between one cut and the next
        runs = F.zip_with(F.concat(F.array(F.lit(-1)), found), F.concat(found, F.array(F.size(body))), lambda a, b: F.slice(body, a + 2, b - a - 1))
        return F.array_join(F.flatten(runs), "\n")

    whole = F.when(found.isNull(), content).otherwise(F.transform(F.array(_lines_of(content)), without)[0])
    counted = {
        n_lines: F.when(content.isNull(), 0).otherwise(F.size(_lines_of(content))).cast("long"),
        n_removed: F.coalesce(F.size(found), F.lit(0)).cast("long"),
    }
    out = [(whole if c == text else F.col(d)).alias(c) for c, d in hidden.items() if c not in counted]
    return joined.select(*out, *[value.alias(name) for name, value in counted.items() if name])


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
spread AS (
  SELECT line, min(doc_id) AS first_doc FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES}),
marked AS (
  SELECT l.*, s.line IS NOT NULL AND l.doc_id <> s.first_doc AS cut
  FROM lines l LEFT JOIN spread s ON l.line = s.line)
SELECT d.doc_id, d.source,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.body, '') END AS text,
       coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut) AS body,
         count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed
  FROM marked GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""
