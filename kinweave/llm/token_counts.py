"""Exact length histogram: token totals, quantiles and truncated totals at every context limit.

Documents are encoded whole and aggregated by their number of ids, so one row
per distinct length remains. Suffix sums over that histogram answer, for the
limit equal to each length: documents and tokens at or above it, and the total
that is left when every document is cut to the limit. The sums run in blocks of
``block`` lengths (a few totals, then windows inside each block), so no task
takes the whole histogram.

Defined cases: null or empty text has length 0; repeated rows count again;
an empty table has an empty histogram and zero totals; extra columns are unused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.arrow import slices
from kinweave.llm.bpe import encoder
from kinweave.sources.shared import materialize

def _length_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            counted = [len(ids) for part in slices(batch, 0) for ids in encode.batch(part.column(0))]
            if counted:
                length, n = np.unique(counted, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(n, pa.int64())], ["n_tokens", "n_docs"])

    return run


def histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs), one row per distinct length."""
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_length_batches(tokenizer), "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int | None = None) -> DataFrame:
    """Per length L: docs_at_least, tokens_at_least, truncated_tokens (sum of min(length, L)), docs_below, share_at_most."""
    if block is None:
        block = max(16, math.isqrt(hist.agg(F.max("n_tokens")).first()[0] or 0))
    tokens = (F.col("n_tokens") * F.col("n_docs")).alias("t")
    rows = hist.select("n_tokens", "n_docs", tokens, F.floor(F.col("n_tokens") / block).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("t").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    beyond = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    total = blocks.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumns({"d_in": F.sum("n_docs").over(inside), "t_in": F.sum("t").over(inside)}).join(beyond, "block").crossJoin(F.broadcast(total))  # one row
    d, t = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    return at.select(
        "n_tokens", "n_docs", d.alias("docs_at_least"), t.alias("tokens_at_least"),
        (F.col("all_tokens") - t + F.col("n_tokens") * d).alias("truncated_tokens"),
        (F.col("all_docs") - d).alias("docs_below"),
        ((F.col("all_docs") - d + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, truncated_tokens, dropped_tokens) of each context limit."""
    cut = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    rows = hist.select("n_tokens", "n_docs", cut.alias("context"))
    kept = F.least("n_tokens", "context") * F.col("n_docs")
    return rows.groupBy("context").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(kept).alias("truncated_tokens"), F.sum(F.col("n_tokens") * F.col("n_docs") - kept).alias("dropped_tokens"),
    )


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that a share ``q`` of the documents does not exceed."""
    return sums.filter(F.col("share_at_most") >= q).agg(F.min("n_tokens")).first()[0]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The histogram of ``docs`` with its suffix sums."""
    return suffix_sums(materialize(histogram(docs, tokenizer, text), "lengths"))
