"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the
stage before kept; its result is written as Parquet and read again as the next
one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import line_dedup, mixing, packing, quality, simhash
from kinweave.llm.queries import TOKENIZER
from kinweave.sources.shared import materialize, recorded, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose base counts pass and whose lines are content by half or more."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that spread over many sources (the first document keeps them)."""
    cut = line_dedup.remove_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule."""
    return mixing.interleave(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; ``position`` is the place in the mixed order, and seeds are taken in it."""
    return packing.pack(docs, TOKENIZER, order=packing.file_order(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: No SQL: the quality stage decodes a trained chain and packing needs BPE ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what only an ended stage needed is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept: list[str] = []  # the last stage's result
    for i, (name, stage) in enumerate(STAGES):
        with recorded() as paths:
            docs = stage(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs = materialize(docs, name.replace(" ", "-"))
                release(spark, kept + paths[:-1])
                kept = paths[-1:]
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
