"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import chat, delta_lloyd, licenses, line_dedup, lm_score, media, mixing, packing, phrases, quality, simhash, token_counts, toxicity

#: A bare name: every worker looks up its own file.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, _table(spark, sf_dir, "labels"), {"low_quality": "1 - quality", "toxic": "toxic"})


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, _table(spark, sf_dir, "labels"))


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op5_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_media(media.store_payloads(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.remove_lines(docs, n_lines="n_lines", n_removed="n_removed")


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents").select("text"), TOKENIZER)


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.schedule(docs).drop("text")


def op9_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = delta_lloyd.quantise(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return delta_lloyd.cluster_digests(delta_lloyd.delta_lloyd(vectors), vectors)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_hostile(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return chat.read_back(chat.windows(turns, TOKENIZER))


def queries() -> dict:
    all_ = (
        op1_toxicity_chain, op2_quality_crf, op3_simhash_trie, op4_bm25_packing, op5_media_sniffing,
        op6_line_dedup, op7_token_histogram, op8_pfair_mixing, op9_gru_scores, op10_license_sentences,
        op11_delta_lloyd, op12_phrases, op13_chat_windows,
    )
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.ORACLE, "op8_pfair_mixing": mixing.ORACLE, "op11_delta_lloyd": delta_lloyd.ORACLE, "op12_phrases": phrases.ORACLE}
