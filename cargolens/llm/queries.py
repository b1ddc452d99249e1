"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (chat, jaccard, lexical, mixing, packing, pages, permutation, pieces, runs, sharding, sql, substrings, topk,
               toxicity)
from .shared import table

SHARDS = 8


#: Added to the table so that control strings inside texts are part of every run.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    kinds = dict(rows.dtypes)
    probe = probe.select(*[F.col(c).cast(kinds[c]) for c in rows.columns])
    return chat.digest(chat.format_conversations(chat.text_parts(rows.unionByName(probe))))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digest(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rows = sharding.assign_shards(documents, "doc_id", "text", SHARDS).drop("text")
    return sharding.number_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return permutation.nearest_neighbours(table(spark, folder, "embeddings"), k=20, every=20)


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.exact_top_k(table(spark, folder, "embeddings"), k=10, every=100, scale=1024)


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(substrings.removed_spans(table(spark, folder, "documents")))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    rows = packing.token_pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return packing.pack(rows, 2048)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, folder, "labels"))
    return (toxicity.score(documents, model)
            .select("doc_id", (toxicity.remainder("doc_id") == 1).alias("held_out"), "score", "predicted"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


def echoed(doc_id: object, n: int) -> np.ndarray | None:
    """Word numbers of a text that repeats a stretch of itself to its end; the checksum of the id says which and how often."""
    check = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if check % 10 or not n:
        return None
    g = check // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % period)


def op12_run_detection(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(table(spark, folder, "documents"), order=echoed))


def op13_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_sentencepiece, op3_sharding, op4_permutation_index, op5_exact_top_k,
                                  op6_html_extraction, op7_jaccard_join, op8_substring_dedup, op9_best_fit_packing, op10_toxicity,
                                  op11_lexical_search, op12_run_detection, op13_source_mixing)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.TWINS)
