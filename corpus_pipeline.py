"""The corpus pipeline: toxicity, near-duplicates by n-gram Jaccard, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next. All but
the last return the columns of documents; decisions take effect at once.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cargolens.llm import jaccard, packing, shared, substrings, toxicity

CAPACITY = 2048
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject. It learns from the labelled part of these documents."""
    model = toxicity.fit(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def _row_key() -> Column:
    """What tells rows apart and orders them: doc_id (nulls last), then the digest of the text. No field is null."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                    F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("digest"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component stays, in order of doc_id (nulls last) and digest of the text.

    Rows are compared, not ids: of rows without an id, or with the same one, copies and near copies go and different
    texts stay. Rows equal in id and text are one document; of rows without an id and without words all stay, as
    nothing says that they are one.
    """
    shared.prepare(spark)
    keyed = docs.select(_row_key().alias("_key"), "text", F.struct(*docs.columns).alias("_row"))
    groups = jaccard.jaccard_components(keyed.drop("_row"), key="_key")
    first = (groups.where(F.col("doc_id") == F.col("component_id"))
             .groupBy(F.col("doc_id").alias("_first")).agg(F.max("n_shingles").alias("_n")))
    rows = keyed.join(first, F.col("_key") == F.col("_first"))
    alone = F.when(F.col("_key.no_id") & (F.col("_n") == 0), F.monotonically_increasing_id())
    return (rows.withColumn("_alone", alone).groupBy("_key", "_alone")
            .agg(F.min("_row").alias("_row")).select("_row.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows that a document of smaller id has are cut out; texts that lose nothing stay as they are.

    Each row gets its own cut text. Rows of one id do not count as repeats of each other; rows without an id keep all.
    """
    shared.prepare(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = substrings.removed_spans(docs, carry=("text", *others))
    cut = F.col("n_removed") > 0
    made = {"doc_id": F.col("doc_id"), "text": F.when(cut, F.col("kept_text")).otherwise(F.col("carried.text")),
            "n_chars": F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType))
            .otherwise(F.col("carried.n_chars"))}
    return rows.select(*[made.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    shared.prepare(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)
    return packing.pack(pieces, CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages), ("best_fit_packing", pack)]

#: A trained classifier and a tokenizer are not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the checkpoint folder before the next."""
    docs = shared.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.cut_lineage(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
