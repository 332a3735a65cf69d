"""A training corpus from documents: toxicity, exact and near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import exact_dedup, packing, simhash, substring_dedup, toxicity
from framewright.llm.common import removed, stored

#: SQL cannot train the models of the first stage; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models, fitted to the labels of those still here, do not predict to be toxic.

    Texts that are null or empty, repeated rows, null ids and further columns stay as they are.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id, a null one last; a null text equals an empty one, and of rows that are alike one stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id, a null one last; texts without words are one group."""
    return simhash.drop_near_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that occur elsewhere too; texts without any stay as they are, null ones too."""
    done = substring_dedup.substring_dedup(docs.withColumn("__whole", F.col("text")), ("__n_words", "__n_removed"))
    text = F.when(F.col("__n_removed") == 0, F.col("__whole")).otherwise(F.col("text"))
    changed = done.withColumn("text", text).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return changed.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; a null or empty text is the one id that ends it."""
    return packing.harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before kept, as stored; a stored table goes once the next one is written. An empty table gives no pieces."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, path = stored(docs)
            if before:
                removed(spark, before)
            before = path
    return docs
