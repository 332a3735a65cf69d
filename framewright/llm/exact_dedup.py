"""Exact deduplication by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Runs that one merge takes in; the binomial rounds double up to this many at once.
FAN_IN_BITS = 4
#: Ranges of digests, each of which ends as one sorted run in one task: of ten billion texts, about 2.5 million.
RANGES = 4_096


def digests(documents: DataFrame) -> DataFrame:
    """One slim row per document: doc_id, the digest of its normalised text, its length, and a row number."""
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return documents.select("doc_id", norm.alias("norm")).select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
        F.monotonically_increasing_id().alias("row"),
    )


def tree_merge(rows: DataFrame, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """Merge the digest runs of all partitions, round by round, into one row per distinct text.

    A run is what one partition of the input holds of one of RANGES ranges of digests. The
    first round adds up each task's equal digests before anything moves, so a text that a
    third of all rows share sends one row per task. In every round after, the runs of a
    range whose numbers agree but for their last ``fan_in_bits`` bits go to one task, whole,
    are merged there in the order of their digests, and stay there as one sorted run; equal
    digests become one row with the identifier that stays and a count. In the end each range
    is one run. Digests meet only if length and a second hash agree too, which verifies each merge.
    """
    key = ["text_sha256", "n_bytes", "check"]
    number = F.shiftright("row", 33)  # monotonically_increasing_id has the partition above bit 33
    merge = [F.max("keep").alias("keep"), F.sum("group_size").alias("group_size")]
    runs = rows.select(
        *key,
        (F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long") * RANGES / 2**32).cast("int").alias("range"),
        F.shiftright(number, fan_in_bits).alias("run"),
        F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row").alias("keep"),
        F.lit(1).cast("long").alias("group_size"),
    )
    runs = runs.groupBy("range", "run", *key).agg(*merge)
    last = (rows.agg(F.max(number).alias("last")).first().last or 0) >> fan_in_bits
    while True:
        last >>= fan_in_bits
        sent = runs.withColumn("run", F.shiftright("run", fan_in_bits)).repartition("range", "run")
        runs = sent.sortWithinPartitions("range", "run", *key).groupBy("range", "run", *key).agg(*merge)
        if not last:
            return runs.drop("range", "run")


def exact_dedup(documents: DataFrame) -> DataFrame:
    """Keep, of equal texts, the row with the largest doc_id.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty.
    A null doc_id counts as smallest. Of rows that also share the doc_id exactly one
    stays. Extra columns are ignored; an empty table gives an empty result.
    Returns a row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows = cut(digests(documents))
    key = ["text_sha256", "n_bytes", "check"]
    groups = cut(tree_merge(rows).where("group_size > 1"))
    # Both sides are exchanged for this join, so AQE can split the partition of a hot digest.
    return rows.join(groups, key, "left").select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """The documents without those that exact_dedup drops, all columns as they are."""
    judged = cut(exact_dedup(documents).where("NOT kept"))
    names = documents.columns
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    keyed = documents.select("*", F.sha2(norm, 256).alias("__sha"))
    gone = judged.where("NOT (doc_id <=> keep_id)").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__gone")).distinct()
    left = keyed.join(gone, (F.col("__sha") == F.col("__gone")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    if not judged.where("doc_id <=> keep_id").isEmpty():  # rows repeated under one doc_id
        left = left.dropDuplicates(["doc_id", "__sha"])
    return left.select(*names)
