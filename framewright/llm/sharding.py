"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, shared_folder

#: Virtual slots; the slot table and the map have at most this many rows, and splits.
SLOTS = 16384
#: Parts of a shard's fair share that a slot may have, tried from the largest: slots above are split by doc_id.
SPLITS = (1, 1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32, 1 / 64)
#: How far above the fair share a shard may be before slots are split finer.
UNEVEN = 1.005


def as_rows(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """The map as a table: version, vslot, piece, shard, bytes, rows; it is small, so its text goes with the plan."""
    text = ",".join(":".join(map(str, x)) for x in entries)
    parts = F.split("entry", ":")
    rows = spark.range(1 if entries else 0).select(F.explode(F.split(F.lit(text), ",")).alias("entry"))
    kinds = {"version": "int", "vslot": "int", "piece": "int", "shard": "int", "bytes": "long", "rows": "long"}
    return rows.select(*(parts[k].cast(kind).alias(name) for k, (name, kind) in enumerate(kinds.items())))


def records(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One slim row per document with its virtual slot, hashed from the text so that equal texts stay together."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return documents.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64(raw), F.lit(slots)).cast("int").alias("vslot"),
        F.monotonically_increasing_id().alias("row"),
    )


def least_split(slots: list, shards: int, splits: tuple = SPLITS) -> dict[int, int]:
    """Into how many pieces slots too hot for balance go: as few as the first split needs that leaves shards even."""
    total = sum(s.bytes for s in slots)
    for split in splits:
        most = max(1.0, total * split / shards)
        parts = {s.vslot: min(math.ceil(s.bytes / most), s.rows) for s in slots}
        load = [0.0] * shards
        heapq.heapify(load)
        for size in sorted((s.bytes / parts[s.vslot] for s in slots for _ in range(parts[s.vslot])), reverse=True):
            heapq.heapreplace(load, load[0] + size)
        if max(load) <= UNEVEN * total / shards:
            break
    return {k: n for k, n in parts.items() if n > 1}


def pieces(rows: DataFrame, shards: int) -> DataFrame:
    """Give every row the piece of its slot: 0, but for slots too hot for balance, which doc_id and text split.

    The table of slots and that of hot ones have at most SLOTS rows; at most ``2 * shards / SPLITS[-1]``
    pieces are made beyond the slots.
    """
    slots = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    hot = least_split(slots, shards)
    if not hot:
        return rows.withColumn("piece", F.lit(0))
    n = F.get(F.array(*(F.lit(x) for x in hot.values())), F.array_position(F.array(*(F.lit(x) for x in hot)), F.col("vslot")).cast("int") - 1)
    return rows.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), n).cast("int"), F.lit(0)))


def first_map(slots: list, shards: int) -> list[tuple]:
    """Version 1 of the map: slots, largest first, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, k) for k in range(shards)]
    out = []
    for s in sorted(slots, key=lambda s: (-s.bytes, s.vslot, s.piece)):
        size, n, k = heapq.heappop(heap)
        out.append((1, s.vslot, s.piece, k, s.bytes, s.rows))
        heapq.heappush(heap, (size + s.bytes, n + s.rows, k))
    return out


def rebalance(old: list[tuple], shards: int) -> list[tuple]:
    """The next version of the map, for another number of shards; only slots that must move do.

    Slots of shards that go, and the smallest slots that fit of shards above the new fair share,
    go to the shards with the fewest bytes.
    """
    total = sum(x[4] for x in old)
    fair = total / shards
    load = [0] * shards
    stay, move = [], []
    for x in sorted(old, key=lambda x: (-x[4], x[1], x[2])):
        if x[3] < shards and load[x[3]] + x[4] <= fair:
            load[x[3]] += x[4]
            stay.append(x)
        else:
            move.append(x)
    heap = [(size, k) for k, size in enumerate(load)]
    heapq.heapify(heap)
    out = [(x[0] + 1, *x[1:]) for x in stay]
    for x in move:
        size, k = heapq.heappop(heap)
        out.append((x[0] + 1, x[1], x[2], k, x[4], x[5]))
        heapq.heappush(heap, (size + x[4], k))
    return out


def save_map(spark: SparkSession, entries: list[tuple], path: str) -> None:
    """Add versions of a map to its table, a folder for each version."""
    as_rows(spark, entries).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, or the last: version, vslot, piece, shard, bytes, rows."""
    found = spark.read.schema("vslot int, piece int, shard int, bytes long, rows long, version int").parquet(path)
    last = version if version is not None else found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == (last if last is not None else 0)).select("version", "vslot", "piece", "shard", "bytes", "rows")


def edit_map(spark: SparkSession, path: str, shards: int) -> int:
    """Add the version that rebalances the last one to another number of shards; returns its number."""
    now = [tuple(r) for r in load_map(spark, path).collect()]  # at most slots and pieces of hot ones, whatever the input
    if not now:
        return 0
    then = rebalance(now, shards)
    save_map(spark, then, path)
    return then[0][0]


def deal(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The rows in the shards that a version of the map says, numbered in each from 0 without gaps."""
    # Where each slot's rows begin in their shard: a window over the map, not over rows.
    here = W.partitionBy("shard").orderBy("vslot", "piece").rowsBetween(W.unboundedPreceding, -1)
    starts = slot_map.select("vslot", "piece", "shard", F.coalesce(F.sum("rows").over(here), F.lit(0).cast("long")).alias("before"))
    rank = F.row_number().over(W.partitionBy("vslot", "piece").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    return rows.join(F.broadcast(starts), ["vslot", "piece"]).withColumn("slot", F.col("before") + rank)


def shard(documents: DataFrame, shards: int = 8, slots: int = SLOTS, grow_to: int | None = None, path: str | None = None) -> tuple[DataFrame, str]:
    """Deal documents to shards of nearly equal bytes.

    A size is the UTF-8 bytes of the text (null: none) plus 1. Rows are hashed into fixed
    virtual slots, bytes are summed per slot, and a stored map gives each slot to a shard. A row
    per input row comes back, repeated rows and null doc_ids too; an empty table gives
    none. ``slot`` numbers the rows of a shard from 0 without gaps. Equal texts share a
    shard unless their slot is too large for even shards; then rows of one doc_id and text
    stay together. Neither depends on how the input is partitioned. With ``grow_to`` a second version of the map is
    stored, for so many shards, and rows go where that says.
    Returns the rows and the folder of the map with all its versions: path, or a new one in the shared folder.
    """
    spark = documents.sparkSession
    path = path or f"{shared_folder(spark)}/framewright-map-{uuid.uuid4().hex}"
    rows = cut(pieces(cut(records(documents, slots)), shards))
    table = rows.groupBy("vslot", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    save_map(spark, first_map(table.collect(), shards), path)  # at most slots and pieces of hot ones, whatever the input
    if grow_to:
        edit_map(spark, path, grow_to)
    dealt = deal(rows, load_map(spark, path))
    return dealt.select("doc_id", "size", "text_crc32", "shard", "slot", "vslot"), path


def shard_query(documents: DataFrame) -> DataFrame:
    """shard() by the law of equal bytes, for eight shards, with the columns of its query."""
    rows, _ = shard(documents)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
