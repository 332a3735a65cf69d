"""What the corpus operators share: cutting lineage and cheap, exact text primitives.

Words are runs of bytes outside 0x20 and 0x09-0x0D; ``bytes.split()`` breaks at
exactly these, and none of them occurs inside a multi-byte UTF-8 character.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Java pattern of the word separators.
SPACES = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or in local mode one of our own."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if shared is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="framewright-"))
    return shared or sc.getCheckpointDir()


def cut(df: DataFrame, anew: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation.

    Where spark.cleaner.referenceTracking.cleanCheckpoints is set, Spark's cleaner removes
    the files once nothing refers to them; else they stay until the folder is removed.
    A checkpoint keeps the optimizer's estimate of its size, which joins multiply; in a
    loop, anew forgets it, or its digits double from round to round.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    if not anew:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False), spark)


def few(df: DataFrame, rows: float, each: int = 50_000) -> DataFrame:
    """df in as few tasks, and files where it is cut, as so many rows need; never in more than it has."""
    return df.coalesce(int(rows // each) + 1)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written as Parquet to the shared folder and read again, and where it is."""
    path = f"{shared_folder(df.sparkSession)}/framewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder that stored() made, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_keys(*columns: str) -> tuple[Column, Column]:
    """Two independent hashes of some columns, 128 bits in all; nulls count."""
    each = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return F.xxhash64(*each), F.xxhash64(F.lit("also"), *each)


_kept: dict = {}


def keep(name: tuple, make):
    """What a worker process keeps from task to task for one operator; what another operator kept goes first."""
    if name not in _kept:
        _kept.clear()
        give_back()
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Return to the system what Python, Arrow and the C library hold without using it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, rows: int = 1_000):
    """Arrow batches cut into pieces of at most so many rows, so that Python objects of few rows exist at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Memo:
    """What a worker process keeps from batch to batch: two generations of entries, so that frequent keys stay.

    Holds at most twice ``cap`` entries and one batch; what falls out is only computed again.
    """

    def __init__(self, cap: int):
        self.cap, self.new, self.old = cap, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are not held; all others can be looked up in ``new`` from here on."""
        if len(self.new) > self.cap:
            self.old, self.new = self.new, {}
        out = []
        for k in keys:
            if k not in self.new:
                if k in self.old:
                    self.new[k] = self.old[k]
                else:
                    out.append(k)
        return out


def chunks(texts: list, most: int):
    """Slices of texts of up to ``most`` characters each, one text at least."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to
