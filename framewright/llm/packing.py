"""Harmonic packing of token sequences."""

from __future__ import annotations

import re
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, chunks, cut, keep

CAPACITY = 4096
#: The classes: a piece of class j takes at most 1/j of a sequence, and a sequence of class j holds exactly j pieces.
CLASSES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512)
#: A remainder this near to its class's share is placed whole; any other is cut at the next smaller share.
NEAR = 0.97
#: The id that ends each document.
END_ID = 2
#: The two special strings of the word vocabulary; where a text spells one, it is its one id, as the tokenizer's plain call has it.
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: Words whose ids a worker keeps, words that are encoded at once, and characters that are split at once.
KEPT_WORDS, WORDS_AT_ONCE, CHARS_AT_ONCE = 400_000, 5_000, 4_000_000

#: A sign after a letter; an apostrophe may belong to what follows and stays.
_SIGN = re.compile(rb"(?<=[a-z])([^a-z0-9\s'\x80-\xff])")
_SPECIAL = re.compile(b"(" + b"|".join(map(re.escape, SPECIAL)) + b")")


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never merges across it: word by word, each once.

    Words are told apart after A-Z is lower-cased and a space put between a letter and the
    sign after it, where the tokenizer splits too. A word of lower-case letters alone goes
    to its merges at once, as the signs that stand for its bytes; any other takes the whole way.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.joint = Tokenizer.from_str(vocabulary)
        self.special = {x: self.joint.token_to_id(x.decode()) for x in SPECIAL}
        self.mark = self.special[SPECIAL[0]]
        self.merge = self.joint.model.tokenize
        letters = (chr(b) for b in range(0x80, 0x800))  # every byte of UTF-8 that letters beyond a-z begin or go on with
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {}
        for c in letters:
            for byte, sign in zip(c.encode(), level.pre_tokenize_str(c)[0][0]):
                self.signs[byte] = sign
        for byte in range(0xE0, 0xF5):
            c = bytes([byte, 0xA0 if byte < 0xED else 0x9F if byte == 0xED else 0x80 if byte == 0xF4 else 0x90 if byte >= 0xF0 else 0x80, 0x80, *[0x80] * (byte >= 0xF0)]).decode()
            self.signs[byte] = level.pre_tokenize_str(c)[0][0][0]
        self.known = Memo(KEPT_WORDS)

    @staticmethod
    def of(path: str, read) -> WordEncoder:
        """The encoder of a vocabulary file that read() gives, made once in a worker."""
        return keep(("words", path), lambda: WordEncoder(read()))

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        if b"<|" not in text or not _SPECIAL.search(text):
            return _SIGN.sub(rb" \1", text.lower()).split()
        return [w for part in _SPECIAL.split(text) for w in ([part] if part in SPECIAL else _SIGN.sub(rb" \1", part.lower()).split())]

    def _learn(self, words: list[bytes]) -> None:
        known, merge, rest = self.known.new, self.merge, []
        for word in words:
            if word in self.special:
                known[word] = array("I", [self.special[word]]).tobytes()
                continue
            if word.isalpha():
                known[word] = array("I", [t.id for t in merge(word.decode())]).tobytes()
                continue
            text = word.decode()
            if text.isalpha() and text == text.lower() and is_normalized("NFC", text):
                known[word] = array("I", [t.id for t in merge(word.decode("latin-1").translate(self.signs))]).tobytes()
            else:
                rest.append(word)
        for at in range(0, len(rest), WORDS_AT_ONCE):
            some = rest[at : at + WORDS_AT_ONCE]
            # A special token between the words keeps them apart and marks where each one's ids end.
            ids = np.array(self.joint.encode_batch_fast([SPECIAL[0].decode().join(w.decode() for w in some)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, [*(np.flatnonzero(ids == self.mark) * 4).tolist(), len(raw)]):
                known[word] = raw[start:end]
                start = end + 4

    def encode(self, texts: list[bytes]):
        """The ids of each text, given as UTF-8, as little-endian unsigned 32-bit integers."""
        for part in chunks(texts, CHARS_AT_ONCE):
            split = [self.words(t) for t in part]
            if new := self.known.missing({w for words in split for w in words}):
                self._learn(new)
            get = self.known.new.__getitem__
            for words in split:
                yield b"".join(map(get, words))


def cuts(n: int, capacity: int = CAPACITY, classes: tuple = CLASSES, near: float = NEAR) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n ids: whole sequences, then the largest shares that fit."""
    out = [(capacity, 1)] * (n // capacity)
    left = n % capacity
    while left:
        below = 1  # the widest class whose share is below what is left
        for j in classes:
            share = capacity // j
            if share < left:
                below = j
                break
            tight = j
        if left >= near * (capacity // tight) or tight == classes[-1]:
            out.append((left, tight))
            break
        out.append((capacity // below, below))
        left -= capacity // below
    return out


def pieces(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, class, local and the ids if asked for.

    local numbers the pieces of each class from 0 within the task that makes them.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()
    with open(path, encoding="utf-8") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())  # one file, whatever the input

    def run(batches):
        encoder = WordEncoder.of(path, lambda: vocabulary.value)
        made = dict.fromkeys(CLASSES, 0)
        for batch in batches:
            source, rows, blobs = [], [], []
            for k, raw in enumerate(encoder.encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])):
                raw += end
                n, start = len(raw) // 4, 0
                for length, j in cuts(n):
                    ids = raw[4 * start : 4 * (start + length)]
                    source.append(k)
                    rows.append((start, length, zlib.crc32(ids), n, j, made[j]))
                    made[j] += 1
                    if with_ids:
                        blobs.append(ids)
                    start += length
            columns = list(zip(*rows)) or [()] * 6
            out = [batch.column(0).take(pa.array(source, pa.int32())), *(pa.array(c, pa.int64()) for c in columns)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "local"]
            if with_ids:
                out.append(pa.array(blobs, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class long, local long" + ", ids binary" * with_ids)


def first_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(key, bin, place) of each (key, length), longest first, each into the first bin with room."""
    room, count, out = [], [], []
    for key, length in sorted(items, key=lambda x: (-x[1], x[0])):
        k = next((k for k, r in enumerate(room) if r >= length), len(room))
        if k == len(room):
            room.append(capacity)
            count.append(0)
        out.append((key, k, count[k]))
        room[k] -= length
        count[k] += 1
    return out


def harmonic_pack(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most CAPACITY ids.

    Each document ends with END_ID, so an empty or null text is one id, and each id lies
    in exactly one piece. A worker numbers its pieces of each class by itself; counts per
    worker and class, not pieces, tell where its numbers begin, and number // class is
    the sequence. Only the last, incomplete sequence of each class is left, at most
    ``sum(CLASSES)`` pieces for any input, and first fit packs these. Repeated rows are
    packed each; a null doc_id stays null; extra columns are ignored. A text that spells a
    special string has its id there, and its own ids around it.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset per piece.
    """
    spark: SparkSession = documents.sparkSession
    made = cut(pieces(documents, path, with_ids).withColumn("row", F.monotonically_increasing_id()).withColumn("worker", F.shiftright("row", 33)))
    per = cut(made.groupBy("class", "worker").agg(F.count("*").alias("n")))
    totals = {x["class"]: x.n for x in per.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # a row per class
    before = per.select("class", "worker", F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("worker").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    first, k = {}, 0
    for j in sorted(totals):
        first[j] = k
        k += totals[j] // j
    bounds = spark.createDataFrame([(j, first[j], totals[j] // j * j) for j in totals], "class long, first long, whole long")
    # The counts per worker are joined by worker and class: small beside the pieces, and no key has more rows than one worker made.
    ranked = made.join(before, ["class", "worker"]).withColumn("rank", F.col("before") + F.col("local")).join(F.broadcast(bounds), "class")
    slim = cut(ranked.select("row", "length", "class", (F.col("rank") >= F.col("whole")).alias("left"), (F.col("first") + F.floor(F.col("rank") / F.col("class"))).alias("sequence_id"), (F.col("rank") % F.col("class")).alias("place")))
    rest = first_fit([(x.row, x.length) for x in slim.where("left").select("row", "length").collect()], CAPACITY)  # at most sum(CLASSES) rows
    left = spark.createDataFrame([(row, k + b, p) for row, b, p in rest], "row long, s long, p long")
    here = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        slim.join(F.broadcast(left), "row", "left")
        .select("row", "length", F.coalesce("s", "sequence_id").alias("sequence_id"), F.coalesce("p", "place").alias("place"))
        .withColumn("offset", F.coalesce(F.sum("length").over(here), F.lit(0).cast("long")))
        .select("row", "sequence_id", "offset")
    )
    return made.join(placed, "row").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, ids (binary) and n_tokens. A sequence has at most CAPACITY pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    return joined.select("sequence_id", F.expr("aggregate(parts, X'', (a, x) -> concat(a, x.ids))").alias("ids"), "n_tokens")
