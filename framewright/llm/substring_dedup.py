"""Substring deduplication by prefix-partitioned suffix trees.

A suffix is the text of a document from one of its words on; what matters of it is its
first WINDOW words. Its partition is a prefix of it of variable length: the words up to
the end of its anchor, the gram of GRAM words with the least hash among those that lie
within the window. Suffixes with equal windows have equal anchors at equal places, so
they meet in one partition. How often each anchor occurs is counted first: partitions
whose anchor occurs once hold no repeat and are dropped before any text moves; those too
large for memory get the longest prefix, the whole window, under which each partition is
a single node. In every other partition a tree is built as a sorted suffix array with
common prefix lengths, and its internal nodes of WINDOW words or deeper are the repeats.
Hashes only say which suffixes meet: words themselves decide which are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, keep, row_keys, slices

WINDOW, GRAM = 35, 8
#: Suffix groups of an anchor above which its suffixes are split by their whole window.
TREE_ROWS = 5_000
#: Rows of sorted partitions that are held at once, and suffixes that are sorted at once.
ROWS_AT_ONCE, SUFFIXES_AT_ONCE = 20_000, 100_000
#: Words whose hashes a worker keeps, and entries of a task's table of what it has sent.
KEPT_WORDS, KEPT_SENT = 250_000, 50_000

#: A place is one number: the first of its windows, how far into it the anchor is, and how many windows it has.
PLACE_BITS = 6

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _word_hashes(text: bytes) -> np.ndarray:
    known = keep(("hashes",), _WordHash)
    words = text.split()
    if len(known) > KEPT_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL
    return x ^ (x >> np.uint64(29))


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, by doubling."""
    out, have, power = h, 1, _BASE
    done = {1: (h, _BASE)}
    while have * 2 <= size:
        out = out[: len(out) - have] * power + out[have:]
        power = power * power
        have *= 2
        done[have] = (out, power)
    while have < size:
        step = max(k for k in done if k <= size - have)
        tail, p = done[step]
        n = len(h) - have - step + 1
        out = out[:n] * p + tail[have : have + n]
        have += step
    return _mix(out)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a document's windows: their grams, their places, and the first and the end of the windows of each."""
    with np.errstate(over="ignore"):
        grams = _rolling(h, GRAM)
    width = WINDOW - GRAM + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    places = at[first]
    return grams[places], places, first, np.r_[first[1:], len(at)]


def unplace(place: int) -> tuple[int, int, int]:
    """The first window of a place, how far into it its anchor is, and how many windows it has."""
    low = (1 << PLACE_BITS) - 1
    return place >> 2 * PLACE_BITS, place >> PLACE_BITS & low, place & low


def _anchor_rows(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            found = []
            for text, key, also in zip(batch.column(0).cast(pa.binary()).to_pylist(), *(batch.column(k).to_pylist() for k in (1, 2))):
                h = _word_hashes(text or b"")
                if len(h) >= WINDOW:
                    grams, places, first, end = anchors(h)
                    place = (first << PLACE_BITS | places - first) << PLACE_BITS | end - first
                    found.append((grams.view(np.int64), np.full(len(grams), key, np.int64), np.full(len(grams), also, np.int64), place))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["gram", "key", "also", "place"])

    return rows.mapInArrow(run, "gram long, key long, also long, place long")


def candidates(rows: DataFrame) -> DataFrame:
    """Per document (__at, __and), the places of its anchors that occur elsewhere too: twice the place, plus 1 for a crowded anchor, and the anchor."""
    found = cut(_anchor_rows(rows))
    often = cut(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > TREE_ROWS).cast("long").alias("crowd")))
    # Both sides are exchanged for this join alone, so AQE splits an anchor that very many documents hold.
    met = found.join(often, "gram").select("key", "also", F.struct((F.col("place") * 2 + F.col("crowd")).alias("place"), "gram").alias("place"))
    return met.groupBy(F.col("key").alias("__at"), F.col("also").alias("__and")).agg(F.collect_set("place").alias("__places"))  # at most a document's words


SUFFIX = "part long, key long, also long, place long, words binary, sure boolean"


def _suffixes(joined: DataFrame) -> DataFrame:
    """The suffixes whose anchors are shared, dealt by their prefixes; see SUFFIX.

    A row has the windows of a place, and the words they span; for a crowded anchor, a
    single window. Of rows that are alike a task sends one: the others are sure to be
    repeats and come with no words, dealt evenly.
    """

    def run(batches):
        sent: dict = {}

        def one(part, key, also, place, words, out):
            alike = part, place & _SHAPE, words
            known = sent.get(alike)
            if known is None:
                sent[alike] = [key, also, place, False]
                out.append((part, key, also, place, words, False))
            else:
                out.append((key ^ place, key, also, place, None, True))
                if not known[3]:
                    known[3] = True
                    out.append((known[0] ^ known[2], *known[:3], None, True))

        for batch in slices(batches):
            out: list = []
            names = batch.schema.names
            columns = (batch.column(names.index(c)) for c in ("__text", "__key", "__also", "__places"))
            for text, key, also, places in zip(*(c.to_pylist() for c in columns)):
                words = text.split()
                whole = None
                for found in places:
                    place, crowded = found["place"] >> 1, found["place"] & 1
                    start, at, n = unplace(place)
                    if crowded:
                        if whole is None:
                            with np.errstate(over="ignore"):
                                whole = _rolling(_word_hashes(text), WINDOW).view(np.int64)
                        for w in range(start, start + n):
                            one(int(whole[w]), key, also, (w << PLACE_BITS) << PLACE_BITS | 1, b" ".join(words[w : w + WINDOW]), out)
                    else:
                        one(found["gram"], key, also, place, b" ".join(words[start : start + n - 1 + WINDOW]), out)
            if len(sent) > KEPT_SENT:
                sent.clear()
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["part", "key", "also", "place", "words", "sure"])

    return joined.mapInArrow(run, SUFFIX)


#: What of a place says how its windows lie about the anchor.
_SHAPE = (1 << 2 * PLACE_BITS) - 1


def deep_nodes(parts: list[int], into: list[int], words: list[bytes]) -> list[np.ndarray]:
    """For each row of a partition, which of its suffixes lie below an internal node of WINDOW words or more.

    Rows come in order of their partition. Words are numbered as they come, each different
    one anew. A suffix becomes its partition's number, its anchor's place and its words;
    sorted, those below one node are neighbours whose common prefix has WINDOW words.
    """
    number: dict = {}
    new = number.setdefault
    split = [[new(w, len(number)) for w in x.split()] for x in words]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    counts = sizes - (WINDOW - 1)
    total = int(counts.sum())
    spans = np.concatenate([np.array(x, np.uint32) for x in split])
    row = np.repeat(np.arange(len(words)), counts)
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.cumsum(sizes) - sizes
    matrix = np.empty((total, WINDOW + 2), dtype=">u4")
    matrix[:, 0] = np.cumsum(np.r_[False, np.diff(np.array(parts, np.int64)) != 0])[row]
    matrix[:, 1] = np.array(into, np.int64)[row] - within  # how far into the suffix its anchor is
    matrix[:, 2:] = np.lib.stride_tricks.sliding_window_view(spans, WINDOW)[starts[row] + within]
    order = np.argsort(matrix.view(f"S{4 * (WINDOW + 2)}").ravel(), kind="stable")
    ranked = matrix[order]
    same = (ranked[1:] == ranked[:-1]).all(axis=1)  # a common prefix of WINDOW words
    deep = np.zeros(total, bool)
    deep[order] = np.r_[same, False] | np.r_[False, same]
    return np.split(deep, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def repeats(suffixes: DataFrame) -> DataFrame:
    """key, also, start, n: runs of n windows, from start on, that occur elsewhere too."""

    def decide(rows: list[tuple]) -> list[tuple]:
        """Rows of whole partitions, in order."""
        out, trees = [], []
        alike: dict = {}
        for part, key, also, place, words, sure in rows:
            if sure:
                start, _, n = unplace(place)
                out.append((key, also, start, n))
            else:
                alike.setdefault((part, place & _SHAPE, words), []).append((key, also, place >> 2 * PLACE_BITS))
        for (part, shape, words), members in alike.items():
            _, at, n = unplace(shape)
            if len(members) > 1:
                out += [(*m, n) for m in members]
            trees.append((part, at, words, n, members))
        size, some = 0, []
        for k, tree in enumerate(trees):
            some.append(tree)
            size += tree[3]
            if k + 1 == len(trees) or (size >= SUFFIXES_AT_ONCE and trees[k + 1][0] != tree[0]):
                if len(some) > 1:
                    parts, into, words, _, _ = zip(*some)
                    for (*_, members), flags in zip(some, deep_nodes(parts, into, words)):
                        if len(members) == 1:
                            key, also, start = members[0]
                            out += [(key, also, start + a, n) for a, n in _runs(flags)]
                size, some = 0, []
        return out

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= ROWS_AT_ONCE:
                end = len(held)
                while end and held[end - 1][0] == held[-1][0]:  # the last partition may go on
                    end -= 1
                if end:
                    yield emit(decide(held[:end]))
                    held = held[end:]
        if held:
            yield emit(decide(held))

    def emit(out: list[tuple]):
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "also", "start", "n"])

    return suffixes.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, also long, start int, n int")


def substring_dedup(documents: DataFrame, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Remove every word that a window of WINDOW words covers whose words also start anywhere else.

    Windows are judged on the input: each place of a repeat goes, in the same document
    too. Texts with fewer words than a window keep all; a null text has no words and
    becomes empty. Repeated rows count as different places. Other columns come back as
    they are, but for columns named as ``counts``, which are replaced.
    Returns the columns of documents with text as its kept words, joined by one space,
    and how many words it had and lost (long), named as ``counts``.
    """
    kept = documents.drop(*counts)
    key, also = row_keys("doc_id", "text")
    keyed = kept.select("*", key.alias("__key"), also.alias("__also"), F.coalesce("text", F.lit("")).cast("binary").alias("__text")).drop("text")
    places = cut(candidates(keyed.select("__text", "__key", "__also")))
    same = lambda other: (keyed["__key"] == other["__at"]) & (keyed["__also"] == other["__and"])
    joined = keyed.join(places, same(places)).drop("__at", "__and")
    spans = repeats(_suffixes(joined)).groupBy(F.col("key").alias("__at"), F.col("also").alias("__and")).agg(F.collect_set(F.struct("start", "n")).alias("__spans"))
    # The texts' exchange by key is the one of the join above, used again.
    both = keyed.join(spans, same(spans), "left").drop("__at", "__and", "__key", "__also")
    names = kept.columns

    def run(batches):
        for batch in slices(batches):
            texts, n, removed = [], [], []
            for text, runs in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist()):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in runs or ():
                    gone[r["start"]] += 1
                    gone[r["start"] + r["n"] - 1 + WINDOW] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                left = [words[k] for k in np.flatnonzero(stay).tolist()] if runs else words
                texts.append(b" ".join(left).decode())
                n.append(len(words))
                removed.append(len(words) - len(left))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*names, *counts])

    fields = [StructField("text", StringType()) if f.name == "text" else f for f in kept.schema.fields]
    return both.mapInArrow(run, StructType([*fields, *(StructField(c, LongType()) for c in counts)]))


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row, as substring_dedup has them; extra columns are ignored."""
    done = substring_dedup(documents.select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
