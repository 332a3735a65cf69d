"""Byte-level BPE by corpus-level merge replay."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, chunks, keep

#: Distinct pieces of text whose ids a worker keeps; bounds memory, not results.
KEPT_PIECES = 250_000
#: Characters of text whose new pieces are replayed together.
REPLAY_CHARS = 4_000_000


class Merges:
    """The vocabulary of a rank file: which neighbouring ids merge, into which id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        # No merge has the key -1 and the rank -1, so look-ups need no bounds check.
        self.keys = np.array([*sorted(pairs), np.iinfo(np.int64).max], dtype=np.int64)
        self.ranks = np.array([pairs.get(int(k), -1) for k in self.keys], dtype=np.int64)

    @classmethod
    def load(cls, lines: bytes) -> Merges:
        """Of the bytes of a rank file."""
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, or -1; a right of -1 is the end of a piece."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], -1)


def replay(merges: Merges, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Apply every merge, in rank order, to all pieces at once.

    An inverted index has, for each merge that some pieces admit, the positions of its
    pairs. The lowest rank is taken from it, applied at all its positions, and only the
    pairs with the two neighbours of a merged position are looked up and entered anew.
    Returns the ids of all pieces in a row and where each piece's ids end.
    """
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(pieces) else 0
    ids = np.empty(n + 1, dtype=np.int64)
    ids[:n] = merges.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    ids[n] = -1
    after = np.arange(1, n + 2, dtype=np.int64)  # position n stands for the end of any piece
    before = np.arange(-1, n, dtype=np.int64)
    after[ends[sizes > 0] - 1] = n
    starts = (ends - sizes)[sizes > 0]
    before[starts] = n
    after[n] = before[n] = n
    alive = np.ones(n + 1, dtype=bool)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        if len(positions) <= 4:
            for p, r in zip(positions.tolist(), ranks.tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(np.array([p], dtype=np.int64))
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        heads = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for r, part in zip(ranks[heads].tolist(), np.split(positions, heads[1:])):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(part)

    every = np.arange(n, dtype=np.int64)
    ranks = merges.rank(ids[every], ids[after[every]])
    found = ranks >= 0
    enter(every[found], ranks[found])
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        nxt = after[at]
        # A pair may have gone since it was entered, by a merge of either half.
        good = alive[at] & (merges.rank(ids[at], ids[nxt]) == rank)
        at, nxt = at[good], nxt[good]
        if len(at) > 1 and (np.isin(nxt, at, assume_unique=True)).any():
            # Runs such as aaaa: from the left, every other pair of a chain merges.
            taken, free = np.ones(len(at), dtype=bool), -2
            for k, (p, q) in enumerate(zip(at.tolist(), nxt.tolist())):
                if p == free:
                    taken[k] = False
                    free = -2
                else:
                    free = q
            at, nxt = at[taken], nxt[taken]
        if not len(at):
            continue
        ids[at] = rank
        alive[nxt] = False
        far = after[nxt]
        after[at] = far
        before[far] = at
        after[n] = before[n] = n
        near = before[at]
        touched = np.concatenate([at, near[near < n]])
        ranks = merges.rank(ids[touched], ids[after[touched]])
        found = ranks >= 0
        if found.any():
            enter(touched[found], ranks[found])
    alive = alive[:n]
    counts = np.cumsum(alive)
    out_ends = np.where(ends > 0, counts[np.maximum(ends - 1, 0)], 0) if n else np.zeros(len(pieces), dtype=np.int64)
    return ids[:n][alive], out_ends


class Encoder:
    """Encodes texts by replaying merges over the distinct pieces of many texts at a time."""

    def __init__(self, path: str, read, pattern: str):
        """path names the rank file that read() gives."""
        self.merges, self.known = keep(("byte_bpe", path, pattern), lambda: (Merges.load(read()), Memo(KEPT_PIECES)))
        self.find = regex.compile(pattern).findall

    def _learn(self, new: list[str]) -> None:
        ids, ends = replay(self.merges, [x.encode() for x in new])
        raw = ids.astype("<u4").tobytes()
        start = 0
        for piece, end in zip(new, (ends * 4).tolist()):
            self.known.new[piece] = raw[start:end]
            start = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        for part in chunks(texts, REPLAY_CHARS):
            split = [self.find(t) for t in part]
            if new := self.known.missing({p for pieces in split for p in pieces}):
                self._learn(new)
            get = self.known.new.__getitem__
            for pieces in split:
                yield b"".join(map(get, pieces))

    def decode(self, raw: bytes) -> bytes:
        return b"".join(map(self.merges.bytes_of.__getitem__, np.frombuffer(raw, dtype="<u4").tolist()))


def sent(df: DataFrame, path: str):
    """The bytes of a rank file, which the driver reads, for all workers: one file, whatever the input."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row; a null text is empty and has no ids."""

    ranks = sent(documents, path)

    def run(batches):
        encoder = Encoder(path, lambda: ranks.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(encoder.encode(texts)), pa.binary())], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text (binary: the decoded bytes) of every row of ids; null ids decode to nothing."""

    ranks = sent(encoded, path)

    def run(batches):
        encoder = Encoder(path, lambda: ranks.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text binary")


def digest_texts(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode it again, in one pass, keeping digests.

    A row comes back per input row, repeated rows too, in no set order; a null or empty
    text has no tokens and the digests of nothing. Extra columns are ignored.
    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
    """

    ranks = sent(documents, path)

    def run(batches):
        encoder = Encoder(path, lambda: ranks.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for raw in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(raw) // 4)
                a.append(sha(raw).hexdigest())
                b.append(sha(encoder.decode(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
