"""Near-duplicate groups by SimHash fingerprints and a generalised pigeonhole search."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, few, row_keys, slices
from .components import components

BITS, SHINGLE, DISTANCE, SEED = 64, 4, 4, 42
#: Numbers of partitions that are weighed against each other, and the widest threshold a partition can get.
PARTITIONS, WIDEST = (2, 3, 4, 5), 2
#: Copies that edits have moved farther apart, at any distance: texts whose shingles of so many words have this Jaccard similarity.
WIDE_SHINGLE, WIDE_SIMILARITY = 5, 0.8
#: Texts are compared if in one of BANDS bands all of BAND_ROWS least hashes agree: at a similarity of 0.8 all but 7 pairs in ten thousand, at 0.9 all.
BANDS, BAND_ROWS = 24, 6
#: While more pairs than this for each text are left, one text of each bucket is compared with the rest before, as what that links needs no other pairs.
CROWD = 32
#: Texts of a block, of which two at a time are held to be compared.
BLOCK = 1_000
#: What a row that is dealt out costs, in pairs that are compared.
ROW_COST = 300.0
#: Buckets up to this size are compared together, larger ones each by itself, this many pairs at a time.
SMALL, PAIRS_AT_ONCE = 48, 2_000_000
#: Rows of a bucket above which it goes to many tasks, block against block, and how many such buckets are broadcast.
BUCKET, LARGE = 50_000, 100_000
#: Rows of sorted buckets that are held at once, besides the largest bucket.
ROWS_AT_ONCE = 200_000

# ---- fingerprints


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's shingles: words of A-Z in lower case, joined by a space, each occurrence counted."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, carry: tuple = ()) -> DataFrame:
    """doc_id and fingerprint (long) of every row, and columns that are carried along; a null text has no words and fingerprint 0."""
    others = ["doc_id", *carry]

    def run(batches):
        for batch in slices(batches):
            found = [fingerprint(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(np.array(found, np.uint64).view(np.int64))], names=[*others, "fp"])

    return documents.select("doc_id", "text", *others[1:]).mapInArrow(run, StructType([*(documents.schema[c] for c in others), StructField("fp", LongType())]))


# ---- which bits go together, and how far each partition is searched


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both set, over all of them."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fps)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, i].astype(np.int32)), pa.array(np.r_[-1, j].astype(np.int32)), pa.array(np.r_[n, total[i, j]].astype(np.int64))], names=["i", "j", "n"])

    rows = distinct.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # one row per pair of bits
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits to partitions of nearly equal size, correlated ones together: each grows by the bit nearest to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (len(free) + parts - k - 1) // (parts - k)
        rest = near[np.ix_(free, free)]
        first = free[int(rest.max(axis=1).argmax())]
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: near[b, group].mean())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def within(p: np.ndarray, most: int) -> np.ndarray:
    """The chance that two fingerprints differ in 0, 1, ... most of some bits, bit by bit set with chance p."""
    out = np.zeros(most + 1)
    out[0] = 1
    for q in 2 * p * (1 - p):
        out[1:] = out[1:] * (1 - q) + out[:-1] * q
        out[0] *= 1 - q
    return np.cumsum(out)


def allocate(costs: list[list[float]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Thresholds for the partitions with the least total cost, by dynamic programming.

    costs[i][t + 1] is the cost of searching partition i up to t differing bits, -1 standing
    for not at all. Any two fingerprints within the distance meet in some partition
    if the thresholds, each plus 1, sum to the distance plus 1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for extra, c in enumerate(row):
                s = spent + extra
                if s <= distance + 1 and (s not in then or cost + c < then[s][0]):
                    then[s] = (cost + c, [*chosen, extra - 1])
        best = then
    return best.get(distance + 1, (float("inf"), []))


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a partition, gathered into one number."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _meetings(distinct: DataFrame, groups: list[list[int]]) -> dict[int, float]:
    """For each partition, how many ordered pairs of fingerprints agree on it, itself included: exact, over all."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            parts, values, counts = [], [], []
            for k, bits in enumerate(groups):
                v, n = np.unique(_values(fps, bits), return_counts=True)
                parts.append(np.full(len(v), k, np.int32))
                values.append(v.view(np.int64))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (parts, values, counts)], names=["part", "value", "n"])

    rows = distinct.select("fp").mapInArrow(run, "part int, value long, n long")
    met = rows.groupBy("part", "value").agg(F.sum("n").cast("double").alias("n")).groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    return {r.part: r.pairs for r in met.collect()}  # a row per partition


def plan(distinct: DataFrame, distance: int = DISTANCE, partitions: tuple = PARTITIONS) -> list[tuple[list[int], int]]:
    """The partitions that are searched, each with its threshold, for the least estimated work."""
    n, both = bit_counts(distinct)
    if n < 2:
        return []
    p = np.diag(both) / n
    options = {m: group_bits(n, both, m) for m in partitions}
    flat = [g for m in partitions for g in options[m]]
    met = _meetings(distinct, flat)
    best, at = (float("inf"), []), 0
    for m in partitions:
        costs = []
        for bits in options[m]:
            chance = within(p[bits], WIDEST)
            agree = max(met[at] - n, 0.0) / 2
            row = [0.0]
            for t in range(WIDEST + 1):
                probes = sum(1 for k in range(t + 1) for _ in combinations(bits, k))
                row.append(n * probes * ROW_COST + max(agree, 1.0) * chance[t] / max(chance[0], 1e-12))
            costs.append(row)
            at += 1
        total, chosen = allocate(costs, distance)
        if total < best[0]:
            best = total, [(bits, t) for bits, t in zip(options[m], chosen) if t >= 0]
    return best[1]


# ---- probing and verifying


def _probes(distinct: DataFrame, searched: list[tuple[list[int], int]]) -> DataFrame:
    """part, value, probe, fp: each fingerprint in its own bucket of every partition, and as a probe in those nearby."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, (bits, t) in enumerate(searched):
                values = _values(fps, bits)
                for d in range(t + 1):
                    for flip in combinations(range(len(bits)), d):
                        mask = np.uint64(sum(1 << b for b in flip))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int32)), pa.array((values ^ mask).view(np.int64)), pa.array(np.full(len(fps), d > 0)), pa.array(fps.view(np.int64))], names=["part", "value", "probe", "fp"])

    return distinct.select("fp").mapInArrow(run, "part int, value long, probe boolean, fp long")


def _stars(fps: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups that a large bucket links, as edges to one member of each.

    Breadth first: a block of newly reached members is compared with those not yet
    reached, so what is linked densely takes few comparisons and memory stays bounded.
    """
    left = np.arange(len(fps))
    u, v = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        wave = np.array([root])
        while len(wave) and len(left):
            step = max(1, PAIRS_AT_ONCE // len(left))
            block, wave = wave[:step], wave[step:]
            near = np.bitwise_count(fps[block][:, None] ^ fps[left][None, :]) <= distance
            near &= ~(probe[block][:, None] & probe[left][None, :])  # two probes meet elsewhere, if at all
            hit = near.any(axis=0)
            if hit.any():
                found, left = left[hit], left[~hit]
                u.append(np.full(len(found), fps[root]))
                v.append(fps[found])
                wave = np.concatenate([wave, found])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(u), np.concatenate(v)) if u else (none, none)


def bucket_edges(key: np.ndarray, probe: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges, enough to connect what is linked, among rows whose buckets are numbered ascending by key."""
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[heads, len(key)])
    us, vs = [], []
    for head, size in zip(heads[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        u, v = _stars(fps[head : head + size], probe[head : head + size], distance)
        us.append(u)
        vs.append(v)
    small = np.repeat(sizes <= SMALL, sizes)
    key, probe, fps = key[small], probe[small], fps[small]
    for d in range(1, SMALL):
        if len(key) <= d:
            break
        at = np.flatnonzero(key[d:] == key[:-d])
        if not len(at):
            break
        near = (np.bitwise_count(fps[at] ^ fps[at + d]) <= distance) & ~(probe[at] & probe[at + d])
        us.append(fps[at[near]])
        vs.append(fps[at[near] + d])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def links(distinct: DataFrame, distance: int = DISTANCE, partitions: tuple = PARTITIONS) -> DataFrame:
    """Verified links between different fingerprints, u and v, enough of them to connect all that are within the distance."""
    searched = plan(distinct, distance, partitions)
    probes = _dealt(_probes(distinct, searched))

    def run(batches):
        held: list[list[np.ndarray]] = []

        def out(parts, values, cells, probe, fps):
            change = (parts[1:] != parts[:-1]) | (values[1:] != values[:-1]) | (cells[1:] != cells[:-1])
            u, v = bucket_edges(np.cumsum(np.r_[False, change]), probe, fps, distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            held.append([*c[:4], c[4].astype(np.int64).view(np.uint64)])
            n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                a = [np.concatenate(x) for x in zip(*held)]
                last = np.flatnonzero((a[0] != a[0][-1]) | (a[1] != a[1][-1]) | (a[2] != a[2][-1]))
                end = last[-1] + 1 if len(last) else 0  # the last bucket may go on
                if end:
                    yield out(*(x[:end] for x in a))
                held, n = [[x[end:] for x in a]], len(a[0]) - end
        if n:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    at = ["part", "value", "cell"]
    return probes.repartition(*at).sortWithinPartitions(*at).select(*at, "probe", "fp").mapInArrow(run, "u long, v long")


def _dealt(probes: DataFrame) -> DataFrame:
    """The probes with a cell: 0, but in large buckets, whose rows are dealt to blocks, and each block to a cell with every other and one by itself."""
    sizes = cut(probes.groupBy("part", "value").agg(F.ceil(F.count("*") / BUCKET).alias("blocks")).where("blocks > 1"))
    n = sizes.count()
    if not n:
        return probes.withColumn("cell", F.lit(0).cast("long"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.least(block, k) * F.col("blocks") + F.greatest(block, k))
    met = probes.join(F.broadcast(sizes) if n <= LARGE else sizes, ["part", "value"], "left")
    whole = F.array(F.lit(0).cast("long"))
    return met.withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(cells))).drop("blocks")


def _shingle_set(text: bytes) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    k = min(WIDE_SHINGLE, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype="<u8"))


_FACTORS = np.random.default_rng(SEED).integers(0, 2**64, (BANDS * BAND_ROWS, 2), np.uint64) | np.uint64(1)


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A number for each band: of its least hashes, under as many orders of the shingles, and the band itself."""
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2_000):
        mixed = shingles[at : at + 2_000].astype(np.uint64)[None, :] * _FACTORS[:, :1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _FACTORS[:, 1:]
        np.minimum(least, mixed.min(axis=1), out=least)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64)


def banded(documents: DataFrame, key: str) -> DataFrame:
    """key, size (different shingles) and bands of every text that has words."""

    def run(batches):
        for batch in slices(batches):
            keys, sizes, bands = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = _shingle_set(t or b"")
                if len(found):
                    keys.append(k)
                    sizes.append(len(found))
                    bands.append(_bands(found))
            values = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), values)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), lists], names=["key", "size", "bands"])

    return documents.select(key, "text").mapInArrow(run, "key long, size int, bands array<long>")


def _cell(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The similar ones of some pairs, by the sets of their texts: each text's shingles are marked once, and counted in its partners."""
    at = {k: i for i, k in enumerate(sets.column("key").to_pylist())}
    column = sets.column("set").combine_chunks()
    ends = column.offsets.to_numpy()
    _, ids = np.unique(column.values.to_numpy(zero_copy_only=False)[: ends[-1]], return_inverse=True)
    u = np.array([at[k] for k in pairs.column("u").to_pylist()], np.int64)
    v = np.array([at[k] for k in pairs.column("v").to_pylist()], np.int64)
    size, mark, good = np.diff(ends), np.zeros(len(ids) + 1, np.int64), np.zeros(len(u), bool)
    order = np.argsort(u, kind="stable")
    heads = np.flatnonzero(np.r_[True, u[order][1:] != u[order][:-1]]) if len(u) else []
    for some in np.split(order, heads[1:]) if len(u) else []:
        k = u[some[0]]
        mine = ids[ends[k] : ends[k + 1]]
        mark[mine] = 1
        for j in some:
            both = int(mark[ids[ends[v[j]] : ends[v[j] + 1]]].sum())
            good[j] = both >= WIDE_SIMILARITY * (size[k] + size[v[j]] - both)
        mark[mine] = 0
    return pairs.filter(pa.array(good)).select(["ru", "rv"]).rename_columns(["u", "v"])


def shingle_sets(documents: DataFrame, key: str) -> DataFrame:
    """key and set, the different shingles of each text, hashed and sorted."""

    def run(batches):
        for batch in slices(batches, 200):
            found = [_shingle_set(t or b"").view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], names=["key", "set"])

    return documents.select(key, "text").mapInArrow(run, "key long, set array<long>").dropDuplicates(["key"])


def similar_pairs(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs of texts (their keys u and v, and ru and rv) those that are similar by all their shingles, which known has: ru and rv, as u and v.

    Texts are dealt to blocks of about BLOCK, pairs to cells of two blocks, so a text goes to a cell once for all its pairs there.
    """
    some = cut(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct())
    blocks = some.count() // BLOCK + 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    dealt = cut(pairs.withColumn("cell", block("u") * blocks + block("v")))
    each = [dealt.select(F.col("cell").alias("place"), F.col(c).alias("key")).distinct() for c in ("u", "v")]
    places = each[0].union(each[1]).distinct()
    return dealt.groupBy("cell").cogroup(places.join(known, "key").groupBy("place")).applyInArrow(_cell, "u long, v long")


def wide_links(documents: DataFrame, rows: DataFrame, key: str, linked: DataFrame) -> DataFrame:
    """Links (u, v) between fingerprints that, with those given, connect all similar texts.

    Texts meet in a bucket for each band. Those that links connect already need not be
    compared; any others that meet are, by all their shingles, unless one has so many
    that no other text of any bucket shares that they cannot be similar. First one text of
    each bucket, the one with the least share of such shingles, is compared with the rest,
    so that what stands about one text takes as many pairs as texts; then, once, all that
    are still apart: no pair is given up.
    """
    of = rows.select(F.col(key).alias("key"), "fp").dropDuplicates(["key"])
    texts = cut(banded(documents, key).dropDuplicates(["key"]).join(of, "key"))
    n = texts.count()
    roots = cut(few(components(linked), n))
    root = F.coalesce("root", "fp").alias("root")
    each = texts.join(roots, texts.fp == roots.node, "left").select("key", root, F.posexplode("bands").alias("at", "value"))
    apart = lambda rows: rows.groupBy("value").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("value")
    shared = cut(few(each.select("key", "at", "value").join(apart(each), "value"), BANDS * n))
    rows_met = shared.count()
    # What few texts that share a bucket with others need is joined to them alone.
    met = cut(few(shared, rows_met).join(texts, "key").select("value", "key", "fp", "size", F.slice("bands", F.lit(1), F.col("at")).alias("before")))
    some = met.select("key").distinct()
    known = cut(shingle_sets(documents.join(some, documents[key] == some["key"], "left_semi"), key))
    lone = known.select("key", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    lone = lone.groupBy("key").agg(F.count("*").alias("lone"))
    # Of similar texts, what both have is at most what one does not have alone; so the other can have up to this many shingles.
    alone = F.coalesce("lone", F.lit(0))
    most = F.floor((F.col("size") - alone) / WIDE_SIMILARITY - alone + 1e-6)
    met = cut(met.join(lone, "key", "left").withColumn("most", most).withColumn("share", alone / F.col("size")).drop("lone").where(F.col("most") >= F.ceil(WIDE_SIMILARITY * F.col("size") - 1e-6)))
    more, last, turn = None, float("inf"), 0
    while True:
        named = met.join(roots, met.fp == roots.node, "left").select("value", "key", "size", "most", "share", "before", root)
        now = cut(few(named.join(apart(named), "value"), rows_met), anew=True)
        whole, total = False, rows_met
        if turn:
            per = now.groupBy("value", "root").agg(F.count("*").alias("n")).groupBy("value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
            total = per.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0
            whole = total <= CROWD * n or total > 0.7 * last
            last = total
        side = lambda rows, k: rows.select("value", F.col("key").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("size", "most", "before", "root")))
        first = now if whole else now.groupBy("value").agg(F.min_by(F.struct("key", "size", "most", "before", "root"), F.struct(F.col("share") if not turn else F.lit(0), F.xxhash64("key", F.lit(turn)))).alias("one")).select("value", "one.*")
        may = (F.col("size_v") <= F.col("most_u")) & (F.col("size_u") <= F.col("most_v")) & (F.least("size_u", "size_v") >= WIDE_SIMILARITY * F.greatest("size_u", "size_v"))
        once = F.col("root_u") < F.col("root_v") if whole else F.col("root_u") != F.col("root_v")
        # A pair comes from the first band in which it meets; one that stands for a bucket may come from several.
        fresh = ~F.arrays_overlap("before_u", "before_v") if whole else F.lit(True)
        pairs = side(first, "u").join(side(now, "v"), "value").where(once & may & fresh).select("u", "v", F.col("root_u").alias("ru"), F.col("root_v").alias("rv"))
        found = cut(few(similar_pairs(known, cut(few(pairs if whole else pairs.distinct(), total, 200_000))).distinct(), rows_met))
        more = found if more is None else cut(few(more.union(found), rows_met), anew=True)
        if whole:
            return more
        roots = cut(few(components(linked.union(more)), n), anew=True)
        turn += 1


def _groups(documents: DataFrame, distance: int, carry: tuple = (), wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """Each row's fingerprint, and the group and its smallest doc_id of each fingerprint."""
    rows = cut(fingerprints(documents, carry))
    n = rows.count()
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = cut(links(distinct, distance))
    if wide:
        linked = cut(linked.union(wide_links(documents, rows, carry[0], linked)))
    roots = cut(few(components(linked), n))
    named = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least")
    least = cut(few(named.groupBy("root").agg(F.min("least").alias("component_id")), n))
    groups = cut(few(named.join(least, "root").select("fp", "root", "component_id"), n))
    found = F.col("root").isNotNull()
    each = distinct.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(found, F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return rows, cut(few(each, n))


def near_duplicates(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The fingerprint and the group of every document.

    Copies share a fingerprint and are one node; nodes within the distance are linked,
    and a group is all that links reach. A text without words (null, empty) has
    fingerprint 0, linked like any other. A null doc_id never names a group that has
    another; repeated rows each come back. Extra columns are ignored.
    Returns doc_id, fingerprint (16 hex digits) and component_id, the group's smallest doc_id.
    """
    rows, each = _groups(documents, distance)
    return rows.join(each, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(documents: DataFrame, distance: int = DISTANCE, wide: bool = True) -> DataFrame:
    """The documents without all but one of each group: the one with the smallest doc_id stays, a null one last. All columns stay as they are.

    A group holds what near_duplicates links and, unless wide is false, copies at any distance
    whose shingles of WIDE_SHINGLE words have a similarity of WIDE_SIMILARITY or more.
    """
    names = documents.columns
    key, also = row_keys("doc_id", "text")
    keyed = documents.select("*", key.alias("__key"), also.alias("__also"))
    rows, each = _groups(keyed, distance, ("__key", "__also"), wide)
    this = F.struct("__key", "__also")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", this)
    crowd = cut(rows.join(each, "fp").select("root", "doc_id", "__key", "__also"))
    first = cut(crowd.groupBy("root").agg(F.min_by(this, order).alias("__first"), F.count("*").alias("n")).where("n > 1"))
    met = cut(crowd.join(first, "root").select("__key", "__also", "__first", "root"))
    stays = this == F.col("__first")
    gone = met.where(~stays).select(F.col("__key").alias("__gone"), F.col("__also").alias("__too")).distinct()
    left = keyed.join(gone, (F.col("__key") == F.col("__gone")) & (F.col("__also") == F.col("__too")), "left_anti")
    again = met.where(stays).groupBy("__key", "__also").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():  # rows repeated under one doc_id
        left = left.dropDuplicates(["__key", "__also"])
    return left.select(*names)
