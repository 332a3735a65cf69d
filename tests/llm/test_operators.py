import base64
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import byte_bpe, components, exact_dedup, html_text, licenses, packing, quality_rules, sharding, simhash, substring_dedup, toxicity

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, words string, count long, class string"
LONG = "lorem ipsum dolor " * 30_000


def table(spark, rows):
    """Documents with extra columns whose names clash with those that operators use."""
    full = [(d, t, "en", s, len(t or ""), "x", 1, "y", 2, "z") for d, s, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(1)
    passages = [" ".join(rng.choice("xyz") for _ in range(rng.randint(3, 90))) for _ in range(12)]
    rows = [(i, f"s{i % 3}", "\n".join(rng.choice(passages) if rng.random() < 0.6 else " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 70))) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    rows += [rows[3], rows[3], (7, "s0", rows[3][2]), (200, None, None), (201, "s1", ""), (None, "s1", "null id " * 60), (None, "s1", "NULL ID " * 60), (202, "s1", LONG), (203, "s2", LONG), (204, "s2", "É é Straße ÀB   x\x1cy " * 20), (205, "s2", "é É straße Àb   x\x1cy " * 20)]
    return rows


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_exact_dedup(spark, odd):
    got = exact_dedup.exact_dedup(table(spark, odd)).collect()
    by = defaultdict(list)
    for d, _, t in odd:
        by[brute.lower(t)].append(d)
    want = Counter()
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((d, keep, len(ids), brute.sha(t)) for d in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(by)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_copies(spark, odd):
    docs = table(spark, odd)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    texts = [brute.lower(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({brute.lower(t) for _, _, t in odd})


def test_tree_merge_rounds(spark):
    rows = spark.range(0, 4000, 1, 40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 700).cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(rows).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got}[True] == len({"hot" if i % 3 == 0 else str(i % 700) for i in range(4000)})


@pytest.mark.parametrize("limits", [(2, 0.02), (50, 0.02), (0, 0.3)])
def test_quality_rules(spark, odd, limits):
    got = quality_rules.quality_rules(table(spark, odd), *limits)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept"]
    assert rows_of(got, *names) == sorted(brute.quality([(d, s, t) for d, s, t in odd], *limits), key=repr)


def test_repeats_under_one_hash(spark):
    """Windows whose hashes share all bits that are kept: A B A, A B, and both among others."""
    texts = ["a3430799 b c p1 p2 p3 a3824771 b c p4 p5 p6 a3430799 b c", "a3430799 b c p1 p2 p3 a3824771 b c", "x y z a3430799 b c x y z p a3824771 b c q a3430799 b c"]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_rules(table(spark, [(k, "s", t) for k, t in enumerate(texts)])).collect()}
    assert got == {0: 6, 1: 0, 2: 12}


def test_simhash(spark, odd):
    got = simhash.near_duplicates(table(spark, odd))
    fps = [brute.fingerprint(t) for _, _, t in odd]
    want = brute.groups([d for d, _, _ in odd], fps)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == sorted(((d, f"{f:016x}", c) for (d, _, _), f, c in zip(odd, fps, want)), key=repr)


@pytest.mark.parametrize("spread", [3, 64])
def test_simhash_links_all(spark, spread):
    """Dense and sparse fingerprints, a large bucket among them: components as by comparing all pairs."""
    rng = np.random.default_rng(spread)
    centers = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set()
    for k in range(1500):
        x = int(centers[min(k % 40, 11)])
        for b in rng.integers(0, 64, rng.integers(0, spread)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(df).collect()]
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    want = brute.groups(fps, fps)
    got = defaultdict(list)
    for f in fps:
        got[find(f)].append(f)
    assert {f: min(got[find(f)]) for f in fps} == dict(zip(fps, want))


def test_large_buckets_in_blocks(spark, monkeypatch):
    """Buckets that are dealt to many tasks link what whole ones do."""
    rng = np.random.default_rng(12)
    centre = int(rng.integers(0, 2**63))
    fps = sorted({centre ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 7)))) for _ in range(700)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    want = brute.groups(fps, fps)
    for bucket in (40, 50_000):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found = {r.node % 2**64: r.root for r in components.components(simhash.links(df)).collect()}
        groups = defaultdict(set)
        for f in fps:
            groups[found.get(f, f)].add(f)
        assert sorted(map(min, groups.values())) == sorted(set(want)) and sorted(map(len, groups.values())) == sorted(Counter(want).values())


def test_allocate_covers_every_distance():
    cost, thresholds = simhash.allocate([[0, 1, 5, 50], [0, 2, 3, 9], [0, 10, 30, 90]])
    assert sum(t + 1 for t in thresholds) == simhash.DISTANCE + 1 and cost == 5 + 9


def test_wide_copies(spark):
    rng = random.Random(6)
    docs, similar = [], {}
    for k in range(60):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        docs.append((10 * k, "s", " ".join(w)))
        for j in range(1, 3):
            x = w[:]
            for _ in range(j * 4):
                x[rng.randrange(200)] = "changed"
            docs.append((10 * k + j, "s", " ".join(x)))
    sets = {d: set(simhash._shingle_set(t.encode()).tolist()) for d, _, t in docs}
    left = {r.doc_id for r in simhash.drop_near_copies(table(spark, docs)).collect()}
    narrow = {r.doc_id for r in simhash.drop_near_copies(table(spark, docs), wide=False).collect()}
    assert left <= narrow and {10 * k for k in range(60)} <= left
    fps = {d: brute.fingerprint(t) for d, _, t in docs}
    for d in narrow - left:
        first = d // 10 * 10
        assert any(len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) for e in range(first, d))
    for d in left - {10 * k for k in range(60)}:
        for e in range(d // 10 * 10, d):
            assert (fps[d] ^ fps[e]).bit_count() > 4 and len(sets[d] & sets[e]) < 0.8 * len(sets[d] | sets[e])


@pytest.mark.parametrize("crowd", [0, 32])
def test_wide_pairs_are_whole(spark, crowd, monkeypatch):
    """Long texts about the threshold, in crowds and at any distance: groups are those of all exact similarities."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(11)
    docs = []
    for k in range(4):
        w = [f"w{rng.randint(0, 9000)}" for _ in range(600)]
        for _ in range(30):
            x = w[:]
            for _ in range(rng.randint(0, 26)):
                x[rng.randrange(600)] = f"c{rng.randint(0, 9000)}"
            docs.append((len(docs), "s", " ".join(x)))
    sets = [set(simhash._shingle_set(t.encode()).tolist()) for _, _, t in docs]
    fps = [brute.fingerprint(t) for _, _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 4 or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 4 < len(set(root)) < 100
    assert {r.doc_id for r in simhash.drop_near_copies(table(spark, docs)).collect()} == set(root)


def test_wide_pairs_beyond_the_search(spark):
    """Similar texts whose fingerprints are more than 12 bits apart are copies too."""
    rng, docs = random.Random(3), []
    while len(docs) < 10:
        w = [f"w{rng.randint(0, 9000)}" for _ in range(60)]
        x = [*w[:-6], *(f"c{rng.randint(0, 9000)}" for _ in range(6))]
        a, b = (set(simhash._shingle_set(" ".join(t).encode()).tolist()) for t in (w, x))
        if len(a & b) >= 0.8 * len(a | b) and (brute.fingerprint(" ".join(w)) ^ brute.fingerprint(" ".join(x))).bit_count() > 12:
            docs += [(len(docs), "s", " ".join(w)), (len(docs) + 1, "s", " ".join(x))]
    assert {r.doc_id for r in simhash.drop_near_copies(table(spark, docs)).collect()} == {0, 2, 4, 6, 8}


def test_drop_near_copies(spark, odd):
    left = simhash.drop_near_copies(table(spark, odd), wide=False)
    ids = [d for d, _, _ in odd]
    want = Counter(brute.groups(ids, [brute.fingerprint(t) for _, _, t in odd]))
    assert Counter(r.doc_id for r in left.collect()) == Counter(want.keys())


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 180)] + [(0, k) for k in range(1, 40)] + [(500, 500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{k: 0 for k in range(40)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("tree_rows", [3, 5000])
def test_substring_dedup(spark, odd, tree_rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TREE_ROWS", tree_rows)
    got = substring_dedup.substring_dedup(table(spark, odd))
    want = brute.substrings([(d, t) for d, _, t in odd])
    assert rows_of(got, "doc_id", "n_words", "n_removed", "text", "key") == sorted(((d, n, r, t, 1) for d, n, r, t in want), key=repr)


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90).map(" ".join), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_anchors_agree(texts):
    """Equal windows have equal anchors at equal places."""
    seen = {}
    for t in texts:
        h = substring_dedup._word_hashes(t.encode())
        if len(h) < 35:
            continue
        _, places, first, end = substring_dedup.anchors(h)
        for p, a, b in zip(places, first, end):
            for s in range(a, b):
                assert s <= p <= s + 35 - substring_dedup.GRAM
                assert seen.setdefault(tuple(h[s : s + 35]), p - s) == p - s


def test_packing(spark, odd):
    path = P.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rows = [r for r in odd if r[0] is not None and r[0] != 3 and r[0] != 7]
    packed = packing.harmonic_pack(table(spark, rows), path, with_ids=True)
    got = packed.collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, _, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by_doc[d], key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == ids.tobytes()
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 for r in parts)
        assert [r.start for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
    assert sorted(by_seq) == list(range(len(by_seq)))
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) <= packing.CAPACITY
    assert sum(r.length for r in got) / (len(by_seq) * packing.CAPACITY) > 0.9
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(whole[k] == b"".join(r.ids for r in v) for k, v in by_seq.items())


@given(st.integers(1, 40_000))
def test_cuts(n):
    parts = packing.cuts(n)
    assert sum(length for length, _ in parts) == n
    assert all(0 < length <= packing.CAPACITY // j and j in packing.CLASSES for length, j in parts)


@given(st.lists(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "A", "b's", " ", "endoftext", "é"]), max_size=8).map("".join)), max_size=8))
@settings(max_examples=90, deadline=None)
def test_word_ids(texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = list(packing.WordEncoder.of(path, lambda: open(path, encoding='utf-8').read()).encode([t.encode() for t in texts]))
    assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_replay(tiktoken_encoding):
    encoder = byte_bpe.Encoder("ranks", lambda: open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)

    @given(st.lists(st.one_of(st.text(max_size=200), st.text("aeths 'n\n", max_size=200)), max_size=6))
    @settings(max_examples=80, deadline=None)
    def check(texts):
        for t, raw in zip(texts, encoder.encode(texts)):
            assert raw == np.array(tiktoken_encoding.encode_ordinary(t), "<u4").tobytes()
            assert encoder.decode(raw) == t.encode()

    check()


def test_byte_bpe_query(spark, odd, tiktoken_encoding):
    path = P.path("byte_bpe_50k.tiktoken")
    docs = table(spark, odd)
    got = rows_of(byte_bpe.digest_texts(docs, path, P.PATTERN), "doc_id", "n_tokens", "decoded_sha256")
    assert got == sorted(((d, len(tiktoken_encoding.encode_ordinary(t or "")), brute.sha(t or "")) for d, _, t in odd), key=repr)
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, path, P.PATTERN), path, P.PATTERN)
    assert sorted(bytes(r.text) for r in back.collect()) == sorted((t or "").encode() for _, _, t in odd)


def test_sharding(spark, odd, tmp_path):
    long = sharding.shard(table(spark, odd), 8)[0].collect()
    assert len(long) == len(odd) and {r["size"] for r in long} == {len((t or "").encode()) + 1 for _, _, t in odd}
    short = [r for r in odd if r[2] != LONG]
    docs = table(spark, short + [(1000 + i, "s", f"text {i} " * (i % 9)) for i in range(3000)])
    rows, path = sharding.shard(docs, 8, grow_to=9, path=f"{tmp_path}/map")
    got = rows.collect()
    assert len(got) == len(short) + 3000 and path == f"{tmp_path}/map"
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    first, second = ({(r.vslot, r.piece): r for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    assert first.keys() == second.keys() and {r.version for r in sharding.load_map(spark, path).collect()} == {2}
    assert 0 < sum(r.bytes for k, r in first.items() if r.shard != second[k].shard) < sum(r.bytes for r in first.values()) / 2
    assert all(r.shard in range(9) for r in second.values())
    again = sharding.edit_map(spark, path, 8)
    assert again == 3 and {r.shard for r in sharding.load_map(spark, path).collect()} <= set(range(8))


def test_sharding_does_not_depend_on_partitions(spark, odd):
    where = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard, r["size"]) for r in sharding.shard(df)[0].collect())
    docs = table(spark, odd + [(1000 + i, "s", "one text of many" if i % 3 else f"text {i}") for i in range(900)])
    assert where(docs.repartition(2)) == where(docs.orderBy(F.desc("doc_id")).repartition(7))


def test_sharding_hot_and_balance(spark):
    docs = spark.range(0, 6000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + F.col("id") % 50))).alias("text"))
    got = sharding.shard(docs)[0].collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert len(size) == 8 and max(size.values()) < 1.02 * min(size.values())
    assert len({r.shard for r in got if r["size"] == 1}) == 1  # many short copies fit one shard


def test_words_decide_not_their_hashes(spark):
    """Words whose hashes share 32 bits, and suffixes of one partition that differ in a word, are no repeats."""
    tails = [" ".join(f"t{k}w{j}" for j in range(34)) for k in range(6)]
    docs = table(spark, [(2 * k + j, "s", f"{w} {t}") for k, t in enumerate(tails) for j, w in enumerate(("q27495", "q97008"))])
    assert all(r.n_removed == 0 for r in substring_dedup.substring_dedup(docs).collect())
    assert [[f.tolist() for f in substring_dedup.deep_nodes([1, 1, 2], [3, 3, 3], [b"a " * 34 + x for x in (b"b", b"c", b"b")])]] == [[[False], [False], [False]]]


def test_row_keys_tell_nulls_apart(spark):
    rows = spark.createDataFrame([(5, None), (None, "5"), (5, "5"), (None, None)], "doc_id long, text string")
    assert rows.select(*substring_dedup.row_keys("doc_id", "text")).distinct().count() == 4


def test_toxicity(spark):
    rng = random.Random(3)
    calm = ["".join(rng.choice("bcdfglmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        w = [rng.choice(calm) for _ in range(rng.randint(20, 200))]
        for _ in range(max(2, len(w) // 40) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["grozzle", "skrabbit" + rng.choice(calm)])
        docs.append((i, "s", " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs += [(5000, "s", None), (5001, "s", ""), (None, "s", "abc"), docs[0]]
    labels += [(None, 1, 1), (9999, 0, 0), (12, 1, None)]
    got = toxicity.toxicity(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert {r.doc_id for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in held]) > 0.97


def test_toxicity_without_examples(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, [(1, "s", "a b"), (2, "s", None)]), labels).collect()
    assert [r.predicted for r in got] == [0, 0]


def test_html(spark):
    art = "<h1>The title</h1><p>First long paragraph of text, with &amp; and &eacute; in it.<p>Second <b>one</b>\n\t here goes on for a while.</p>"
    menu = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
    page = f"<!DOCTYPE html><html><head><title>x</title><script>var a='</p>';</script></head><body>{menu}<div class='ad'>Buy this now, very cheap indeed.</div><article>{art}</article><div id=comments><p>First! Nice post, I did like it so much.</p></div><footer>&copy; all of us, for ever and ever</footer></body></html>"
    want = "The title\nFirst long paragraph of text, with & and é in it.\nSecond one here goes on for a while."
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", page.replace("<article>", "<div class='post-content'>").replace("</article>", "</div>")), (5, "u", page[: page.index("First long") + 30]), (1, "u", page), (6, None, "<p>" * 5000)]
    got = {r.page_id: r for r in html_text.extract_main_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == want and got[1].n_chars == len(want) and got[4].text == want
    assert got[2].text == got[3].text == got[6].text == "" and got[2].n_chars == 0
    assert got[5].text == "The title\n" + "First long paragraph of text, with & and é"[:30].strip()


@given(st.lists(st.floats(-5, 5), max_size=40))
def test_best_region(scores):
    a, b = html_text.best_region(scores)
    best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert abs(sum(scores[a:b]) - best) < 1e-9


def test_html_held_out():
    """Weights from some labelled pages find the main text of others."""
    weights = html_text.fit(html_text.labelled_pages())
    right = total = 0
    for page in html_text.labelled_pages(120, seed=99):
        main = "".join(re.findall(r"<!--main-->(.*?)<!--/main-->", page, re.S))
        want = Counter(re.sub(r"<[^>]*>", " ", main).split())
        got = Counter(html_text.extract(page, weights).split())
        right += 2 * sum((want & got).values())
        total += sum(want.values()) + sum(got.values())
    assert right / total > 0.95


def brute_license(rows):
    """By cosine against every template, over all words, of every line and paragraph, without an index or a bound."""
    import math

    n = len(rows)
    df = Counter(w for _, t in rows for w in set(licenses.words(t or "")))

    def vec(ws):
        v = {w: k * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    temps = [(name, vec(t)) for name, t in licenses.templates()]

    def best(ws):
        v = vec(ws)
        found = [(sum(x * t.get(w, 0) for w, x in v.items()), name) for name, t in temps]
        top = max(found)[0]
        return round(top, 9), {name for x, name in found if x > top * (1 - 1e-9)}

    own = []
    for p, t in rows:
        size, scores, total = Counter(), {}, 0

        def hit(ws):
            score, names = best(ws)
            return (len(ws), score, names) if score >= licenses.LEAST else None

        paragraphs, para = [], []
        for x in [*(licenses.words(x) for x in (t or "").split("\n")), []]:
            total += len(x)
            if x:
                para.append(x)
            elif para:
                paragraphs.append(para)
                para = []
        each, scored = [], []
        for para in paragraphs:
            lines = [h for x in para if (h := hit(x))]
            whole = hit([w for x in para for w in x]) if len(para) > 1 else None
            scored += lines + [whole] * bool(whole)
            each += [whole] if whole else lines
        if re.match(licenses.NAMED, (p or "").rpartition("/")[2]) and (whole := hit([w for para in paragraphs for x in para for w in x])):
            each = [whole]
            scored.append(whole)
        for k, score, names in each:
            for name in names:
                size[name] += k
                scores[name] = max(score, scores.get(name, 0))
        own.append((min(size, key=lambda x: (-size[x], -scores[x], x)), max(s for _, s, _ in scored), sum(k for k, _, _ in each) / total) if size else (None, 0, 0))
    return own


def test_licenses(spark):
    rng = random.Random(2)
    noise = [f"word{k} of the and text this is a" for k in range(50)]
    rows = []
    for k in range(120):
        lines = [rng.choice(noise) for _ in range(rng.randint(14, 20))]
        if rng.random() < 0.3:
            name = rng.choice(list(licenses.TEMPLATES))
            notice = rng.choice(licenses.TEMPLATES[name])
            half = notice.split(" ")
            lines.insert(rng.randint(0, len(lines)), notice + " été" * (rng.random() < 0.3) if rng.random() < 0.6 else " ".join(half[: len(half) // 2]) + "\n" + " ".join(half[len(half) // 2 :]))
        rows.append((f"repo{k % 3}/src/{k % 5}/f{k}.txt", "\n".join(lines)))
    of = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    rows += [("repo0/LICENSE", of["MIT"]), ("repo1/src/COPYING", of["GPL-3.0"]), ("repo0/src/1/LICENSE.txt", of["Apache-2.0"]), (None, None), ("", ""), ("x", LONG), rows[0]]
    df = spark.createDataFrame([(k, p, t, "c") for k, (p, t) in enumerate(rows)], "id long, path string, text string, license string").repartition(4)
    got = {r.id: r for r in licenses.license_scan(df).collect()}
    assert len(got) == len(rows)
    for k, (own, score, share) in enumerate(brute_license(rows)):
        assert got[k].own_license == own and abs(got[k].score - score) < 1e-6 and abs(got[k].share - share) < 1e-9
        path = rows[k][0] or ""
        if own:
            assert got[k].license == own and got[k].license_from is None
        elif path.startswith("repo0/src/1/"):
            assert (got[k].license, got[k].license_from) == ("Apache-2.0", "/repo0/src/1/")
        elif path.startswith("repo0/"):
            assert (got[k].license, got[k].license_from) == ("MIT", "/repo0/")
        elif path.startswith("repo1/src/"):
            assert (got[k].license, got[k].license_from) == ("GPL-3.0", "/repo1/src/")
        else:
            assert got[k].license is None


def test_openings_of_licenses(spark):
    """The beginning of a licence, without its notice, tells which one it is; so does a whole one under another name."""
    of = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    rows = [(f"{name}/{kind}", name, text if kind == "a.txt" else text[: len(text) // 3]) for name, text in of.items() for kind in ("LICENSE", "a.txt")]
    got = licenses.license_scan(spark.createDataFrame(rows, "path string, name string, text string")).collect()
    assert len(got) == len(rows) and all(r.license == r.name and r.is_license for r in got)


def test_prose_of_many_kinds():
    """Prose counts as text wherever no name speaks against it; deep pages take time in proportion."""
    weights = html_text.fit(html_text.labelled_pages())
    said = "This is some prose that goes on for a while and says a lot of things, truly."
    of = lambda page: html_text.extract(page, weights)
    assert of(f"<div>{said}</div><div>{said} Two.</div>") == f"{said}\n{said} Two."
    assert of(said) == said
    assert of(f"<nav><a>home</a></nav><div class='side-content'><p>{said}</p><p>{said}</p></div><footer>copyright</footer>") == f"{said}\n{said}"
    assert of(f"<article><h1>T</h1><p>{said}</p><section class='discussion'><h3>More</h3><p>{said} See <a href=x>there</a>.</p></section></article>") == f"T\n{said}\nMore\n{said} See there."
    assert of(f"<article><p>{said} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><div class=ad>Buy!</div><p>{said}</p></article>") == f"{said} x=1\n{said}"
    begun = time.perf_counter()
    for page in ("<div><b>" * 40_000 + said, "<b>" * 80_000 + "<hr>" * 80_000 + said, "".join(f"<div class=c{k}>" for k in range(80_000)) + said + "</div>" * 80_000):
        assert of(page) == said
    assert time.perf_counter() - begun < 6


def test_scores_against_all_open_names():
    """The running score of each word is the sum over the different names that are open."""
    weights = html_text.fit(html_text.labelled_pages(60))
    for page in html_text.labelled_pages(40, seed=5):
        scores, texts = html_text.scored(page, weights)
        want, names = [], Counter()
        for kind, what, block in html_text.events(page):
            if kind == html_text.OPEN:
                names.update(what)
            elif kind == html_text.CLOSE:
                names.subtract(what)
            elif kind == html_text.TAG:
                want.append((weights["tags"].get(what, weights["other"]), None))
            elif kind == html_text.TEXT:
                now = weights["base"] + sum(weights["words"].get(name, 0) for name in +names)
                own = weights["part"] + sum(weights["parts"].get(name, 0) for name in +names)
                want.append((max(-html_text.MOST, min(html_text.MOST, now)) * len(what.split()), own > 0))
        assert np.allclose(scores, [w for w, _ in want])
        assert all(keep is None or bool(text) == (keep or not text and keep) for (_, keep), text in zip(want, texts))
        best = max((sum(scores[a:b]), -a, -b) for a in range(0, len(scores), 7) for b in range(a, len(scores) + 1))
        first, end = html_text.best_region(scores)
        assert sum(scores[first:end]) >= best[0] - 1e-9


def test_empty_tables(spark):
    docs = table(spark, [])
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0
    assert quality_rules.quality_rules(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_copies(docs).count() == 0
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert packing.harmonic_pack(docs, P.path("word_bpe_49k.json")).count() == 0
    assert sharding.shard_query(docs).count() == 0
    assert byte_bpe.digest_texts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert licenses.license_scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_counts_of_all_labelled_rows(spark, monkeypatch):
    """The models count the words of every labelled row, however few teach the calibration."""
    made, plain = [], toxicity.telling_words

    def spy(counts):
        made.append({r.word: [r.n0, r.n1] for r in counts.select("word", "n0", "n1").collect()})
        return plain(counts)

    monkeypatch.setattr(toxicity, "telling_words", spy)
    docs = [(k, "s", f"word x{k:03d}") for k in range(160)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(160)], "doc_id long, quality int, toxic int")
    toxicity.fit(table(spark, docs), labels, 5)
    used = [k for k in range(160) if zlib.crc32(str(k).encode()) % 5]
    assert {w: n for w, n in made[-1].items() if w != "word"} == {f"x{k:03d}": [1 - k % 2, k % 2] for k in used}


def test_kneser_ney(spark):
    """Backoff and ratios against a plain Kneser-Ney model."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcé!") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    n = {w: (rng.choice([0, 1, 1, 2, 40]), rng.choice([0, 1, 3])) for w in words}
    n = {w: c if sum(c) else (1, 0) for w, c in n.items()}
    counts = spark.createDataFrame([(w, *c) for w, c in n.items()], "word string, n0 long, n1 long").repartition(4)
    known = counts.join(toxicity.letter_backoff(counts.select("word")), "word")
    got = {r.word: (r.backoff, r.ratio) for r in known.select("word", "backoff").join(toxicity.word_ratios(known), "word").collect()}
    want = brute.kneser_ney(n, toxicity.ORDER, toxicity.DISCOUNT, toxicity.LETTER)
    assert set(got) == set(want)
    assert all(abs(got[w][k] - want[w][k]) < 1e-9 for w in want for k in (0, 1))


def test_toxicity_query_against_plain_scores(spark):
    """Scores of texts, by the words sent and by a join, against a plain sum over the telling words."""
    rows = [(k, "s", t) for k, t in enumerate(["bad Worse good", "", None, "bad " * 9000 + "good!", "good", "bad Worse good", "w" * 200 + " bad"])]
    docs = table(spark, rows)
    words = spark.createDataFrame([("bad", 2.0), ("worse", 0.5), ("w" * 64, 1.0), ("!", 0.25)], "word string, excess double")
    want = {0: 2.5 / 3, 1: 0, 2: 0, 3: 18000.25 / 9002, 4: 0, 5: 2.5 / 3, 6: 5.0 / 5}
    for most in (10, 2):
        evidence = toxicity.Evidence(words, most)
        assert (evidence.sent is None) == (most == 2)
        got = evidence.measure(docs, "x").collect()
        assert len(got) == len(rows) and all(abs(r.x - want[r.doc_id]) < 1e-9 and r["class"] == "z" for r in got)
    scored = toxicity.score(docs.withColumn("toxicity", F.lit("mine")), toxicity.Model(evidence, (4.0, -1.0)), "s").collect()
    assert all(r.toxicity == "mine" and abs(r.s - 1 / (1 + np.exp(-min(30, 4 * want[r.doc_id] - 1)))) < 1e-9 for r in scored)
