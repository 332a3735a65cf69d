"""The pipeline's stages and the corpus queries over the smallest tables, against plain versions and SQL."""

import hashlib
import importlib
import os
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from framewright.llm import common, queries, simhash

from . import brute

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.dtypes
    kept = {}
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if name != "toxicity" else None
        docs, _ = common.stored(stage(spark, docs, SMALL))
        if name == "packing":
            break
        assert docs.dtypes == columns
        after = {r.doc_id: r for r in docs.collect()}
        kept[name] = set(after)
        if name == "exact_dedup":
            by = defaultdict(list)
            for d, t in before:
                by[brute.lower(t)].append(d)
            assert set(after) == {max(v) for v in by.values()}
        if name == "near_dedup":
            ids, fps = [d for d, _ in before], [brute.fingerprint(t) for _, t in before]
            groups = brute.groups(ids, fps)
            assert set(after) <= set(groups)
            text = dict(before)
            for d in set(groups) - set(after):
                mine = set(simhash._shingle_set((text[d] or "").encode()).tolist())
                others = (set(simhash._shingle_set((t or "").encode()).tolist()) for e, t in before if e != d)
                assert any(len(mine & o) >= 0.8 * len(mine | o) for o in others)
        if name == "substring_dedup":
            want = {d: (n, gone, t) for d, n, gone, t in brute.substrings(before)}
            text = dict(before)
            for d, r in after.items():
                n, gone, t = want[d]
                assert r.text == (t if gone else text[d]) and r.n_chars == len(r.text or "")
    assert kept["exact_dedup"] <= kept["toxicity"] and kept["near_dedup"] <= kept["exact_dedup"] and kept["substring_dedup"] == kept["near_dedup"]
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == kept["substring_dedup"]
    assert sorted({r.sequence_id for r in pieces}) == list(range(len({r.sequence_id for r in pieces})))
    per = defaultdict(int)
    for r in pieces:
        per[r.doc_id] += r.length
    assert all(per[r.doc_id] == r.doc_tokens for r in pieces)


ODD = [(1, None), (2, ""), (None, None), (None, "a b c"), (3, "x " * 60_000), (4, "Same text"), (5, "same TEXT"), (5, "same TEXT"), (6, " ".join(f"w{k}" for k in range(80))), (7, " ".join(f"w{k}" for k in range(80)) + " more"), (8, "é\u00a0ü <|endoftext|> z")]


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names, and no rows at all, through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, n_words string, n_removed string, fp string, row string, at string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ODD, []):
        docs = spark.createDataFrame([(d, t, "en", "s", 0, "mine", "mine", "mine", "mine", "mine", "mine") for d, t in rows], schema).repartition(3)
        columns = docs.dtypes
        for name, stage in pipeline.STAGES[:-1]:
            docs, _ = common.stored(stage(spark, docs, str(tmp_path)))
            assert docs.dtypes == columns
            kept = docs.collect()
            assert all(r[c] == "mine" for r in kept for c in columns_of_mine)
            if rows and name == "toxicity":
                assert len(kept) == len(rows)
            if rows and name == "exact_dedup":
                assert Counter((r.doc_id, r.text) for r in kept) == Counter([(2, ""), (None, "a b c"), (3, "x " * 60_000), (5, "same TEXT"), ODD[8], ODD[9], ODD[10]])
            if rows and name == "near_dedup":
                assert sorted(r.doc_id or 0 for r in kept) == [0, 2, 3, 5, 6, 8]
            if rows and name == "substring_dedup":
                assert {r.doc_id or 0: r.text for r in kept} == {0: "a b c", 2: "", 3: "", 5: "same TEXT", 6: ODD[8][1], 8: ODD[10][1]}
        packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r.doc_id or 0 for r in packed} == ({0, 2, 3, 5, 6, 8} if rows else set())


columns_of_mine = ("toxicity", "n_words", "n_removed", "fp", "row", "at")


def test_run(spark):
    assert pipeline.run(spark, SMALL).columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = queries.queries()[name](spark, SMALL)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


def test_simhash_query(spark, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SMALL).collect()}
    fps = [brute.fingerprint(t) for _, t in documents]
    want = brute.groups([d for d, _ in documents], fps)
    assert got == {d: (f"{f:016x}", c) for (d, _), f, c in zip(documents, fps, want)}


def test_sharding_query(spark, documents):
    got = queries.op9_sharding(spark, SMALL).collect()
    text = dict(documents)
    assert len(got) == len(documents) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    size = defaultdict(int)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        size[r.shard] += r["size"]
    assert set(size) == set(range(8)) and max(size.values()) < 1.05 * min(size.values())
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_bpe_query(spark, documents):
    got = {r.doc_id: r for r in queries.op10_byte_bpe(spark, SMALL).collect()}
    assert all(got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for d, t in documents)


def test_html_query(spark):
    """Every page's text against the blocks of its article, which these pages mark."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    want = {p.page_id: brute.article(p.html or "") for p in pages}
    got = queries.op5_html_text(spark, SMALL).collect()
    assert len(got) == len(pages) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_other_queries(spark):
    scored = queries.op1_toxicity(spark, SMALL).collect()
    assert len({r.doc_id for r in scored}) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert queries.op4_licenses(spark, SMALL).count() == 200
    pages = queries.op5_html_text(spark, SMALL).collect()
    assert len(pages) == 50 and all(r.n_chars == len(r.text) and "<" not in r.text for r in pages)
    assert queries.op3_packing(spark, SMALL).select("doc_id").distinct().count() == 200
