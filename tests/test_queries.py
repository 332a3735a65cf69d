"""Every query of the driver against DuckDB, on the smallest tables."""

import importlib
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
entry_points = importlib.import_module("__spark_entry__")
SMALL = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry_points.queries() if not n.startswith("op") and n != "pipeline")

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_tuple"):
        return str(v)
    return f"{float(v):.4f}".replace("-0.0000", "0.0000")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry_points.queries()[name](spark, SMALL)
    rows = got.collect()
    sql = entry_points.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    want = duck.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    b = sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    assert a == b


def test_kabsch_rmsd_of_a_frame_with_fewer_atoms(spark, tmp_path):
    """496 vectors make 49 frames of ten atoms and one of six."""
    import numpy as np

    held = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id < 496")
    held.write.parquet(f"{tmp_path}/embeddings.parquet")
    xyz = np.array([r.embedding[:3] for r in held.orderBy("vec_id").collect()], float)
    got = {r.frame: r for r in entry_points.queries()["kabsch_rmsd"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(50))
    for f, r in got.items():
        now = xyz[10 * f : 10 * f + 10]
        a, b = (m - m.mean(axis=0) for m in (now, xyz[: len(now)]))
        s = np.linalg.svd(a.T @ b, compute_uv=False) * [1, 1, np.sign(np.linalg.det(a.T @ b))]
        want = math.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(now)))
        assert r.n_matched == len(now) and abs(r.rmsd - want) < 1e-6


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["ward_labels", "two_sample_tests", "mixture_test", "signed_rank", "bootstrap_r2", "permutation_pvalues"])
def test_no_part_of_the_rows(spark, tmp_path, name):
    """Ids from 600 on and all 64 features count."""
    from pyspark.sql import functions as F

    moved = spark.read.parquet(f"{SMALL}/embeddings.parquet").withColumn("vec_id", F.col("vec_id") + 600)
    moved.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = entry_points.queries()[name](spark, str(tmp_path)).collect()
    if name == "ward_labels":
        assert len(rows) == moved.count()
    else:
        assert len({r["feature"] for r in rows if "feature" in r} or {str(r) for r in rows}) >= (64 if rows and "feature" in rows[0] else 1)
