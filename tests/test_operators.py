import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.functions import clean, groups, labels, time, vectors
from framewright.operators import aggregates, attribution, changepoints, clustering, geometry, joins, scoring, statistics, windows
from framewright.operators.groups import each_group
from framewright.plans.passes import standard
from framewright.plans.pipeline import Analysis
from framewright.plans.registry import Operator, Parameter, Registry, Session


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


@pytest.fixture(scope="module")
def flips(spark):
    text = {"a": "0110111100001", "b": "1", "c": "0001110"}
    return spark.createDataFrame([(k, i, int(c)) for k, s in text.items() for i, c in enumerate(s)], "k string, i long, on int")


def plain_events(flags, least):
    state, out, i = 0, [], 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j] == flags[i]:
            j += 1
        if j - i >= least and flags[i] != state:
            state = flags[i]
            out.append((i, "entry" if state else "exit"))
        i = j
    return out


@pytest.mark.parametrize("least", [1, 2, 4])
def test_debounce(spark, flips, least):
    got = windows.debounced_events(flips, "k", "i", "on", least).collect()
    for k, part in flips.toPandas().groupby("k"):
        own = sorted((r["at"], r.event) for r in got if r.k == k)
        assert own == plain_events(part.sort_values("i").on.tolist(), least)
    for k in {r.k for r in got}:
        own = sorted((r for r in got if r.k == k), key=lambda r: r["at"])
        assert [r.censored for r in own] == [False] * (len(own) - 1) + [True]


def test_dwell_and_runs(spark):
    df = spark.createDataFrame([("t", i, "A" if i < 30 else "B") for i in range(40)] + [("t", 50 + i, "B") for i in range(10)], "k string, i long, l string")
    out = windows.dwell_statistics(df, "k", "i", "l", 20, step="i").first()
    assert (out.median_run, out.n_runs) == (10, 3) and abs(out.pct_persistent - 60) < 1e-9
    stats = windows.run_statistics(df.withColumn("on", F.col("l") == "A"), "k", "i", "on").first()
    assert (stats.n_on, stats.n_runs, stats.max_run_length, stats.n_switches) == (30, 1, 30, 1)


def test_plateau(spark):
    rng = np.random.default_rng(0)
    y = np.r_[np.linspace(0, 10, 60), 10 + rng.normal(0, 0.01, 60)]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)] + [("short", 0, 1.0), ("short", 1, 2.0)], "k string, i long, y double")
    got = {r.k: r for r in windows.plateau(df, "k", "i", "y", 20).collect()}
    stds = pd.Series(y).rolling(20).std(ddof=1).dropna().to_numpy()
    first = next(i for i in range(len(stds)) if (stds[i:] <= 0.12 * y.std()).all())
    assert got["a"].plateau_start == first and got["a"].success and got["a"].mode == "full_tail"
    assert got["short"].mode == "insufficient_data" and not got["short"].success


def test_plateau_fallback(spark):
    y = [0, 9] * 10 + [5] * 15 + [0, 9] * 10
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, i long, y double")
    got = windows.plateau(df, "k", "i", "y", 5, 0.5).first()
    assert got.mode == "longest_segment" and 18 <= got.plateau_start <= 21


def test_elbow_and_plateaus(spark):
    df = spark.createDataFrame([(1.0, 100, None, 1.0), (2.0, 40, 0.9, 0.9), (3.0, 20, 0.9, 0.9), (4.0, 19, 0.95, 1.0), (5.0, 18, 0.9, 1.0), (6.0, 5, 0.2, 0.5)], "penalty double, total_breakpoints long, timing_jaccard_vs_prev double, regime_agreement_vs_ref double")
    assert windows.elbow(df, "penalty", "total_breakpoints").first().penalty == 3.0
    got = windows.stable_plateaus(df, min_steps=2, timing=0.8, count_change=0.1).first()
    assert (got.penalty_min, got.penalty_max, got.n_steps) == (4.0, 5.0, 2)
    assert abs(got.stability_score - 2 * 0.925 * 1.0) < 1e-9


def test_interval_joins(spark):
    pts = spark.createDataFrame([("a", i) for i in range(0, 4000, 7)] + [("b", 5)], "k string, f long")
    seg = spark.createDataFrame([("a", 1, 0, 2999), ("a", 2, 1000, 1100), ("a", 3, 3500, 3600), ("a", 4, 9, 3)], "k string, id int, start_frame long, end_frame long")
    for width in (10, 1024, 10**6):
        got = rows(joins.interval_join(pts, seg, ["k"], "f", width=width), "k", "f", "id")
        want = sorted(("a", f, i) for f in range(0, 4000, 7) for i, a, b in ((1, 0, 2999), (2, 1000, 1100), (3, 3500, 3600)) if a <= f <= b)
        assert got == want
    later = {(r.k, r.f): r.id for r in joins.label_points(pts, seg, ["k"], "f").collect()}
    assert later["a", 1001] == 2 and later["a", 14] == 1 and later["a", 3010] is None and later["b", 5] is None


def test_greedy_match(spark):
    a, b = [10, 12, 50, 100], [11, 13, 55, 300]
    df = lambda v, n: spark.createDataFrame([("t", x) for x in v], f"k string, {n} long")
    got = rows(joins.greedy_match(joins.band_join(df(a, "at_a"), df(b, "at_b"), ["k"], "at_a", "at_b", 5), ["k"], "at_a", "at_b"), "at_a", "at_b")
    assert got == [(10, 11), (12, 13), (50, 55)]
    timing = joins.compare_timing(
        spark.createDataFrame([("t", "x", v) for v in a] + [("t", "y", v) for v in b], "traj_id string, grp string, frame long"),
        spark.createDataFrame([("t", "x"), ("t", "y"), ("t", "z"), ("u", "x"), ("u", "y")], "traj_id string, grp string"), 5,
    )
    got = {(r.traj_id, r.group_a, r.group_b): r for r in timing.collect()}
    assert got["t", "x", "y"].n_shared == 3 and abs(got["t", "x", "y"].jaccard - 3 / 5) < 1e-12
    assert got["u", "x", "y"].jaccard == 1.0 and got["t", "x", "z"].jaccard == 0.0 and len(got) == 4


def test_boundary_matching(spark):
    b = spark.createDataFrame([("t", 100.0), ("t", 200.0), ("v", 1.0)], "traj_id string, time_ps double")
    p = spark.createDataFrame([("t", 150.0), ("t", 210.0), ("t", 900.0), ("u", 5.0)], "traj_id string, time_ps double")
    got = {r.traj_id: r for r in joins.match_boundaries(b, p, tolerance=60.0).collect()}
    assert (got["t"].n_matched, got["t"].n_breakpoints) == (2, 3) and abs(got["t"].f1 - 0.8) < 1e-12
    assert got["u"].n_boundaries == 0 and got["v"].n_breakpoints == 0


def test_distance_join(spark):
    rng = np.random.default_rng(1)
    pts = [(int(f), i, *map(float, rng.uniform(-5, 5, 3))) for f in range(2) for i in range(60)]
    df = spark.createDataFrame(pts, "frame long, id int, x double, y double, z double")
    got = rows(joins.distance_join(df, df, ["frame"], 2.0).where("id < b_id"), "frame", "id", "b_id")
    want = sorted((p[0], p[1], q[1]) for p in pts for q in pts if p[0] == q[0] and p[1] < q[1] and math.dist(p[2:], q[2:]) < 2.0)
    assert got == want


def test_clean_and_groups(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0, float("nan"), 2.0), ("a", 1, 1.0, float("inf"), 4.0, 3.0)], "traj_id string, frame long, time_ps double, assembly_rg double, n_guest_bulk double, endpoint_dist_0s1_1s2 double")
    c = clean.finite_table(df)
    assert c.agg(F.avg("assembly_rg"), F.avg("n_guest_bulk")).first()[:] == (1.0, 4.0)
    assert groups.group_columns(df, "combined") == ["assembly_rg", "n_guest_bulk", "endpoint_dist_0s1_1s2"]
    assert groups.group_columns(df, "guest") == ["n_guest_bulk"] and groups.group_columns(df, "endpoint") == []
    assert groups.group_columns(df, "endpoint", True) == ["endpoint_dist_0s1_1s2"]
    with pytest.raises(ValueError):
        groups.group_columns(df, "nothing")
    filled = clean.impute(df, ["assembly_rg", "n_guest_bulk"], ("traj_id",), "median").orderBy("frame").collect()
    assert [r.assembly_rg for r in filled] == [1.0, 1.0] and [r.n_guest_bulk for r in filled] == [4.0, 4.0]


def test_labels(spark):
    df = spark.createDataFrame([("BMMpM_109_v_gsa_features", "endpoint_dist_0s3_1s6", 4.5, 2, 1), ("x", "other", float("nan"), 3, 0), ("y", "z", 7.0, None, None)], "id string, name string, d double, o int, e int")
    got = df.select(labels.series_id(F.col("id")).alias("id"), labels.cohort(F.col("id")).alias("c"), labels.pair_key(F.col("name")).alias("p"), labels.edge_window(F.col("d")).alias("w"), labels.edge_state(F.col("d")).alias("s"), labels.contact_state(F.col("d")).alias("k"), labels.metastructure(F.col("o"), F.col("e")).alias("m"), labels.opening(F.col("o")).alias("n")).collect()
    assert [r.id for r in got] == ["109_v", "x", "y"] and [r.c for r in got] == ["BMMpM", None, None]
    assert tuple(got[0].p) == (0, 3, 1, 6) and got[1].p is None
    assert [r.w for r in got] == ["compact", "unknown", "elongated"] and [r.s for r in got] == ["open", "unknown", "elongated"]
    assert [r.k for r in got] == ["closed", "unknown", "open"] and [r.m for r in got] == ["C2", "other", None]
    assert got[0].n == "2 poles open" and got[1].n == "3+ poles open"
    assert labels.permutation_cycles((1, 0, 2, 4, 3)) == "(0 1)(3 4)" and labels.permutation_cycles((0, 1)) == "()"
    rows = [(5.0, 95.0, 1.0, 0.0, 0.0, False), (5.0, 60.0, 1.0, 0.0, 0.0, False), (5.0, 10.0, 1.0, 0.0, 45.0, False), (5.0, 10.0, 1.0, 0.0, 5.0, False), (90.0, 0.0, 80.0, 5.0, 0.0, False), (85.0, 0.0, 45.0, 40.0, 0.0, False), (48.0, 0.0, 42.0, 2.0, 0.0, False), (60.0, 0.0, 30.0, 30.0, 0.0, False), (60.0, 0.0, 20.0, 30.0, 0.0, True)]
    named = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, any double, a double, e double, f double, p double, s boolean").orderBy("k")
    of = labels.structure_name(F.col("any"), F.col("a"), {"M0-M1": F.col("e"), "M2-M3": F.col("f")}, {"P0": F.col("p")}, F.col("s"))
    assert [x.n for x in named.select(of.alias("n")).collect()] == ["compact cage", "mostly compact", "intact belt, P0 often open", "intact belt", "belt broken along M0-M1", "belt broken along M0-M1 or M2-M3", "partly belt broken along M0-M1", "mixed belt, largest edge M0-M1", "loosened single replica, edge M2-M3"]
    order = spark.createDataFrame([("v10",), ("v9",), ("v1",)], "n string").orderBy(labels.natural_key(F.col("n"))).collect()
    assert [r.n for r in order] == ["v1", "v9", "v10"]


def test_time_and_vectors(spark):
    df = spark.createDataFrame([("a", i, 2.0 * i) for i in range(5)], "traj_id string, frame long, time_ps double")
    assert time.spacing(df).first().sample_ps == 2.0
    one = spark.range(1).select(time.lag_frames(F.lit(0.005), F.lit(2.0)).alias("n"), vectors.angle(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("g")).first()
    assert one.n == 2 and abs(one.g - 90) < 1e-9


def test_bootstrap_and_one_se(spark):
    rng = np.random.default_rng(3)
    long = spark.createDataFrame([(2, f"s{i % 6}", i % 2, "x", float((i % 2) * 3 + rng.normal())) for i in range(120)], "k int, series string, label int, feature string, value double")
    stats = statistics.sufficient_statistics(long, "value", "series", "label", ["k", "feature"])
    got = statistics.bootstrap_r_squared(stats, "series", "label", ["k"], 60).first()
    assert 0.5 < got.out_of_bag <= got.in_sample + 0.1 and got.se > 0
    pick = spark.createDataFrame([(2, 0.5, 0.1, True), (3, 0.58, 0.05, True), (4, 0.6, 0.05, True), (5, 0.9, 0.1, False)], "k int, s double, se double, ok boolean")
    assert statistics.one_se(pick, "s", "se", gate="ok").first().k == 3


def test_changepoints_and_pipeline(spark):
    rng = np.random.default_rng(4)
    data = []
    for t in range(6):
        level = np.r_[np.zeros(60), np.full(60, 5.0), np.zeros(60)] if t % 2 else np.r_[np.full(60, 5.0), np.zeros(60), np.full(60, 5.0)]
        for i in range(180):
            data.append((f"t{t}", i, float(i), float(level[i] + rng.normal(0, 0.2)), float(-level[i] + rng.normal(0, 0.2)), float(rng.normal())))
    df = spark.createDataFrame(data, "traj_id string, frame long, time_ps double, u double, v double, w double")
    a = Analysis(df, {"main": ["u", "v"], "noise": ["w"]}, cost="l2", penalty=10.0, jump=5, tolerance=10, k=2)
    found = a.breakpoints().where("grp = 'main'").groupBy("traj_id").agg(F.array_sort(F.collect_list("frame")).alias("f")).collect()
    assert len(found) == 6 and all(r.f == [60, 120] for r in found)
    seg = a.segments().where("grp = 'main'").collect()
    assert len(seg) == 18 and all(r.n_frames == 60 and r.end_frame - r.start_frame == 59 for r in seg)
    one = next(r for r in seg if r.traj_id == "t0" and r.segment_id == 0)
    u = np.array([d[3] for d in data if d[0] == "t0"][:60])
    assert abs(one.u_mean - u.mean()) < 1e-9 and abs(one.u_std - u.std()) < 1e-9
    assert a.clusters().where("grp = 'main'").select("cluster_label").distinct().count() == 2
    moves = rows(a.transitions("main").groupBy("traj_id").count())
    assert [n for _, n in moves] == [2] * 6
    ranking = a.attribution("main").collect()
    best = {r.feature for r in ranking if r["rank"] <= 2}
    assert best == {"u", "v"} and all(not r.is_descriptive for r in ranking)
    assert {r.group_a for r in a.timing().collect()} == {"main"}
    assert a.pick(5) is not None
    summary = a.summary()
    assert summary["population"].where("grp = 'main'").agg(F.sum("fraction")).first()[0] == pytest.approx(1.0)
    sub = changepoints.suppress_recrossings(spark.createDataFrame([("a", i, c) for i, c in enumerate("AABAAC")], "traj_id string, frame long, l string"), "l", min_dwell=2)
    assert "".join(r.l for r in sub.orderBy("frame").collect()) == "AAAAAC"


def test_clustering(spark):
    rng = np.random.default_rng(5)
    data = [("g", f"r{i % 5}", i, [float(v) for v in rng.normal(3 * (i % 3), 0.2, 4)]) for i in range(60)]
    df = spark.createDataFrame(data, "grp string, rep string, id int, x array<double>")
    lab = clustering.ward(df, ["id"], ["grp"]).collect()
    assert {r.chosen_k for r in lab} == {3} and sum(r.medoid for r in lab) == 3
    assert len({(r.id % 3, r.cluster_label) for r in lab}) == 3
    assert clustering.cuts(df, ["id"], ["grp"], k_max=5).select("k").distinct().count() == 4
    full = df.join(spark.createDataFrame([(r.id, r.cluster_label) for r in lab], "id int, cluster_label int"), "id")
    assert clustering.hold_out(full, ["grp"], "cluster_label", "rep", repeats=2).first().balanced_accuracy > 0.95
    assert clustering.diameters(full, ["id"], ["grp"]).count() == 3
    assert clustering.core_split(full, ["grp"], ["id"]).where("core").count() > 0
    prof = clustering.profile_correlations(full, ["grp"], mappings=np.array([[0, 1, 2, 3], [3, 2, 1, 0]])).collect()
    assert all(r.best_r >= r.r - 1e-9 for r in prof)
    scores, share = clustering.pca(df, "x", 2)
    assert share[0] > 0.9 and scores.count() == 60
    assert clustering.kmeans_by_silhouette(df, "x", 2, 5).select("cluster").distinct().count() == 3
    assert clustering.families(["a", "b", "c"], [("a", "b", 0.97), ("b", "c", 0.5)]) == {"a": 0, "b": 0, "c": 1}
    assert clustering.dilution_verdict(0.5, 0.97, n_a=9, n_b=9) == "diluted_copies"


def test_tica_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = {t: rng.normal(size=(40, 3)).cumsum(axis=0) for t in ("a", "b")}
    df = spark.createDataFrame([(t, i, v.tolist()) for t, m in x.items() for i, v in enumerate(m)], "traj_id string, frame long, x array<double>")
    c0, ct = clustering.lagged_covariances(df, "x", 3, 2)
    c = {t: m - m.mean(axis=0) for t, m in x.items()}
    assert np.allclose(c0, sum(m.T @ m for m in c.values()) / 79)
    assert np.allclose(ct, sum(m[:-2].T @ m[2:] for m in c.values()) / 76)
    out, found = clustering.tica(df, "x", 2, 2)
    assert len(out.first().tics) == 2 and len(found["timescales"]) == 2


def test_geometry(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 3)) * 3
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    frames = [base, base @ q + 5, base + rng.normal(0, 0.1, base.shape)]
    data = [("t", f, float(f), i, i // 4, "MOL", "C", "C", *map(float, p)) for f, m in enumerate(frames) for i, p in enumerate(m)]
    atoms = spark.createDataFrame(data, "traj_id string, frame long, time_ps double, atom_id int, resid int, resname string, name string, element string, x double, y double, z double")
    pos = geometry.positions(atoms)
    rmsd = {r.frame: r.rmsd for r in geometry.rmsd_to_reference(pos, pos.where("frame = 0").select("traj_id", "positions")).collect()}
    assert rmsd[0] < 1e-9 and rmsd[1] < 1e-9 and 0.02 < rmsd[2] < 0.3
    moved = geometry.align(atoms, F.lit(True)).where("frame = 1").orderBy("atom_id").select("x", "y", "z").collect()
    assert np.allclose([list(r) for r in moved], base, atol=1e-8)
    from framewright.kernels import geometry as G

    shape = {r.frame: r for r in geometry.shapes(atoms).collect()}
    want = G.shape(base)
    assert all(abs(shape[0][k] - want[k]) < 1e-9 for k in want)
    rg = standard().run(atoms, ["rg", "atoms"], frames=(0, 2, 1)).orderBy("frame").collect()
    assert len(rg) == 2 and abs(rg[0].rg - want["rg"]) < 1e-9 and rg[0].n_atoms == 12
    c = geometry.contact_summary(atoms, "resid", 4.5).collect()
    for r in c:
        m = frames[r.frame]
        pairs = {(i, j): sum(math.dist(a, b) < 4.5 for a in m[4 * i : 4 * i + 4] for b in m[4 * j : 4 * j + 4]) for i in range(3) for j in range(i + 1, 3)}
        assert r.total_contacts == sum(pairs.values()) and r.n_active == sum(v > 0 for v in pairs.values()) and r.weakest == min(pairs.values())
    one = atoms.where("frame = 0 AND atom_id = 0")
    vol = geometry.voxel_volume(one, 0.1).first().volume
    assert abs(vol - 4 / 3 * math.pi * 1.7**3) < 0.5
    assert abs(geometry.cavity_volume(one, 0.2).first().volume - vol) < 1.0
    step = {r.frame: r.step_rmsd for r in geometry.rmsd_to_previous(pos).collect()}
    assert step[0] is None and abs(step[1] - np.sqrt(((frames[1] - base) ** 2).sum(axis=1).mean())) < 1e-9
    assert geometry.strain(pos).count() == 3 and all(r.strain is None for r in geometry.strain(pos).collect())
    assert [r.strain is None for r in geometry.strain(pos, 1).orderBy('frame').collect()] == [True, False, True]
    f = aggregates.atom_fluctuation(atoms).where("atom_id = 3").first().rmsf
    p3 = np.array([m[3] for m in frames])
    assert abs(f - np.sqrt(((p3 - p3.mean(axis=0)) ** 2).sum(axis=1).mean())) < 1e-9
    assert aggregates.main_species(atoms).first().resname == "MOL" and aggregates.residue_catalog(atoms).first().resids == [0, 1, 2]


@pytest.mark.parametrize("centred", [True, False])
def test_rmsd_of_frames_that_lack_atoms(spark, centred):
    """Atoms meet by their ids: one missing, another in its place, one without a place, only others; the reference lacks one too."""
    from framewright.kernels import geometry as G

    rng = np.random.default_rng(11)
    base = rng.normal(size=(8, 3))
    ids = {0: range(7), 1: range(8), 2: [0, 1, 2, 4, 5], 3: [0, 1, 2, 4, 5, 6, 7], 4: range(7), 5: [7]}
    place = {(f, i): base[i] + rng.normal(0, 0.2, 3) for f, some in ids.items() for i in some}
    place[4, 3] = [math.nan, 0.0, 0.0]
    data = [("t", f, i, *map(float, p)) for (f, i), p in place.items()] + [("t", 4, 7, None, 0.0, 0.0)]
    pos = geometry.positions(spark.createDataFrame(data, "traj_id string, frame long, atom_id int, x double, y double, z double"))
    got = {r.frame: r for r in geometry.rmsd_to_reference(pos, pos.where("frame = 0").drop("frame"), centred).collect()}
    both = {0: range(7), 1: range(7), 2: [0, 1, 2, 4, 5], 3: [0, 1, 2, 4, 5, 6], 4: [0, 1, 2, 4, 5, 6]}
    for f, shared in both.items():
        want = (G.rmsd_superposed if centred else G.rmsd_rotated)(*(np.array([place[g, i] for i in shared]) for g in (f, 0)))
        assert got[f].n_matched == len(shared) and abs(got[f].rmsd - want) < 1e-9
    assert len(got) == 6 and got[5].n_matched == 0 and got[5].rmsd is None


def test_predicates(spark):
    v = lambda *a: F.array(*(F.lit(float(x)) for x in a))
    got = spark.range(1).select(
        geometry.hydrogen_bond(v(0, 0, 0), v(1, 0, 0), v(3.5, 0, 0)).alias("hb"),
        geometry.hydrogen_bond(v(0, 0, 0), v(0, 1, 0), v(3, 0, 0)).alias("bent"),
        geometry.cation_pi(v(0, 0, 6.5), v(0, 0, 0), v(0, 0, 1)).alias("cp"),
        geometry.cation_pi(v(6, 0, 1), v(0, 0, 0), v(0, 0, 1)).alias("side"),
        geometry.pi_stacking(v(0, 0, 0), v(0, 0, 1), v(1, 0, 4), v(0, 0, -1)).alias("pp"),
        geometry.pi_stacking(v(0, 0, 0), v(0, 0, 1), v(3, 0, 4), v(0, 0, 1)).alias("off"),
        geometry.preference(F.lit(2), F.lit(0)).alias("inf"),
        geometry.preference(F.lit(0), F.lit(0)).alias("nan"),
    ).first()
    assert got.hb and not got.bent and got.cp and not got.side and got.pp and not got.off
    assert got.inf == float("inf") and math.isnan(got.nan)


def test_scores(spark):
    run = spark.createDataFrame([(5, 2, 100.0, 10.0, 40.0, 0.9, 0.6, 4, 0.25, 30), (0, 0, 0.0, 0.0, 0.0, None, None, 0, None, 0)], "n_entries int, n_exits int, volume_mean double, volume_std double, volume_range double, r_max double, r_mean double, n_strong int, dist_cv double, n_dist int")
    a, b = scoring.score_runs(run, True).collect()
    g = 0.3 + 0.2 * (1 - math.exp(-1.5)) + 0.15 * (1 - math.exp(-0.8)) + 0.25 * (1 + 3 / 5) * 5 / 7
    v = 0.2 + 0.2 * (1 + math.tanh(2 * (4 - 0.5))) + 0.4
    c = 0.15 + 0.5 * 0.9**1.5 + 0.25 * math.log(5) / math.log(10) + 0.1 * 0.6**1.2
    s = 0.25 + 0.5 + 0.2 * 0.05 / 0.3
    total = 0.3 * min(1, g) + 0.25 * min(1, v) + 0.25 * min(1, c) + 0.2 * min(1, s)
    total = min(1, total + 0.08 * (total - 0.5) ** 1.5)
    assert abs(a.overall_score - total) < 1e-9 and a.is_valid and not b.is_valid


def test_guest_residence(spark):
    """Time inside counts by its share, and against a least time; without time inside neither does."""
    runs = spark.createDataFrame([(3, 1, 30.0, 10.0, 20.0), (3, 1, 5.0, 15.0, 20.0), (2, 0, 0.0, 9.0, 20.0), (0, 0, 5.0, 5.0, 20.0)], "e int, x int, i double, o double, t double")
    got = [r.s for r in runs.select(scoring.guest_score(F.col("e"), F.col("x"), F.col("i"), F.col("t"), F.col("o")).alias("s")).collect()]
    come = lambda e: 0.3 + 0.2 * (1 - math.exp(-0.3 * e)) + 0.15 * (1 - math.exp(-0.2 * (e - 1)))
    balance = 0.25 * (1 + 2 / 3) * 0.75
    want = [min(1, come(3) + balance + 0.25 * 0.75**0.7 + 0.15), min(1, come(3) + balance + 0.25 * 0.25**0.7 + 0.1 * 0.5), come(2), 0.0]
    assert np.allclose(got, want)


def test_select_frames_against_plain(spark):
    """All frames are candidates, those that must be stay beyond the limit, extremes are of end distances."""
    rng = np.random.default_rng(3)
    n = 300
    score, pcs, lo, hi, mean = rng.normal(size=n), rng.normal(size=(n, 3)), rng.random(n), rng.random(n), rng.random(n)
    rows = [("a", k, float(score[k]), pcs[k].tolist(), float(lo[k]) if k != 7 else float("nan"), float(hi[k]), float(mean[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "traj_id string, frame int, score double, pcs array<double>, endpoint_dist_min double, endpoint_dist_max double, endpoint_dist_mean double").repartition(4)
    marks = [5, 50, 80]
    for most in (2, 12, 40):
        chosen = {*marks, min((k for k in range(n) if k != 7), key=lambda k: lo[k]), int(hi.argmax())}
        must = set(chosen)
        for k in np.argsort(np.abs(np.gradient(mean)))[-3:][::-1]:
            if len(chosen) < most:
                chosen.add(int(k))
        for k in np.argsort(-score):
            if len(chosen) < most and all(np.linalg.norm(pcs[k] - pcs[j]) >= 0.75 for j in chosen):
                chosen.add(int(k))
        got = scoring.select_frames(df, spark.createDataFrame([("a", k) for k in marks], "traj_id string, frame int"), most=most).collect()
        assert {r.frame for r in got} == chosen and {r.frame for r in got if r.must} == must


def test_bh_qvalues(spark):
    """Against the plain step-up, in groups and without, with ties and missing values, in few and many ranges."""
    rng = np.random.default_rng(4)
    rows = [(k, "ab"[k % 2] if k % 11 else None, float(rng.choice([0.001, 0.02, 1.0, rng.random()])) if k % 7 else float("nan")) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, p double").repartition(3)

    def plain(some):
        some = sorted((p, k) for k, p in some if p == p)
        q, least = {}, 1.0
        for i in range(len(some), 0, -1):
            least = min(least, some[i - 1][0] * len(some) / i)
            q[some[i - 1][1]] = least
        return q

    for parts in (1, 5, 64):
        got = {r.id: r.q for r in statistics.bh_qvalues(df, "p", parts=parts).collect()}
        want = plain([(k, p) for k, _, p in rows])
        assert all(abs(got[k] - want[k]) < 1e-12 if k in want else got[k] is None for k in got) and len(got) == 200
        got = {r.id: r.q for r in statistics.bh_qvalues(df, "p", ["g"], parts).collect()}
        want = {k: q for g in ("a", "b", None) for k, q in plain([(k, p) for k, x, p in rows if x == g]).items()}
        assert all(abs(got[k] - want[k]) < 1e-12 if k in want else got[k] is None for k in got) and len(got) == 200


def test_silhouette_in_blocks(spark):
    rng = np.random.default_rng(9)
    x, l = rng.normal(size=(90, 5)), rng.integers(0, 4, 90)
    l[7] = 9
    df = spark.createDataFrame([(k, x[k].tolist(), int(l[k])) for k in range(90)], "id int, x array<double>, l int")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for block in (7, 4096):
        for r in statistics.silhouette(df, "id", "x", "l", block).collect():
            own = [j for j in range(90) if l[j] == l[r.id] and j != r.id]
            b = min(d[r.id, l == m].mean() for m in set(l.tolist()) - {l[r.id]})
            a = d[r.id, own].mean() if own else None
            assert abs(r.silhouette - (0.0 if a is None else (b - a) / max(a, b))) < 1e-9


def test_each_group(spark):
    """Groups come whole and in order, however batches cut them; null keys are a group."""
    rows = [(k % 13 if k % 13 else None, "xy"[k % 2], k) for k in range(4000)]
    df = spark.createDataFrame(rows, "a int, b string, v int").repartition(6)
    one = lambda pdf: pd.DataFrame([(pdf["a"].iloc[0], pdf["b"].iloc[0], len(pdf), bool((pdf["v"].diff().dropna() > 0).all()), int(pdf["v"].sum()))], columns=["a", "b", "n", "ordered", "total"])
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "37", "100000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {(r.a, r.b): r for r in each_group(df, ["a", "b"], ["v"], one, "a int, b string, n long, ordered boolean, total long").collect()}
        assert len(got) == 26 and all(r.ordered for r in got.values())
        assert {k: (r.n, r.total) for k, r in got.items()} == {(a, b): (len(v), sum(v)) for a in [None, *range(1, 13)] for b in "xy" for v in [[z for x, y, z in rows if (x, y) == (a, b)]]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_registry(spark):
    reg = Registry()

    @reg.operator("double", parameters=(Parameter("times", "integer", default=2),), requires=("numbers",), produces=("doubled",))
    def double(session, times):
        """Multiply."""
        return {"doubled": session.values["numbers"].selectExpr(f"id * {times} AS id")}

    s = Session(spark)
    assert reg.available(s) == []
    with pytest.raises(ValueError):
        reg.call(s, "double")
    s.put("numbers", spark.range(3))
    assert reg.available(s) == ["double"]
    reg.call(s, "double", times=3)
    assert [r.id for r in spark.sql("SELECT * FROM doubled ORDER BY id").collect()] == [0, 3, 6] and s.log[0]["parameters"] == {"times": 3}
    with pytest.raises(ValueError):
        reg.call(s, "double", times="x")
    with pytest.raises(ValueError):
        reg.add(Operator("double", double))
    assert '"name": "double"' in reg.definitions()


def test_grouping_sets_and_vectors(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (1, "a", float("nan")), (1, "b", 5.0)], "f int, p string, v double")
    got = {(r.f, r.p, r.level): (r["mean"], r.n) for r in aggregates.pair_and_frame_levels(df, ["f"], ["p"], "v").collect()}
    assert got[0, None, "frame"] == (2.0, 2) and got[1, None, "frame"] == (5.0, 1) and got[1, "a", "pair"] == (None, 0)
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, float("nan")])], "k string, x array<double>")
    assert aggregates.vector_merge(v, ["k"], "x").first().x == [2.0, 2.0]
    assert aggregates.vector_merge(v, ["k"], "x", "sum").first().x == [4.0, 2.0]
    cmp = joins.compare_tables(spark.createDataFrame([(1, 1.0), (2, 2.0), (4, 1.0)], "k int, v double"), spark.createDataFrame([(1, 1.0 + 1e-9), (2, 2.1), (3, 1.0)], "k int, v double"), ["k"]).first()
    assert (cmp.same, cmp.differs, cmp.missing) == (1, 1, 2)
    assert zlib.crc32(b"") == 0


def test_attribution_helpers(spark):
    ranking = spark.createDataFrame([("endpoint_dist_0s3_1s6", 1)], "feature string, rank int")
    sites = spark.createDataFrame([(0, 3, "ring"), (1, 6, "cation")], "monomer int, site_index int, kind string")
    got = attribution.attach_sites(ranking, sites).first()
    assert (got.label, got.kind_a, got.kind_b) == ("M0S3-M1S6", "ring", "cation")
