import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import groups
from framewright.operators import joins
from framewright.plans import guests, metastable, rescoring, states, structures
from framewright.plans.catalog import REGISTRY
from framewright.plans.registry import Session
from framewright.sources import sinks, tables


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(8):
        level = np.repeat(rng.permutation([0.0, 4.0, 8.0]), 50)
        for i in range(150):
            inside = int(60 <= i < 110)
            rows.append((f"t{t}", i, float(i), "one" if t < 4 else "two", float(level[i] + rng.normal(0, 0.2)), float(-level[i] + rng.normal(0, 0.2)), float(level[i] * 2 + 3 * inside + rng.normal()), inside))
    return spark.createDataFrame(rows, "traj_id string, frame long, time_ps double, cohort string, u double, v double, held double, n_guest_inside_cavity int").cache()


@pytest.fixture(scope="module")
def atoms(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(4, 5, 3)) + np.array([[0, 0, 0], [4, 0, 0], [0, 4, 0], [0, 0, 4]])[:, None]
    rows = [("t", f, float(f), 5 * m + a, m, "MOL", "C", "C", *map(float, base[m, a] + rng.normal(0, 0.05, 3))) for f in range(12) for m in range(4) for a in range(5)]
    return spark.createDataFrame(rows, "traj_id string, frame long, time_ps double, atom_id int, resid int, resname string, name string, element string, x double, y double, z double").cache()


def test_registered_analysis(spark, features):
    s = Session(spark)
    s.put("features", features)
    call = lambda name, **p: REGISTRY.call(s, name, **p)
    call("detect_motion_plateau", metric="u", window=10)
    call("track_guest", min_dwell=5)
    got = s.values["guest_stats"].first()
    assert (got.n_inside, got.n_entries, got.n_exits, got.first_inside, got.longest_stay) == (50, 1, 1, 60, 50)
    assert s.values["guest_events"].where("event = 'entry' AND at = 60").count() == 8
    geometry = {(r.cohort, r.feature): r for r in call("compare_guest_cage_geometry", columns=["u", "held"])["guest_cage_geometry"].collect()}
    assert geometry["one", "held"].n == 4 and geometry["one", "held"].occupancy_effect is not None
    call("guest_entry_geometry_response", columns=["held"], window=5)
    assert s.values["guest_entry_response"].count() == 11
    made = call("changepoint_feature_groups", groups=["combined"], cost="l2", penalty=20.0)
    assert made["breakpoints"].where("frame IN (50, 100)").count() == 16
    call("guest_event_cotiming", tolerance=12)
    call("compare_changepoint_timing")
    call("cluster_changepoint_segments")
    assert s.values["clusters"].select("chosen_k").first()[0] >= 2
    call("summarize_changepoint_results")
    assert s.values["state_paths"].count() == 8
    call("attribute_endpoint_transitions", grp="combined", columns=["u", "v"])
    assert s.values["transition_ranking"].count() > 0
    assert s.values["transition_ranking"].select("rank").agg(F.min("rank")).first()[0] == 1
    call("audit_cluster_replicas")
    call("detect_replica_outliers", value="u")
    call("rank_endpoint_pairs_at_k", grp="combined")
    call("scan_endpoint_cluster_chemical_k", grp="combined")
    call("select_physical_k", grp="combined", columns=["held"], draws=20)
    assert s.values["physical_scan"].where("out_of_bag > 0.5").count() > 0
    call("validate_endpoint_clusters", repeats=1, splits=2)
    assert s.values["cluster_validation"].first().balanced_accuracy > 0.8
    call("check_merge_dilution")
    call("bootstrap_core_match", grp="combined", a=1, b=2, draws=5)
    assert s.values["core_bootstrap"].count() == 5
    call("label_frames", grp="combined")
    s.put("labelled_frames", s.values["labelled_frames"].withColumn("structure", F.when(F.col("u") > 6, "A").otherwise("B")).withColumn("e1", F.lit(8.0)).withColumn("p1", F.lit(1.0)))
    call("categorize_cluster_mixtures", category="structure")
    profiles = call("describe_endpoint_clusters", structure="structure", edges=["e1"], poles=["p1"])["cluster_profiles"].collect()
    assert all(r.structure_name.startswith("belt broken along e1") for r in profiles)
    call("audit_cluster_replicas")
    ranking = call("rank_metastable_structures", grp="combined")["structure_ranking"].orderBy("rank").collect()
    assert abs(sum(r.percent for r in ranking) - 100) < 1e-9 and [r.rank for r in ranking] == list(range(1, len(ranking) + 1)) and ranking[0].n_frames >= ranking[-1].n_frames
    assert call("summarize_metastable_structures")["structure_summary"].where("structure_name IS NOT NULL").count() == len(ranking)
    assert call("select_chemical_k")["chemical_k_selected"].count() == 1
    call("compare_endpoint_cluster_k", k_from=2, k_to=3)
    splits = s.values["k_splits"].collect()
    assert all(abs(sum(x.share for x in splits if x.from_cluster == r.from_cluster and x.grp == r.grp) - 1) < 1e-9 for r in splits)
    cohorts = call("compare_endpoint_clusters_across_cohorts")["cohort_clusters"].collect()
    assert sum(r.n_segments for r in cohorts) == s.values["clusters"].count()
    call("run_gsa_step1_cluster_k", by=["grp"], k_from=2, k_to=3)
    assert s.values["cohort_cuts"].count() == s.values["segment_cuts"].count()
    s.put("features", s.values["features"].withColumn("structure", F.when(F.col("u") > 6, "A").otherwise("B")).withColumn("e1", F.lit(8.0)).withColumn("p1", F.lit(1.0)))
    whole = call("run_metastable_pipeline", grp="combined", columns=["held"], structure="structure", edges=["e1"], poles=["p1"], draws=20)
    assert whole["structure_summary"].orderBy("rank").first().structure_name.startswith("belt broken along e1")
    occupancy = {r.label: r.percent for r in call("compare_metastructures", structure="structure")["structure_occupancy"].collect()}
    assert occupancy["C1"] == 0.0 and abs(sum(occupancy.values()) - 100) < 1e-9
    call("sweep_changepoint_penalty", groups=["combined"], points=4)
    call("assembly_qc", spread="u", component="n_guest_inside_cavity", most=100.0, least=0)
    assert s.values["features"].count() == 1200 and len(s.log) > 20


def test_registered_geometry(spark, atoms):
    s = Session(spark)
    s.put("atoms", atoms)
    call = lambda name, **p: REGISTRY.call(s, name, **p)
    for name in ("compute_rg", "compute_rmsd", "align", "compute_rmsf", "compute_contacts", "contact_graph", "compute_strain", "compute_cube_metrics", "find_endpoints", "compute_endpoint_distances"):
        for out in call(name).values():
            assert out.count() > 0, name
    call("compute_volume", spacing=1.0)
    call("endpoint_volume_correlation")
    call("compute_layered_interactions", cutoff=5.0)
    assert s.values["correlation"].count() == 6 * 4 and s.values["interface_stability"].count() == 6
    call("run_trajectory_observer_pass", metrics=["rg", "extent"], selection="resid < 2", start=2, stop=8, step=2)
    assert s.values["observer_pass_results"].count() == 3
    call("compute_pca", components=2)
    call("cluster_frames", k_max=3)
    call("markov_states", n_micro=4, n_macro=2)
    call("select_frames", most=5, apart=0.0)
    assert s.values["selected_frames"].count() == 5
    made = call("compute_cage_features")["features"]
    assert made.count() == 12 and "assembly_rg" in made.columns and "com_octahedrality" in made.columns
    assert "run_changepoint_pipeline" in REGISTRY.available(s)


def test_state_model(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{t}", i, [float(v) for v in 5 * ((i // 20 + t) % 3) * np.eye(4)[(i // 20 + t) % 3] + rng.normal(0, 0.1, 4)]) for t in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "traj_id string, frame long, x array<double>")
    for projection in ("pca", "tica"):
        out = states.StateModel(df, projection=projection, components=2, n_micro=9, n_macro=3).run()
        assert out["quality"]["occupied_macro"] == 1.0
        assert out["matrix"].count() == 9 and out["transitions"].agg(F.sum("n")).first()[0] == 15
    grid = states.sweep(df, "x", [6, 9], [2, 3], 2)
    assert len(grid) == 4 and all(0 <= g["gini"] < 1 for g in grid)


def test_structures_helpers(spark):
    r = spark.createDataFrame([(1, 2, 0.97), (2, 3, 0.5)], "a int, b int, best_r double")
    assert structures.merge_families(r) == {"1": 0, "2": 0, "3": 1}
    f = spark.createDataFrame([("a", 1, True, 1.0), ("b", 1, True, 2.0), ("c", 1, False, 3.0)], "k string, x int, s boolean, y double")
    assert structures.held_out_columns(f, ["x", "y"], "s") == ["y"]
    ev = guests.events(spark.createDataFrame([("t", i, int(3 <= i < 9)) for i in range(12)], "traj_id string, frame long, g int"), "g", min_dwell=3)
    assert sorted((e.event, e["at"]) for e in ev.collect()) == [("entry", 3), ("exit", 9)]


def test_metastable_parts(spark):
    cuts = spark.createDataFrame([("c1", "a", k, q, lab, s) for q, s in ((2, 0.5), (3, 0.7), (4, 0.7)) for k in range(6) for lab in [k % q]], "cohort string, traj_id string, segment_id int, k int, cluster_label int, silhouette double")
    assert [(r.cohort, r.peak_k) for r in metastable.silhouette_peaks(cuts).collect()] == [("c1", 3)]
    got = {(r.from_cluster, r.to_cluster): (r.n_segments, r.n_parts) for r in metastable.k_splits(cuts, 2, 4).collect()}
    assert got == {(0, 0): (2, 2), (0, 2): (1, 2), (1, 1): (2, 2), (1, 3): (1, 2)}
    seg = spark.createDataFrame([("c1", "a", 10, 0, 1.0), ("c1", "b", 30, 0, 2.0), ("c1", "b", 20, 1, None)], "cohort string, traj_id string, n_frames int, cluster_label int, x double")
    d = metastable.segment_dynamics(seg).first()
    assert (d.n_series, d.n_segments, d.mean_length, d.median_length, d.segments_per_series) == (2, 3, 20.0, 20.0, 1.5)
    a = {r.cluster_label: r for r in metastable.compare_across_cohorts(seg, ["x"], least=2).collect()}
    assert abs(a[0].x - 1.75) < 1e-12 and a[1].x is None and a[1].low_confidence and not a[0].low_confidence and abs(a[0].frame_share - 2 / 3) < 1e-12
    spread = metastable.geometry_spread(seg, ["x"]).first()
    assert (spread["mean"], spread["min"], spread["max"]) == (1.5, 1.0, 2.0)
    frames = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 2)], "traj_id string, cluster_label int")
    merged = {r.family: (r.n_frames, r.n_clusters, r.n_series) for r in metastable.rank_structures(frames, seg, families={"0": 7, "2": 7}).collect()}
    assert merged == {"7": (3, 2, 2), "1": (1, 1, 1)}
    square = spark.createDataFrame([(0, [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [0.0, 3.0, 0.0]])], "frame int, positions array<array<double>>")
    sym = {r.relabelling: r.admissible for r in metastable.cage_symmetry(square, [[0, 1, 2, 3], [3, 2, 1, 0]], 0.1).collect()}
    assert sym == {0: True, 1: False}
    r = metastable.correlate_means(spark.createDataFrame([("c", 1.0, 2.0), ("c", 2.0, 4.0), ("c", 3.0, 6.5)], "cohort string, a double, b double"), ["a"], ["b"]).first()
    assert r.n == 3 and abs(r.r - np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]) < 1e-12


def test_rescoring(spark):
    runs = spark.createDataFrame([("r1", 2, 1, 5.0, 1.0, 3.0, 0.2, 0.1, 0, 0.3, 9, 0.9), ("r2", 0, 0, 7.0, 0.0, 0.0, None, None, 0, None, 0, 0.1)], "simulation_id string, n_entries int, n_exits int, volume_mean double, volume_std double, volume_range double, r_max double, r_mean double, n_strong long, dist_cv double, n_dist long, overall_score double")
    volumes = spark.createDataFrame([("r1", 10.0), ("r1", 14.0)], "simulation_id string, volume double")
    pairs = spark.createDataFrame([("r1", 0, 1, -0.8), ("r1", 1, 0, -0.8), ("r1", 0, 2, 0.4)], "simulation_id string, i int, j int, r double")
    guests = spark.createDataFrame([("r2", 3, 1, 30.0, 10.0)], "simulation_id string, n_entries int, n_exits int, residence double, outside double")
    loaded = {r.simulation_id: r for r in rescoring.load_sides(runs, volumes, pairs, guests=guests).collect()}
    assert (loaded["r1"].volume_mean, loaded["r1"].volume_std, loaded["r1"].volume_range) == (12.0, 2.0, 4.0) and loaded["r2"].volume_mean == 7.0
    assert (loaded["r1"].r_max, loaded["r1"].n_strong) == (0.8, 1) and abs(loaded["r1"].r_mean - 0.6) < 1e-12
    assert (loaded["r2"].n_entries, loaded["r2"].residence, loaded["r1"].n_entries) == (3, 30.0, 2)
    again = {r.simulation_id: r for r in rescoring.rescore(runs, True, volumes=volumes, guests=guests).collect()}
    assert again["r2"].is_valid and again["r2"].guest_score > again["r1"].guest_score and again["r1"].overall_score != 0.9
    v = [r.volume for r in rescoring.volume_from_metrics(runs.withColumn("volume_max", F.lit(5.5)), n=50).where("simulation_id = 'r1'").orderBy("frame").collect()]
    assert np.allclose(v, np.clip(5 + np.sin(np.linspace(0, 4 * np.pi, 50)), 5, 5.5))


def test_attachments(spark):
    frames = spark.createDataFrame([("BHHpH_run1", 0), ("run1", 1), ("run2", 0)], "traj_id string, frame int")
    counts = spark.createDataFrame([("run1_gsa_features", 0, 2), ("run1_gsa_features", 0, 3), ("run1", 1, 1)], "traj_id string, frame int, n_open int")
    assert {(r.traj_id, r.frame): r.n_open for r in joins.attach_open_counts(frames, counts).collect()} == {("BHHpH_run1", 0): 2, ("run1", 1): 1, ("run2", 0): None}
    occ = spark.createDataFrame([("run2", 0, 1), ("run2", 0, 4)], "traj_id string, frame int, n int")
    assert {(r.traj_id, r.n) for r in joins.attach_occupancy(frames, occ, "n").collect()} == {("BHHpH_run1", None), ("run1", None), ("run2", 1)}
    steps = joins.attach_energies(spark.createDataFrame([(1, 0.5), (2, 0.6)], "step int, d double"), spark.createDataFrame([(2, -3.0)], "step int, e double")).collect()
    assert {(r.step, r.d, r.e) for r in steps} == {(1, 0.5, None), (2, 0.6, -3.0)}
    assert [r.grp for r in groups.missing_groups(spark.createDataFrame([("a",)], "grp string"), ["a", "b"]).collect()] == ["b"]


def test_trees_and_sinks(spark, tmp_path):
    for side, files in (("ref", {"x/a.csv": "k,v\n1,2.0\n", "x/b.csv": "k,v\n1,2.0\n", "c.csv": "k,v\n1,2\n", "only.csv": "1"}), ("new", {"x/a.csv": "k,v\n1,2.0\n", "x/b.csv": "k,v\n1,2.0000001\n", "c.csv": "k,w\n1,3\n4,4\n"})):
        for name, text in files.items():
            at = tmp_path / side / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
    got = {r.path: (r.state, r.n_cells) for r in tables.compare_trees(spark, str(tmp_path / "ref"), str(tmp_path / "new")).collect()}
    assert got == {"x/a.csv": ("identical", 0), "x/b.csv": ("within", 0), "c.csv": ("differs", 4), "only.csv": ("missing", 0)}
    path = str(tmp_path / "scores")
    spark.range(3).write.parquet(path)
    sinks.replace_source(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    cuts = spark.createDataFrame([("g", "a", 0, 2, 1, 0.5), ("g", "a", 0, 3, 2, 0.4)], "grp string, traj_id string, segment_id int, k int, cluster_label int, silhouette double")
    sinks.write_cuts(spark.createDataFrame([("g", "a", 0, 7.0)], "grp string, traj_id string, segment_id int, u_mean double"), cuts, str(tmp_path / "cuts"))
    one = spark.read.parquet(str(tmp_path / "cuts/segments")).where("k = 3")
    assert one.first().cluster_label == 2 and len(one.inputFiles()) == 2
    sinks.write_states({"labels": cuts}, {"n_micro": 5, "lag": 1}, str(tmp_path / "states"))
    assert spark.read.json(str(tmp_path / "states/settings")).first().n_micro == 5 and spark.read.parquet(str(tmp_path / "states/labels")).count() == 2


def test_feature_tables(spark, atoms):
    guest = spark.createDataFrame([("t", f, float(f), 100 + g, 50 + g, "IOD", "I", "I", 1.0 + 9.0 * g, 1.0, 1.0) for f in range(12) for g in range(2 if f % 2 else 1)], atoms.schema)
    s = Session(spark)
    s.put("atoms", atoms.unionByName(guest))
    REGISTRY.call(s, "compute_gsa_features", main="resname = 'MOL'", guest="resname = 'IOD'", solvent="resname = 'IOD'", head="atom_id % 5 = 0", tail="atom_id % 5 = 4")
    rows = s.values["features"].orderBy("frame").collect()
    assert len(rows) == 12 and {"assembly_rg", "com_mean", "total_contacts", "guest_inside", "axis_cos_mean"} <= set(s.values["features"].columns)
    assert rows[0].assembly_rmsd_to_ref < 1e-9 and 0 < rows[1].assembly_rmsd_to_ref < 0.3
    assert [r.n_guest_inside_cavity for r in rows] == [1 + (f % 2) * 0 for f in range(12)] and [r.guest_bulk + r.guest_near_outer + r.guest_inside + r.guest_near_inner >= 1 for r in rows] == [True] * 12
    motifs = spark.createDataFrame([("ring", a) for a in (0, 1, 2, 3)] + [("pole", a) for a in (4, 9, 14)], "motif string, atom_id int")
    units = spark.createDataFrame([("pi", "a", 0, 19), ("pi", "b", 0, 1), ("d1", "e", 5, 15)], "kind string, unit string, atom_a int, atom_b int")
    s.put("motifs", motifs)
    s.put("motif_units", units)
    got = REGISTRY.call(s, "compute_murata_motif_rmsd")["motif_rmsd"].orderBy("frame").collect()
    xyz = {(r.frame, r.atom_id): np.array([r.x, r.y, r.z]) for r in atoms.collect()}
    from framewright.kernels import geometry as G

    for r in got:
        now, ref = (np.array([xyz[f, a] for a in (0, 1, 2, 3)]) for f in (r.frame, 0))
        assert abs(r.rmsd_ring - G.rmsd_superposed(now, ref)) < 1e-9
        d = {k: np.linalg.norm(xyz[r.frame, a] - xyz[r.frame, b]) for k, a, b in (("pi_a", 0, 19), ("pi_b", 0, 1), ("d1_e", 5, 15))}
        assert all(abs(r[k] - v) < 1e-9 for k, v in d.items())
        assert r.n_open == sum(d[k] >= 6.5 for k in ("pi_a", "pi_b")) and r.n_elongated == int(d["d1_e"] >= 7.0)
