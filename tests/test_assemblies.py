import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import assemblies, geometry, joins, statistics, windows
from framewright.plans.runlog import RunLog


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    kinds = ["N", "O", "C", "H"]
    rows = [("t", f, i, i // 6, "MOL", kinds[i % 4], *map(float, rng.uniform(-4, 4, 3))) for f in range(3) for i in range(24)]
    return rows, spark.createDataFrame(rows, "traj_id string, frame long, atom_id int, resid int, resname string, element string, x double, y double, z double").cache()


def test_interfaces_and_guests(spark, cloud):
    rows, atoms = cloud
    e = F.col("element")
    got = {(r.frame, r.i, r.j): r for r in assemblies.interface_chemistry(atoms, "resid", e == "N", e == "O", e == "C", e == "H", e == "O").collect()}
    for f in range(3):
        for i in range(4):
            for j in range(i + 1, 4):
                pairs = [(p, q, math.dist(p[6:], q[6:])) for p in rows for q in rows if p[1] == q[1] == f and p[3] == i and q[3] == j]
                hb = sum(d < 3.5 and {p[5], q[5]} == {"N", "O"} for p, q, d in pairs)
                hy = sum(d < 4.5 and p[5] == q[5] == "C" for p, q, d in pairs)
                sb = sum(d < 4.0 and {p[5], q[5]} == {"H", "O"} for p, q, d in pairs)
                r = got.get((f, i, j))
                assert (hb, hy, sb) == ((r.hbonds, r.hydrophobic, r.salt_bridges) if r else (0, 0, 0))
    guest = atoms.where("resid = 0").withColumn("m", F.col("atom_id"))
    host = atoms.where("resid > 0")
    got = {r.frame: r for r in assemblies.guest_contacts(guest, host, "m", "resid", 4.0).collect()}
    for f in range(3):
        g = [p for p in rows if p[1] == f and p[3] == 0]
        touched = [{q[3] for q in rows if q[1] == f and q[3] > 0 and math.dist(p[6:], q[6:]) < 4.0} for p in g]
        assert got[f].bridging_2 == sum(len(t) == 2 for t in touched) and got[f].mediated == sum(len(t) * (len(t) - 1) // 2 for t in touched)
        assert got[f].groups_touched == len(set().union(*touched))
    assert assemblies.near_molecules(guest, host, "m").count() > 0


def test_axes_and_segregation(spark, cloud):
    rows, atoms = cloud
    e = F.col("element")
    axis = assemblies.axes(atoms, "resid", e == "N", e == "C")
    p = np.array([r[6:] for r in rows if r[1] == 0 and r[3] == 1])
    k = np.array([r[5] for r in rows if r[1] == 0 and r[3] == 1])
    v = p[k == "N"].mean(axis=0) - p[k == "C"].mean(axis=0)
    got = axis.where("frame = 0 AND resid = 1").first()
    assert np.allclose(got.axis, v / np.linalg.norm(v))
    out = p.mean(axis=0) - np.array([r[6:] for r in rows if r[1] == 0]).mean(axis=0)
    assert abs(got.radial_cos - v @ out / np.linalg.norm(v) / np.linalg.norm(out)) < 1e-9
    assert assemblies.axis_statistics(axis).count() == 3
    twist = {r.frame: r.twist_std for r in assemblies.twist(axis, "resid").collect()}
    assert twist[0] is None and twist[1] > 0
    centres = atoms.groupBy("traj_id", "frame").agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    s = assemblies.segregation(atoms, centres, e == "N", e == "C").where("frame = 0").first()
    assert abs(s.difference - (s.philic - s.phobic)) < 1e-12
    assert assemblies.dipole(atoms, centres).where("dipole < 1e-9").count() == 3
    assert assemblies.inner_atoms(atoms, centres).count() == 3


def test_symmetry(spark):
    octahedron = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0], [0, -1, 0], [0, 0, -1.0]])
    df = spark.createDataFrame([("t", 0, octahedron.tolist())], "traj_id string, frame long, positions array<array<double>>")
    perms = [(0, 1, 2, 3, 4, 5), (1, 3, 2, 4, 0, 5), (1, 0, 2, 3, 4, 5)]
    got = {r.relabelling: r.rmsd for r in assemblies.relabelling_rmsd(df, perms).collect()}
    assert got[0] < 1e-9 and got[1] < 1e-9 and got[2] > 0.1
    pairs = [(0, 3, 1, 6), (1, 3, 0, 6), (0, 3, 2, 6), (1, 3, 2, 6)]
    assert assemblies.column_mappings(pairs, [(0, 1, 2), (1, 0, 2)]).tolist() == [[0, 1, 2, 3], [1, 0, 3, 2]]
    two = spark.createDataFrame([(0, octahedron.tolist()), (1, (octahedron * 2).tolist())], "id int, positions array<array<double>>")
    assert abs(assemblies.pairwise_rmsd(two, "id").first().rmsd - 1) < 1e-9


def test_monomers_and_transfer(spark):
    atoms = spark.createDataFrame([("t", i, 10 + i // 2, "MOL") for i in range(12)], "traj_id string, atom_id int, resid int, resname string")
    assert [r.monomer for r in assemblies.number_monomers(atoms, "MOL", 3).orderBy("atom_id").collect()] == [0] * 4 + [1] * 4 + [2] * 4
    first = spark.createDataFrame([("t", 0, "N", 0.0, 0.0, 0.0), ("t", 1, "O", 2.6, 0.0, 0.0), ("t", 2, "H", 1.6, 0.0, 0.0), ("t", 3, "H", -1.0, 0.0, 0.0), ("t", 4, "O", 9.0, 0.0, 0.0), ("t", 5, "H", 9.9, 0.0, 0.0)], "traj_id string, atom_id int, element string, x double, y double, z double")
    got = assemblies.transfer_atoms(first).collect()
    assert [(r.donor, r.hydrogen, r.acceptor) for r in got] == [(0, 2, 1)]


def test_segments(spark, cloud):
    _, atoms = cloud
    seg = spark.createDataFrame([("t", 0, 1, 0, 1), ("t", 1, 2, 2, 2)], "traj_id string, segment_id int, cluster_label int, start_frame long, end_frame long")
    mean = assemblies.mean_structures(atoms, seg).where("segment_id = 0 AND atom_id = 5").first()
    want = atoms.where("frame < 2 AND atom_id = 5").agg(F.avg("x")).first()[0]
    assert abs(mean.x - want) < 1e-12
    edges = spark.createDataFrame([("t", f, 0, 1, v) for f, v in enumerate((5.0, 8.0, 4.6))], "traj_id string, frame long, i int, j int, d double")
    got = {r.segment_id: (r["mean"], r.n_open, r.n_frames) for r in assemblies.edges_by_segment(edges, seg, "d").collect()}
    assert got == {0: (6.5, 1, 2), 1: (4.6, 1, 1)}
    assert geometry.formation_frame(spark.createDataFrame([("t", i, n) for i, n in enumerate((1, 15, 3, 15, 16, 17))], "traj_id string, frame long, n_active int"), sustain=2).first().formation_frame == 3


def test_flips_steps_and_summaries(spark):
    df = spark.createDataFrame([("a", 2 * i, v) for i, v in enumerate((1.0, 0.01, -1.0, -2.0, 3.0))] + [("b", 0, 0.0)], "k string, i long, v double")
    assert {r.k: r.n_flips for r in windows.sign_flips(df, "k", "i", "v").collect()} == {"a": 2, "b": 0}
    assert windows.frame_step(df, "k", "i").first().step == 2
    c = windows.contrast_summary(spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "s string, delta double"), ["s"], n=200)
    got = {r.s: r for r in c.collect()}
    assert got["x"]["mean"] == 2 and got["x"].low >= 1 and got["y"].low == got["y"].high == 5


def test_labels_discriminants_nesting(spark):
    t = spark.createDataFrame([("x", 1, 9), ("x", 2, 8), ("y", 1, 8), ("y", 2, 1)], "a string, b int, n long")
    assert sorted((r.a, r.b) for r in statistics.map_labels(t).collect()) == [("x", 2), ("y", 1)]
    rng = np.random.default_rng(1)
    rows = [("g", f"t{i % 4}", i % 2, float(3 * (i % 2) + rng.normal()), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, traj_id string, l int, u double, v double").withColumn("traj_id", F.concat("traj_id", (F.rand(1) > 0.5).cast("string")))
    got = statistics.discriminant(df, ["u", "v"], "l", ["g"]).collect()
    load = {r.feature: abs(r.loading) for r in got}
    assert load["u"] > 3 * load["v"] and got[0].balanced_accuracy > 0.85
    blocks = spark.createDataFrame([("g", i // 5, int(i >= 50), float(4 * (i >= 50) + rng.normal())) for i in range(100)], "g string, b int, l int, v double")
    assert statistics.energy_permutation(blocks, ["v"], "l", "b", ["g"]).first().p < 0.02
    inner = spark.createDataFrame([("a", 10), ("a", 50), ("b", 30)], "traj_id string, frame long")
    outer = spark.createDataFrame([("a", 11), ("b", 52), ("b", 90)], "traj_id string, frame long")
    got = {r.traj_id: (r.nested, r.cross_null) for r in joins.nesting(inner, outer, 3).collect()}
    assert got == {"a": (0.5, 0.5), "b": (0.0, 0.0)}


def test_run_log(tmp_path):
    log = RunLog(str(tmp_path), "one", cube="x")
    with log.step("detect"):
        pass
    with pytest.raises(ValueError), log.step("bad"):
        raise ValueError("no")
    log.close()
    events = [json.loads(x) for x in log.path.read_text().splitlines()]
    assert [e["event"] for e in events] == ["run_start", "step_start", "step_end", "step_start", "step_failed", "run_end"]
