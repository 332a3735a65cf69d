import json

import pytest
from pyspark.sql import functions as F

from framewright.operators import windows
from framewright.sources import sinks, tables, trajectories
from framewright.streaming import states


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


@pytest.mark.parametrize("least", [1, 3])
def test_flips_as_in_batch(spark, tmp_path, least):
    text = {"a": "0110111100001111", "b": "1110001", "c": "0"}
    rows = [(k, i, float(i), c == "1") for k, s in text.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, i long, t double, on boolean")
    for part in range(4):  # files arrive in order of time
        df.where((F.col("i") >= 4 * part) & (F.col("i") < 4 * part + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.key, r["at"], r.event) for r in drain(states.debounced_flips(stream, "k", "i", "t", "on", least), f"flips{least}"))
    want = sorted((r.k, r["at"], r.event) for r in windows.debounced_events(df, "k", "i", "on", least).collect())
    assert got == want


def test_set_changes(spark, tmp_path):
    rows = [("a", 0, ["x"]), ("a", 1, ["x", "y"]), ("a", 2, ["y"]), ("b", 0, [])]
    df = spark.createDataFrame(rows, "k string, i long, m array<string>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted((r.key, r["at"], r.event, r.member) for r in drain(states.set_changes(stream, "k", "i", "m"), "changes"))
    assert got == [("a", 0, "entry", "x"), ("a", 1, "entry", "y"), ("a", 2, "exit", "x")]


def test_sessions(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01 00:00:00'), (1, TIMESTAMP'2024-01-01 00:10:00'), (1, TIMESTAMP'2024-01-01 02:00:00'), (2, TIMESTAMP'2024-01-01 05:00:00') AS v(u, ts)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = drain(states.sessions(stream, "u", "ts"), "visits", "complete")
    assert sorted((r.u, r.n) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_feature_files(spark, tmp_path):
    for name, body in (("BHHpH_7_v_gsa_features.csv", "frame,time_ps,rg\n0,0.0,1.5\n1,1.0,nan\n"), ("BMMpM_8_v_gsa_features.csv", "frame,time_ps,rg\n0,0.0,2.5\n")):
        (tmp_path / name).write_text(body)
    df = tables.read_features(spark, str(tmp_path / "*_gsa_features.csv"), "frame long, time_ps double, rg double")
    got = sorted(((r.traj_id, r.cohort, r.frame, r.rg) for r in df.collect()), key=str)
    assert got == [("7_v", "BHHpH", 0, 1.5), ("7_v", "BHHpH", 1, None), ("8_v", "BMMpM", 0, 2.5)]
    ids = tables.unique_ids(spark.createDataFrame([("a/x.nc",), ("b/x.nc",), ("c/y.nc",)], "path string"))
    assert sorted(r.traj_id for r in ids.collect()) == ["x", "x_1", "y"]


def test_logs_and_manifests(spark, tmp_path):
    (tmp_path / "ham.dat").write_text("# step energy\n 0  -1.5 \n\n 1 -2.5\nend x\n")
    got = tables.read_energy_log(spark, str(tmp_path / "ham.dat"), ["step", "energy"]).collect()
    assert [(r.step, r.energy) for r in got] == [(0.0, -1.5), (1.0, -2.5)]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "m.json").write_text(json.dumps({"name": "one", "note": "alpha"}))
    assert tables.read_manifests(spark, str(tmp_path / "runs"), contains="alpha").count() == 1
    assert tables.read_manifests(spark, str(tmp_path / "runs"), name="two").count() == 0


def test_xyz_and_pdb(spark, tmp_path):
    frame = lambda s, d: f"4\nstep={s}\nN 0 0 {d}\nH 1 0 {d}\nN 0 0 {d + 2}\nH 1 0 {d + 2}\n"
    (tmp_path / "run1.xyz").write_text(frame(10, 0) + frame(20, 1))
    beads = trajectories.read_xyz(spark, str(tmp_path / "run1.xyz"), n_beads=2)
    assert beads.count() == 8
    c = {(r.step, r.atom_id): r.z for r in trajectories.centroid_of(beads).collect()}
    assert c == {(10, 0): 1.0, (10, 1): 1.0, (20, 0): 2.0, (20, 1): 2.0}
    assert all(abs(r.spread - 1) < 1e-12 for r in trajectories.bead_spread(beads).collect())
    atoms = spark.createDataFrame([("t", 0, 0.0, 1, 5, "MOL", "CA", "C", 1.0, 2.0, 3.5), ("t", 0, 0.0, 2, 5, "MOL", "N", "N", -1.0, 0.25, 9.0)], "traj_id string, frame long, time_ps double, atom_id int, resid int, resname string, name string, element string, x double, y double, z double")
    sinks.write_pdb(atoms, str(tmp_path / "pdb"))
    text = "\n".join(r.value for r in spark.read.option("wholetext", "true").text(str(tmp_path / "pdb")).collect())
    (tmp_path / "t.pdb").write_text(text)
    back = trajectories.read_pdb(spark, str(tmp_path / "t.pdb")).orderBy("atom_id").collect()
    assert [(r.atom_id, r.resid, r.resname, r.name, r.x, r.y, r.z) for r in back] == [(1, 5, "MOL", "CA", 1.0, 2.0, 3.5), (2, 5, "MOL", "N", -1.0, 0.25, 9.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "traj_id string, v int")
    path = str(tmp_path / "out")
    sinks.write_by(df, path)
    sinks.upsert_by(spark.createDataFrame([("b", 5), ("c", 6)], "traj_id string, v int"), path)
    assert sorted((r.traj_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5), ("c", 6)]
    sinks.write_tables({"x": df, "y": spark.range(3)}, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all" / "y")).count() == 3


def test_proton_coordinate(spark):
    atoms = spark.createDataFrame([("t", 0, 0, 0.0, 0.0, 0.0), ("t", 0, 1, 1.0, 0.0, 0.0), ("t", 0, 2, 3.0, 0.0, 0.0)], "traj_id string, frame long, atom_id int, x double, y double, z double")
    assert trajectories.proton_coordinate(atoms, 0, 1, 2).first().delta == -1.0
