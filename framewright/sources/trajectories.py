"""Trajectories as long atom tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BEADS = "traj_id string, frame long, step long, bead int, atom_id int, element string, x double, y double, z double"


def parse_xyz(text: str, n_beads: int = 1, max_frames: int | None = None):
    """Rows (frame, step, bead, atom_id, element, x, y, z) of an XYZ file whose frames stack the beads of each atom list.

    A frame of n lines holds n / n_beads atoms. The step is the number after ``step`` in
    the comment, else the frame's number.
    """
    lines = text.split("\n")
    at = frame = 0
    while at < len(lines) and (max_frames is None or frame < max_frames):
        if not lines[at].strip():
            at += 1
            continue
        n = int(lines[at])
        m = re.search(r"step\D*(\d+)", lines[at + 1], re.I)
        step = int(m[1]) if m else frame
        atoms = n // n_beads
        for k, line in enumerate(lines[at + 2 : at + 2 + n]):
            element, x, y, z = line.split()[:4]
            yield frame, step, k // atoms, k % atoms, element, float(x), float(y), float(z)
        at += n + 2
        frame += 1


def read_xyz(spark: SparkSession, path: str, n_beads: int = 1, max_frames: int | None = None) -> DataFrame:
    """Extended XYZ files, one task each; see parse_xyz. The beads' mean is ``centroid_of``."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = list(parse_xyz(bytes(content).decode(), n_beads, max_frames))
                if rows:
                    out = pd.DataFrame(rows, columns=["frame", "step", "bead", "atom_id", "element", "x", "y", "z"])
                    out.insert(0, "traj_id", re.sub(r"\.[^.]*$", "", name.rpartition("/")[2]))
                    yield out

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, BEADS)


def centroid_of(beads: DataFrame) -> DataFrame:
    """Each atom at the mean place of its beads."""
    return beads.groupBy("traj_id", "frame", "step", "atom_id", "element").agg(*(F.avg(c).alias(c) for c in "xyz"))


def bead_spread(beads: DataFrame) -> DataFrame:
    """The root mean square distance of an atom's beads from their mean."""
    return beads.groupBy("traj_id", "frame", "atom_id", "element").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("spread"))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """ATOM and HETATM records of PDB files, MODEL by MODEL, one task per file."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows, frame = [], 0
                for line in bytes(content).decode().split("\n"):
                    if line.startswith(("ATOM", "HETATM")):
                        rows.append((frame, float(frame), int(line[6:11]), int(line[22:26]), line[17:20].strip(), line[12:16].strip(), line[76:78].strip() or line[12:16].strip()[:1], float(line[30:38]), float(line[38:46]), float(line[46:54])))
                    elif line.startswith("ENDMDL"):
                        frame += 1
                out = pd.DataFrame(rows, columns=["frame", "time_ps", "atom_id", "resid", "resname", "name", "element", "x", "y", "z"])
                out.insert(0, "traj_id", re.sub(r"\.[^.]*$", "", name.rpartition("/")[2]))
                yield out

    from ..schemas import ATOMS

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, ATOMS)


def proton_coordinate(atoms: DataFrame, donor: int, hydrogen: int, acceptor: int) -> DataFrame:
    """Per frame the distance hydrogen to donor minus hydrogen to acceptor; its sign tells whose the proton is."""
    at = lambda i, a: F.max(F.when(F.col("atom_id") == i, F.col(a)))
    p = atoms.where(F.col("atom_id").isin(donor, hydrogen, acceptor)).groupBy("traj_id", "frame").agg(*(at(i, a).alias(f"{n}{a}") for n, i in (("d", donor), ("h", hydrogen), ("a", acceptor)) for a in "xyz"))
    d = lambda u, v: F.sqrt(sum(((F.col(u + a) - F.col(v + a)) ** 2 for a in "xyz"), F.lit(0.0)))
    return p.select("traj_id", "frame", d("h", "d").alias("d_donor"), d("h", "a").alias("d_acceptor"), (d("h", "d") - d("h", "a")).alias("delta"))
