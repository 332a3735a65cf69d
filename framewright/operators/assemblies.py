"""Features of assemblies of like molecules and their guests: axes, segregation, interface chemistry, symmetry."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm, unit
from ..kernels import geometry as G
from .geometry import FRAME, GUEST_CONTACT, HBOND, SALT_BRIDGE
from .joins import distance_join


def _distance(prefix: str = "c") -> Column:
    return F.sqrt(sum(((F.col(a) - F.col(f"{prefix}{a}")) ** 2 for a in "xyz"), F.lit(0.0)))


def number_monomers(atoms: DataFrame, resname: str, n: int | None = None) -> DataFrame:
    """Atoms of one residue name with a monomer number from 0, by residue; with n, residues are dealt to n monomers in order."""
    some = atoms.where(F.col("resname") == resname)
    ids = some.select("traj_id", "resid").distinct()
    w = W.partitionBy("traj_id").orderBy("resid")
    rank = ids.withColumn("__r", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(W.partitionBy("traj_id")))
    number = F.floor(F.col("__r") * n / F.col("__n")) if n else F.col("__r")
    return some.join(rank.select("traj_id", "resid", number.cast("int").alias("monomer")), ["traj_id", "resid"])


def axes(atoms: DataFrame, group: str, head: Column, tail: Column, frame: Sequence[str] = FRAME) -> DataFrame:
    """Per group the unit vector from the centre of its tail to that of its head, and its cosine with the direction outwards."""
    at = lambda sel, a: F.avg(F.when(sel, F.col(a)))
    own = atoms.groupBy(*frame, group).agg(F.array(*(at(head, a) - at(tail, a) for a in "xyz")).alias("v"), F.array(*(F.avg(a) for a in "xyz")).alias("c"))
    whole = atoms.groupBy(*frame).agg(F.array(*(F.avg(a) for a in "xyz")).alias("m"))
    met = own.join(whole, list(frame)).withColumn("axis", unit(F.col("v")))
    out = F.zip_with("c", "m", lambda a, b: a - b)
    return met.select(*frame, group, "axis", F.when((norm(out) > 0) & F.col("axis").isNotNull(), cosine(F.col("axis"), out)).alias("radial_cos"))


def axis_statistics(axis: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    return axis.groupBy(*frame).agg(F.avg("radial_cos").alias("cos_mean"), F.stddev_pop("radial_cos").alias("cos_std"))


def twist(axis: DataFrame, group: str, key: str = "traj_id", order: str = "frame") -> DataFrame:
    """Per frame the deviation over groups of the angle, in degrees, between an axis and itself one frame before."""
    prev = F.lag("axis").over(W.partitionBy(key, group).orderBy(order))
    met = axis.withColumn("__p", prev).withColumn("angle", F.degrees(F.acos(cosine(F.col("axis"), F.col("__p")))))
    return met.groupBy(key, order).agg(F.stddev_pop("angle").alias("twist_std"))


def segregation(atoms: DataFrame, centres: DataFrame, philic: Column, phobic: Column, frame: Sequence[str] = FRAME) -> DataFrame:
    """Mean distances of two kinds of atoms from the centre (cx, cy, cz), and their difference."""
    met = atoms.join(centres.select(*frame, "cx", "cy", "cz"), list(frame)).withColumn("__d", _distance())
    out = met.groupBy(*frame).agg(F.avg(F.when(philic, F.col("__d"))).alias("philic"), F.avg(F.when(phobic, F.col("__d"))).alias("phobic"))
    return out.withColumn("difference", F.col("philic") - F.col("phobic"))


def inner_atoms(atoms: DataFrame, centres: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """How far the chosen atoms lie from the centre: least, mean, deviation."""
    met = atoms.join(centres.select(*frame, "cx", "cy", "cz"), list(frame)).withColumn("__d", _distance())
    return met.groupBy(*frame).agg(F.min("__d").alias("min"), F.avg("__d").alias("mean"), F.stddev_pop("__d").alias("std"))


def interface_chemistry(atoms: DataFrame, group: str, donor: Column, acceptor: Column, phobic: Column, cation: Column, anion: Column, frame: Sequence[str] = FRAME) -> DataFrame:
    """Per frame and pair of groups: donor-acceptor pairs either way (3.5), hydrophobic contacts (4.5), salt bridges (4.0); one join for all."""
    flags = {"d": donor, "a": acceptor, "h": phobic, "p": cation, "n": anion}
    slim = atoms.select(*frame, F.col(group).alias("g"), "x", "y", "z", *(F.coalesce(c, F.lit(False)).alias(f"is_{k}") for k, c in flags.items()))
    slim = slim.where(F.greatest(*(F.col(f"is_{k}").cast("int") for k in flags)) == 1)
    near = distance_join(slim, slim, frame, 4.5).where("g < b_g")
    both = lambda a, b: (F.col(f"is_{a}") & F.col(f"b_is_{b}")) | (F.col(f"is_{b}") & F.col(f"b_is_{a}"))
    d = F.col("distance")
    return near.groupBy(*frame, F.col("g").alias("i"), F.col("b_g").alias("j")).agg(F.count_if(both("d", "a") & (d < HBOND)).alias("hbonds"), F.count_if(F.col("is_h") & F.col("b_is_h")).alias("hydrophobic"), F.count_if(both("p", "n") & (d < SALT_BRIDGE)).alias("salt_bridges"))


def guest_contacts(guests: DataFrame, atoms: DataFrame, guest: str, group: str, cutoff: float = GUEST_CONTACT, frame: Sequence[str] = FRAME) -> DataFrame:
    """Per frame: contacts of guests, the nearest, groups touched, guests that bridge two and three or more groups, and interfaces they mediate."""
    near = distance_join(guests.select(*frame, F.col(guest).alias("m"), "x", "y", "z"), atoms.select(*frame, F.col(group).alias("g"), "x", "y", "z"), frame, cutoff)
    each = near.groupBy(*frame, "m").agg(F.countDistinct("b_g").alias("c"), F.count("*").alias("n"), F.min("distance").alias("d"))
    per = each.groupBy(*frame).agg(F.sum("n").alias("contacts"), F.min("d").alias("min_distance"), F.avg("c").alias("groups_mean"), F.count_if(F.col("c") == 2).alias("bridging_2"), F.count_if(F.col("c") >= 3).alias("bridging_3"), F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("mediated"))
    return per.join(near.groupBy(*frame).agg(F.countDistinct("b_g").alias("groups_touched")), list(frame))


def near_molecules(molecules: DataFrame, atoms: DataFrame, molecule: str, cutoff: float = HBOND, frame: Sequence[str] = FRAME) -> DataFrame:
    """Per frame the molecules with an atom near any of the atoms, and the contacts."""
    near = distance_join(molecules.select(*frame, molecule, "x", "y", "z"), atoms.select(*frame, "x", "y", "z"), frame, cutoff)
    return near.groupBy(*frame).agg(F.countDistinct(molecule).alias("n_molecules"), F.count("*").alias("n_contacts"))


def dipole(points: DataFrame, centres: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """How far the mean of the points lies from the centre: their lopsidedness."""
    met = points.groupBy(*frame).agg(*(F.avg(a).alias(a) for a in "xyz")).join(centres.select(*frame, "cx", "cy", "cz"), list(frame))
    return met.select(*frame, _distance().alias("dipole"))


def mean_structures(atoms: DataFrame, segments: DataFrame, label: str = "cluster_label") -> DataFrame:
    """The mean place of every atom over the frames of each segment."""
    from .joins import interval_join

    met = interval_join(atoms, segments.select("traj_id", "segment_id", label, "start_frame", "end_frame"), ["traj_id"], "frame")
    return met.groupBy("traj_id", "segment_id", label, "atom_id").agg(*(F.avg(a).alias(a) for a in "xyz"))


def pairwise_rmsd(structures: DataFrame, id: str, positions: str = "positions") -> DataFrame:
    """The superposed distance of every two structures: representatives, so few."""
    a = structures.select(F.col(id).alias("i"), F.col(positions).alias("__a"))
    b = structures.select(F.col(id).alias("j"), F.col(positions).alias("__b"))

    @F.pandas_udf("double")
    def kernel(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([G.rmsd_superposed(np.stack(x).astype(float), np.stack(y).astype(float)) for x, y in zip(p, q)])

    return a.join(b, F.col("i") < F.col("j")).select("i", "j", kernel("__a", "__b").alias("rmsd"))


def relabelling_rmsd(frames: DataFrame, permutations: Sequence[Sequence[int]], positions: str = "positions") -> DataFrame:
    """Per frame and relabelling of points the distance of the relabelled points from themselves after superposition, reflections told apart."""
    perms = [list(map(int, p)) for p in permutations]

    @F.pandas_udf("array<double>")
    def kernel(p: pd.Series) -> pd.Series:
        return pd.Series([[G.rmsd_superposed(x[m], x) for m in perms] for x in (np.stack(v).astype(float) for v in p)])

    keys = [c for c in frames.columns if c != positions]
    return frames.select(*keys, F.posexplode(kernel(positions)).alias("relabelling", "rmsd"))


def column_mappings(pairs: Sequence[tuple[int, int, int, int]], permutations: Sequence[Sequence[int]]) -> np.ndarray:
    """For each relabelling of molecules the order of the pair columns (mon_i, site_a, mon_j, site_b) it brings about."""
    key = lambda i, a, j, b: frozenset(((i, a), (j, b)))
    at = {key(*p): k for k, p in enumerate(pairs)}
    return np.array([[at[key(m[i], a, m[j], b)] for i, a, j, b in pairs] for m in permutations])


def edges_by_segment(edges: DataFrame, segments: DataFrame, value: str, low: float = 4.5, high: float = 5.5, key: str = "traj_id") -> DataFrame:
    """Per segment and edge (i, j) the mean of a value, and how many frames lie in a window."""
    from .joins import interval_join

    met = interval_join(edges.select(key, "frame", "i", "j", value), segments.select(key, "segment_id", "start_frame", "end_frame"), [key], "frame")
    return met.groupBy(key, "segment_id", "i", "j").agg(F.avg(value).alias("mean"), F.count_if(F.col(value).between(low, high)).alias("n_open"), F.count("*").alias("n_frames"))


def transfer_atoms(first: DataFrame, oh: float = 1.25, nh: float = 1.25, no: float = 3.5) -> DataFrame:
    """From a first frame: each nitrogen with the nearest hydrogen that an oxygen holds, among oxygens near enough to the nitrogen."""
    at = lambda e: first.where(F.col("element") == e).select("traj_id", "atom_id", "x", "y", "z")
    held = distance_join(at("H"), at("O"), ["traj_id"], oh, True).select("traj_id", F.col("atom_id").alias("h"), F.col("b_atom_id").alias("o"), "x", "y", "z")
    bound = distance_join(at("H"), at("N"), ["traj_id"], nh, True).select("traj_id", F.col("atom_id").alias("h"))
    free = held.join(bound, ["traj_id", "h"], "left_anti")
    near = distance_join(at("N"), at("O"), ["traj_id"], no, True).select("traj_id", F.col("atom_id").alias("n"), F.col("b_atom_id").alias("o"))
    met = free.join(near, ["traj_id", "o"]).join(at("N").select("traj_id", F.col("atom_id").alias("n"), *(F.col(a).alias(f"c{a}") for a in "xyz")), ["traj_id", "n"]).withColumn("d", _distance())
    return met.groupBy("traj_id", "n").agg(F.min_by(F.struct("h", "o"), F.struct("d", "h", "o")).alias("s"), F.min("d").alias("distance")).select("traj_id", F.col("n").alias("donor"), F.col("s.h").alias("hydrogen"), F.col("s.o").alias("acceptor"), "distance")
