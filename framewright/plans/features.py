"""Feature tables from atoms: all tiers of an assembly's frames, and the distances and RMSD of its motifs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ELONGATED_LO, OPEN_LO, metastructure
from ..operators import assemblies, geometry

FRAME = ["traj_id", "frame"]


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in FRAME})


def assembly_features(
    atoms: DataFrame,
    group: str = "resid",
    main: Column | None = None,
    guest: Column | None = None,
    solvent: Column | None = None,
    head: Column | None = None,
    tail: Column | None = None,
    molecule: str = "resid",
    cutoff: float = 4.5,
    cavity: float = 8.0,
    inner: float = 5.0,
    outer: float = 12.0,
    shell: float = 3.0,
    ref_frame: int = 0,
) -> DataFrame:
    """One row per frame: traj_id, frame, time_ps and the features of every tier whose atoms are given.

    main, guest and solvent are conditions on atoms, head and tail on main ones. Always: shape,
    regularity of group centres, contacts, distance from the reference frame. With guests:
    how many are in the cavity, their shells, and contacts with groups. With solvent: molecules near
    the assembly. With head and tail: the axes of groups and their twist.
    """
    own = atoms.where(main) if main is not None else atoms
    centres = geometry.centroids(own, [group]).select(*FRAME, group, "x", "y", "z")
    middle = own.groupBy(*FRAME).agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    pos = geometry.positions(own)
    reference = pos.where(F.col("frame") == ref_frame).select("traj_id", "positions", "atom_ids")
    parts = [
        _named(geometry.shapes(own), "assembly"),
        _named(geometry.neighbour_statistics(centres, group), "com"),
        geometry.contact_summary(own, group, cutoff),
        geometry.rmsd_to_reference(pos, reference).select(*FRAME, F.col("rmsd").alias("assembly_rmsd_to_ref")),
    ]
    if guest is not None:
        some = geometry.centroids(atoms.where(guest), [molecule]).select(*FRAME, molecule, "x", "y", "z")
        inside = geometry.radial_counts(some, middle, cavity, name="n_guest_inside_cavity")
        parts.append(inside.withColumnsRenamed({c: f"guest_radial_{c}" for c in ("mean", "std", "min", "max")}))
        parts.append(_named(geometry.guest_shells(some, middle, inner, outer, shell).drop("mean", "std", "min", "max"), "guest"))
    if solvent is not None:
        near = assemblies.near_molecules(atoms.where(solvent), own, molecule)
        parts.append(_named(near, "solvent"))
    if head is not None and tail is not None:
        axis = assemblies.axes(own, group, head, tail)
        parts.append(_named(assemblies.axis_statistics(axis), "axis"))
        parts.append(assemblies.twist(axis, group))
    times = atoms.groupBy(*FRAME).agg(F.min("time_ps").alias("time_ps"))
    out = reduce(lambda a, b: a.join(b, FRAME, "left"), parts, times)
    return out.fillna(0, [c for c in out.columns if c.startswith(("n_guest", "guest_inside", "guest_near", "guest_bulk"))])


def unit_distances(atoms: DataFrame, units: DataFrame) -> DataFrame:
    """Per frame and unit (kind, unit, atom_a, atom_b) the distance of its two atoms."""
    at = atoms.select(*FRAME, "atom_id", "x", "y", "z")
    a = at.join(F.broadcast(units), at["atom_id"] == units["atom_a"]).select(*FRAME, "kind", "unit", "atom_b", *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = at.select(*(F.col(c).alias(f"__{c}") for c in FRAME), F.col("atom_id").alias("__b"), "x", "y", "z")
    met = a.join(b, (F.col("traj_id") == F.col("__traj_id")) & (F.col("frame") == F.col("__frame")) & (F.col("atom_b") == F.col("__b")))
    d = F.sqrt(sum(((F.col(c) - F.col(f"a{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return met.select(*FRAME, "kind", "unit", d.alias("distance"))


def motif_rmsd(atoms: DataFrame, motifs: DataFrame, units: DataFrame, ref_frame: int = 0, contact: str = "pi", edge: str = "d1") -> DataFrame:
    """Per frame the distance of each motif from itself in the reference frame after superposition, the distances of its units, how many contacts are open and edges elongated, and the metastructure.

    motifs has motif and atom_id; units has kind, unit, atom_a and atom_b, as they pair in
    the reference frame: tables of a molecule's size. Columns are rmsd_<motif> and <kind>_<unit>.
    """
    names = sorted(r[0] for r in motifs.select("motif").distinct().collect())
    columns = sorted({f"{r['kind']}_{r['unit']}" for r in units.select("kind", "unit").distinct().collect()})
    pos = geometry.positions(atoms.join(F.broadcast(motifs), "atom_id"), [*FRAME, "motif"])
    reference = pos.where(F.col("frame") == ref_frame).select("traj_id", "motif", "positions", "atom_ids")
    moved = geometry.rmsd_to_reference(pos, reference, key=("traj_id", "motif"))
    wide = moved.groupBy(*FRAME).pivot("motif", names).agg(F.first("rmsd")).withColumnsRenamed({n: f"rmsd_{n}" for n in names})
    each = unit_distances(atoms, units)
    d = F.col("distance")
    counts = each.groupBy(*FRAME).agg(F.count_if((F.col("kind") == contact) & (d >= OPEN_LO)).cast("int").alias("n_open"), F.count_if((F.col("kind") == edge) & (d >= ELONGATED_LO)).cast("int").alias("n_elongated"))
    spread = each.withColumn("column", F.concat_ws("_", "kind", "unit")).groupBy(*FRAME).pivot("column", columns).agg(F.first("distance"))
    times = atoms.groupBy(*FRAME).agg(F.min("time_ps").alias("time_ps"))
    out = reduce(lambda a, b: a.join(b, FRAME, "left"), (wide, spread, counts), times)
    return out.withColumn("structure", metastructure(F.col("n_open"), F.col("n_elongated")))
