"""Schemas of the tables that operators hand to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Keys of a per-frame table; every other numeric column is a feature.
META = ("traj_id", "frame", "time_ps")

ATOMS = "traj_id string, frame long, time_ps double, atom_id int, resid int, resname string, name string, element string, x double, y double, z double"
FRAMES = "traj_id string, frame long, time_ps double"
BREAKPOINTS = "traj_id string, grp string, breakpoint_idx int, signal_index int, frame long, time_ps double, n_cols_used int"
SEGMENTS = "traj_id string, grp string, segment_id int, start_frame long, end_frame long, start_ps double, end_ps double, n_frames long, n_cols_used int"
SITES = "traj_id string, monomer int, site_index int, kind string, atom_ids array<int>"

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, without: tuple[str, ...] = META) -> list[str]:
    return [c for c, kind in df.dtypes if c not in without and (kind in NUMERIC or kind.startswith("decimal"))]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
