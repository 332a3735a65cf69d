"""Which columns of a wide feature table belong together."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..schemas import numeric_columns

SITE_PAIR = re.compile(r"endpoint_dist_\d+s\d+_\d+s\d+")
PAIR_MEAN = re.compile(r"endpoint_dist_\d+_\d+_mean")

#: Groups by the beginnings of their columns' names; callers with tables of their own pass their own mapping.
PREFIXES = {
    "cage": ("assembly_", "radial_", "com_", "octahedrality", "amphiphile_", "monomer_", "total_inter", "inter_contact", "n_active", "n_broken", "weakest_", "contact_graph", "largest_connected", "cavity_min", "cavity_inner", "hydrophilic_", "hydrophobic_radial", "hydrophobic_contact", "tooth_", "endpoint_dist_mean", "endpoint_dist_std", "gear_", "neighbor_relative", "inter_monomer", "polar_", "salt_", "pore_"),
    "guest": ("n_guest", "guest_"),
    "solvent": ("cavity_water", "cavity_ion", "headgroup_water", "hydrophobic_water", "water_bridge", "ion_bridge", "water_count", "guest_water"),
}


def group_columns(df: DataFrame, group: str, site_pairs: bool = False, prefixes: dict[str, tuple[str, ...]] = PREFIXES) -> list[str]:
    """The numeric columns of a group, in the table's order: all for ``combined``, distances for ``endpoint``."""
    columns = numeric_columns(df)
    if group == "combined":
        return columns
    if group == "endpoint":
        return [c for c in columns if c.startswith("endpoint_dist_") and (site_pairs or not SITE_PAIR.fullmatch(c))]
    if group not in prefixes:
        raise ValueError(f"unknown group {group!r}; there are {sorted([*prefixes, 'combined', 'endpoint'])}")
    mine = [c for c in columns if c.startswith(prefixes[group])]
    others = tuple(p for g, ps in prefixes.items() if g != group for p in ps)
    # A column goes to the group with the longest beginning that fits it.
    longest = lambda c, ps: max((len(p) for p in ps if c.startswith(p)), default=0)
    return [c for c in mine if longest(c, prefixes[group]) >= longest(c, others)]


def group_map(df: DataFrame, groups: list[str] | None = None, **options) -> dict[str, list[str]]:
    """Columns by group, groups without any left out."""
    found = {g: group_columns(df, g, **options) for g in groups or [*PREFIXES, "combined", "endpoint"]}
    return {g: c for g, c in found.items() if c}


def site_pair_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if SITE_PAIR.fullmatch(c)]


def pair_mean_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if PAIR_MEAN.fullmatch(c)]


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def summary_columns(bases: list[str]) -> list[str]:
    return [f"{b}_{s}" for b in bases for s in ("mean", "std")]


def missing_groups(found: DataFrame, wanted: list[str], column: str = "grp") -> DataFrame:
    """The groups that a table of results does not have yet."""
    names = found.sparkSession.createDataFrame([(g,) for g in wanted], f"{column} string")
    return names.join(found.select(column).distinct(), column, "left_anti")
