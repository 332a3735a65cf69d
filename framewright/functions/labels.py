"""Labels from numbers, and keys from names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distance windows in angstrom, and the prefixes that run names have by default.
COMPACT_LO, COMPACT_HI, ELONGATED_LO = 4.5, 5.5, 7.0
OPEN_LO = 6.5
CUBES = ("BHHpH", "BHHpM", "BMHpH", "BMHpM", "BMMpH", "BMMpM")

SITE_PAIR = r"^endpoint_dist_(\d+)s(\d+)_(\d+)s(\d+)$"
ROLE_PAIR = r"^paper_d1_m(\d+)r(\d+)_m(\d+)r(\d+)$"


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def series_id(c: Column, cohorts: tuple[str, ...] = CUBES) -> Column:
    """The id of a series without the cohort before it and the name of its feature table behind it."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), f"^(?:{'|'.join(cohorts)})_", ""), r"_(?:gsa|endpoint)_features$", "")


def cohort(c: Column, cohorts: tuple[str, ...] = CUBES) -> Column:
    """The cohort before a run's name; NULL where there is none."""
    return F.nullif(F.regexp_extract(c, f"^({'|'.join(cohorts)})_", 1), F.lit(""))


def pair_key(name: Column, pattern: str = SITE_PAIR) -> Column:
    """Name of a pair column to a struct (mon_i, site_a, mon_j, site_b); NULL for any other name."""
    part = lambda k: F.regexp_extract(name, pattern, k).cast("int")
    found = F.struct(part(1).alias("mon_i"), part(2).alias("site_a"), part(3).alias("mon_j"), part(4).alias("site_b"))
    return F.when(name.rlike(pattern), found)


def pair_label(mon_i: Column, site_a: Column, mon_j: Column, site_b: Column) -> Column:
    return F.format_string("M%dS%d-M%dS%d", mon_i, site_a, mon_j, site_b)


def metastructure(n_open: Column, n_elongated: Column) -> Column:
    """A, B, C1, C2 or other from the number of open contacts and of elongated edges.

    NULL where the first is missing; a missing second counts as 0.
    """
    o, e = n_open.cast("int"), F.coalesce(n_elongated.cast("int"), F.lit(0))
    return F.when(o.isNull(), F.lit(None)).when(o == 0, "A").when(o == 1, "B").when((o == 2) & (e == 0), "C1").when((o == 2) & (e == 1), "C2").otherwise("other")


def edge_window(d: Column) -> Column:
    """short, compact, intermediate or elongated; unknown where missing."""
    return F.when(~F.coalesce(_known(d), F.lit(False)), "unknown").when(d < COMPACT_LO, "short").when(d <= COMPACT_HI, "compact").when(d >= ELONGATED_LO, "elongated").otherwise("intermediate")


def edge_state(d: Column, open_lo: float = COMPACT_LO, open_hi: float = COMPACT_HI) -> Column:
    """closed, open or elongated; unknown where missing."""
    return F.when(~F.coalesce(_known(d), F.lit(False)), "unknown").when(d < open_lo, "closed").when(d <= open_hi, "open").otherwise("elongated")


def contact_state(d: Column, open_lo: float = OPEN_LO) -> Column:
    return F.when(~F.coalesce(_known(d), F.lit(False)), "unknown").when(d >= open_lo, "open").otherwise("closed")


def open_bin(n: Column) -> Column:
    """0, 1, or 2 for two and more."""
    return F.when(n >= 0, F.least(n, F.lit(2)))


def opening(n: Column) -> Column:
    return F.when(n >= 3, "3+ poles open").when(n < 0, "unlabeled").when(n == 1, "1 pole open").otherwise(F.concat(n.cast("string"), F.lit(" poles open")))


def belt(edges: Column) -> Column:
    """Label of a frame from the names of its elongated edges, an array in a fixed order."""
    n = F.size(edges)
    return (
        F.when(n <= 0, "intact belt")
        .when(n == 1, F.concat(F.lit("edge "), F.get(edges, F.lit(0))))
        .when(n == 2, F.concat(F.lit("edges "), F.array_join(edges, "+")))
        .otherwise(F.concat(n.cast("string"), F.lit(" elongated edges")))
    )


def belt_kind(label: Column) -> Column:
    return F.when(label == "intact belt", "intact").when(label.startswith("edge "), "one_edge").otherwise("two_plus_edges")


def pair_relation(i: Column, j: Column, poles: list[tuple[int, int]], belt_pairs: list[tuple[int, int]]) -> Column:
    """same monomer, same pole, equatorial or opposite."""
    key = F.concat_ws("-", F.least(i, j), F.greatest(i, j))
    names = lambda pairs: [f"{min(p)}-{max(p)}" for p in pairs]
    return F.when(i == j, "same monomer").when(key.isin(names(poles)), "same pole").when(key.isin(names(belt_pairs)), "equatorial").otherwise("opposite")


def natural_key(name: Column) -> Column:
    """Sorts names by the first number in them, then by name."""
    return F.struct(F.regexp_extract(name, r"(\d+)", 1).try_cast("long").alias("n"), name.alias("name"))


def permutation_cycles(perm: tuple[int, ...]) -> str:
    """Cycle notation of a permutation of 0..n-1; fixed points are left out."""
    seen, out = set(), []
    for k in range(len(perm)):
        cycle = []
        while k not in seen:
            seen.add(k)
            cycle.append(k)
            k = perm[k]
        if len(cycle) > 1:
            out.append("(" + " ".join(map(str, cycle)) + ")")
    return "".join(out) or "()"


# Shares, in percent, by which a profile gets its name, and the names.
INTACT_BELOW, COMPACT_A, MOSTLY_A, OPEN_POLE = 15.0, 90.0, 50.0, 40.0
CLEAN_EDGE, CLEAR_EDGE, CLEAR_PART, BROKEN_BELT, AXIS_BELT = 50.0, 40.0, 0.8, 70.0, 80.0
SECOND_EDGE, SECOND_PART = 30.0, 0.7


def largest(shares: dict[str, Column], rank: int) -> tuple[Column, Column]:
    """Value and name of the rank-th largest of some columns, the first of equals; 0 and an empty name beyond them."""
    each = [F.struct(F.coalesce(c, F.lit(0.0)).alias("v"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, c) in enumerate(shares.items())]
    none = F.struct(F.lit(0.0).alias("v"), F.lit(-len(each)).alias("k"), F.lit("").alias("name"))
    at = F.get(F.sort_array(F.array(*each, none, none), asc=False), F.lit(rank))
    return at["v"], at["name"]


def structure_name(any_edge: Column, compact: Column, edges: dict[str, Column], poles: dict[str, Column], single_replica: Column) -> Column:
    """A short name of a cluster from its motif profile, shares in percent, as a table of rules of which the first that holds counts.

    any_edge is the share of frames with an elongated edge, compact that of label A; edges
    and poles are the shares of each by name.
    """
    (first, at), (second, other), (pole, where) = largest(edges, 0), largest(edges, 1), largest(poles, 0)
    intact = any_edge < INTACT_BELOW
    two = (second >= SECOND_EDGE) & (second >= SECOND_PART * first)
    on_edge = (first >= CLEAN_EDGE) | ((first >= CLEAR_EDGE) & (first >= CLEAR_PART * any_edge))
    on_axis = two & (first >= CLEAR_EDGE) & (any_edge >= AXIS_BELT)
    broken = on_edge | on_axis
    place = F.when(two, F.concat(at, F.lit(" or "), other)).otherwise(at)
    rules = [
        (single_replica, F.concat(F.lit("loosened single replica, edge "), at)),
        (intact & (compact >= COMPACT_A), F.lit("compact cage")),
        (intact & (compact >= MOSTLY_A), F.lit("mostly compact")),
        (intact & (pole >= OPEN_POLE), F.concat(F.lit("intact belt, "), where, F.lit(" often open"))),
        (intact, F.lit("intact belt")),
        (broken & ((any_edge >= BROKEN_BELT) | (first >= CLEAN_EDGE)), F.concat(F.lit("belt broken along "), place)),
        (broken, F.concat(F.lit("partly belt broken along "), place)),
    ]
    out = F.concat(F.lit("mixed belt, largest edge "), at)
    for holds, name in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out
