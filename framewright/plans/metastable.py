"""From clustered segments to ranked, named structures, and the same across cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates, assemblies, windows
from . import structures

LABEL = "cluster_label"


def select_chemical_k(chemical: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group the k that chemistry tells apart whose clusters it explains best, the smaller of equals."""
    w = W.partitionBy(*by).orderBy(F.desc_nulls_last("best_eta"), "k")
    return chemical.where("chemical_separation").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def rank_structures(frames: DataFrame, segments: DataFrame, label: str = LABEL, key: str = "traj_id", families: dict[str, int] | None = None) -> DataFrame:
    """Structures by their share of frames: rank, percent, frames, series, segments and their mean length.

    families (label to number) merges clusters that are copies of each other; the structure
    is then named by its most populated cluster.
    """
    names = families or {}
    own = F.col(label).cast("string")
    family = F.coalesce(*(F.when(own == k, F.lit(int(v)).cast("string")) for k, v in names.items()), own) if names else own
    at = frames.withColumn("family", family).groupBy("family", label).agg(F.count("*").alias("n_frames"), F.collect_set(key).alias("__s"))
    whole = at.groupBy("family").agg(F.max_by(F.col(label), F.struct("n_frames", -F.col(label))).alias(label), F.sum("n_frames").alias("n_frames"), F.size(F.array_distinct(F.flatten(F.collect_list("__s")))).alias("n_series"), F.count("*").alias("n_clusters"))
    stays = segments.withColumn("family", family).groupBy("family").agg(F.count("*").alias("n_segments"), F.avg("n_frames").alias("mean_length"))
    total = F.sum("n_frames").over(W.partitionBy())  # a row per structure
    out = whole.join(stays, "family", "left").withColumn("percent", 100.0 * F.col("n_frames") / total)
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_frames"), label)))


def summarize_structures(ranking: DataFrame, profiles: DataFrame, audit: DataFrame, mixtures: DataFrame, label: str = LABEL) -> DataFrame:
    """One row per structure: rank, name, share, lifetimes, whether one series makes it, and whether it is a mixture."""
    named = profiles.select(label, "structure_name", "any_edge", "pct_A")
    alone = audit.select(label, "isolated", F.col("frame_share").alias("largest_share"))
    kind = mixtures.groupBy(label).agg(F.max("kind").alias("kind"))
    return ranking.join(named, label, "left").join(alone, label, "left").join(kind, label, "left").orderBy("rank")


def run(frames: DataFrame, segments: DataFrame, cuts: DataFrame, contacts: Sequence[str], held: Sequence[str], structure: str, edges: Sequence[str], poles: Sequence[str], draws: int = 500, key: str = "traj_id", families: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The whole way for one group of one cohort: chemical gate, physical k, labels, ranking, profiles, mixtures, audit and summary.

    segments have means of the ``contacts`` columns; frames have the ``held`` columns, which
    made no cluster, the ``structure`` label and the edge and pole distances. Without any
    k that chemistry tells apart, only the scan comes back.
    """
    scan = structures.chemical_scan(segments, cuts, list(contacts), key).cache()
    physical = structures.physical_scan(structures.frames_by_cut(frames, segments, cuts, key), list(held), key, draws).cache()
    chosen = structures.select_k(scan, physical).cache()
    first = chosen.first()
    out = {"chemical_scan": scan, "physical_scan": physical, "k_selected": chosen}
    if first is None:
        return out
    labels = cuts.where(F.col("k") == first["k"]).select(key, "segment_id", LABEL)
    own = segments.drop(LABEL).join(labels, [key, "segment_id"])
    at = structures.frames_by_cut(frames, segments, cuts.where(F.col("k") == first["k"]), key).drop("k")
    audit = structures.replica_audit(own, LABEL, key)
    profiles = structures.profiles(at, LABEL, structure, edges, poles, audit)
    ranking = rank_structures(at, own, LABEL, key, families)
    mixtures = structures.mixtures(at, LABEL, structure)
    return out | {"clusters": own, "labelled_frames": at, "replica_audit": audit, "cluster_profiles": profiles, "structure_ranking": ranking, "cluster_mixtures": mixtures, "structure_summary": summarize_structures(ranking, profiles, audit, mixtures), "transitions": windows.handoffs(own, key, LABEL)}


# ---- across cohorts and k


def silhouette_peaks(cuts: DataFrame, by: Sequence[str] = ("cohort",)) -> DataFrame:
    """Per cohort the k of the best silhouette, the smaller of equals, and that silhouette."""
    each = cuts.groupBy(*by, "k").agg(F.max("silhouette").alias("silhouette"))
    return each.groupBy(*by).agg(F.min_by("k", F.struct((-F.col("silhouette")).alias("s"), "k")).alias("peak_k"), F.max("silhouette").alias("silhouette"))


def k_splits(cuts: DataFrame, k_from: int, k_to: int, by: Sequence[str] = ("cohort",), key: Sequence[str] = ("traj_id", "segment_id")) -> DataFrame:
    """How the clusters of one k come apart at another: per cohort and pair of clusters the segments both hold, their share of the first, and into how many it splits."""
    side = lambda k, name: cuts.where(F.col("k") == k).select(*by, *key, F.col(LABEL).alias(name))
    both = side(k_from, "from_cluster").join(side(k_to, "to_cluster"), [*by, *key])
    n = both.groupBy(*by, "from_cluster", "to_cluster").agg(F.count("*").alias("n_segments"))
    w = W.partitionBy(*by, "from_cluster")
    return n.withColumns({"share": F.col("n_segments") / F.sum("n_segments").over(w), "n_parts": F.count("*").over(w)})


def segment_dynamics(segments: DataFrame, by: Sequence[str] = ("cohort",), key: str = "traj_id") -> DataFrame:
    """Per cohort: series, segments, segments per series, and the spread of segment lengths."""
    length = F.col("n_frames").cast("double")
    q = lambda p: F.percentile(length, F.lit(p))
    out = segments.groupBy(*by).agg(F.countDistinct(key).alias("n_series"), F.count("*").alias("n_segments"), F.avg(length).alias("mean_length"), q(0.25).alias("q25"), q(0.5).alias("median_length"), q(0.75).alias("q75"))
    return out.withColumn("segments_per_series", F.col("n_segments") / F.col("n_series"))


def geometry_spread(frames: DataFrame, columns: Sequence[str], by: Sequence[str] = ("cohort",)) -> DataFrame:
    """Per cohort and column: mean, deviation and range."""
    long = frames.unpivot(list(by), list(columns), "feature", "value")
    return long.groupBy(*by, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def compare_cluster_k(cuts: DataFrame, segments: DataFrame, k_from: int = 5, k_to: int = 6, by: Sequence[str] = ("cohort",)) -> dict[str, DataFrame]:
    """What speaks for one k or the next, cohort by cohort: silhouette peaks, splits and the dynamics of segments."""
    return {"silhouette_peaks": silhouette_peaks(cuts, by), "k_splits": k_splits(cuts, k_from, k_to, by), "segment_dynamics": segment_dynamics(segments, by)}


def compare_across_cohorts(segments: DataFrame, proxies: Sequence[str], by: Sequence[str] = ("cohort",), key: str = "traj_id", least: int = 5) -> DataFrame:
    """Per cohort and cluster: segments, series, the share of frames, the means of proxies weighted by frames, and whether the cluster is small."""
    weight = lambda c: (F.sum(F.col(c) * F.col("n_frames")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n_frames")))).alias(c)
    out = segments.groupBy(*by, LABEL).agg(F.count("*").alias("n_segments"), F.countDistinct(key).alias("n_series"), F.sum("n_frames").alias("n_frames"), *(weight(c) for c in proxies))
    return out.withColumns({"frame_share": F.col("n_frames") / F.sum("n_frames").over(W.partitionBy(*by)), "low_confidence": F.col("n_segments") < least})


def correlate_means(segments: DataFrame, columns: Sequence[str], targets: Sequence[str], by: Sequence[str] = ("cohort",)) -> DataFrame:
    """Per cohort the correlation of segment means of columns with those of targets: column, target, n and r."""
    long = segments.unpivot([*by, *targets], list(columns), "column", "x").unpivot([*by, "column", "x"], list(targets), "target", "y")
    return long.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*by, "column", "target").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def cage_symmetry(frames: DataFrame, permutations: Sequence[Sequence[int]], most: float, positions: str = "positions") -> DataFrame:
    """Which relabellings of molecules a cage admits: per relabelling the mean and largest superposed distance over reference frames, and whether the mean stays below a limit."""
    each = assemblies.relabelling_rmsd(frames, permutations, positions)
    out = each.groupBy("relabelling").agg(F.avg("rmsd").alias("mean_rmsd"), F.max("rmsd").alias("max_rmsd"), F.count("*").alias("n_frames"))
    return out.withColumn("admissible", F.col("mean_rmsd") <= most)


def occupancy_by_cohort(frames: DataFrame, structure: str, by: Sequence[str] = ("cohort",)) -> DataFrame:
    return aggregates.occupancy(frames, structure, by=list(by))
