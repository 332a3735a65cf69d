"""Which features tell what changes: at handoffs between segments, between clusters, around events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite
from .joins import interval_join


def transition_scores(events: DataFrame, frames: DataFrame, columns: Sequence[str], key: str = "traj_id", window: int | None = None, least_r: float = 0.0) -> DataFrame:
    """Features ranked per directed transition of handoffs (see windows.handoffs).

    For each event and feature: the change of means from the segment before to the one
    after, in units of the feature's overall deviation, and the point-biserial correlation
    of values with the side. ``window`` keeps only so many frames on either side of the
    boundary. A transition's score is half the mean change, relative to its largest, and
    half the mean |r|; with one event it only describes.
    """
    # A hash of the event's place names it; numbering all events would put them in one task.
    numbered = events.withColumn("event_id", F.xxhash64(key, "start_frame", "segment_id")) if "event_id" not in events.columns else events
    lo, hi = F.col("start_frame"), F.col("end_frame")
    to_lo, to_hi = F.col("to_start_frame"), F.col("to_end_frame")
    if window:
        lo, to_hi = F.greatest(lo, hi - window + 1), F.least(to_hi, to_lo + window - 1)
    sides = numbered.select(key, "event_id", "source", "target", F.explode(F.array(F.struct(F.lit(0.0).alias("side"), lo.alias("a"), hi.alias("b")), F.struct(F.lit(1.0).alias("side"), to_lo.alias("a"), to_hi.alias("b")))).alias("s")).select(key, "event_id", "source", "target", "s.side", "s.a", "s.b")
    met = interval_join(frames.select(key, "frame", *columns), sides, [key], "frame", "a", "b")
    long = met.unpivot([key, "event_id", "source", "target", "side"], list(columns), "feature", "value").withColumn("value", finite("value"))
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("value")))
    each = long.groupBy("event_id", "source", "target", "feature").agg((mean(1.0) - mean(0.0)).alias("delta"), F.corr("value", F.when(F.col("value").isNotNull(), F.col("side"))).alias("r"))
    scale = frames.select(*columns).unpivot([], list(columns), "feature", "value").groupBy("feature").agg(F.nullif(F.stddev_pop(finite("value")), F.lit(0.0)).alias("scale"))
    per = each.join(scale, "feature").groupBy("source", "target", "feature").agg(F.avg("delta").alias("mean_delta"), F.avg(F.abs(F.col("delta") / F.col("scale"))).alias("mean_std_delta"), F.avg(F.abs("r")).alias("mean_abs_r"), F.countDistinct("event_id").alias("n_events"))
    top = F.max("mean_std_delta").over(W.partitionBy("source", "target"))
    score = 0.5 * F.coalesce(F.col("mean_std_delta") / F.nullif(top, F.lit(0.0)), F.lit(0.0)) + 0.5 * F.coalesce("mean_abs_r", F.lit(0.0))
    out = per.withColumn("score", score).withColumn("is_descriptive", F.col("n_events") < 2)
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("source", "target").orderBy(F.desc("score"), "feature")))
    return ranked.where(F.coalesce("mean_abs_r", F.lit(0.0)) >= least_r) if least_r > 0 else ranked


def top_features(ranking: DataFrame, k: int = 10, least_r: float = 0.0) -> DataFrame:
    return ranking.where((F.col("rank") <= k) & (F.coalesce("mean_abs_r", F.lit(0.0)) >= least_r))


def attach_sites(ranking: DataFrame, sites: DataFrame, open_lo: float = 4.5, open_hi: float = 5.5) -> DataFrame:
    """The ranking with the pair that a feature's name means and the kinds of its two sites (sites: monomer, site_index, kind)."""
    from ..functions.labels import pair_key, pair_label

    named = ranking.withColumn("__p", pair_key(F.col("feature"))).select("*", *(F.col(f"__p.{c}").alias(c) for c in ("mon_i", "site_a", "mon_j", "site_b"))).drop("__p")
    for side, mon, site in (("a", "mon_i", "site_a"), ("b", "mon_j", "site_b")):
        s = sites.select(F.col("monomer").alias(f"__m{side}"), F.col("site_index").alias(f"__s{side}"), F.col("kind").alias(f"kind_{side}")).dropDuplicates([f"__m{side}", f"__s{side}"])
        named = named.join(s, (F.col(mon) == F.col(f"__m{side}")) & (F.col(site) == F.col(f"__s{side}")), "left").drop(f"__m{side}", f"__s{side}")
    return named.withColumn("label", pair_label(F.col("mon_i"), F.col("site_a"), F.col("mon_j"), F.col("site_b")))


def segment_feature_means(frames: DataFrame, segments: DataFrame, columns: Sequence[str], key: str = "traj_id", label: str = "cluster_label") -> DataFrame:
    """Per segment each feature's count, sum, sum of squares and mean over its frames: long."""
    met = interval_join(frames.select(key, "frame", *columns), segments.select(key, "segment_id", label, "start_frame", "end_frame"), [key], "frame")
    long = met.unpivot([key, "segment_id", label], list(columns), "feature", "value").withColumn("value", finite("value"))
    v = F.col("value")
    return long.groupBy(key, "segment_id", label, "feature").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.avg(v).alias("mean"))


def cluster_margins(segments: DataFrame, columns: Sequence[str], label: str = "cluster_label") -> DataFrame:
    """Per cluster and column how far its mean lies from the nearest other cluster's, in units of the column's deviation."""
    long = segments.unpivot([label], list(columns), "feature", "value").withColumn("value", finite("value"))
    means = long.groupBy(label, "feature").agg(F.avg("value").alias("mean"))
    scale = long.groupBy("feature").agg(F.nullif(F.stddev_pop("value"), F.lit(0.0)).alias("scale"))
    w = W.partitionBy("feature").orderBy("mean")
    gap = F.least(F.col("mean") - F.lag("mean").over(w), F.lead("mean").over(w) - F.col("mean"))
    return means.withColumn("gap", gap).join(scale, "feature").select(label, "feature", "mean", (F.col("gap") / F.col("scale")).alias("margin"))


def replica_window(frames: DataFrame, segments: DataFrame, value: str, label: str, cluster: int, key: str = "traj_id") -> DataFrame:
    """Per series the mean of a value inside and outside the segments of one cluster."""
    own = segments.where(F.col(label) == cluster).select(key, "start_frame", "end_frame", F.lit(1).alias("__in"))
    met = interval_join(frames.select(key, "frame", value), own, [key], "frame", how="left")
    return met.groupBy(key).agg(F.avg(F.when(F.col("__in") == 1, finite(value))).alias("inside"), F.avg(F.when(F.col("__in").isNull(), finite(value))).alias("outside"), F.count_if(F.col("__in") == 1).alias("n_inside"))


def annotation_series(handoff: DataFrame, shift: str = "rms_shift", key: str = "traj_id", cohort: str = "cube", least_at: float = 200.0, least_flank: float = 400.0) -> DataFrame:
    """Series with exactly one leaving of a tight state, late enough and with long enough flanks, scored by shift times flank; the best of each cohort has priority.

    handoff has key, cohort, boundary_ps, left_ps, right_ps, leaves_tight and the shift.
    """
    left = handoff.where("leaves_tight")
    one = left.withColumn("__n", F.count("*").over(W.partitionBy(cohort, key))).where("__n = 1").drop("__n")
    flank = F.least("left_ps", "right_ps")
    good = one.where((F.col("boundary_ps") >= least_at) & (flank >= least_flank)).withColumn("score", F.col(shift) * F.least(flank / 1000, F.lit(2.0)))
    return good.withColumn("priority", F.row_number().over(W.partitionBy(cohort).orderBy(F.desc("score"), key)) == 1)


def inspection_list(handoff: DataFrame, by: str = "cube", most: int = 3) -> DataFrame:
    """Handoffs whose markers differ, that are no symmetry copies, and whose ordered pair is rare in its cohort.

    handoff has source, target, marker_source, marker_target and is_copy.
    """
    n = F.count("*").over(W.partitionBy(by, "source", "target"))
    return handoff.withColumn("n_pair", n).where((F.col("marker_source") != F.col("marker_target")) & ~F.col("is_copy") & (F.col("n_pair") <= most))


def motif_profile(frames: DataFrame, label: str, structure: str, edges: Sequence[str], poles: Sequence[str]) -> DataFrame:
    """Per cluster the percentage of frames with each metastructure label, each elongated edge, any of them, and each open pole."""
    from ..functions.labels import ELONGATED_LO, OPEN_LO

    pct = lambda c: 100.0 * F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    any_edge = F.lit(False)
    for e in edges:
        any_edge = any_edge | F.coalesce(F.col(e) >= ELONGATED_LO, F.lit(False))
    aggs = [pct(F.col(structure) == s).alias(f"pct_{s}") for s in ("A", "B", "C1", "C2", "other")]
    aggs += [pct(F.col(e) >= ELONGATED_LO).alias(f"edge_{e}") for e in edges] + [pct(any_edge).alias("any_edge")]
    aggs += [pct(F.col(p) >= OPEN_LO).alias(f"pole_{p}") for p in poles]
    return frames.groupBy(label).agg(F.count("*").alias("n_frames"), *aggs)
