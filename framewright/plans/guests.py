"""Guests: when they come and go, and what the cage does then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..operators import joins, statistics, windows


def events(frames: DataFrame, guest: str, key: str = "traj_id", min_dwell: int = 20) -> DataFrame:
    """Debounced entries and exits from a per-frame count of guests inside."""
    return windows.debounced_events(frames.withColumn("__in", F.coalesce(F.col(guest), F.lit(0)) >= 1), key, "frame", "__in", min_dwell)


def residence(frames: DataFrame, guest: str, key: str = "traj_id") -> DataFrame:
    """Per series: frames inside and outside, entries, exits, the first entry, and the longest stay."""
    inside = frames.withColumn("__in", F.coalesce(F.col(guest), F.lit(0)) >= 1)
    totals = inside.groupBy(key).agg(F.count_if("__in").alias("n_inside"), F.count_if(~F.col("__in")).alias("n_outside"), F.min(F.when(F.col("__in"), F.col("frame"))).alias("first_inside"))
    ev = windows.debounced_events(inside, key, "frame", "__in", 1)
    flips = ev.groupBy(key).agg(F.count_if(F.col("event") == "entry").alias("n_entries"), F.count_if(F.col("event") == "exit").alias("n_exits"), F.max(F.when(F.col("event") == "entry", F.col("dwell"))).alias("longest_stay"))
    return totals.join(flips, key, "left").fillna(0, ["n_entries", "n_exits"])


def geometry_contrast(frames: DataFrame, guest: str, columns: Sequence[str], key: str = "traj_id", cohort: str = "cohort") -> DataFrame:
    """Per cohort and feature the paired difference occupied minus empty within series, its signed-rank p and q, and the occupancy coefficient beside a time trend."""
    base = frames.withColumn("__occ", (F.coalesce(F.col(guest), F.lit(0)) >= 1).cast("double"))
    long = base.unpivot([key, cohort, "frame", "__occ"], list(columns), "feature", "value").withColumn("value", finite("value"))
    per = long.groupBy(cohort, "feature", key).agg((F.avg(F.when(F.col("__occ") == 1, F.col("value"))) - F.avg(F.when(F.col("__occ") == 0, F.col("value")))).alias("difference")).where("difference IS NOT NULL")
    tests = statistics.bh_qvalues(statistics.signed_rank(per, "difference", [cohort, "feature"]), "p", [cohort])
    fit = statistics.least_squares(long, "value", ["__occ", "frame"], [cohort, "feature"]).select(cohort, "feature", F.col("b___occ").alias("occupancy_effect"), F.col("b_frame").alias("time_trend"))
    return tests.join(fit, [cohort, "feature"], "left")


def entry_response(frames: DataFrame, entries: DataFrame, columns: Sequence[str], key: str = "traj_id", window: int = 100) -> DataFrame:
    """Per feature and lag around entries (key, at): traces averaged within each series first, then over series, against the mean before."""
    origins = entries.select(key, F.col("at").alias("origin"))
    traces = windows.aligned(frames, origins, key, "frame", list(columns), window, window)
    long = traces.unpivot([key, "origin", "lag"], list(columns), "feature", "value").withColumn("value", finite("value"))
    per = long.groupBy(key, "feature", "lag").agg(F.avg("value").alias("v"))
    before = per.where("lag < 0").groupBy(key, "feature").agg(F.avg("v").alias("__base"))
    return per.join(before, [key, "feature"]).groupBy("feature", "lag").agg(F.avg("v").alias("mean"), F.avg(F.col("v") - F.col("__base")).alias("change"), F.count("v").alias("n_series"))


def cotiming(entries: DataFrame, breakpoints: DataFrame, n_frames: DataFrame, key: str = "traj_id", tolerance: int = 50, shifts: int = 100, margin: int = 250) -> DataFrame:
    """Per series the share of entries that a breakpoint accompanies, and what circular shifts of the entries would give."""
    return joins.event_recall(entries.select(key, F.col("at").alias("frame")), breakpoints, n_frames, tolerance, key, "frame", shifts, margin)
