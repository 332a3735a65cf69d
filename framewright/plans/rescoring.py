"""Scores of runs again, from what earlier runs have stored."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring


def load_sides(runs: DataFrame, volumes: DataFrame | None = None, correlations: DataFrame | None = None, distances: DataFrame | None = None, guests: DataFrame | None = None, key: str = "simulation_id", strong: float = 0.5) -> DataFrame:
    """Runs with what their side tables tell, each summed up first and joined by the run: a run without a row in one keeps its stored numbers.

    volumes have volume, correlations i, j and r, distances distance, guests n_entries,
    n_exits, residence and outside, all with the run's key.
    """
    out = runs

    def put(side: DataFrame | None, **aggs) -> None:
        nonlocal out
        if side is None:
            return
        sums = side.groupBy(F.col(key).alias("__key")).agg(*(c.alias(f"__{n}") for n, c in aggs.items()))
        out = out.join(sums, F.col(key) == F.col("__key"), "left")
        for n in aggs:
            old = F.col(n) if n in out.columns else F.lit(None)
            out = out.withColumn(n, F.coalesce(F.col(f"__{n}"), old)).drop(f"__{n}")
        out = out.drop("__key")

    v, r, d = F.col("volume"), F.abs("r"), F.col("distance")
    put(volumes, volume_mean=F.avg(v), volume_std=F.stddev_pop(v), volume_range=F.max(v) - F.min(v))
    put(None if correlations is None else correlations.where("i < j"), r_max=F.max(r), r_mean=F.avg(r), n_strong=F.count_if(r >= strong))
    put(distances, dist_cv=F.stddev_pop(d) / F.nullif(F.avg(d), F.lit(0.0)), n_dist=F.count(d))
    put(guests, **{c: F.max(c) for c in ("n_entries", "n_exits", "residence", "outside") if guests is not None and c in guests.columns})
    return out


def rescore(runs: DataFrame, require_entry: bool = False, least_pct: float = 10.0, **sides: DataFrame) -> DataFrame:
    """Runs scored anew from their stored numbers and side tables; earlier scores are replaced."""
    made = ("guest_score", "volume_score", "correlation_score", "structure_score", "overall_score", "is_valid")
    return scoring.score_runs(load_sides(runs.drop(*made), **sides), require_entry, least_pct)


def volume_from_metrics(runs: DataFrame, key: str = "simulation_id", n: int = 1000) -> DataFrame:
    """A made-up volume series per run (key, frame, volume) with the stored mean, swinging twice by the stored deviation within the stored bounds."""
    frame = F.sequence(F.lit(0), F.lit(n - 1))
    mean = F.col("volume_mean").cast("double")
    of = lambda c, other: F.coalesce(F.col(c).cast("double"), other) if c in runs.columns else other
    spread, low, high = of("volume_std", F.lit(0.0)), of("volume_min", mean), of("volume_max", mean)
    swing = F.sin(F.col("frame") * (4 * math.pi / max(1, n - 1))) * spread
    value = F.when(spread > 0, F.greatest(low, F.least(high, mean + swing))).otherwise(mean)
    return runs.where("volume_mean IS NOT NULL").withColumn("frame", F.explode(frame)).select(key, "frame", value.alias("volume"))
