"""Scores of frames and of whole runs, and the frames worth looking at."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite, zscore
from .windows import gradient

# Weights of the parts of a frame's score (components, rmsd, gyration, strain) and of a run's (guest, volume, correlation, structure).
FRAME_WEIGHTS = (0.35, 0.2, 0.35, 0.1)
RUN_WEIGHTS = (0.3, 0.25, 0.25, 0.2)


def score_frames(frames: DataFrame, key: str = "traj_id", order: str = "frame", pcs: str = "pcs", rmsd: str = "rmsd", rg: str = "rg", strain: str | None = None, breakpoints: DataFrame | None = None, weights: Sequence[float] = FRAME_WEIGHTS) -> DataFrame:
    """Frames with score: the largest of the first three components, the steepness of rmsd, the gyration radius and the strain, all standardised, plus 1 at a breakpoint.

    Components share one mean and one deviation, taken over all of them together.
    """
    w = W.partitionBy(key)
    p = [F.coalesce(F.get(F.col(pcs), F.lit(k)).cast("double"), F.lit(None)) for k in range(3)]
    n = sum((x.isNotNull().cast("int") for x in p), F.lit(0))
    s = sum((F.coalesce(x, F.lit(0.0)) for x in p), F.lit(0.0))
    q = sum((F.coalesce(x * x, F.lit(0.0)) for x in p), F.lit(0.0))
    base = frames.withColumns({"__n": F.sum(n).over(w), "__s": F.sum(s).over(w), "__q": F.sum(q).over(w), "__g": F.abs(gradient(rmsd, key, order))})
    mean = F.col("__s") / F.col("__n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__n") - mean * mean))
    top = F.when(sd > 0, F.greatest(*(F.abs((x - mean) / sd) for x in p))).otherwise(F.lit(0.0))
    parts = [top, zscore("__g", key), F.abs(zscore(rg, key)), zscore(strain, key) if strain else F.lit(0.0)]
    total = sum((F.lit(float(k)) * F.coalesce(x, F.lit(0.0)) for k, x in zip(weights, parts)), F.lit(0.0))
    out = base.withColumn("score", total).drop("__n", "__s", "__q", "__g")
    if breakpoints is not None:
        marks = breakpoints.select(F.col(key).alias("__k"), F.col(order).alias("__f")).distinct().withColumn("__one", F.lit(1.0))
        out = out.join(marks, (F.col(key) == F.col("__k")) & (F.col(order) == F.col("__f")), "left").withColumn("score", F.col("score") + F.coalesce("__one", F.lit(0.0))).drop("__k", "__f", "__one")
    return out


def select_frames(scored: DataFrame, must: DataFrame | None = None, key: str = "traj_id", order: str = "frame", pcs: str = "pcs", most: int = 30, apart: float = 0.75, ends: Sequence[str] = ("endpoint_dist_min", "endpoint_dist_max", "endpoint_dist_mean")) -> DataFrame:
    """Per series the frames that must be, then up to ``most`` in all: the three with the steepest mean end distance, then by score if far enough from all chosen.

    must has key and order (medoids, breakpoints). The least and the greatest end distance
    must be too, where the columns that ``ends`` names exist. All frames of a series are
    candidates; the greedy choice takes one pass over them for each frame that it chooses.
    """
    w = W.partitionBy(key)
    least, greatest, mean = (c if c in scored.columns else None for c in ends)
    first = lambda c, way: F.coalesce((F.row_number().over(w.orderBy(way(c), order)) == 1) & F.col(c).isNotNull(), F.lit(False))
    needed, steep = F.lit(False), F.lit(None).cast("int")
    base = scored
    for c, way in ((least, F.asc_nulls_last), (greatest, F.desc_nulls_last)):
        if c:
            base = base.withColumn(c, finite(F.col(c).cast("double")))
            needed = needed | first(c, way)
    if mean:
        base = base.withColumn(mean, finite(F.col(mean).cast("double"))).withColumn("__g", F.abs(gradient(mean, key, order)))
        rank = F.row_number().over(w.orderBy(F.desc_nulls_last("__g"), order))
        steep = F.when((rank <= 3) & F.col("__g").isNotNull(), rank)
    ranked = base.withColumn("__must", needed).withColumn("__steep", steep)
    if must is not None:
        m = must.select(F.col(key).alias("__k"), F.col(order).alias("__f")).distinct().withColumn("__one", F.lit(True))
        ranked = ranked.join(m, (F.col(key) == F.col("__k")) & (F.col(order) == F.col("__f")), "left").withColumn("__must", F.col("__must") | F.coalesce("__one", F.lit(False)))
    spots = F.array(*(F.coalesce(F.get(F.col(pcs), F.lit(k)).cast("double"), F.lit(0.0)) for k in range(3)))
    some = ranked.select(key, order, "score", F.col("__must").alias("must"), F.col("__steep").alias("steep"), spots.alias("p"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", order], ascending=[False, True]).reset_index(drop=True)
        at = np.array(pdf["p"].tolist(), float).reshape(len(pdf), 3)
        chosen = np.flatnonzero(pdf["must"].to_numpy(bool)).tolist()
        for k in pdf["steep"].dropna().sort_values().index:
            if len(chosen) < most and k not in chosen:
                chosen.append(k)
        free = np.ones(len(pdf), bool)
        for k in chosen:
            free &= np.linalg.norm(at - at[k], axis=1) >= apart
        free[chosen] = False
        while len(chosen) < most and free.any():
            k = int(free.argmax())
            chosen.append(k)
            free &= np.linalg.norm(at - at[k], axis=1) >= apart
            free[k] = False
        return pdf.loc[chosen, [key, order, "score", "must"]]

    kinds = scored.schema
    return some.groupBy(key).applyInPandas(pick, f"{key} {kinds[key].dataType.simpleString()}, {order} {kinds[order].dataType.simpleString()}, score double, must boolean")


def _c(name: str) -> Column:
    return F.coalesce(finite(F.col(name).cast("double")), F.lit(0.0))


def guest_score(entries: Column, exits: Column, residence: Column | None = None, least_time: Column | None = None, outside: Column | None = None) -> Column:
    """0 to 1 from numbers of entries and exits, from the share of time inside, and from the time inside against a least one."""
    e, x = entries.cast("double"), exits.cast("double")
    ratio = e / (e + x)
    first = F.when(e > 0, 0.3 + 0.2 * (1 - F.exp(-0.3 * e))).otherwise(F.lit(0.0))
    more = F.when(e > 1, 0.15 * (1 - F.exp(-0.2 * (e - 1)))).otherwise(F.lit(0.0))
    leave = F.when((e > 0) & (x > 0), F.when(e > x, 0.25 * (1 + (e - x) / e) * ratio).when(e == x, 0.15 * ratio).otherwise(0.05 * ratio)).otherwise(F.lit(0.0))
    share = stay = F.lit(0.0)
    inside = (e > 0) & (residence > 0) if residence is not None else F.lit(False)
    if residence is not None:
        total = residence + (F.coalesce(outside, F.lit(0.0)) if outside is not None else F.lit(0.0))
        share = F.when(inside, 0.25 * F.pow(residence / total, F.lit(0.7))).otherwise(F.lit(0.0))
    if residence is not None and least_time is not None:
        t = residence / least_time
        stay = F.when(inside & (least_time > 0), F.when(t >= 1, 0.15 * F.least(F.lit(1.0), F.log1p(t) / float(np.log(2)))).otherwise(0.1 * F.sqrt(F.greatest(t, F.lit(0.0))))).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), first + more + leave + F.coalesce(share, F.lit(0.0)) + F.coalesce(stay, F.lit(0.0)))


def volume_score(mean: Column, spread: Column, change_range: Column, least_pct: float = 10.0) -> Column:
    p, cv = 100 * change_range / mean, spread / mean
    s = 0.2 + 0.4 * 0.5 * (1 + F.tanh(2 * (p / max(least_pct, 1.0) - 0.5))) + 0.4 * F.exp(-F.pow((cv - 0.1) / 0.15, F.lit(2)))
    return F.when(mean > 0, F.least(F.lit(1.0), s)).otherwise(F.lit(0.0))


def correlation_score(largest: Column, mean: Column, n_strong: Column) -> Column:
    """From the largest and mean |r| over pairs, and how many reach 0.5."""
    s = 0.15 + 0.5 * F.pow(largest, F.lit(1.5)) + 0.25 * F.log1p(n_strong) / float(np.log(10)) + 0.1 * F.pow(mean, F.lit(1.2))
    return F.when(largest.isNotNull(), F.least(F.lit(1.0), s)).otherwise(F.lit(0.0))


def _ramp(cv: Column, high: float, middle: float, low: float) -> Column:
    return F.when(cv >= 0.2, high + 0.2 * F.least(F.lit(1.0), (cv - 0.2) / 0.3)).when(cv > 0.05, middle + 0.2 * (cv - 0.05) / 0.15).otherwise(low + 0.2 * cv / 0.05)


def structure_score(cv: Column, n: Column, edge_cv: Column | None = None) -> Column:
    """From the variation of distances between ends, or of edges where there is none."""
    main = 0.25 + _ramp(cv, 0.5, 0.3, 0.1)
    other = _ramp(edge_cv, 0.7, 0.5, 0.3) if edge_cv is not None else F.lit(0.0)
    return F.least(F.lit(1.0), F.when((n > 1) & cv.isNotNull(), main).otherwise(F.coalesce(other, F.lit(0.0))))


def score_runs(runs: DataFrame, require_entry: bool = False, least_pct: float = 10.0) -> DataFrame:
    """One row per run with its four parts, overall_score and is_valid.

    runs has n_entries, n_exits, volume_mean, volume_std, volume_range, r_max, r_mean,
    n_strong, dist_cv and n_dist; residence (the time inside), outside and least_time, edge_cv if there are any.
    """
    has = lambda c: F.col(c) if c in runs.columns else None
    out = runs.withColumns(
        {
            "guest_score": guest_score(_c("n_entries"), _c("n_exits"), has("residence"), has("least_time"), has("outside")),
            "volume_score": volume_score(_c("volume_mean"), _c("volume_std"), _c("volume_range"), least_pct),
            "correlation_score": correlation_score(finite(F.col("r_max")), _c("r_mean"), _c("n_strong")),
            "structure_score": structure_score(finite(F.col("dist_cv")), F.col("n_dist"), has("edge_cv")),
        }
    )
    total = sum((F.lit(w) * F.col(c) for w, c in zip(RUN_WEIGHTS, ("guest_score", "volume_score", "correlation_score", "structure_score"))), F.lit(0.0))
    raised = F.when(total > 0.5, F.least(F.lit(1.0), total + 0.08 * F.pow(total - 0.5, F.lit(1.5)))).otherwise(total)
    valid = (_c("n_entries") > 0) if require_entry else F.lit(True)
    return out.withColumn("overall_score", raised).withColumn("is_valid", valid)
