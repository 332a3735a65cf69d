"""Changepoints of every series and feature group, penalty sweeps, and the segments they make."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels import segmentation as S
from ..schemas import BREAKPOINTS
from .aggregates import segment_statistics, segments_from_breakpoints
from .groups import each_group
from .windows import elbow


def signals(frames: DataFrame, groups: Mapping[str, Sequence[str]], key: str = "traj_id", frame: str = "frame", time: str = "time_ps") -> DataFrame:
    """One row per series, group and frame: the group's features as an array x, and i from 0."""
    w = W.partitionBy(key).orderBy(frame)
    base = frames.withColumn("i", (F.row_number().over(w) - 1).cast("int"))
    each = F.array(*(F.struct(F.lit(g).alias("grp"), F.lit(len(cols)).alias("n_cols"), F.array(*(F.col(c).cast("double") for c in cols)).alias("x")) for g, cols in groups.items()))
    return base.select(F.col(key).alias("traj_id"), F.col(frame).cast("long").alias("frame"), F.col(time).cast("double").alias("time_ps"), "i", F.explode(each).alias("s")).select("traj_id", "frame", "time_ps", "i", "s.grp", "s.n_cols", "s.x")


def detect(signal: DataFrame, method: str = "pelt", cost: str = "rbf", penalty: float | None = None, n_bkps: int | None = None, min_size: int = 2, jump: int = 5, width: int = 100, normalise: bool = True) -> DataFrame:
    """Breakpoints of every series and group; series run beside each other, one in a task at a time.

    Missing values become their column's mean, constant columns go, the rest is z-scored.
    Without a penalty it is log(n), or log(n) * variance * columns if not normalised.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = S.signal_matrix(np.stack(pdf["x"].to_numpy()), normalise)
        found: list[int] = []
        if x.size and len(x) >= 2:
            pen = penalty if penalty is not None else S.default_penalty(x, normalise)
            found = S.detect(x, method, cost, pen, n_bkps, min_size, jump, width)
        at = pdf.iloc[found]
        return pd.DataFrame({"traj_id": pdf["traj_id"].iloc[0], "grp": pdf["grp"].iloc[0], "breakpoint_idx": np.arange(len(found), dtype=np.int32), "signal_index": np.array(found, np.int32), "frame": at["frame"].to_numpy(np.int64), "time_ps": at["time_ps"].to_numpy(float), "n_cols_used": np.int32(x.shape[1] if x.ndim == 2 else 0)})

    return each_group(signal, ["traj_id", "grp"], ["i"], one, BREAKPOINTS)


def segments(signal: DataFrame, breakpoints: DataFrame, frames: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The segments between breakpoints, with bounds and mean and deviation of the columns."""
    at = signal.select("traj_id", "grp", "frame", "i")
    values = frames.select("traj_id", "frame", "time_ps", *columns)
    return segment_statistics(segments_from_breakpoints(at, breakpoints).join(values, ["traj_id", "frame"]), columns)


def sweep(signal: DataFrame, points: int = 12, cost: str = "l2", tolerance: int = 50, min_size: int = 2, jump: int = 5) -> DataFrame:
    """Breakpoints at every penalty of a grid, in one pass: each series is prepared once and searched for all penalties.

    Returns traj_id, grp, step, penalty, n and frames (an array).
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = S.signal_matrix(np.stack(pdf["x"].to_numpy()))
        frames = pdf["frame"].to_numpy()
        fitted = S.COSTS[cost](x) if x.size else None
        grid = [float(p) for p in S.penalty_grid(max(2, len(pdf)), points)]
        each = S.pelt_many(fitted, grid, min_size, jump) if fitted is not None else [[] for _ in grid]
        rows = [(pdf["traj_id"].iloc[0], pdf["grp"].iloc[0], step, pen, len(found), frames[found].tolist()) for step, (pen, found) in enumerate(zip(grid, each))]
        return pd.DataFrame(rows, columns=["traj_id", "grp", "step", "penalty", "n", "frames"])

    return each_group(signal, ["traj_id", "grp"], ["i"], one, "traj_id string, grp string, step int, penalty double, n long, frames array<long>")


def sweep_summary(swept: DataFrame, tolerance: int = 50) -> DataFrame:
    """Per step of a sweep: the penalty, all breakpoints, and the median agreement with the step before."""
    from .joins import band_join, greedy_match

    w = W.partitionBy("traj_id", "grp").orderBy("step")
    prev = swept.withColumns({"before": F.lag("frames").over(w), "n_before": F.lag("n").over(w)}).where("before IS NOT NULL")
    a = prev.select("traj_id", "grp", "step", F.explode("frames").alias("at_a"))
    b = prev.select("traj_id", "grp", "step", F.explode("before").alias("at_b"))
    shared = greedy_match(band_join(a, b, ["traj_id", "grp", "step"], "at_a", "at_b", tolerance), ["traj_id", "grp", "step"], "at_a", "at_b").groupBy("traj_id", "grp", "step").agg(F.count("*").alias("shared"))
    total = F.col("n") + F.col("n_before") - F.coalesce("shared", F.lit(0))
    jac = F.when(total == 0, F.lit(1.0)).otherwise(F.coalesce("shared", F.lit(0)) / total)
    timing = prev.join(shared, ["traj_id", "grp", "step"], "left").withColumn("j", jac).groupBy("step").agg(F.median("j").alias("timing_jaccard_vs_prev"))
    return swept.groupBy("step").agg(F.avg("penalty").alias("penalty"), F.sum("n").alias("total_breakpoints")).join(timing, "step", "left")


def pick_penalty(summary: DataFrame) -> DataFrame:
    """The elbow of breakpoints over the logarithm of the penalty."""
    return elbow(summary.withColumn("log_penalty", F.log10("penalty")), "log_penalty", "total_breakpoints")


def suppress_recrossings(frames: DataFrame, label: str, key: str = "traj_id", frame: str = "frame", min_dwell: int = 2) -> DataFrame:
    """Labels without A-B-A visits shorter than min_dwell rows; a series at a time, since each repair can make the next."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame)
        pdf[label] = S.suppress_recrossings(pdf[label].to_numpy(), min_dwell)
        return pdf

    return frames.groupBy(key).applyInPandas(one, frames.schema)
