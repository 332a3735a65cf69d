"""Times as plain numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nanoseconds(time_ps: Column) -> Column:
    return time_ps / 1000


def lag_frames(lag_ns: Column, dt_ps: Column, stride: int = 1) -> Column:
    """A lag in frames, at least 1, halves rounded to even."""
    return F.greatest(F.lit(1), F.rint(lag_ns * 1000 / (dt_ps * stride)).cast("int"))


def spacing(df: DataFrame, key: str = "traj_id", order: str = "frame", time: str = "time_ps") -> DataFrame:
    """The median positive step between neighbours within a series: one row, sample_ps."""
    step = F.lead(time).over(W.partitionBy(key).orderBy(order)) - F.col(time)
    return df.select(step.alias("step")).where("step > 0").agg(F.median("step").alias("sample_ps"))


def frame_times(df: DataFrame, frames: DataFrame, key: str = "traj_id") -> DataFrame:
    """frames (key, frame) with the time of each from df; the first where a frame comes twice."""
    times = df.groupBy(key, "frame").agg(F.min("time_ps").alias("time_ps"))
    return frames.join(times, [key, "frame"], "left")
