"""Stateful operators on streams of frames; the batch operators in ``operators.windows`` define their results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FLIPS = "key string, event string, at long, time double"
_STATE = "inside boolean, last long, run_start long, run_time double, run_on boolean, run_length long, buffer string"


def debounced_flips(frames: DataFrame, key: str, frame: str, time: str, flag: str, min_dwell: int = 1) -> DataFrame:
    """Entries and exits as they are settled: a flip is told once its run has lasted min_dwell rows, at the run's first row.

    Rows of a series must come in order, within and between batches. The state of a series
    is a few numbers, whatever its length.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        inside, last, start, begun, on, length, _ = state.get if state.exists else (False, -1, -1, 0.0, False, 0, "")
        out = []
        rows = pd.concat(list(batches)).sort_values("frame")
        for f, t, o in zip(rows["frame"], rows["time"], rows["flag"]):
            o = bool(o)
            if length == 0 or o != on:
                on, start, begun, length = o, int(f), float(t), 0
            length += 1
            last = int(f)
            if length >= min_dwell and on != inside:
                inside = on
                out.append((str(group[0]), "entry" if on else "exit", start, begun))
        state.update((bool(inside), last, start, begun, bool(on), int(length), ""))
        yield pd.DataFrame(out, columns=["key", "event", "at", "time"])

    rows = frames.select(F.col(key).cast("string").alias("key"), F.col(frame).cast("long").alias("frame"), F.col(time).cast("double").alias("time"), F.coalesce(F.col(flag).cast("boolean"), F.lit(False)).alias("flag"))
    return rows.groupBy("key").applyInPandasWithState(step, FLIPS, _STATE, "append", GroupStateTimeout.NoTimeout)


def set_changes(frames: DataFrame, key: str, frame: str, members: str) -> DataFrame:
    """Members of a set that come and go from row to row: key, event, at, member. State is the last set."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        before = set(state.get[0]) if state.exists else set()
        out = []
        rows = pd.concat(list(batches)).sort_values("frame")
        for f, m in zip(rows["frame"], rows["members"]):
            now = set(m) if m is not None else set()
            out += [(str(group[0]), "entry", int(f), x) for x in sorted(now - before)] + [(str(group[0]), "exit", int(f), x) for x in sorted(before - now)]
            before = now
        state.update((sorted(before),))
        yield pd.DataFrame(out, columns=["key", "event", "at", "member"])

    rows = frames.select(F.col(key).cast("string").alias("key"), F.col(frame).cast("long").alias("frame"), F.col(members).cast("array<string>").alias("members"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, event string, at long, member string", "members array<string>", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Visits: rows of a series with no longer gap between them; late rows are awaited for a while."""
    at = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return at.groupBy(F.session_window("__t", gap).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_rates(events: DataFrame, time: str, label: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and label."""
    at = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    w = F.window("__t", width, slide) if slide else F.window("__t", width)
    return at.groupBy(w.alias("w"), F.col(label)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), label, "n", "total")
