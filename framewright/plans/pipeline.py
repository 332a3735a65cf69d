"""The changepoint analysis, end to end, as one object whose stages are DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite_table
from ..operators import aggregates, attribution, changepoints, clustering, joins, windows


@dataclass
class Analysis:
    """Feature tables (traj_id, frame, time_ps and numbers) through detection, segments, clusters, transitions and attribution.

    Each stage is planned from those before it and computed when used; ``kept`` holds what was made.
    """

    frames: DataFrame
    groups: Mapping[str, Sequence[str]]
    method: str = "pelt"
    cost: str = "rbf"
    penalty: float | None = None
    min_size: int = 2
    jump: int = 5
    tolerance: int = 50
    k: int | None = None
    kept: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.frames = finite_table(self.frames)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for cols in self.groups.values() for c in cols))

    def signals(self) -> DataFrame:
        return self._once("signals", lambda: changepoints.signals(self.frames, self.groups))

    def sweep(self, points: int = 12) -> DataFrame:
        """Breakpoints over a grid of penalties, and how far each step agrees with the one before."""
        return self._once("sweep", lambda: changepoints.sweep_summary(changepoints.sweep(self.signals(), points, "l2", self.tolerance, self.min_size, self.jump), self.tolerance))

    def pick(self, points: int = 12) -> float | None:
        """Take the elbow of the sweep as the penalty."""
        row = changepoints.pick_penalty(self.sweep(points)).first()
        if row is not None:
            self.penalty = float(row["penalty"])
            for name in [n for n in self.kept if n not in ("signals", "sweep")]:
                del self.kept[name]
        return self.penalty

    def breakpoints(self) -> DataFrame:
        return self._once("breakpoints", lambda: changepoints.detect(self.signals(), self.method, self.cost, self.penalty, min_size=self.min_size, jump=self.jump).cache())

    def segments(self) -> DataFrame:
        return self._once("segments", lambda: changepoints.segments(self.signals(), self.breakpoints(), self.frames, self.columns))

    def timing(self) -> DataFrame:
        return self._once("timing", lambda: joins.compare_timing(self.breakpoints(), self.signals().select("traj_id", "grp").distinct(), self.tolerance))

    def clusters(self) -> DataFrame:
        """Segments with cluster_label, group by group."""

        def make() -> DataFrame:
            matrix = clustering.feature_matrix(self.segments(), [f"{c}_{s}" for c in self.columns for s in ("mean", "std")], ["grp"])
            labels = clustering.ward(matrix, ["traj_id", "segment_id"], ["grp"], k=self.k)
            return self.segments().join(labels, ["grp", "traj_id", "segment_id"])

        return self._once("clusters", make)

    def transitions(self, grp: str | None = None) -> DataFrame:
        own = self.clusters().where(F.col("grp") == (grp or next(iter(self.groups))))
        return windows.handoffs(own)

    def attribution(self, grp: str | None = None, window: int | None = None) -> DataFrame:
        return attribution.transition_scores(self.transitions(grp), self.frames, self.columns, window=window)

    def summary(self) -> dict[str, DataFrame]:
        """The cohort's tables: agreement of groups, breakpoints per series, clusters and their replicas."""
        return {
            "timing": aggregates.cohort_summary(self.timing()),
            "breakpoints": aggregates.breakpoint_pivot(self.breakpoints(), list(self.groups)),
            "population": aggregates.cluster_population(self.clusters(), by=["grp"]),
            "replicas": aggregates.replica_composition(self.clusters()),
        }

    def run(self, sweep: bool = False) -> dict[str, DataFrame]:
        if sweep:
            self.pick()
        return {"breakpoints": self.breakpoints(), "segments": self.segments(), "clusters": self.clusters(), "transitions": self.transitions(), **self.summary()}
