"""Markov states: projection, microstates, macrostates, transitions between them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering, windows


@dataclass
class StateModel:
    """Frames (traj_id, frame, a vector) to labelled states and their transitions.

    Projection is ``pca`` or ``tica``; lags are in frames.
    """

    frames: DataFrame
    vector: str = "x"
    projection: str = "pca"
    components: int = 5
    n_micro: int = 1500
    n_macro: int = 22
    lag: int = 1
    lag_time: float = 1.0
    ridge: float = 1e-6
    seed: int = 0

    def project(self) -> tuple[DataFrame, dict]:
        if self.projection == "pca":
            scores, share = clustering.pca(self.frames, self.vector, self.components, "scores")
            return scores, {"share": share}
        if self.projection == "tica":
            scores, found = clustering.tica(self.frames, self.vector, self.components, self.lag, self.lag_time, self.ridge)
            return scores.withColumnRenamed("tics", "scores"), found
        raise ValueError(f"unknown projection {self.projection!r}")

    def label(self) -> DataFrame:
        return clustering.two_stage(self.project()[0], "scores", self.n_micro, self.n_macro, self.seed)

    def transitions(self, labelled: DataFrame, by_series: bool = False) -> DataFrame:
        pairs = windows.transitions(labelled, "traj_id", "frame", "macro_label", lag=self.lag)
        return windows.transition_counts(pairs, ["traj_id"] if by_series else [])

    def run(self) -> dict[str, DataFrame | dict]:
        labelled = self.label().cache()
        states = labelled.select(F.col("macro_label").alias("state")).distinct()
        counts = self.transitions(labelled)
        return {
            "labels": labelled,
            "transitions": counts,
            "matrix": windows.transition_matrix(counts, states),
            "boundaries": windows.boundaries(labelled, "traj_id", "frame", "macro_label"),
            "dwells": windows.dwell_statistics(labelled, "traj_id", "frame", "macro_label", by=["macro_label"]),
            "importance": clustering.importance(labelled, self.vector, "macro_label"),
            "quality": clustering.state_quality(labelled, n_micro=self.n_micro, n_macro=self.n_macro),
        }


def sweep(frames: DataFrame, vector: str, micro: list[int], macro: list[int], components: int = 5, seed: int = 0) -> list[dict]:
    """Quality over a grid of state numbers; each projection and each k-means is made once, its cuts share one tree."""
    from ..kernels import hierarchy as H
    from ..operators.aggregates import vector_merge

    scores, _ = clustering.pca(frames, vector, components, "scores")
    scores = scores.cache()
    out = []
    for n in micro:
        labelled = clustering.kmeans(scores, "scores", n, seed, "micro").cache()
        centres = vector_merge(labelled, ["micro"], "scores").toPandas().sort_values("micro")  # n rows
        x = np.stack(centres["scores"].to_numpy()).astype(float)
        d = H.pairwise(x)
        tree = H.linkage(d)
        for m in macro:
            if m >= len(x):
                continue
            cut = H.cut(tree, m)
            mapping = frames.sparkSession.createDataFrame(list(zip(centres["micro"].tolist(), cut.tolist())), "micro int, macro_label int")
            s = H.silhouette(d, cut)
            out.append({"n_micro": n, "n_macro": m, "silhouette": s} | clustering.state_quality(labelled.join(F.broadcast(mapping), "micro"), n_micro=n, n_macro=m, silhouette=s))
        labelled.unpersist()
    scores.unpersist()
    return out


def rank_to_pairs(frames: DataFrame, pairs: str = "pairs") -> DataFrame:
    """Which physical pair stands at each rank of a sorted-distance vector, and how often."""
    each = frames.select(F.posexplode(pairs).alias("rank", "pair"))
    return each.groupBy("rank", F.col("pair.i").alias("i"), F.col("pair.j").alias("j")).agg(F.count("*").alias("n"))
