"""From clusters to named structures: how many, which are real, which are the same, what to call them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import structure_name
from ..operators import aggregates, attribution, clustering, joins, statistics


def frames_by_cut(frames: DataFrame, segments: DataFrame, cuts: DataFrame, key: str = "traj_id") -> DataFrame:
    """Frames with their cluster at every cut: one row per frame and k."""
    bounds = cuts.join(segments.select(key, "segment_id", "start_frame", "end_frame"), [key, "segment_id"])
    return joins.interval_join(frames, bounds.select(key, "k", "cluster_label", "start_frame", "end_frame"), [key], "frame")


def chemical_scan(segments: DataFrame, cuts: DataFrame, columns: Sequence[str], key: str = "traj_id", n_permutations: int = 0) -> DataFrame:
    """Per k: whether contacts tell its clusters apart, the best eta squared, and the silhouette."""
    long = cuts.join(segments.select(key, "segment_id", *columns), [key, "segment_id"]).unpivot([key, "segment_id", "k", "cluster_label", "silhouette"], list(columns), "feature", "value")
    eta = statistics.eta_squared(long, "value", "cluster_label", ["k", "feature"])
    ranked = statistics.rank_features(eta, statistics.kruskal_epsilon(long, "value", "cluster_label", ["k", "feature"]).select("k", "feature", "epsilon_squared"), ["k"])
    stats = long.groupBy("k", "feature", "cluster_label").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    w = W.partitionBy("k", "feature")
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "s", "q")}
    both = stats.withColumns({f"r{c}": v for c, v in rest.items()}).where("n > 1 AND rn > 1")
    var = lambda p: (F.col(f"{p}q") - F.col(f"{p}s") ** 2 / F.col(f"{p}n")) / (F.col(f"{p}n") - 1)
    pooled = F.sqrt(((F.col("n") - 1) * var("") + (F.col("rn") - 1) * var("r")) / (F.col("n") + F.col("rn") - 2))
    d = both.select("k", "feature", F.col("cluster_label").alias("cluster"), ((F.col("s") / F.col("n") - F.col("rs") / F.col("rn")) / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"))
    sizes = cuts.groupBy("k", F.col("cluster_label").alias("cluster")).agg(F.count("*").alias("n"))
    gate = statistics.chemical_gate(ranked.select("k", "feature", "rank").join(d, ["k", "feature"]), sizes)
    top = eta.groupBy("k").agg(F.max("eta_squared").alias("best_eta"))
    return gate.join(top, "k", "left").join(cuts.groupBy("k").agg(F.max("silhouette").alias("silhouette")), "k", "left")


def held_out_columns(frames: DataFrame, columns: Sequence[str], scored: str) -> list[str]:
    """Columns that vary both over all frames and over the scored ones (a boolean column)."""
    row = frames.agg(*(F.var_pop(c).alias(f"a_{c}") for c in columns), *(F.var_pop(F.when(F.col(scored), F.col(c))).alias(f"b_{c}") for c in columns)).first()
    return [c for c in columns if (row[f"a_{c}"] or 0) > 0 and (row[f"b_{c}"] or 0) > 0]


def physical_scan(labelled: DataFrame, columns: Sequence[str], key: str = "traj_id", n: int = 500, seed: int = 0) -> DataFrame:
    """Per k how well clusters predict geometry that did not make them: R squared in sample and out of bag over resampled series."""
    long = labelled.unpivot([key, "k", "cluster_label"], list(columns), "feature", "value")
    z = W.partitionBy("k", "feature")
    scaled = long.withColumn("value", (F.col("value") - F.avg("value").over(z)) / F.nullif(F.stddev_pop("value").over(z), F.lit(0.0)))
    return statistics.bootstrap_r_squared(statistics.sufficient_statistics(scaled, "value", key, "cluster_label", ["k", "feature"]), key, "cluster_label", ["k"], n, seed)


def select_k(chemical: DataFrame, physical: DataFrame) -> DataFrame:
    """The smallest k that chemistry tells apart and whose out-of-bag R squared is within one standard error of the best such."""
    return statistics.one_se(chemical.join(physical, "k"), "out_of_bag", "se", gate="chemical_separation")


def replica_audit(clustered: DataFrame, label: str = "cluster_label", key: str = "traj_id", most: float = 0.5) -> DataFrame:
    """Clusters with the series that gives most of their frames; one that gives more than a share is isolated."""
    return aggregates.replica_composition(clustered, label, key).withColumn("isolated", F.col("frame_share") >= most)


def profiles(frames: DataFrame, label: str, structure: str, edges: Sequence[str], poles: Sequence[str], replicas: DataFrame | None = None) -> DataFrame:
    """Motif profile of each cluster with a name."""
    rows = attribution.motif_profile(frames, label, structure, edges, poles)
    rows = rows.join(replicas.select(label, "isolated"), label, "left") if replicas is not None else rows.withColumn("isolated", F.lit(False))
    of = lambda kind, names: {x: F.col(f"{kind}_{x}") for x in names}
    return rows.withColumn("structure_name", structure_name(F.col("any_edge"), F.col("pct_A"), of("edge", edges), of("pole", poles), F.col("isolated")))


def merge_families(correlations: DataFrame, threshold: float = 0.95, how: str = "single") -> dict[str, int]:
    """Clusters (a, b, best_r) that are copies of each other up to relabelling."""
    rows = correlations.collect()  # pairs of clusters, few
    names = sorted({str(r.a) for r in rows} | {str(r.b) for r in rows})
    return clustering.families(names, [(str(r.a), str(r.b), r.best_r if r.best_r is not None else float("nan")) for r in rows], threshold, how)


def mixtures(frames: DataFrame, label: str, category: str, least: float = 0.1) -> DataFrame:
    """Categories that make at least a share of a cluster's frames, and whether it is one or a mixture."""
    share = aggregates.occupancy(frames, category, by=[label]).where(F.col("percent") >= 100 * least)
    return share.withColumn("kind", F.when(F.count("*").over(W.partitionBy(label)) > 1, "mixture").otherwise("pure"))


def outliers(frames: DataFrame, segments: DataFrame, value: str, label: str = "cluster_label", key: str = "traj_id", most: float = 0.5) -> DataFrame:
    """Isolated clusters with how far their frames' value departs from the rest of the same series."""
    audit = replica_audit(segments, label, key, most).where("isolated").select(label, F.col("top_series").alias(key))
    spans = segments.join(audit, [label, key]).select(key, label, "start_frame", "end_frame")
    met = joins.interval_join(frames.select(key, "frame", value), spans, [key], "frame")
    inside = met.groupBy(label, key).agg(F.avg(value).alias("inside"), F.count("*").alias("n_frames"))
    whole = frames.groupBy(key).agg(F.avg(value).alias("whole"), F.stddev_pop(value).alias("sd"))
    return inside.join(whole, key).withColumn("z", (F.col("inside") - F.col("whole")) / F.nullif("sd", F.lit(0.0)))


def core_match(matrix: DataFrame, label: str, a: int, b: int, block: str, n: int = 200, seed: int = 1) -> DataFrame:
    """The correlation of two clusters' core profiles over resampled replicas: one row per draw, in parallel."""
    import pandas as pd

    from ..kernels import statistics as K

    rows = matrix.select(F.col(label).alias("l"), F.col(block).cast("string").alias("r"), "x").toPandas()  # one cohort's segments
    x, l, r = np.stack(rows["x"].to_numpy()).astype(float), rows["l"].to_numpy(), rows["r"].to_numpy()
    names = np.unique(r)

    def draw(batches):
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                pick = np.random.default_rng([seed, int(k)]).choice(names, len(names))
                at = np.concatenate([np.flatnonzero(r == p) for p in pick])
                d = K.deltas(x[at], l[at])
                out.append((int(k), K.best_profile_r(d[a], d[b], np.arange(x.shape[1])[None]) if a in d and b in d else None))
            yield pd.DataFrame(out, columns=["draw", "r"])

    return matrix.sparkSession.range(n).mapInPandas(draw, "draw long, r double")
