"""Aggregations over frames, segments, clusters and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite


def segments_from_breakpoints(frames: DataFrame, breakpoints: DataFrame, key: str = "traj_id", grp: str = "grp") -> DataFrame:
    """Rows of frames (key, grp, i from 0 in each) with segment_id: how many breakpoints (key, grp, signal_index) lie at or before i."""
    marks = breakpoints.select(key, grp, F.col("signal_index").alias("i"), F.lit(1).alias("__b")).distinct()
    met = frames.join(marks, [key, grp, "i"], "left")
    return met.withColumn("segment_id", F.coalesce(F.sum("__b").over(W.partitionBy(key, grp).orderBy("i")), F.lit(0)).cast("int")).drop("__b")


def segment_statistics(labelled: DataFrame, columns: Sequence[str], key: Sequence[str] = ("traj_id", "grp", "segment_id"), frame: str = "frame", time: str | None = "time_ps") -> DataFrame:
    """Bounds, and mean and population deviation of each column over finite values."""
    bounds = [F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame")]
    if time:
        bounds += [F.min(time).alias("start_ps"), F.max(time).alias("end_ps")]
    stats = [f(finite(c)).alias(f"{c}_{s}") for c in columns for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return labelled.groupBy(*key).agg(*bounds, F.count("*").alias("n_frames"), *stats)


def cohort_summary(timing: DataFrame) -> DataFrame:
    """Per pair of groups: series, median and mean jaccard."""
    return timing.groupBy("group_a", "group_b").agg(F.count("*").alias("n"), F.median("jaccard").alias("median_jaccard"), F.avg("jaccard").alias("mean_jaccard"))


def breakpoint_pivot(breakpoints: DataFrame, groups: Sequence[str], key: str = "traj_id", grp: str = "grp") -> DataFrame:
    """Breakpoints per series, a column per group; the groups are given, so nothing is scanned to find them."""
    return breakpoints.groupBy(key).pivot(grp, list(groups)).agg(F.count(F.lit(1))).fillna(0)


def extremes(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """The k lowest and the k highest rows, with side and rank; ties by all other columns."""
    others = [c for c in df.columns if c != value]
    low = df.orderBy(F.asc_nulls_last(value), *others).limit(k).withColumn("side", F.lit("lowest"))
    high = df.orderBy(F.desc_nulls_last(value), *others).limit(k).withColumn("side", F.lit("highest"))
    return low.union(high)


def cluster_population(segments: DataFrame, label: str = "cluster_label", key: str = "traj_id", by: Sequence[str] = ()) -> DataFrame:
    """Segments, series and the share of all segments per cluster."""
    out = segments.groupBy(*by, label).agg(F.count("*").alias("n_segments"), F.countDistinct(key).alias("n_series"))
    return out.withColumn("fraction", F.col("n_segments") / F.sum("n_segments").over(W.partitionBy(*by)))


def cluster_lifetime(segments: DataFrame, label: str = "cluster_label", duration: str = "n_frames") -> DataFrame:
    d = F.col(duration)
    return segments.groupBy(label).agg(F.count("*").alias("n_segments"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.min(d).alias("min"), F.max(d).alias("max"), F.sum(d).alias("total"))


def replica_composition(segments: DataFrame, label: str = "cluster_label", key: str = "traj_id", frames: str = "n_frames") -> DataFrame:
    """Per cluster the series that gives most frames, its share of frames and of segments; ties go to the smaller name."""
    each = segments.groupBy(label, key).agg(F.sum(frames).alias("frames"), F.count("*").alias("segments"))
    ranked = each.withColumn("__rank", F.row_number().over(W.partitionBy(label).orderBy(F.desc("frames"), key)))
    first = F.col("__rank") == 1
    return ranked.groupBy(label).agg(
        F.max(F.when(first, F.col(key))).alias("top_series"),
        (F.max("frames") / F.sum("frames")).alias("frame_share"),
        (F.max("segments") / F.sum("segments")).alias("segment_share"),
        F.count("*").alias("n_series"),
    )


def occupancy(df: DataFrame, label: str, labels: DataFrame | None = None, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Percent of rows per label; with a dimension of labels (one column, label) also those at 0."""
    total = F.sum(weight) if weight else F.count("*")
    counts = df.groupBy(*by, F.col(label).alias("label")).agg(total.alias("n"))
    if labels is not None:
        grid = counts.select(*by).distinct().crossJoin(labels) if by else labels
        counts = grid.join(counts, [*by, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def occupancy_deviation(found: DataFrame, expected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Occupancy against a reference (by, label, expected): the difference, and per cell the sum and the worst of its size."""
    return found.join(expected, [*by, "label"]).withColumn("delta", F.col("percent") - F.col("expected"))


def grid_fit(deviations: DataFrame, cell: Sequence[str], label: str = "label", delta: str = "delta") -> DataFrame:
    d = F.col(delta)
    return deviations.groupBy(*cell).agg(F.sum(d).alias("signed_sum"), F.sum(F.abs(d)).alias("absolute_sum"), F.max(F.abs(d)).alias("worst"), F.max_by(label, F.abs(d)).alias("worst_label"))


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of label pairs: long, so that any number of labels fits."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def majority(df: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """The commonest label per key, the smaller one of equals, and its share."""
    counts = df.groupBy(*key, label).agg(F.count("*").alias("n"))
    w = W.partitionBy(*key)
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc("n"), label)))
    return ranked.where("__r = 1").select(*key, F.col(label).alias("mode"), "share")


def quality(frames: DataFrame, spread: str, component: str, most: float, least: float, key: str = "traj_id", frame: str = "frame") -> DataFrame:
    """Per series the largest spread and the smallest component, how many frames fail either limit, and the first that does."""
    g, c = finite(spread), F.col(component)
    bad = F.coalesce(g > most, F.lit(False)) | F.coalesce(c < least, F.lit(False))
    return frames.groupBy(key).agg(
        F.max(g).alias("max_spread"),
        F.min(c).alias("min_component"),
        F.count_if(F.coalesce(g > most, F.lit(False))).alias("n_spread"),
        F.count_if(F.coalesce(c < least, F.lit(False))).alias("n_component"),
        F.min(F.when(bad, F.col(frame))).alias("first_failure"),
        F.max(bad).alias("failed"),
    )


def pair_and_frame_levels(pairs: DataFrame, frame: Sequence[str], pair: Sequence[str], value: str) -> DataFrame:
    """Min, mean, max and deviation of a value per pair and per whole frame in one pass; level tells which, pair columns are NULL for frames."""
    for c in (*frame, *pair):
        if c == "__v":
            raise ValueError("a column named __v is in the way")
    base = pairs.select(*frame, *pair, finite(value).alias("__v"))
    every = base.groupingSets([[F.col(c) for c in (*frame, *pair)], [F.col(c) for c in frame]], *(F.col(c) for c in (*frame, *pair)))
    out = every.agg(F.grouping_id().alias("__g"), F.min("__v").alias("min"), F.avg("__v").alias("mean"), F.max("__v").alias("max"), F.stddev_pop("__v").alias("std"), F.count("__v").alias("n"))
    return out.withColumn("level", F.when(F.col("__g") == 0, "pair").otherwise("frame")).drop("__g")


def pair_variation(pairs: DataFrame, pair: Sequence[str], value: str, least: int = 3) -> DataFrame:
    """Per pair with at least ``least`` values: mean, sample-free spread, range, and coefficient of variation."""
    v = finite(value)
    out = pairs.groupBy(*pair).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    return out.where(F.col("n") >= least).withColumn("range", F.col("max") - F.col("min")).withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")))


def summarise(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Median, quartiles, share above 0 and count of the finite values."""
    v = finite(value)
    return df.groupBy(*by).agg(F.median(v).alias("median"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"), F.avg((v > 0).cast("double")).alias("fraction_positive"), F.count(v).alias("n"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0))


def vector_merge(df: DataFrame, by: Sequence[str], vector: str, how: str = "mean") -> DataFrame:
    """Element by element over arrays: sum, mean, or the first value that is not missing. Sums and counts merge, so the mean does not depend on their order."""
    each = df.select(*by, F.posexplode(vector).alias("__k", "__v")).withColumn("__v", finite(F.col("__v").cast("double")))
    agg = {"sum": F.sum("__v"), "mean": F.avg("__v"), "first": F.any_value("__v", True)}[how]
    cells = each.groupBy(*by, "__k").agg(agg.alias("__v"))
    ordered = F.array_sort(F.collect_list(F.struct("__k", "__v")))
    return cells.groupBy(*by).agg(F.transform(ordered, lambda s: s["__v"]).alias(vector))


def atom_fluctuation(atoms: DataFrame, by: Sequence[str] = ("traj_id", "atom_id")) -> DataFrame:
    """The root mean square fluctuation of each atom around its mean place."""
    return atoms.groupBy(*by).agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def residue_catalog(atoms: DataFrame) -> DataFrame:
    """Per residue name its atoms, residues and their numbers, sorted."""
    return atoms.groupBy("resname").agg(F.countDistinct("atom_id").alias("n_atoms"), F.countDistinct("resid").alias("n_residues"), F.array_sort(F.collect_set("resid")).alias("resids"))


def main_species(atoms: DataFrame, solvent: Sequence[str] = ("WAT", "HOH", "TIP3", "TIP3P", "SOL", "Na+", "Cl-", "NA", "CL", "SOD", "CLA", "K+", "IOD")) -> DataFrame:
    """The residue name with most atoms that is neither water nor an ion."""
    counts = atoms.where(~F.col("resname").isin(*solvent)).groupBy("resname").agg(F.countDistinct("atom_id").alias("n"))
    return counts.agg(F.max_by("resname", F.struct("n", "resname")).alias("resname"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group, ranked."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def ranked_scores(scores: DataFrame, by: str = "overall_score", tie: str = "simulation_id") -> DataFrame:
    """Scores best first, missing ones last, with a rank."""
    w = W.orderBy(F.desc_nulls_last(F.when(~F.isnan(by), F.col(by))), tie)
    return scores.withColumn("rank", F.row_number().over(w))


def sample_frames(df: DataFrame, stride: int, cap: int | None = None, frame: str = "frame", seed: int = 0) -> DataFrame:
    """Every stride-th frame; above a cap, those with the smallest hashes. Sampling is what this operator is for."""
    some = df.where(F.pmod(F.col(frame), F.lit(stride)) == 0)
    return some if cap is None else some.orderBy(F.xxhash64(*df.columns, F.lit(seed))).limit(cap)
