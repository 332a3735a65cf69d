"""Interval, band, distance and nearest joins, and the one-to-one matches built on them.

Ranges are joined by equality on the series and a bucket of the range, so that neither a
long series nor a dense one falls to one task, and no join emits pairs that cannot match.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .groups import each_group


def interval_join(points: DataFrame, intervals: DataFrame, key: Sequence[str], at: str, start: str = "start_frame", end: str = "end_frame", how: str = "inner", width: int = 1024) -> DataFrame:
    """Each point with the intervals of its series that hold it, both ends included.

    ``width`` is the size of a bucket: an interval is sent once to each bucket it touches,
    a point to its own. Other columns must have different names; the key comes once.
    """
    left = points.withColumn("__bucket", F.floor(F.col(at) / width))
    right = intervals.where(F.col(start) <= F.col(end)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    right = right.select(*(F.col(c).alias(f"__{c}") if c in key else F.col(c) for c in right.columns if c != "__bucket"), F.col("__bucket").alias("__b"))
    on = (F.col("__bucket") == F.col("__b")) & F.col(at).between(F.col(start), F.col(end))
    for k in key:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(right, on, how).drop("__bucket", "__b", *(f"__{k}" for k in key))


def label_points(points: DataFrame, segments: DataFrame, key: Sequence[str], at: str, start: str = "start_frame", end: str = "end_frame", width: int = 1024) -> DataFrame:
    """As interval_join, but a point in several intervals takes the one that starts last."""
    met = interval_join(points, segments, key, at, start, end, "left", width)
    rank = F.row_number().over(W.partitionBy(*key, at).orderBy(F.desc_nulls_last(start), F.desc_nulls_last(end)))
    return met.withColumn("__r", rank).where("__r = 1").drop("__r")


def paint(points: DataFrame, segments: DataFrame, key: Sequence[str], at: str, start: str = "start_frame", end: str = "end_frame", gap: int = 5, width: int = 1024) -> DataFrame:
    """As label_points, but an interval also covers up to ``gap`` rows after it, where no other begins."""
    nxt = F.lead(start).over(W.partitionBy(*key).orderBy(start, end))
    wider = segments.withColumn(end, F.when(nxt.isNull() | (nxt - F.col(end) - 1 > gap), F.col(end)).otherwise(F.greatest(F.col(end), nxt - 1)))
    return label_points(points, wider, key, at, start, end, width)


def expand_segments(segments: DataFrame, start: str = "start_frame", end: str = "end_frame", n: str = "n_frames", name: str = "frame") -> DataFrame:
    """n evenly spaced points of each interval, ends included, rounded half to even."""
    step = F.when(F.col(n) > 1, (F.col(end) - F.col(start)) / (F.col(n) - 1)).otherwise(F.lit(0.0))
    return segments.where(F.col(n) > 0).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))).withColumn(name, F.rint(F.col(start) + F.col("__k") * step).cast("long")).drop("__k")


def band_join(a: DataFrame, b: DataFrame, key: Sequence[str], at_a: str, at_b: str, tolerance: float) -> DataFrame:
    """Pairs of one series whose positions differ by at most the tolerance, with their distance.

    Buckets are as wide as the tolerance; b goes to its own and both neighbours. Columns
    besides the key must have different names.
    """
    width = float(tolerance) if tolerance > 0 else 1.0
    left = a.withColumn("__bucket", F.floor(F.col(at_a) / width))
    right = b.select(*(F.col(c).alias(f"__{c}") if c in key else F.col(c) for c in b.columns), F.explode(F.array(*(F.floor(F.col(at_b) / width) + k for k in (-1, 0, 1)))).alias("__b"))
    on = F.col("__bucket") == F.col("__b")
    for k in key:
        on = on & (F.col(k) == F.col(f"__{k}"))
    gap = F.abs(F.col(at_a) - F.col(at_b))
    return left.join(right, on).withColumn("distance", gap).where(F.col("distance") <= tolerance).drop("__bucket", "__b", *(f"__{k}" for k in key))


def greedy_pairs(distance: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which candidate pairs a one-to-one match takes: nearest first, then by the smaller and the larger position."""
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), distance))
    used_a, used_b = set(), set()
    taken = np.zeros(len(a), dtype=bool)
    for k in order.tolist():
        if a[k] not in used_a and b[k] not in used_b:
            used_a.add(a[k])
            used_b.add(b[k])
            taken[k] = True
    return taken


def greedy_match(candidates: DataFrame, key: Sequence[str], at_a: str, at_b: str) -> DataFrame:
    """The one-to-one match among candidates of a band join, series by series.

    Pairs that are nearest for both their positions are in the match whatever else is, and
    take all other pairs of these with them; only what remains, chains of close positions,
    is matched in Python, where its order decides.
    """
    order = [F.col("distance"), F.least(at_a, at_b), F.greatest(at_a, at_b)]
    rank = lambda c: F.row_number().over(W.partitionBy(*key, c).orderBy(*order, at_a, at_b))
    mutual = (F.col("__ra") == 1) & (F.col("__rb") == 1)
    taken = lambda c: F.max(mutual).over(W.partitionBy(*key, c))
    ranked = candidates.repartition(*key).withColumns({"__ra": rank(at_a), "__rb": rank(at_b)}).withColumns({"__ta": taken(at_a), "__tb": taken(at_b)})
    first = ranked.where(mutual).select(*candidates.columns)
    rest = ranked.where("NOT __ta AND NOT __tb").select(*candidates.columns)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[greedy_pairs(pdf["distance"].to_numpy(), pdf[at_a].to_numpy(), pdf[at_b].to_numpy())]

    return first.unionByName(each_group(rest, list(key), [], pick, candidates.schema))


def compare_timing(breakpoints: DataFrame, coverage: DataFrame, tolerance: int = 50, key: str = "traj_id", grp: str = "grp", at: str = "frame") -> DataFrame:
    """How far the breakpoints of two groups of one series agree.

    coverage (key, grp) lists what was searched, also where nothing was found. For every
    two groups of a series: n_a, n_b, n_shared, and jaccard = shared / (a + b - shared), 1
    where both are empty.
    """
    cover = coverage.select(key, grp).distinct()
    pairs = cover.withColumnRenamed(grp, "group_a").join(cover.select(F.col(key).alias("__k"), F.col(grp).alias("group_b")), (F.col(key) == F.col("__k")) & (F.col("group_a") < F.col("group_b"))).drop("__k")
    counts = breakpoints.groupBy(key, grp).agg(F.count("*").alias("n"))
    both = [key, "group_a", "group_b"]
    a = breakpoints.select(key, F.col(grp).alias("group_a"), F.col(at).alias("at_a")).join(pairs, [key, "group_a"])
    b = breakpoints.select(key, F.col(grp).alias("group_b"), F.col(at).alias("at_b")).join(pairs, [key, "group_b"])
    met = greedy_match(band_join(a, b, both, "at_a", "at_b", tolerance), both, "at_a", "at_b")
    shared = met.groupBy(key, "group_a", "group_b").agg(F.count("*").alias("n_shared"))
    out = pairs
    for side in "ab":
        out = out.join(counts.select(key, F.col(grp).alias(f"group_{side}"), F.col("n").alias(f"n_{side}")), [key, f"group_{side}"], "left")
    out = out.join(shared, [key, "group_a", "group_b"], "left").fillna(0, ["n_a", "n_b", "n_shared"])
    total = F.col("n_a") + F.col("n_b") - F.col("n_shared")
    return out.withColumn("jaccard", F.when(total == 0, F.lit(1.0)).otherwise(F.col("n_shared") / total)).select(key, "group_a", "group_b", "n_a", "n_b", "n_shared", "jaccard")


def match_boundaries(boundaries: DataFrame, breakpoints: DataFrame, key: str = "traj_id", at: str = "time_ps", tolerance: float = 500.0) -> DataFrame:
    """Per series: each boundary, in time order, takes the nearest breakpoint that is left within the tolerance.

    Returns n_boundaries, n_breakpoints, n_matched, precision, recall and f1.
    """

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        who = (left if len(left) else right)[key].iloc[0]
        free, n = sorted(right[at].tolist()), 0
        total = len(free)
        for t in sorted(left[at].tolist()):
            near = min(free, key=lambda x: (abs(x - t), x), default=None)
            if near is not None and abs(near - t) <= tolerance:
                free.remove(near)
                n += 1
        p, r = (n / total if total else None), (n / len(left) if len(left) else None)
        f1 = 2 * p * r / (p + r) if p and r else (0.0 if p is not None and r is not None else None)
        return pd.DataFrame([(who, len(left), total, n, p, r, f1)], columns=["k", "a", "b", "n", "p", "r", "f"])

    kind = boundaries.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_boundaries long, n_breakpoints long, n_matched long, precision double, recall double, f1 double"
    names = [f.split()[0] for f in schema.split(", ")]
    return boundaries.select(F.col(key).alias(key), F.col(at).alias(at)).groupBy(key).cogroup(breakpoints.select(F.col(key).alias(key), F.col(at).alias(at)).groupBy(key)).applyInPandas(lambda a, b: pick(a, b).set_axis(names, axis=1), schema)


def event_recall(events: DataFrame, breakpoints: DataFrame, n_frames: DataFrame, tolerance: int, key: str = "traj_id", at: str = "frame", shifts: int = 100, margin: int = 250, seed: int = 0) -> DataFrame:
    """Per series: the share of events matched one to one to a breakpoint, and the mean of that after circular shifts of the events.

    n_frames has the key and n. The null is NULL for series not longer than twice the margin.
    """

    def recall(ev: np.ndarray, bp: np.ndarray) -> float:
        gap = np.abs(ev[:, None] - bp[None, :])
        i, j = np.nonzero(gap <= tolerance)
        return float(greedy_pairs(gap[i, j], ev[i], bp[j]).sum()) / len(ev)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=names)
        ev, bp, n = left[at].to_numpy(np.int64), right[at].to_numpy(np.int64), int(left["n"].iloc[0])
        null = None
        if n > 2 * margin:
            rng = np.random.default_rng(seed)
            null = float(np.mean([recall((ev + s) % n, bp) for s in rng.integers(margin, n - margin, shifts)]))
        return pd.DataFrame([(left[key].iloc[0], len(ev), recall(ev, bp), null)], columns=names)

    kind = events.schema[key].dataType.simpleString()
    names = [key, "n_events", "recall", "null_recall"]
    sizes = n_frames.select(F.col(key).alias("__k"), F.col("n").alias("__n"))
    left = events.select(F.col(key).alias("__e"), F.col(at).alias("__at")).join(sizes, F.col("__e") == F.col("__k")).select(F.col("__e").alias(key), F.col("__at").alias(at), F.col("__n").alias("n"))
    return left.groupBy(key).cogroup(breakpoints.select(F.col(key).alias(key), F.col(at).alias(at)).groupBy(key)).applyInPandas(run, f"{key} {kind}, n_events long, recall double, null_recall double")


def _cell(c: str, cutoff: float) -> Column:
    return F.floor(F.col(c) / cutoff)


def distance_join(a: DataFrame, b: DataFrame, key: Sequence[str], cutoff: float, inclusive: bool = False) -> DataFrame:
    """Pairs of points (x, y, z) of one frame that are nearer than the cutoff, with their distance.

    A cell list: space is cut into cubes as wide as the cutoff, a goes to its cube and b to
    the 27 around its own. Columns of b come with ``b_`` before their names.
    """
    left = a.select("*", *(_cell(c, cutoff).alias(f"__{c}") for c in "xyz"))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> flatten(transform(sequence(-1, 1), j -> transform(sequence(-1, 1), k -> named_struct('i', i, 'j', j, 'k', k))))))"))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)).withColumn("__o", around)
    right = right.select("*", *((F.floor(F.col(f"b_{c}") / cutoff) + F.col(f"__o.{o}")).alias(f"__b{c}") for c, o in zip("xyz", "ijk"))).drop("__o")
    on = (F.col("__x") == F.col("__bx")) & (F.col("__y") == F.col("__by")) & (F.col("__z") == F.col("__bz"))
    for k in key:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    d = F.sqrt(sum(((F.col(c) - F.col(f"b_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    out = left.join(right, on).withColumn("distance", d)
    near = F.col("distance") <= cutoff if inclusive else F.col("distance") < cutoff
    return out.where(near).drop(*(f"__{c}" for c in "xyz"), *(f"__b{c}" for c in "xyz"), *(f"b_{k}" for k in key))


def nearest_pairs(points: DataFrame, key: Sequence[str], id: str, k: int = 4) -> DataFrame:
    """Undirected pairs (i, j, distance) of each point's k nearest within its frame; ties go to the smaller id. Frames hold few points."""
    b = points.select(*(F.col(c).alias(f"b_{c}") for c in points.columns))
    on = F.col(id) != F.col(f"b_{id}")
    for c in key:
        on = on & (F.col(c) == F.col(f"b_{c}"))
    d = F.sqrt(sum(((F.col(c) - F.col(f"b_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    ranked = points.join(b, on).withColumn("distance", d).withColumn("__r", F.row_number().over(W.partitionBy(*key, id).orderBy("distance", f"b_{id}")))
    return ranked.where(F.col("__r") <= k).select(*key, F.least(id, f"b_{id}").alias("i"), F.greatest(id, f"b_{id}").alias("j"), "distance").dropDuplicates([*key, "i", "j"])


def replace_groups(old: DataFrame, new: DataFrame, column: str = "grp") -> DataFrame:
    """old with every group that new has replaced by new's rows."""
    return old.join(new.select(column).distinct(), column, "left_anti").unionByName(new, allowMissingColumns=True)


def map_ids(df: DataFrame, mapping: DataFrame, column: str, source: str, target: str) -> DataFrame:
    """Ids translated where the mapping has them, else as they are."""
    m = mapping.select(F.col(source).alias("__s"), F.col(target).alias("__t"))
    return df.join(m, F.col(column) == F.col("__s"), "left").withColumn(column, F.coalesce("__t", column)).drop("__s", "__t")


def without_series(df: DataFrame, failed: DataFrame, key: str = "traj_id") -> DataFrame:
    return df.join(failed.select(key).distinct(), key, "left_anti")


def without_guest(df: DataFrame, guest: str, mode: str = "frames", key: str = "traj_id") -> DataFrame:
    """Rows without a guest (``frames``), rows of series that never have one (``never``), or ``all``."""
    if mode == "all":
        return df
    if mode == "frames":
        return df.where(F.coalesce(F.col(guest), F.lit(0)) < 1)
    if mode != "never":
        raise ValueError(f"unknown mode {mode!r}")
    free = df.groupBy(key).agg(F.max(F.coalesce(F.col(guest), F.lit(0))).alias("m")).where("m < 1")
    return df.join(free, key, "left_semi")


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """left with columns of right: every row of left once, as right is cut to its first row per key; NULL where it has none."""
    one = right.groupBy(*on).agg(*((F.min_by(F.struct(*columns), F.struct(*order)) if order else F.first(F.struct(*columns))).alias("__r"),))
    out = left.join(one, list(on), "left")
    for c in columns:
        out = out.withColumn(c, F.col(f"__r.{c}"))
    return out.drop("__r")


def attach_open_counts(frames: DataFrame, counts: DataFrame, column: str = "n_open", key: str = "traj_id", frame: str = "frame") -> DataFrame:
    """Frames with the number of open contacts of their series and frame; names of series are compared without cohort and suffix."""
    from ..functions.labels import series_id

    normal = lambda df: df.withColumn("__s", series_id(F.col(key)))
    return attach(normal(frames), normal(counts), ["__s", frame], [column], [column]).drop("__s")


def attach_occupancy(frames: DataFrame, features: DataFrame, column: str, key: Sequence[str] = ("traj_id", "frame")) -> DataFrame:
    """Frames with the guest occupancy of the feature table, the first row of a frame that has several."""
    return attach(frames, features, list(key), [column], [column])


def attach_energies(table: DataFrame, energies: DataFrame, step: str = "step", key: Sequence[str] = ()) -> DataFrame:
    """A feature table with the energies of its steps."""
    names = [c for c in energies.columns if c not in (*key, step) and c not in table.columns]
    return attach(table, energies, [*key, step], names, names)


def compare_tables(reference: DataFrame, candidate: DataFrame, key: Sequence[str], rtol: float = 1e-6, atol: float = 1e-9) -> DataFrame:
    """A row per value column: rows that agree, that differ, and that only one side has."""
    columns = [c for c in reference.columns if c in candidate.columns and c not in key]
    a = reference.select(*(F.col(k).alias(f"__{k}") for k in key), *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("__a"))
    b = candidate.select(*key, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("__b"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    kinds = dict(reference.dtypes)
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()

    def same(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(x), F.lit(False)) if kinds[c] in ("double", "float") else x.eqNullSafe(y)

    joined = a.join(b, on, "full")
    flags = joined.select(*(F.when(both, F.when(same(c), "same").otherwise("differs")).otherwise("missing").alias(c) for c in columns))
    return flags.unpivot([], columns, "column", "state").groupBy("column").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("same", "differs", "missing")))


def nesting(inner: DataFrame, outer: DataFrame, tolerance: int, key: str = "traj_id", at: str = "frame") -> DataFrame:
    """Per series the share of inner breakpoints near an outer one of the same series, and near one of any other series: how far they nest beyond chance."""
    a = inner.select(F.col(key).alias("k"), F.col(at).alias("at_a")).distinct().withColumn("one", F.lit(1))
    b = outer.select(F.col(key).alias("other"), F.col(at).alias("at_b"), F.lit(1).alias("one")).distinct()
    near = band_join(a, b, ["one"], "at_a", "at_b", tolerance).groupBy("k", "at_a").agg(F.max((F.col("k") == F.col("other")).cast("int")).alias("own"), F.countDistinct(F.when(F.col("k") != F.col("other"), F.col("other"))).alias("others"))
    n = outer.select(key).distinct().agg(F.count("*").alias("n"))
    met = a.join(near, ["k", "at_a"], "left").crossJoin(F.broadcast(n))  # one row
    return met.groupBy(F.col("k").alias(key)).agg(F.count("*").alias("n_inner"), F.avg(F.coalesce("own", F.lit(0))).alias("nested"), F.avg(F.coalesce("others", F.lit(0)) / F.nullif(F.col("n") - 1, F.lit(0))).alias("cross_null"))
