"""Sequence operators over ordered series: runs, dwells, transitions, plateaus, aligned windows.

Every window is partitioned by the series, so no task holds more than one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def number_frames(df: DataFrame, key: str | Sequence[str], order: Sequence[str], name: str = "frame") -> DataFrame:
    """Add consecutive numbers from 0 within each series."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*_keys(key)).orderBy(*order)) - 1).cast("long"))


def runs(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], label: str, step: str | None = None) -> DataFrame:
    """Add run_id, from 0 in each series: it grows where the label changes, or where ``step`` jumps by other than 1."""
    w = W.partitionBy(*_keys(key)).orderBy(*_keys(order))
    new = ~F.col(label).eqNullSafe(F.lag(label).over(w))
    if step:
        new = new | F.coalesce(F.col(step) - F.lag(step).over(w) != 1, F.lit(True))
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", (new & ~first).cast("long")).withColumn("run_id", F.sum("__new").over(w)).drop("__new")


def run_table(df: DataFrame, key: str | Sequence[str], order: str, label: str, step: str | None = None) -> DataFrame:
    """One row per run: keys, run_id, the label, start, end (inclusive) and n_rows."""
    keys = _keys(key)
    return runs(df, keys, order, label, step).groupBy(*keys, "run_id", label).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n_rows"))


def run_statistics(df: DataFrame, key: str | Sequence[str], order: str, flag: str) -> DataFrame:
    """Per series of a flag: persistence, n_frames, n_on, n_runs, mean and max run length of what is on, n_switches."""
    keys = _keys(key)
    on = df.withColumn("__on", F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    table = run_table(on, keys, order, "__on")
    held = F.when(F.col("__on"), F.col("n_rows"))
    return table.groupBy(*keys).agg(
        (F.coalesce(F.sum(held), F.lit(0)) / F.sum("n_rows")).alias("persistence"),
        F.sum("n_rows").alias("n_frames"),
        F.coalesce(F.sum(held), F.lit(0)).alias("n_on"),
        F.count(held).alias("n_runs"),
        F.coalesce(F.avg(held), F.lit(0.0)).alias("mean_run_length"),
        F.coalesce(F.max(held), F.lit(0)).alias("max_run_length"),
        (F.count("*") - 1).alias("n_switches"),
    )


def dwell_statistics(df: DataFrame, key: str | Sequence[str], order: str, label: str, min_persist: int = 20, step: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Median run length, and the percentage of rows that lie in runs of at least min_persist rows."""
    table = run_table(df, key, order, label, step)
    long = F.sum(F.when(F.col("n_rows") >= min_persist, F.col("n_rows")).otherwise(0))
    return table.groupBy(*by).agg(F.median("n_rows").alias("median_run"), (100.0 * long / F.sum("n_rows")).alias("pct_persistent"), F.count("*").alias("n_runs"))


def debounced_events(df: DataFrame, key: str, order: str, flag: str, min_dwell: int = 20) -> DataFrame:
    """Entries and exits of a flag that flickers: the state flips only when the new run lasts min_dwell rows.

    A shorter run belongs to the state before it. Series begin in state off. One row per
    flip: key, event (entry or exit), at (the first row of its run), dwell (rows until the
    next flip) and censored (the series ends before one).
    """
    keys = _keys(key)
    on = df.withColumn("__on", F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    table = run_table(on, keys, order, "__on")
    w = W.partitionBy(*keys).orderBy("start")
    total = table.groupBy(*keys).agg(F.sum("n_rows").alias("__total"))
    place = table.withColumn("__at", F.coalesce(F.sum("n_rows").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    settled = place.where(F.col("n_rows") >= min_dwell)
    flips = settled.withColumn("__before", F.coalesce(F.lag("__on").over(w), F.lit(False))).where("__on <> __before")
    until = F.lead("__at").over(w)
    return (
        flips.join(total, keys)
        .withColumn("__until", until)
        .select(*keys, F.when(F.col("__on"), "entry").otherwise("exit").alias("event"), F.col("start").alias("at"), (F.coalesce("__until", "__total") - F.col("__at")).alias("dwell"), F.col("__until").isNull().alias("censored"))
    )


def transitions(df: DataFrame, key: str, order: str | Sequence[str], label: str, lag: int = 1, keep_same: bool = False, step: str | None = None) -> DataFrame:
    """Each row with the label ``lag`` rows later: key, order columns, source, target.

    Steps to the same label go unless keep_same; with ``step``, only pairs whose step column grows by exactly 1 stay.
    """
    w = W.partitionBy(*_keys(key)).orderBy(*_keys(order))
    out = df.withColumn("source", F.col(label)).withColumn("target", F.lead(label, lag).over(w))
    if step:
        out = out.withColumn("__step", F.lead(step).over(w) - F.col(step)).where("__step = 1").drop("__step")
    out = out.where("target IS NOT NULL AND source IS NOT NULL")
    return out if keep_same else out.where("source <> target")


def transition_counts(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """source, target, n, and probability: n over all that leave the source."""
    counts = pairs.groupBy(*by, "source", "target").agg(F.count("*").alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(W.partitionBy(*by, "source")))


def transition_matrix(counts: DataFrame, states: DataFrame, value: str = "n") -> DataFrame:
    """Every pair of states (one column, state), with 0 where none was counted. States are few: a dimension, not data."""
    s = states.select(F.col("state").alias("source"))
    return s.crossJoin(states.select(F.col("state").alias("target"))).join(counts, ["source", "target"], "left").select("source", "target", F.coalesce(value, F.lit(0)).alias(value))


def step_rates(df: DataFrame, key: str, order: str, label: str, per: int = 1000, step: str | None = None) -> DataFrame:
    """Step counts that keep steps to the same label, scaled to ``per`` steps out of each source."""
    return transition_counts(transitions(df, key, order, label, keep_same=True, step=step)).withColumn("rate", per * F.col("probability"))


def state_paths(df: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Per series: its labels in order, runs collapsed, joined by ->, and how many."""
    table = run_table(df, key, order, label)
    path = F.transform(F.array_sort(F.collect_list(F.struct("start", label))), lambda s: s[label].cast("string"))
    return table.groupBy(*_keys(key)).agg(F.array_join(path, "->").alias("path"), F.count("*").alias("n_runs"), F.countDistinct(label).alias("n_states"))


def handoffs(segments: DataFrame, key: str = "traj_id", label: str = "cluster_label", order: Sequence[str] = ("start_frame", "segment_id")) -> DataFrame:
    """Neighbouring segments of different labels: both sides' labels, bounds and numbers."""
    w = W.partitionBy(*_keys(key)).orderBy(*order)
    nxt = {f"to_{c}": F.lead(c).over(w) for c in ("segment_id", "start_frame", "end_frame")}
    out = segments.withColumns({"source": F.col(label), "target": F.lead(label).over(w)} | nxt)
    return out.where("target IS NOT NULL AND source <> target")


def boundaries(df: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Rows where a new label begins, but for each series' first: key, order, source, target."""
    w = W.partitionBy(*_keys(key)).orderBy(order)
    return df.select(*_keys(key), order, F.lag(label).over(w).alias("source"), F.col(label).alias("target")).where("source <> target")


def rolling_std(df: DataFrame, key: str, order: str, value: str, window: int = 50) -> DataFrame:
    """Add n, i (from 0), w (the window, within 2 and n // 2) and rolling_std: the sample deviation of the w rows from this one on."""
    w = W.partitionBy(*_keys(key))
    ordered = w.orderBy(order)
    numbered = df.withColumn("__y", finite(value)).withColumns({"n": F.count("*").over(w), "i": F.row_number().over(ordered) - 1, "__all": F.collect_list(F.col("__y")).over(ordered.rowsBetween(0, window - 1))})
    width = F.greatest(F.lit(2), F.least(F.lit(window), F.floor(F.col("n") / 2))).cast("int")
    numbered = numbered.withColumn("w", width).withColumn("__win", F.slice("__all", 1, F.col("w")))
    mean = F.expr("aggregate(__win, 0D, (a, x) -> a + x) / size(__win)")
    numbered = numbered.withColumn("__mean", mean)
    spread = F.expr("sqrt(aggregate(transform(__win, x -> (x - __mean) * (x - __mean)), 0D, (a, x) -> a + x) / (size(__win) - 1))")
    whole = (F.col("i") + F.col("w") <= F.col("n")) & (F.size("__win") == F.col("w"))
    return numbered.withColumn("rolling_std", F.when(whole, spread)).drop("__all", "__win", "__mean", "__y")


def plateau(df: DataFrame, key: str, order: str, value: str, window: int = 50, rel: float = 0.12, abs_max: float | None = None) -> DataFrame:
    """Where a series settles: the first window from which on no window varies more than a threshold.

    The threshold is ``rel`` times the series' deviation, or ``abs_max`` if that is more; a
    series without deviation takes its mean size instead. If no tail is calm, the longest
    calm run counts. Series of fewer than 4 rows have none. One row per series: key,
    threshold, plateau_start (an order value, NULL if none), representative, mode and success.
    """
    keys = _keys(key)
    w = W.partitionBy(*keys)
    y = finite(value)
    sd = F.stddev_pop(y).over(w)
    size = F.avg(F.abs(y)).over(w) + 1e-12
    base = rel * F.when(F.coalesce(sd, F.lit(0.0)) > 0, sd).otherwise(size)
    tau = F.greatest(F.lit(float(abs_max)), base) if abs_max is not None else base
    rolled = rolling_std(df.withColumn("threshold", tau), keys, order, value, window)
    last = rolled.groupBy(*keys).agg(F.max(order).alias("__last"), F.max("n").alias("n"), F.max("threshold").alias("threshold"))
    starts = rolled.where("rolling_std IS NOT NULL AND n >= 4").withColumn("calm", F.col("rolling_std") <= F.col("threshold"))
    restless = starts.groupBy(*keys).agg(F.max(F.when(~F.col("calm"), F.col("i"))).alias("__bad"), F.max("i").alias("__end"))
    tail = starts.join(restless, keys).where((F.col("__bad").isNull()) | (F.col("i") > F.col("__bad"))).groupBy(*keys).agg(F.min(order).alias("tail_start"))
    runs_of = run_table(starts, keys, order, "calm").where("calm")
    best = runs_of.groupBy(*keys).agg(F.max_by(F.struct("start", "end"), F.struct("n_rows", (-F.col("start").cast("double")).alias("s"))).alias("__best"))
    out = last.join(tail, keys, "left").join(best, keys, "left")
    start = F.coalesce("tail_start", F.col("__best.start"))
    stop = F.when(F.col("tail_start").isNotNull(), F.col("__last")).otherwise(F.col("__best.end"))
    mode = F.when(F.col("n") < 4, "insufficient_data").when(F.col("tail_start").isNotNull(), "full_tail").when(F.col("__best").isNotNull(), "longest_segment").otherwise("none")
    return out.select(*keys, "threshold", start.alias("plateau_start"), F.rint((start + stop) / 2).alias("representative"), mode.alias("mode"), F.col("tail_start").isNotNull().alias("success"))


def gradient(value: str, key: str | Sequence[str], order: str | Sequence[str]) -> Column:
    """Central differences, one-sided at the ends; 0 in a series of one row."""
    w = W.partitionBy(*_keys(key)).orderBy(*_keys(order))
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - here).when(before.isNotNull(), here - before).otherwise(F.lit(0.0))


def relative_change(value: str, order: str, key: Sequence[str] = ()) -> Column:
    """The size of the change against the row before, relative to that."""
    before = F.lag(value).over(W.partitionBy(*key).orderBy(order))
    return F.abs(F.col(value) / F.nullif(before, F.lit(0)) - 1)


def elbow(df: DataFrame, x: str, y: str, key: Sequence[str] = ()) -> DataFrame:
    """The interior point farthest from the chord, after scaling both axes to 0..1: one row per key. x is used as it is; give its logarithm where that is meant."""
    w = W.partitionBy(*key)
    full = w.orderBy(x).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    scaled = df.select(
        *df.columns,
        F.row_number().over(w.orderBy(x)).alias("__k"),
        F.count("*").over(w).alias("__n"),
        ((F.col(x) - F.min(x).over(w)) / F.nullif(F.max(x).over(w) - F.min(x).over(w), F.lit(0))).alias("__x"),
        ((F.col(y) - F.min(y).over(w)) / F.nullif(F.max(y).over(w) - F.min(y).over(w), F.lit(0))).alias("__y"),
    ).withColumns({f"__{a}{e}": f(f"__{a}").over(full) for a in "xy" for e, f in (("0", F.first), ("1", F.last))})
    dx, dy = F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")
    away = F.abs(dy * (F.col("__x") - F.col("__x0")) - dx * (F.col("__y") - F.col("__y0"))) / F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    inner = scaled.withColumn("distance", away).where("__k > 1 AND __k < __n AND distance IS NOT NULL")
    best = F.row_number().over(w.orderBy(F.desc("distance"), x))
    return inner.withColumn("__r", best).where("__r = 1").select(*df.columns, "distance")


def stable_plateaus(df: DataFrame, x: str = "penalty", min_steps: int = 3, timing: float = 0.8, count_change: float = 0.1, key: Sequence[str] = ()) -> DataFrame:
    """Runs of at least min_steps penalties over which timing hardly changes and counts drift slowly, the best first.

    df has timing_jaccard_vs_prev, total_breakpoints and regime_agreement_vs_ref. The score
    is steps * median timing * (0.5 + 0.5 * median agreement).
    """
    changed = df.withColumn("count_rel_change", relative_change("total_breakpoints", x, key))
    calm = (F.coalesce("timing_jaccard_vs_prev", F.lit(1.0)) >= timing) & (F.coalesce("count_rel_change", F.lit(0.0)) <= count_change)
    blocks = runs(changed.withColumn("stable", calm), list(key), x, "stable").where("stable").groupBy(*key, "run_id")
    out = blocks.agg(
        F.min(x).alias("penalty_min"),
        F.max(x).alias("penalty_max"),
        F.sqrt(F.min(x) * F.max(x)).alias("penalty_mid"),
        F.count("*").alias("n_steps"),
        F.median("timing_jaccard_vs_prev").alias("median_timing"),
        F.median("regime_agreement_vs_ref").alias("median_regime"),
    ).where(F.col("n_steps") >= min_steps)
    regime = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("median_regime", F.lit(0.0))))
    return out.withColumn("stability_score", F.col("n_steps") * F.coalesce("median_timing", F.lit(0.0)) * (0.5 + 0.5 * regime)).orderBy(F.desc("stability_score"))


def aligned(df: DataFrame, events: DataFrame, key: str, order: str, values: Sequence[str], before: int, after: int) -> DataFrame:
    """Values around events (key, origin): a row per event and lag from -before to after, NULL outside the series."""
    lags = events.select(key, "origin", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("lag")).withColumn("__at", F.col("origin") + F.col("lag"))
    right = df.select(F.col(key).alias("__key"), F.col(order).alias("__order"), *values)
    return lags.join(right, (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__order")), "left").select(key, "origin", "lag", *values)


def window_contrast(df: DataFrame, events: DataFrame, key: str, order: str, value: str, window: int = 25) -> DataFrame:
    """Around each event (key, origin, an order value): means before and after, their difference, the jump at the boundary and the largest step.

    Windows are counted in rows. Differences are also given in units of the value's overall
    population deviation. Events without rows on either side are left out.
    """
    y = finite(value)
    numbered = df.select(F.col(key).alias("__key"), F.col(order).alias("__order"), y.alias("__y"), F.row_number().over(W.partitionBy(key).orderBy(order)).alias("__i"))
    w = W.partitionBy("__key").orderBy("__i")
    stepped = numbered.withColumn("__step", F.abs(F.col("__y") - F.lag("__y").over(w)))
    origin = events.join(stepped.select("__key", "__order", F.col("__i").alias("__at")), (F.col(key) == F.col("__key")) & (F.col("origin") == F.col("__order"))).select(*events.columns, "__at")
    near = origin.join(stepped, (F.col(key) == F.col("__key")) & F.col("__i").between(F.col("__at") - window, F.col("__at") + window - 1))
    pre, post = F.col("__i") < F.col("__at"), F.col("__i") >= F.col("__at")
    inside = F.when(F.col("__i") > F.col("__at") - window, F.col("__step"))
    stats = near.groupBy(*events.columns, "__at").agg(
        F.avg(F.when(pre, F.col("__y"))).alias("pre_mean"),
        F.avg(F.when(post, F.col("__y"))).alias("post_mean"),
        F.max(F.when(F.col("__i") == F.col("__at"), F.col("__y"))).alias("__first"),
        F.max(F.when(F.col("__i") == F.col("__at") - 1, F.col("__y"))).alias("__last"),
        F.max(inside).alias("peak_step"),
        F.min_by(F.col("__i") - F.col("__at"), F.struct((-inside).alias("s"), F.col("__i").alias("i"))).alias("peak_row"),
    )
    scale = df.agg(F.nullif(F.stddev_pop(y), F.lit(0.0)).alias("__scale"))
    delta = F.col("post_mean") - F.col("pre_mean")
    full = stats.where("pre_mean IS NOT NULL AND post_mean IS NOT NULL").crossJoin(F.broadcast(scale))  # one row
    return full.select(*events.columns, "pre_mean", "post_mean", delta.alias("delta"), (delta / F.col("__scale")).alias("std_delta"), (F.col("__first") - F.col("__last")).alias("jump"), "peak_step", "peak_row")


def regime_directions(segments: DataFrame, columns: Sequence[str], key: Sequence[str] = ("traj_id", "grp")) -> DataFrame:
    """The sign of each column's change from the first to the last segment: long, with feature and direction."""
    ends = segments.groupBy(*key).agg(*(F.signum(F.max_by(c, "segment_id") - F.min_by(c, "segment_id")).alias(c) for c in columns))
    return ends.unpivot(list(key), list(columns), "feature", "direction")


def regime_agreement(reference: DataFrame, other: DataFrame, key: Sequence[str] = ("traj_id", "grp")) -> DataFrame:
    """The share of directions that two sets of segments have in common."""
    both = reference.join(other.withColumnRenamed("direction", "__other"), [*key, "feature"]).where("direction IS NOT NULL AND __other IS NOT NULL")
    return both.agg(F.avg((F.col("direction") == F.col("__other")).cast("double")).alias("agreement"), F.count("*").alias("n"))


def entered_exited(df: DataFrame, key: str, order: str, members: str) -> DataFrame:
    """Against the row before, which members of a set are new and which are gone."""
    now = F.coalesce(F.col(members), F.array().cast(df.schema[members].dataType))
    prev = F.coalesce(F.lag(members).over(W.partitionBy(key).orderBy(order)), F.array().cast(df.schema[members].dataType))
    return df.select(key, order, F.array_sort(F.array_except(now, prev)).alias("entered"), F.array_sort(F.array_except(prev, now)).alias("exited"))


def residences(events: DataFrame, ends: DataFrame, key: Sequence[str] = ("traj_id", "guest"), order: str = "frame") -> DataFrame:
    """Stays from events (key, frame, event): the k-th entry with the k-th exit; one still inside leaves at the series' end.

    ends has traj_id and last_frame.
    """
    keys = list(key)
    ranked = events.withColumn("k", F.row_number().over(W.partitionBy(*keys, "event").orderBy(order)))
    entry = ranked.where("event = 'entry'").select(*keys, "k", F.col(order).alias("entry"))
    leave = ranked.where("event = 'exit'").select(*keys, "k", F.col(order).alias("exit"))
    out = entry.join(leave, [*keys, "k"], "left").join(ends, keys[0])
    return out.select(*keys, "k", "entry", F.coalesce("exit", "last_frame").alias("exit"), (F.coalesce("exit", "last_frame") - F.col("entry")).alias("duration"), F.col("exit").isNull().alias("open"))


def sign_flips(df: DataFrame, key: str | Sequence[str], order: str, value: str, near_zero: float = 0.05) -> DataFrame:
    """Per series how often a value changes sign, values near zero left out."""
    keys = _keys(key)
    some = df.where(F.abs(F.col(value)) > near_zero).withColumn("__s", F.signum(value))
    flip = F.col("__s") != F.lag("__s").over(W.partitionBy(*keys).orderBy(order))
    counts = some.withColumn("__f", flip).groupBy(*keys).agg(F.count_if("__f").alias("n_flips"))
    return df.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["n_flips"])


def frame_step(df: DataFrame, key: str = "traj_id", order: str = "frame") -> DataFrame:
    """The commonest positive step between neighbours, the smaller of equals: one row, step."""
    gap = df.select((F.lead(order).over(W.partitionBy(key).orderBy(order)) - F.col(order)).alias("step")).where("step > 0")
    return gap.groupBy("step").count().agg(F.max_by("step", F.struct("count", (-F.col("step")).alias("s"))).alias("step"))


def contrast_summary(contrasts: DataFrame, by: Sequence[str], value: str = "delta", n: int = 500, seed: int = 0) -> DataFrame:
    """Mean change per kind of event with the 2.5 and 97.5 percentiles of resampled means; events of a kind are few beside frames."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].dropna().to_numpy(float)
        draws = np.random.default_rng(seed).choice(v, (n, len(v))).mean(axis=1) if len(v) else np.array([np.nan])
        return pd.DataFrame([(*pdf[list(by)].iloc[0], len(v), v.mean() if len(v) else None, *np.quantile(draws, [0.025, 0.975]))], columns=[*by, "n_events", "mean", "low", "high"])

    schema = "".join(f"{c} {contrasts.schema[c].dataType.simpleString()}, " for c in by)
    return contrasts.groupBy(*by).applyInPandas(one, f"{schema}n_events long, mean double, low double, high double")
