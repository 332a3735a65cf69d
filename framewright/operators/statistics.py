"""Effect sizes, associations and selections as plans over sums; resampling in Arrow functions per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..kernels import statistics as K


def eta_squared(long: DataFrame, value: str, label: str, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Share of variance between labels, from each label's count, sum and sum of squares."""
    v = finite(value)
    each = long.groupBy(*by, label).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    out = each.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("b"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    centre = F.col("s") * F.col("s") / F.col("n")
    total = F.col("q") - centre
    return out.select(*by, F.col("n"), F.when(total > 0, (F.col("b") - centre) / total).alias("eta_squared"))


def cohens_d(long: DataFrame, value: str, flag: Column, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Difference of means over the pooled sample deviation; NULL with fewer than two values on a side."""
    v = finite(value)
    a, b = F.when(flag, v), F.when(~flag, v)
    out = long.groupBy(*by).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return out.select(*by, F.when((F.col("na") > 1) & (F.col("nb") > 1) & (pooled > 0), (F.col("ma") - F.col("mb")) / pooled).alias("cohens_d"))


def point_biserial(long: DataFrame, value: str, flag: Column, by: Sequence[str] = ("feature",)) -> DataFrame:
    v = finite(value)
    return long.groupBy(*by).agg(F.corr(v, F.when(v.isNotNull(), flag.cast("double"))).alias("r"))


def average_rank(value: str, *by: str) -> Column:
    """Ranks from 1; equal values share their mean rank."""
    w = W.partitionBy(*by).orderBy(value)
    same = W.partitionBy(*by, value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def cumulative(counted: DataFrame, value: str, n: str, parts: int = 64) -> DataFrame:
    """Different values of groups (__by, value, n) with __part, __upto and __m: a range of values, how many rows are not greater, and how many there are.

    Values are summed within ``parts`` ranges of each group, so that no task gets a whole
    group; what lies before a range comes from the sums of whole ranges, a few rows a group.
    """
    ranged = counted.withColumn("__part", F.lit(0))
    if parts > 1:
        bounds = counted.groupBy("__by").agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 1_000).alias("__bounds"))
        inside = F.size(F.filter(F.array_distinct("__bounds"), lambda x: x < F.col(value)))
        ranged = counted.join(bounds, "__by").withColumn("__part", inside).drop("__bounds")
    on = ["__by", "__part"]
    sums = ranged.groupBy(*on).agg(F.sum(n).alias("__in"))
    ahead = W.partitionBy("__by").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*on, F.coalesce(F.sum("__in").over(ahead), F.lit(0)).alias("__before"), F.sum("__in").over(W.partitionBy("__by")).alias("__m"))
    within = F.sum(n).over(W.partitionBy(*on).orderBy(value))
    return ranged.join(sums, on).withColumn("__upto", F.col("__before") + within).drop("__before")


def kruskal_epsilon(long: DataFrame, value: str, label: str, by: Sequence[str] = ("feature",), parts: int = 64) -> DataFrame:
    """Kruskal-Wallis H, corrected for ties, and epsilon squared = H / (n - 1).

    Equal values share their mean rank, so different ones are counted first and ranked in ranges.
    """
    some = long.where(finite(value).isNotNull()).select(F.struct(*by).alias("__by"), F.col(label).alias("__l"), F.col(value).alias("__v"))
    counts = some.groupBy("__by", "__l", "__v").agg(F.count("*").alias("__c"))
    each = counts.groupBy("__by", "__v").agg(F.sum("__c").alias("__n"))
    ranks = cumulative(each, "__v", "__n", parts).select("__by", "__v", "__m", (F.col("__upto") - (F.col("__n") - 1) / 2).alias("__r"))
    sums = counts.join(ranks, ["__by", "__v"]).groupBy("__by", "__l").agg(F.sum(F.col("__c") * F.col("__r")).alias("s"), F.sum("__c").alias("m"), F.max("__m").alias("n"))
    t = F.col("__n").cast("double")
    ties = each.groupBy("__by").agg(F.sum(t * t * t - t).alias("ties"))
    h = sums.groupBy("__by").agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("h"), F.max("n").cast("double").alias("n")).join(ties, "__by")
    raw = 12.0 / (F.col("n") * (F.col("n") + 1)) * F.col("h") - 3 * (F.col("n") + 1)
    fix = 1 - F.col("ties") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))
    return h.select("__by.*", F.when(fix > 0, raw / fix).alias("h"), F.when(fix > 0, raw / fix / (F.col("n") - 1)).alias("epsilon_squared"))


def correlations(long: DataFrame, x: str, y: str, by: Sequence[str], spearman: bool = True) -> DataFrame:
    """Pearson's r with its two-sided p, and Spearman's, over pairs that are both finite."""
    some = long.where(finite(x).isNotNull() & finite(y).isNotNull())
    if spearman:
        some = some.withColumns({"__rx": average_rank(x, *by), "__ry": average_rank(y, *by)})
    aggs = [F.corr(x, y).alias("pearson"), F.count("*").alias("n")]
    out = some.groupBy(*by).agg(*aggs, *([F.corr("__rx", "__ry").alias("spearman")] if spearman else []))

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([K.pearson_p(a, int(b)) if a is not None and np.isfinite(a) else None for a, b in zip(r, n)], dtype="float64")

    return out.withColumn("p", p_value("pearson", "n"))


def key_pairs(variation: DataFrame, correlation: DataFrame, pair: Sequence[str], least_variation: float = 0.1, least_r: float = 0.7, k: int = 10) -> DataFrame:
    """The k pairs that vary most together with a series: cv and |r| above their limits, by |r|."""
    return variation.join(correlation, list(pair)).where((F.col("cv") >= least_variation) & (F.abs("pearson") >= least_r)).orderBy(F.desc(F.abs("pearson")), *pair).limit(k)


def association(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of a contingency table (by, a, b, n): mutual information, normalised by the mean entropy, V-measure parts, Cramér's V and the adjusted Rand index."""
    w = W.partitionBy(*by)
    t = table.withColumns({"ra": F.sum("n").over(W.partitionBy(*by, "a")), "rb": F.sum("n").over(W.partitionBy(*by, "b")), "t": F.sum("n").over(w)}).withColumns({"na": F.count("*").over(W.partitionBy(*by, "a")), "nb": F.count("*").over(W.partitionBy(*by, "b"))})
    n, a, b, total = (F.col(c).cast("double") for c in ("n", "ra", "rb", "t"))
    choose = lambda c: c * (c - 1) / 2
    out = t.groupBy(*by).agg(
        F.max(total).alias("t"),
        F.sum(n / total * F.log(n * total / (a * b))).alias("mi"),
        F.sum(-(a / total) * F.log(a / total) / F.col("na")).alias("ha"),
        F.sum(-(b / total) * F.log(b / total) / F.col("nb")).alias("hb"),
        F.sum(n * n / (a * b)).alias("x"),
        F.countDistinct("a").alias("ka"),
        F.countDistinct("b").alias("kb"),
        F.sum(choose(n)).alias("same"),
        F.sum(choose(a) / F.col("na")).alias("pa"),
        F.sum(choose(b) / F.col("nb")).alias("pb"),
    )
    c = F.col
    mean = (c("ha") + c("hb")) / 2
    nmi = F.when(mean > 0, c("mi") / mean).otherwise(F.lit(1.0))
    v = F.when(F.least("ka", "kb") > 1, F.sqrt(F.greatest(c("x") - 1, F.lit(0.0)) / (F.least("ka", "kb") - 1)))
    chance = c("pa") * c("pb") / F.nullif(choose(c("t")), F.lit(0.0))
    top = (c("pa") + c("pb")) / 2 - chance
    return out.select(
        *by,
        c("t").cast("long").alias("n"),
        c("mi").alias("mutual_information"),
        nmi.alias("nmi"),
        F.when(c("ha") > 0, c("mi") / c("ha")).otherwise(F.lit(1.0)).alias("homogeneity"),
        F.when(c("hb") > 0, c("mi") / c("hb")).otherwise(F.lit(1.0)).alias("completeness"),
        v.alias("cramers_v"),
        F.when(top != 0, (c("same") - chance) / top).otherwise(F.lit(1.0)).alias("ari"),
    )


def adjusted_mutual_information(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mutual information corrected for chance, per group of a contingency table."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="a", columns="b", values="n", aggfunc="sum", fill_value=0).to_numpy()
        return pd.DataFrame([(*pdf[list(by)].iloc[0], K.adjusted_mutual_information(wide))], columns=[*by, "ami"])

    schema = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in by)
    return table.groupBy(*by).applyInPandas(one, f"{schema}, ami double")


def bootstrap_nmi(tables: DataFrame, by: str = "k", block: str = "traj_id", n: int = 500, seed: int = 0) -> DataFrame:
    """Per k the NMI of summed per-block contingency tables (by, block, a, b, n), and its deviation over resampled blocks, the same draws for every k."""
    blocks = [r[0] for r in tables.select(block).distinct().orderBy(block).collect()]  # one per replica: the unit of resampling, few by nature
    weights = np.random.default_rng(seed).multinomial(len(blocks), np.full(len(blocks), 1 / max(1, len(blocks))), size=n) if blocks else np.zeros((n, 0), int)
    at = {b: i for i, b in enumerate(blocks)}

    def nmi(t: np.ndarray) -> float:
        total, a, b = t.sum(), t.sum(axis=1), t.sum(axis=0)
        h = lambda p: -(p[p > 0] / total * np.log(p[p > 0] / total)).sum()
        i, j = np.nonzero(t)
        mi = (t[i, j] / total * np.log(t[i, j] * total / (a[i] * b[j]))).sum()
        m = (h(a) + h(b)) / 2
        return float(mi / m) if m > 0 else 1.0

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pd.factorize(pdf["a"], sort=True)[0], pd.factorize(pdf["b"], sort=True)[0]
        cube = np.zeros((len(blocks), a.max() + 1, b.max() + 1))
        np.add.at(cube, (pdf[block].map(at).to_numpy(), a, b), pdf["n"].to_numpy())
        draws = [nmi(t) for t in np.tensordot(weights, cube, axes=1) if t.sum()]
        return pd.DataFrame([(pdf[by].iloc[0], nmi(cube.sum(axis=0)), float(np.std(draws, ddof=1)) if len(draws) > 1 else None)], columns=[by, "nmi", "se"])

    return tables.groupBy(by).applyInPandas(one, f"{by} {tables.schema[by].dataType.simpleString()}, nmi double, se double")


def bh_qvalues(df: DataFrame, p: str = "p", by: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """q-values of the p-values that are not missing, within by.

    Equal p-values share one q, so different ones are counted first, and ranked within
    ``parts`` ranges of them; what lies before and after a range comes from sums and least
    values of whole ranges, a few rows for each group.
    """
    group = F.struct(*by) if by else F.lit(0)  # structs with null fields are equal
    each = df.select(group.alias("__by"), finite(p).alias("__p")).where("__p IS NOT NULL").groupBy("__by", "__p").agg(F.count("*").alias("__n"))
    raw = cumulative(each, "__p", "__n", parts).withColumn("__raw", F.col("__p") * F.col("__m") / F.col("__upto"))
    on = ["__by", "__part"]
    low = raw.groupBy(*on).agg(F.min("__raw").alias("__low"))
    behind = W.partitionBy("__by").orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)
    later = low.select(*on, F.min("__low").over(behind).alias("__later"))
    least = F.min("__raw").over(W.partitionBy(*on).orderBy(F.desc("__p")))
    q = raw.join(later, on).select("__by", "__p", F.least(F.lit(1.0), least, F.coalesce("__later", F.lit(1.0))).alias("q"))
    return df.drop("q").join(q, (finite(p) == F.col("__p")) & (group == F.col("__by")), "left").drop("__p", "__by")


def permutation_eta(wide: DataFrame, columns: Sequence[str], label: str, by: Sequence[str] = (), n: int = 999, seed: int = 0) -> DataFrame:
    """Per group and column: eta squared and its permutation p. A group is one cohort's segments: a bounded table."""
    keys = list(by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(columns)].to_numpy(float)
        x = np.where(np.isfinite(x), x, np.nanmean(np.where(np.isfinite(x), x, np.nan), axis=0))
        eta, p = K.permutation_p(x, pdf[label].to_numpy(), n, seed)
        out = pd.DataFrame({"feature": list(columns), "eta_squared": eta, "p": p})
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[[*keys, "feature", "eta_squared", "p"]]

    schema = "".join(f"{k} {wide.schema[k].dataType.simpleString()}, " for k in keys) + "feature string, eta_squared double, p double"
    return (wide.groupBy(*keys) if keys else wide.groupBy(F.lit("all").alias("__all"))).applyInPandas(one, schema)


def rank_features(eta: DataFrame, epsilon: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features by eta squared, then epsilon squared, then name."""
    both = eta.join(epsilon, [*by, "feature"], "left")
    return both.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last("eta_squared"), F.desc_nulls_last("epsilon_squared"), "feature")))


def sufficient_statistics(long: DataFrame, value: str, series: str, label: str, by: Sequence[str] = ("feature",)) -> DataFrame:
    """N, S, Q per series and label: all that any weighted R squared needs."""
    v = finite(value)
    return long.groupBy(*by, series, label).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def r_squared(stats: DataFrame, label: str, by: Sequence[str] = (), fit: str | None = None, evaluate: str | None = None) -> DataFrame:
    """1 - SSE / SST with label means fitted under one weight column and judged under another; without them, all rows count once."""
    wf, we = (F.col(c) if c else F.lit(1.0) for c in (fit, evaluate))
    sums = stats.groupBy(*by, "feature", label).agg(*(F.sum(w * F.col(c)).alias(f"{p}{c}") for p, w in (("f", wf), ("e", we)) for c in ("n", "s", "q")))
    mean = F.when(F.col("fn") > 0, F.col("fs") / F.col("fn"))
    total = W.partitionBy(*by, "feature")
    whole = F.sum("fs").over(total) / F.nullif(F.sum("fn").over(total), F.lit(0))
    loss = lambda m: F.col("eq") - 2 * m * F.col("es") + m * m * F.col("en")
    parts = sums.withColumns({"__sse": loss(F.coalesce(mean, whole)), "__sst": loss(whole)})
    out = parts.groupBy(*by).agg(F.sum("__sse").alias("sse"), F.sum("__sst").alias("sst"))
    return out.withColumn("r2", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")))


def bootstrap_weights(stats: DataFrame, series: str, n: int = 500, seed: int = 0) -> DataFrame:
    """Draws of whole series: b, series, w (how often it was drawn) and out (1 where it was not); the same for whatever they are joined to."""
    names = [r[0] for r in stats.select(series).distinct().orderBy(series).collect()]  # replicas, few by nature
    spark = stats.sparkSession
    draws = np.random.default_rng(seed).multinomial(len(names), np.full(len(names), 1 / max(1, len(names))), size=n) if names else np.zeros((0, 0), int)
    rows = pd.DataFrame({"b": np.repeat(np.arange(len(draws)), len(names)), "i": np.tile(np.arange(len(names)), len(draws)), "w": draws.ravel().astype(float)})
    dim = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"i long, {series} {stats.schema[series].dataType.simpleString()}")
    return spark.createDataFrame(rows, "b long, i long, w double").join(F.broadcast(dim), "i").select("b", series, "w", (F.col("w") == 0).cast("double").alias("out"))


def bootstrap_r_squared(stats: DataFrame, series: str, label: str, by: Sequence[str] = ("k",), n: int = 500, seed: int = 0) -> DataFrame:
    """In-sample R squared, and out-of-bag R squared over resampled series: its mean and deviation."""
    inside = r_squared(stats, label, by).select(*by, F.col("r2").alias("in_sample"))
    drawn = stats.join(F.broadcast(bootstrap_weights(stats, series, n, seed)), series)  # replicas times draws, both small
    outside = r_squared(drawn, label, [*by, "b"], "w", "out").groupBy(*by).agg(F.avg("r2").alias("out_of_bag"), F.stddev_samp("r2").alias("se"))
    return inside.join(outside, list(by))


def one_se(scores: DataFrame, score: str, se: str, k: str = "k", gate: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The smallest gated k whose score is within one standard error of the best gated one."""
    some = scores.where(F.col(gate)) if gate else scores
    w = W.partitionBy(*by)
    best = F.max_by(F.struct(score, se), F.struct(F.col(score), (-F.col(k)).alias("m"))).over(w)
    near = some.where(F.col(score).isNotNull()).withColumn("__b", best).where(F.col(score) >= F.col("__b")[score] - F.coalesce(F.col("__b")[se], F.lit(0.0)))
    return near.withColumn("__r", F.row_number().over(w.orderBy(k))).where("__r = 1").drop("__r", "__b")


def block_sums(vectors: DataFrame, id: str, vector: str, label: str, block: int = 4_096, own: bool = False) -> DataFrame:
    """Per row i, its label l and each label m (or its own alone): s and n, the sum of Euclidean distances to the label's other rows, and how many those are.

    Rows are dealt to blocks, each block goes to every other once (of the same label, with
    own), and a task gets the sums of one block's rows against another's from one matrix
    product: the work is quadratic in rows, as the measures built on it are, but what is
    sent is a row a block.
    """
    kind, mark = (vectors.schema[c].dataType.simpleString() for c in (id, label))
    blocks = int(vectors.count() // block + 1)
    at = F.pmod(F.xxhash64(F.col(id)), F.lit(blocks)).cast("int")
    base = vectors.select(F.col(id).alias("i"), F.transform(vector, lambda x: x.cast("double")).alias("x"), F.col(label).alias("l"), at.alias("at"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    where = F.struct(F.col("l")) if own else F.struct(F.lit(0).alias("l"))
    left = base.withColumn("other", every).select((F.col("at") * blocks + F.col("other")).alias("cell"), where.alias("of"), "i", "x", "l")
    right = base.withColumn("other", every).select((F.col("other") * blocks + F.col("at")).alias("cell"), where.alias("of"), *(F.col(c).alias(c) for c in "ixl"))
    names = ["i", "l", "m", "s", "n"]

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        x, y = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
        middle = y.mean(axis=0)
        x, y = x - middle, y - middle
        d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))
        same = a["i"].to_numpy()[:, None] == b["i"].to_numpy()[None, :]
        d[same] = 0.0
        codes, labels = pd.factorize(b["l"])
        out = [pd.DataFrame({"i": a["i"], "l": a["l"], "m": m, "s": d[:, codes == k].sum(axis=1), "n": (~same[:, codes == k]).sum(axis=1)}) for k, m in enumerate(labels)]
        return pd.concat(out, ignore_index=True)[names]

    met = left.groupBy("of", "cell").cogroup(right.groupBy("of", "cell")).applyInPandas(sums, f"i {kind}, l {mark}, m {mark}, s double, n long")
    return met.groupBy("i", "l", "m").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def silhouette(vectors: DataFrame, id: str, vector: str, label: str, block: int = 4_096) -> DataFrame:
    """Per row and label the Euclidean silhouette, from mean distances to every label."""
    mean = block_sums(vectors, id, vector, label, block).withColumn("d", F.col("s") / F.nullif("n", F.lit(0)))
    out = mean.groupBy("i", "l").agg(F.max(F.when(F.col("l") == F.col("m"), F.col("d"))).alias("a"), F.min(F.when(F.col("l") != F.col("m"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return out.select(F.col("i").alias(id), F.col("l").alias(label), s.alias("silhouette"))


def two_sample(df: DataFrame, value: str, flag: str, by: Sequence[str]) -> DataFrame:
    """Per group the energy and Wasserstein distances of two samples, the shift of medians in robust units, and Cohen's d."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].to_numpy(float)
        f = pdf[flag].to_numpy(bool)[np.isfinite(v)]
        v = v[np.isfinite(v)]
        a, b = v[f], v[~f]
        row = [None] * 4
        if len(a) and len(b):
            mad = 1.4826 * np.median(np.abs(v - np.median(v)))
            pooled = np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)) if len(a) > 1 and len(b) > 1 else 0
            row = [K.energy_distance(a, b), K.wasserstein(a, b), (np.median(a) - np.median(b)) / mad if mad else None, (a.mean() - b.mean()) / pooled if pooled else None]
        return pd.DataFrame([(*pdf[list(by)].iloc[0], *row)], columns=[*by, "energy", "wasserstein", "median_shift", "cohens_d"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.groupBy(*by).applyInPandas(one, f"{schema}, energy double, wasserstein double, median_shift double, cohens_d double")


def variance_split(df: DataFrame, value: str, segment: str, series: str, by: Sequence[str]) -> DataFrame:
    """Shares of variance within segments, between segments of a series, and between series."""
    v = finite(value)
    seg = df.groupBy(*by, series, segment).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    rep = W.partitionBy(*by, series)
    seg = seg.withColumns({"rn": F.sum("n").over(rep), "rs": F.sum("s").over(rep), "segs": F.count("*").over(rep)})
    out = seg.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 / F.nullif("n", F.lit(0))).alias("bs"), F.sum(F.col("rs") ** 2 / F.nullif("rn", F.lit(0)) / F.col("segs")).alias("br"))
    c = F.col
    centre = c("s") ** 2 / c("n")
    total = F.nullif(c("q") - centre, F.lit(0.0))
    return out.select(*by, ((c("q") - c("bs")) / total).alias("within_segment"), ((c("bs") - c("br")) / total).alias("between_segments"), ((c("br") - centre) / total).alias("between_series"))


def mixtures(df: DataFrame, value: str, by: Sequence[str], block: str | None = None, **limits) -> DataFrame:
    """Per group whether two normals describe the values better than one."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = K.two_populations(pdf[value].to_numpy(float), pdf[block].to_numpy() if block else None, **limits)
        return pd.DataFrame([(*pdf[list(by)].iloc[0], r["n"], r["verdict"], r["delta_bic"], r["ashman_d"], r["minor_share"], r["minor_blocks"])], columns=[*by, "n", "verdict", "delta_bic", "ashman_d", "minor_share", "minor_blocks"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.groupBy(*by).applyInPandas(one, f"{schema}, n long, verdict string, delta_bic double, ashman_d double, minor_share double, minor_blocks long")


def signed_rank(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Wilcoxon's signed-rank p per group, with the median and the quartiles."""
    from .aggregates import summarise

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*pdf[list(by)].iloc[0], K.wilcoxon(pdf[value].to_numpy(float)))], columns=[*by, "p"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return summarise(df, value, by).join(df.groupBy(*by).applyInPandas(one, f"{schema}, p double"), list(by))


def least_squares(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Ordinary least squares with a constant, per group, solved from sums of products: intercept and b_<x>."""
    terms = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    ok = finite(y).isNotNull()
    for x in xs:
        ok = ok & finite(x).isNotNull()
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]) for i in range(k) for j in range(k)]
    found = df.where(ok).groupBy(*by).agg(F.array(*sums).alias("a"), F.array(*(F.sum(t * F.col(y)) for t in terms)).alias("c"))

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.array(p, float).reshape(k, k), np.array(q, float), rcond=None)[0].tolist() for p, q in zip(a, c)])

    out = found.withColumn("b", solve("a", "c"))
    return out.select(*by, F.col("b")[0].alias("intercept"), *(F.col("b")[i + 1].alias(f"b_{x}") for i, x in enumerate(xs)))


def peaks(df: DataFrame, value: str, by: Sequence[str], width: float = 0.05, sigma: float = 2.0, prominence: float = 0.05, expected: Sequence[float] = (), tolerance: float = 0.4) -> DataFrame:
    """Peaks of each group's smoothed histogram, with the expected place each is nearest to within a tolerance. The histogram is counted by Spark; only its bins are gathered."""
    bins = df.where(finite(value).isNotNull()).groupBy(*by, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    spots = list(expected)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.repeat((pdf["bin"].to_numpy() + 0.5) * width, pdf["n"].to_numpy())
        rows = []
        for at, height, depth in K.histogram_peaks(x, width, sigma, prominence):
            near = min(spots, key=lambda e: abs(e - at), default=None)
            rows.append((*pdf[list(by)].iloc[0], at, height, depth, near if near is not None and abs(near - at) <= tolerance else None))
        return pd.DataFrame(rows, columns=[*by, "position", "height", "prominence", "expected"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return bins.groupBy(*by).applyInPandas(one, f"{schema}, position double, height double, prominence double, expected double")


def chemical_gate(ranking: DataFrame, sizes: DataFrame, top: int = 10, least_size: int = 5, least_d: float = 0.5) -> DataFrame:
    """Per k whether clusters are told apart by contacts: at least two clusters of least_size segments are marked, by two or more different features or with d of either sign.

    ranking has k, feature, rank, cluster and cohens_d; sizes has k, cluster and n.
    """
    large = sizes.where(F.col("n") >= least_size)
    marks = ranking.where((F.col("rank") <= top) & (F.abs("cohens_d") >= least_d)).join(large.select("k", "cluster"), ["k", "cluster"])
    found = marks.groupBy("k").agg(F.countDistinct("cluster").alias("marked"), F.countDistinct("feature").alias("features"), F.countDistinct(F.signum("cohens_d")).alias("signs"))
    return large.groupBy("k").agg(F.count("*").alias("large")).join(found, "k", "left").select("k", F.coalesce((F.col("large") >= 2) & (F.col("marked") >= 2) & ((F.col("features") >= 2) | (F.col("signs") >= 2)), F.lit(False)).alias("chemical_separation"), "large", F.coalesce("marked", F.lit(0)).alias("marked"))


def map_labels(table: DataFrame) -> DataFrame:
    """Of a contingency table (a, b, n) the one-to-one mapping of labels with the largest overlap: a, b, n. Labels are few."""
    from ..kernels.hierarchy import assign

    rows = table.toPandas()  # a row per pair of labels
    wide = rows.pivot_table(index="a", columns="b", values="n", aggfunc="sum", fill_value=0)
    pairs = [(wide.index[i], wide.columns[j], int(wide.iat[i, j])) for i, j in assign(-wide.to_numpy(float))]
    kinds = {c: table.schema[c].dataType.simpleString() for c in ("a", "b")}
    return table.sparkSession.createDataFrame([(a.item() if hasattr(a, "item") else a, b.item() if hasattr(b, "item") else b, n) for a, b, n in pairs], f"a {kinds['a']}, b {kinds['b']}, n long")


def discriminant(frames: DataFrame, columns: Sequence[str], label: str, by: Sequence[str], key: str = "traj_id", components: int = 5) -> DataFrame:
    """Per group the loadings of linear discriminants, and the balanced accuracy of labels on series that were left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, g = pdf[list(columns)].to_numpy(float), pdf[label].to_numpy(), pdf[key].to_numpy()
        ok = np.isfinite(x).all(axis=1)
        x, y, g = x[ok], y[ok], g[ok]
        sd = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
        _, load = K.lda(z, y, components)
        scores = []
        for k in np.unique(g):
            test = g == k
            if test.all() or len(np.unique(y[~test])) < 2:
                continue
            _, part = K.lda(z[~test], y[~test], components)
            guess = K.nearest_centroid(z[~test] @ part, y[~test], z[test] @ part)
            scores.append(np.mean([(guess[y[test] == c] == c).mean() for c in np.unique(y[test])]))
        acc = float(np.mean(scores)) if scores else None
        return pd.DataFrame([(*pdf[list(by)].iloc[0], c, j, float(load[i, j]), acc) for i, c in enumerate(columns) for j in range(load.shape[1])], columns=[*by, "feature", "component", "loading", "balanced_accuracy"])

    schema = "".join(f"{c} {frames.schema[c].dataType.simpleString()}, " for c in by)
    return frames.groupBy(*by).applyInPandas(one, f"{schema}feature string, component int, loading double, balanced_accuracy double")


def energy_permutation(df: DataFrame, columns: Sequence[str], label: str, block: str, by: Sequence[str], n: int = 199, seed: int = 0) -> DataFrame:
    """Per group with two labels the energy distance, and its p when whole replicas change sides."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row = (None, None)
        if pdf[label].nunique() == 2:
            row = K.block_energy_p(pdf[list(columns)].to_numpy(float), pdf[label].to_numpy(), pdf[block].to_numpy(), n, seed)
        return pd.DataFrame([(*pdf[list(by)].iloc[0], *row)], columns=[*by, "energy", "p"])

    schema = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    return df.groupBy(*by).applyInPandas(one, f"{schema}energy double, p double")
