"""Operators on the driver's tables, each with the SQL that checks it.

Conventions: a series is a user of ``events``, its frames are the events in order of
time and id, its label the event's type, its signal the value. Vectors are
``embeddings``. Floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, labels, vectors
from ..operators import aggregates as A
from ..operators import attribution, changepoints, clustering, geometry, joins, scoring, windows
from ..operators import statistics as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, and the SQL for the same rows if there is any."""

    def wrap(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return wrap


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    return windows.number_frames(t(spark, d, "events"), "user_id", ["ts", "event_id"])


def r(c: str | Column, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


EV = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"
RUNS = f"""{EV},
marked AS (SELECT *, CASE WHEN frame > 0 AND event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY frame) THEN 1 ELSE 0 END AS m FROM ev),
numbered AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY frame) AS run_id FROM marked),
runs AS (SELECT user_id, run_id::BIGINT AS run_id, event_type, min(frame)::BIGINT AS start, max(frame)::BIGINT AS "end", count(*)::BIGINT AS n_rows FROM numbered GROUP BY ALL)"""
SEG = f"""{EV}, seg AS (SELECT user_id, floor(frame / 10)::BIGINT AS segment_id, min(frame)::BIGINT AS start_frame, max(frame)::BIGINT AS end_frame,
  count(*)::BIGINT AS n_frames, avg(value) AS value_mean, stddev_pop(value) AS value_std, mode(event_type ORDER BY event_type) AS m FROM ev GROUP BY ALL)"""
LONG = "long AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of ten frames."""
    ev = frames(spark, d).withColumn("segment_id", F.floor(F.col("frame") / 10))
    return A.segment_statistics(ev, ["value"], ["user_id", "segment_id"], "frame", None)


def long_vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


# ---- sequences


@query(f"WITH {RUNS} SELECT user_id, run_id, event_type, start, \"end\", n_rows FROM runs")
def run_islands(spark, d):
    return windows.run_table(frames(spark, d), "user_id", "frame", "event_type")


@query(
    f"""WITH {EV}, p AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS target FROM ev)
SELECT source, target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS probability FROM p WHERE target IS NOT NULL AND source <> target GROUP BY source, target"""
)
def transition_probs(spark, d):
    pairs = windows.transitions(frames(spark, d), "user_id", "frame", "event_type")
    return windows.transition_counts(pairs).withColumn("probability", r("probability"))


@query(
    f"""WITH {EV}, p AS (SELECT event_type AS source, lead(event_type, 3) OVER (PARTITION BY user_id ORDER BY frame) AS target FROM ev)
SELECT source, target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS probability FROM p WHERE target IS NOT NULL AND source <> target GROUP BY source, target"""
)
def lagged_transitions(spark, d):
    pairs = windows.transitions(frames(spark, d), "user_id", "frame", "event_type", lag=3)
    return windows.transition_counts(pairs).withColumn("probability", r("probability"))


@query(
    f"""WITH {EV}, p AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS target FROM ev),
c AS (SELECT source, target, count(*) AS n FROM p WHERE target IS NOT NULL AND source <> target GROUP BY ALL), s AS (SELECT DISTINCT event_type AS state FROM events)
SELECT a.state AS source, b.state AS target, coalesce(n, 0)::BIGINT AS n FROM s a CROSS JOIN s b LEFT JOIN c ON c.source = a.state AND c.target = b.state"""
)
def transition_matrix(spark, d):
    ev = frames(spark, d)
    counts = windows.transition_counts(windows.transitions(ev, "user_id", "frame", "event_type"))
    return windows.transition_matrix(counts, ev.select(F.col("event_type").alias("state")).distinct())


@query(
    f"""WITH {EV}, p AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS target FROM ev)
SELECT source, target, count(*) AS n, round(1000 * count(*) / sum(count(*)) OVER (PARTITION BY source), 4) AS rate FROM p WHERE target IS NOT NULL GROUP BY source, target"""
)
def step_frequency_per_thousand(spark, d):
    return windows.step_rates(frames(spark, d), "user_id", "frame", "event_type", step="frame").select("source", "target", "n", r("rate", 4).alias("rate"))


@query(
    f"""WITH {RUNS} SELECT event_type, median(n_rows)::DOUBLE AS median_run, round(100.0 * sum(CASE WHEN n_rows >= 2 THEN n_rows ELSE 0 END) / sum(n_rows), 6) AS pct_persistent, count(*) AS n_runs FROM runs GROUP BY event_type"""
)
def dwell_stats(spark, d):
    out = windows.dwell_statistics(frames(spark, d), "user_id", "frame", "event_type", 2, by=["event_type"])
    return out.withColumn("pct_persistent", r("pct_persistent")).withColumn("median_run", F.col("median_run").cast("double"))


@query(
    f"""WITH {EV}, f AS (SELECT user_id, frame, event_type = 'purchase' AS o FROM ev),
a AS (SELECT *, CASE WHEN frame > 0 AND o <> lag(o) OVER (PARTITION BY user_id ORDER BY frame) THEN 1 ELSE 0 END AS m FROM f),
b AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY frame) AS g FROM a), rr AS (SELECT user_id, g, o, count(*) AS n FROM b GROUP BY ALL)
SELECT user_id, round(coalesce(sum(CASE WHEN o THEN n END), 0) / sum(n), 6) AS persistence, sum(n)::BIGINT AS n_frames, coalesce(sum(CASE WHEN o THEN n END), 0)::BIGINT AS n_on,
 count(CASE WHEN o THEN 1 END) AS n_runs, round(coalesce(avg(CASE WHEN o THEN n END), 0), 6) AS mean_run_length, coalesce(max(CASE WHEN o THEN n END), 0)::BIGINT AS max_run_length, count(*) - 1 AS n_switches FROM rr GROUP BY user_id"""
)
def run_persistence(spark, d):
    out = windows.run_statistics(frames(spark, d).withColumn("on", F.col("event_type") == "purchase"), "user_id", "frame", "on")
    return out.withColumns({"persistence": r("persistence"), "mean_run_length": r("mean_run_length")})


@query(
    f"""WITH {EV}, f AS (SELECT user_id, frame, event_type = 'purchase' AS o FROM ev),
a AS (SELECT *, CASE WHEN frame > 0 AND o <> lag(o) OVER (PARTITION BY user_id ORDER BY frame) THEN 1 ELSE 0 END AS m FROM f),
b AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY frame) AS g FROM a),
rr AS (SELECT user_id, g, o, count(*) AS n, min(frame) AS s FROM b GROUP BY ALL),
l AS (SELECT * FROM rr WHERE n >= 2), tot AS (SELECT user_id, count(*) AS total FROM ev GROUP BY 1),
x AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY s), false) AS p FROM l),
y AS (SELECT * FROM x WHERE o <> p)
SELECT user_id, CASE WHEN o THEN 'entry' ELSE 'exit' END AS event, s::BIGINT AS at, (coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s), total) - s)::BIGINT AS dwell,
 lead(s) OVER (PARTITION BY user_id ORDER BY s) IS NULL AS censored FROM y JOIN tot USING (user_id)"""
)
def debounced_events(spark, d):
    return windows.debounced_events(frames(spark, d).withColumn("on", F.col("event_type") == "purchase"), "user_id", "frame", "on", 2)


@query(f"WITH {RUNS} SELECT user_id, string_agg(event_type, '->' ORDER BY start) AS path, count(*) AS n_runs, count(DISTINCT event_type) AS n_states FROM runs GROUP BY user_id")
def state_paths(spark, d):
    return windows.state_paths(frames(spark, d), "user_id", "frame", "event_type")


@query(f"WITH {EV}, p AS (SELECT user_id, frame::BIGINT AS frame, lag(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS source, event_type AS target FROM ev) SELECT * FROM p WHERE source <> target")
def state_boundaries(spark, d):
    return windows.boundaries(frames(spark, d), "user_id", "frame", "event_type")


@query(
    f"""WITH {EV}, n AS (SELECT user_id, frame, value, count(*) OVER (PARTITION BY user_id) AS n, stddev_pop(value) OVER (PARTITION BY user_id) AS sd FROM ev),
w AS (SELECT *, least(10, greatest(2, n // 2)) AS w FROM n),
s AS (SELECT a.user_id, a.frame, any_value(a.n) AS n, any_value(a.w) AS w, any_value(a.sd) AS sd, stddev_samp(b.value) AS rs, count(*) AS c FROM w a JOIN w b ON a.user_id = b.user_id AND b.frame BETWEEN a.frame AND a.frame + a.w - 1 GROUP BY a.user_id, a.frame),
q AS (SELECT *, 0.8 * sd AS tau FROM s WHERE c = w AND n >= 4),
bad AS (SELECT user_id, max(CASE WHEN rs > tau THEN frame END) AS bad FROM q GROUP BY 1)
SELECT q.user_id, min(CASE WHEN bad IS NULL OR q.frame > bad THEN q.frame END)::BIGINT AS tail_start, round(any_value(tau), 6) AS threshold FROM q JOIN bad USING (user_id) GROUP BY 1"""
)
def rolling_std_plateau(spark, d):
    out = windows.plateau(frames(spark, d), "user_id", "frame", "value", 10, 0.8).where("mode <> 'insufficient_data'")
    return out.select("user_id", F.when(F.col("success"), F.col("plateau_start")).cast("long").alias("tail_start"), r("threshold").alias("threshold"))


@query(
    f"""WITH {EV}, g AS (SELECT user_id, frame::BIGINT AS frame, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT user_id, frame, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a - b) / 2 WHEN a IS NOT NULL THEN a - value WHEN b IS NOT NULL THEN value - b ELSE 0 END, 6) AS gradient FROM g"""
)
def gradient_score(spark, d):
    return frames(spark, d).select("user_id", "frame", r(windows.gradient("value", "user_id", "frame")).alias("gradient"))


@query(
    f"""WITH {EV}, o AS (SELECT user_id, frame AS origin FROM ev WHERE event_type = 'error'), l AS (SELECT user_id, origin, unnest(range(-2, 3)) AS lag FROM o)
SELECT l.user_id, origin::BIGINT AS origin, lag::INT AS lag, value FROM l LEFT JOIN ev ON ev.user_id = l.user_id AND ev.frame = origin + lag"""
)
def event_aligned_window(spark, d):
    ev = frames(spark, d)
    return windows.aligned(ev, ev.where("event_type = 'error'").select("user_id", F.col("frame").alias("origin")), "user_id", "frame", ["value"], 2, 2)


@query(
    f"""WITH {EV}, o AS (SELECT user_id, frame AS origin FROM ev WHERE event_type = 'purchase'),
j AS (SELECT o.user_id, origin, avg(CASE WHEN frame < origin THEN value END) AS a, avg(CASE WHEN frame >= origin THEN value END) AS b, max(CASE WHEN frame = origin THEN value END) - max(CASE WHEN frame = origin - 1 THEN value END) AS jump
 FROM o JOIN ev ON ev.user_id = o.user_id AND frame BETWEEN origin - 5 AND origin + 4 GROUP BY ALL), s AS (SELECT stddev_pop(value) AS sd FROM events)
SELECT user_id, origin::BIGINT AS origin, round(a, 6) AS pre_mean, round(b, 6) AS post_mean, round(b - a, 6) AS delta, round((b - a) / sd, 6) AS std_delta, round(jump, 6) AS jump FROM j, s WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def transition_window_contrast(spark, d):
    ev = frames(spark, d)
    out = windows.window_contrast(ev, ev.where("event_type = 'purchase'").select("user_id", F.col("frame").alias("origin")), "user_id", "frame", "value", 5)
    return out.select("user_id", "origin", *(r(c).alias(c) for c in ("pre_mean", "post_mean", "delta", "std_delta", "jump")))


@query(
    f"""WITH {EV}, s AS (SELECT user_id, frame, list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY frame ROWS 3 PRECEDING))) AS m FROM ev),
p AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY frame), []) AS b FROM s)
SELECT user_id, frame::BIGINT AS frame, array_to_string(list_sort(list_filter(m, lambda x: NOT list_contains(b, x))), ',') AS entered, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(m, x))), ',') AS exited FROM p"""
)
def set_entered_exited(spark, d):
    from pyspark.sql import Window as W

    ev = frames(spark, d).withColumn("m", F.array_distinct(F.collect_list("event_type").over(W.partitionBy("user_id").orderBy("frame").rowsBetween(-3, 0))))
    out = windows.entered_exited(ev, "user_id", "frame", "m")
    return out.select("user_id", "frame", F.array_join("entered", ",").alias("entered"), F.array_join("exited", ",").alias("exited"))


@query(
    f"""WITH {EV}, x AS (SELECT user_id, frame, CASE event_type WHEN 'view' THEN 'entry' WHEN 'purchase' THEN 'exit' END AS e FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, e ORDER BY frame) AS k FROM x WHERE e IS NOT NULL), l AS (SELECT user_id, max(frame) AS z FROM ev GROUP BY 1)
SELECT a.user_id, a.k::INT AS k, a.frame::BIGINT AS entry, coalesce(b.frame, z)::BIGINT AS exit, (coalesce(b.frame, z) - a.frame)::BIGINT AS duration, b.frame IS NULL AS open
FROM k a LEFT JOIN k b ON a.user_id = b.user_id AND a.k = b.k AND b.e = 'exit' JOIN l ON l.user_id = a.user_id WHERE a.e = 'entry'"""
)
def residence_pairing(spark, d):
    ev = frames(spark, d)
    marks = ev.withColumn("event", F.when(F.col("event_type") == "view", "entry").when(F.col("event_type") == "purchase", "exit")).where("event IS NOT NULL")
    return windows.residences(marks, ev.groupBy("user_id").agg(F.max("frame").alias("last_frame")), ["user_id"])


@query(
    f"""WITH {SEG}, x AS (SELECT *, lead(m) OVER w AS target, lead(segment_id) OVER w AS to_segment_id FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY start_frame, segment_id))
SELECT user_id, segment_id, to_segment_id, m AS source, target FROM x WHERE target IS NOT NULL AND m <> target"""
)
def segment_handoffs(spark, d):
    ev = frames(spark, d).withColumn("segment_id", F.floor(F.col("frame") / 10))
    seg = segments(spark, d).join(A.majority(ev, ["user_id", "segment_id"], "event_type").select("user_id", "segment_id", F.col("mode").alias("m")), ["user_id", "segment_id"])
    return windows.handoffs(seg, "user_id", "m").select("user_id", "segment_id", "to_segment_id", "source", "target")


@query("""WITH g AS (SELECT l_linenumber AS step, count(*) AS y FROM lineitem WHERE l_quantity > l_linenumber * l_linenumber GROUP BY 1),
s AS (SELECT step, y, row_number() OVER (ORDER BY step) AS k, count(*) OVER () AS n, (step - min(step) OVER ()) / (max(step) OVER () - min(step) OVER ()) AS x1, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y1 FROM g),
e AS (SELECT *, first_value(x1) OVER w AS xa, last_value(x1) OVER w AS xb, first_value(y1) OVER w AS ya, last_value(y1) OVER w AS yb FROM s WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT step, y, round(abs((yb - ya) * (x1 - xa) - (xb - xa) * (y1 - ya)) / sqrt((xb - xa) ^ 2 + (yb - ya) ^ 2), 6) AS distance FROM e WHERE k > 1 AND k < n ORDER BY distance DESC, step LIMIT 1""")
def penalty_elbow(spark, d):
    grid = t(spark, d, "lineitem").where("l_quantity > l_linenumber * l_linenumber").groupBy(F.col("l_linenumber").alias("step")).agg(F.count("*").alias("y"))
    return windows.elbow(grid, "step", "y").withColumn("distance", r("distance"))


@query(f"WITH {SEG} SELECT user_id, sign(arg_max(value_mean, segment_id) - arg_min(value_mean, segment_id))::DOUBLE AS direction FROM seg GROUP BY user_id")
def regime_direction(spark, d):
    return windows.regime_directions(segments(spark, d), ["value_mean"], ["user_id"]).select("user_id", "direction")


# ---- joins


@query(f"WITH {EV}, s AS (SELECT user_id, 7 * unnest(range(0, 40)) AS a FROM (SELECT DISTINCT user_id FROM events)) SELECT ev.user_id, frame::BIGINT AS frame, a::BIGINT AS start_frame FROM ev JOIN s ON s.user_id = ev.user_id AND frame BETWEEN a AND a + 4")
def frame_segment_interval_join(spark, d):
    ev = frames(spark, d).select("user_id", "frame")
    seg = ev.select("user_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("user_id", (7 * F.col("k")).cast("long").alias("start_frame"), (7 * F.col("k") + 4).cast("long").alias("end_frame"))
    return joins.interval_join(ev, seg, ["user_id"], "frame", width=64).select("user_id", "frame", "start_frame")


@query(
    f"""WITH {EV}, s AS (SELECT user_id, 7 * unnest(range(0, 40)) AS a FROM (SELECT DISTINCT user_id FROM events)),
j AS (SELECT ev.user_id, frame, max(a) AS start_frame FROM ev LEFT JOIN s ON s.user_id = ev.user_id AND frame BETWEEN a AND a + 11 GROUP BY ALL) SELECT user_id, frame::BIGINT AS frame, start_frame::BIGINT AS start_frame FROM j"""
)
def later_segment_wins(spark, d):
    ev = frames(spark, d).select("user_id", "frame")
    seg = ev.select("user_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("user_id", (7 * F.col("k")).cast("long").alias("start_frame"), (7 * F.col("k") + 11).cast("long").alias("end_frame"))
    return joins.label_points(ev, seg, ["user_id"], "frame", width=64).select("user_id", "frame", "start_frame")


@query(
    f"""WITH {EV}, s AS (SELECT user_id, 7 * unnest(range(0, 40)) AS a FROM (SELECT DISTINCT user_id FROM events)),
j AS (SELECT ev.user_id, frame, max(a) AS start_frame FROM ev LEFT JOIN s ON s.user_id = ev.user_id AND frame BETWEEN a AND a + CASE WHEN a < 273 THEN 6 ELSE 4 END GROUP BY ALL) SELECT user_id, frame::BIGINT AS frame, start_frame::BIGINT AS start_frame FROM j"""
)
def painted_segments(spark, d):
    ev = frames(spark, d).select("user_id", "frame")
    seg = ev.select("user_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("user_id", (7 * F.col("k")).cast("long").alias("start_frame"), (7 * F.col("k") + 4).cast("long").alias("end_frame"))
    return joins.paint(ev, seg, ["user_id"], "frame", gap=5, width=64).select("user_id", "frame", "start_frame")


@query(f"WITH {SEG}, n AS (SELECT user_id, segment_id, start_frame, end_frame, unnest(range(0, 4)) AS k FROM seg) SELECT user_id, segment_id, round_even(start_frame + k * (end_frame - start_frame) / 3, 0)::BIGINT AS frame FROM n")
def segment_expand(spark, d):
    seg = segments(spark, d).withColumn("n_frames", F.lit(4))
    return joins.expand_segments(seg).select("user_id", "segment_id", "frame")


@query(f"WITH {EV} SELECT a.user_id, a.frame::BIGINT AS at_a, b.frame::BIGINT AS at_b, abs(a.frame - b.frame)::BIGINT AS distance FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(a.frame - b.frame) <= 3")
def band_match_candidates(spark, d):
    ev = frames(spark, d)
    return joins.band_join(ev.where("event_type = 'click'").select("user_id", F.col("frame").alias("at_a")), ev.where("event_type = 'purchase'").select("user_id", F.col("frame").alias("at_b")), ["user_id"], "at_a", "at_b", 3)


# One row per candidate, nearest first; each is taken if both its ends are free: what is taken is carried along in lists.
GREEDY = """c AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY distance, least(at_a, at_b), greatest(at_a, at_b), at_a) AS k FROM cand),
walk AS (SELECT DISTINCT g, 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::BIGINT AS at_a, NULL::BIGINT AS at_b, NULL::BIGINT AS distance, false AS taken FROM c
 UNION ALL SELECT g, k, CASE WHEN ok THEN list_append(ua, at_a) ELSE ua END, CASE WHEN ok THEN list_append(ub, at_b) ELSE ub END, at_a, at_b, distance, ok
 FROM (SELECT w.g, c.k, w.ua, w.ub, c.at_a, c.at_b, c.distance, NOT list_contains(w.ua, c.at_a) AND NOT list_contains(w.ub, c.at_b) AS ok FROM walk w JOIN c ON c.g = w.g AND c.k = w.k + 1) AS step),
met AS (SELECT g, at_a, at_b, distance FROM walk WHERE taken)"""


@query(
    f"""WITH RECURSIVE {EV}, cand AS (SELECT a.user_id AS g, a.frame::BIGINT AS at_a, b.frame::BIGINT AS at_b, abs(a.frame - b.frame)::BIGINT AS distance FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(a.frame - b.frame) <= 3),
{GREEDY} SELECT g AS user_id, at_a, at_b, distance FROM met"""
)
def greedy_match(spark, d):
    return joins.greedy_match(band_match_candidates(spark, d), ["user_id"], "at_a", "at_b")


@query(
    f"""WITH RECURSIVE {EV}, n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
cand AS (SELECT a.user_id || '|' || a.event_type || '|' || b.event_type AS g, a.frame::BIGINT AS at_a, b.frame::BIGINT AS at_b, abs(a.frame - b.frame)::BIGINT AS distance FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type < b.event_type AND abs(a.frame - b.frame) <= 2),
{GREEDY}, s AS (SELECT g, count(*) AS n FROM met GROUP BY 1)
SELECT a.user_id::VARCHAR AS traj_id, a.event_type AS group_a, b.event_type AS group_b, a.n AS n_a, b.n AS n_b, coalesce(s.n, 0) AS n_shared, round(coalesce(s.n, 0) / (a.n + b.n - coalesce(s.n, 0)), 6) AS jaccard
FROM n a JOIN n b ON a.user_id = b.user_id AND a.event_type < b.event_type LEFT JOIN s ON s.g = a.user_id || '|' || a.event_type || '|' || b.event_type"""
)
def timing_comparison(spark, d):
    ev = frames(spark, d).select(F.col("user_id").cast("string").alias("traj_id"), F.col("event_type").alias("grp"), "frame")
    return joins.compare_timing(ev, ev.select("traj_id", "grp").distinct(), 2).withColumn("jaccard", r("jaccard"))


@query(
    f"""WITH RECURSIVE {EV}, a AS (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS k FROM ev WHERE event_type = 'click'),
b AS (SELECT user_id, list(frame ORDER BY frame) AS free FROM ev WHERE event_type = 'purchase' GROUP BY 1),
who AS (SELECT user_id FROM a UNION SELECT user_id FROM b),
walk AS (SELECT who.user_id, 0::BIGINT AS k, coalesce(free, []::BIGINT[]) AS free, 0::BIGINT AS n FROM who LEFT JOIN b USING (user_id)
 UNION ALL SELECT user_id, k, CASE WHEN ok THEN list_filter(free, lambda x: x <> near['x']) ELSE free END, n + ok::BIGINT
 FROM (SELECT *, coalesce(near['d'] <= 2, false) AS ok FROM (SELECT w.user_id, a.k, w.free, w.n, list_sort(list_transform(w.free, lambda x: {{'d': abs(x - a.frame), 'x': x}}))[1] AS near FROM walk w JOIN a ON a.user_id = w.user_id AND a.k = w.k + 1) AS one) AS step),
m AS (SELECT user_id, max(n) AS n FROM walk GROUP BY 1), na AS (SELECT user_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT user_id, len(free) AS n FROM b),
x AS (SELECT user_id, coalesce(na.n, 0) AS a, coalesce(nb.n, 0) AS b, m.n AS m, m.n / nullif(coalesce(nb.n, 0), 0) AS p, m.n / nullif(coalesce(na.n, 0), 0) AS r FROM m LEFT JOIN na USING (user_id) LEFT JOIN nb USING (user_id))
SELECT user_id::VARCHAR AS traj_id, a::BIGINT AS n_boundaries, b::BIGINT AS n_breakpoints, m::BIGINT AS n_matched, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM x"""
)
def boundary_f1(spark, d):
    ev = frames(spark, d).withColumn("traj_id", F.col("user_id").cast("string")).withColumn("time_ps", F.col("frame").cast("double"))
    out = joins.match_boundaries(ev.where("event_type = 'click'"), ev.where("event_type = 'purchase'"), tolerance=2.0)
    return out.withColumns({c: r(c) for c in ("precision", "recall", "f1")})


@query()
def event_recall(spark, d):
    ev = frames(spark, d).withColumn("traj_id", F.col("user_id").cast("string"))
    n = ev.groupBy("traj_id").agg(F.count("*").alias("n"))
    return joins.event_recall(ev.where("event_type = 'purchase'"), ev.where("event_type = 'click'"), n, 2, shifts=20, margin=5)


POINTS = "p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", "label", *(e[k].cast("double").alias(a) for k, a in enumerate("xyz")))


@query(f"WITH {POINTS} SELECT a.label, a.vec_id, b.vec_id AS b_vec_id, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2), 6) AS distance FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id AND sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) < 0.1")
def contact_pairs(spark, d):
    p = points(spark, d)
    return joins.distance_join(p, p, ["label"], 0.1).where("vec_id < b_vec_id").select("label", "vec_id", "b_vec_id", r("distance").alias("distance"))


@query(
    f"""WITH {POINTS}, q AS (SELECT a.label, a.vec_id, b.vec_id AS o, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) AS d FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY d, o) AS r FROM q) SELECT DISTINCT label, least(vec_id, o) AS i, greatest(vec_id, o) AS j, round(d, 6) AS distance FROM k WHERE r <= 4"""
)
def knn4(spark, d):
    return joins.nearest_pairs(points(spark, d), ["label"], "vec_id", 4).withColumn("distance", r("distance"))


@query("SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey = o_custkey AND x.c_acctbal < 0)")
def qc_anti_join(spark, d):
    bad = t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    left = joins.without_series(t(spark, d, "orders").select("o_orderkey", "o_custkey"), bad, "o_custkey")
    return left.join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.value >= 200)")
def never_semi_join(spark, d):
    ev = t(spark, d, "events").withColumn("g", (F.col("value") / 200).cast("int"))
    return joins.without_guest(ev, "g", "never", "user_id").select("event_id", "user_id")


@query("SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'brand-' || substr(p_brand, 7) ELSE p_brand END AS p_brand FROM part")
def id_mapping(spark, d):
    part = t(spark, d, "part")
    m = part.select(F.col("p_brand").alias("s")).distinct().where("s LIKE 'Brand#1%'").withColumn("g", F.concat(F.lit("brand-"), F.substring("s", 7, 99)))
    return joins.map_ids(part.select("p_partkey", "p_brand"), m, "p_brand", "s", "g")


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag <> 'A' UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, -l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'A'")
def replace_groups(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    return joins.replace_groups(li, li.where("l_returnflag = 'A'").withColumn("l_quantity", -F.col("l_quantity")), "l_returnflag")


@query("SELECT 'l_quantity' AS \"column\", count(*) FILTER (l_quantity <= 40) AS same, count(*) FILTER (l_quantity > 40) AS differs, 0::BIGINT AS missing FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)")
def table_comparison(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = t(spark, d, "lineitem").groupBy(*key).agg(F.max("l_quantity").alias("l_quantity"))
    return joins.compare_tables(li, li.withColumn("l_quantity", F.when(F.col("l_quantity") > 40, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))), key)


# ---- aggregates


@query(f"WITH {SEG} SELECT user_id, segment_id, start_frame, end_frame, n_frames, round(value_mean, 6) AS value_mean, round(value_std, 6) AS value_std FROM seg")
def segment_stats(spark, d):
    return segments(spark, d).withColumns({c: r(c) for c in ("value_mean", "value_std")})


@query(f"WITH {EV} SELECT event_type AS group_a, count(*) AS n, round(median(value), 6) AS median_value, round(avg(value), 6) AS mean_value FROM ev GROUP BY 1")
def cohort_summary(spark, d):
    ev = frames(spark, d).select(F.col("event_type").alias("group_a"), F.lit(0).alias("group_b"), F.col("value").alias("jaccard"))
    return A.cohort_summary(ev).select("group_a", "n", r("median_jaccard").alias("median_value"), r("mean_jaccard").alias("mean_value"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def regime_pivot(spark, d):
    return A.breakpoint_pivot(t(spark, d, "events"), ["click", "purchase", "error"], "user_id", "event_type")


@query(
    """WITH e AS (SELECT c_nationkey, o_custkey, sum(o_totalprice) AS f, count(*) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY f DESC, o_custkey) AS r FROM e)
SELECT c_nationkey, max(CASE WHEN r = 1 THEN o_custkey END) AS top_series, round(max(f) / sum(f), 6) AS frame_share, round(max(s) / sum(s), 6) AS segment_share, count(*) AS n_series FROM k GROUP BY 1"""
)
def replica_share(spark, d):
    both = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = A.replica_composition(both, "c_nationkey", "o_custkey", "o_totalprice")
    return out.withColumns({c: r(c) for c in ("frame_share", "segment_share")})


@query("SELECT l_returnflag AS label, count(*) AS n_segments, count(DISTINCT l_suppkey) AS n_series, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM lineitem GROUP BY 1")
def cluster_population(spark, d):
    return A.cluster_population(t(spark, d, "lineitem"), "l_returnflag", "l_suppkey").select(F.col("l_returnflag").alias("label"), "n_segments", "n_series", r("fraction").alias("fraction"))


@query("SELECT l_linestatus AS label, count(*) AS n_segments, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1")
def cluster_lifetime(spark, d):
    return A.cluster_lifetime(t(spark, d, "lineitem"), "l_linestatus", "l_quantity").select(F.col("l_linestatus").alias("label"), "n_segments", r("mean").alias("mean"), "median", "min", "max")


@query("WITH x AS (SELECT unnest(['A', 'N', 'R', 'X']) AS label), c AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1) SELECT x.label, coalesce(n, 0)::BIGINT AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS percent FROM x LEFT JOIN c USING (label)")
def occupancy_percent(spark, d):
    dim = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in "ANRX"))).alias("label"))
    return A.occupancy(t(spark, d, "lineitem"), "l_returnflag", dim).withColumn("percent", r("percent"))


@query("SELECT l_returnflag, l_linestatus, CASE WHEN grouping(l_linestatus) = 1 THEN 'frame' ELSE 'pair' END AS level, min(l_quantity) AS min, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS max, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def pair_and_assembly_levels(spark, d):
    out = A.pair_and_frame_levels(t(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus"], "l_quantity")
    return out.select("l_returnflag", "l_linestatus", "level", "min", r("mean").alias("mean"), "max", "n")


@query(f"WITH {EV} SELECT user_id, max(value) AS max_spread, min(event_id) AS min_component, count(*) FILTER (value > 100) AS n_spread, count(*) FILTER (event_id < 50) AS n_component, min(CASE WHEN value > 100 OR event_id < 50 THEN frame END)::BIGINT AS first_failure, bool_or(value > 100 OR event_id < 50) AS failed FROM ev GROUP BY 1")
def assembly_qc(spark, d):
    return A.quality(frames(spark, d), "value", "event_id", 100, 50, "user_id")


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def contingency(spark, d):
    return A.contingency(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT user_id, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(avg((value > 0)::INT), 6) AS fraction_positive, count(value) AS n FROM events GROUP BY 1")
def quartile_summary(spark, d):
    out = A.summarise(t(spark, d, "events"), "value", ["user_id"])
    return out.withColumns({c: r(c) for c in ("median", "q25", "q75", "fraction_positive")})


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def weighted_means(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(r(A.weighted_mean("l_discount", "l_quantity")).alias("mean"))


@query("SELECT * FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3")
def top_k_per_group(spark, d):
    li = t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return A.top_k(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {LONG}, m AS (SELECT label, feature, avg(value) AS v FROM long GROUP BY ALL) SELECT label, round(list_sum(list(v ^ 2)), 6) AS norm2 FROM m GROUP BY 1")
def vector_means(spark, d):
    out = A.vector_merge(t(spark, d, "embeddings"), ["label"], "embedding")
    return out.select("label", r(vectors.dot(F.col("embedding"), F.col("embedding"))).alias("norm2"))


# ---- statistics


@query(
    f"""WITH {LONG}, g AS (SELECT feature, label, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM long GROUP BY ALL)
SELECT feature, sum(n)::BIGINT AS n, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS eta_squared FROM g GROUP BY 1"""
)
def eta_squared(spark, d):
    return S.eta_squared(long_vectors(spark, d), "value", "label").withColumn("eta_squared", r("eta_squared"))


@query(
    f"""WITH {LONG}, g AS (SELECT feature, avg(value) FILTER (label = 0) AS ma, avg(value) FILTER (label <> 0) AS mb, var_samp(value) FILTER (label = 0) AS va, var_samp(value) FILTER (label <> 0) AS vb, count(*) FILTER (label = 0) AS na, count(*) FILTER (label <> 0) AS nb FROM long GROUP BY 1)
SELECT feature, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d FROM g"""
)
def cohens_d(spark, d):
    return S.cohens_d(long_vectors(spark, d), "value", F.col("label") == 0).withColumn("cohens_d", r("cohens_d"))


@query(f"WITH {LONG} SELECT feature, round(corr(value, (label = 0)::INT), 6) AS r FROM long GROUP BY 1")
def point_biserial(spark, d):
    return S.point_biserial(long_vectors(spark, d), "value", F.col("label") == 0).withColumn("r", r("r"))


SPEARMAN = """rk AS (SELECT l_suppkey, l_quantity, l_extendedprice, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS a,
 rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2 AS b FROM lineitem)"""


@query(f"WITH {SPEARMAN} SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS pearson, count(*) AS n, round(corr(a, b), 6) AS spearman FROM rk GROUP BY 1")
def pearson_spearman(spark, d):
    out = S.correlations(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"])
    return out.select("l_suppkey", r("pearson").alias("pearson"), "n", r("spearman").alias("spearman"))


@query(
    f"""WITH {LONG}, x AS (SELECT feature, label, value FROM long), rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS k, count(*) OVER (PARTITION BY feature) AS n FROM x),
t AS (SELECT feature, sum(c * c * c - c) AS ties FROM (SELECT feature, value, count(*) AS c FROM x GROUP BY ALL) GROUP BY 1),
h AS (SELECT feature, any_value(n) AS n, sum(s * s / m) AS h FROM (SELECT feature, label, any_value(n) AS n, sum(k) AS s, count(*) AS m FROM rk GROUP BY ALL) GROUP BY 1)
SELECT feature, round((12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - ties / (n::DOUBLE ^ 3 - n)), 5) AS h, round((12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - ties / (n::DOUBLE ^ 3 - n)) / (n - 1), 6) AS epsilon_squared FROM h JOIN t USING (feature)"""
)
def kruskal_epsilon(spark, d):
    out = S.kruskal_epsilon(long_vectors(spark, d), "value", "label")
    return out.withColumns({"h": r("h", 5), "epsilon_squared": r("epsilon_squared")})


@query(
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
ra AS (SELECT a, sum(n) AS x FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS y FROM c GROUP BY 1),
mi AS (SELECT sum(n / t * ln(n * t / (x * y))) AS mi, sum(n * n / (x * y)) AS q, sum(n * (n - 1) / 2) AS same, any_value(t) AS t FROM c JOIN ra USING (a) JOIN rb USING (b), t),
ha AS (SELECT -sum(x / t * ln(x / t)) AS ha, count(*) AS ka, sum(x * (x - 1) / 2) AS pa FROM ra, t), hb AS (SELECT -sum(y / t * ln(y / t)) AS hb, count(*) AS kb, sum(y * (y - 1) / 2) AS pb FROM rb, t)
SELECT t::BIGINT AS n, round(mi, 6) AS mutual_information, round(mi / ((ha + hb) / 2), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness,
 round(sqrt(greatest(q - 1, 0) / (least(ka, kb) - 1)), 6) AS cramers_v, round((same - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari FROM mi, ha, hb"""
)
def label_association(spark, d):
    out = S.association(contingency(spark, d))
    return out.select("n", *(r(c).alias(c) for c in ("mutual_information", "nmi", "homogeneity", "completeness", "cramers_v", "ari")))


@query(
    """WITH p AS (SELECT p_partkey, (p_partkey * 37 % 1000 + 1) / 1001 AS p FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS i, count(*) OVER () AS m FROM p)
SELECT p_partkey, round(least(1, min(p * m / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM k"""
)
def bh_qvalues(spark, d):
    p = t(spark, d, "part").select("p_partkey", ((F.col("p_partkey") * 37 % 1000 + 1) / 1001).alias("p"))
    return S.bh_qvalues(p, "p").select("p_partkey", r("q").alias("q"))


@query(
    f"""WITH {LONG}, g AS (SELECT feature, label, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM long GROUP BY ALL)
SELECT feature, round(sum(q - s * s / n), 6) AS sse, round(sum(q) - sum(s) ^ 2 / sum(n), 6) AS sst, round(1 - sum(q - s * s / n) / (sum(q) - sum(s) ^ 2 / sum(n)), 6) AS r2 FROM g GROUP BY 1"""
)
def r2_sufficient_stats(spark, d):
    stats = S.sufficient_statistics(long_vectors(spark, d).withColumn("series", F.col("vec_id") % 10), "value", "series", "label")
    per = stats.withColumn("f", F.col("feature"))
    return S.r_squared(per, "label", ["f"]).select(F.col("f").alias("feature"), *(r(c).alias(c) for c in ("sse", "sst", "r2")))


@query(
    """WITH s AS (SELECT o_orderpriority AS g, extract(year FROM o_orderdate)::INT AS k, avg(o_totalprice) AS score, stddev_samp(o_totalprice) / sqrt(count(*)) AS se FROM orders GROUP BY ALL),
b AS (SELECT *, first_value(score) OVER w AS bs, first_value(se) OVER w AS be FROM s WINDOW w AS (PARTITION BY g ORDER BY score DESC, k))
SELECT g, min(k) AS k FROM b WHERE score >= bs - be GROUP BY g"""
)
def one_se_pick(spark, d):
    s = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.year("o_orderdate").alias("k")).agg(F.avg("o_totalprice").alias("score"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*"))).alias("se"))
    return S.one_se(s, "score", "se", by=["g"]).select("g", "k")


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id) QUALIFY stddev_pop(value) OVER w > 0")
def zscore_minmax(spark, d):
    from pyspark.sql import Window as W

    ev = t(spark, d, "events").withColumn("sd", F.stddev_pop("value").over(W.partitionBy("user_id"))).where("sd > 0")
    return ev.select("event_id", r(clean.zscore("value", "user_id")).alias("z"), r(clean.minmax("value", "user_id")).alias("scaled"))


@query(
    """WITH s AS (SELECT l_suppkey AS g, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1)
SELECT g AS l_suppkey, round(a, 3) AS intercept, round(b, 4) AS slope FROM s"""
)
def least_squares(spark, d):
    return S.least_squares(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"]).select("l_suppkey", r("intercept", 3).alias("intercept"), r("b_l_quantity", 4).alias("slope"))


@query("""WITH s AS (SELECT l_returnflag AS g, l_linestatus AS rep, l_linenumber AS seg, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY ALL),
r AS (SELECT g, rep, sum(n) AS n, sum(s) AS s FROM s GROUP BY ALL), t AS (SELECT g, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS bs FROM s GROUP BY 1), u AS (SELECT g, sum(s * s / n) AS br FROM r GROUP BY 1)
SELECT g, round((q - bs) / (q - s * s / n), 6) AS within_segment, round((bs - br) / (q - s * s / n), 6) AS between_segments, round((br - s * s / n) / (q - s * s / n), 6) AS between_series FROM t JOIN u USING (g)""")
def variance_split(spark, d):
    li = t(spark, d, "lineitem").withColumn("g", F.col("l_returnflag"))
    out = S.variance_split(li, "l_quantity", "l_linenumber", "l_linestatus", ["g"])
    return out.select("g", *(r(c).alias(c) for c in ("within_segment", "between_segments", "between_series")))


@query(
    """WITH q AS (SELECT a.vec_id AS i, a.label AS l, b.label AS m, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT i, l, max(CASE WHEN l = m THEN d END) AS a, min(CASE WHEN l <> m THEN d END) AS b FROM q GROUP BY ALL)
SELECT i AS vec_id, l AS label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS silhouette FROM s"""
)
def silhouette_by_label(spark, d):
    return S.silhouette(t(spark, d, "embeddings"), "vec_id", "embedding", "label").withColumn("silhouette", r("silhouette", 5))


@query()
def permutation_pvalues(spark, d):
    wide = t(spark, d, "embeddings").select("label", *(F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)))
    return S.permutation_eta(wide, [f"f{k}" for k in range(64)], "label", n=99)


@query(
    f"""WITH {LONG}, x AS (SELECT feature, value AS v, label = 0 AS f FROM long),
w AS (SELECT feature, lead(v) OVER o - v AS gap, count(*) FILTER (f) OVER o / count(*) FILTER (f) OVER p AS fa, count(*) FILTER (NOT f) OVER o / count(*) FILTER (NOT f) OVER p AS fb FROM x WINDOW o AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY feature)),
d AS (SELECT feature, 2 * sum((fa - fb) ^ 2 * gap) AS energy, sum(abs(fa - fb) * gap) AS wasserstein FROM (SELECT feature, coalesce(lead_gap, 0) AS gap, fa, fb FROM (SELECT feature, fa, fb, gap AS lead_gap FROM w)) GROUP BY 1),
m AS (SELECT feature, median(v) AS m FROM x GROUP BY 1), a AS (SELECT x.feature, 1.4826 * median(abs(v - m)) AS mad FROM x JOIN m USING (feature) GROUP BY 1),
g AS (SELECT feature, median(v) FILTER (f) AS ma, median(v) FILTER (NOT f) AS mb, avg(v) FILTER (f) AS ua, avg(v) FILTER (NOT f) AS ub, var_samp(v) FILTER (f) AS va, var_samp(v) FILTER (NOT f) AS vb, count(*) FILTER (f) AS na, count(*) FILTER (NOT f) AS nb FROM x GROUP BY 1)
SELECT feature, round(energy, 6) AS energy, round(wasserstein, 6) AS wasserstein, round((ma - mb) / mad, 6) AS median_shift, round((ua - ub) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d FROM d JOIN a USING (feature) JOIN g USING (feature)"""
)
def two_sample_tests(spark, d):
    out = S.two_sample(long_vectors(spark, d).withColumn("first", F.col("label") == 0), "value", "first", ["feature"])
    return out.select("feature", *(r(c).alias(c) for c in ("energy", "wasserstein", "median_shift", "cohens_d")))


@query()
def mixture_test(spark, d):
    return S.mixtures(long_vectors(spark, d), "value", ["feature"])


@query()
def signed_rank(spark, d):
    return S.signed_rank(long_vectors(spark, d), "value", ["feature"])


@query()
def histogram_peaks(spark, d):
    return S.peaks(t(spark, d, "events"), "value", ["event_type"], 5.0, 2.0, 0.05, [10.0, 20.0], 5.0)


@query(
    """WITH c AS (SELECT l_linenumber AS g, l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), t AS (SELECT g, sum(n) AS t FROM c GROUP BY 1),
ra AS (SELECT g, a, sum(n) AS x FROM c GROUP BY ALL), rb AS (SELECT g, b, sum(n) AS y FROM c GROUP BY ALL),
mi AS (SELECT g, sum(n / t * ln(n * t / (x * y))) AS mi FROM c JOIN ra USING (g, a) JOIN rb USING (g, b) JOIN t USING (g) GROUP BY 1),
ha AS (SELECT g, -sum(x / t * ln(x / t)) AS h FROM ra JOIN t USING (g) GROUP BY 1), hb AS (SELECT g, -sum(y / t * ln(y / t)) AS h FROM rb JOIN t USING (g) GROUP BY 1),
k AS (SELECT g, x, y, t, unnest(range(greatest(1, x + y - t)::BIGINT, least(x, y)::BIGINT + 1))::DOUBLE AS k FROM ra JOIN rb USING (g) JOIN t USING (g)),
e AS (SELECT g, sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS e FROM k GROUP BY 1)
SELECT g AS l_linenumber, round((mi - e) / ((ha.h + hb.h) / 2 - e), 5) AS ami FROM mi JOIN ha USING (g) JOIN hb USING (g) JOIN e USING (g)"""
)
def adjusted_information(spark, d):
    li = t(spark, d, "lineitem")
    return S.adjusted_mutual_information(A.contingency(li, "l_returnflag", "l_linestatus", ["l_linenumber"]), ["l_linenumber"]).withColumn("ami", r("ami", 5))


@query()
def bootstrap_information(spark, d):
    li = t(spark, d, "lineitem").withColumn("k", F.lit(2)).withColumn("traj_id", F.col("l_suppkey") % 20)
    return S.bootstrap_nmi(A.contingency(li, "l_returnflag", "l_linestatus", ["k", "traj_id"]), n=50)


@query()
def bootstrap_r2(spark, d):
    long = long_vectors(spark, d).withColumns({"series": F.col("vec_id") % 12, "k": F.lit(10)})
    return S.bootstrap_r_squared(S.sufficient_statistics(long, "value", "series", "label", ["k", "feature"]), "series", "label", ["k"], 40)


# ---- vectors and geometry


@query(f"WITH {POINTS} SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rg, count(*) AS n_atoms FROM p GROUP BY 1")
def centroid_rg(spark, d):
    out = geometry.centroids(points(spark, d), [], ["label"])
    return out.select("label", *(r(c).alias(c) for c in ("x", "y", "z", "rg")), "n_atoms")


@query(
    f"""WITH {LONG}, m AS (SELECT label AS near, feature, avg(value) AS v FROM long GROUP BY ALL),
q AS (SELECT vec_id, label, near, sqrt(sum((value - v) ^ 2)) AS d FROM long JOIN m USING (feature) GROUP BY ALL)
SELECT vec_id, label, arg_min(near, d) AS nearest, round(min(d), 6) AS distance FROM q GROUP BY ALL"""
)
def nearest_centroid(spark, d):
    return clustering.nearest_centroid(t(spark, d, "embeddings"), "embedding", "label", "vec_id").withColumn("distance", r("distance"))


@query(
    """WITH q AS (SELECT a.label, a.vec_id, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY ALL)
SELECT label, arg_min(vec_id, d) AS vec_id, round(min(d), 6) AS mean_distance FROM q GROUP BY 1"""
)
def medoid(spark, d):
    return clustering.medoids(t(spark, d, "embeddings"), "vec_id", "embedding", "label").withColumn("mean_distance", r("mean_distance"))


@query(
    f"""WITH {POINTS}, q AS (SELECT a.label, a.vec_id, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) AS d, row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2)) AS r FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT label, round(avg(d), 6) AS mean, round(avg(CASE WHEN r <= 4 THEN d END), 6) AS neighbour_mean, round(1 - stddev_pop(CASE WHEN r <= 4 THEN d END) / avg(CASE WHEN r <= 4 THEN d END), 6) AS octahedrality FROM q GROUP BY 1"""
)
def octahedrality(spark, d):
    out = geometry.neighbour_statistics(points(spark, d), "vec_id", 4, ["label"])
    return out.select("label", r("mean").alias("mean"), r("neighbour_mean").alias("neighbour_mean"), r("octahedrality").alias("octahedrality"))


@query(f"WITH {POINTS}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1), d AS (SELECT label, sqrt((x - cx) ^ 2 + (y - cy) ^ 2 + (z - cz) ^ 2) AS d FROM p JOIN c USING (label)) SELECT label, count(*) FILTER (d < 0.15) AS n_inside, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS min, round(max(d), 6) AS max FROM d GROUP BY 1")
def radial_counts(spark, d):
    p = points(spark, d)
    c = p.groupBy("label").agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    return geometry.radial_counts(p, c, 0.15, ["label"]).select("label", "n_inside", *(r(x).alias(x) for x in ("mean", "std", "min", "max")))


@query(f"WITH {POINTS}, q AS (SELECT a.label AS i, b.label AS j, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) AS d FROM p a JOIN p b ON a.label < b.label) SELECT i, j, count(*) AS contacts, round(min(d), 6) AS min_distance, count(*) >= 20 AS active FROM q WHERE d < 0.1 GROUP BY ALL")
def group_contacts(spark, d):
    p = points(spark, d).withColumn("f", F.lit(1))
    return geometry.contacts(p, "label", 0.1, 20, ["f"]).select("i", "j", "contacts", r("min_distance").alias("min_distance"), "active")


@query(
    f"""WITH {POINTS}, c AS (SELECT label, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM p GROUP BY 1),
q AS (SELECT *, (a + b + c) / 3 AS m, sqrt(((a - (a + b + c) / 3) ^ 2 + (b - (a + b + c) / 3) ^ 2 + (c - (a + b + c) / 3) ^ 2 + 2 * (d * d + e * e + f * f)) / 6) AS s FROM c),
h AS (SELECT *, acos(greatest(-1, least(1, ((a - m) * ((b - m) * (c - m) - f * f) - d * (d * (c - m) - f * e) + e * (d * f - (b - m) * e)) / (2 * s ^ 3)))) / 3 AS phi FROM q),
l AS (SELECT label, m + 2 * s * cos(phi + 2 * pi() / 3) AS l1, 3 * m - (m + 2 * s * cos(phi)) - (m + 2 * s * cos(phi + 2 * pi() / 3)) AS l2, m + 2 * s * cos(phi) AS l3 FROM h)
SELECT label, round(sqrt(l1 + l2 + l3), 6) AS rg, round(l1, 6) AS eig_1, round(l2, 6) AS eig_2, round(l3, 6) AS eig_3, round(l3 - (l1 + l2) / 2, 6) AS asphericity, round(l2 - l1, 6) AS acylindricity,
 round(((l3 - (l1 + l2) / 2) ^ 2 + 0.75 * (l2 - l1) ^ 2) / (l1 + l2 + l3) ^ 2, 6) AS anisotropy FROM l"""
)
def shape_descriptors(spark, d):
    out = geometry.shapes(points(spark, d), ["label"])
    return out.select("label", *(r(c).alias(c) for c in ("rg", "eig_1", "eig_2", "eig_3", "asphericity", "acylindricity", "anisotropy")))


@query()
def kabsch_rmsd(spark, d):
    p = points(spark, d).withColumn("atom_id", F.col("vec_id") % 10).withColumn("frame", F.floor(F.col("vec_id") / 10)).withColumn("traj_id", F.lit("a"))
    pos = geometry.positions(p)
    return geometry.rmsd_to_reference(pos, pos.where("frame = 0").drop("frame")).select("traj_id", "frame", "rmsd", "n_matched")


@query(
    f"""WITH RECURSIVE {POINTS}, c AS (SELECT vec_id % 6 AS i, (vec_id // 6) % 6 AS j, sum(x) AS cost FROM p GROUP BY ALL),
w AS (SELECT -1::BIGINT AS i, []::BIGINT[] AS js, 0::DOUBLE AS total UNION ALL SELECT c.i, list_append(js, c.j), total + cost FROM w JOIN c ON c.i = w.i + 1 AND c.i <> c.j AND NOT list_contains(js, c.j)),
b AS (SELECT js FROM w WHERE i = 5 ORDER BY total LIMIT 1), a AS (SELECT unnest(range(6)) AS i, js FROM b)
SELECT 0 AS g, a.i, c.j, round(cost, 6) AS cost FROM a JOIN c ON c.i = a.i AND c.j = js[a.i + 1]"""
)
def hungarian(spark, d):
    cost = points(spark, d).select((F.col("vec_id") % 6).alias("i"), F.floor(F.col("vec_id") / 6 % 6).cast("long").alias("j"), "x").groupBy("i", "j").agg(F.sum("x").alias("cost")).withColumn("g", F.lit(0))
    return geometry.lock_pairs(cost, ["g"]).withColumn("cost", r("cost"))


@query(
    f"""WITH {POINTS}, a AS (SELECT label, 10 * x AS x, 10 * y AS y, 10 * z AS z FROM p),
i AS (SELECT *, unnest(range(floor(x - 1.7)::BIGINT, ceil(x + 1.7)::BIGINT + 1)) AS i FROM a), j AS (SELECT *, unnest(range(floor(y - 1.7)::BIGINT, ceil(y + 1.7)::BIGINT + 1)) AS j FROM i),
k AS (SELECT *, unnest(range(floor(z - 1.7)::BIGINT, ceil(z + 1.7)::BIGINT + 1)) AS k FROM j)
SELECT label AS frame, 'a' AS traj_id, count(DISTINCT (i, j, k))::DOUBLE AS volume FROM k WHERE (i - x) ^ 2 + (j - y) ^ 2 + (k - z) ^ 2 <= 1.7 * 1.7 GROUP BY 1"""
)
def voxel_volumes(spark, d):
    p = points(spark, d).select(F.col("label").alias("frame"), F.lit("a").alias("traj_id"), *((10 * F.col(a)).alias(a) for a in "xyz"), F.lit("C").alias("element"))
    return geometry.voxel_volume(p, 1.0)


# ---- names, labels, json


@query(
    r"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'rg' ELSE 'endpoint_dist_' || (p_partkey % 6) || 's' || (p_size % 9) || '_' || (p_partkey % 5) || 's' || p_size END AS name, CASE p_partkey % 3 WHEN 0 THEN 'BHHpH_' WHEN 1 THEN 'BMMpM_' ELSE '' END AS c FROM part),
k AS (SELECT p_partkey, c, regexp_extract(name, '^endpoint_dist_(\d+)s(\d+)_(\d+)s(\d+)$', ['i', 'a', 'j', 'b']) AS g FROM n)
SELECT p_partkey, try_cast(g.i AS INT) AS mon_i, try_cast(g.a AS INT) AS site_a, try_cast(g.j AS INT) AS mon_j, try_cast(g.b AS INT) AS site_b, CASE WHEN g.i <> '' THEN 'M' || g.i || 'S' || g.a || '-M' || g.j || 'S' || g.b END AS label,
 'run' || p_partkey AS series, nullif(rtrim(c, '_'), '') AS cohort FROM k"""
)
def label_regex_parse(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(key % 4 == 0, "rg").otherwise(F.concat(F.lit("endpoint_dist_"), key % 6, F.lit("s"), size % 9, F.lit("_"), key % 5, F.lit("s"), size))
    run = F.concat(F.when(key % 3 == 0, "BHHpH_").when(key % 3 == 1, "BMMpM_").otherwise(""), F.lit("run"), key, F.lit("_gsa_features"))
    p = t(spark, d, "part").select(key, labels.pair_key(name).alias("pair"), run.alias("run"))
    parts = [F.col(f"pair.{c}") for c in ("mon_i", "site_a", "mon_j", "site_b")]
    label = F.when(F.col("pair").isNotNull(), labels.pair_label(*parts))
    return p.select("p_partkey", *parts, label.alias("label"), labels.series_id(F.col("run")).alias("series"), labels.cohort(F.col("run")).alias("cohort"))


@query(
    """SELECT event_id, CASE WHEN o = 0 THEN 'A' WHEN o = 1 THEN 'B' WHEN o = 2 AND e = 0 THEN 'C1' WHEN o = 2 AND e = 1 THEN 'C2' ELSE 'other' END AS structure, CASE WHEN v < 4.5 THEN 'short' WHEN v <= 5.5 THEN 'compact' WHEN v >= 7 THEN 'elongated' ELSE 'intermediate' END AS edge_window,
 CASE WHEN v < 4.5 THEN 'closed' WHEN v <= 5.5 THEN 'open' ELSE 'elongated' END AS edge, CASE WHEN v >= 6.5 THEN 'open' ELSE 'closed' END AS contact, least(o, 2) AS opened
FROM (SELECT event_id, value AS v, (event_id % 5)::INT AS o, (user_id % 3)::INT AS e FROM events)"""
)
def case_labels(spark, d):
    ev = t(spark, d, "events").select("event_id", F.col("value").alias("v"), (F.col("event_id") % 5).cast("int").alias("o"), (F.col("user_id") % 3).cast("int").alias("e"))
    v = F.col("v")
    return ev.select("event_id", labels.metastructure(F.col("o"), F.col("e")).alias("structure"), labels.edge_window(v).alias("edge_window"), labels.edge_state(v).alias("edge"), labels.contact_state(v).alias("contact"), labels.open_bin(F.col("o")).alias("opened"))


@query("SELECT p_partkey, CASE len(e) WHEN 0 THEN 'intact belt' WHEN 1 THEN 'edge ' || e[1] WHEN 2 THEN 'edges ' || e[1] || '+' || e[2] ELSE len(e) || ' elongated edges' END AS belt FROM (SELECT p_partkey, list_filter(['M0-M1', 'M1-M2', 'M2-M3'], lambda x, i: p_partkey % (i + 1) = 0) AS e FROM part)")
def belt_labels(spark, d):
    names = F.array(*(F.lit(x) for x in ("M0-M1", "M1-M2", "M2-M3")))
    return t(spark, d, "part").select("p_partkey", labels.belt(F.filter(names, lambda x, i: F.col("p_partkey") % (i + 2) == 0)).alias("belt"))


# ---- scores and attribution


@query(
    """WITH s AS (SELECT o_custkey AS run, count(*) FILTER (o_orderstatus = 'O') AS e, count(*) FILTER (o_orderstatus = 'F') AS x, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS i, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS o FROM orders GROUP BY 1)
SELECT run, round(least(1, CASE WHEN e > 0 THEN 0.3 + 0.2 * (1 - exp(-0.3 * e)) ELSE 0 END + CASE WHEN e > 1 THEN 0.15 * (1 - exp(-0.2 * (e - 1))) ELSE 0 END
 + CASE WHEN e > 0 AND x > 0 THEN CASE WHEN e > x THEN 0.25 * (1 + (e - x) / e) * e / (e + x) WHEN e = x THEN 0.15 * e / (e + x) ELSE 0.05 * e / (e + x) END ELSE 0 END
 + CASE WHEN e > 0 AND i > 0 THEN 0.25 * (i / (i + o)) ^ 0.7 + CASE WHEN i >= 300000 THEN 0.15 * least(1, ln(1 + i / 300000) / ln(2)) ELSE 0.1 * sqrt(i / 300000) END ELSE 0 END), 6) AS score FROM s"""
)
def guest_score(spark, d):
    price = lambda x: F.sum(F.when(F.col("o_orderstatus") == x, F.col("o_totalprice")))
    s = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("e"), F.count_if(F.col("o_orderstatus") == "F").alias("x"), price("O").alias("i"), price("F").alias("o"))
    return s.select("run", r(scoring.guest_score(F.col("e"), F.col("x"), F.col("i"), F.lit(300000.0), F.col("o"))).alias("score"))


@query(
    """WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS e, count(*) FILTER (o_orderstatus = 'F') AS x, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, max(o_totalprice) - min(o_totalprice) AS w, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT *, least(1, CASE WHEN e > 0 THEN 0.3 + 0.2 * (1 - exp(-0.3 * e)) ELSE 0 END + CASE WHEN e > 1 THEN 0.15 * (1 - exp(-0.2 * (e - 1))) ELSE 0 END
  + CASE WHEN e > 0 AND x > 0 THEN CASE WHEN e > x THEN 0.25 * (1 + (e - x) / e) * e / (e + x) WHEN e = x THEN 0.15 * e / (e + x) ELSE 0.05 * e / (e + x) END ELSE 0 END) AS g,
 least(1, 0.2 + 0.2 * (1 + tanh(2 * (100 * w / m / 10 - 0.5))) + 0.4 * exp(-(((s / m - 0.1) / 0.15) ^ 2))) AS v,
 least(1, 0.15 + 0.5 * (n / 50) ^ 1.5 + 0.25 * ln(3) / ln(10) + 0.1 * (n / 100) ^ 1.2) AS c,
 CASE WHEN n > 1 THEN least(1, 0.25 + CASE WHEN s / m >= 0.2 THEN 0.5 + 0.2 * least(1, (s / m - 0.2) / 0.3) WHEN s / m > 0.05 THEN 0.3 + 0.2 * (s / m - 0.05) / 0.15 ELSE 0.1 + 0.2 * (s / m) / 0.05 END) ELSE 0 END AS t FROM o),
q AS (SELECT *, 0.3 * g + 0.25 * v + 0.25 * c + 0.2 * t AS a FROM p)
SELECT o_custkey, round(g, 6) AS guest_score, round(v, 6) AS volume_score, round(c, 6) AS correlation_score, round(t, 6) AS structure_score, round(CASE WHEN a > 0.5 THEN least(1, a + 0.08 * (a - 0.5) ^ 1.5) ELSE a END, 6) AS overall_score, true AS is_valid FROM q"""
)
def run_scores(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_entries"), F.count_if(F.col("o_orderstatus") == "F").alias("n_exits"), F.avg("o_totalprice").alias("volume_mean"), F.stddev_pop("o_totalprice").alias("volume_std"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("volume_range"), (F.count("*") / 50).alias("r_max"), (F.count("*") / 100).alias("r_mean"), F.lit(2).alias("n_strong"), (F.stddev_pop("o_totalprice") / F.avg("o_totalprice")).alias("dist_cv"), F.count("*").alias("n_dist"))
    return scoring.score_runs(o).select("o_custkey", *(r(c).alias(c) for c in ("guest_score", "volume_score", "correlation_score", "structure_score", "overall_score")), "is_valid")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").select(F.col("label").cast("string").alias("traj_id"), "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("pcs"), F.col("embedding")[3].cast("double").alias("rmsd"), F.col("embedding")[4].cast("double").alias("rg"))
    return scoring.score_frames(windows.number_frames(e, "traj_id", ["vec_id"]))


SCORED = """e AS (SELECT label::VARCHAR AS traj_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS rmsd, embedding[5]::DOUBLE AS rg FROM embeddings),
g AS (SELECT *, abs(CASE WHEN lead(rmsd) OVER o IS NOT NULL AND lag(rmsd) OVER o IS NOT NULL THEN (lead(rmsd) OVER o - lag(rmsd) OVER o) / 2 WHEN lead(rmsd) OVER o IS NOT NULL THEN lead(rmsd) OVER o - rmsd WHEN lag(rmsd) OVER o IS NOT NULL THEN rmsd - lag(rmsd) OVER o ELSE 0 END) AS g FROM e WINDOW o AS (PARTITION BY traj_id ORDER BY frame)),
p AS (SELECT traj_id, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT traj_id, unnest([a, b, c]) AS v FROM e) GROUP BY 1),
z AS (SELECT g.traj_id, frame, a, b, c, m, s, CASE WHEN stddev_pop(g) OVER w = 0 THEN 0 ELSE (g - avg(g) OVER w) / stddev_pop(g) OVER w END AS zg, CASE WHEN stddev_pop(rg) OVER w = 0 THEN 0 ELSE abs((rg - avg(rg) OVER w) / stddev_pop(rg) OVER w) END AS zr FROM g JOIN p USING (traj_id) WINDOW w AS (PARTITION BY traj_id)),
scored AS (SELECT traj_id, frame::BIGINT AS frame, a, b, c, 0.35 * greatest(abs((a - m) / s), abs((b - m) / s), abs((c - m) / s)) + 0.2 * zg + 0.35 * zr AS score FROM z)"""


@query(f"WITH {SCORED} SELECT traj_id, frame, round(score, 5) AS score FROM scored")
def frame_scores(spark, d):
    return _scored(spark, d).select("traj_id", F.col("frame").cast("long").alias("frame"), r("score", 5).alias("score"))


@query(
    f"""WITH RECURSIVE {SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY score DESC, frame) AS k FROM scored),
walk AS (SELECT DISTINCT traj_id, 0::BIGINT AS k, []::DOUBLE[][] AS spots, NULL::BIGINT AS frame, NULL::DOUBLE AS score, false AS taken FROM o
 UNION ALL SELECT traj_id, k, CASE WHEN ok THEN list_append(spots, spot) ELSE spots END, frame, score, ok
 FROM (SELECT w.traj_id, o.k, w.spots, [o.a, o.b, o.c] AS spot, o.frame, o.score, len(w.spots) < 12 AND len(list_filter(w.spots, lambda s: sqrt((s[1] - o.a) ^ 2 + (s[2] - o.b) ^ 2 + (s[3] - o.c) ^ 2) < 0.1)) = 0 AS ok FROM walk w JOIN o ON o.traj_id = w.traj_id AND o.k = w.k + 1) AS step)
SELECT traj_id, frame, round(score, 5) AS score, false AS must FROM walk WHERE taken"""
)
def selected_frames(spark, d):
    out = scoring.select_frames(_scored(spark, d), most=12, apart=0.1)
    return out.select("traj_id", F.col("frame").cast("long").alias("frame"), r("score", 5).alias("score"), "must")


@query(
    f"""WITH {SEG}, h AS (SELECT user_id, segment_id, m AS source, lead(m) OVER w AS target, start_frame AS a, end_frame AS b, lead(start_frame) OVER w AS ta, lead(end_frame) OVER w AS tb FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY start_frame, segment_id)),
e AS (SELECT * FROM h WHERE target IS NOT NULL AND source <> target),
f AS (SELECT user_id, frame, 'value' AS feature, value AS v FROM ev UNION ALL SELECT user_id, frame, 'extra', json_extract_string(props, '$.k')::DOUBLE FROM ev),
s AS (SELECT e.user_id, segment_id, source, target, 0.0 AS side, feature, v FROM e JOIN f ON f.user_id = e.user_id AND frame BETWEEN a AND b UNION ALL SELECT e.user_id, segment_id, source, target, 1.0, feature, v FROM e JOIN f ON f.user_id = e.user_id AND frame BETWEEN ta AND tb),
g AS (SELECT user_id, segment_id, source, target, feature, avg(v) FILTER (side = 1) - avg(v) FILTER (side = 0) AS delta, CASE WHEN var_pop(v) > 0 THEN corr(v, side) END AS r FROM s GROUP BY ALL),
c AS (SELECT feature, stddev_pop(v) AS scale FROM f GROUP BY 1),
p AS (SELECT source, target, feature, avg(delta) AS mean_delta, avg(abs(delta / scale)) AS mean_std_delta, avg(abs(r)) AS mean_abs_r, count(*) AS n_events FROM g JOIN c USING (feature) GROUP BY ALL),
q AS (SELECT *, 0.5 * mean_std_delta / max(mean_std_delta) OVER (PARTITION BY source, target) + 0.5 * coalesce(mean_abs_r, 0) AS score FROM p)
SELECT source, target, feature, round(mean_delta, 5) AS mean_delta, round(mean_std_delta, 5) AS mean_std_delta, round(mean_abs_r, 5) AS mean_abs_r, n_events, round(score, 5) AS score, n_events < 2 AS is_descriptive, row_number() OVER (PARTITION BY source, target ORDER BY score DESC, feature) AS rank FROM q"""
)
def transition_attribution(spark, d):
    ev = frames(spark, d).withColumn("extra", F.get_json_object("props", "$.k").cast("double"))
    seg = segments(spark, d).join(A.majority(ev.withColumn("segment_id", F.floor(F.col("frame") / 10)), ["user_id", "segment_id"], "event_type").select("user_id", "segment_id", F.col("mode").alias("m")), ["user_id", "segment_id"])
    out = attribution.transition_scores(windows.handoffs(seg, "user_id", "m"), ev, ["value", "extra"], "user_id")
    return out.withColumns({c: r(c, 5) for c in ("mean_delta", "mean_std_delta", "mean_abs_r", "score")}).withColumn("rank", F.col("rank").cast("long"))


# ---- kernels


def _signals(spark: SparkSession, d: str) -> DataFrame:
    ev = frames(spark, d).select(F.col("user_id").cast("string").alias("traj_id"), "frame", F.col("frame").cast("double").alias("time_ps"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return changepoints.signals(ev, {"value": ["value"], "both": ["value", "k"]})


@query()
def pelt_breakpoints(spark, d):
    return changepoints.detect(_signals(spark, d), "pelt", "l2", jump=1)


@query()
def penalty_sweep(spark, d):
    return changepoints.sweep_summary(changepoints.sweep(_signals(spark, d), 6, "l2", jump=1), 3)


@query()
def recrossings_suppressed(spark, d):
    ev = frames(spark, d).select("user_id", "frame", "event_type")
    return changepoints.suppress_recrossings(ev, "event_type", "user_id", "frame", 2)


@query()
def ward_labels(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("label").alias("grp"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return clustering.ward(e, ["vec_id"], ["grp"], k_max=6)


@query()
def kmeans_labels(spark, d):
    return clustering.kmeans(t(spark, d, "embeddings"), "embedding", 5).select("vec_id", "cluster")


@query()
def principal_components(spark, d):
    return clustering.pca(t(spark, d, "embeddings"), "embedding", 3)[0].select("vec_id", "pcs")


@query()
def tica_scores(spark, d):
    e = windows.number_frames(t(spark, d, "embeddings").select(F.col("label").cast("string").alias("traj_id"), "vec_id", F.col("embedding").alias("x")), "traj_id", ["vec_id"])
    return clustering.tica(e, "x", 3)[0].select("traj_id", "frame", "tics")


@query()
def two_stage_states(spark, d):
    out = clustering.two_stage(t(spark, d, "embeddings"), "embedding", 30, 5)
    return out.select("vec_id", "micro", "macro_label")


# ---- whole analyses


@query(
    f"""WITH {RUNS}, p AS (SELECT user_id, event_type AS source, n_rows, lead(event_type) OVER (PARTITION BY user_id ORDER BY start) AS target FROM runs)
SELECT source, target, count(*) AS n, round(avg(n_rows), 6) AS mean_dwell, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS probability FROM p WHERE target IS NOT NULL GROUP BY source, target"""
)
def regime_transitions(spark, d):
    """The flagship: series to runs, runs to dwells, dwells to a row-normalised transition table."""
    runs = windows.run_table(frames(spark, d), "user_id", "frame", "event_type")
    pairs = windows.transitions(runs, "user_id", "start", "event_type")
    from pyspark.sql import Window as W

    out = pairs.groupBy("source", "target").agg(F.count("*").alias("n"), r(F.avg("n_rows")).alias("mean_dwell"))
    return out.withColumn("probability", r(F.col("n") / F.sum("n").over(W.partitionBy("source"))))
