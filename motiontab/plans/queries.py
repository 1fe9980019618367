"""Registered queries of the track library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiontab.functions import geometry as g
from motiontab.functions import windows as w
from motiontab.operators import binning, events, kinematics, stats, summary
from motiontab.plans.fixtures import frames, frames_sql, measures, measures_sql
from motiontab.plans.oracle import angle, kinematics_ctes, limits, mean, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rnd(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with the SQL, minus zero as zero."""
    return df.select(*[F.col(c) if c in keep or t != "double" else (F.round(c, digits) + 0.0).alias(c) for c, t in df.dtypes])


KIN = "WITH " + kinematics_ctes()
FRAMES = "WITH " + frames_sql()
MEASURES = "WITH " + measures_sql()
MASK = "coalesce(collision_flag, 0) IN (1, 2)"
TRACKED = ("midpoint_speed", "midpoint_distance", "head_vector_angular_speed", "tail_vector_angular_speed", "head_vel_forward", "tail_vel_forward", "bending_angle", "bearing_angle", "heading_angle", "odor_speed", "distance_to_odor")


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.analysed(frames(spark, sf_dir))


# geometry and projections


@query("b01_clockwise_angle", f"{FRAMES} SELECT id, frame, {rounded('angle')} FROM (SELECT id, frame, {angle('spinepoint_x_1', 'spinepoint_y_1', 'spinepoint_x_6', 'spinepoint_y_6')} AS angle FROM frames)")
def _(spark, d):
    return rnd(frames(spark, d).select("id", "frame", g.clockwise_angle("spinepoint_x_1", "spinepoint_y_1", "spinepoint_x_6", "spinepoint_y_6").alias("angle")))


@query("b03_rotate_to_odor", f"{KIN} SELECT id, frame, {rounded('x1r', 'y1r', 'x6r', 'y6r', 'oy')} FROM rot")
def _(spark, d):
    r = kinematics.rotated_to_odor(kinematics.long_tracks(frames(spark, d), 32))
    return rnd(r.select("id", "frame", F.col("spinepoint_x_1_rot").alias("x1r"), F.col("spinepoint_y_1_rot").alias("y1r"), F.col("spinepoint_x_6_rot").alias("x6r"), F.col("spinepoint_y_6_rot").alias("y6r"), F.col("odor_a_y_rot").alias("oy")))


@query("b04_spine_length", f"{KIN} SELECT id, frame, {rounded('spine_length')} FROM rot")
def _(spark, d):
    return rnd(kinematics.with_spine_length(kinematics.long_tracks(frames(spark, d), 32)).select("id", "frame", "spine_length"))


@query("b12_body_length_normalised", f"{KIN} SELECT id, frame, {rounded('s', 'h')} FROM (SELECT id, frame, CASE WHEN NOT {MASK} THEN midpoint_speed / mean_length END AS s, CASE WHEN NOT {MASK} THEN head_vel_forward / mean_length END AS h FROM kin)")
def _(spark, d):
    return rnd(analysed(spark, d).select("id", "frame", F.col("midpoint_speed_bl").alias("s"), F.col("head_vel_forward_bl").alias("h")))


@query("b13_masked_rows", f"{KIN} SELECT id, collision_flag, count(*) AS n, count(CASE WHEN NOT {MASK} THEN bending_angle END) AS bending, count(abs(bending_angle)) AS abs_bending FROM kin GROUP BY ALL")
def _(spark, d):
    return analysed(spark, d).groupBy("id", "collision_flag").agg(F.count("*").alias("n"), F.count("bending_angle").alias("bending"), F.count("abs_bending_angle").alias("abs_bending"))


@query("b14_row_filters", f"{MEASURES} SELECT id, count(*) AS n FROM measures WHERE frame BETWEEN 32 AND 640 AND distance_to_odor BETWEEN 4 AND 24 AND abs(bearing_angle) BETWEEN 10 AND 170 AND run_direction IN (1) GROUP BY id")
def _(spark, d):
    return summary.filtered(measures(spark, d), (2, 40), (4, 24), (10, 170), "forwards").groupBy("id").agg(F.count("*").alias("n"))


@query("b18_rescaled", f"{MEASURES} SELECT id, frame, -(2 * distance_to_odor / (2 * 32.0) - 1) AS y FROM measures")
def _(spark, d):
    return measures(spark, d).select("id", "frame", g.rescale("distance_to_odor", 32.0).alias("y"))


@query("b21_every_fourth_row", f"{MEASURES} SELECT id, frame FROM (SELECT id, frame, row_number() OVER (PARTITION BY id ORDER BY frame) AS r FROM measures) WHERE r % 4 = 1")
def _(spark, d):
    return measures(spark, d).withColumn("row", w.position()).where("row % 4 = 1").select("id", "frame")


# time series


@query("c01_smoothed_points", f"{KIN} SELECT id, frame, {rounded('x6', 'y6', 'x12', 'y12', digits=10)} FROM conv")
def _(spark, d):
    a = kinematics.analysed(frames(spark, d), keep_points=True)
    return rnd(a.select("id", "frame", *[F.col(f"spinepoint_{c}_{k}_conv").alias(f"{c}{k}") for k in (6, 12) for c in "xy"]), digits=10)


@query("c02_even_window", f"{MEASURES} SELECT id, frame, {mean('area', 6)} AS m FROM measures")
def _(spark, d):
    return measures(spark, d).select("id", "frame", w.centred("area", 6).alias("m"))


@query("c05_rolling_median", f"{MEASURES} SELECT id, frame, CASE WHEN count(tail_vel_forward) OVER w = 9 THEN median(tail_vel_forward) OVER w END AS m FROM measures WINDOW w AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
def _(spark, d):
    return measures(spark, d).select("id", "frame", w.centred_median("tail_vel_forward", 9).alias("m"))


@query("c05_long_rolling_median", f"{MEASURES} SELECT id, frame, CASE WHEN count(tail_vel_forward_bl) OVER w = 80 THEN median(tail_vel_forward_bl) OVER w END AS m FROM (SELECT id, frame, coalesce(tail_vel_forward_bl, 0) AS tail_vel_forward_bl FROM measures) WINDOW w AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 39 PRECEDING AND 40 FOLLOWING)")
def _(spark, d):
    return measures(spark, d).select("id", "frame", w.centred_median(F.coalesce("tail_vel_forward_bl", F.lit(0.0)), 80).alias("m"))


def _tracked(name: str, *columns: str, digits: int = 7) -> None:
    masked = ", ".join(f"CASE WHEN NOT {MASK} THEN {c} END AS {c}" for c in columns)

    @query(name, f"{KIN} SELECT id, frame, {rounded(*columns, digits=digits)} FROM (SELECT id, frame, {masked} FROM kin)")
    def _(spark, d):
        return rnd(analysed(spark, d).select("id", "frame", *columns), digits=digits)


_tracked("c07_midpoint_speed", "midpoint_speed", "midpoint_distance")
_tracked("c09_head_angular_speed", "head_vector_angular_speed")
_tracked("c10_tail_angular_speed", "tail_vector_angular_speed")
_tracked("c11_head_velocity", "head_vel_forward")
_tracked("c12_tail_velocity", "tail_vel_forward")
_tracked("c13_odor_speed", "odor_speed", "distance_to_odor", digits=10)
_tracked("c14_bending_angle", "bending_angle", "bearing_angle", "heading_angle")


@query("c08_distance_to_start", f"{KIN} SELECT id, frame, {rounded('distance_to_sp')} FROM kin")
def _(spark, d):
    return rnd(analysed(spark, d).select("id", "frame", "distance_to_sp"))


@query("c15_flip_flag", f"""{KIN} SELECT id, frame, CASE WHEN count(f) OVER w = 5 THEN sum(f) OVER w > 0 END AS na_flag_flip
FROM (SELECT id, frame, CAST((abs(head_vector_angular_speed) > 180) OR (tail_vector_angular_speed > 180) AS INT) AS f FROM kin)
WINDOW w AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(spark, d):
    return analysed(spark, d).select("id", "frame", "na_flag_flip")


_ISLANDS = f"""{MEASURES},
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY frame) AS row FROM measures),
o AS (SELECT *, coalesce(abs(head_vector_angular_speed) > 60, false) AND row > 1 AS over FROM r),
i AS (SELECT *, row - row_number() OVER (PARTITION BY id ORDER BY frame) AS k FROM o WHERE over),
j AS (SELECT id, k, min(row) - 1 AS a, max(row) AS b FROM i GROUP BY id, k),
v AS (SELECT j.id, j.a, j.b, max(abs(o.tail_vector_angular_speed)) AS tail, max(abs(o.head_vector_angular_speed)) AS top,
             min(CASE WHEN o.row = j.a THEN o.bending_angle END) AS b1, min(CASE WHEN o.row = j.b THEN o.bending_angle END) AS b2,
             min(CASE WHEN o.row = j.a THEN o.heading_angle END) AS h1, min(CASE WHEN o.row = j.b THEN o.heading_angle END) AS h2
      FROM j JOIN o ON o.id = j.id AND o.row BETWEEN j.a AND j.b GROUP BY ALL),
c AS (SELECT v.*, (SELECT min(o.row) + 1 FROM o WHERE o.id = v.id AND o.row BETWEEN v.a AND v.b AND abs(o.head_vector_angular_speed) = v.top) AS peak,
             coalesce(tail < 45, false) AS tail_ok, coalesce(abs(b1 - b2) > 20, false) AS size_ok FROM v)"""


@query("c16_head_cast_intervals", f"{_ISLANDS} SELECT id, a AS start, b AS \"end\", peak, b2 - b1 AS angle, abs(h1) - abs(h2) AS reorientation, tail_ok, size_ok FROM c")
def _(spark, d):
    df = events.with_row(measures(spark, d))
    out = events.head_cast_intervals(df, 60.0, 45.0, 20.0)
    return out.select("id", F.col("start").cast("long"), F.col("end").cast("long"), F.col("peak").cast("long"), "angle", "reorientation", "tail_ok", "size_ok")


@query("c19_head_cast_flags", f"""{_ISLANDS}, ok AS (SELECT * FROM c WHERE tail_ok AND size_ok), s AS (SELECT id, count(*) AS n FROM ok GROUP BY id),
f AS (SELECT o.id, o.frame, o.head_vector_angular_speed AS h, CASE WHEN coalesce(s.n, 0) > 0 THEN EXISTS (SELECT 1 FROM ok WHERE ok.id = o.id AND o.row BETWEEN ok.a AND ok.b) ELSE o.over END AS flag,
             EXISTS (SELECT 1 FROM ok WHERE ok.id = o.id AND ok.peak = o.row) AS hc FROM o LEFT JOIN s ON s.id = o.id)
SELECT id, frame, CAST(flag AS INT) AS HC_flag, CAST(hc AS INT) AS HCs, CAST(flag AND coalesce(h > 0, false) AS INT) AS HCs_left, CAST(flag AND coalesce(h < 0, false) AS INT) AS HCs_right FROM f""")
def _(spark, d):
    df = measures(spark, d).drop("HCs", "HC_angle", "HC_reorientation", "Abs_HC_angle")
    return events.with_head_casts(df, 60.0, 45.0, 20.0).select("id", "frame", "HC_flag", "HCs", "HCs_left", "HCs_right")


@query("c22_run_flag", f"""{MEASURES} SELECT id, frame, CASE WHEN count(*) OVER (PARTITION BY id) > 12 THEN CASE WHEN count(*) OVER w = 12 THEN sum(HCs) OVER w = 0 END ELSE HCs = 0 END AS run_flag
FROM measures WINDOW w AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)""")
def _(spark, d):
    df = measures(spark, d).withColumns({"HCs_left": F.col("HCs"), "HCs_right": F.lit(0)})
    return events.with_run_flag(df, 4).select("id", "frame", "run_flag")


_STEPS = f"""{MEASURES},
r AS (SELECT *, row_number() OVER t AS row, sign(lead(tail_vel_forward, 2) OVER t - lead(tail_vel_forward) OVER t) - sign(lead(tail_vel_forward) OVER t - tail_vel_forward) AS turn,
             lead(tail_vel_forward, 1) OVER t AS v1, lead(tail_vel_forward, 2) OVER t AS v2, lead(tail_vel_forward, 3) OVER t AS v3, lead(tail_vel_forward, 4) OVER t AS v4,
             lead(row, 4) OVER t IS NOT NULL AS five FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY frame) AS row FROM measures) WINDOW t AS (PARTITION BY id ORDER BY frame)),
p AS (SELECT *, coalesce(turn = -2 AND NOT coalesce(tail_vel_forward < 0.6, false), false) AS step_forward,
             coalesce(five AND v1 = least(tail_vel_forward, v1, v2, v3, v4) AND (tail_vel_forward IS NULL OR tail_vel_forward > v1) AND NOT coalesce(tail_vel_forward > -0.4, false), false) AS step_backward FROM r)"""


@query("c23_step_candidates", f"{_STEPS.replace('row_number() OVER t AS row, ', '')} SELECT id, frame, step_forward, step_backward FROM p")
def _(spark, d):
    return events.with_step_candidates(measures(spark, d)).select("id", "frame", "step_forward", "step_backward")


@query("c25_step_pairs", f"""{_STEPS.replace('row_number() OVER t AS row, ', '')},
q AS (SELECT id, row, frame, run_flag, midpoint_distance AS md, lead(row) OVER t AS row2, lead(frame) OVER t AS frame2, lead(run_flag) OVER t AS run2, lead(midpoint_distance) OVER t AS md2
      FROM p WHERE step_forward OR step_backward WINDOW t AS (PARTITION BY id ORDER BY frame))
SELECT q.id, q.row AS start, q.row2 AS "end", (frame2 - q.frame) / 16.0 AS "interval", md2 - md AS distance, round(avg(p.midpoint_speed), 9) AS run_speed
FROM q JOIN p ON p.id = q.id AND p.row BETWEEN q.row AND q.row2 WHERE q.run_flag AND q.run2 GROUP BY ALL""")
def _(spark, d):
    df = events.with_step_candidates(measures(spark, d)).withColumns({"tail_vector_x": F.lit(1.0), "tail_vector_y": F.lit(0.0)})
    s = events.steps_of(df)
    return s.select("id", F.col("start").cast("long"), F.col("end").cast("long"), F.col("IS_interval").alias("interval"), F.col("IS_distance").alias("distance"), F.round("run_speed", 9).alias("run_speed"))


@query("c35_z_scores", f"{MEASURES} SELECT id, frame, round((area - avg(area) OVER w) / stddev_samp(area) OVER w, 6) + 0.0 AS z FROM measures WINDOW w AS (PARTITION BY id)")
def _(spark, d):
    return rnd(measures(spark, d).select("id", "frame", w.z_score("area").alias("z")))


@query("c37_event_markers", f"""{MEASURES} SELECT id, kind, frame / 16.0 AS seconds FROM (SELECT id, frame, unnest(list_filter([CASE WHEN step_boolean THEN 'step' END, CASE WHEN flanks = 1 THEN 'to_forward' END, CASE WHEN flanks = -1 THEN 'to_backward' END], lambda x: x IS NOT NULL)) AS kind FROM measures)""")
def _(spark, d):
    return events.event_markers(measures(spark, d).withColumns({"HCs_left": F.lit(0), "HCs_right": F.lit(0)}))


# the whole chain, without SQL: held against row loops in the tests


@query("c34_event_chain")
def _(spark, d):
    return rnd(events.with_events(analysed(spark, d), least_head=35.0, most_tail=45.0, min_size=0.0).select("id", "frame", "HCs", "HC_flag", "HC_angle", "run_flag", "run_direction", "step_boolean", "IS_angle", "run_speed", "step_extr", "minima", "flanks"))


# summaries


@query("d01_summary_by_id", f"""{MEASURES}, n AS (SELECT id FROM measures GROUP BY id HAVING count(*) > 16 * 5), r AS (SELECT m.* FROM measures m JOIN n USING (id)),
u AS (SELECT DISTINCT id, "group", condition, group_condition FROM r), f AS (SELECT * FROM r),
x AS (SELECT id, avg(bending_angle) AS b, var_samp(bending_angle) AS bv, avg(abs(bearing_angle)) AS ab, avg(midpoint_speed) / avg(spine_length) AS s, var_samp(midpoint_speed) / power(avg(spine_length), 2) AS sv,
             CASE WHEN count(midpoint_distance) = count(*) THEN max(midpoint_distance) END AS md, sum(CASE WHEN collision_flag <> 0 THEN 1 ELSE 0 END) AS col,
             sum(CASE WHEN Abs_HC_angle BETWEEN 20 AND 360 THEN HCs END) AS hc, sum(CASE WHEN Abs_HC_angle BETWEEN 20 AND 360 AND odor_orientation = 'away' THEN HCs END) AS away, count(*) AS rows,
             avg(CASE WHEN step_boolean THEN run_speed END) AS rs, (count(CASE WHEN spinepoint_y_6_conv > 0 THEN 1 END) - count(CASE WHEN spinepoint_y_6_conv < 0 THEN 1 END)) / count(*)::DOUBLE AS pr FROM f GROUP BY id),
g AS (SELECT id, first(distance_to_odor ORDER BY frame) - last(distance_to_odor ORDER BY frame) AS gain FROM r WHERE distance_to_odor IS NOT NULL GROUP BY id)
SELECT u.id, u.group_condition, round(b, 6) + 0.0 AS bending_angle_mean, round(bv, 6) AS bending_angle_var, round(ab, 6) AS abs_bearing_angle_mean, round(s, 6) AS midpoint_speed_bl_mean, round(sv, 6) AS midpoint_speed_bl_var,
       md AS midpoint_distance_max, CAST(coalesce(col, 0) AS BIGINT) AS collisions, CAST(coalesce(hc, 0) AS BIGINT) AS HCs, CAST(coalesce(away, 0) AS BIGINT) AS HCs_away, round(coalesce(hc, 0) / rows, 6) AS HC_rate, round(rs, 6) AS run_speed_mean, round(pr, 6) + 0.0 AS preference, gain AS preference_dist_se
FROM u LEFT JOIN x USING (id) LEFT JOIN g USING (id)""")
def _(spark, d):
    s = summary.summarised(measures(spark, d), "id", threshold=5)
    keep = "id group_condition bending_angle_mean bending_angle_var abs_bearing_angle_mean midpoint_speed_bl_mean midpoint_speed_bl_var midpoint_distance_max collisions HCs HCs_away HC_rate run_speed_mean preference preference_dist_se".split()
    return rnd(s.withColumns({c: F.col(c).cast("long") for c in ("collisions", "HCs", "HCs_away")}).select(*keep))


@query("d04_acceleration_by_trial", f"""{MEASURES}, x AS (SELECT *, lead(midpoint_speed) OVER (PARTITION BY trial, "group", condition ORDER BY id, frame) - midpoint_speed AS dd FROM measures)
SELECT trial, "group", condition, round(avg(dd), 6) + 0.0 AS midpoint_speed_diff_mean, round(var_samp(dd), 6) AS midpoint_speed_diff_var FROM x GROUP BY ALL""")
def _(spark, d):
    s = summary.summarised(measures(spark, d), "trial")
    return rnd(s.select("trial", "group", "condition", "midpoint_speed_diff_mean", "midpoint_speed_diff_var"))


@query("d07_head_cast_summary", f"""{MEASURES}, x AS (SELECT group_condition, trial, "group", condition, avg(CASE WHEN Abs_HC_angle BETWEEN 20 AND 360 THEN HC_angle END) AS a,
  sum(CASE WHEN Abs_HC_angle BETWEEN 20 AND 360 AND odor_orientation = 'towards' THEN HCs ELSE 0 END) / nullif(count(CASE WHEN odor_orientation = 'towards' THEN 1 END), 0)::DOUBLE AS t,
  sum(CASE WHEN Abs_HC_angle BETWEEN 20 AND 360 AND odor_orientation = 'away' THEN HCs ELSE 0 END) / nullif(count(CASE WHEN odor_orientation = 'away' THEN 1 END), 0)::DOUBLE AS w FROM measures GROUP BY ALL)
SELECT trial, "group", condition, round(a, 6) + 0.0 AS HC_angle_mean, round((w - t) / nullif(w + t, 0), 6) + 0.0 AS HC_rate_modulation FROM x""")
def _(spark, d):
    return rnd(summary.summarised(measures(spark, d), "trial").select("trial", "group", "condition", "HC_angle_mean", "HC_rate_modulation"))


@query("d12_accepted_tracks", f"{MEASURES}, n AS (SELECT id, count(*) AS n FROM measures GROUP BY id) SELECT round(100.0 * avg(CASE WHEN n > 16 * 30 THEN 1.0 ELSE 0.0 END), 6) AS ids_percent, round(100.0 * sum(CASE WHEN n > 16 * 30 THEN n ELSE 0 END) / sum(n), 6) AS frames_percent FROM n")
def _(spark, d):
    return rnd(summary.acceptance(measures(spark, d), 30))


@query("d31_per_step", f"""{MEASURES}, x AS (SELECT *, sum(CAST(step_boolean AS INT)) OVER (PARTITION BY id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS step_count FROM measures)
SELECT id, group_condition, CAST(step_count AS BIGINT) AS step_count, count(*) AS n, round(avg(tail_vel_forward), 6) + 0.0 AS tail_vel_forward_mean, round(avg(CASE WHEN step_boolean THEN run_speed END), 6) AS run_speed_mean FROM x GROUP BY ALL""")
def _(spark, d):
    return rnd(summary.per_step(measures(spark, d, spread=True)).select("id", "group_condition", "step_count", "n", "tail_vel_forward_mean", "run_speed_mean"))


@query("d32_minima_classes", f"""{MEASURES}, c AS (SELECT *, CASE WHEN step_extr > 2 THEN '>2' ELSE CAST(step_extr AS VARCHAR) END AS minima FROM measures),
ev AS (SELECT * FROM (SELECT DISTINCT id FROM measures) CROSS JOIN (SELECT DISTINCT minima FROM c))
SELECT ev.id, ev.minima, count(c.id) AS n, round(avg(CASE WHEN step_boolean THEN run_speed END), 6) AS run_speed_mean FROM ev LEFT JOIN c ON c.id = ev.id AND c.minima IS NOT DISTINCT FROM ev.minima GROUP BY ALL""")
def _(spark, d):
    return rnd(summary.per_minima_class(measures(spark, d)).select("id", "minima", "n", "run_speed_mean"))


# binning

_BINS = f"""{MEASURES}, z AS (SELECT min(frame)::DOUBLE AS lo, max(frame)::DOUBLE AS hi FROM measures),
b AS (SELECT m.*, CAST(CASE WHEN ceil((frame - lo) / 160) BETWEEN 1 AND floor((hi - lo) / 160) THEN ceil((frame - lo) / 160) END AS INT) AS bin, lo FROM measures m, z)"""


@query("d14_bins", f"{_BINS} SELECT bin, (lo + (bin - 0.5) * 160) / 16 AS midpoint, count(*) AS n FROM b GROUP BY ALL")
def _(spark, d):
    return binning.binned(measures(spark, d), "frame", 10).groupBy("bin", "midpoint").agg(F.count("*").alias("n"))


@query("d17_binned_series", f"""{_BINS} SELECT group_condition, bin, round(avg(midpoint_speed), 6) AS midpoint_speed_mean, round(avg(abs(bearing_angle)), 6) AS abs_bearing_angle_mean, count(*) AS "N",
round(sum(CASE WHEN Abs_HC_angle IS NULL OR Abs_HC_angle BETWEEN 20 AND 360 THEN HCs END) / count(*)::DOUBLE, 6) AS HC_rate, round(avg(run_speed), 6) AS run_speed_mean FROM b GROUP BY ALL""")
def _(spark, d):
    t = binning.binned_table(binning.binned(measures(spark, d), "frame", 10))
    return rnd(t.select("group_condition", "bin", "midpoint_speed_mean", "abs_bearing_angle_mean", "N", "HC_rate", "run_speed_mean"))


@query("d16_confidence_limits", f"{_BINS} SELECT group_condition, bin, {limits('midpoint_speed', 'midpoint_speed')} FROM b GROUP BY ALL")
def _(spark, d):
    t = binning.binned_table(binning.binned(measures(spark, d), "frame", 10), ["ts"])
    return rnd(t.select("group_condition", "bin", "midpoint_speed_mean", "midpoint_speed_lowCI", "midpoint_speed_hiCI"), digits=5)


@query("d22_binned_by_animal", f"""{_BINS}, u AS (SELECT group_condition, bin, id, avg(midpoint_speed) AS v FROM b GROUP BY ALL)
SELECT group_condition, bin, round(avg(v), 6) AS midpoint_speed_mean FROM u GROUP BY ALL""")
def _(spark, d):
    t = binning.binned_by_unit(binning.binned(measures(spark, d), "frame", 10), "id", ["ts"])
    return rnd(t.select("group_condition", "bin", "midpoint_speed_mean"))


_GRID = f"""{MEASURES}, r AS (SELECT * FROM measures WHERE bearing_angle IS NOT NULL AND distance_to_odor IS NOT NULL), z AS (SELECT min(bearing_angle) a, max(bearing_angle) b, min(distance_to_odor) c, max(distance_to_odor) d FROM r),
h AS (SELECT CAST(least(8, floor((bearing_angle - a) * 8 / (b - a)) + 1) AS INT) AS xbin, CAST(least(8, floor((distance_to_odor - c) * 8 / (d - c)) + 1) AS INT) AS ybin, count(*) AS n, avg(midpoint_speed) AS z FROM r, z GROUP BY ALL)"""


@query("d25_heat_map", f"{_GRID} SELECT xbin, ybin, n, round(z, 6) AS z FROM h")
def _(spark, d):
    return rnd(binning.heat_map(measures(spark, d), "bearing_angle", "distance_to_odor", "midpoint_speed", 8))


@query("d26_median_filter", f"""{_GRID}, g AS (SELECT CAST(x AS INT) AS xbin, CAST(y AS INT) AS ybin FROM range(1, 9) a(x), range(1, 9) b(y))
SELECT g.xbin, g.ybin, round(median(h.z), 6) AS z FROM g LEFT JOIN h ON abs(h.xbin - g.xbin) <= 1 AND abs(h.ybin - g.ybin) <= 1 GROUP BY ALL""")
def _(spark, d):
    return rnd(binning.median_filtered(binning.heat_map(measures(spark, d), "bearing_angle", "distance_to_odor", "midpoint_speed", 8), 8))


@query("d26_default_filter")
def _(spark, d):
    # the application's own grid and filter; tests hold ten passes against a loop
    m = measures(spark, d).withColumn("time", F.col("frame") / 16)
    return rnd(binning.named_heat_map(m, "bearing_distance", "HC_rate"))


@query("d27_histogram", f"""{MEASURES}, r AS (SELECT id, area FROM measures), z AS (SELECT id, min(area) AS a, max(area) AS b FROM r GROUP BY id)
SELECT id, CAST(least(10, coalesce(floor((area - a) * 10 / nullif(b - a, 0)), 0) + 1) AS INT) AS bin, count(*) AS n FROM r JOIN z USING (id) GROUP BY ALL""")
def _(spark, d):
    return binning.histogram(measures(spark, d), "area", 10)


@query("d28_density")
def _(spark, d):
    return rnd(binning.density(measures(spark, d), "midpoint_speed", points=16))


@query("d29_outliers", f"""{MEASURES}, q AS (SELECT quantile_cont(odor_speed, 0.25) a, quantile_cont(odor_speed, 0.75) b, quantile_cont(HC_reorientation, 0.25) c, quantile_cont(HC_reorientation, 0.75) e FROM measures)
SELECT id, frame, CASE WHEN odor_speed BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN odor_speed END AS odor_speed, CASE WHEN HC_reorientation BETWEEN c - 1.5 * (e - c) AND e + 1.5 * (e - c) THEN HC_reorientation END AS HC_reorientation FROM measures, q""")
def _(spark, d):
    return stats.without_outliers(measures(spark, d).select("id", "frame", "odor_speed", "HC_reorientation"), ["odor_speed", "HC_reorientation"])


@query("d30_box_statistics", f"""{MEASURES}, q AS (SELECT group_condition, quantile_cont(midpoint_speed, 0.25) a, median(midpoint_speed) m, quantile_cont(midpoint_speed, 0.75) b FROM measures GROUP BY ALL)
SELECT group_condition, a AS q1, m AS median, b AS q3, min(CASE WHEN midpoint_speed BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN midpoint_speed END) AS low, max(CASE WHEN midpoint_speed BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN midpoint_speed END) AS high,
count(CASE WHEN midpoint_speed NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN 1 END) AS outliers, count(*) AS n FROM measures JOIN q USING (group_condition) WHERE midpoint_speed IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return stats.box_statistics(measures(spark, d), "midpoint_speed")


# tests and correlations

_RANKS = """WITH g AS (SELECT DISTINCT l_returnflag AS g FROM lineitem), p AS (SELECT x.g AS a, y.g AS b FROM g x JOIN g y ON x.g < y.g),
r AS (SELECT a, b, l_returnflag AS f, rank() OVER (PARTITION BY a, b ORDER BY l_quantity) + (count(*) OVER (PARTITION BY a, b, l_quantity) - 1) / 2.0 AS k FROM p JOIN lineitem ON l_returnflag IN (a, b))"""


@query("g01_rank_sums", f"""{_RANKS} SELECT a, b, 'l_quantity' AS variable, count(CASE WHEN f = a THEN 1 END) AS n_a, count(CASE WHEN f = b THEN 1 END) AS n_b,
CAST(sum(CASE WHEN f = a THEN k END) - count(CASE WHEN f = a THEN 1 END) * (count(CASE WHEN f = a THEN 1 END) + 1) / 2 AS DOUBLE) AS w FROM r GROUP BY a, b""")
def _(spark, d):
    t = stats.rank_sum_tests(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_quantity"], "l_returnflag")
    return t.select("a", "b", "variable", "n_a", "n_b", F.col("w").cast("double"))


@query("g02_all_tests")
def _(spark, d):
    return rnd(stats.rank_sum_tests(measures(spark, d), ["midpoint_speed", "bending_angle", "area"]))


@query("g04_kruskal", """WITH r AS (SELECT o_orderstatus AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS k FROM orders),
s AS (SELECT g, count(*) AS n, sum(k) AS r FROM r GROUP BY g), t AS (SELECT sum(c * c * c - c) AS tied FROM (SELECT count(*)::DOUBLE AS c FROM orders GROUP BY o_totalprice))
SELECT count(*) AS groups, round((12.0 / (sum(n) * (sum(n) + 1.0)) * sum(r * r / n) - 3 * (sum(n) + 1.0)) / (1 - min(tied) / (power(sum(n), 3) - sum(n))), 6) AS h FROM s, t""")
def _(spark, d):
    return rnd(stats.kruskal(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", "o_orderstatus").select("groups", "h"))


_VARS = ("midpoint_speed", "bending_angle", "tail_vel_forward", "area")


def _pairs_sql(rows: str, fold: str = "") -> str:
    out = [f"SELECT '{a}' AS a, '{b}' AS b, round({fold}(corr({a}, {b})), 6) + 0.0 AS r, count(*) AS n FROM x" for i, a in enumerate(_VARS) for b in _VARS[i + 1 :]]
    return f"{MEASURES}, c AS (SELECT {', '.join(_VARS)} FROM measures WHERE {' AND '.join(f'{v} IS NOT NULL' for v in _VARS)}), x AS ({rows}) " + " UNION ALL ".join(out)


@query("g05_correlations", _pairs_sql("SELECT * FROM c"))
def _(spark, d):
    return rnd(stats.correlations(measures(spark, d), _VARS))


@query("g05_spearman", _pairs_sql("SELECT " + ", ".join(f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS {v}" for v in _VARS) + " FROM c"))
def _(spark, d):
    return rnd(stats.correlations(measures(spark, d), _VARS, "spearman"))


@query("g06_significance")
def _(spark, d):
    return rnd(stats.significance(stats.correlations(measures(spark, d), _VARS)))


@query("g07_strongest_pairs", "SELECT a, b, abs(r) AS r, n FROM (" + _pairs_sql("SELECT * FROM c") + ") ORDER BY 3 DESC, 1, 2 LIMIT 3")
def _(spark, d):
    return rnd(stats.strongest(stats.correlations(measures(spark, d), _VARS), 3))


@query("g18_pairs_by_group", f"{MEASURES}, c AS (SELECT group_condition, midpoint_speed, area FROM measures WHERE midpoint_speed IS NOT NULL AND area IS NOT NULL) SELECT group_condition, 'midpoint_speed' AS a, 'area' AS b, round(corr(midpoint_speed, area), 6) + 0.0 AS r, count(*) AS n FROM c GROUP BY 1")
def _(spark, d):
    return rnd(stats.correlations(measures(spark, d), ["midpoint_speed", "area"], keys=["group_condition"]))


@query("g17_parallel_coordinates")
def _(spark, d):
    return rnd(stats.parallel_coordinates(measures(spark, d), ["midpoint_speed", "area", "grey"]))
