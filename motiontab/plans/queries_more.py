"""More registered queries: pieces of the event chain, selections, identities, orientation and track files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiontab.functions import geometry as g
from motiontab.functions import windows as w
from motiontab.operators import binning, collisions, events, kinematics, learning, linking, orientation, stats, summary
from motiontab.plans.fixtures import frames, measures
from motiontab.plans.oracle import angle, mean, rounded
from motiontab.plans.queries import _BINS, _STEPS, FRAMES, KIN, MASK, MEASURES, analysed, query, rnd
from motiontab.plans.queries_linking import OBJECTS, PIXELS, objects, pixel_table
from motiontab.sources import detections, tracks

_STEPS = _STEPS.replace("row_number() OVER t AS row, ", "")

# kinematics


_ABS = ("head_vector_angular_speed", "tail_vector_angular_speed", "bending_angle", "bearing_angle", "heading_angle")


@query("b09_absolute_values", f"{KIN} SELECT id, frame, {', '.join(f'round(abs({c}), 6) AS abs_{c}' for c in _ABS[2:])} FROM kin")
def _(spark, d):
    return rnd(analysed(spark, d).select("id", "frame", *[f"abs_{c}" for c in _ABS[2:]]))


@query("b10_odor_orientation", f"{KIN} SELECT id, frame, odor_orientation FROM kin")
def _(spark, d):
    return kinematics.with_kinematics(*_vectors(spark, d)).select("id", "frame", "odor_orientation")


@query("b11_side_of_dish", f"{KIN} SELECT id, frame, pref FROM kin")
def _(spark, d):
    return kinematics.with_kinematics(*_vectors(spark, d)).select("id", "frame", "pref")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame]:
    """Smoothed points with vectors, before masks."""
    df = kinematics.rotated_to_odor(kinematics.with_spine_length(kinematics.long_tracks(frames(spark, d), 32)))
    spots = kinematics.points_of(frames(spark, d))
    names = {f"spinepoint_{a}_{k}_rot": f"spinepoint_{a}_{k}_conv" for a in "xy" for k in spots}
    return (kinematics.with_vectors(kinematics.smoothed(df, list(names), 16, names)),)


@query("b14_without_flips", f"""{KIN}, f AS (SELECT id, frame, midpoint_speed, collision_flag, CASE WHEN count(f) OVER w = 5 THEN sum(f) OVER w > 0 END AS flip
FROM (SELECT *, CAST((abs(head_vector_angular_speed) > 180) OR (tail_vector_angular_speed > 180) AS INT) AS f FROM kin) WINDOW w AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT id, count(*) AS n, count(CASE WHEN NOT {MASK} THEN midpoint_speed END) AS speeds FROM f WHERE NOT flip GROUP BY id""")
def _(spark, d):
    return summary.filtered(analysed(spark, d), drop_flips=True).groupBy("id").agg(F.count("*").alias("n"), F.count("midpoint_speed").alias("speeds"))


@query("b19_selected_groups", f"{MEASURES} SELECT id, trial, \"group\", condition, group_condition, area, midpoint_speed FROM measures WHERE group_condition IN ('G0-C0', 'G1-C1')")
def _(spark, d):
    return summary.selected(measures(spark, d), ["G0-C0", "G1-C1"], ["area", "midpoint_speed"])


@query("c03_centred_or_same", f"{MEASURES} SELECT id, frame, CASE WHEN count(*) OVER (PARTITION BY id) < 100 THEN area ELSE {mean('area', 100)} END AS m FROM measures")
def _(spark, d):
    return measures(spark, d).select("id", "frame", w.centred_or_same("area", 100).alias("m"))


@query("c38_end_points", f"{MEASURES} SELECT id, arg_max(midpoint_speed, frame) AS x, arg_max(spinepoint_y_6_conv, frame) AS y FROM measures WHERE midpoint_speed IS NOT NULL AND spinepoint_y_6_conv IS NOT NULL GROUP BY id")
def _(spark, d):
    # the fixture has no x of its own; a speed stands in for it
    return summary.end_points(measures(spark, d).withColumn("spinepoint_x_6_conv", F.col("midpoint_speed")))


# steps and directions

_PAIRS = f"""{_STEPS},
q AS (SELECT id, row, frame, run_flag, heading_angle AS ha, bending_angle AS b, bearing_angle AS a, lead(row) OVER t AS row2, lead(run_flag) OVER t AS run2, lead(heading_angle) OVER t AS ha2, lead(bending_angle) OVER t AS b2, lead(bearing_angle) OVER t AS a2
      FROM p WHERE step_forward OR step_backward WINDOW t AS (PARTITION BY id ORDER BY frame)),
s AS (SELECT * FROM q WHERE run_flag AND run2)"""


def _steps(spark: SparkSession, d: str) -> DataFrame:
    df = measures(spark, d).drop("run_speed", "step_extr", "minima", "IS_angle", "Abs_IS_angle", "IS_interval", "IS_distance", "step_boolean", "gt_1min")
    return df.withColumns({"tail_vector_x": F.col("bending_angle"), "tail_vector_y": F.col("bearing_angle")})


@query("c27_step_angles", f"""{_PAIRS} SELECT id, row AS start, {rounded('a')} , round(abs(ha) - abs(ha2), 6) + 0.0 AS r, count(*) OVER (PARTITION BY id) AS n_steps
FROM (SELECT id, row, ha, ha2, {angle('b2', 'a2', 'b', 'a')} AS a FROM s)""")
def _(spark, d):
    s = events.steps_of(events.with_step_candidates(_steps(spark, d)))
    return rnd(s.select("id", F.col("start").cast("long"), F.col("IS_angle").alias("a"), F.col("IS_reorientation").alias("r"), "n_steps"))


@query("c29_local_minima", f"""{_PAIRS}, l AS (SELECT s.id, s.row AS start, s.row2 AS "end", list(p.tail_vel_forward ORDER BY p.row) AS v FROM s JOIN p ON p.id = s.id AND p.row BETWEEN s.row AND s.row2 GROUP BY ALL),
l2 AS (SELECT *, len(v) AS n, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS d FROM l),
l3 AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN i BETWEEN 2 AND n - 2 THEN (d[i - 1] + d[i] + d[i + 1]) / 3 END) AS sm FROM l2),
h AS (SELECT id, start, "end", CASE WHEN n > 5 THEN len(list_filter(range(1, n - 3), lambda i: coalesce(sm[i + 1] = list_min(sm[i:i + 4]) AND (sm[i] IS NULL OR sm[i] > sm[i + 1]), false)))
                                     WHEN n > 2 THEN len(list_filter(range(1, n - 1), lambda i: coalesce(v[i + 1] = list_min(v[i:i + 2]) AND (v[i] IS NULL OR v[i] > v[i + 1]), false))) END AS step_extr FROM l3)
SELECT *, CASE WHEN step_extr > 2 THEN '>2' ELSE CAST(step_extr AS VARCHAR) END AS minima, step_extr <> 1 AS gt_1min FROM h""")
def _(spark, d):
    m = events.local_minima(events.with_step_candidates(_steps(spark, d)))
    return m.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query("c30_steps_and_directions", f"""{_PAIRS}, n AS (SELECT id FROM s GROUP BY id HAVING count(*) > 2), s2 AS (SELECT s.* FROM s JOIN n USING (id)),
k AS (SELECT p.*, CASE WHEN step_backward THEN -1 WHEN step_forward THEN 1 END AS kind FROM p), z AS (SELECT id, max(row) AS last FROM k WHERE kind IS NOT NULL GROUP BY id),
y AS (SELECT k.*, z.last, last_value(CASE WHEN row < z.last THEN kind END IGNORE NULLS) OVER (PARTITION BY k.id ORDER BY row ROWS UNBOUNDED PRECEDING) AS way FROM k LEFT JOIN z ON z.id = k.id)
SELECT y.id, y.frame, EXISTS (SELECT 1 FROM s2 WHERE s2.id = y.id AND s2.row2 = y.row) AS step_boolean,
       CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.id = y.id) THEN CASE WHEN y.run_flag THEN CASE WHEN y.row <= y.last THEN coalesce(way, 1) ELSE 1 END ELSE 0 END END AS run_direction FROM y""")
def _(spark, d):
    return events.with_steps(_steps(spark, d).drop("run_direction")).select("id", "frame", "step_boolean", "run_direction")


@query("c31_interval_difference", f"""{_PAIRS} SELECT s.id, s.row AS start, s.row2 AS "end", y.area - x.area AS change FROM s JOIN p x ON x.id = s.id AND x.row = s.row JOIN p y ON y.id = s.id AND y.row = s.row2""")
def _(spark, d):
    df = events.with_row(events.with_step_candidates(_steps(spark, d)))
    out = events.interval_difference(df, events.steps_of(df), "area", lambda a, b: b - a, "change")
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


_FLANKS = f"""{MEASURES}, a AS (SELECT id, frame, CASE WHEN count(tail_vel_forward_bl) OVER f = 8 THEN median(tail_vel_forward_bl) OVER f END AS v FROM measures WINDOW f AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING)),
b AS (SELECT id, frame, CASE WHEN abs(v) < 0.03 THEN 0.0 ELSE v END AS v FROM a),
c AS (SELECT id, frame, sign(CASE WHEN count(v) OVER f = 8 THEN avg(v) OVER f END) AS s FROM b WINDOW f AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING)),
c2 AS (SELECT id, frame, s - lag(s) OVER t AS d, coalesce(s, 0) AS z FROM c WINDOW t AS (PARTITION BY id ORDER BY frame)),
h AS (SELECT id, frame, d, min(z) OVER p AS p0, max(z) OVER p AS p1, min(z) OVER n AS n0, max(z) OVER n AS n1, count(*) OVER n AS k FROM c2
      WINDOW p AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"""


@query("c32_flanks", f"{_FLANKS} SELECT id, frame, CASE WHEN d IN (-1, -2) AND p0 >= 0 AND n1 = -1 AND k = 4 THEN -1 WHEN d IN (1, 2) AND p1 <= 0 AND n0 = 1 AND k = 4 THEN 1 ELSE 0 END AS flanks FROM h")
def _(spark, d):
    return events.with_flanks(measures(spark, d).drop("flanks"), 2, 4, 2).select("id", "frame", "flanks")


_LONG = _FLANKS.replace("= 8 ", "= 80 ").replace("3 PRECEDING AND 4 FOLLOWING", "39 PRECEDING AND 40 FOLLOWING").replace("BETWEEN 4 PRECEDING AND 1 PRECEDING", "BETWEEN 80 PRECEDING AND 1 PRECEDING").replace("1 FOLLOWING AND 4 FOLLOWING", "1 FOLLOWING AND 80 FOLLOWING")
# long stretches of either direction, so that windows of five seconds turn
_SLOW = "tail_vel_forward_bl FROM (SELECT id, frame, CASE WHEN frame // 300 % 2 = 0 THEN 0.5 ELSE -0.5 END + frame % 7 / 64.0 AS tail_vel_forward_bl FROM measures)"


@query("c32_long_flanks", f"{_LONG.replace('AS v FROM measures', 'AS v FROM slow').replace(', a AS', f', slow AS (SELECT id, frame, {_SLOW}), a AS', 1)} SELECT id, frame, CASE WHEN d IN (-1, -2) AND p0 >= 0 AND n1 = -1 AND k = 80 THEN -1 WHEN d IN (1, 2) AND p1 <= 0 AND n0 = 1 AND k = 80 THEN 1 ELSE 0 END AS flanks FROM h")
def _(spark, d):
    m = measures(spark, d).drop("flanks").withColumn("tail_vel_forward_bl", F.when(F.expr("frame div 300 % 2 = 0"), 0.5).otherwise(-0.5) + F.col("frame") % 7 / 64.0)
    return events.with_flanks(m).select("id", "frame", "flanks")


@query("c33_switching_points", f"{MEASURES}, m AS (SELECT id, frame, count(*) OVER (PARTITION BY id) AS n, sign({mean('tail_vel_forward', 8)}) AS s FROM measures) SELECT id, frame, CASE WHEN n >= 16 THEN s - lag(s) OVER (PARTITION BY id ORDER BY frame) = 2 END AS back_to_for FROM m")
def _(spark, d):
    return events.with_switching_points(measures(spark, d), 4, 2).select("id", "frame", "back_to_for")


# tables


@query("d13_selectable_tracks", f"{MEASURES}, n AS (SELECT id FROM measures GROUP BY id HAVING count(*) > 16 * 3) SELECT DISTINCT m.id, 'larva_' || m.id AS name, trial, condition, \"group\" FROM measures m JOIN n USING (id)")
def _(spark, d):
    return summary.selectable_tracks(measures(spark, d).withColumn("name", F.concat(F.lit("larva_"), "id")), 3)


_SUMS = """round(avg(midpoint_speed), 6) AS midpoint_speed_mean, round(avg(IS_interval), 6) AS IS_interval_mean, round(avg(CASE WHEN Abs_HC_angle IS NULL OR Abs_HC_angle BETWEEN 20 AND 360 THEN HC_reorientation END), 6) + 0.0 AS HC_reorientation_mean,
round((avg(CASE WHEN odor_orientation = 'towards' THEN run_speed END) - avg(CASE WHEN odor_orientation = 'away' THEN run_speed END)) / nullif(avg(CASE WHEN odor_orientation = 'towards' THEN run_speed END) + avg(CASE WHEN odor_orientation = 'away' THEN run_speed END), 0), 6) + 0.0 AS run_speed_modulation,
round(avg(pref), 6) + 0.0 AS preference, round(-(2 * avg(distance_to_odor) / 85.0 - 1), 6) + 0.0 AS preference_distance_mean, round(avg(odor_speed), 6) + 0.0 AS odor_speed_mean"""
_WHERE = "frame BETWEEN 16 AND 6400 AND distance_to_odor BETWEEN 2 AND 30 AND abs(bearing_angle) BETWEEN 10 AND 170 AND run_direction IN (1, -1)"
_KEPT = ["midpoint_speed_mean", "IS_interval_mean", "HC_reorientation_mean", "run_speed_modulation", "preference", "preference_distance_mean", "odor_speed_mean"]


@query("d23_filtered_bins", f"{_BINS.replace('FROM measures), z', f'FROM measures WHERE {_WHERE}), z').replace('z AS (SELECT min(frame)::DOUBLE AS lo, max(frame)::DOUBLE AS hi FROM measures)', f'r AS (SELECT * FROM measures WHERE {_WHERE}), z AS (SELECT min(frame)::DOUBLE AS lo, max(frame)::DOUBLE AS hi FROM r)').replace('FROM measures m, z', 'FROM r m, z')} SELECT group_condition, bin, {_SUMS} FROM b GROUP BY ALL")
def _(spark, d):
    t = binning.binned_series(measures(spark, d), "frame", 10, seconds=(1, 400), odor=(2, 30), bearing=(10, 170), direction="both")
    return rnd(t.select("group_condition", "bin", *_KEPT))


@query("d24_filtered_bins_by_trial", f"""{_BINS}, u AS (SELECT group_condition, bin, trial, avg(midpoint_speed) AS v, avg(run_speed) AS rs FROM b GROUP BY ALL)
SELECT group_condition, bin, round(avg(v), 6) AS midpoint_speed_mean, round(avg(rs), 6) AS run_speed_mean FROM u GROUP BY ALL""")
def _(spark, d):
    t = binning.binned_series(measures(spark, d), "frame", 10, unit="trial")
    return rnd(t.select("group_condition", "bin", "midpoint_speed_mean", "run_speed_mean"))


@query("d16_limits_without_quantile", f"""{_BINS} SELECT group_condition, bin, round(avg(midpoint_speed), 6) AS middle, round(stddev_samp(midpoint_speed) / sqrt(count(midpoint_speed)), 6) AS error FROM b GROUP BY ALL""")
def _(spark, d):
    # the limits over the quantile, which the tests hold against printed tables
    rows = binning.binned(measures(spark, d), "frame", 10).withColumn("_bin", F.coalesce("bin", F.lit(-1)))
    n = rows.groupBy("group_condition", "_bin").agg(F.count("midpoint_speed").alias("n"))
    t = binning.binned_table(rows, ["ts"]).withColumn("_bin", F.coalesce("bin", F.lit(-1))).join(n, ["group_condition", "_bin"])
    low, high = F.col("midpoint_speed_lowCI"), F.col("midpoint_speed_hiCI")
    return rnd(t.select("group_condition", "bin", F.coalesce((high + low) / 2, "midpoint_speed_mean").alias("middle"), F.try_divide((high - low) / 2, stats.t_quantiles([F.col("n") - 1], 0.975)[0]).alias("error")))


@query("d33_time_bins", f"{MEASURES}, b AS (SELECT id, frame, CASE WHEN frame > 0 AND frame / 16.0 <= 180 THEN CAST(ceil(frame / 160.0) AS INT) END AS bin FROM measures) SELECT id, frame, bin, row_number() OVER (PARTITION BY id, bin ORDER BY frame) AS bin_id FROM b")
def _(spark, d):
    return binning.time_bins(measures(spark, d).select("id", "frame"))


@query("f03_grid_matrix", f"""{MEASURES}, r AS (SELECT bearing_angle AS x, distance_to_odor AS y, area AS z FROM measures WHERE bearing_angle IS NOT NULL AND distance_to_odor IS NOT NULL), r2 AS (SELECT min(x) a, max(x) b, min(y) c, max(y) d FROM r),
h AS (SELECT CAST(least(4, floor((x - a) * 4 / (b - a)) + 1) AS INT) AS xbin, CAST(least(4, floor((y - c) * 4 / (d - c)) + 1) AS INT) AS ybin, avg(z) AS z FROM r, r2 GROUP BY ALL)
SELECT xbin, {', '.join(f'round(max(CASE WHEN ybin = {k} THEN z END), 6) AS "{k}"' for k in range(1, 5))} FROM h GROUP BY xbin""")
def _(spark, d):
    return rnd(binning.as_matrix(binning.heat_map(measures(spark, d), "bearing_angle", "distance_to_odor", "area", 4), 4))


# correlations and distances

_NUMBERS = ("midpoint_speed", "bending_angle", "tail_vel_forward", "area")


@query("g07_strongest_spearman", f"""{MEASURES}, c AS (SELECT {', '.join(_NUMBERS)} FROM measures WHERE {' AND '.join(f'{v} IS NOT NULL' for v in _NUMBERS)}),
x AS (SELECT {', '.join(f'rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS {v}' for v in _NUMBERS)} FROM c),
y AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r, count(*) AS n FROM x" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1:])}) SELECT * FROM y ORDER BY r DESC LIMIT 3""")
def _(spark, d):
    return rnd(stats.strongest(stats.correlations(measures(spark, d), _NUMBERS, "spearman"), 3))


@query("g08_network_edges", f"""{MEASURES}, x AS (SELECT {', '.join(_NUMBERS)} FROM measures WHERE {' AND '.join(f'{v} IS NOT NULL' for v in _NUMBERS)}),
y AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM x" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1:])}) SELECT * FROM y WHERE abs(r) >= 0.005""")
def _(spark, d):
    return stats.network_edges(rnd(stats.correlations(measures(spark, d), _NUMBERS)), 0.005)


@query("g11_shape_score")
def _(spark, d):
    return rnd(learning.shape_score(frames(spark, d).withColumn("spine_length", F.col("width") * F.col("width") + F.col("grey") / 100))[0])


@query("g19_mahalanobis", f"""{MEASURES}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY frame DESC) AS r FROM measures),
k AS (SELECT id, avg(area) AS a, avg(grey) AS b, var_samp(area) AS va, var_samp(grey) AS vb, covar_samp(area, grey) AS c FROM l WHERE r <= 10 GROUP BY id)
SELECT m.id, m.frame, round(sqrt((vb * power(m.area - a, 2) - 2 * c * (m.area - a) * (m.grey - b) + va * power(m.grey - b, 2)) / (va * vb - c * c)), 6) AS distance FROM measures m JOIN k USING (id)""")
def _(spark, d):
    m = measures(spark, d).select("id", "frame", "area", "grey")
    return rnd(stats.mahalanobis(m, m, ["area", "grey"]).select("id", "frame", "distance"))


# links


_GREYS = f"{PIXELS}, l AS (SELECT video, frame, x, y, CAST(grey // 64 AS INT) AS label FROM pixels)"


@query("e06_pixel_links", f"""{_GREYS}, n AS (SELECT video, frame, label AS b, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT q.video, q.frame, p.label AS a, q.label AS b, count(*) AS s FROM l p JOIN l q ON q.video = p.video AND q.frame = p.frame + 1 AND q.x = p.x AND q.y = p.y GROUP BY ALL)
SELECT video, frame, a, b, round(s / n, 6) AS overlap FROM s JOIN n USING (video, frame, b) WHERE s / n > 0.1""")
def _(spark, d):
    return rnd(linking.pixel_links(pixel_table(spark, d).withColumn("label", F.floor(F.col("grey") / 64).cast("int"))))


_EXIT = "CASE WHEN least(l, r) >= rim THEN 0 WHEN l <= r THEN -1 ELSE -2 END"


@query("h03_exit_codes", f"""{OBJECTS} SELECT video, frame, label, {_EXIT} AS code FROM (SELECT video, frame, label, sqrt(power(cx - 420, 2) + power(cy - 400, 2)) AS l, sqrt(power(cx - 380, 2) + power(cy - 400, 2)) AS r, 600 - sqrt(cx * cx + cy * cy) AS rim FROM objects)""")
def _(spark, d):
    return objects(spark, d).select("video", "frame", "label", linking.exit_code(F.col("cx"), F.col("cy"), 600.0, (420.0, 400.0), (380.0, 400.0)).alias("code"))


@query("h04_rim_guard", f"""{OBJECTS}, q AS (SELECT c.*, (c.a % 7) / 8.0 AS of_a, (c.b % 5) / 4.0 AS of_b FROM classed c)
SELECT p.video, p.frame, p.a, p.b, p.kind, CASE WHEN p.kind = '1->1' AND power(o.cx - 400, 2) + power(o.cy - 400, 2) > power(0.95 * 100, 2) THEN CASE WHEN of_b - of_a > 0.3 THEN 'split' WHEN of_b - of_a < -0.3 THEN 'merge' END END AS rim
FROM q p LEFT JOIN objects o ON o.video = p.video AND o.frame = p.frame AND o.label = p.b""")
def _(spark, d):
    o = objects(spark, d)
    c = linking.classified(o, linking.box_links(o))
    shares = c.where("a IS NOT NULL AND b IS NOT NULL").select("video", "frame", "a", "b", (F.col("a") % 7 / 8.0).alias("of_a"), (F.col("b") % 5 / 4.0).alias("of_b"))
    return linking.rim_guarded(c, o, shares, 100.0, (400.0, 400.0))


@query("h07_matches", f"""{OBJECTS} SELECT a.video, a.frame, a.label AS a, b.label AS b, abs(a.cx - b.cx) < (1.05::DOUBLE - 1) * 40 AND abs(a.cy - b.cy) < (1.05::DOUBLE - 1) * 40 AS centre, b.perimeter > 0.7 * a.perimeter AND b.perimeter < 1.3 * a.perimeter AS size
FROM (SELECT objects.*, f.perimeter FROM objects JOIN frames f ON f.trial = video AND f.frame = objects.frame AND f.id = label) a JOIN (SELECT objects.*, f.perimeter FROM objects JOIN frames f ON f.trial = video AND f.frame = objects.frame AND f.id = label) b ON a.video = b.video AND a.frame + 1 = b.frame AND a.label = b.label""")
def _(spark, d):
    o = objects(spark, d)
    n = o.select("video", (F.col("frame") - 1).alias("frame"), "label", *[F.col(c).alias(f"n_{c}") for c in ("cx", "cy", "perimeter")])
    both = o.join(n, ["video", "frame", "label"])
    centre = linking.centre_match(F.col("cx"), F.col("cy"), F.col("n_cx"), F.col("n_cy"))
    return both.select("video", "frame", F.col("label").alias("a"), F.col("label").alias("b"), centre.alias("centre"), linking.size_match(F.col("perimeter"), F.col("n_perimeter")).alias("size"))


@query("h09_speed_gate", f"{MEASURES} SELECT id, frame, midpoint_speed - coalesce(avg(midpoint_speed) OVER (PARTITION BY id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) < 1.0 * (1 - (0.25 - 1 / (frame % 5 + 3.0))) AS fine FROM measures")
def _(spark, d):
    m = measures(spark, d).withColumn("gap", F.col("frame") % 5)
    return m.select("id", "frame", collisions.speed_gate(m, "midpoint_speed", 1.0).alias("fine"))


@query("h11_round_shapes", f"{FRAMES} SELECT id, frame, perimeter / 9 < 3.55 AND width / 2 BETWEEN 0.001 AND 3.35 AND width / perimeter BETWEEN 0.001 AND 0.42 AS round FROM frames")
def _(spark, d):
    rule = collisions.round_shape(roundness=F.col("perimeter") / 9, length_width=F.col("width") / 2, length_perimeter=F.col("width") / F.col("perimeter"))
    return frames(spark, d).select("id", "frame", rule.alias("round"))


_DISTANCE = lambda a, b: f"sqrt(power(x{a} - x{b}, 2) + power(y{a} - y{b}, 2))"
_FOUR = ", ".join(f"spinepoint_{c}_{k} AS {c}{n}" for n, k in ((1, 1), (2, 2), (3, 9), (4, 11)) for c in "xy")


@query("h21_end_pairs", f"{FRAMES}, f AS (SELECT id, frame, {_FOUR} FROM frames) SELECT id, frame, {_DISTANCE(1, 3)} + {_DISTANCE(2, 4)} <= {_DISTANCE(1, 4)} + {_DISTANCE(2, 3)} AS straight FROM f")
def _(spark, d):
    names = {"in1": 1, "in2": 2, "out1": 9, "out2": 11}
    rows = frames(spark, d).select("id", "frame", *[F.col(f"spinepoint_{c}_{k}").alias(f"{c}_{n}") for n, k in names.items() for c in "xy"])
    return collisions.end_point_pairing(rows).select("id", "frame", "straight")


@query("h21_partition_errors", """WITH x AS (SELECT o_custkey AS candidate, o_orderkey % 3 AS part, o_orderkey % 500 AS expected FROM orders), p AS (SELECT candidate, part, sum(expected) AS s FROM x GROUP BY ALL)
SELECT candidate, CAST(sum(abs(100 * part - s)) AS BIGINT) AS error FROM p GROUP BY ALL""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    x = o.select(F.col("o_custkey").alias("candidate"), (F.col("o_orderkey") % 3).alias("part"), (100 * (F.col("o_orderkey") % 3)).alias("area"), (F.col("o_orderkey") % 500).alias("expected"))
    return collisions.partition_error(x)


@query("h32_joint_angles", f"{FRAMES} SELECT id, frame, round(r - 360 * floor(r / 360), 5) + 0.0 AS a FROM (SELECT id, frame, {angle('spinepoint_x_1 - spinepoint_x_6', 'spinepoint_y_1 - spinepoint_y_6', 'spinepoint_x_12 - spinepoint_x_6', 'spinepoint_y_12 - spinepoint_y_6')} AS r FROM frames)")
def _(spark, d):
    a = g.joint_angles([(f"spinepoint_x_{k}", f"spinepoint_y_{k}") for k in (1, 6, 12)])[0]
    return rnd(frames(spark, d).select("id", "frame", a.alias("a")), digits=5)


@query("h33_spine_distances", f"{FRAMES}, f AS (SELECT id, frame, {_FOUR} FROM frames) SELECT id, frame, round(least({_DISTANCE(1, 3)} + {_DISTANCE(2, 4)}, {_DISTANCE(1, 4)} + {_DISTANCE(2, 3)}), 6) AS d FROM f")
def _(spark, d):
    p = lambda k: (f"spinepoint_x_{k}", f"spinepoint_y_{k}")
    return rnd(frames(spark, d).select("id", "frame", g.polyline_distance([p(1), p(2)], [p(9), p(11)]).alias("d")))


# identities

_GRAPH = """SELECT DISTINCT o_orderkey // 200 AS video, o_orderkey % 40 AS parent, o_orderkey % 40 + 1 + o_custkey % 5 AS child FROM orders"""


@query("h19_end_objects", f"""WITH RECURSIVE e AS ({_GRAPH}), b AS (SELECT DISTINCT video, parent AS track FROM e WHERE parent % 3 <> 0),
r AS (SELECT b.video, b.track, e.child AS node FROM b JOIN e ON e.video = b.video AND e.parent = b.track UNION
      SELECT r.video, r.track, e.child FROM r JOIN b ON b.video = r.video AND b.track = r.node JOIN e ON e.video = r.video AND e.parent = r.node)
SELECT video, track, node AS single FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.video = r.video AND b.track = r.node)""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    e = o.select(F.expr("o_orderkey div 200").alias("video"), (F.col("o_orderkey") % 40).alias("parent"), (F.col("o_orderkey") % 40 + 1 + F.col("o_custkey") % 5).alias("child")).distinct()
    sizes = e.select("video", F.col("parent").alias("track")).distinct().withColumn("size", F.when(F.col("track") % 3 != 0, 2).otherwise(1))
    return collisions.end_objects(sizes, e)


_STAR = """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 2 THEN c_custkey - c_custkey % 5 + 2 WHEN c_custkey % 5 = 2 THEN c_custkey + 1 END AS new1, CASE WHEN c_custkey % 5 = 2 THEN c_custkey + 2 END AS new2, CAST(NULL AS BIGINT) AS new3,
CASE WHEN c_custkey % 5 = 2 THEN 2 ELSE 1 END AS bundle FROM customer)"""


def _stars(spark: SparkSession, d: str) -> DataFrame:
    """Five customers in turn are two that meet, their bundle, and the two that leave it."""
    k, none = F.col("c_custkey"), F.lit(None).cast("long")
    new1 = F.when(k % 5 < 2, k - k % 5 + 2).when(k % 5 == 2, k + 1)
    return spark.read.parquet(f"{d}/customer.parquet").select(k.cast("long").alias("id"), new1.cast("long").alias("new1"), F.when(k % 5 == 2, k + 2).cast("long").alias("new2"), none.alias("new3"), F.when(k % 5 == 2, 2).otherwise(1).alias("bundle"))


@query("e09_collision_stars", f"""{_STAR}, i AS (SELECT new1 AS collision, list(id ORDER BY id) AS ids FROM c WHERE new1 IS NOT NULL GROUP BY 1), n AS (SELECT id AS collision, unnest([new1, new2]) AS o FROM c), x AS (SELECT collision, list(o ORDER BY o) AS ids FROM n JOIN c ON c.id = o GROUP BY 1)
SELECT c.id AS collision, bundle, array_to_string(i.ids, ',') AS incoming, array_to_string(x.ids, ',') AS outgoing FROM c JOIN i ON i.collision = c.id JOIN x ON x.collision = c.id""")
def _(spark, d):
    ids = lambda c: F.array_join(F.transform(c, lambda r: r["id"].cast("string")), ",")
    return collisions.collision_stars(_stars(spark, d)).select("collision", "bundle", ids("incoming").alias("incoming"), ids("outgoing").alias("outgoing"))


_ROWS = """o AS (SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS frame, o_orderkey % 1000 / 8.0 + CASE WHEN o_custkey % 5 IN (1, 4) THEN 200 ELSE 0 END AS v FROM orders)"""


def _order_tracks(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the rows of a track; the second and the fifth of five have values of their own."""
    from pyspark.sql import Window

    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_custkey")
    frame = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(k.cast("long").alias("id"), frame.alias("frame"), (F.col("o_orderkey") % 1000 / 8.0 + F.when((k % 5).isin(1, 4), 200).otherwise(0)).alias("v"))


@query("h26_collision_samples", f"""{_STAR}, {_ROWS}, m AS (SELECT id - id % 5 + 2 AS collision, id, CASE id % 5 WHEN 0 THEN 'in1' WHEN 1 THEN 'in2' WHEN 3 THEN 'out1' ELSE 'out2' END AS role FROM c WHERE id % 5 <> 2),
w AS (SELECT collision FROM m GROUP BY 1 HAVING count(*) = 4 AND count(CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.id = collision) THEN 1 END) = 4),
r AS (SELECT m.collision, role, o.id, frame, v AS value, count(*) OVER (PARTITION BY m.collision, role) AS n, row_number() OVER (PARTITION BY m.collision, role ORDER BY CASE WHEN role LIKE 'in%' THEN -frame ELSE frame END) AS k FROM m JOIN w USING (collision) JOIN o ON o.id = m.id),
q AS (SELECT *, min(n) OVER (PARTITION BY collision) AS least FROM r), z AS (SELECT collision FROM r GROUP BY 1 HAVING count(DISTINCT role) = 4)
SELECT collision, role, id, frame, value FROM q JOIN z USING (collision) WHERE least >= 3 AND k <= least(7, least)""")
def _(spark, d):
    return collisions.collision_samples(_order_tracks(spark, d), _stars(spark, d), 2, "v", 3, 7)


@query("h26_assignments")
def _(spark, d):
    s = collisions.collision_samples(_order_tracks(spark, d), _stars(spark, d), 2, "v")
    two = collisions.resolve_two(s, forced=True)
    outs = F.when(F.col("straight"), F.array(F.lit("out1"), F.lit("out2"))).otherwise(F.array(F.lit("out2"), F.lit("out1")))
    pairs = two.select("collision", "forced", F.posexplode(outs).alias("k", "outgoing")).withColumn("incoming", F.concat(F.lit("in"), (F.col("k") + 1).cast("string")))
    return collisions.assignments_of(s, pairs, "2x2")


@query("h27_three_by_three")
def _(spark, d):
    # every 90 frames of a pair of animals, in six stretches with shifts of their own, are a collision
    m = measures(spark, d).where("midpoint_speed IS NOT NULL")
    part = F.floor(F.col("frame") % 90 / 15).cast("int")
    role = F.concat(F.when(part < 3, "in").otherwise("out"), (part % 3 + 1).cast("string"))
    collision = F.concat_ws("-", "id", F.floor(F.col("frame") / 90))
    s = m.select(collision.alias("collision"), role.alias("role"), (F.col("midpoint_speed") + 10 * (part % 3)).alias("value"))
    return rnd(collisions.resolve_three(s), digits=9)


@query("h22_counters", f"""{MEASURES}, r AS (SELECT id, frame, CASE WHEN frame % 3 = 0 THEN NULL ELSE frame % 2 = 0 END AS straight FROM measures) SELECT count(*) AS collisions, count(straight) AS resolved, count(*) - count(straight) AS open FROM r""")
def _(spark, d):
    r = measures(spark, d).select(F.when(F.col("frame") % 3 != 0, F.col("frame") % 2 == 0).alias("straight"))
    return collisions.counters(r)


@query("h24_location_check", f"""{MEASURES}, r AS (SELECT id, frame, midpoint_speed AS x, spinepoint_y_6_conv AS y FROM measures WHERE midpoint_speed IS NOT NULL AND spinepoint_y_6_conv IS NOT NULL), f AS (SELECT id, arg_min(x, frame) AS x, arg_min(y, frame) AS y FROM r GROUP BY id)
SELECT id, CAST(id % 2 - 1 AS INT) AS code, CASE WHEN id % 2 = 1 THEN x * x + y * y > 20 ELSE (x - 1) * (x - 1) + (y - 2) * (y - 2) < 40 END AS fine FROM f""")
def _(spark, d):
    m = measures(spark, d).where("midpoint_speed IS NOT NULL AND spinepoint_y_6_conv IS NOT NULL")
    r = m.select("id", "frame", F.col("midpoint_speed").alias("centroid_x"), F.col("spinepoint_y_6_conv").alias("centroid_y"), (F.col("id") % 2 - 1).cast("int").alias("code"))
    return collisions.location_checked(r, True, 20.0, 40.0, (1.0, 2.0))


@query("h29_merged_tracks", f"""{MEASURES}, x AS (SELECT CASE WHEN id = 0 THEN 1 ELSE id END AS id, CASE WHEN id = 1 THEN frame + 100000 ELSE frame END AS frame, area FROM measures),
z AS (SELECT id, frame, lead(frame) OVER (PARTITION BY id ORDER BY frame) AS n FROM x) SELECT id, frame, area FROM x UNION ALL SELECT id, unnest(range(frame + 1, n)) AS frame, NULL FROM z WHERE n > frame + 1""")
def _(spark, d):
    m = measures(spark, d).select("id", "frame", "area")
    m = m.withColumn("frame", F.when(F.col("id") == 1, F.col("frame") + 100_000).otherwise(F.col("frame")))
    one = spark.range(1).select(F.lit(0).alias("incoming"), F.lit(1).alias("outgoing"))
    return collisions.merged_tracks(m, one)


# orientation and track files

_ENDS = """d AS (SELECT id, frame, collision_flag, spinepoint_x_12 AS head_x, spinepoint_y_12 AS head_y, spinepoint_x_1 AS tail_x, spinepoint_y_1 AS tail_y, spinepoint_x_6 AS mid_x, spinepoint_y_6 AS mid_y, grey AS head_grey, area * 10 AS tail_grey FROM frames)"""


def _ends(spark: SparkSession, d: str) -> DataFrame:
    names = {"head": 12, "tail": 1, "mid": 6}
    points = [F.col(f"spinepoint_{c}_{k}").alias(f"{n}_{c}") for n, k in names.items() for c in "xy"]
    return frames(spark, d).select("id", "frame", "collision_flag", *points, F.col("grey").alias("head_grey"), (F.col("area") * 10).alias("tail_grey"))


_SEGMENTS = f"""{FRAMES}, {_ENDS}, f AS (SELECT *, collision_flag <> 0 AS flag FROM d), i AS (SELECT *, flag OR (coalesce(lag(flag) OVER t, false) AND coalesce(lead(flag) OVER t, false)) AS inside FROM f WINDOW t AS (PARTITION BY id ORDER BY frame)),
b AS (SELECT *, CAST(inside <> coalesce(lag(inside) OVER t, false) AS INT) AS brk FROM i WINDOW t AS (PARTITION BY id ORDER BY frame)),
seg AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM b)"""
_SMOOTH = ", ".join(f"avg({c}) OVER w AS s_{c}" for c in ("head_x", "head_y", "tail_x", "tail_y", "mid_x", "mid_y"))


def _far(a: str, b: str) -> str:
    return f"sqrt(power(s_{a}_x - lag(s_{b}_x, 2) OVER g, 2) + power(s_{a}_y - lag(s_{b}_y, 2) OVER g, 2))"


@query("h14_head_tail_votes", f"""{_SEGMENTS}, m AS (SELECT *, {_SMOOTH} FROM seg WINDOW w AS (PARTITION BY id ORDER BY frame ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)),
far AS (SELECT *, {_far('mid', 'head')} AS h1, {_far('mid', 'tail')} AS t1, {_far('head', 'head')} AS h3, {_far('tail', 'tail')} AS t3 FROM m WINDOW g AS (PARTITION BY id, segment ORDER BY frame)),
v AS (SELECT id, segment, count(*) AS n, {', '.join(f'coalesce(sum(CASE WHEN {c} > 0 AND {c} < 100 THEN {c} END), 0) AS {c}' for c in ('h1', 't1', 'h3', 't3'))}, sum(head_grey) AS h2, sum(tail_grey) AS t2 FROM far GROUP BY ALL)
SELECT id, CAST(segment AS BIGINT) AS segment, n AS rows, CAST(CASE WHEN h1 < t1 THEN 1 ELSE -1 END + CASE WHEN n > 1 THEN CASE WHEN h2 < t2 THEN 1 ELSE -1 END ELSE 0 END + CASE WHEN h3 <> 0 AND t3 <> 0 AND n > 1 THEN CASE WHEN h3 > t3 THEN 1 ELSE -1 END ELSE 0 END AS INT) AS votes FROM v""")
def _(spark, d):
    return orientation.head_tail_votes(_ends(spark, d)).withColumn("segment", F.col("segment").cast("long"))


@query("a13_track_rows", f"""{FRAMES} SELECT id, frame, round(CASE WHEN frame % 3 = 0 THEN spinepoint_x_12 ELSE spinepoint_x_1 END * 0.5 - 5, 6) AS first_x, round(5 - CASE WHEN frame % 3 = 0 THEN spinepoint_y_1 ELSE spinepoint_y_12 END * 0.5, 6) AS last_y,
round((spinepoint_y_6 - 10) * 0.5, 6) + 0.0 AS centroid_y, perimeter * 0.5 AS perimeter, CASE WHEN frame % 5 = 4 THEN 1 ELSE collision_flag END AS collision_flag FROM frames""".replace("round(CASE", "round(CASE WHEN frame % 5 = 4 THEN NULL ELSE 1 END * CASE").replace("round(5 - CASE", "round(5 - CASE WHEN frame % 5 = 4 THEN NULL ELSE 1 END * CASE"))
def _(spark, d):
    point = lambda k: F.struct(F.col(f"spinepoint_x_{k}").alias("x"), F.col(f"spinepoint_y_{k}").alias("y"))
    f = frames(spark, d)
    spine = F.array(*[point(k) for k in (1, 1, 2, 2, 5, 5, 6, 6, 9, 9, 11, 12)])
    turned = F.col("frame") % 3 == 0
    end = lambda c: F.when(F.col("frame") % 5 == 4, F.lit(1e6)).when(turned, F.col(f"spinepoint_{c}_12")).otherwise(F.col(f"spinepoint_{c}_1"))
    o = f.withColumns({"spine": spine, "pairs": F.array_repeat(F.struct(point(5).alias("a"), point(9).alias("b")), 10), "tail_x": end("x"), "tail_y": end("y"), "centroid_x": F.col("spinepoint_x_6"), "centroid_y": F.col("spinepoint_y_6"), "blob_orient": F.lit(0.0), "spine_length": F.lit(4.0)})
    t = tracks.track_rows(o, (10.0, 10.0), 0.5)
    return rnd(t.select("id", "frame", F.col("spinepoint_x_1").alias("first_x"), F.col("spinepoint_y_12").alias("last_y"), "centroid_y", "perimeter", "collision_flag"))


@query("a11_run_counts", f"{OBJECTS} SELECT video, count(DISTINCT frame) AS frames, count(*) AS blobs, CAST(96 AS DOUBLE) AS mean_area FROM objects GROUP BY video")
def _(spark, d):
    return detections.run_counts(objects(spark, d).withColumnRenamed("frame", "frame_index"), ["video"])


@query("a12_long_tracks", f"{MEASURES}, x AS (SELECT CASE WHEN id = 1 THEN 2 ELSE id END AS id, frame FROM measures), n AS (SELECT id FROM x GROUP BY 1 HAVING count(*) > 120) SELECT id, count(*) AS n FROM x JOIN n USING (id) GROUP BY 1")
def _(spark, d):
    remap = spark.range(1).select(F.lit(1).alias("old"), F.lit(2).alias("new"))
    return tracks.long_tracks(measures(spark, d), 120, remap).groupBy("id").agg(F.count("*").alias("n"))
