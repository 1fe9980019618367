"""Planted head casts, steps and turns, and row loops that the window operators must equal."""

import math

import pytest
from motiontab.functions import windows as w
from motiontab.operators import binning, events, kinematics, stats, summary
from pyspark.sql import functions as F

COLUMNS = "id int, frame int, head_vector_angular_speed double, tail_vector_angular_speed double, bending_angle double, heading_angle double"


def track(spark, speeds, bends=None, tails=None, id_=1):
    n = len(speeds)
    rows = [(id_, k, speeds[k], (tails or [0.0] * n)[k], (bends or [0.0] * n)[k], 10.0) for k in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def test_planted_head_cast(spark):
    speeds = [0.0, 1.0, 50.0, 90.0, 40.0, 0.0, None, -60.0, 0.0, 0.0]
    bends = [0.0, 0.0, 10.0, 20.0, 30.0, 0.0, 0.0, 40.0, 0.0, 0.0]
    out = events.with_head_casts(track(spark, speeds, bends), 35.0, 45.0, 20.0).orderBy("frame").collect()
    assert [r.HCs for r in out] == [0, 0, 0, 0, 1, 0, 0, 0, 1, 0]  # the row after the fastest
    assert [r.HC_flag for r in out] == [0, 1, 1, 1, 1, 0, 1, 1, 0, 0]  # from the row before the island
    assert out[4].HC_angle == 30.0 and out[8].Abs_HC_angle == 40.0 and out[4].HC_reorientation == 0.0
    assert [r.HCs_left for r in out] == [0, 1, 1, 1, 1, 0, 0, 0, 0, 0] and out[7].HCs_right == 1


def test_rejected_casts_flag_fast_rows_and_first_row_starts_none(spark):
    out = events.with_head_casts(track(spark, [99.0, 0.0, 50.0, 0.0, 0.0], tails=[90.0] * 5), 35.0, 45.0, 20.0).orderBy("frame").collect()
    assert [r.HC_flag for r in out] == [0, 0, 1, 0, 0] and not any(r.HCs for r in out)
    quiet = events.with_head_casts(track(spark, [0.0, None, 1.0])).collect()
    assert not any(r.HC_flag or r.HCs for r in quiet) and all(r.HC_angle is None for r in quiet)


def steps_frame(spark, v, run=None):
    rows = [(1, k, x, True if run is None else run[k], 1.0, 0.0, float(k), float(k) / 4, 2.0, 1.0) for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "id int, frame int, tail_vel_forward double, run_flag boolean, tail_vector_x double, tail_vector_y double, heading_angle double, midpoint_distance double, midpoint_speed double, spine_length double")


def test_steps_of_a_wave(spark):
    v = [1.0 + math.sin(k * math.pi / 4) for k in range(50)]
    out = events.with_steps(steps_frame(spark, v)).orderBy("frame").collect()
    peaks = [k - 1 for k in range(1, 49) if v[k] > v[k - 1] and v[k] > v[k + 1] and v[k - 1] >= 0.6]
    ends = [k for k, r in enumerate(out) if r.step_boolean]
    assert ends == peaks[1:] and {r.run_direction for r in out} == {1}
    starts = [r for r in out if r.IS_interval is not None]
    assert [r.frame for r in starts] == peaks[:-1] and {r.IS_interval for r in starts} == {0.5} and {r.run_speed for r in starts} == {2.0}
    assert {r.IS_distance for r in starts} == {2.0} and {r.minima for r in starts} == {"1"} and not any(r.gt_1min for r in starts)


def test_few_steps_are_none(spark):
    v = [0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    out = events.with_steps(steps_frame(spark, v)).collect()
    assert not any(r.step_boolean for r in out) and all(r.run_direction is None and r.IS_angle is None for r in out)


def test_backward_candidates(spark):
    out = events.with_step_candidates(steps_frame(spark, [0.0, -1.0, -0.5, -0.2, 0.0, None, 3.0, -2.0, 1.0, 1.0, 1.0])).orderBy("frame").collect()
    assert [r.step_backward for r in out] == [False] * 11 or out[0].step_backward is False
    again = events.with_step_candidates(steps_frame(spark, [-0.5, -1.0, -0.6, -0.2, 0.0, 0.0])).orderBy("frame").collect()
    assert [r.frame for r in again if r.step_backward] == [0]


def test_flanks_and_switches(spark):
    v = [-1.0] * 120 + [1.0] * 120
    df = spark.createDataFrame([(1, k, x, x) for k, x in enumerate(v)], "id int, frame int, tail_vel_forward_bl double, tail_vel_forward double")
    out = events.with_flanks(df, 4, 5, 5).orderBy("frame").collect()
    assert [r.flanks for r in out].count(1) == 1 and -1 not in [r.flanks for r in out]
    assert 110 < [r.flanks for r in out].index(1) < 130
    turns = events.with_switching_points(df, 4, 10).where("back_to_for").collect()
    assert len(turns) <= 1


@pytest.mark.parametrize("n", [5, 6])
def test_centred_windows_equal_a_loop(spark, n):
    x = [1.0, 2.0, None, 4.0, 5.0, 7.0, 11.0, 13.0, 1.0, 0.0, 3.0, 8.0]
    df = spark.createDataFrame([(1, 3 * k, v) for k, v in enumerate(x)], "id int, frame int, x double")
    out = [r.m for r in df.repartition(3).select("frame", w.centred("x", n).alias("m")).orderBy("frame").collect()]
    for k, m in enumerate(out):
        part = x[k - (n - 1 - n // 2) : k + n // 2 + 1] if k - (n - 1 - n // 2) >= 0 else []
        assert m == (sum(part) / n if len(part) == n and None not in part else None)


def test_rigid_motion_leaves_bending(spark):
    rows = []
    for id_, (turn, dx) in enumerate(((0.0, 0.0), (0.7, 30.0))):
        for k in range(60):
            points = [(j * math.cos(k / 9) + k / 3, j * math.sin(k / 9) + 0.02 * (j - 6) ** 2) for j in range(1, 13)]
            moved = [(x * math.cos(turn) - y * math.sin(turn) + dx, x * math.sin(turn) + y * math.cos(turn)) for x, y in points]
            rows.append((id_, k, 0.0, 0.0, 0, *[c for p in moved for c in p]))
    spine = ", ".join(f"spinepoint_x_{k} double, spinepoint_y_{k} double" for k in range(1, 13))
    df = spark.createDataFrame(rows, f"id int, frame int, odor_a_x double, odor_a_y double, collision_flag int, {spine}")
    out = kinematics.analysed(df)
    a, b = ({r.frame: r for r in out.where(f"id = {i}").collect()} for i in (0, 1))
    assert len(a) == 60
    for k in range(60):
        for c in ("bending_angle", "midpoint_speed", "tail_vector_angular_speed", "spine_length"):
            x, y = a[k][c], b[k][c]
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6)
    assert a[59].head_vector_angular_speed is None and a[20].bending_angle is not None
    assert kinematics.analysed(df.where("frame < 32")).count() == 0  # 32 rows are too few at 16 frames a second


def test_masking_keeps_absolute_angles(spark):
    df = spark.createDataFrame([(1, 0, 1, 2.0, -3.0, 3.0), (1, 1, 0, 2.0, -3.0, 3.0), (1, 2, None, 2.0, -3.0, 3.0)], "id int, frame int, collision_flag int, midpoint_speed double, bending_angle double, abs_bending_angle double")
    out = {r.frame: r for r in kinematics.masked(df).collect()}
    assert out[0].midpoint_speed is None and out[0].bending_angle is None and out[0].abs_bending_angle == 3.0
    assert out[1].bending_angle == -3.0 and out[2].bending_angle == -3.0


def test_bins_and_modulations(spark):
    df = spark.createDataFrame([(float(k),) for k in range(11)] + [(None,)], "x double")
    got = sorted(((r.x, r.bin, r.midpoint) for r in binning.binned(df, "x", 4.0).collect() if r.x is not None))
    assert got[0] == (0.0, None, None) and got[1] == (1.0, 1, 2.0) and got[4] == (4.0, 1, 2.0) and got[5] == (5.0, 2, 6.0) and got[9] == (9.0, None, None)
    assert binning.empty_bins(binning.binned(df, "x", 4.0)) == 0
    rows = spark.createDataFrame([("G", 1, 0.5, s, 25.0, h) for s, h in (("towards", 1), ("towards", 1), ("away", 1), ("away", 0))], "group_condition string, bin int, midpoint double, odor_orientation string, Abs_HC_angle double, HCs int")
    there = rows.groupBy("bin").agg(*binning.extras("hc")).first().HC_rate_modulation
    here = rows.withColumns({"HC_angle": F.lit(1.0), "HC_reorientation": F.lit(1.0)}).groupBy("bin").agg(*summary.head_casts()).first().HC_rate_modulation
    assert abs(there - 1 / 3) < 1e-12 and abs(here + 1 / 3) < 1e-12  # opposite signs in the two tables


def test_direction_filter_and_missing_groups(spark):
    df = spark.createDataFrame([(1,), (-1,), (0,), (None,)], "run_direction int")
    assert [df.where(summary.direction_test(d)).count() for d in ("forwards", "backwards", "both", "none", None)] == [1, 1, 2, 4, 4]


def test_rank_sums_and_correlations(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0), ("c", None)], "group_condition string, v double")
    got = {(r.a, r.b): (r.w, r.p) for r in stats.rank_sum_tests(df, ["v"]).collect()}
    assert got["a", "b"][0] == 0 and abs(got["a", "b"][1] - 0.1) < 1e-12
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0), (4.0, None)], "x double, y double")
    assert abs(stats.correlations(pairs, ["x", "y"], "spearman").first().r - 1.0) < 1e-12
    assert stats.significance(stats.correlations(pairs, ["x", "y"])).first().p < 0.2
    assert stats.correlations(pairs.withColumn("y", F.lit(1.0)), ["x", "y"]).first().r is None
