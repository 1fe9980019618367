"""Operators that feed tables: files written and read back, names of catalogues, groups of variables, small statistics."""

import math
import random

import pytest
from motiontab.operators import binning, collisions, learning, orientation, stats, summary
from motiontab.sources import detections, tracks
from pyspark.sql import functions as F


def test_metadata_round_trip(spark, tmp_path):
    rows = [("G 1", "C=1", "T/1".replace("/", "-"), {"FPS": "16", "OdorALocation": "9, 9", "b": "x=y"}, 1.5, -2.0), ("G2", "C", "T", {}, 0.0, 0.0)]
    meta = spark.createDataFrame(rows, "`group` string, condition string, trial string, pairs map<string,string>, odor_a_x double, odor_a_y double")
    tracks.write_metadata(meta, str(tmp_path / "m"))
    back = {r.group: r for r in tracks.read_metadata(spark, str(tmp_path / "m")).collect()}
    first = back["G 1"]
    assert (first.condition, first.trial, first.odor_a_x, first.odor_a_y) == ("C=1", "T-1", 1.5, -2.0)
    assert first.pairs == {"FPS": "16", "OdorALocation": "1.5,-2.0", "b": "x=y"} and (back["G2"].odor_a_x, set(back["G2"].pairs)) == (0.0, {"OdorALocation"})


def test_many_files_are_numbered_as_few(spark):
    listing = spark.createDataFrame([(f"p{k % 97:03}/{k}",) for k in range(500)], "path string").repartition(5)
    assert sorted(map(tuple, tracks.numbered(listing, True).collect())) == sorted(map(tuple, tracks.numbered(listing, False).collect()))


def test_model_rows_and_written_tables(spark, tmp_path):
    t = spark.createDataFrame([(1, 0, 2.5, 0)], "id int, frame int, area double, collision_flag int")
    out = tracks.model_rows(t, spark.createDataFrame([(1, 1)], "id int, frame int")).orderBy("frame").collect()
    assert [(r.frame, r.area, r.collision_flag) for r in out] == [(0, 2.5, 0), (1, None, 2)]
    tracks.write_collisions(spark.createDataFrame([(1, 3, None, None, 0, 1)], "id int, new1 int, new2 int, new3 int, origin int, bundle int"), str(tmp_path / "c"))
    r = tracks.read_table(spark, str(tmp_path / "c")).first()
    assert (r.id, r.new1, r.new2, r.origin, r.bundle) == (1, 3, None, 0, 1)
    tracks.write_assignments(spark.createDataFrame([(1, 2, "2x2", 7, 0)], "incoming int, outgoing int, type string, duration int, forced int"), str(tmp_path / "a"))
    assert tuple(tracks.read_table(spark, str(tmp_path / "a")).first()) == (1, 2, "2x2", 7, 0)
    d = spark.createDataFrame([("v", 0, 1, 5, 1.0, 2.0, 0, 0, 2, 2), ("v", 3, 1, 7, 1.0, 2.0, 0, 0, 2, 2)], "video string, frame_index int, label int, area int, cx double, cy double, x int, y int, width int, height int")
    assert tuple(detections.run_counts(d, ["video"]).first()) == ("v", 2, 2, 6.0)


def test_catalogued(spark):
    table = spark.createDataFrame([(1, 5.0, 99.0, 1.0)], "id int, speed double, far double, unnamed double")
    names = spark.createDataFrame([("speed", "Speed", "mm/s", 0.0, 9.0), ("far", "Distance", "mm", None, 50.0), ("absent", "None", "", None, None)], "variable string, name string, unit string, `min` double, `max` double")
    rows = {r.variable: (r.name, r.unit, r.value) for r in tracks.catalogued(table, names, ["id"]).collect()}
    assert rows == {"speed": ("Speed", "mm/s", 5.0), "far": ("Distance", "mm", None)}


def test_small_table_operators(spark):
    g = summary.with_group_condition(spark.createDataFrame([("A", "x"), ("B", None)], "`group` string, condition string")).collect()
    assert [r.group_condition for r in g] == ["A-x", "B"]
    bins = spark.createDataFrame([("A-x", k, float(k)) for k in range(1, 7)], "group_condition string, bin int, v double")
    around = {r.bin: r.smooth for r in binning.circular_mean_of_bins(bins, "v", 6, 3, circular=True).collect()}
    assert around == {1: 3.0, 2: 2.0, 3: 3.0, 4: 4.0, 5: 5.0, 6: 4.0}
    flat = {r.bin: r.smooth for r in binning.circular_mean_of_bins(bins, "v", 6, 3).collect()}
    assert flat[1] is None and flat[6] is None and flat[2] == 2.0
    with pytest.raises(ValueError, match="empty"):
        binning.checked(spark.createDataFrame([(1,), (3,)], "bin int"))


def test_density_integrates_to_one_and_peaks_at_the_mode(spark):
    pick = random.Random(1)
    df = spark.createDataFrame([(1, pick.gauss(5, 1)) for _ in range(3000)], "id int, v double")
    rows = sorted((r.at, r.density) for r in binning.density(df, "v", points=64).collect())
    step = rows[1][0] - rows[0][0]
    assert abs(sum(d for _, d in rows) * step - 1) < 0.03 and abs(max(rows, key=lambda r: r[1])[0] - 5) < 0.5
    peak = 1 / math.sqrt(2 * math.pi)
    assert abs(max(d for _, d in rows) - peak) < 0.15 * peak


def test_groups_of_variables(spark):
    """Three planted groups are found, with the number chosen by silhouettes; members of a group lie close in the plane."""
    pick, rows = random.Random(2), []
    for _ in range(400):
        base = [pick.gauss(0, 1) for _ in range(3)]
        rows.append(tuple(base[k % 3] * (-1 if k == 7 else 1) + pick.gauss(0, 0.2) for k in range(9)))
    names = [f"v{k}" for k in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    for linkage in learning.LINKAGES:
        out = {r.variable: r for r in learning.variable_groups(df, names, absolute=True, linkage=linkage).collect()}
        assert [out[n].cluster for n in names] == [1, 2, 3] * 3 and all(r.silhouette > 0.8 for r in out.values())
        far = lambda a, b, out=out: math.dist((out[a].x, out[a].y), (out[b].x, out[b].y))
        assert max(far("v0", "v3"), far("v1", "v4"), far("v2", "v5")) < 0.5 < min(far("v0", "v1"), far("v1", "v2"))
    assert {r.cluster for r in learning.variable_groups(df, names, k=4).collect()} == {1, 2, 3, 4}
    two = learning.variable_groups(df, ["v0", "v1"]).collect()
    assert [(r.cluster, r.silhouette) for r in two] == [(1, 0.0), (1, 0.0)]


def test_names_of_importance_and_order_by_skewness(spark):
    importance = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.3)], "variable string, importance double")
    names = spark.createDataFrame([("b", "Bending"), ("b", "Bent")], "variable string, name string")
    assert [(r.place, r.name, r.variable) for r in learning.top_importance(importance, names, 2).collect()] == [(1, "Bending", "b"), (2, "c", "c")]
    rows = [(float(k), float(k**3), 1.0, -float(k**2)) for k in range(20)]
    order = stats.skewness_order(spark.createDataFrame(rows, "flat double, steep double, same double, down double"), ["flat", "steep", "same", "down"]).orderBy("place").collect()
    assert [r.variable for r in order] == ["steep", "down", "flat", "same"] and order[1].skewness < 0 and order[3].skewness is None


def test_turned_heads_are_set_right(spark):
    """An animal that goes to the right with its head in front; in the second stretch the ends are exchanged."""
    rows = []
    for k in range(60):
        head, tail, middle = (k + 4.0, 0.0), (k - 4.0, 0.0), (k + 0.0, 0.0)
        if k >= 30:
            head, tail = tail, head
        grey = (10.0, 90.0) if k < 30 else (90.0, 10.0)
        rows.append((1, k, 1 if k == 29 else 0, *head, *tail, *middle, *grey))
    names = "id int, frame int, collision_flag int, head_x double, head_y double, tail_x double, tail_y double, mid_x double, mid_y double, head_grey double, tail_grey double"
    out = orientation.oriented(spark.createDataFrame(rows, names)).orderBy("frame").collect()
    right = [r for r in out if r.head_x > r.tail_x]
    assert len(right) >= 55 and all(r.head_grey == 10.0 for r in out[33:])


def test_straightened_ends_follow_the_first_row(spark):
    rows = []
    for k in range(10):
        a, b = (k + 0.0, 0.0), (k + 10.0, 0.0)
        a, b = (b, a) if 3 <= k < 6 else (a, b)
        rows.append((1, k, *a, *b))
    df = spark.createDataFrame(rows, "id int, frame int, spinepoint_x_1 double, spinepoint_y_1 double, spinepoint_x_12 double, spinepoint_y_12 double")
    assert [r.swapped for r in collisions.straightened_ends(df).orderBy("frame").collect()] == [3 <= k < 6 for k in range(10)]


def test_significance_and_parallel_axes(spark):
    """p of a correlation against the exact t tail, and z means that sum to nothing over balanced groups."""
    pairs = spark.createDataFrame([("a", "b", 0.5, 12), ("a", "c", 0.0, 12), ("a", "d", 1.0, 12), ("a", "e", 0.9, 2)], "a string, b string, r double, n long")
    p = {r.b: r.p for r in stats.significance(pairs).collect()}
    assert abs(p["b"] - stats.t_tail(0.5 * math.sqrt(10 / 0.75), 10)) < 1e-12 and abs(p["b"] - 0.0978) < 1e-3 and p["c"] == 1.0 and p["d"] == 0.0 and p["e"] is None
    df = spark.createDataFrame([("x", float(k), 1.0 * k % 3) for k in range(20)] + [("y", float(k + 5), 1.0 * k % 3) for k in range(20)], "group_condition string, far double, same double")
    rows = {(r.group_condition, r.variable): r for r in stats.parallel_coordinates(df, ["far", "same"]).collect()}
    assert abs(rows["x", "far"].z_mean + rows["y", "far"].z_mean) < 1e-12 and rows["y", "far"].z_mean > 0
    mean, within = 2.5, sum((k - 9.5) ** 2 for k in range(20)) * 2 / 38
    assert abs(rows["x", "far"].f - 40 * mean**2 / within) < 1e-9 and abs(rows["x", "same"].f) < 1e-12
    assert df.groupBy("group_condition").agg(F.count("*").alias("n")).count() == 2


def test_named_heat_map_equals_ten_passes_of_a_loop(spark):
    pick = random.Random(6)
    rows = [(k, pick.uniform(-180, 180), pick.uniform(0, 40), pick.choice([None, 1, 0]), pick.uniform(-90, 90)) for k in range(400)]
    df = spark.createDataFrame(rows, "frame int, bearing_angle double, distance_to_odor double, HCs int, bending_angle double")
    n = 9

    def loop(points, radius, passes):
        (x0, x1), (y0, y1) = ((min(p[i] for p in points), max(p[i] for p in points)) for i in (0, 1))
        cells = {}
        for x, y, z in points:
            key = min(n, int((x - x0) * n / (x1 - x0)) + 1), min(n, int((y - y0) * n / (y1 - y0)) + 1)
            cells.setdefault(key, []).extend([] if z is None else [z])
        grid = {k: sum(v) / len(v) for k, v in cells.items() if v}
        for _ in range(passes):
            new = {}
            for i in range(1, n + 1):
                for j in range(1, n + 1):
                    near = sorted(v for (a, b), v in grid.items() if abs(a - i) <= radius and abs(b - j) <= radius)
                    if near:
                        m = len(near) // 2
                        new[i, j] = near[m] if len(near) % 2 else (near[m - 1] + near[m]) / 2
            grid = new
        return grid

    for axes, z, points in (("bearing_time", "HC_rate", [(r[1], r[0] / 16, r[3]) for r in rows]), ("time_distance", "abs_bending_angle", [(r[0] / 16, r[2], abs(r[4])) for r in rows])):
        got = {(r.xbin, r.ybin): r.z for r in binning.named_heat_map(df, axes, z, n, 2, 10).collect() if r.z is not None}
        want = loop(points, 2, 10)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sets_and_running_extremes(spark):
    from motiontab.operators import linking

    rows = [("v", 0, 1, 10.0, 0.0, 100.0), ("v", 0, 2, 14.0, 0.0, 300.0), ("v", 1, 9, 13.5, 1.0, 390.0), ("v", 1, 8, 90.0, 1.0, 900.0)]
    o = spark.createDataFrame(rows, "video string, frame int, label int, cx double, cy double, area double")
    members = spark.createDataFrame([("v", 1, 0, 1, 9), ("v", 1, 0, 2, 9), ("v", 1, 1, 2, 8)], "video string, frame int, set int, a int, b int")
    got = {r.set: (r.b, round(r.d, 6), r.centred, r.sized) for r in linking.set_matches(members, o).collect()}
    assert got == {0: (9, 1.5, True, True), 1: (8, 77.0, False, False)}
    t = spark.createDataFrame([("v", 1, k, a, a / 2) for k, a in enumerate([4.0, 2.0, 8.0])], "video string, track int, frame int, area double, spine_length double")
    assert [(r.area_sum, r.area_min, r.area_max) for r in linking.with_running_extremes(t).orderBy("frame").collect()] == [(4.0, 4.0, 4.0), (6.0, 2.0, 4.0), (14.0, 2.0, 8.0)]
    r = linking.object_statistics(t).first()
    assert abs(r.spine_length_sd - math.sqrt(7 / 3)) < 1e-12 and (r.area_min, r.area_max, r.n) == (2.0, 8.0, 3)
    lives = spark.createDataFrame([("v", 1, 102.0), ("v", 1, 306.0), ("v", 2, 900.0)], "video string, size int, area double")
    assert linking.single_area(lives).first().area == 200.0


def test_candidates_pairings_and_counters(spark):
    edges = spark.createDataFrame([("v", p, c) for p, c in ((1, 10), (2, 10), (10, 20), (10, 21), (20, 30), (3, 30), (30, 40), (30, 41), (4, 50), (31, 50), (50, 60), (50, 61))], "video string, parent int, child int")
    size = {10: 2, 30: 3, 20: 2, 50: 2, 31: 2}
    tracks_ = sorted({1, 2, 3, 4, 10, 20, 21, 30, 31, 40, 41, 50, 60, 61})
    lives = spark.createDataFrame([("v", t, 0, 5 if t != 50 else 500, size.get(t, 1), t == 3) for t in tracks_], "video string, track int, `start` int, `end` int, size int, round boolean")
    names = lambda df: sorted(r.track for r in df.collect())
    assert names(collisions.collision_candidates(lives.drop("size", "round"), edges, 10)) == [10, 30]
    assert names(collisions.collision_candidates(lives, edges, 10)) == [10] and names(collisions.collision_candidates(lives.drop("round"), edges, 1000)) == [10, 30, 50]
    resolved = spark.createDataFrame([("v", 10, 2), ("v", 30, 1), ("v", 50, 0)], "video string, track int, pairs int")
    r = collisions.collision_counters(lives, edges, resolved, spark.createDataFrame([("v", 4)], "video string, most int")).first()
    assert tuple(r) == ("v", 3, 3, 9 - 4, 1, 1, 3)
    p = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 5.0, 0.0, 1, 1), (0.0, 0.0, 1.0, 0.0, 5.0, 0.0, 2, 1), (0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 2, 1), (0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1, 1)], "x_in1 double, y_in1 double, x_out1 double, y_out1 double, x_out2 double, y_out2 double, size_out1 int, size_out2 int")
    assert [r.partner for r in collisions.one_sided_pairing(p).collect()] == ["out1", None, "out2", None]
    gaps = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0), (1, 4, 3.0, 4.0, 0.0, 8.0)], "id int, frame int, spinepoint_x_6 double, spinepoint_y_6 double, centroid_x double, centroid_y double")
    v = collisions.gap_velocities(gaps).orderBy("frame").collect()[1]
    assert (v.velocity, v.centroid_velocity, v.velocity_max) == (20.0, 32.0, 20.0)


def test_ranks_by_ranges_equal_those_by_windows(spark, monkeypatch):
    pick = random.Random(9)
    rows = [(k, pick.choice(["a", "a", "a", "b"]), float(pick.choice([0, 0, pick.randint(0, 300)])), float(pick.randint(0, 5))) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double")
    counts = df.groupBy("g", "x").agg(F.count("*").alias("c"))

    def found():
        below = sorted(map(tuple, stats.running_below(counts, ["g"], "x", "c").select("g", "x", "c", "below").collect()))
        whole = sorted(map(tuple, stats.running_below(counts.groupBy("x").agg(F.sum("c").alias("c")), [], "x", "c").select("x", "below").collect()))
        return below, whole, [(r.a, r.b, round(r.r, 12)) for r in stats.correlations(df, ["x", "y"], "spearman").collect()]

    few = found()
    monkeypatch.setattr(stats, "FEW_VALUES", 10)
    monkeypatch.setattr(stats, "FEW_RANKS", 10)
    assert found() == few
    total = {}
    for g, x, c, n in few[0]:
        assert n == total.get(g, 0)
        total[g] = n + c
