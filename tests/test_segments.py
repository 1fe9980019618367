import math
import random

import pytest
from motiontab.functions import segments
from motiontab.functions import windows as w
from motiontab.operators import events, kinematics, longtracks, summary
from motiontab.operators.saving import saved
from motiontab.plans import queries_long  # noqa: F401
from motiontab.plans.fixtures import measures
from motiontab.plans.queries import QUERIES
from pyspark.sql import Window
from pyspark.sql import functions as F

POINTS = (1, 2, 5, 6, 9, 11, 12)


@pytest.fixture(scope="module")
def raw(spark):
    """One animal with nine tenths of the rows, and two short ones; long quiet and long restless stretches, gaps in the frames."""
    pick, rows = random.Random(4), []
    for id, n in ((1, 2700), (2, 220), (3, 70)):
        x = y = way = turn = 0.0
        frame = 0
        for k in range(n):
            frame += 1 if pick.random() < 0.97 else pick.randint(2, 9)
            still, casting = k // 500 % 5 == 4, k // 170 % 4 == 2
            way += pick.gauss(0, 0.05)
            turn = pick.gauss(0, 0.8) if casting else 0.9 * turn + pick.gauss(0, 0.05)
            speed = 0.0 if still else (1 + math.sin(k / 3)) * (-0.1 if k // 600 % 2 else 0.1)
            x, y = x + speed * math.cos(way), y + speed * math.sin(way)
            points = []
            for p in POINTS:
                bend = way + (turn if p > 6 else 0)
                points += [x + (p - 6) / 4 * math.cos(bend) + pick.gauss(0, 0.002), y + (p - 6) / 4 * math.sin(bend) + pick.gauss(0, 0.002)]
            rows.append((id, frame, 1 if pick.random() < 0.01 and k < 300 else 0, 10.0, 20.0, *points))
    names = ", ".join(f"spinepoint_x_{p} double, spinepoint_y_{p} double" for p in POINTS)
    return spark.createDataFrame(rows, f"id int, frame int, collision_flag int, odor_a_x double, odor_a_y double, {names}").repartition(3).cache()


def table_of(df):
    names = sorted(df.columns)
    return names, {(r.id, r.frame): [r[c] for c in names] for r in df.collect()}


def same(a, b):
    (names, left), (others, right) = table_of(a), table_of(b)
    assert names == others and left.keys() == right.keys() and len(left) > 0
    for key, values in left.items():
        for name, x, y in zip(names, values, right[key], strict=True):
            fine = x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
            assert fine, (key, name, x, y)
    return left, names


def test_whole_chain_in_segments_is_as_on_whole_tracks(spark, raw):
    whole = events.with_events(kinematics.analysed(raw), min_size=5.0)
    rows, names = same(whole, longtracks.with_events(raw, rows=400, min_size=5.0))
    column = lambda c: [r[names.index(c)] for r in rows.values()]
    assert sum(column("HCs")) > 10 and sum(map(bool, column("step_boolean"))) > 20 and {1, -1} <= set(column("run_direction"))
    assert sum(x is not None and x > 1 for x in column("step_extr")) > 0 and set(column("flanks")) >= {0, 1, -1}


def test_segments_hold_few_rows_each(raw):
    cut = segments.cut(raw, 400, 100)
    n = [r["count"] for r in cut.groupBy("id", "_segment").count().collect()]
    assert max(n) <= 600 and len(n) == 9 and sorted(n)[len(n) // 2] * 2 >= max(n)
    assert segments.whole(cut).count() == raw.count()
    whole = cut.where("_core").groupBy("id").agg(F.countDistinct("_row").alias("a"), F.max("_row").alias("b"), F.max("_rows").alias("c")).collect()
    assert all(r.a == r.b == r.c for r in whole)
    with pytest.raises(ValueError):
        segments.cut(raw, 10, 20)


def test_stitched_values_equal_windows(spark, raw):
    """Sums, last and next values and groups that go over several segments, nulls and a track without any value."""
    test = (F.col("frame") % 700 == 3) & (F.col("id") != 3)
    value = F.when(test, F.col("frame"))
    group = F.col("frame") < 900

    def added(df):
        df = segments.stitched(df, totals={"t": F.sum(value)}, sums={"s": F.coalesce(value, F.lit(0))}, lasts={"l": value}, nexts={"n": value})
        df = df.withColumns({"before": w.before("l"), "after": w.after("n"), "row": segments.row_number(), "g": (F.col("frame") / 650).cast("int")})
        return segments.by_group(df, ["g"], group, {"m": F.max("frame"), "k": F.count("frame")})

    keep = ["id", "frame", "t", "s", "l", "n", "before", "after", "row", "m", "k"]
    with segments.segmented():
        parts = segments.whole(added(segments.cut(raw, 128, 16)))
    same(added(raw).select(*keep), parts.select(*keep))


def test_steps_of_one_track_are_counted_in_many_tasks(spark):
    """Sums up to a row equal those of a window over the track, with nulls and gaps; the windows of the plan hold blocks and steps."""
    pick = random.Random(5)
    rows = [(t, f, pick.choice([None, 0, 1])) for t in (1, 2, None) for f in range(0, 300, 7)] + [(1, None, 1), (3, 5, None), (3, 99, 1)]
    df = spark.createDataFrame(rows, "id int, frame int, x int").withColumn("x", F.when(F.col("frame").isNull() | (F.col("frame") > 20), F.col("x")))
    whole = F.sum("x").over(Window.partitionBy("id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    got = segments.running(df, {"so_far": F.col("x")}, width=32)
    assert got.columns == ["id", "frame", "x", "so_far"]
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("so_far", whole).collect()))
    steps = summary.per_step(measures(spark, "/root/testdata/sf0.001", spread=True))
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_none#" in plan and "windowspecdefinition(id#" not in plan


def test_steps_in_segments_write_few_columns_few_times(spark, monkeypatch):
    written = []
    monkeypatch.setattr(segments, "saved", lambda df: written.append(len(df.columns)) or saved(df))
    QUERIES["c30_in_segments"](spark, "/root/testdata/sf0.001").collect()
    assert len(written) <= 3 and max(written) <= 24
