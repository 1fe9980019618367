import math

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from motiontab.functions import geometry as g
from motiontab.operators import stats
from motiontab.plans.oracle import angle
from pyspark.sql import functions as F

number = st.floats(-100, 100, allow_nan=False).filter(lambda v: abs(v) > 1e-3)
vectors = st.lists(st.tuples(number, number, number, number), min_size=1, max_size=40)


@settings(max_examples=10, deadline=None)
@given(rows=vectors)
def test_angles_and_rotation(spark, rows):
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double")
    x, y = g.rotated("ax", "ay", g.to_upright("bx", "by"))
    ux, uy = g.rotated("bx", "by", g.to_upright("bx", "by"))
    out = df.select("*", g.clockwise_angle("ax", "ay", "bx", "by").alias("f"), g.clockwise_angle("bx", "by", "ax", "ay").alias("r"), x.alias("x"), y.alias("y"), ux.alias("ux"), uy.alias("uy"))
    for r in out.collect():
        assert -180.0001 <= r.f <= 180.0001
        assert abs(r.f + r.r) < 1e-6 or abs(abs(r.f) - 180) < 1e-6
        assert math.isclose(math.hypot(r.x, r.y), math.hypot(r.ax, r.ay), rel_tol=1e-9)
        assert abs(r.ux) < 1e-6 * math.hypot(r.bx, r.by) and r.uy > 0  # the target is straight above


def test_clockwise_is_positive_and_zero_vectors(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0, 0.0), (1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0)], "ax double, ay double, bx double, by double")
    assert [r[0] for r in df.select(g.clockwise_angle("ax", "ay", "bx", "by")).collect()] == [90.0, -90.0, 0.0]
    zero = df.select(*[c.alias(n) for c, n in zip(g.over_square(F.lit(0.0), F.lit(0.0)), "xy", strict=True)]).first()
    assert zero.x is None and zero.y is None
    joints = g.joint_angles([("ax", "ay"), ("bx", "by"), ("ay", "ax")])
    assert all(0 <= r[0][0] < 360 for r in df.select(joints).collect())


def test_kernels():
    for df, value in ((1, 12.7062), (5, 2.5706), (10, 2.2281), (30, 2.0423)):
        assert abs(stats.t_value(df, 0.975) - value) < 1e-4
    assert abs(stats.chi_square_tail(3.841459, 1) - 0.05) < 1e-6 and abs(stats.chi_square_tail(18.307, 10) - 0.05) < 1e-5
    # three against three, all smaller: one of 20 samples at each end
    assert abs(stats.rank_sum_p(0, 3, 3, 0.0) - 0.1) < 1e-12 and stats.rank_sum_p(4.5, 3, 3, 6.0) == 1.0
    assert abs(stats.rank_sum_p(25 * 25 / 2, 25, 25, 0.0) - 1) < 0.02 and stats.rank_sum_p(0, 0, 3, 0.0) is None
    assert abs(stats.rank_sum_p(100, 20, 15, 0.0) - stats.rank_sum_p(200, 20, 15, 0.0)) < 1e-12


def test_opposite_vectors_turn_as_in_sql(spark):
    """The sign of half a turn hangs on the last bit of the arctangents, in which Java's and C's differ."""
    rows = [(float(k * x), float(k * y), float(-x), float(-y)) for x in range(-30, 31, 3) for y in range(-40, 41, 5) for k in (1, 2, 3) if (x, y) != (0, 0)]
    df = spark.createDataFrame([*rows, (3.0, 4.0, 4.0, -3.0), (None, 1.0, 2.0, 3.0)], "ax double, ay double, bx double, by double")
    got = [r[0] for r in df.select(g.clockwise_angle_of_steps("ax", "ay", "bx", "by")).collect()]
    con = duckdb.connect()
    con.sql("CREATE TABLE v (ax DOUBLE, ay DOUBLE, bx DOUBLE, cy DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?, ?, ?)", rows)
    want = [r[0] for r in con.sql(f"SELECT {angle('ax', 'ay', 'bx', 'cy')} FROM v ORDER BY rowid").fetchall()]
    assert [round(x, 6) for x in got[: len(rows)]] == [round(x, 6) for x in want] and {180.0, -180.0} == {round(x, 6) for x in want}
    assert abs(got[-2] - 90) < 1e-9 and got[-1] is None
