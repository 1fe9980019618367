"""From raw points to smoothed points, speeds, angles and flags: one row in, one row out.

Operators take and return the frame table: keys ``id`` and ``frame``, points ``spinepoint_x_k`` and ``spinepoint_y_k``,
the odour's place ``odor_a_x`` and ``odor_a_y``. All windows share one partitioning and order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motiontab.functions import geometry as g
from motiontab.functions import segments
from motiontab.functions import windows as w

#: Columns that collision and curl rows lose.
MASKED = (
    "head_vector_x head_vector_y tail_vector_x tail_vector_y midpoint_speed midpoint_speed_bl midpoint_distance midpoint_distance_bl "
    "head_vector_angular_speed abs_head_vector_angular_speed tail_vector_angular_speed abs_tail_vector_angular_speed "
    "head_vel_forward head_vel_forward_bl tail_vel_forward tail_vel_forward_bl head_vector_extended_x head_vector_extended_y "
    "bending_angle bearing_angle heading_angle distance_to_odor odor_orientation odor_speed pref"
).split()


def point(k: int, kind: str = "") -> tuple[str, str]:
    return f"spinepoint_x_{k}{kind}", f"spinepoint_y_{k}{kind}"


def points_of(df: DataFrame) -> list[int]:
    return sorted(int(c.rsplit("_", 1)[1]) for c in df.columns if c.startswith("spinepoint_x_") and c.rsplit("_", 1)[1].isdigit())


def with_spine_length(df: DataFrame, points: Sequence[int] | None = None) -> DataFrame:
    return df.withColumn("spine_length", g.polyline_length([point(k) for k in points or points_of(df)]))


def rotated_to_odor(df: DataFrame, prefixes: Sequence[str] = ("spinepoint",), suffix: str = "_rot") -> DataFrame:
    """Rotate all points so that the odour lies on the upper y axis: columns ..._rot, odor_a_x_rot = 0, odor_a_y_rot."""
    angle = g.to_upright("odor_a_x", "odor_a_y")
    new = {"odor_a_x_rot": F.lit(0.0), "odor_a_y_rot": F.sqrt(F.col("odor_a_x") * F.col("odor_a_x") + F.col("odor_a_y") * F.col("odor_a_y"))}
    df = df.withColumn("_turn", angle)
    for prefix in prefixes:
        for c in [c for c in df.columns if c.startswith(f"{prefix}_x_")]:
            k = c.rsplit("_", 1)[1]
            new[f"{prefix}_x_{k}{suffix}"], new[f"{prefix}_y_{k}{suffix}"] = g.rotated(c, f"{prefix}_y_{k}", F.col("_turn"))
    return df.withColumns(new).drop("_turn")


def smoothed(df: DataFrame, columns: Sequence[str], frame_rate: float = 16, names: dict[str, str] | None = None) -> DataFrame:
    """Centred means over 0.3 s as ``<column>_conv``."""
    n = round(0.3 * frame_rate)
    return df.withColumns({(names or {}).get(c, f"{c}_conv"): w.centred(c, n) for c in columns})


def with_vectors(df: DataFrame) -> DataFrame:
    """Tail vector 2 to 6 over its squared length, head vector 9 to 11, extended head vector 5 to 11; smoothed points."""
    p = lambda k: [F.col(c) for c in point(k, "_conv")]
    tail = g.over_square(p(6)[0] - p(2)[0], p(6)[1] - p(2)[1])
    return df.withColumns(
        {
            "tail_vector_x": tail[0],
            "tail_vector_y": tail[1],
            "head_vector_x": p(11)[0] - p(9)[0],
            "head_vector_y": p(11)[1] - p(9)[1],
            "head_vector_extended_x": p(11)[0] - p(5)[0],
            "head_vector_extended_y": p(11)[1] - p(5)[1],
        }
    )


def angular_speed(x: str, y: str, frame_rate: float) -> Column:
    return frame_rate * g.clockwise_angle(x, y, w.after(x), w.after(y))


def smooth_if_long(x, seconds: float, frame_rate: float) -> Column:
    """Centred mean over so many seconds, for frame rates over 8 and tracks longer than the window."""
    n = round(seconds * frame_rate)
    if frame_rate <= 8:
        return g.column(x)
    return F.when(segments.track_rows() > n, w.centred(x, n)).otherwise(g.column(x))


def with_kinematics(df: DataFrame, frame_rate: float = 16, strict_ref: bool = True) -> DataFrame:
    """Speeds, distances, angular speeds and angles from smoothed points and vectors.

    strict_ref: the forward head velocity weighs both differences by the tail vector's x, as published results do;
    False weighs the second one by y.
    """
    x6, y6 = point(6, "_conv")
    step = g.distance(w.before(x6), w.before(y6), x6, y6)
    ahead = lambda k: [w.after(c) - F.col(c) for c in point(k, "_conv")]
    d12, d1, d6 = ahead(12), ahead(1), ahead(6)
    to_odor = g.over_square(F.col("odor_a_x_rot") - F.col(x6), F.col("odor_a_y_rot") - F.col(y6))
    df = df.withColumns(
        {
            "midpoint_speed": step * frame_rate,
            "head_turn": angular_speed("head_vector_x", "head_vector_y", frame_rate),
            "tail_vector_angular_speed": angular_speed("tail_vector_x", "tail_vector_y", frame_rate),
            "head_vel_forward": frame_rate * (F.col("tail_vector_x") * d12[0] + F.col("tail_vector_x" if strict_ref else "tail_vector_y") * d12[1]),
            "tail_step": frame_rate * (F.col("tail_vector_x") * d1[0] + F.col("tail_vector_y") * d1[1]),
            "bend": -g.clockwise_angle("tail_vector_x", "tail_vector_y", "head_vector_extended_x", "head_vector_extended_y"),
            "bearing_angle": g.clockwise_angle("tail_vector_x", "tail_vector_y", F.col("odor_a_x_rot") - F.col(x6), F.col("odor_a_y_rot") - F.col(y6)),
            "heading_angle": g.clockwise_angle("head_vector_x", "head_vector_y", F.col("odor_a_x_rot") - F.col(point(9, "_conv")[0]), F.col("odor_a_y_rot") - F.col(point(9, "_conv")[1])),
            "odor_speed": frame_rate * (to_odor[0] * d6[0] + to_odor[1] * d6[1]),
            "distance_to_odor": g.distance(x6, y6, "odor_a_x_rot", "odor_a_y_rot"),
            "pref": F.when(F.col(point(5, "_conv")[1]) > 0, 1).when(F.col(point(5, "_conv")[1]).isNotNull(), -1),
        }
    )
    start = {"_x": segments.nth(F.col(x6), 5), "_y": segments.nth(F.col(y6), 5)}
    df = segments.stitched(df, totals={"_length": F.avg("spine_length"), **start}, sums={"_gone": F.coalesce(F.col("midpoint_speed") / frame_rate, F.lit(0.0))})
    df = df.withColumns(
        {
            "distance_to_sp": g.distance("_x", "_y", x6, y6),
            "midpoint_distance": F.when(F.col("midpoint_speed").isNotNull(), F.col("_gone")),
            "head_vector_angular_speed": smooth_if_long("head_turn", 0.45, frame_rate),
            "tail_vel_forward": smooth_if_long("tail_step", 0.3, frame_rate),
            "bending_angle": smooth_if_long("bend", 0.45, frame_rate),
            "odor_orientation": F.when(F.col("bearing_angle") <= 90, "towards").when(F.col("bearing_angle").isNotNull(), "away"),
        }
    ).drop("head_turn", "tail_step", "bend", "_x", "_y", "_gone")
    flipped = (F.abs("head_vector_angular_speed") > 180) | (F.col("tail_vector_angular_speed") > 180)
    return df.withColumns(
        {
            **{f"abs_{c}": F.abs(c) for c in ("head_vector_angular_speed", "tail_vector_angular_speed", "bending_angle", "bearing_angle", "heading_angle")},
            **{f"{c}_bl": F.try_divide(F.col(c), F.col("_length")) for c in ("midpoint_speed", "midpoint_distance", "head_vel_forward", "tail_vel_forward")},
            "na_flag_flip": w.centred(flipped.cast("int"), 5, F.sum) > 0,
        }
    ).drop("_length")


def masked(df: DataFrame, flags: Sequence[int] = (1, 2), columns: Sequence[str] = MASKED) -> DataFrame:
    """Null the kinematics of collision (1) and curl or model (2) rows; absolute angles and points stay."""
    hit = F.coalesce(F.col("collision_flag").isin(list(flags)), F.lit(False))
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns if c in df.columns})


def long_tracks(df: DataFrame, least: float) -> DataFrame:
    """Tracks of more than ``least`` rows."""
    return df.withColumn("_long", segments.track_rows() > least).where("_long").drop("_long")


def analysed(df: DataFrame, frame_rate: float = 16, strict_ref: bool = True, keep_points: bool = False) -> DataFrame:
    """Raw frame table to kinematics, masked; tracks of more than frame_rate / 0.5 rows."""
    df = with_spine_length(long_tracks(df, round(frame_rate / 0.5)))
    spots = points_of(df)
    df = rotated_to_odor(df)
    names = {f"spinepoint_{a}_{k}_rot": f"spinepoint_{a}_{k}_conv" for a in "xy" for k in spots}
    df = smoothed(df, list(names), frame_rate, names)
    df = df.drop(*names, *[c for k in spots for c in point(k)])
    df = masked(with_kinematics(with_vectors(df), frame_rate, strict_ref))
    return df if keep_points else df.drop(*[c for k in spots if k not in (1, 5, 6, 9, 12) for c in point(k, "_conv")])
