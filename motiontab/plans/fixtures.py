"""Track tables derived from the ``events`` table, the same in Spark SQL and in DuckDB. Coordinates are dyadic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiontab.functions import segments

_E = """
e AS (SELECT CAST(user_id % 10 AS INT) AS id, event_id,
             CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS INT) AS frame,
             CAST(round(value * 100) AS BIGINT) AS c FROM events)"""

_NAMES = """concat('G', CAST(id % 2 AS STRING)) AS {q}group{q}, concat('C', CAST(id % 3 AS STRING)) AS condition,
            concat('T', CAST(id % 5 AS STRING)) AS trial"""


def _points() -> str:
    out = []
    for k in (1, 2, 5, 6, 9, 11, 12):
        bend = f" + CAST({(k - 6) ** 2} AS DOUBLE) * b" if k > 6 else ""
        out.append(f"x + CAST({k - 6} AS DOUBLE) * hx / CAST(4 AS DOUBLE){bend} AS spinepoint_x_{k}, y + CAST({k - 6} AS DOUBLE) / CAST(4 AS DOUBLE) AS spinepoint_y_{k}")
    return ",\n".join(out)


def frames_sql(q: str = '"') -> str:
    """CTEs e, s and frames: raw points of ten tracks."""
    return f"""{_E},
s AS (SELECT id, event_id, frame, c,
        sum(CAST((event_id * 37) % 97 - 48 AS DOUBLE) / CAST(64 AS DOUBLE)) OVER w AS x,
        sum(CAST((event_id * 53) % 89 - 44 AS DOUBLE) / CAST(64 AS DOUBLE)) OVER w AS y,
        CAST((c % 33) - 16 AS DOUBLE) / CAST(32 AS DOUBLE) AS hx, CAST((event_id % 5) - 2 AS DOUBLE) / CAST(512 AS DOUBLE) AS b
      FROM e WINDOW w AS (PARTITION BY id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
frames AS (SELECT id, frame, {_NAMES.format(q=q)},
        CAST(CASE WHEN id % 2 = 0 THEN 24 ELSE 0 END AS DOUBLE) AS odor_a_x, CAST(CASE WHEN id % 2 = 0 THEN 32 ELSE 0 END AS DOUBLE) AS odor_a_y,
        {_points()},
        CAST(100 + abs(c) % 50 AS DOUBLE) AS area, CAST(1000 + abs(c) % 97 AS DOUBLE) AS grey, CAST(4 + abs(c) % 3 AS DOUBLE) AS width, CAST(30 + abs(c) % 11 AS DOUBLE) AS perimeter,
        CASE WHEN event_id % 101 = 0 THEN 1 WHEN event_id % 103 = 0 THEN 2 ELSE 0 END AS collision_flag
      FROM s)"""


def measures_sql(q: str = '"') -> str:
    """CTEs e and measures: a table like an analysed one, with whole and dyadic values and some nulls."""
    num = lambda expr, by=1: f"CAST({expr} AS DOUBLE) / CAST({by} AS DOUBLE)"
    some = lambda rest, expr: f"CASE WHEN event_id % {rest} <> 0 THEN {expr} END"
    columns = {
        "bearing_angle": some(11, num("abs(c * 7) % 361 - 180")),
        "heading_angle": some(13, num("abs(c * 5) % 361 - 180")),
        "bending_angle": some(17, num("abs(c * 3) % 181 - 90")),
        "head_vector_angular_speed": some(19, num("abs(c * 11) % 401 - 200", 2)),
        "tail_vector_angular_speed": some(23, num("abs(c * 13) % 201 - 100", 2)),
        "midpoint_speed": some(11, num("abs(c) % 64", 32)),
        "midpoint_distance": num("frame", 8),
        "head_vel_forward": some(29, num("abs(c * 3) % 65 - 32", 16)),
        "tail_vel_forward": some(31, num("abs(c * 5) % 65 - 32", 16)),
        "tail_vel_forward_bl": some(31, num("abs(c * 9) % 65 - 32", 16)),
        "spine_length": num("2 + abs(c) % 3"),
        "distance_to_odor": some(11, num("abs(c * 17) % 128", 4)),
        "distance_to_sp": some(47, num("abs(c * 37) % 96", 4)),
        "odor_speed": some(37, num("abs(c * 19) % 33 - 16", 8)),
        "spinepoint_y_6_conv": some(41, num("abs(c * 23) % 81 - 40", 4)),
        "HCs": "CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END",
        "HC_angle": f"CASE WHEN event_id % 7 = 0 THEN {num('abs(c * 3) % 121 - 60')} END",
        "HC_reorientation": f"CASE WHEN event_id % 7 = 0 THEN {num('abs(c * 29) % 91 - 45')} END",
        "run_flag": "CASE WHEN event_id % 43 = 0 THEN NULL ELSE event_id % 7 <> 1 END",
        "run_direction": "CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST(abs(c) % 3 - 1 AS INT) END",
        # where steps end, which is apart from the rows with their measures
        "step_boolean": "event_id % 5 = 0 AND event_id % 3 <> 1 OR event_id % 5 = 2",
        "IS_angle": f"CASE WHEN event_id % 5 = 0 THEN {num('abs(c * 7) % 91 - 45')} END",
        "IS_interval": f"CASE WHEN event_id % 5 = 0 THEN {num('1 + abs(c) % 16', 16)} END",
        "IS_distance": f"CASE WHEN event_id % 5 = 0 THEN {num('abs(c) % 32', 16)} END",
        "run_speed": f"CASE WHEN event_id % 5 = 0 THEN {num('abs(c) % 48', 32)} END",
        "IS_reorientation": f"CASE WHEN event_id % 5 = 0 THEN {num('abs(c * 3) % 77 - 38')} END",
        "pref": some(43, "CASE WHEN abs(c * 31) % 5 < 3 THEN 1 ELSE -1 END"),
        "step_extr": "CASE WHEN event_id % 5 = 0 AND event_id % 4 <> 3 THEN CAST(abs(c) % 4 AS INT) END",
        "flanks": "CASE WHEN event_id % 97 = 0 THEN 1 WHEN event_id % 89 = 0 THEN -1 ELSE 0 END",
        "collision_flag": "CASE WHEN event_id % 101 = 0 THEN 1 WHEN event_id % 103 = 0 THEN 2 ELSE 0 END",
        "area": num("100 + abs(c) % 50"),
        "grey": num("1000 + abs(c) % 97"),
        "width": num("4 + abs(c) % 3"),
        "perimeter": num("30 + abs(c) % 11"),
    }
    listed = ",\n".join(f"{v} AS {k}" for k, v in columns.items())
    more = """CASE WHEN bearing_angle <= 90 THEN 'towards' WHEN bearing_angle IS NOT NULL THEN 'away' END AS odor_orientation,
        abs(bearing_angle) AS abs_bearing_angle, abs(HC_angle) AS Abs_HC_angle, step_extr <> 1 AS gt_1min, abs(IS_angle) AS Abs_IS_angle,
        IS_distance / spine_length AS IS_distance_bl, run_speed / spine_length AS run_speed_bl"""
    return f"""{_E},
m0 AS (SELECT id, frame, event_id, {_NAMES.format(q=q)}, {listed} FROM e),
measures AS (SELECT *, concat({q}group{q}, '-', condition) AS group_condition, {more} FROM m0)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {frames_sql('`').replace('FROM events', 'FROM {events}')} SELECT * FROM frames", events=_events(spark, sf_dir))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CTE e, numbered by blocks of events, so that a track spreads over tasks."""
    e = _events(spark, sf_dir).select(F.expr("CAST(user_id % 10 AS INT)").alias("id"), "event_id", F.expr("CAST(round(value * 100) AS BIGINT)").alias("c"))
    return segments.running(e, {"_row": F.lit(1)}, "event_id", 65536).select("id", "event_id", (F.col("_row") - 1).cast("int").alias("frame"), "c")


def measures(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``spread``: rows of a track lie in many tasks; without it one task holds a track, and windows over it need no further exchange."""
    if spread:
        return spark.sql(f"WITH {measures_sql('`').replace(_E, 'e AS (SELECT * FROM {e})')} SELECT * FROM measures", e=_numbered(spark, sf_dir))
    return spark.sql(f"WITH {measures_sql('`').replace('FROM events', 'FROM {events}')} SELECT * FROM measures", events=_events(spark, sf_dir))
