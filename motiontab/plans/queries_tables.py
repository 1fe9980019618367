"""Registered queries on whole binned and summary tables: every output column is compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motiontab.operators import binning, learning, stats, summary
from motiontab.plans.fixtures import measures
from motiontab.plans.oracle import limits
from motiontab.plans.queries import _BINS, MEASURES
from motiontab.plans.queries import query as plain_query

_ANGLES = ("bearing_angle", "heading_angle", "bending_angle", "head_vector_angular_speed", "tail_vector_angular_speed")
_SERIES = (*_ANGLES, "head_vel_forward", "tail_vel_forward", "midpoint_speed", "midpoint_distance", "distance_to_odor", "spine_length")
_LENGTHS = ("head_vel_forward", "tail_vel_forward", "midpoint_speed", "midpoint_distance")
_CAST = "(Abs_HC_angle IS NULL OR Abs_HC_angle BETWEEN 20 AND 360)"
_IS = ("IS_angle", "Abs_IS_angle", "IS_reorientation", "IS_distance", "IS_distance_bl", "IS_interval")
#: Dyadic values often lie half-way between two rounded ones; both sides add this before they round.
_SHIFT = 1.23e-7


def query(name: str, sql: str):
    return plain_query(name, sql.replace(", 5)", f" + {_SHIFT}, 5)"))


def rnd(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(c) + _SHIFT, 5) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _change(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


def _side(x: str, side: str, how: str = "avg", test: str = "true") -> str:
    return f"{how}(CASE WHEN {test} AND odor_orientation = '{side}' THEN {x} END)"


def _rescaled(x: str) -> str:
    return f"-(2 * ({x}) / 85.0 - 1)"


_SPEEDS = _change(_side("run_speed", "towards"), _side("run_speed", "away"))
_CASTS = _change(_side("HCs", "towards", "sum", _CAST), _side("HCs", "away", "sum", _CAST))
_RATE = f"sum(CASE WHEN {_CAST} THEN HCs END) / count(*)::DOUBLE"


def _binned(spark, d):
    return binning.binned(measures(spark, d), "frame", 10)


def _kind(name: str, kind: str, columns: str) -> None:
    @query(name, f"{_BINS} SELECT group_condition, bin, {columns} FROM b GROUP BY ALL")
    def _(spark, d):
        return rnd(binning.binned_table(_binned(spark, d), [kind]).drop("midpoint"))


_kind("d17_all_series", "ts", ", ".join([limits(c, c) for c in _SERIES] + [limits(f"abs_{c}", f"abs({c})") for c in _ANGLES] + [limits(f"{c}_bl", c, "avg(spine_length)") for c in _LENGTHS]))
_kind("d18_head_casts", "hc", ", ".join([limits(c, f"CASE WHEN {_CAST} THEN {c} END") for c in ("HC_angle", "Abs_HC_angle", "HC_reorientation")]) + f', count(*) AS "N", round({_RATE}, 5) + 0.0 AS HC_rate, round({_CASTS}, 5) + 0.0 AS HC_rate_modulation')
_kind("d19_steps", "is", ", ".join(limits(c, c) for c in _IS))
_kind("d20_runs", "run", f"{limits('run_speed', 'run_speed')}, {limits('run_speed_bl', 'run_speed_bl')}, round({_SPEEDS}, 5) + 0.0 AS run_speed_modulation")


@query("d21_preference", f"""{_BINS}, p AS (SELECT group_condition, bin, round(avg(pref), 5) + 0.0 AS preference, {limits('odor_speed', 'odor_speed')}, {limits('preference_distance', _rescaled('distance_to_odor'))},
CASE WHEN count(odor_orientation) = count(*) THEN round(count(CASE WHEN odor_orientation = 'towards' THEN 1 END) / count(*)::DOUBLE, 5) END AS ratio_towards FROM b GROUP BY ALL)
SELECT * EXCLUDE (preference_distance_lowCI, preference_distance_hiCI), preference_distance_hiCI AS preference_distance_lowCI, preference_distance_lowCI AS preference_distance_hiCI FROM p""")
def _(spark, d):
    # rescaling turns the distance's limits round
    return rnd(binning.binned_table(_binned(spark, d), ["pref"]).drop("midpoint"))


_UNIT = {c: f"avg({c})" for c in (*_SERIES, *_IS, "run_speed", "run_speed_bl", "odor_speed")} | {f"abs_{c}": f"avg(abs({c}))" for c in _ANGLES}
_UNIT |= {c: f"avg(CASE WHEN {_CAST} THEN {c} END)" for c in ("HC_angle", "Abs_HC_angle", "HC_reorientation")} | {f"{c}_bl": f"avg({c}) / avg(spine_length)" for c in _LENGTHS[1:]}
_UNIT |= {"head_vel_forward_bl": "avg(head_vel_forward / spine_length)", "preference": "avg(pref)", "preference_distance": _rescaled("avg(distance_to_odor)")}
_UNIT |= {"ratio_towards": "count(CASE WHEN odor_orientation = 'towards' THEN 1 END) / nullif(count(odor_orientation), 0)::DOUBLE", "run_speed_modulation": _SPEEDS, "HC_rate": _RATE, "HC_rate_modulation": _CASTS}


def _by_unit(unit: str) -> str:
    return f"""{_BINS}, u AS (SELECT group_condition, bin, {unit}, {', '.join(f'{x} AS {c}' for c, x in _UNIT.items())} FROM b GROUP BY ALL)
    SELECT group_condition, bin, count(*) AS "N", {', '.join(limits(c, c) for c in _UNIT)} FROM u GROUP BY ALL"""


@query("d22_all_by_animal", _by_unit("id"))
def _(spark, d):
    return rnd(binning.binned_by_unit(_binned(spark, d), "id").drop("midpoint"))


@query("d22_all_by_trial", _by_unit("trial"))
def _(spark, d):
    return rnd(binning.binned_by_unit(_binned(spark, d), "trial").drop("midpoint"))


# summaries


def _pair(name: str, x: str, by: str = "1.0") -> str:
    return f"round(avg({x}) / {by}, 5) + 0.0 AS {name}_mean, round(var_samp({x}) / power({by}, 2), 5) + 0.0 AS {name}_var"


_TURNED = ("midpoint_speed", "head_vel_forward", "tail_vel_forward", "head_vector_angular_speed", "tail_vector_angular_speed")
_FAR = "CASE WHEN count(midpoint_distance) = count(*) THEN max(midpoint_distance) END"
_TS = ", ".join(
    [_pair(c, c) for c in (*_ANGLES, "head_vel_forward", "tail_vel_forward", "midpoint_speed", "odor_speed", "distance_to_odor")]
    + [_pair(f"abs_{c}", f"abs({c})") for c in _ANGLES]
    + [_pair(f"{c}_diff", f"d_{c}") for c in _TURNED]
    + [_pair(f"{c}_bl", c, "avg(spine_length)") for c in _TURNED[:3]]
    + [f"round({_FAR}, 5) AS midpoint_distance_max, round({_FAR} / avg(spine_length), 5) AS midpoint_distance_bl_max, round(avg(distance_to_sp), 5) AS distance_to_sp_mean, max(distance_to_sp) AS distance_to_sp_max"]
)
_STEP = "CASE WHEN step_boolean THEN {} END"
_ENDS = "count(CASE WHEN step_boolean THEN 1 END)"
_AT = {s: f"avg(CASE WHEN step_boolean AND odor_orientation = '{s}' THEN run_speed END)" for s in ("towards", "away")}
_RUNS = ", ".join(
    [_pair(c, _STEP.format(c)) for c in (*_IS, "run_speed")]
    + [_pair("run_speed_bl", _STEP.format("run_speed"), f"avg({_STEP.format('spine_length')})")]
    + [f"round({_change(_AT['towards'], _AT['away'])}, 5) + 0.0 AS run_speed_modulation, round(avg({_STEP.format('step_extr')}), 5) AS step_extr_mean"]
    + [f"round(1 - count(CASE WHEN step_boolean AND gt_1min THEN 1 END) / nullif({_ENDS}, 0)::DOUBLE, 5) + 0.0 AS one_minimum_share"]
)


def _led(keys: str, source: str) -> str:
    return f"SELECT *, {', '.join(f'lead({c}) OVER w - {c} AS d_{c}' for c in _TURNED)} FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY id, frame)"


_SHAPES = ", ".join([_pair(c, c) for c in ("area", "grey", "spine_length", "width", "perimeter")] + ["count(CASE WHEN collision_flag <> 0 THEN 1 END) AS collisions"] + [f"max(CASE WHEN flanks = {k} THEN frame END) / 16.0 AS {c}" for k, c in ((1, "last_to_forward"), (-1, "last_to_backward"))])
_BETWEEN = "Abs_HC_angle BETWEEN 20 AND 360"
_COUNT = {s: f"coalesce(sum(CASE WHEN {_BETWEEN} AND odor_orientation = '{s}' THEN HCs END), 0)" for s in ("towards", "away")}
_RATES = {s: f"({n} / nullif(count(CASE WHEN odor_orientation = '{s}' THEN 1 END), 0)::DOUBLE)" for s, n in _COUNT.items()}
_HEADS = ", ".join(
    [_pair(c, f"CASE WHEN {_BETWEEN} THEN {c} END") for c in ("HC_angle", "Abs_HC_angle", "HC_reorientation")]
    + [f'CAST(coalesce(sum(CASE WHEN {_BETWEEN} THEN HCs END), 0) AS BIGINT) AS "HCs", CAST({_COUNT["towards"]} AS BIGINT) AS "HCs_towards", CAST({_COUNT["away"]} AS BIGINT) AS "HCs_away"']
    + [f"round(coalesce(sum(CASE WHEN {_BETWEEN} THEN HCs END), 0) / count(*)::DOUBLE, 5) AS HC_rate, round({_change(_RATES['away'], _RATES['towards'])}, 5) + 0.0 AS HC_rate_modulation"]
)
_PREFERENCE = """round((count(CASE WHEN spinepoint_y_6_conv > 0 THEN 1 END) - count(CASE WHEN spinepoint_y_6_conv < 0 THEN 1 END)) / count(*)::DOUBLE, 5) + 0.0 AS preference,
round(-(2 * avg(distance_to_odor) / 85.0 - 1), 5) + 0.0 AS preference_distance, CASE WHEN count(odor_orientation) = count(*) THEN round(count(CASE WHEN odor_orientation = 'towards' THEN 1 END) / count(*)::DOUBLE, 5) END AS ratio_towards, round(avg(odor_speed), 5) + 0.0 AS mean_odor_speed"""


@query("d02_whole_summary", f"""{MEASURES}, n AS (SELECT id FROM measures GROUP BY id HAVING count(*) > 16 * 5), r AS ({_led('id', 'measures')}),
g AS (SELECT id, first(distance_to_odor ORDER BY frame) - last(distance_to_odor ORDER BY frame) AS preference_dist_se FROM measures WHERE distance_to_odor IS NOT NULL GROUP BY id)
SELECT id, "group", condition, group_condition, any_value(preference_dist_se) AS preference_dist_se, {_TS}, {_SHAPES}, {_HEADS}, {_RUNS}, {_PREFERENCE} FROM r JOIN n USING (id) LEFT JOIN g USING (id) GROUP BY ALL""")
def _(spark, d):
    s = summary.summarised(measures(spark, d), "id", threshold=5)
    return rnd(s.withColumns({c: F.col(c).cast("long") for c in ("collisions", "HCs", "HCs_towards", "HCs_away")}))


_PER = '"group", condition, group_condition, trial, id'


@query("d31_whole_per_step", f"""{MEASURES}, c AS (SELECT *, CAST(sum(CAST(step_boolean AS INT)) OVER (PARTITION BY id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step_count FROM measures),
r AS ({_led('id, step_count', 'c')}) SELECT {_PER}, step_count, count(*) AS n, {_TS}, {_RUNS}, CASE WHEN {_ENDS} > 0 THEN coalesce(sum({_STEP.format('step_extr')}), 0) > 1 END AS is_silly_step FROM r GROUP BY ALL""")
def _(spark, d):
    return rnd(summary.per_step(measures(spark, d, spread=True)))


@query("d32_whole_minima_classes", f"""{MEASURES}, c AS (SELECT *, CASE WHEN step_extr > 2 THEN '>2' ELSE CAST(step_extr AS VARCHAR) END AS minima FROM measures), r AS ({_led('id, minima', 'c')}),
f AS (SELECT {_PER}, minima, count(*) AS n, {_TS}, {_RUNS} FROM r GROUP BY ALL), ev AS (SELECT * FROM (SELECT DISTINCT id FROM measures) CROSS JOIN (SELECT DISTINCT minima FROM c))
SELECT ev.id, ev.minima, coalesce(f.n, 0) AS n, f.* EXCLUDE (id, minima, n) FROM ev LEFT JOIN f ON f.id = ev.id AND f.minima IS NOT DISTINCT FROM ev.minima""")
def _(spark, d):
    return rnd(summary.per_minima_class(measures(spark, d)))


_AXES = ("midpoint_speed", "area", "grey", "bending_angle", "tail_vel_forward", "odor_speed")
_THIRD = " UNION ALL ".join(f"SELECT '{c}' AS variable, avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5) AS s FROM measures, (SELECT avg({c}) AS m FROM measures)" for c in _AXES)


@query("g17_skewness_order", f"{MEASURES}, s AS ({_THIRD}) SELECT variable, round(s, 5) + 0.0 AS skewness, CAST(row_number() OVER (ORDER BY abs(s) DESC, variable) AS INT) AS place FROM s")
def _(spark, d):
    return rnd(stats.skewness_order(measures(spark, d), _AXES))


@plain_query("g09_variable_groups")
def _(spark, d):
    g = learning.variable_groups(measures(spark, d), (*_AXES, "spine_length", "width", "perimeter", "head_vel_forward", "distance_to_odor"))
    return g.select("variable", "cluster", *[F.round(c, 6).alias(c) for c in ("silhouette", "x", "y")])
