"""The analysed frame table in plain SQL for DuckDB, written apart from the DataFrame operators it checks."""

from __future__ import annotations

from motiontab.plans.fixtures import frames_sql

POINTS = (1, 2, 5, 6, 9, 11, 12)


def angle(ax: str, ay: str, bx: str, by: str) -> str:
    t = f"(atan2({by}, {bx}) - atan2({ay}, {ax}))"
    return f"(-degrees(CASE WHEN abs({t}) > pi() THEN {t} - sign({t}) * 2 * pi() ELSE {t} END))"


def mean(x: str, n: int) -> str:
    back, ahead = n - 1 - n // 2, n // 2
    w = f"OVER (PARTITION BY id ORDER BY frame ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    return f"CASE WHEN count({x}) {w} = {n} THEN avg({x}) {w} END"


def ahead(x: str) -> str:
    return f"(lead({x}) OVER t - {x})"


def kinematics_ctes() -> str:
    """frames_sql plus: rot, conv, vec, k1 and kin (unmasked kinematics of tracks over 32 rows, 16 frames a second)."""
    rot = ",".join(f"spinepoint_x_{k} * cos(a) - spinepoint_y_{k} * sin(a) AS x{k}r, spinepoint_x_{k} * sin(a) + spinepoint_y_{k} * cos(a) AS y{k}r" for k in POINTS)
    conv = ",".join(f"{mean(f'{c}{k}r', 5)} AS {c}{k}" for k in POINTS for c in "xy")
    segments = "+".join(f"sqrt(power(spinepoint_x_{b} - spinepoint_x_{a}, 2) + power(spinepoint_y_{b} - spinepoint_y_{a}, 2))" for a, b in zip(POINTS, POINTS[1:], strict=False))
    turn = angle("0.0", "len", "odor_a_x", "odor_a_y")
    steps = {
        "hv": "16 * " + angle("hx", "hy", "lead(hx) OVER t", "lead(hy) OVER t"),
        "tv": "16 * " + angle("tx", "ty", "lead(tx) OVER t", "lead(ty) OVER t"),
        "head_vel_forward": f"16 * (tx * {ahead('x12')} + tx * {ahead('y12')})",
        "ts": f"16 * (tx * {ahead('x1')} + ty * {ahead('y1')})",
        "bd": "-" + angle("tx", "ty", "ex", "ey"),
        "bearing_angle": angle("tx", "ty", "(0 - x6)", "(oy - y6)"),
        "heading_angle": angle("hx", "hy", "(0 - x9)", "(oy - y9)"),
        "odor_speed": f"16 * ((0 - x6) / (x6 * x6 + (oy - y6) * (oy - y6)) * {ahead('x6')} + (oy - y6) / (x6 * x6 + (oy - y6) * (oy - y6)) * {ahead('y6')})",
        "distance_to_odor": "sqrt(x6 * x6 + (y6 - oy) * (y6 - oy))",
        "midpoint_speed": "16 * sqrt(power(x6 - lag(x6) OVER t, 2) + power(y6 - lag(y6) OVER t, 2))",
        "distance_to_sp": "sqrt(power(x6 - nth_value(x6, 5) OVER w, 2) + power(y6 - nth_value(y6, 5) OVER w, 2))",
        "pref": "CASE WHEN y5 > 0 THEN 1 WHEN y5 IS NOT NULL THEN -1 END",
    }
    listed = ",\n".join(f"{v} AS {k}" for k, v in steps.items())
    return f"""{frames_sql()},
rot AS (SELECT *, {rot} FROM (SELECT *, {segments} AS spine_length, len AS oy, CASE WHEN len = 0 THEN 0.0 ELSE radians({turn}) END AS a
        FROM (SELECT *, sqrt(odor_a_x * odor_a_x + odor_a_y * odor_a_y) AS len, count(*) OVER (PARTITION BY id) AS n FROM frames) WHERE n > 32)),
conv AS (SELECT *, {conv} FROM rot),
vec AS (SELECT *, (x6 - x2) / nullif((x6 - x2) * (x6 - x2) + (y6 - y2) * (y6 - y2), 0) AS tx, (y6 - y2) / nullif((x6 - x2) * (x6 - x2) + (y6 - y2) * (y6 - y2), 0) AS ty,
               x11 - x9 AS hx, y11 - y9 AS hy, x11 - x5 AS ex, y11 - y5 AS ey FROM conv),
k1 AS (SELECT *, {listed} FROM vec WINDOW t AS (PARTITION BY id ORDER BY frame), w AS (PARTITION BY id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
kin AS (SELECT *, tv AS tail_vector_angular_speed, {mean('hv', 7)} AS head_vector_angular_speed, {mean('ts', 5)} AS tail_vel_forward, {mean('bd', 7)} AS bending_angle,
               CASE WHEN midpoint_speed IS NOT NULL THEN sum(coalesce(midpoint_speed / 16, 0)) OVER (PARTITION BY id ORDER BY frame ROWS UNBOUNDED PRECEDING) END AS midpoint_distance,
               avg(spine_length) OVER (PARTITION BY id) AS mean_length,
               CASE WHEN bearing_angle <= 90 THEN 'towards' WHEN bearing_angle IS NOT NULL THEN 'away' END AS odor_orientation FROM k1)"""


def rounded(*columns: str, digits: int = 6) -> str:
    """Rounded columns, minus zero as zero."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


#: The 0.975 quantiles of Student's t with 1 to 30 degrees of freedom, and of the normal distribution: fixed values.
T_975 = (
    12.7062047362, 4.3026527297, 3.1824463053, 2.7764451052, 2.5705818356, 2.4469118511, 2.3646242516, 2.3060041352, 2.2621571628, 2.228138852,
    2.2009851601, 2.1788128297, 2.1603686565, 2.1447866879, 2.1314495456, 2.1199052992, 2.1098155778, 2.1009220402, 2.0930240544, 2.0859634473,
    2.0796138447, 2.0738730679, 2.0686576104, 2.0638985616, 2.0595385528, 2.0555294386, 2.0518305165, 2.0484071418, 2.0452296421, 2.0422724563,
)
NORMAL_975 = 1.959963984540054


def t_quantile(n: str) -> str:
    """The 0.975 quantile for n - 1 degrees of freedom: from the table, beyond it by the expansion around the normal one."""
    z, v = NORMAL_975, f"CAST(greatest({n} - 1, 1) AS DOUBLE)"
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    terms.append((79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    expanded = " + ".join(f"{t!r} / power({v}, {k})" for k, t in enumerate(terms))
    return f"CASE WHEN {n} < 2 THEN NULL WHEN {n} <= 31 THEN {list(T_975)}[CAST({n} - 1 AS INT)] ELSE {expanded} END"


def limits(name: str, x: str, by: str = "1.0") -> str:
    """name_mean, name_lowCI and name_hiCI of an expression, over another aggregate."""
    half = f"{t_quantile(f'count({x})')} * stddev_samp({x}) / sqrt(count({x}))"
    return ", ".join(f"round({value}, 5) + 0.0 AS {name}_{c}" for c, value in (("mean", f"avg({x}) / {by}"), ("lowCI", f"(avg({x}) - {half}) / {by}"), ("hiCI", f"(avg({x}) + {half}) / {by}")))
