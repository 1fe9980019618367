"""Head casts, runs, steps and direction changes, found as islands and pairs of rows in a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motiontab.functions import geometry as g
from motiontab.functions import segments
from motiontab.functions import windows as w


#: The columns that ``with_head_casts`` reads.
CASTS = ("id", "frame", "head_vector_angular_speed", "tail_vector_angular_speed", "bending_angle", "heading_angle")


def with_row(df: DataFrame) -> DataFrame:
    return df if "row" in df.columns else df.withColumn("row", segments.row_number())


def _with_islands(df: DataFrame, least_head: float) -> DataFrame:
    """Add the islands of fast rows as _island (number), _inside, and on each of their rows _start, _end, _fastest (rows),
    _tail, _angle, _turned and _size.

    An island is made of rows whose head turns faster than ``least_head`` either way, with the row before them. The first
    row of a track is never fast. A single quiet row between two islands starts the second.
    """
    over = F.coalesce(F.abs("head_vector_angular_speed") > least_head, F.lit(False)) & (F.col("row") > 1)
    df = with_row(df).withColumn("_over", over)
    ahead = F.coalesce(w.after("_over"), F.lit(False)) & ~F.col("_over")
    df = segments.stitched(df.withColumn("_starts", ahead), sums={"_island": F.col("_starts").cast("int")})
    df = df.withColumn("_inside", F.col("_over") | F.col("_starts"))
    speed = F.coalesce(F.abs("head_vector_angular_speed"), F.lit(-1.0))
    ends = lambda c: (F.min_by(c, "row"), F.max_by(c, "row"))
    (first_bend, last_bend), (first_heading, last_heading) = ends("bending_angle"), ends("heading_angle")
    found = {"_start": F.min("row"), "_end": F.max("row"), "_fastest": F.max_by("row", F.struct(speed, -F.col("row"))), "_tail": F.max(F.abs("tail_vector_angular_speed"))}
    found |= {"_b1": first_bend, "_b2": last_bend, "_h1": first_heading, "_h2": last_heading}
    df = segments.by_group(df, ["_island"], F.col("_inside"), found)
    turns = {"_angle": F.col("_b2") - F.col("_b1"), "_turned": F.abs("_h1") - F.abs("_h2")}
    return df.withColumns(turns).drop("_b1", "_b2", "_h1", "_h2")


_ISLAND = ["_over", "_starts", "_island", "_inside", "_start", "_end", "_fastest", "_tail", "_angle", "_turned"]


def _tail_ok(most_tail: float) -> Column:
    return F.coalesce(F.col("_tail") < most_tail, F.lit(False))


def _size_ok(min_size: float, max_size: float | None) -> Column:
    size = F.abs("_angle")
    return F.coalesce((size > min_size) & (size < max_size if max_size is not None else F.lit(True)), F.lit(False))


def head_cast_intervals(df: DataFrame, least_head: float = 35.0, most_tail: float = 45.0, min_size: float = 20.0, max_size: float | None = None) -> DataFrame:
    """Candidates (id, start, end, peak, angle, reorientation, tail_ok, size_ok) as rows of the track.

    A candidate is an island of rows whose head turns faster than ``least_head`` either way; it starts a row before
    the island, its peak is the row after the fastest. The first row of a track starts no island.
    """
    rows = _with_islands(df, least_head).where(F.col("_inside") & (F.col("row") == F.col("_start")))
    return rows.select(
        "id", F.col("_start").alias("start"), F.col("_end").alias("end"), (F.col("_fastest") + 1).alias("peak"), F.col("_angle").alias("angle"), F.col("_turned").alias("reorientation"),
        _tail_ok(most_tail).alias("tail_ok"), _size_ok(min_size, max_size).alias("size_ok"),
    )


def with_head_casts(df: DataFrame, least_head: float = 35.0, most_tail: float = 45.0, min_size: float = 20.0, max_size: float | None = None) -> DataFrame:
    """Add HCs, HC_flag, HCs_left, HCs_right, HC_angle, Abs_HC_angle, HC_reorientation.

    If no candidate of a track survives, the flag marks all fast rows. Tracks without candidates have zeros and nulls.
    """
    df = _with_islands(df, least_head)
    df = df.withColumn("_covered", (F.col("_inside") & _tail_ok(most_tail) & _size_ok(min_size, max_size)).cast("int"))
    peak = F.when((F.col("_covered") == 1) & (F.col("row") == F.col("_fastest")), F.struct("_angle", "_turned"))
    df = segments.stitched(df.withColumn("_peak", w.before(peak)), totals={"_some": F.max("_covered")})
    df = df.withColumns({"HCs": F.col("_peak").isNotNull().cast("int"), "HC_angle": F.col("_peak")["_angle"], "HC_reorientation": F.col("_peak")["_turned"], "HC_flag": F.when(F.col("_some") == 1, F.col("_covered")).otherwise(F.col("_over").cast("int"))})
    side = lambda test: ((F.col("HC_flag") == 1) & F.coalesce(test, F.lit(False))).cast("int")
    df = df.withColumns({"HCs_left": side(F.col("head_vector_angular_speed") > 0), "HCs_right": side(F.col("head_vector_angular_speed") < 0), "Abs_HC_angle": F.abs("HC_angle")})
    return df.drop(*_ISLAND, "_covered", "_peak", "_some")


def with_run_flag(df: DataFrame, frame_rate: float = 16) -> DataFrame:
    """True where no head cast lies within 3 s around; null at the ends of long tracks."""
    n = round(3 * frame_rate)
    casts = ((F.col("HCs_left") == 1) | (F.col("HCs_right") == 1)).cast("int")
    around = F.when(segments.track_rows() > n, w.centred(casts, n, F.sum)).otherwise(casts)
    return df.withColumn("run_flag", around == 0)


def with_step_candidates(df: DataFrame, forward: float = 0.6, backward: float = -0.4) -> DataFrame:
    """step_forward: the row before a peak of tail velocity of ``forward`` and more; step_backward: the second of five rows is the least, at most ``backward``."""
    v = F.col("tail_vel_forward")
    turn = F.signum(w.after(v, 2) - w.after(v, 1)) - F.signum(w.after(v, 1) - v)
    five = F.collect_list(F.struct(v.alias("v"))).over(w.track().rowsBetween(0, 4))
    least = F.array_min(F.transform(five, lambda s: s["v"]))
    second = (F.size(five) == 5) & (F.array_position(F.transform(five, lambda s: s["v"]), least) == 2)
    return df.withColumns({"step_forward": F.coalesce((turn == -2) & ~F.coalesce(v < forward, F.lit(False)), F.lit(False)), "step_backward": F.coalesce(second & ~F.coalesce(v > backward, F.lit(False)), F.lit(False))})


#: The columns that ``with_steps`` reads.
STEPS = ("id", "frame", "run_flag", "tail_vel_forward", "tail_vector_x", "tail_vector_y", "heading_angle", "midpoint_distance", "midpoint_speed", "spine_length")


def _candidate() -> Column:
    return F.col("step_forward") | F.col("step_backward")


def _with_pairs(df: DataFrame, totals: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Add the pairs of successive candidates that both lie in runs: _paired on the row where one starts (_next has the row where it
    ends), _ended (its start) on the row where it ends, _of (start, end) of the pair that started last, and _n, the pairs of the
    track. ``totals`` and ``lasts`` are stitched with the first sums."""
    df = with_row(df)
    take = ["row", "frame", "run_flag", "tail_vector_x", "tail_vector_y", "heading_angle", "midpoint_distance"]
    candidate = _candidate()
    sums = {"_total": F.coalesce("midpoint_speed", F.lit(0.0)), "_counted": F.col("midpoint_speed").isNotNull().cast("int")}
    df = segments.stitched(df, totals=totals, sums=sums, lasts=lasts)
    df = segments.stitched(df, nexts={"_next": F.when(candidate, F.struct(*take, "_total", "_counted"))})
    df = df.withColumn("_next", F.when(candidate, w.after("_next")))
    df = df.withColumn("_paired", F.coalesce(candidate & F.col("run_flag") & F.col("_next")["run_flag"], F.lit(False)))
    before = F.when(candidate, F.struct(F.when(F.col("_paired"), F.col("row")).alias("row")))
    of = F.when(F.col("_paired"), F.struct(F.col("row").alias("start"), F.col("_next")["row"].alias("end")))
    df = segments.stitched(df, totals={"_n": F.count(F.when(F.col("_paired"), 1))}, lasts={"_ended": before, "_of": of})
    return df.withColumn("_ended", F.when(candidate, w.before("_ended")["row"]))


def _pair(frame_rate: float) -> Column:
    """The end and the measures of the pair that starts on a row; null where none does. After all stitches, so that only what is
    asked for is worked out."""
    next_, here = (lambda c: F.col("_next")[c]), F.col("midpoint_speed")
    # sums up to both ends, the first row included
    speed = F.try_divide(next_("_total") - F.col("_total") + F.coalesce(here, F.lit(0.0)), next_("_counted") - F.col("_counted") + here.isNotNull().cast("int"))
    pair = F.struct(
        next_("row").alias("end"),
        g.clockwise_angle_of_steps(next_("tail_vector_x"), next_("tail_vector_y"), "tail_vector_x", "tail_vector_y").alias("IS_angle"),
        (F.abs("heading_angle") - F.abs(next_("heading_angle"))).alias("IS_reorientation"),
        ((next_("frame") - F.col("frame")) / frame_rate).alias("IS_interval"),
        (next_("midpoint_distance") - F.col("midpoint_distance")).alias("IS_distance"),
        speed.alias("run_speed"),
    )
    return F.when(F.col("_paired"), pair)


_PAIRS = ["_total", "_counted", "_next", "_paired", "_ended", "_of", "_n"]


def steps_of(df: DataFrame, frame_rate: float = 16) -> DataFrame:
    """Pairs of successive candidates that both lie in runs: (id, start, end, IS_* measures, run_speed, n_steps)."""
    pairs = _with_pairs(df).where("_paired").withColumn("_pair", _pair(frame_rate))
    return pairs.select("id", F.col("row").alias("start"), "_pair.*", F.col("_n").alias("n_steps")).withColumn("Abs_IS_angle", F.abs("IS_angle"))


def _second_least(values: list[Column]) -> Column:
    """The second of the values is the least of those that are not null, and none before it is as small."""
    some = F.array(*values)
    return F.coalesce(F.array_position(some, F.array_min(some)) == 2, F.lit(False))


def _with_minima(df: DataFrame) -> DataFrame:
    """Add step_extr on rows where a pair starts (_paired): the local minima of tail velocity within it.

    Pairs of over five rows: rows whose smoothed (3 rows) difference is the least of five as their second; over two rows:
    whose velocity is the second and least of three; shorter: null.
    """
    # a row is of the pair that started last; the end row, which may start another, ends windows that reach to it
    df = df.withColumn("_of", F.when(F.col("row") < F.col("_of")["end"], F.col("_of")))
    start, end, v = F.col("_of")["start"], F.col("_of")["end"], F.col("tail_vel_forward")
    df = df.withColumn("_d", w.after(v) - v)
    inner = (F.col("row") > start) & (F.col("row") < end - 1)
    df = df.withColumn("_s", F.when(inner & w.before("_d").isNotNull() & F.col("_d").isNotNull() & w.after("_d").isNotNull(), F.avg("_d").over(w.track().rowsBetween(-1, 1))))
    five = (F.col("row") + 4 <= end) & _second_least([F.col("_s"), *[w.after("_s", k) for k in range(1, 5)]])
    three = (F.col("row") + 2 <= end) & _second_least([v, w.after(v, 1), w.after(v, 2)])
    df = df.withColumns({"_five": F.coalesce(five, F.lit(False)).cast("int"), "_three": F.coalesce(three, F.lit(False)).cast("int")})
    df = segments.by_group(df.withColumn("_key", start), ["_key"], F.col("_key").isNotNull(), {"_fives": F.sum("_five"), "_threes": F.sum("_three")})
    rows = end - start + 1
    n = F.when(rows > 5, F.col("_fives")).when(rows > 2, F.col("_threes"))
    return df.withColumn("step_extr", F.when(F.col("_paired"), n)).drop("_d", "_s", "_five", "_three", "_fives", "_threes", "_key")


def _minima_class(n: Column) -> Column:
    return F.when(n > 2, ">2").otherwise(n.cast("string"))


def local_minima(df: DataFrame, frame_rate: float = 16) -> DataFrame:
    """Per step the number of local minima of tail velocity and its class: (id, start, end, step_extr, minima, gt_1min).

    df: a track with step candidates and run_flag. gt_1min is false for exactly one minimum.
    """
    steps = _with_minima(_with_pairs(df)).where("_paired")
    return steps.select("id", F.col("row").alias("start"), F.col("_next.row").alias("end"), "step_extr", _minima_class(F.col("step_extr")).alias("minima"), (F.col("step_extr") != 1).alias("gt_1min"))


def with_steps(df: DataFrame, frame_rate: float = 16, forward: float = 0.6, backward: float = -0.4) -> DataFrame:
    """Add step_boolean (end rows), run_direction and inter-step measures (start rows); all null with two steps or fewer."""
    df = with_step_candidates(with_row(df), forward, backward)
    kind = F.when(F.col("step_backward"), -1).when(F.col("step_forward"), 1)
    totals = {"_last": F.max(F.when(kind.isNotNull(), F.col("row"))), "_length": F.avg("spine_length")}
    df = _with_pairs(df, totals, {"_way": kind})
    many = F.col("_n") > 2
    df = df.withColumns({"_paired": many & F.col("_paired"), "_ended": F.when(many, F.col("_ended")), "_of": F.when(many, F.col("_of"))})
    # a pair ends on the next candidate's row, which starts a pair of its own, but for the last one
    way = F.when(F.col("row") < F.col("_last"), F.col("_way")).otherwise(w.before("_way"))
    run = F.when(F.col("run_flag"), F.when(F.col("row") <= F.col("_last"), F.coalesce(way, F.lit(1))).otherwise(1)).otherwise(0)
    df = df.withColumns({"run_direction": F.when(many, run), "step_boolean": F.col("_ended").isNotNull()})
    df = _with_minima(df).withColumn("_pair", _pair(frame_rate))
    measures = ["IS_angle", "IS_reorientation", "IS_interval", "IS_distance", "run_speed"]
    df = df.withColumns({c: F.col("_pair")[c] for c in measures} | {"minima": _minima_class(F.col("step_extr")), "gt_1min": F.col("step_extr") != 1})
    df = df.withColumn("Abs_IS_angle", F.abs("IS_angle"))
    df = df.withColumns({"IS_distance_bl": F.try_divide(F.col("IS_distance"), F.col("_length")), "run_speed_bl": F.try_divide(F.col("run_speed"), F.col("_length"))})
    return df.drop(*_PAIRS, "_pair", "_last", "_way", "_length")


def with_flanks(df: DataFrame, frame_rate: int = 16, filter_seconds: int = 5, interval_seconds: int = 5) -> DataFrame:
    """flanks: 1 where the long-run direction of the tail turns from backward or rest to forward for good, -1 mirrored, else 0."""
    n, m = frame_rate * filter_seconds, frame_rate * interval_seconds
    df = df.withColumn("_v", w.centred_median("tail_vel_forward_bl", n))
    df = df.withColumn("_v", F.when(F.abs("_v") < 0.03, F.lit(0.0)).otherwise(F.col("_v")))
    df = df.withColumn("_s", F.signum(w.centred("_v", n)))
    df = df.withColumn("_d", F.col("_s") - w.before("_s")).withColumn("_z", F.coalesce("_s", F.lit(0.0)))
    low, high = (lambda a, b: F.min("_z").over(w.track().rowsBetween(a, b))), (lambda a, b: F.max("_z").over(w.track().rowsBetween(a, b)))
    whole = F.count(F.lit(1)).over(w.track().rowsBetween(1, m)) == m
    down = F.col("_d").isin(-1.0, -2.0) & (low(-m, -1) >= 0) & (high(1, m) == -1) & whole
    up = F.col("_d").isin(1.0, 2.0) & (high(-m, -1) <= 0) & (low(1, m) == 1) & whole
    return df.withColumn("flanks", F.when(down, -1).when(up, 1).otherwise(0)).drop("_v", "_d", "_s", "_z")


def with_switching_points(df: DataFrame, frame_rate: int = 16, seconds: int = 10) -> DataFrame:
    """back_to_for: the sign of the rolling mean of tail velocity turns from -1 to 1; null at the ends, and for tracks of
    less than twice the window."""
    n = frame_rate * seconds
    df = df.withColumn("_m", F.signum(w.centred("tail_vel_forward", n)))
    long = segments.track_rows() >= 2 * n
    return df.withColumn("back_to_for", F.when(long, F.col("_m") - w.before("_m") == 2)).drop("_m")


def interval_difference(df: DataFrame, intervals: DataFrame, value: str, how, name: str) -> DataFrame:
    """(id, start, end, name): ``how`` of the value at the first and the last row of each interval, any Column function."""
    at = lambda c: with_row(df).select("id", F.col("row").alias(c), F.col(value).alias(f"{value}_{c}"))
    both = intervals.select("id", "start", "end").join(at("start"), ["id", "start"]).join(at("end"), ["id", "end"])
    return both.select("id", "start", "end", how(F.col(f"{value}_start"), F.col(f"{value}_end")).alias(name))


def with_events(df: DataFrame, frame_rate: int = 16, **casts) -> DataFrame:
    """The whole event chain on an analysed frame table."""
    df = with_head_casts(df, **casts)
    return with_flanks(with_steps(with_run_flag(df, frame_rate), frame_rate), frame_rate)


def event_markers(df: DataFrame, frame_rate: float = 16) -> DataFrame:
    """Long table (id, kind, seconds) of head casts by side, steps and flanks."""
    t = (F.col("frame") / frame_rate).alias("seconds")
    kinds = {"hc_left": "HCs = 1 AND HCs_left = 1", "hc_right": "HCs = 1 AND HCs_right = 1", "step": "step_boolean", "to_forward": "flanks = 1", "to_backward": "flanks = -1"}
    kind = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(k)) for k, test in kinds.items()]))
    return df.select("id", F.explode(kind).alias("kind"), t)
