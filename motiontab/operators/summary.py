"""Summaries of an analysed frame table per animal or per dish, as one aggregation per table of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.functions import segments
from motiontab.functions.geometry import rescale

SIGNED = ("bending_angle", "bearing_angle", "heading_angle", "head_vector_angular_speed", "tail_vector_angular_speed", "head_vel_forward", "tail_vel_forward", "midpoint_speed", "odor_speed", "distance_to_odor")
NORMALISED = ("midpoint_speed", "head_vel_forward", "tail_vel_forward")
ACCELERATED = ("midpoint_speed", "head_vel_forward", "tail_vel_forward", "head_vector_angular_speed", "tail_vector_angular_speed")
SHAPE = ("area", "grey", "spine_length", "width", "perimeter")
STEPS = ("IS_angle", "Abs_IS_angle", "IS_reorientation", "IS_interval", "IS_distance", "IS_distance_bl", "run_speed")


def keys_of(by: str) -> list[str]:
    if by not in ("id", "trial"):
        raise ValueError("summaries are by id or by trial")
    return [by, "group", "condition", "group_condition"]


def with_group_condition(df: DataFrame) -> DataFrame:
    return df.withColumn("group_condition", F.concat_ws("-", "group", "condition"))


def direction_test(direction: str | None) -> Column:
    """forwards, backwards, both; None or 'none' passes every row."""
    ways = {"forwards": [1], "backwards": [-1], "both": [1, -1]}
    return F.col("run_direction").isin(ways[direction]) if direction in ways else F.lit(True)


def filtered(df: DataFrame, seconds: Sequence[float] | None = None, odor: Sequence[float] | None = None, bearing: Sequence[float] | None = None, direction: str | None = None, frame_rate: float = 16, drop_flips: bool = False) -> DataFrame:
    """Closed intervals of time, distance to the odour and absolute bearing, run direction, and no flipped rows."""
    if seconds:
        df = df.where(F.col("frame").between(seconds[0] * frame_rate, seconds[1] * frame_rate))
    if odor:
        df = df.where(F.col("distance_to_odor").between(*odor))
    if bearing:
        df = df.where(F.abs("bearing_angle").between(*bearing))
    if drop_flips:
        df = df.where(~F.col("na_flag_flip"))
    return df.where(direction_test(direction))


def accepted(df: DataFrame, threshold: float = 90, frame_rate: float = 16) -> DataFrame:
    """Rows of tracks with more than threshold seconds."""
    long = df.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > frame_rate * threshold).select("id")
    return df.join(long, "id", "left_semi")


def acceptance(df: DataFrame, threshold: float, frame_rate: float = 16) -> DataFrame:
    """One row: shares of ids and of frames in accepted tracks, in percent."""
    n = df.groupBy("id").agg(F.count("*").alias("n"))
    good = F.col("n") > frame_rate * threshold
    return n.agg((100.0 * F.avg(good.cast("double"))).alias("ids_percent"), (100.0 * F.sum(F.when(good, F.col("n")).otherwise(0)) / F.sum("n")).alias("frames_percent"))


def pair(name: str, c: Column) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.var_samp(c).alias(f"{name}_var")]


def time_series(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """The table with differences of successive rows of a key, and the aggregates over it."""
    order = Window.partitionBy(*keys).orderBy("id", "frame")
    df = df.withColumns({f"_d_{c}": F.lead(c).over(order) - F.col(c) for c in ACCELERATED if c in df.columns})
    out = [a for c in SIGNED if c in df.columns for a in pair(c, F.col(c))]
    out += [a for c in SIGNED[:5] if c in df.columns for a in pair(f"abs_{c}", F.abs(c))]
    out += [a for c in ACCELERATED if c in df.columns for a in pair(f"{c}_diff", F.col(f"_d_{c}"))]
    mean = F.avg("spine_length")
    for c in NORMALISED:
        out += [F.try_divide(F.avg(c), mean).alias(f"{c}_bl_mean"), F.try_divide(F.var_samp(c), mean * mean).alias(f"{c}_bl_var")]
    # null if any row of the key lacks it
    far = F.when(F.count("midpoint_distance") == F.count(F.lit(1)), F.max("midpoint_distance"))
    out += [far.alias("midpoint_distance_max"), F.try_divide(far, mean).alias("midpoint_distance_bl_max")]
    if "distance_to_sp" in df.columns:
        out += [F.avg("distance_to_sp").alias("distance_to_sp_mean"), F.max("distance_to_sp").alias("distance_to_sp_max")]
    return df, out


def track_shape(frame_rate: float = 16) -> list[Column]:
    last = lambda k: (F.max(F.when(F.col("flanks") == k, F.struct("id", "frame")))["frame"] / frame_rate)
    return [a for c in SHAPE for a in pair(c, F.col(c))] + [F.count_if(F.col("collision_flag") != 0).alias("collisions"), last(1).alias("last_to_forward"), last(-1).alias("last_to_backward")]


def head_casts(sizes: Sequence[float] = (20, 360)) -> list[Column]:
    """Counts over rows with a head cast in the size range; rates are per frame of an orientation."""
    cast = F.col("Abs_HC_angle").between(*sizes)
    of = lambda c: F.when(cast, F.col(c))
    n = lambda side: F.coalesce(F.sum(F.when(cast & (F.col("odor_orientation") == side), F.col("HCs"))), F.lit(0))
    frames = lambda side: F.count_if(F.col("odor_orientation") == side)
    rate = lambda side: F.try_divide(n(side), frames(side))
    total = F.coalesce(F.sum(of("HCs")), F.lit(0))
    return [
        *[a for c in ("HC_angle", "Abs_HC_angle", "HC_reorientation") for a in pair(c, of(c))],
        total.alias("HCs"),
        n("towards").alias("HCs_towards"),
        n("away").alias("HCs_away"),
        F.coalesce(F.try_divide(total, F.count(F.lit(1))), F.lit(0.0)).alias("HC_rate"),
        F.try_divide(rate("away") - rate("towards"), rate("away") + rate("towards")).alias("HC_rate_modulation"),
    ]


def runs() -> list[Column]:
    """Step measures over the rows where steps end."""
    step = lambda c: F.when(F.col("step_boolean"), F.col(c))
    side = lambda s: F.avg(F.when(F.col("step_boolean") & (F.col("odor_orientation") == s), F.col("run_speed")))
    more = F.coalesce(F.sum(F.when(F.col("step_boolean"), F.col("gt_1min").cast("int"))), F.lit(0))
    length = F.avg(step("spine_length"))
    return [
        *[a for c in STEPS for a in pair(c, step(c))],
        F.try_divide(F.avg(step("run_speed")), length).alias("run_speed_bl_mean"),
        F.try_divide(F.var_samp(step("run_speed")), length * length).alias("run_speed_bl_var"),
        F.try_divide(side("towards") - side("away"), side("towards") + side("away")).alias("run_speed_modulation"),
        F.avg(step("step_extr")).alias("step_extr_mean"),
        # of all steps, also those whose minima are not known
        (1 - F.try_divide(more, F.count_if(F.col("step_boolean")))).alias("one_minimum_share"),
    ]


def preference(radius: float = 42.5) -> list[Column]:
    y = F.col("spinepoint_y_6_conv")
    n = F.count(F.lit(1))
    all_known = F.count("odor_orientation") == n
    return [
        F.try_divide(F.count_if(y > 0) - F.count_if(y < 0), n).alias("preference"),
        rescale(F.avg("distance_to_odor"), radius).alias("preference_distance"),
        F.when(all_known, F.try_divide(F.count_if(F.col("odor_orientation") == "towards"), n)).alias("ratio_towards"),
        F.avg("odor_speed").alias("mean_odor_speed"),
    ]


def distance_gained(df: DataFrame, by: str) -> DataFrame:
    """First minus last known distance to the odour of each animal, averaged over the animals of a key."""
    keys = keys_of(by)
    known = df.where("distance_to_odor IS NOT NULL")
    each = known.groupBy(*dict.fromkeys([*keys, "id", "trial"])).agg((F.min_by("distance_to_odor", "frame") - F.max_by("distance_to_odor", "frame")).alias("gain"))
    return each.groupBy(*keys).agg(F.avg("gain").alias("preference_dist_se"))


def summarised(df: DataFrame, by: str = "id", threshold: float = 90, frame_rate: float = 16, sizes: Sequence[float] = (20, 360), radius: float = 42.5, **intervals) -> DataFrame:
    """One row per key of ``by``, also for keys whose rows are all filtered out (nulls; head-cast counts 0)."""
    keys = keys_of(by)
    if by == "id":
        df = accepted(df, threshold, frame_rate)
    universe = df.select(*keys).distinct()
    rows = filtered(df, frame_rate=frame_rate, **intervals)
    rows, series = time_series(rows, keys)
    out = rows.groupBy(*keys).agg(*series, *track_shape(frame_rate), *head_casts(sizes), *runs(), *preference(radius))
    out = universe.join(out, keys, "left").join(distance_gained(df, by), keys, "left")
    return out.fillna(0, ["HCs", "HCs_towards", "HCs_away", "HC_rate"])


def selected(df: DataFrame, groups: Sequence[str] | None = None, variables: Sequence[str] | None = None, keys: Sequence[str] = ("id", "trial", "group", "condition", "group_condition")) -> DataFrame:
    """Rows of the ticked groups with the chosen variables beside the keys; None keeps all. Variables the table lacks are left out."""
    if groups is not None:
        df = df.where(F.col("group_condition").isin(list(groups)))
    if variables is None:
        return df
    return df.select(*[c for c in df.columns if c in keys or c in variables])


def selectable_tracks(df: DataFrame, threshold: float = 90, frame_rate: float = 16) -> DataFrame:
    """Distinct (id, name, trial, condition, group) of tracks with more than threshold seconds."""
    return accepted(df, threshold, frame_rate).select("id", "name", "trial", "condition", "group").distinct()


def end_points(df: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """(id, x, y): the last known midpoint of each selected track."""
    known = df.where("spinepoint_x_6_conv IS NOT NULL AND spinepoint_y_6_conv IS NOT NULL")
    known = known if ids is None else known.where(F.col("id").isin(list(ids)))
    last = F.max_by(F.struct(F.col("spinepoint_x_6_conv").alias("x"), F.col("spinepoint_y_6_conv").alias("y")), "frame")
    return known.groupBy("id").agg(last.alias("p")).select("id", "p.x", "p.y")


PER_STEP = ("group", "condition", "group_condition", "trial", "id")


def per_step(df: DataFrame) -> DataFrame:
    """A row per animal and number of steps so far (step_count): n rows, all time-series measures over them, and the step
    measures of the row where the step ends. is_silly_step: that step has more than one minimum; null before the first."""
    keys = [*PER_STEP, "step_count"]
    counted = segments.running(df, {"step_count": F.col("step_boolean").cast("int")})
    # steps are dealt out by a number of partitions, which Spark does not join to fewer, larger ones
    counted = counted.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows, series = time_series(counted, keys)
    ends = F.col("step_boolean")
    silly = F.when(F.count_if(ends) > 0, F.coalesce(F.sum(F.when(ends, F.col("step_extr"))), F.lit(0)) > 1)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *series, *runs(), silly.alias("is_silly_step"))


def per_minima_class(df: DataFrame) -> DataFrame:
    """A row per animal and class of minima (0, 1, 2, >2, and null for rows where no step starts), completed to every pair with n = 0:
    n rows, all time-series measures over them, and the step measures over those of them where a step ends."""
    kind = F.when(F.col("step_extr") > 2, ">2").otherwise(F.col("step_extr").cast("string"))
    rows, series = time_series(df.withColumn("minima", kind), [*PER_STEP, "minima"])
    found = rows.groupBy(*PER_STEP, "minima").agg(F.count("*").alias("n"), *series, *runs())
    classes = F.broadcast(rows.select(F.col("minima").alias("_minima")).distinct())  # five at most
    every = df.select(F.col("id").alias("_id")).distinct().crossJoin(classes)
    out = every.join(found, (F.col("id") == F.col("_id")) & F.col("minima").eqNullSafe(F.col("_minima")), "left")
    return out.drop("id", "minima").withColumnsRenamed({"_id": "id", "_minima": "minima"}).fillna(0, ["n"])
