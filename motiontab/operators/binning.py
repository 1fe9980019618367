"""Binned series with confidence limits, heat maps and histograms."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.functions.geometry import rescale
from motiontab.operators.saving import saved
from motiontab.operators.stats import t_quantiles
from motiontab.operators.summary import filtered


def binned(df: DataFrame, variable: str, width: float, frame_rate: float = 16, drop_null_bin: bool = False) -> DataFrame:
    """Add bin (1-based) and midpoint: intervals (low, high] of ``width`` from the least value on.

    The least value and what lies above the last whole interval have a null bin. ``frame`` takes widths in seconds and
    midpoints are in seconds.
    """
    step, scale = (width * frame_rate, frame_rate) if variable == "frame" else (width, 1.0)
    edges = F.broadcast(df.agg(F.min(variable).cast("double").alias("_low"), F.max(variable).cast("double").alias("_high")))  # one row
    x = F.col(variable).cast("double")
    k = F.ceil((x - F.col("_low")) / step).cast("int")
    whole = F.floor((F.col("_high") - F.col("_low")) / step).cast("int")
    df = df.crossJoin(edges).withColumn("bin", F.when((k >= 1) & (k <= whole), k))
    df = df.withColumn("midpoint", (F.col("_low") + (F.col("bin") - 0.5) * step) / scale).drop("_low", "_high")
    return df.where("bin IS NOT NULL") if drop_null_bin else df


def empty_bins(df: DataFrame) -> int:
    """Bins between 1 and the highest that no row has."""
    r = df.agg(F.max("bin").alias("high"), F.countDistinct("bin").alias("n")).first()
    return (r.high or 0) - r.n


def checked(df: DataFrame) -> DataFrame:
    """``df``, or an error if one of its bins is empty."""
    if n := empty_bins(df):
        raise ValueError(f"{n} bins are empty. Try a higher width.")
    return df


def time_bins(df: DataFrame, width: float = 10, end: float = 180, frame_rate: float = 16) -> DataFrame:
    """Add bin, 1-based intervals (low, high] of ``width`` seconds from 0 to ``end`` (null outside), and bin_id, the row in its bin of the track."""
    t = F.col("frame") / frame_rate
    bin_ = F.when((t > 0) & (t <= end), F.ceil(t / width).cast("int"))
    df = df.withColumn("bin", bin_)
    return df.withColumn("bin_id", F.row_number().over(Window.partitionBy("id", "bin").orderBy("frame")))


def mean_ci(name: str, c: Column) -> list[Column]:
    """Pieces that ``with_limits`` turns into mean and confidence limits."""
    return [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_sd"), F.count(c).alias(f"{name}_n")]


def with_limits(df: DataFrame, names: Sequence[str], level: float = 0.95) -> DataFrame:
    """name_lowCI and name_hiCI: mean -+ t * sd / sqrt(n), null for n < 2. The quantile is read on the few binned rows."""
    df = df.withColumn("_t", t_quantiles([F.col(f"{name}_n") - 1 for name in names], (1 + level) / 2))
    new = {}
    for k, name in enumerate(names):
        half = F.col("_t")[k] * F.col(f"{name}_sd") / F.sqrt(F.col(f"{name}_n"))
        new |= {f"{name}_lowCI": F.col(f"{name}_mean") - half, f"{name}_hiCI": F.col(f"{name}_mean") + half}
    return df.withColumns(new).drop("_t", *[f"{name}_{c}" for name in names for c in ("sd", "n")])


KEYS = ("group_condition", "bin", "midpoint")
ANGLES = ("bearing_angle", "heading_angle", "bending_angle", "head_vector_angular_speed", "tail_vector_angular_speed")
TIME_SERIES = (*ANGLES, "head_vel_forward", "tail_vel_forward", "midpoint_speed", "midpoint_distance", "distance_to_odor", "spine_length")
#: Variables that are also given per mean spine length of their row's bin, as <name>_bl.
PER_LENGTH = ("head_vel_forward", "tail_vel_forward", "midpoint_speed", "midpoint_distance")


def size_test(sizes: Sequence[float] | None) -> Column:
    return F.col("Abs_HC_angle").isNull() | F.col("Abs_HC_angle").between(*sizes) if sizes else F.lit(True)


def variables(kind: str, sizes: Sequence[float] | None = (20, 360)) -> Mapping[str, Column]:
    """Columns that get a mean and limits, by kind of table: ts, hc, is, run, pref. Step measures lie on the rows where steps
    start, and all of them count."""
    cast = size_test(sizes)
    return {
        "ts": {**{c: F.col(c) for c in TIME_SERIES}, **{f"abs_{c}": F.abs(c) for c in ANGLES}},
        "hc": {c: F.when(cast, F.col(c)) for c in ("HC_angle", "Abs_HC_angle", "HC_reorientation")},
        "is": {c: F.col(c) for c in ("IS_angle", "Abs_IS_angle", "IS_reorientation", "IS_distance", "IS_distance_bl", "IS_interval")},
        "run": {c: F.col(c) for c in ("run_speed", "run_speed_bl")},
        "pref": {"odor_speed": F.col("odor_speed")},
    }[kind]


def extras(kind: str, sizes: Sequence[float] | None = (20, 360)) -> list[Column]:
    """Counts, rates and shares without limits. The modulation of casts is (towards - away) here, the summary's is mirrored."""
    side = lambda c, s: F.sum(F.when(size_test(sizes) & (F.col("odor_orientation") == s), F.col(c)))
    speed = lambda s: F.avg(F.when(F.col("odor_orientation") == s, F.col("run_speed")))
    change = lambda a, b: F.try_divide(a - b, a + b)
    n = F.count(F.lit(1))
    return {
        "ts": [],
        "hc": [n.alias("N"), F.try_divide(F.sum(F.when(size_test(sizes), F.col("HCs"))), n).alias("HC_rate"), change(side("HCs", "towards"), side("HCs", "away")).alias("HC_rate_modulation")],
        "is": [],
        "run": [change(speed("towards"), speed("away")).alias("run_speed_modulation")],
        "pref": [F.avg("pref").alias("preference")],
    }[kind]


def _share_towards() -> Column:
    towards = F.col("odor_orientation") == "towards"
    return F.try_divide(F.count_if(towards), F.count("odor_orientation"))


def binned_table(df: DataFrame, kinds: Sequence[str] = ("ts", "hc", "is", "run", "pref"), sizes: Sequence[float] | None = (20, 360), radius: float = 42.5) -> DataFrame:
    """One aggregation over all kinds of variables of a binned table; each variable with mean and limits.

    Per length means values over the bin's mean spine length. The preference is the mean of ``pref``; the distance's mean and limits are
    rescaled to -1..1, so its lowCI is the greater one; the share of rows towards the odour is null if one of them is not known.
    """
    named = {k: c for kind in kinds for k, c in variables(kind, sizes).items()}
    aggregates = [a for k, c in named.items() for a in mean_ci(k, c)] + [e for kind in kinds for e in extras(kind, sizes)]
    names = list(named)
    if "ts" in kinds:
        length = F.avg("spine_length")
        for c in PER_LENGTH:
            aggregates += [F.try_divide(F.avg(c), length).alias(f"{c}_bl_mean"), F.try_divide(F.stddev_samp(c), length).alias(f"{c}_bl_sd"), F.count(c).alias(f"{c}_bl_n")]
        names += [f"{c}_bl" for c in PER_LENGTH]
    if "pref" in kinds:
        aggregates += [*mean_ci("preference_distance", F.col("distance_to_odor")), F.when(F.count("odor_orientation") == F.count(F.lit(1)), _share_towards()).alias("ratio_towards")]
        names.append("preference_distance")
    out = with_limits(df.groupBy(*KEYS).agg(*aggregates), names)
    return out.withColumns({f"preference_distance_{c}": rescale(f"preference_distance_{c}", radius) for c in ("mean", "lowCI", "hiCI")}) if "pref" in kinds else out


def binned_by_unit(df: DataFrame, unit: str = "id", kinds: Sequence[str] = ("ts", "hc", "is", "run", "pref"), sizes: Sequence[float] | None = (20, 360), radius: float = 42.5) -> DataFrame:
    """Two levels: means per animal or dish and bin, then mean and limits over these units, N of them.

    The head's velocity per length is the mean of rows' quotients here, other measures are over the unit's mean length; the
    share towards the odour is of rows where it is known.
    """
    if unit not in ("id", "trial"):
        raise ValueError("units are id or trial")
    named = {k: F.avg(c) for kind in kinds for k, c in variables(kind, sizes).items()}
    if "ts" in kinds:
        named |= {f"{c}_bl": F.try_divide(F.avg(c), F.avg("spine_length")) for c in PER_LENGTH}
        named["head_vel_forward_bl"] = F.avg(F.try_divide(F.col("head_vel_forward"), F.col("spine_length")))
    if "pref" in kinds:
        named |= {"preference_distance": rescale(F.avg("distance_to_odor"), radius), "ratio_towards": _share_towards()}
    first = df.groupBy(*KEYS, unit).agg(*[c.alias(k) for k, c in named.items()], *[e for kind in kinds for e in extras(kind, sizes)])
    names = [c for c in first.columns if c not in (*KEYS, unit, "N")]
    second = first.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("N"), *[a for c in names for a in mean_ci(c, F.col(c))])
    return with_limits(second, names)


def binned_series(df: DataFrame, variable: str = "frame", width: float = 10, unit: str | None = None, frame_rate: float = 16, kinds: Sequence[str] = ("ts", "hc", "is", "run", "pref"), seconds=None, odor=None, bearing=None, direction=None, drop_flips: bool = False, **options) -> DataFrame:
    """Filter, bin and tabulate in one call: ``binned_table``, or ``binned_by_unit`` for a unit. An empty bin is an error."""
    rows = filtered(df, seconds, odor, bearing, direction, frame_rate, drop_flips)
    rows = checked(binned(rows, variable, width, frame_rate))
    return binned_by_unit(rows, unit, kinds, **options) if unit else binned_table(rows, kinds, **options)


def as_matrix(grid: DataFrame, bins: int, x: str = "xbin", y: str = "ybin", z: str = "z") -> DataFrame:
    """A long grid as one row for each x with a column for each y from 1 to ``bins``."""
    return grid.groupBy(x).pivot(y, list(range(1, bins + 1))).agg(F.first(z))


def circular_mean_of_bins(df: DataFrame, value: str, bins: int, n: int, circular: bool = False) -> DataFrame:
    """(group_condition, bin, smooth): mean over n neighbouring bins, around the circle if asked, else null at the edges."""
    from motiontab.functions.windows import full

    rows = df.select("group_condition", F.col("bin").alias("frame"), F.col(value).alias("v")).where("frame IS NOT NULL")
    if circular:
        turns = F.explode(F.array(F.lit(-bins), F.lit(0), F.lit(bins)))
        rows = rows.withColumn("turn", turns).withColumn("frame", F.col("frame") + F.col("turn")).drop("turn")
    rows = rows.withColumn("smooth", full(F.col("v"), n, F.avg, n - 1 - n // 2, n // 2, "group_condition"))
    return rows.where(F.col("frame").between(1, bins)).select("group_condition", F.col("frame").alias("bin"), "smooth")


def heat_map(df: DataFrame, x: str, y: str, z: str, bins: int = 50) -> DataFrame:
    """(xbin, ybin, n, z): mean of z on a grid over the ranges of x and y; the upper edge belongs to the last cell."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = F.broadcast(rows.agg(*[f(c).cast("double").alias(f"_{n}") for c, a, b in ((x, "x0", "x1"), (y, "y0", "y1")) for f, n in ((F.min, a), (F.max, b))]))  # one row
    cell = lambda c, lo, hi: F.least(F.lit(bins), F.coalesce(F.floor(F.try_divide((F.col(c) - F.col(lo)) * bins, F.col(hi) - F.col(lo))), F.lit(0)) + 1).cast("int")
    return rows.crossJoin(edges).groupBy(cell(x, "_x0", "_x1").alias("xbin"), cell(y, "_y0", "_y1").alias("ybin")).agg(F.count("*").alias("n"), F.avg(z).alias("z"))


#: Pairs of axes of heat maps; time is in seconds.
AXES = {"dish": ("spinepoint_x_6_conv", "spinepoint_y_6_conv"), "bearing_distance": ("bearing_angle", "distance_to_odor"), "bearing_time": ("bearing_angle", "time"), "time_distance": ("time", "distance_to_odor")}


def named_heat_map(df: DataFrame, axes: str, z: str, bins: int = 50, radius: int = 5, passes: int = 10, frame_rate: float = 16) -> DataFrame:
    """The filtered grid (xbin, ybin, z) of a variable over a pair of ``AXES``.

    HC_rate is the mean of HCs; a name that starts with abs_ or Abs_ is absolute, of its own column or else of the one without that.
    """
    column = "HCs" if z == "HC_rate" else z
    if column[:4].lower() == "abs_":
        column = F.abs(column if column in df.columns else column[4:])
    else:
        column = F.col(column)
    x, y = AXES[axes]
    rows = df.withColumns({"time": F.col("frame") / frame_rate, "_z": column.cast("double")})
    return median_filtered(heat_map(rows, x, y, "_z", bins), bins, radius, passes)


def median_filtered(grid: DataFrame, bins: int, radius: int = 1, passes: int = 1) -> DataFrame:
    """All bins x bins cells, each the median of known cells within ``radius`` on both axes; ``passes`` times."""
    spark = grid.sparkSession
    cells = spark.range(bins * bins).select((F.col("id") % bins + 1).cast("int").alias("xbin"), (F.floor(F.col("id") / bins) + 1).cast("int").alias("ybin"))
    shift = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    for _ in range(passes):
        spread = grid.where("z IS NOT NULL").select("xbin", "ybin", "z", shift.alias("dx")).withColumn("dy", shift)
        spread = spread.select((F.col("xbin") + F.col("dx")).alias("xbin"), (F.col("ybin") + F.col("dy")).alias("ybin"), "z")
        grid = cells.join(spread.groupBy("xbin", "ybin").agg(F.percentile("z", F.lit(0.5)).alias("z")), ["xbin", "ybin"], "left")
        grid = saved(grid) if passes > 1 else grid
    return grid


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ("id",), seconds: Sequence[float] | None = None, frame_rate: float = 16) -> DataFrame:
    """(keys, bin, n): equal-width counts over each key's range, within a time interval."""
    rows = df.where(F.col(value).isNotNull())
    if seconds:
        rows = rows.where(F.col("frame").between(seconds[0] * frame_rate, seconds[1] * frame_rate))
    edges = rows.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    k = F.least(F.lit(bins), F.coalesce(F.floor(F.try_divide((F.col(value) - F.col("_a")) * bins, F.col("_b") - F.col("_a"))), F.lit(0)) + 1).cast("int")
    return rows.join(edges, list(keys)).groupBy(*keys, k.alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, value: str, keys: Sequence[str] = ("id",), points: int = 64, bandwidth: float | None = None) -> DataFrame:
    """(keys, at, density): Gaussian kernel estimate on ``points`` places between each key's extremes.

    Values are first counted on a grid of 16 * points cells, so the kernel meets a bounded number of rows per key.
    """
    rows = df.where(F.col(value).isNotNull())
    stats = rows.groupBy(*keys).agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"), F.stddev_samp(value).alias("_s"), F.count("*").alias("_n"))
    h = F.lit(bandwidth) if bandwidth else F.greatest(F.lit(1e-9), 1.06 * F.coalesce("_s", F.lit(0.0)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    stats = stats.withColumn("_h", h)
    fine = 16 * points
    cell = F.coalesce(F.round(F.try_divide((F.col(value) - F.col("_a")) * fine, F.col("_b") - F.col("_a"))), F.lit(0.0))
    counts = rows.join(stats, list(keys)).groupBy(*keys, "_a", "_b", "_n", "_h", cell.alias("_c")).agg(F.count("*").alias("_w"))
    at = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("k") / (points - 1)
    spots = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    u = (at - F.col("_a") - (F.col("_b") - F.col("_a")) * F.col("_c") / fine) / F.col("_h")
    kernel = F.exp(-u * u / 2) / (F.col("_h") * math.sqrt(2 * math.pi)) * F.col("_w") / F.col("_n")
    return spots.groupBy(*keys, at.alias("at")).agg(F.sum(kernel).alias("density"))
