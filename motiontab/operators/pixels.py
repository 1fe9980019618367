"""Detection of objects on pixel tables (video, frame, x, y, grey 0 to 255)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.operators.saving import saved

PIXEL, FRAME = ["video", "x", "y"], ["video", "frame"]


def clipped(value: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), value))


def min_background(pixels: DataFrame, frames: int = 100, step: int = 10) -> DataFrame:
    """Least grey of each pixel over ``frames`` frames, every ``step``-th one."""
    return pixels.where((F.col("frame") % step == 0) & (F.col("frame") < frames * step)).groupBy(*PIXEL).agg(F.min("grey").alias("background"))


def mean_background(pixels: DataFrame) -> DataFrame:
    """Mean grey of each pixel, stretched to 0..255 over the video."""
    mean = pixels.groupBy(*PIXEL).agg(F.avg("grey").alias("m"))
    ends = mean.groupBy("video").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    return mean.join(ends, "video").select(*PIXEL, F.coalesce(F.round(F.try_divide((F.col("m") - F.col("a")) * 255, F.col("b") - F.col("a"))), F.lit(0.0)).alias("background"))


def first_frame_background(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(background of frame 0, the other frames numbered from 0)."""
    return pixels.where("frame = 0").select(*PIXEL, F.col("grey").alias("background")), pixels.where("frame > 0").withColumn("frame", F.col("frame") - 1)


def with_replaced_frames(pixels: DataFrame, threshold: float) -> DataFrame:
    """Frames too far from the last kept one (root of summed squares over pixels * threshold) show that one instead.

    A frame is kept when it is near the last kept frame before it; the first of a video is. Distances are taken to the
    frame that is thought to be the last kept one, and again where that changes, until nothing does: rounds grow with the
    breaks in a row, not with the frames, and every round compares all videos at once.
    """
    names = [*FRAME, "ref"]
    back = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)

    def measured(pairs: DataFrame) -> DataFrame:
        """pairs with near: the frame's distance to ref is small enough."""
        new = pairs.join(pixels, FRAME)
        old = pixels.select("video", F.col("frame").alias("ref"), "x", "y", F.col("grey").alias("old"))
        gap = F.coalesce(F.col("grey") - F.col("old"), F.lit(0)).cast("double")
        sums = new.join(old, ["video", "ref", "x", "y"], "left").groupBy(*names).agg(F.sqrt(F.sum(gap * gap)).alias("d"), F.count("*").alias("n"))
        return sums.select(*names, (F.col("d") <= F.col("n") * threshold).alias("near"))

    frames = pixels.select(*FRAME).distinct()
    before = F.max("frame").over(back)
    plan = frames.withColumn("ref", before)
    known = saved(measured(plan.where("ref IS NOT NULL")))
    while True:
        plan = saved(plan.join(known, names, "left").select(*names, F.coalesce("near", F.col("ref").isNull()).alias("near")))
        ref = F.max(F.when(F.col("near"), F.col("frame"))).over(back)
        again = saved(plan.withColumn("next", ref))
        changed = again.where("next <> ref").select(*FRAME, F.col("next").alias("ref"))
        if changed.isEmpty():
            break
        known = saved(known.unionAll(measured(changed.join(known, names, "left_anti"))))
        plan = again.select(*FRAME, F.col("next").alias("ref"))
    shown = plan.select(*FRAME, F.when(F.col("near"), F.col("frame")).otherwise(F.col("ref")).alias("shown"))
    return shown.join(pixels.withColumnRenamed("frame", "shown"), ["video", "shown"]).select("video", "frame", "x", "y", "grey")


def adjusted(pixels: DataFrame, contrast: float = 1.0, brightness: float = 255.0, gamma: float = 1.0, invert: bool = False) -> DataFrame:
    g = F.col("grey").cast("double")
    if contrast != 1.0 or brightness != 255.0:
        g = F.round(clipped(contrast * g + (brightness - 255)))
    if gamma != 1.0:
        g = F.floor(clipped(F.pow(g, F.lit(gamma)))).cast("double")
    return pixels.withColumn("grey", (255 - g if invert else g).cast("int"))


def stretched(pixels: DataFrame) -> DataFrame:
    """Grey values to 0..255 over each frame."""
    w = Window.partitionBy(*FRAME)
    return pixels.withColumn("grey", F.coalesce(F.floor(F.try_divide((F.col("grey") - F.min("grey").over(w)) * 255.0, F.max("grey").over(w) - F.min("grey").over(w))), F.lit(0)).cast("int"))


def mean_clamped(pixels: DataFrame) -> DataFrame:
    """Values below the frame's mean rise to it (whole part), then the frame is stretched."""
    return stretched(pixels.withColumn("grey", F.greatest(F.col("grey"), F.floor(F.avg("grey").over(Window.partitionBy(*FRAME))).cast("int"))))


def subtracted(pixels: DataFrame, background: DataFrame, weight: float = -1.0) -> DataFrame:
    """grey + weight * background, not below 0, stretched."""
    both = pixels.join(background, PIXEL)
    return stretched(both.withColumn("grey", F.round(clipped(F.col("grey") + weight * F.col("background"))).cast("int")).select(*FRAME, "x", "y", "grey"))


def inside_circle(pixels: DataFrame, circle: tuple[float, float, float] | None) -> DataFrame:
    """Grey 0 outside (cx, cy, radius)."""
    if circle is None:
        return pixels
    cx, cy, r = circle
    return pixels.withColumn("grey", F.when(F.pow(F.col("x") - F.lit(cx), F.lit(2.0)) + F.pow(F.col("y") - F.lit(cy), F.lit(2.0)) <= r * r, F.col("grey")).otherwise(0))


def otsu(pixels: DataFrame) -> DataFrame:
    """(video, frame, threshold): the grey value that parts a frame's histogram with the greatest variance between classes."""
    counts = pixels.groupBy(*FRAME, "grey").agg(F.count("*").alias("n"))
    so_far, whole = Window.partitionBy(*FRAME).orderBy("grey").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*FRAME)
    n, s = F.col("n").cast("double"), (F.col("n") * F.col("grey")).cast("double")
    parts = counts.select(*FRAME, "grey", F.sum(n).over(so_far).alias("w0"), F.sum(s).over(so_far).alias("s0"), F.sum(n).over(whole).alias("w"), F.sum(s).over(whole).alias("s"))
    between = F.coalesce(F.try_divide(F.pow(F.col("s0") * F.col("w") - F.col("s") * F.col("w0"), F.lit(2.0)), F.col("w0") * (F.col("w") - F.col("w0"))), F.lit(0.0))
    return parts.groupBy(*FRAME).agg(F.max_by("grey", F.struct(between, -F.col("grey"))).alias("threshold"))


def foreground(pixels: DataFrame) -> DataFrame:
    """Pixels strictly above their frame's threshold."""
    return pixels.join(otsu(pixels), FRAME).where("grey > threshold").drop("threshold")


def dilated(front: DataFrame, pixels: DataFrame) -> DataFrame:
    """Foreground grown to the four neighbours that exist in ``pixels``, with their grey."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    grown = front.select(*FRAME, "x", "y", steps.alias("s")).select(*FRAME, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).distinct()
    return pixels.join(grown, [*FRAME, "x", "y"], "left_semi")


def remasked(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """``pixels`` with grey 0 outside the pixels of ``mask``."""
    inside = mask.select(*FRAME, "x", "y", F.lit(True).alias("_in")).distinct()
    return pixels.join(inside, [*FRAME, "x", "y"], "left").withColumn("grey", F.when(F.col("_in"), F.col("grey")).otherwise(0)).drop("_in")


def _runs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run of each pixel, component of each run) of one frame's pixels in the order of (y, x)."""
    first = np.append(True, (np.diff(y) != 0) | (np.diff(x) > 1))
    run = np.cumsum(first) - 1
    width = int(x.max() - x.min()) + 4
    place = (y - y.min()) * width + x - x.min() + 1
    start, end = place[first], place[np.append(first[1:], True)]
    # runs of the next row that touch a run, corners included, follow each other
    low, high = np.searchsorted(end, start + width - 1, "left"), np.searchsorted(start, end + width + 1, "right")
    n = np.maximum(0, high - low)
    a = np.repeat(np.arange(len(start)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    component = np.arange(len(start))
    while True:
        least = component.copy()
        np.minimum.at(least, a, component[b])
        np.minimum.at(least, b, component[a])
        least = least[least]
        if (least == component).all():
            return run, component
        component = least


def labelled(front: DataFrame) -> DataFrame:
    """Pixels above zero with a component (8-neighbour, within their frame) as the least pixel position in it.

    One shuffle by (video, frame); a task holds a frame at a time.
    """

    def components(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x", "ascending")])
        x, y = (np.array(table.column(c), dtype=np.int64) for c in "xy")
        run, component = _runs(x, y)
        of = component[run]
        span = y.max() - y.min() + 1
        place = x * span + (y - y.min())
        least = np.full(len(component), place.max() + 1)
        np.minimum.at(least, of, place)
        out = table.select([*FRAME, "x", "y"])
        for name, values in (("cx", least[of] // span), ("cy", least[of] % span + y.min())):
            out = out.append_column(name, pa.array(values).cast(table.schema.field("x").type))
        return out

    rows = (front.where("grey > 0") if "grey" in front.columns else front).select(*FRAME, "x", "y").distinct()
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*FRAME, "x", "y"]) + f", cx {kinds['x']}, cy {kinds['x']}"
    found = rows.groupBy(*FRAME).applyInArrow(components, schema)
    return found.select(*FRAME, "x", "y", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")).alias("c"))


def blobs(components: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(video, frame, label, area, cx, cy, minx, maxx, miny, maxy) of components with an area in the closed range, labels from 1."""
    found = components.groupBy(*FRAME, "c").agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"))
    found = found.where(F.col("area").between(least, most if most is not None else 2**62))
    return found.withColumn("label", F.row_number().over(Window.partitionBy(*FRAME).orderBy("c"))).drop("c")


def away_from_rim(found: DataFrame, radius: float, cx: float = 0.0, cy: float = 0.0, share: float = 0.95) -> DataFrame:
    """Objects whose centre lies within ``share`` of the dish's radius."""
    return found.where(F.pow(F.col("cx") - F.lit(cx), F.lit(2.0)) + F.pow(F.col("cy") - F.lit(cy), F.lit(2.0)) <= (share * radius) ** 2)


def detect(pixels: DataFrame, circle: tuple[float, float, float] | None = None, least: int = 20, most: int = 2000, weight: float = -1.0, max_frames: int | None = None) -> DataFrame:
    """Blobs of every frame against the offline background: what is above zero in the image masked by the grown foreground."""
    if max_frames is not None:
        pixels = pixels.where(F.col("frame") < max_frames)
    clean = inside_circle(subtracted(mean_clamped(pixels), min_background(pixels), weight), circle)
    return blobs(labelled(dilated(foreground(clean), clean)), least, most)  # the mask keeps grey, labels take what is not zero
