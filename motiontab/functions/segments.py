"""Long tracks in segments, so that one id with most rows spreads over tasks.

``cut`` deals a track's rows into segments of so many rows and repeats rows near a border in the neighbour, as far as row windows reach.
Within ``segmented()`` windows see a segment with these rows; what goes beyond is stitched by ``stitched`` and ``by_group``: sums
and last values so far start from those of the segments before, whole-track and group values are aggregates over each row once.
Outside of it the same functions are plain windows over a track, with one exchange and no join.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.functions import windows as w
from motiontab.operators.saving import saved

_on: ContextVar[bool] = ContextVar("segmented", default=False)
COLUMNS = ("_row", "_rows", "_segment", "_core")


@contextmanager
def segmented() -> Iterator[None]:
    """Plans built inside are for a table that was ``cut``."""
    token, keys = _on.set(True), w.keyed.set(("id", "_segment"))
    try:
        yield
    finally:
        _on.reset(token)
        w.keyed.reset(keys)


def cut(df: DataFrame, rows: int = 4096, halo: int = 320) -> DataFrame:
    """``df`` (id, frame, ...) with _row, its number in the track from 1, _rows of the track, _segment and _core; rows within ``halo`` of a
    border are there twice, once with _core false. Gaps in frames do not matter; frames of a track do not repeat."""
    if halo > rows:
        raise ValueError("a segment must be as long as its halo")
    block = F.floor(F.col("frame") / rows)
    counts = df.groupBy("id", block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("id").orderBy("_block")  # a row for each block
    counts = counts.select("id", "_block", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("id")).alias("_rows"))
    df = df.withColumn("_block", block).join(counts.hint("merge"), ["id", "_block"])  # a broadcast of the rows would leave the windows to few tasks
    row = F.col("_before") + F.row_number().over(Window.partitionBy("id", "_block").orderBy("frame"))
    df = df.withColumn("_row", row).drop("_block", "_before")
    own, at = F.floor((F.col("_row") - 1) / rows), (F.col("_row") - 1) % rows
    last = F.floor((F.col("_rows") - 1) / rows)
    spread = F.array_compact(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when((at >= rows - halo) & (own < last), own + 1)))
    df = df.withColumn("_own", own).withColumn("_segment", F.explode(spread))
    return df.withColumn("_core", F.col("_segment") == F.col("_own")).drop("_own")


def whole(df: DataFrame) -> DataFrame:
    """Each row of a cut table once, without the columns of the cut."""
    return df.where("_core").drop(*COLUMNS)


def track_rows() -> Column:
    """Rows of the track."""
    return F.col("_rows") if _on.get() else F.count(F.lit(1)).over(w.whole())


def row_number() -> Column:
    return F.col("_row") if _on.get() else w.position()


def nth(x: Column, n: int) -> Column:
    """An aggregate: x at the n-th row of the track; null if there is none."""
    if _on.get():
        return F.max(F.when(F.col("_row") == n, x))
    return F.nth_value(x, n)


def stitched(df: DataFrame, totals: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, nexts: Mapping[str, Column] | None = None) -> DataFrame:
    """Add aggregates over the whole track (``totals``), sums up to the row, the last value up to it that is not null, and the next
    value from it on that is not null."""
    totals, sums, lasts, nexts = (dict(x or {}) for x in (totals, sums, lasts, nexts))
    forward, backward = w.track(), w.whole().orderBy(F.desc("frame"))
    so_far = Window.unboundedPreceding, 0
    local = {n: F.sum(c).over(forward.rowsBetween(*so_far)) for n, c in sums.items()}
    local |= {n: F.last(c, ignorenulls=True).over(forward.rowsBetween(*so_far)) for n, c in lasts.items()}
    local |= {n: F.last(c, ignorenulls=True).over(backward.rowsBetween(*so_far)) for n, c in nexts.items()}
    if not _on.get():
        every = w.track().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns(local | {n: c.over(every) for n, c in totals.items()})
    df = saved(df)
    core = df.where("_core")
    if totals:
        df = df.join(core.groupBy("id").agg(*[c.alias(n) for n, c in totals.items()]), "id")
    if not local:
        return df
    at = lambda pick, c: pick(c, F.when(c.isNotNull(), F.col("frame")))
    own = [F.sum(c).alias(n) for n, c in sums.items()] + [at(F.max_by, c).alias(n) for n, c in lasts.items()] + [at(F.min_by, c).alias(n) for n, c in nexts.items()]
    parts = core.groupBy("id", "_segment").agg(*own)
    before = Window.partitionBy("id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)  # a row for each segment
    after = Window.partitionBy("id").orderBy(F.desc("_segment")).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_from_{n}") for n in sums]
    carried += [F.last(n, ignorenulls=True).over(before).alias(f"_from_{n}") for n in lasts] + [F.last(n, ignorenulls=True).over(after).alias(f"_from_{n}") for n in nexts]
    first = F.min(F.when(F.col("_core"), F.col("_row"))).over(w.whole())  # rows before it are of the segment before
    ahead = {f"_ahead_{n}": F.coalesce(F.sum(F.when(F.col("_row") < first, c)).over(w.whole()), F.lit(0)) for n, c in sums.items()}
    df = df.join(parts.select("id", "_segment", *carried), ["id", "_segment"]).withColumns(local | ahead)
    stitch = {n: F.col(f"_from_{n}") + F.coalesce(F.col(n), F.lit(0)) - F.col(f"_ahead_{n}") for n in sums}
    stitch |= {n: F.coalesce(F.col(n), F.col(f"_from_{n}")) for n in [*lasts, *nexts]}
    return df.withColumns(stitch).drop(*[f"_from_{n}" for n in [*sums, *lasts, *nexts]], *ahead)


def running(df: DataFrame, sums: Mapping[str, Column], order: str = "frame", width: int = 4096, key: str = "id") -> DataFrame:
    """Add sums of a track's rows up to each, in the order of a number; null before the first value that is not null.

    Tracks are cut by ``width`` of that number; sums inside of a block start from those of the blocks before, so that a track spreads over tasks.
    Of doubles the last bits may differ from one sum over the track.
    """
    at = ["_none", "_key", "_block"]
    df = df.withColumns({"_none": F.col(key).isNull(), "_key": F.coalesce(key, F.lit("0").cast(df.schema[key].dataType)), "_block": F.floor(F.col(order) / width)})
    parts = df.groupBy(*at).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy("_none", "_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    parts = parts.select(*at, *[F.sum(n).over(before).alias(f"_from_{n}") for n in sums])
    within = Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(parts, at, "left")  # a null order is of the first block
    first = lambda n: F.col(f"_from_{n}")
    return df.withColumns({n: F.coalesce(first(n) + F.col(n), first(n), F.col(n)) for n in sums}).drop(*at, *[f"_from_{n}" for n in sums])


def by_group(df: DataFrame, keys: Sequence[str], test: Column, aggregates: Mapping[str, Column]) -> DataFrame:
    """Add aggregates over the rows of a track that pass ``test`` and have the same ``keys``; null where it is not passed."""
    if not _on.get():
        over = Window.partitionBy("id", *keys, test)
        return df.withColumns({n: F.when(test, c.over(over)) for n, c in aggregates.items()})
    df = df.withColumn("_test", test)  # not saved: it is worked out twice at most, and not at all where no aggregate is asked for
    found = df.where("_core AND _test").groupBy("id", *keys).agg(*[c.alias(n) for n, c in aggregates.items()]).withColumn("_test", F.lit(True))
    return df.join(found, ["id", *keys, "_test"], "left").drop("_test")
