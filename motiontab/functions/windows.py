"""Row windows of a track. All share one specification, so Spark sorts each track once."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from motiontab.functions.geometry import column

#: The columns that windows are partitioned by where none are given.
keyed: ContextVar[tuple[str, ...]] = ContextVar("keyed", default=("id",))


def track(*keys: str):
    return Window.partitionBy(*(keys or keyed.get())).orderBy("frame")


def whole(*keys: str):
    return Window.partitionBy(*(keys or keyed.get()))


def full(values: Column, n: int, how, back: int, ahead: int, *keys: str) -> Column:
    """``how`` over rows -back..ahead, null unless all n rows are there and none is null."""
    w = track(*keys).rowsBetween(-back, ahead)
    return F.when(F.count(values).over(w) == n, how(values).over(w))


def centred(x, n: int, how=F.avg, *keys: str) -> Column:
    """A centred window; an even n reaches one row further ahead."""
    return full(column(x), n, how, n - 1 - n // 2, n // 2, *keys)


def centred_or_same(x, n: int = 3, *keys: str) -> Column:
    """Centred mean, or the values themselves where the track is shorter than the window."""
    return F.when(F.count(F.lit(1)).over(whole(*keys)) < n, column(x)).otherwise(centred(x, n, F.avg, *keys))


def centred_median(x, n: int, *keys: str) -> Column:
    """The median of a centred window, from its rows in order: one short sort a row instead of a quantile's histogram."""
    x = column(x).cast("double")
    rows = F.sort_array(F.collect_list(x).over(track(*keys).rowsBetween(-(n - 1 - n // 2), n // 2)))
    return F.when(F.size(rows) == n, rows[n // 2] if n % 2 else (rows[n // 2 - 1] + rows[n // 2]) / 2)


def before(x, rows: int = 1, *keys: str) -> Column:
    return F.lag(column(x), rows).over(track(*keys))


def after(x, rows: int = 1, *keys: str) -> Column:
    return F.lead(column(x), rows).over(track(*keys))


def position(*keys: str) -> Column:
    """1-based row number in the track; gaps in frame do not count."""
    return F.row_number().over(track(*keys))


def z_score(x, *keys: str) -> Column:
    x, w = column(x), whole(*keys)
    return F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))
