"""Linking and track statistics on streams of detections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LINKS = "video string, frame long, a long, b long, overlap double"
BOX = ["label", "minx", "maxx", "miny", "maxy"]
#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def links_between(old: pd.DataFrame, new: pd.DataFrame, least: float) -> list[tuple]:
    """(a, b, overlap) of two frames' boxes, as the batch join has them."""
    both = old.merge(new, how="cross", suffixes=("_a", "_b"))
    width = both[["maxx_a", "maxx_b"]].min(axis=1) - both[["minx_a", "minx_b"]].max(axis=1)
    height = both[["maxy_a", "maxy_b"]].min(axis=1) - both[["miny_a", "miny_b"]].max(axis=1)
    share = width * height / ((both["maxx_b"] - both["minx_b"]) * (both["maxy_b"] - both["miny_b"]))
    fine = (width > 0) & (height > 0) & (share > least)
    return list(zip(both["label_a"][fine], both["label_b"][fine], share[fine], strict=True))


class Linker(StatefulProcessor):
    """A video's last frames as a map of frame to boxes, and its latest frame; a timer clears a video that is silent."""

    def __init__(self, least: float, keep: int, silent_ms: int | None):
        self.least, self.keep, self.silent_ms = least, keep, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "frame long", "label array<long>, minx array<double>, maxx array<double>, miny array<double>, maxy array<double>")
        self.latest = handle.getValueState("latest", "frame long")

    def boxes(self, frame: int) -> pd.DataFrame | None:
        if not self.frames.containsKey((frame,)):
            return None
        return pd.DataFrame(dict(zip(BOX, map(list, self.frames.getValue((frame,))), strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = self.latest.get()[0] if self.latest.exists() else None
        out = []
        for batch in rows:
            for frame, new in batch.groupby("frame"):
                if latest is not None and frame < latest - self.keep:
                    continue
                new = new[BOX]
                # each pair is found once: when the later one of its two boxes comes
                if (before := self.boxes(frame - 1)) is not None:
                    out += [(key[0], frame, a, b, o) for a, b, o in links_between(before, new, self.least)]
                if (after := self.boxes(frame + 1)) is not None:
                    out += [(key[0], frame + 1, a, b, o) for a, b, o in links_between(new, after, self.least)]
                whole = pd.concat([x for x in (self.boxes(frame), new) if x is not None])
                self.frames.updateValue((frame,), tuple(whole[c].tolist() for c in BOX))
                latest = frame if latest is None else max(latest, frame)
        if latest is not None:
            self.latest.update((int(latest),))
            for (frame,) in list(self.frames.keys()):
                if frame < latest - self.keep:
                    self.frames.removeKey((frame,))
        if self.silent_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield pd.DataFrame(out, columns=["video", "frame", "a", "b", "overlap"]).astype({"frame": "int64", "a": "int64", "b": "int64", "overlap": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.frames.clear()
        self.latest.clear()
        yield pd.DataFrame(columns=["video", "frame", "a", "b", "overlap"]).astype({"frame": "int64", "a": "int64", "b": "int64", "overlap": "float64"})

    def close(self) -> None:
        pass


def stream_links(objects: DataFrame, least_overlap: float = 0.1, keep_frames: int = 64, silent_seconds: float | None = None) -> DataFrame:
    """Links as objects arrive, in any order and split: each object is linked with those of the frames before and after that
    came earlier, so the links over all batches are those of the batch join.

    A video's frames stay in state until they are more than ``keep_frames`` behind its latest one; objects of older frames are late
    and dropped. With ``silent_seconds`` a timer clears a video for which nothing came that long (the stream then runs batches
    without data, too). The session needs ``PROVIDER`` as its state store.
    """
    silent = None if silent_seconds is None else int(1000 * silent_seconds)
    rows = objects.select(F.col("video").cast("string"), F.col("frame").cast("long"), F.col("label").cast("long"), *[F.col(c).cast("double") for c in BOX[1:]])
    return rows.groupBy("video").transformWithStateInPandas(Linker(least_overlap, keep_frames, silent), LINKS, "Append", "None" if silent is None else "ProcessingTime")


def stream_statistics(rows: DataFrame, variables: tuple[str, ...] = ("area", "spine_length", "width", "perimeter"), speed: str = "velocity") -> DataFrame:
    """Rows, running means and extremes of the variables that the stream has, and its greatest speed, per track; for the
    update or complete output mode."""
    have = [c for c in variables if c in rows.columns]
    top = [F.max(speed).alias(f"{speed}_max")] if speed in rows.columns else []
    return rows.groupBy("id").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{m}") for c in have for m, f in (("mean", F.avg), ("min", F.min), ("max", F.max))], *top)
