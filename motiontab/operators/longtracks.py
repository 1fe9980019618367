"""The kinematic and the event chain on tracks of any length, in segments that tasks share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from motiontab.functions import segments
from motiontab.operators import events, kinematics


def analysed(df: DataFrame, frame_rate: int = 16, rows: int = 4096, halo: int | None = None, **options) -> DataFrame:
    """``kinematics.analysed`` with each track in segments of ``rows`` rows; the same rows and values.

    halo: rows that are repeated on either side, by default 20 s; the farthest window of both chains reaches about 10 s.
    """
    with segments.segmented():
        out = kinematics.analysed(segments.cut(df, rows, halo or 20 * frame_rate), frame_rate, **options)
    return segments.whole(out)


def with_events(df: DataFrame, frame_rate: int = 16, rows: int = 4096, halo: int | None = None, raw: bool = True, **casts) -> DataFrame:
    """``events.with_events`` on raw points, or (``raw`` false) on an analysed table, with each track in segments.

    Windows stay inside a segment and its halo. Running sums and the last or next candidate row start from what the other segments hold,
    islands and pairs are grouped across borders; each of these steps is one aggregation to a row a segment, id or
    group, with the table written to the checkpoint folder before.
    """
    with segments.segmented():
        cut = segments.cut(df, rows, halo or 20 * frame_rate)
        out = events.with_events(kinematics.analysed(cut, frame_rate) if raw else cut, frame_rate, **casts)
    return segments.whole(out)
