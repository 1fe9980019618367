"""Who comes back from a rim or cup: a time-ordered set of animals that are away, with rank tests at each return."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motiontab.operators.stats import chi_square_tail, rank_sum_p

RESULT = "incoming long, outgoing long, origin int, type string, away int, dependent boolean, duration long, forced int"


def _ranks(samples: Sequence[np.ndarray]) -> tuple[list[np.ndarray], float]:
    """Average ranks of the pooled samples, split again, and the sum of t^3 - t over ties."""
    pooled = np.concatenate(samples)
    _, at, n = np.unique(pooled, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[at]
    return np.split(ranks, np.cumsum([len(s) for s in samples])[:-1]), float((n**3.0 - n).sum())


def rank_test(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided rank-sum p; 0 where the samples do not tell."""
    (ra, _), tied = _ranks([a, b])
    p = rank_sum_p(float(ra.sum() - len(a) * (len(a) + 1) / 2), len(a), len(b), tied)
    return 0.0 if p is None or p != p else p


def spread_test(samples: Sequence[np.ndarray]) -> float:
    """Kruskal-Wallis p with tie correction; 1 where all values are equal."""
    parts, tied = _ranks(samples)
    n = float(sum(map(len, samples)))
    scale = 1 - tied / (n**3 - n)
    if scale <= 0:
        return 1.0
    h = (12 / (n * (n + 1)) * sum(r.sum() ** 2 / len(r) for r in parts) - 3 * (n + 1)) / scale
    return chi_square_tail(h, len(samples) - 1)


class Track:
    """A track's place in the table of lives, its number of rows, and its first and last values."""

    def __init__(self, id: int, start: int, end: int, origin: int | None, into: int | None, bundle: int, n: int, first: list[float], last: list[float]):
        self.id, self.start, self.end, self.origin, self.into, self.bundle = id, start, end, origin, into, bundle
        self.n, self.first, self.last = n, np.asarray(first, float), np.asarray(last, float)

    def continued(self, later: Track, most: int) -> Track:
        """Both as one track with the later one's id and end."""
        first = self.first if self.n >= most else np.concatenate([self.first, later.first])[:most]
        last = later.last if later.n >= most else np.concatenate([self.last, later.last])[-most:]
        return Track(later.id, self.start, later.end, self.origin, later.into, later.bundle, self.n + later.n, first, last)


def chosen(away: Sequence[Track], back: Track, ratio: float, gate: float, least: int, most: int) -> int | None:
    """Which of several that are away has come back, or None where the tests do not tell.

    All samples have as many rows as the shortest track, ``most`` at most and ``least`` at least. They must differ at ``gate``; the best
    rank-sum p against the one that is back must be positive, and both the second and the greatest p between the best
    and another one away must be below ``ratio`` times it.
    """
    rows = min([back.n, most, *(t.n for t in away)])
    if rows < least:
        return None
    gone, returned = [t.last[len(t.last) - rows :] for t in away], back.first[:rows]
    if spread_test([*gone, returned]) > gate:
        return None
    p = [rank_test(g, returned) for g in gone]
    best = int(np.argmax(p))
    others = [x for k, x in enumerate(p) if k != best] + [rank_test(gone[best], g) for k, g in enumerate(gone) if k != best]
    return best if p[best] > 0 and max(others) < ratio * p[best] else None


def passed(tracks: dict[int, Track], origin: int, ratio: float, gate: float, least: int, most: int, most_away: int) -> list[tuple]:
    """One pass over the events of an origin: (incoming, outgoing, away, dependent, duration); tracks are as the pass began."""
    events = sorted([(t.end, 1, t.id) for t in tracks.values() if t.into == origin] + [(t.start, 0, t.id) for t in tracks.values() if t.origin == origin])
    if sum(tracks[i].bundle for _, _, i in events) != len(events):  # a bundle goes in or comes out
        return []
    away, found = [], []
    for k, (frame, goes, i) in enumerate(events):
        if goes:
            away.append(tracks[i])
            continue
        at = 0 if len(away) == 1 else chosen(away, tracks[i], ratio, gate, least, most) if 2 <= len(away) <= most_away else None
        if at is not None:
            gone = away.pop(at)
            alone = not away
            found.append((gone.id, i, len(away) + 1, alone and not events[k - 1][1], frame - gone.end - 1))
    return found


def resolved_returns(lives: DataFrame, tracks: DataFrame, value: str, origins: Sequence[int] = (0, -1, -2), ratio: float = 1e-3, gate: float = 0.05, least: int = 10, most: int = 45, most_away: int = 5) -> DataFrame:
    """(video, incoming, outgoing, origin, type 1x1 | Nx1, away, dependent, duration, forced): who is who after a return.

    lives: (video, id, start, end, origin, into, bundle), a row per track with start <= end: the code it came from and goes to (0 rim,
    -1 and -2 cups; others take no part) and how many animals it holds. tracks: (video, id, frame, ``value``). In order of time, and returns before
    departures of one frame, animals join those that are away and come back: a single one is taken, of two to ``most_away`` the one
    that rank tests name (``chosen``). An origin with bundles is skipped. Who is resolved becomes one track with the later id, and an
    origin is gone through again until nothing changes, then the next. away: how many were away; dependent: the one left of several.

    A video's tracks meet in one task with their first and last ``most`` values each, whatever their length.
    """
    known = tracks.where(F.col(value).isNotNull()).select("video", "id", "frame", F.col(value).cast("double").alias("v"))
    own = Window.partitionBy("video", "id")
    parts = []
    for name, order in (("first", F.col("frame")), ("last", F.desc("frame"))):
        some = known.withColumn("_r", F.row_number().over(own.orderBy(order))).where(F.col("_r") <= most)
        parts.append(some.groupBy("video", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "v"))), lambda x: x["v"]).alias(name)))
    rows = known.groupBy("video", "id").agg(F.count("*").alias("n")).join(parts[0], ["video", "id"]).join(parts[1], ["video", "id"])
    at = lives.where(F.col("origin").isin(*origins) | F.col("into").isin(*origins)).where(F.col("start") <= F.col("end")).select("video", F.col("id").cast("long").alias("id"), *[F.col(c).cast("long").alias(c) for c in ("start", "end", "origin", "into", "bundle")])
    every = at.join(rows, ["video", "id"], "left")
    names = ["id", "start", "end", "origin", "into", "bundle", "n", "first", "last"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for r in pdf[names].itertuples(index=False):
            whole = [None if isinstance(x, float) and x != x else x for x in r[:7]]
            held[r.id] = Track(*(int(x) if x is not None else None for x in whole[:5]), int(whole[5] or 0), int(whole[6] or 0), r.first if whole[6] else [], r.last if whole[6] else [])
        out = []
        for origin in origins:
            while found := passed(held, origin, ratio, gate, least, most, most_away):
                for incoming, outgoing, n, dependent, duration in found:
                    held[outgoing] = held.pop(incoming).continued(held[outgoing], most)
                    out.append((incoming, outgoing, origin, "1x1" if n == 1 else "Nx1", n, dependent, duration, 0))
        named = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
        named.insert(0, "video", pdf["video"].iloc[0])
        return named

    return every.groupBy("video").applyInPandas(fold, f"video {dict(lives.dtypes)['video']}, {RESULT}")
