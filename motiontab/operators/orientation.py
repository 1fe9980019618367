"""Which end of an animal is its head: votes by segment, and spines turned to start at the tail.

Frame tables carry end points (head_x, head_y, tail_x, tail_y), their brightness (head_grey, tail_grey), the middle
(mid_x, mid_y) and collision_flag. All windows share the key id and the order of frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.functions import geometry as g
from motiontab.functions import windows as w

#: Rows of the running mean of points, the longest step that counts, and the brightness that counts.
MEAN_ROWS, LONGEST, BRIGHTEST = 24, 100.0, 9999.0


def with_segments(df: DataFrame) -> DataFrame:
    """segment: 0-based number of the stretch of a track between breaks; a break is the last row of its segment.

    Breaks are the first flagged row of a run, and the first row without flag after it unless the next is flagged again.
    """
    flag = F.coalesce(F.col("collision_flag") != 0, F.lit(False))
    df = df.withColumn("_flag", flag)
    df = df.withColumn("_single", ~F.col("_flag") & F.coalesce(w.before("_flag"), F.lit(False)) & F.coalesce(w.after("_flag"), F.lit(False)))
    df = df.withColumn("_in", F.col("_flag") | F.col("_single"))
    df = df.withColumn("_break", (F.col("_in") != F.coalesce(w.before("_in"), F.lit(False))).cast("int"))
    earlier = F.sum("_break").over(w.track().rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("segment", F.coalesce(earlier, F.lit(0))).drop("_flag", "_single", "_in", "_break")


def head_tail_votes(df: DataFrame) -> DataFrame:
    """(id, segment, rows, votes): the three votes of each segment for leaving head and tail as they are.

    The head should be nearer to where the middle is two rows later, darker, and travel more. Points are means over 23 rows of
    the track; steps of 0 and of LONGEST and more do not count, nor brightness of 0 and below or BRIGHTEST and above.
    A tie in the first vote counts against, segments of one row have the first vote only.
    """
    side = (MEAN_ROWS - 1) // 2
    smooth = lambda c: F.avg(c).over(w.track().rowsBetween(-side, side))
    rows = with_segments(df).withColumns({f"_{c}": smooth(c) for c in ("head_x", "head_y", "tail_x", "tail_y", "mid_x", "mid_y")})
    keys = ("id", "segment")
    back = lambda c: w.before(c, 2, *keys)
    d = lambda a, e: g.distance(f"_{a}_x", f"_{a}_y", back(f"_{e}_x"), back(f"_{e}_y"))
    bright = lambda c: (F.col(c) > 0) & (F.col(c) < BRIGHTEST)
    rows = rows.withColumns({"h1": d("mid", "head"), "t1": d("mid", "tail"), "h3": d("head", "head"), "t3": d("tail", "tail")})
    step = lambda c: F.coalesce(F.sum(F.when((F.col(c) > 0) & (F.col(c) < LONGEST), F.col(c))), F.lit(0.0))
    grey = lambda c: F.coalesce(F.sum(F.when(bright("head_grey") & bright("tail_grey"), F.col(c))), F.lit(0.0))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("rows"), *[step(c).alias(c) for c in ("h1", "t1", "h3", "t3")], grey("head_grey").alias("h2"), grey("tail_grey").alias("t2"))
    vote = lambda test: F.when(test, 1).otherwise(-1)
    known = lambda k: (F.col(f"h{k}") != 0) & (F.col(f"t{k}") != 0) & (F.col("rows") > 1)
    votes = vote(F.col("h1") < F.col("t1")) + F.when(known(2), vote(F.col("h2") < F.col("t2"))).otherwise(0) + F.when(known(3), vote(F.col("h3") > F.col("t3"))).otherwise(0)
    return sums.select(*keys, "rows", votes.alias("votes"))


def oriented(df: DataFrame) -> DataFrame:
    """Head and tail exchanged on the rows of segments whose votes are negative; turned says where."""
    votes = head_tail_votes(df).select("id", "segment", "votes")
    out = with_segments(df).join(votes, ["id", "segment"]).withColumn("turned", F.col("votes") < 0)
    swap = {}
    for c in ("x", "y", "grey"):
        head, tail = f"head_{c}", f"tail_{c}"
        swap |= {head: F.when(F.col("turned"), F.col(tail)).otherwise(F.col(head)), tail: F.when(F.col("turned"), F.col(head)).otherwise(F.col(tail))}
    return out.withColumns(swap).drop("votes", "segment")


def tail_first(spine: str, tail: Column) -> tuple[Column, Column]:
    """(turned, confused) for an array of points: the last point, and not the first, is the tail; neither or both are."""
    first, last = F.element_at(spine, 1) == tail, F.element_at(spine, -1) == tail
    return last & ~first, F.coalesce(first == last, F.lit(True))
