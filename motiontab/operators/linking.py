"""Links between the objects of successive frames, and track ids along one-to-one links.

Objects are rows (video, frame, label) with a box minx, maxx, miny, maxy, centre cx, cy and area. Boxes meet in grid cells of
successive frames: the cells' side is the power of two next above a box's longer one, so that no box lies in more than four
of its own cells, whatever its size, and a pair is found in one cell only. A long video and a crowded frame spread over tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.functions.geometry import column
from motiontab.operators.saving import saved


def _apart(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffles: a table with a row for each object or link is small in its file and large in a driver that would broadcast it."""
    return df.hint("merge")


def _side(objects: DataFrame, mark: str, shift: int = 0) -> DataFrame:
    names = ("label", "minx", "maxx", "miny", "maxy", "cx", "cy", "area")
    return objects.select("video", (F.col("frame") + shift).alias("frame"), *[F.col(c).alias(f"{mark}{c}") for c in names])


def _level(x0: str, x1: str, y0: str, y1: str) -> Column:
    """The power of two whose cells are no smaller than the box."""
    longest = F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0), F.lit(2.0**-20))
    return F.ceil(F.log2(longest)).cast("int")


def _place(x: Column | str, level: Column) -> Column:
    """The number of the cell along an axis."""
    return F.floor(column(x) / F.pow(F.lit(2.0), level)).cast("long")


def _in_cells(rows: DataFrame, level: Column, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
    """A row for each cell (level, gx, gy) that the box reaches."""
    rows = rows.withColumn("level", level)
    span = lambda a, b: F.sequence(_place(a, F.col("level")), _place(b, F.col("level")))
    return rows.withColumn("gx", F.explode(span(x0, x1))).withColumn("gy", F.explode(span(y0, y1)))


def _levels(*sides: DataFrame) -> list[int]:
    """The levels that occur, about one for each doubling between the smallest and the largest box."""
    every = sides[0].select("own")
    for more in sides[1:]:
        every = every.unionAll(more.select("own"))
    return sorted(r[0] for r in every.where("own IS NOT NULL").distinct().collect())


def _ways(rows: DataFrame, mark: str, levels: list[int], first: str, second: str) -> DataFrame:
    """At its own level an object meets those whose own level it is, and finer ones if there are; at coarser levels the coarse ones."""
    rows = rows.withColumn("_l", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col("own"))))
    rows = _in_cells(rows, F.col("_l"), *(f"{mark}{c}" for c in ("minx", "maxx", "miny", "maxy")))
    own = F.when(F.col("level") > F.lit(min(levels, default=0)), F.array(F.lit("alike"), F.lit(first))).otherwise(F.array(F.lit("alike")))
    ways = F.when(F.col("level") == F.col("own"), own).otherwise(F.array(F.lit(second)))
    return rows.withColumn("way", F.explode(ways)).drop("own", "_l")


def box_links(objects: DataFrame, least_overlap: float = 0.1) -> DataFrame:
    """(video, frame, a, b, overlap): object a of frame - 1 and b of frame whose boxes share more than ``least_overlap``
    of b's box.

    A pair meets at the coarser of its two levels, in the cell of the lower corner of what both share. At a level that
    is not its own an object meets only those whose own it is, so many small boxes in a cell of a large one do not meet there.
    """
    box = lambda m: (f"{m}minx", f"{m}maxx", f"{m}miny", f"{m}maxy")
    a, b = (_side(objects, m, k).where(" AND ".join(f"{c} IS NOT NULL" for c in box(m))).withColumn("own", _level(*box(m))) for m, k in (("a_", 1), ("b_", 0)))
    levels = _levels(b)  # both sides are the same boxes
    a, b = _ways(a, "a_", levels, "coarse a", "coarse b"), _ways(b, "b_", levels, "coarse b", "coarse a")
    keys = ["video", "frame", "level", "gx", "gy", "way"]
    both = a.join(_apart(b), keys)
    left, low = F.greatest("a_minx", "b_minx"), F.greatest("a_miny", "b_miny")
    width, height = F.least("a_maxx", "b_maxx") - left, F.least("a_maxy", "b_maxy") - low
    one = (_place(left, F.col("level")) == F.col("gx")) & (_place(low, F.col("level")) == F.col("gy"))
    share = F.try_divide(width * height, (F.col("b_maxx") - F.col("b_minx")) * (F.col("b_maxy") - F.col("b_miny")))
    both = both.where((width > 0) & (height > 0) & one).withColumn("overlap", share).where(F.col("overlap") > least_overlap)
    return both.select("video", "frame", F.col("a_label").alias("a"), F.col("b_label").alias("b"), "overlap")


def pixel_links(pixels: DataFrame, least_overlap: float = 0.1) -> DataFrame:
    """The same from pixels (video, frame, label, x, y): shared pixels over b's pixels."""
    size = pixels.groupBy("video", "frame", F.col("label").alias("b")).agg(F.count("*").alias("n"))
    a = pixels.select("video", (F.col("frame") + 1).alias("frame"), "x", "y", F.col("label").alias("a"))
    shared = a.join(_apart(pixels.withColumnRenamed("label", "b")), ["video", "frame", "x", "y"]).groupBy("video", "frame", "a", "b").agg(F.count("*").alias("s"))
    return shared.join(_apart(size), ["video", "frame", "b"]).withColumn("overlap", F.col("s") / F.col("n")).where(F.col("overlap") > least_overlap).select("video", "frame", "a", "b", "overlap")


def neighbours(objects: DataFrame, pad: float = 0.75) -> DataFrame:
    """(video, frame, a, b, rank): objects b of frame - 1 with centres in a's box padded by pad times its longer side.

    A padded box lies in at most four cells of its own level; a centre lies in one cell of each level there is.
    """
    a, b = _side(objects, "a_"), _side(objects, "b_", 1)
    more = pad * F.greatest(F.col("a_maxx") - F.col("a_minx"), F.col("a_maxy") - F.col("a_miny"))
    a = a.withColumns({"x0": F.col("a_minx") - more, "x1": F.col("a_maxx") + more, "y0": F.col("a_miny") - more, "y1": F.col("a_maxy") + more})
    a = a.where("x0 IS NOT NULL AND x1 >= x0 AND y0 IS NOT NULL AND y1 >= y0").withColumn("own", _level("x0", "x1", "y0", "y1"))
    levels = F.explode(F.array(*map(F.lit, _levels(a))).cast("array<int>"))
    b = b.where("b_cx IS NOT NULL AND b_cy IS NOT NULL").withColumn("_l", levels)
    both = _in_cells(a, F.col("own"), "x0", "x1", "y0", "y1").join(_apart(_in_cells(b, F.col("_l"), "b_cx", "b_cx", "b_cy", "b_cy")), ["video", "frame", "level", "gx", "gy"])
    near = F.col("b_cx").between(F.col("x0"), F.col("x1")) & F.col("b_cy").between(F.col("y0"), F.col("y1"))
    d = F.abs(F.col("a_cx") - F.col("b_cx")) + F.abs(F.col("a_cy") - F.col("b_cy"))
    rank = F.row_number().over(Window.partitionBy("video", "frame", "a_label").orderBy(d, "b_label"))
    return both.where(near).select("video", "frame", F.col("a_label").alias("a"), F.col("b_label").alias("b"), rank.alias("rank"))


def classified(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Links with kind (1->1, N->1, 1->N, N->N), and a row for each NEW (a null) and LOST (b null) object.

    Objects of a video's first frame are NEW; none of its last frame is LOST.
    """
    both = links.withColumn("_out", F.count(F.lit(1)).over(Window.partitionBy("video", "frame", "a"))).withColumn("_in", F.count(F.lit(1)).over(Window.partitionBy("video", "frame", "b")))
    kind = F.concat(F.when(F.col("_in") > 1, "N").otherwise("1"), F.lit("->"), F.when(F.col("_out") > 1, "N").otherwise("1"))
    both = both.select("video", "frame", "a", "b", kind.alias("kind"))
    here = objects.select("video", "frame", "label")
    last = objects.groupBy("video").agg(F.max("frame").alias("last"))
    new = here.withColumnRenamed("label", "b").join(_apart(links), ["video", "frame", "b"], "left_anti").select("video", "frame", F.lit(None).cast(objects.schema["label"].dataType).alias("a"), "b", F.lit("NEW").alias("kind"))
    gone = here.join(last, "video").where("frame < last").select("video", (F.col("frame") + 1).alias("frame"), F.col("label").alias("a"))
    lost = gone.join(_apart(links), ["video", "frame", "a"], "left_anti").select("video", "frame", "a", F.lit(None).cast(objects.schema["label"].dataType).alias("b"), F.lit("LOST").alias("kind"))
    return both.unionByName(new).unionByName(lost)


def track_ids(objects: DataFrame, classed: DataFrame, block: int = 2048) -> DataFrame:
    """(video, frame, label, track): chains of 1->1 links share a track, numbered in each video by (first frame, label).

    Chains are followed within blocks of ``block`` frames first: a task reads a block in the order of frames and holds two of them. What
    is left are the chains' heads in each block, which point to the head of the same chain in the block before; these pointers are
    squared until none moves, the rounds being the logarithm of the number of blocks that the longest chain goes through.
    """
    kinds = dict(objects.dtypes)
    links = classed.where("kind = '1->1'").select("video", "frame", F.col("b").alias("label"), F.col("a").alias("up"))
    rows = objects.select("video", "frame", "label").join(_apart(links), ["video", "frame", "label"], "left").withColumn("block", F.floor(F.col("frame") / block))
    dealt = rows.repartition("video", "block").sortWithinPartitions("video", "block", "frame")

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """head_frame, head_label: where the chain begins in the block; come: its label in the frame before, if that is of another block."""
        at: tuple | None = None
        before: dict = {}  # label -> where its chain begins, in the frame before and in this one
        here: dict = {}
        for batch in batches:
            found = []
            for video, part, frame, label, up in zip(*(batch.column(c).to_pylist() for c in ("video", "block", "frame", "label", "up")), strict=True):
                if at != (video, part, frame):
                    before = here if at is not None and at == (video, part, frame - 1) else {}
                    at, here = (video, part, frame), {}
                head = before.get(up) if up is not None else None
                here[label] = head or (frame, label)
                found.append((*here[label], None if head else up))
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            types = [batch.schema.field(c).type for c in ("frame", "label", "label")]
            own = [batch.column(c) for c in ("video", "frame", "label")]
            yield pa.record_batch([*own, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["video", "frame", "label", "head_frame", "head_label", "come"])

    label = kinds["label"]
    chains = saved(dealt.mapInArrow(followed, f"video {kinds['video']}, frame {kinds['frame']}, label {label}, head_frame {kinds['frame']}, head_label {label}, come {label}"))
    node = lambda f, n: F.struct(F.col(f).alias("frame"), F.col(n).alias("label"))
    heads = chains.where("frame = head_frame AND label = head_label").select("video", node("frame", "label").alias("node"), (F.col("frame") - 1).alias("frame"), F.col("come").alias("label"))
    ups = chains.select("video", "frame", "label", node("head_frame", "head_label").alias("up"))
    points = saved(heads.join(_apart(ups), ["video", "frame", "label"], "left").select("video", "node", F.coalesce("up", "node").alias("up")))
    while True:
        up = points.select("video", F.col("node").alias("up"), F.col("up").alias("top"))
        points = saved(points.join(_apart(up), ["video", "up"]).select("video", "node", (F.col("top") != F.col("up")).alias("moved"), F.col("top").alias("up")))
        if not points.where("moved").limit(1).count():
            break
    tops = points.select("video", "up").distinct()
    numbers = tops.withColumn("track", F.row_number().over(Window.partitionBy("video").orderBy("up")))
    named = points.join(_apart(numbers), ["video", "up"]).select("video", F.col("node.frame").alias("head_frame"), F.col("node.label").alias("head_label"), "track")
    return chains.join(_apart(named), ["video", "head_frame", "head_label"]).select("video", "frame", "label", "track")


def edges(classed: DataFrame, tracks: DataFrame) -> DataFrame:
    """Distinct (video, parent, child, frame, kind) of merges and splits between tracks."""
    a = tracks.select("video", (F.col("frame") + 1).alias("frame"), F.col("label").alias("a"), F.col("track").alias("parent"))
    b = tracks.select("video", "frame", F.col("label").alias("b"), F.col("track").alias("child"))
    some = classed.where("kind IN ('N->1', '1->N', 'N->N')")
    return some.join(_apart(a), ["video", "frame", "a"]).join(_apart(b), ["video", "frame", "b"]).select("video", "parent", "child", "frame", "kind").distinct()


def exit_code(x: Column, y: Column, radius: float, left: tuple[float, float] | None, right: tuple[float, float] | None) -> Column:
    """-1 at the left cup, -2 at the right one, 0 at the rim of a dish around the origin; cups count if nearer than it."""
    if left is None or right is None:
        return F.lit(0)
    d = lambda p: F.sqrt((x - p[0]) * (x - p[0]) + (y - p[1]) * (y - p[1]))
    rim = radius - F.sqrt(x * x + y * y)
    return F.when(F.least(d(left), d(right)) >= rim, 0).when(d(left) <= d(right), -1).otherwise(-2)


def centre_match(ax: Column, ay: Column, bx: Column, by: Column, size: float = 40.0, factor: float = 1.05) -> Column:
    """Centres within (factor - 1) * size on both axes."""
    most = (factor - 1) * size
    return (F.abs(ax - bx) < most) & (F.abs(ay - by) < most)


def size_match(a: Column, b: Column, tolerance: float = 0.3) -> Column:
    return (b > (1 - tolerance) * a) & (b < (1 + tolerance) * a)


def least_pairs(edges: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The most pairs (i, j) of a bipartite graph with the least sum, by successive shortest augmenting paths.

    Each path goes from the unpaired left nodes to the nearest unpaired right one; potentials keep the costs along it from being negative,
    so after k paths the pairs are the cheapest k.
    """
    out: dict[int, list[tuple[int, float]]] = {}
    low = min(edges.values(), default=0.0)
    for (i, j), d in sorted(edges.items()):
        out.setdefault(i, []).append((j, d - low))  # the same shift for each pair
    left: dict[int, int] = {}  # i -> j
    right: dict[int, int] = {}  # j -> i
    pi, pj = dict.fromkeys(out, 0.0), dict.fromkeys((j for _, j in edges), 0.0)
    while True:
        far: dict[int, float] = {}
        come: dict[int, int] = {}
        heap = [(0.0, i) for i in out if i not in left]
        start = dict.fromkeys((i for _, i in heap), 0.0)
        done: set[int] = set()
        found, total = None, 0.0
        heapq.heapify(heap)
        while heap:
            d, i = heapq.heappop(heap)
            if i < 0:  # a right node, as -1 - j
                j = -1 - i
                if j in done:
                    continue
                done.add(j)
                if j not in right:
                    found, total = j, d
                    break
                i = right[j]
                start[i] = d
            for j, cost in out[i]:
                if left.get(i) != j and j not in done:
                    further = d + cost + pi[i] - pj[j]
                    if further < far.get(j, math.inf):
                        far[j], come[j] = further, i
                        heapq.heappush(heap, (further, -1 - j))
        if found is None:
            return sorted(left.items())
        for i, d in start.items():
            pi[i] += min(d, total) - total
        for j in done:
            pj[j] += far[j] - total
        j: int | None = found
        while j is not None:
            i = right[j] = come[j]
            before = left.get(i)
            left[i], j = j, before


def best_pairing(candidates: DataFrame) -> DataFrame:
    """The one-to-one pairing of each (video, frame) with the most pairs and, of these, the least sum of d, which is also the
    least sum d / (1 + (k - 1) 1.5) of k pairs.

    candidates: feasible (video, frame, a, b, d); rows with a null are left out, of a repeated pair the nearest counts. Frames of
    any size are paired in one pass; a task holds one frame at a time.
    """
    names = ["video", "frame", "a", "b", "d"]
    rows = candidates.select(*names[:4], F.col("d").cast("double").alias("d")).dropna()

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, held, kinds = None, [], None

        def pairs() -> list[tuple]:
            a, b = (sorted({r[k] for r in held}) for k in (2, 3))
            at_a, at_b = ({x: k for k, x in enumerate(s)} for s in (a, b))
            edges: dict[tuple[int, int], float] = {}
            for r in held:
                key = (at_a[r[2]], at_b[r[3]])
                edges[key] = min(r[4], edges.get(key, math.inf))
            return [(*frame, a[i], b[j], edges[i, j]) for i, j in least_pairs(edges)]

        for batch in batches:
            kinds, out = batch.schema, []
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if r[:2] != frame:
                    out += pairs() if held else []
                    frame, held = r[:2], []
                held.append(r)
            if out:
                yield pa.record_batch([pa.array(c, kinds.field(n).type) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)
        if held:
            yield pa.record_batch([pa.array(c, kinds.field(n).type) for n, c in zip(names, zip(*pairs(), strict=True), strict=True)], names)

    return rows.repartition("video", "frame").sortWithinPartitions("video", "frame").mapInArrow(paired, rows.schema)


def rim_guarded(classed: DataFrame, objects: DataFrame, pixel_overlaps: DataFrame, radius: float, centre: tuple[float, float] = (0.0, 0.0), gap: float = 0.3, share: float = 0.95) -> DataFrame:
    """classed with rim: on 1->1 links whose object may have changed at the dish's rim, so that it needs a new id.

    pixel_overlaps: (video, frame, a, b, of_a, of_b), the shares of either object's pixels that both have. rim is 'split'
    where the share of b exceeds that of a by more than ``gap`` (part of a stayed at the rim), 'merge' the other way
    round, if b's centre lies beyond ``share`` of the radius; else null.
    """
    far = F.pow(F.col("cx") - F.lit(centre[0]), F.lit(2.0)) + F.pow(F.col("cy") - F.lit(centre[1]), F.lit(2.0)) > (share * radius) ** 2
    places = objects.select("video", "frame", F.col("label").alias("b"), far.alias("_far"))
    both = pixel_overlaps.select("video", "frame", "a", "b", (F.col("of_b") - F.col("of_a")).alias("_gap"))
    rows = classed.join(_apart(places), ["video", "frame", "b"], "left").join(_apart(both), ["video", "frame", "a", "b"], "left")
    test = (F.col("kind") == "1->1") & F.col("_far")
    return rows.withColumn("rim", F.when(test & (F.col("_gap") > gap), "split").when(test & (F.col("_gap") < -gap), "merge")).drop("_far", "_gap")


def object_statistics(tracks: DataFrame) -> DataFrame:
    """Per (video, track): rows, mean area, spread of length, width and perimeter, extremes of area; a spread is there if its column is."""
    spread = [F.stddev_samp(c).alias(f"{c}_sd") for c in ("spine_length", "width", "perimeter") if c in tracks.columns]
    return tracks.groupBy("video", "track").agg(F.count("*").alias("n"), F.avg("area").alias("area_mean"), *spread, F.min("area").alias("area_min"), F.max("area").alias("area_max"))


def with_running_extremes(tracks: DataFrame, columns: Sequence[str] = ("area",)) -> DataFrame:
    """Add c_sum, c_min and c_max of a track's rows so far."""
    so_far = Window.partitionBy("video", "track").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return tracks.withColumns({f"{c}_{n}": f(c).over(so_far) for c in columns for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))})


def single_area(lives: DataFrame) -> DataFrame:
    """(video, area): the mean area of objects of one animal, over 1.02; lives (video, size, area)."""
    return lives.where("size = 1").groupBy("video").agg((F.avg("area") / 1.02).alias("area"))


def set_matches(members: DataFrame, objects: DataFrame, size: float = 40.0, factor: float = 1.05, tolerance: float = 0.3) -> DataFrame:
    """(video, frame, set, b, d, centred, sized): does a set of objects of the frame before fit the object b?

    members: (video, frame, set, a, b). The set's centre is weighted by area, its area is the sum. centred: both axes within
    (factor - 1) * size, sized: b's area within the tolerance of the sum, d: the distance along the axes.
    """
    part = objects.select("video", (F.col("frame") + 1).alias("frame"), F.col("label").alias("a"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.col("area").alias("_w"))
    whole = members.join(_apart(part), ["video", "frame", "a"]).groupBy("video", "frame", "set", "b").agg(F.sum("_w").alias("_area"), F.try_divide(F.sum(F.col("_x") * F.col("_w")), F.sum("_w")).alias("_cx"), F.try_divide(F.sum(F.col("_y") * F.col("_w")), F.sum("_w")).alias("_cy"))
    one = objects.select("video", "frame", F.col("label").alias("b"), "cx", "cy", "area")
    rows = whole.join(_apart(one), ["video", "frame", "b"])
    x, y = (F.col("_cx"), F.col("cx")), (F.col("_cy"), F.col("cy"))
    d = F.abs(x[0] - x[1]) + F.abs(y[0] - y[1])
    return rows.select("video", "frame", "set", "b", d.alias("d"), centre_match(x[0], y[0], x[1], y[1], size, factor).alias("centred"), size_match(F.col("_area"), F.col("area"), tolerance).alias("sized"))


def most_at_once(lives: DataFrame) -> DataFrame:
    """(video, most): the greatest summed size of objects alive, from (video, start, end, size); alive: start < f < end."""
    ends = lives.select("video", F.explode(F.array(F.struct((F.col("start") + 1).alias("f"), F.col("size").alias("s")), F.struct(F.greatest(F.col("end"), F.col("start") + 1).alias("f"), (-F.col("size")).alias("s")))).alias("e"))
    steps = ends.groupBy("video", F.col("e.f").alias("f")).agg(F.sum("e.s").alias("s"))
    running = F.sum("s").over(Window.partitionBy("video").orderBy("f").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("now", running).groupBy("video").agg(F.max("now").alias("most"))
