"""Who is in which bundle: set partitions of singles over bundles by area, and sizes of bundles that balance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.operators.saving import saved

KEY = ["video", "bundle"]
#: Bundles with up to DEALS deals of their items to their parts are tried out where they are, CELLS sums at a time.
DEALS, CELLS = 1 << 17, 1 << 20


def _areas(parts: Column) -> Column:
    return F.transform(parts, lambda p: p["area"])


def _over(sums: Column, areas: Column, sign: int) -> Column:
    """Summed excess (1) or lack (-1) of the parts."""
    gaps = F.zip_with(sums, areas, lambda s, a: F.greatest(F.lit(0.0), sign * (s - a)))
    return F.aggregate(gaps, F.lit(0.0), lambda x, y: x + y)


def _best_deals(areas: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(errors, picked parts) of bundles (rows) with equally many items and parts; of equal deals the first in the order of picks."""
    n, m = areas.shape[1], parts.shape[1]
    sums, used = np.zeros((len(areas), 1, m)), np.zeros(1, dtype=np.int64)
    for k in range(n):
        grown = np.repeat(sums[:, :, None], m, axis=2)
        for p in range(m):
            grown[:, :, p, p] += areas[:, k, None]
        sums, used = grown.reshape(len(areas), -1, m), (used[:, None] | (1 << np.arange(m))).ravel()
    whole = np.flatnonzero(used == (1 << m) - 1)
    over, lack = np.zeros((2, len(areas), len(whole)))
    for p in range(m):
        gap = sums[:, whole, p] - parts[:, p, None]
        over += np.maximum(0.0, gap)
        lack += np.maximum(0.0, -gap)
    error = over + lack
    at = np.where(np.isnan(error), np.inf, error).argmin(axis=1)
    return error[np.arange(len(at)), at], whole[at, None] // m ** np.arange(n - 1, -1, -1) % m


def _tried(areas: pa.Array, parts: pa.Array) -> pa.Array:
    """Every deal of each row's areas (largest first) to its parts; rows of one shape are gone through together."""
    n, m = (np.asarray(x.value_lengths()) for x in (areas, parts))
    flat = [np.asarray(x.flatten(), dtype=float) for x in (areas, parts)]
    start = [np.cumsum(x) - x for x in (n, m)]
    error, ends = np.empty(len(n)), np.cumsum(n)
    picked = np.empty(int(n.sum()), dtype=np.int32)
    for i, j in set(zip(n.tolist(), m.tolist(), strict=True)):
        rows = np.flatnonzero((n == i) & (m == j))
        size = max(1, CELLS // (j ** (i + 1)))
        for at in np.split(rows, range(size, len(rows), size)):
            own = start[0][at, None] + np.arange(i)
            error[at], picked[own] = _best_deals(flat[0][own], flat[1][start[1][at, None] + np.arange(j)])
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(picked))
    return pa.StructArray.from_arrays([pa.array(error), listed], ["error", "picked"])


def best_partitions(items: DataFrame, parts: DataFrame) -> DataFrame:
    """(video, bundle, item, part, error): each bundle's items dealt out to its parts, none empty, with the least error: the summed
    differences of a part's area from the sum of its items' areas. Of equal ones the first in the order of parts of the items by size.

    items: (video, bundle, item, area), parts: (video, bundle, part, area), areas not negative. A bundle with fewer items than
    parts, or without either, has no row; a null area makes the error null. Bundles with up to DEALS deals are tried out in their
    task. In others partial partitions grow by one item a round, see ``_grown``.
    """
    listed = items.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("area").cast("double")).alias("order"), "item"))).alias("items"))
    held = parts.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("part", F.col("area").cast("double").alias("area")))).alias("parts"))
    both = listed.join(held, KEY).where(F.size("items") >= F.size("parts"))
    known = ~F.exists("items", lambda x: x["order"].isNull()) & ~F.exists("parts", lambda x: x["area"].isNull())
    large = known & (F.pow(F.size("parts").cast("double"), F.size("items")) > DEALS)
    areas = [F.when(known, a).otherwise(F.array(F.lit(0.0))) for a in (F.transform("items", lambda x: -x["order"]), _areas(F.col("parts")))]
    best = both.where(~large).withColumn("b", F.arrow_udf(_tried, "struct<error: double, picked: array<int>>")(*areas))
    # where an area is null all errors are, and the first deal that leaves no part empty is taken
    none = F.concat(F.array_repeat(F.lit(0), F.size("items") - F.size("parts")), F.sequence(F.lit(0), F.size("parts") - 1))
    best = best.select(*KEY, F.when(known, F.col("b.error")).alias("error"), F.when(known, F.col("b.picked")).otherwise(none).alias("picked"), "items", "parts")
    counts = items.groupBy(*KEY).count().withColumnRenamed("count", "n").join(parts.groupBy(*KEY).agg(F.count("*").cast("double").alias("m")), KEY)
    keys = saved(counts.where((F.col("n") >= F.col("m")) & (F.pow("m", "n") > DEALS)).select(*KEY))
    if not keys.isEmpty():
        best = best.unionByName(_grown(both.where(large).join(keys, KEY, "left_semi")))
    rows = best.select(*KEY, "error", "parts", F.explode(F.arrays_zip("items", "picked")).alias("x"))
    return rows.select(*KEY, F.col("x.items.item").alias("item"), F.get("parts", F.col("x.picked"))["part"].alias("part"), "error")


def _grown(both: DataFrame) -> DataFrame:
    """(video, bundle, error, picked, items, parts) of bundles with many deals. Partial partitions grow by one item a round, from the
    largest; those whose error cannot come below that of a greedy deal go, and of those with the same sums and the same empty parts one
    stays."""
    m = F.size("parts")
    empty = F.struct(F.array_repeat(F.lit(0.0), m).alias("sums"), F.array_repeat(F.lit(0), m).alias("counts"))

    def dealt(state: Column, item: Column) -> Column:
        """To the part that lacks the most."""
        lack = F.zip_with(state["sums"], _areas(F.col("parts")), lambda s, a: a - s)
        at = F.array_position(lack, F.array_max(lack))
        add = lambda c, x: F.transform(state[c], lambda v, k: v + F.when(k + 1 == at, x).otherwise(F.lit(0)))
        return F.struct(add("sums", -item["order"]).alias("sums"), add("counts", F.lit(1)).alias("counts"))

    greedy = F.aggregate("items", empty, dealt)
    error = _over(greedy["sums"], _areas(F.col("parts")), 1) + _over(greedy["sums"], _areas(F.col("parts")), -1)
    both = both.withColumn("bound", F.when(~F.exists(greedy["counts"], lambda n: n == 0), error))
    states = saved(both.select(*KEY, "items", "parts", "bound", F.array_repeat(F.lit(0.0), m).alias("sums"), F.array().cast("array<int>").alias("picked")))
    found, k = None, 0
    while not states.isEmpty():
        grown = states.withColumn("at", F.explode(F.sequence(F.lit(0), m - 1)))
        area = -F.get("items", F.lit(k))["order"]
        grown = grown.withColumns({"sums": F.transform("sums", lambda s, i: s + F.when(i == F.col("at"), area).otherwise(0.0)), "picked": F.concat("picked", F.array("at"))})
        rest = F.aggregate(F.slice("items", k + 2, F.greatest(F.size("items") - (k + 1), F.lit(0))), F.lit(0.0), lambda s, x: s - x["order"])
        least = _over(F.col("sums"), _areas(F.col("parts")), 1) + F.greatest(F.lit(0.0), _over(F.col("sums"), _areas(F.col("parts")), -1) - rest)
        used = F.array_sort(F.array_distinct("picked"))
        grown = grown.where((m - F.size(used) <= F.size("items") - (k + 1)) & (F.col("bound").isNull() | (least <= F.col("bound") * (1 + 1e-9) + 1e-9)))
        grown = saved(grown.groupBy(*KEY, "items", "parts", "bound", "sums", used.alias("used")).agg(F.min("picked").alias("picked")).drop("used"))
        k += 1
        done = grown.where(F.size("items") == k)
        found = done if found is None else found.unionByName(done)
        states = grown.where(F.size("items") > k)
    if found is None:
        found = states
    total = _over(F.col("sums"), _areas(F.col("parts")), 1) + _over(F.col("sums"), _areas(F.col("parts")), -1)
    return found.groupBy(*KEY).agg(F.min(F.struct(total.alias("error"), "picked", "items", "parts")).alias("b")).select(*KEY, "b.*")


# sizes


def _sides(family: DataFrame) -> DataFrame:
    """(video, family, track, side)."""
    side = lambda c: family.select("video", "family", F.col(c).alias("track"), F.lit(c).alias("side"))
    return side("parent").unionAll(side("child")).distinct()


def propagated(bounds: DataFrame, family: DataFrame, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(bounds, infeasible families): bounds (video, track, low, high) of animals a track holds, tightened until nothing changes.

    In a family the parents hold as many animals as the children: a track holds at least what the other side does at least, less
    what its own side can hold besides, and at most what the other side can, less what its own side does at least.
    A null high is no bound. Families with a low above the high, or sums that cannot meet, are returned as (video, family) and no
    longer tighten anything.
    """
    sides = saved(_sides(family))
    now = saved(bounds.select("video", "track", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")))
    for _ in range(rounds):
        held = sides.join(now, ["video", "track"])
        whole, mine = Window.partitionBy("video", "family"), Window.partitionBy("video", "family", "side")
        total = lambda c, over: F.sum(c).over(over)
        open_ = F.col("high").isNull().cast("int")
        held = held.withColumns({"_low": total("low", mine), "_high": total(F.coalesce("high", F.lit(0)), mine), "_open": F.sum(open_).over(mine), "_all_low": total("low", whole), "_all_high": total(F.coalesce("high", F.lit(0)), whole), "_all_open": F.sum(open_).over(whole)})
        held = held.withColumns({"_other_low": F.col("_all_low") - F.col("_low"), "_other_high": F.col("_all_high") - F.col("_high"), "_other_open": F.col("_all_open") - F.col("_open")})
        clash = (F.col("high") < F.col("low")) | ((F.col("_other_open") == 0) & (F.col("_other_high") < F.col("_low")))
        held = held.withColumn("_bad", F.max(F.coalesce(clash, F.lit(False))).over(whole))
        besides = F.col("_high") - F.coalesce("high", F.lit(0))
        low = F.when(~F.col("_bad") & (F.col("_open") - open_ == 0), F.col("_other_low") - besides)
        high = F.when(~F.col("_bad") & (F.col("_other_open") == 0), F.col("_other_high") - (F.col("_low") - F.col("low")))
        held = saved(held.select("video", "family", "track", "_bad", low.alias("_l"), high.alias("_h")))
        new = held.groupBy("video", "track").agg(F.max("_l").alias("_l"), F.min("_h").alias("_h"))
        after = saved(now.join(new, ["video", "track"], "left").select("video", "track", F.greatest("low", F.coalesce("_l", "low")).alias("low"), F.least(F.coalesce("high", "_h"), F.coalesce("_h", "high")).alias("high"), (F.coalesce(F.col("_l") > F.col("low"), F.lit(False)) | F.coalesce(F.col("_h") < F.col("high"), F.col("_h").isNotNull() & F.col("high").isNull())).alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return now, held.where("_bad").select("video", "family").distinct()


def balanced(bounds: DataFrame, family: DataFrame, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(sizes, unbalanced families): sizes within bounds such that the parents of every family hold as many as its children.

    Bounds are tightened; then the poorer side of an open family takes what it lacks, its largest members first and each as far as its
    bound lets it, and bounds are tightened again. In a round a family acts only if no open family that shares a track
    with it has a smaller number. Families that cannot balance are returned as (video, family, parents, children).
    """
    sides = saved(_sides(family))
    now, bad = propagated(bounds, family, rounds)
    for k in range(rounds + 1):
        held = sides.join(now, ["video", "track"])
        sums = saved(held.groupBy("video", "family").agg(*[F.sum(F.when(F.col("side") == s, F.col("low")).otherwise(0)).alias(n) for s, n in (("parent", "parents"), ("child", "children"))]))
        unequal = sums.where("parents <> children")
        open_ = unequal.join(bad, ["video", "family"], "left_anti")
        if k == rounds or open_.isEmpty():
            return now.select("video", "track", F.col("low").alias("size")), unequal
        touched = sides.join(open_, ["video", "family"])
        first = F.min("family").over(Window.partitionBy("video", "track"))
        acting = touched.withColumn("_first", first).groupBy("video", "family", "parents", "children").agg(F.max(F.col("_first") < F.col("family")).alias("_waits")).where("NOT _waits")
        poor = F.when(F.col("parents") < F.col("children"), "parent").otherwise("child")
        lack = acting.select("video", "family", poor.alias("side"), F.abs(F.col("parents") - F.col("children")).alias("lack"))
        room = held.join(lack, ["video", "family", "side"]).withColumn("room", F.coalesce(F.col("high") - F.col("low"), F.col("lack")))
        order = Window.partitionBy("video", "family").orderBy(F.desc("low"), "track").rowsBetween(Window.unboundedPreceding, -1)
        room = room.withColumn("more", F.least("room", F.greatest(F.lit(0), F.col("lack") - F.coalesce(F.sum("room").over(order), F.lit(0)))))
        raised = room.groupBy("video", "track").agg(F.max("more").alias("more"))
        now, worse = propagated(now.join(raised, ["video", "track"], "left").select("video", "track", (F.col("low") + F.coalesce("more", F.lit(0))).alias("low"), "high"), family, rounds)
        bad = bad.unionByName(worse).distinct()
    raise AssertionError
