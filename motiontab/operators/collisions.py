"""Identities through collisions: bundle sizes, collision candidates, remaps and statistical resolution.

Tables: edges (video, parent, child, frame), lives (video, track, start, end, area), collisions (id, new1, new2, new3,
origin, bundle) and frame tables. All are DataFrames; iterations stop at a fixpoint.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.functions import geometry as g
from motiontab.functions import windows as w
from motiontab.operators import stats
from motiontab.operators.saving import saved


# shape


def shape_features(df: DataFrame) -> DataFrame:
    """Roundness, head displacement with its running mean, and the head-mid-tail angle in [0, 360)."""
    step = lambda k: g.distance(w.before(f"spinepoint_x_{k}"), w.before(f"spinepoint_y_{k}"), f"spinepoint_x_{k}", f"spinepoint_y_{k}")
    least = F.least(step(12), step(1))
    so_far = w.track().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"roundness": F.try_divide(F.col("perimeter") * F.col("perimeter"), 2 * math.pi * F.col("area")), "end_step": least, "end_step_mean": F.avg(least).over(so_far), "spine_angle": g.joint_angles([("spinepoint_x_12", "spinepoint_y_12"), ("spinepoint_x_6", "spinepoint_y_6"), ("spinepoint_x_1", "spinepoint_y_1")])[0]})


def round_shape(n_points: Column | None = None, roundness: Column | None = None, length_width: Column | None = None, length_perimeter: Column | None = None) -> Column:
    """An object without a spine of its own: two spine points only, or (optional rule) round, short and wide."""
    if n_points is not None:
        return n_points == 2
    return (roundness < 3.55) & length_width.between(0.001, 3.35) & length_perimeter.between(0.001, 0.42)


def shape_breaks(df: DataFrame, least: float = -3.0) -> DataFrame:
    """shape_break: the smoothed, standardised z(length) - z(width) + z(roundness) + z(perimeter) is below ``least``; tracks of 5 rows or more."""
    z = w.z_score("spine_length") - w.z_score("width") + w.z_score("roundness") + w.z_score("perimeter")
    df = df.withColumn("_s", z).withColumn("_z", w.z_score("_s")).withColumn("_m", F.avg("_z").over(w.track().rowsBetween(-1, 1)))
    long = F.count(F.lit(1)).over(w.whole()) >= 5
    return df.withColumn("shape_break", F.coalesce(long & (F.col("_m") < least), F.lit(False))).drop("_s", "_z", "_m")


def straightened_ends(df: DataFrame) -> DataFrame:
    """swapped: points 1 and 12 of a row are exchanged against the track's first row, by distances to the previous row."""
    one, two = ("spinepoint_x_1", "spinepoint_y_1"), ("spinepoint_x_12", "spinepoint_y_12")
    d = lambda a, b: g.distance(w.before(a[0]), w.before(a[1]), *b)
    flip = F.coalesce((d(one, two) + d(two, one)) < (d(one, one) + d(two, two)), F.lit(False)).cast("int")
    return df.withColumn("_flip", flip).withColumn("swapped", F.sum("_flip").over(w.track().rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1).drop("_flip")


def gap_velocities(df: DataFrame, frame_rate: float = 16) -> DataFrame:
    """Velocity of point 6 over the real time since the last row, and the fastest so far; centroid_velocity where there is a centroid."""
    per_second = frame_rate / (F.col("frame") - w.before("frame"))
    new = {"velocity": g.distance(w.before("spinepoint_x_6"), w.before("spinepoint_y_6"), "spinepoint_x_6", "spinepoint_y_6") * per_second}
    if "centroid_x" in df.columns:
        new["centroid_velocity"] = g.distance(w.before("centroid_x"), w.before("centroid_y"), "centroid_x", "centroid_y") * per_second
    return df.withColumns(new).withColumn("velocity_max", F.max("velocity").over(w.track().rowsBetween(Window.unboundedPreceding, 0)))


def speed_gate(df: DataFrame, x: str = "velocity", most: float = 100.0, gap: str = "gap") -> Column:
    """The speed a link implies, less the mean of the last three, is below most * (1 - (0.25 - 1 / (gap + 3)))."""
    recent = F.avg(x).over(w.track().rowsBetween(-3, -1))
    return F.col(x) - F.coalesce(recent, F.lit(0.0)) < most * (1 - (0.25 - 1 / (F.col(gap) + 3)))


# bundles


def bundle_bounds(lives: DataFrame, edges: DataFrame) -> DataFrame:
    """(video, track, low, high): at least as many animals as parents, as children, and one; large areas hold two or
    more, small ones one."""
    parents = edges.groupBy("video", F.col("child").alias("track")).agg(F.countDistinct("parent").alias("p"))
    children = edges.groupBy("video", F.col("parent").alias("track")).agg(F.countDistinct("child").alias("c"))
    rows = lives.join(parents, ["video", "track"], "left").join(children, ["video", "track"], "left").withColumn("low", F.greatest(F.lit(1), F.coalesce("p", F.lit(0)), F.coalesce("c", F.lit(0))).cast("long"))
    single = F.avg(F.when(F.col("low") == 1, F.col("area"))).over(Window.partitionBy("video"))
    low = F.when(F.coalesce(F.col("area") >= 2 * single, F.lit(False)), F.greatest("low", F.lit(2).cast("long"))).otherwise(F.col("low"))
    high = F.when(F.coalesce(F.col("area") <= 0.9 * single, F.lit(False)) & (F.col("low") == 1), F.lit(1).cast("long"))
    return rows.withColumn("high", high).withColumn("low", low).select("video", "track", "low", "high")


def families(edges: DataFrame) -> DataFrame:
    """(video, parent, child, family): edges whose parents share children, transitively; family is the least parent."""
    rows = saved(edges.select("video", "parent", "child").distinct().withColumn("family", F.col("parent")))
    while True:
        by_child = rows.groupBy("video", "child").agg(F.min("family").alias("m"))
        by_parent = rows.join(by_child, ["video", "child"]).groupBy("video", "parent").agg(F.min("m").alias("m"))
        rows = saved(rows.join(by_parent, ["video", "parent"]).select("video", "parent", "child", F.least("m", "family").alias("family"), (F.col("m") < F.col("family")).alias("moved")))
        if not rows.where("moved").limit(1).count():
            return rows.drop("moved")
        rows = rows.drop("moved")


def end_objects(sizes: DataFrame, edges: DataFrame) -> DataFrame:
    """(video, track, single): the singles downstream of each bundle, through bundles; edges may form cycles."""
    bundle = sizes.where("size > 1").select("video", "track").distinct()
    step = edges.select("video", F.col("parent").alias("at"), F.col("child").alias("next")).distinct()
    inner = bundle.select("video", F.col("track").alias("next"), F.lit(True).alias("inner"))
    step = saved(step.join(inner, ["video", "next"], "left").withColumn("inner", F.coalesce("inner", F.lit(False))))
    front = saved(bundle.select("video", "track", F.col("track").alias("at"), F.lit(True).alias("inner")))
    seen = [front]
    while True:
        # each pair of a bundle and what it reaches is found once, so that the end is a scan
        reached = front.where("inner").drop("inner").join(step, ["video", "at"]).select("video", "track", F.col("next").alias("at"), "inner").distinct()
        old = reduce(DataFrame.unionByName, seen).drop("inner")
        same = (reached["video"] == old["video"]) & (reached["track"] == old["track"]) & reached["at"].eqNullSafe(old["at"])
        front = saved(reached.join(old, same, "left_anti"))
        if front.isEmpty():
            break
        seen = [*seen, front] if len(seen) < 8 else [saved(reduce(DataFrame.unionByName, [*seen, front]))]
    return reduce(DataFrame.unionByName, seen).where("NOT inner").select("video", "track", F.col("at").alias("single"))


def collision_candidates(lives: DataFrame, edges: DataFrame, most_frames: int) -> DataFrame:
    """Tracks with two parents and two children that last no longer than ``most_frames``: (video, track, duration).

    Where lives has a ``size`` the track is a bundle and one of its parents is not; where it has ``round``, the shape at the end, no
    parent was round.
    """
    own = [c for c in ("size", "round") if c in lives.columns]
    up = edges.select("video", "parent", F.col("child").alias("track")).distinct().join(lives.select("video", F.col("track").alias("parent"), *[F.col(c).alias(f"_{c}") for c in own]), ["video", "parent"], "left")
    tests = [F.count("*").alias("p")]
    tests += [F.min(F.coalesce("_size", F.lit(1))).alias("_least")] if "size" in own else []
    tests += [F.max(F.coalesce("_round", F.lit(False))).alias("_any")] if "round" in own else []
    p = up.groupBy("video", "track").agg(*tests)
    c = edges.groupBy("video", F.col("parent").alias("track")).agg(F.countDistinct("child").alias("c"))
    both = lives.join(p, ["video", "track"]).join(c, ["video", "track"]).where("p = 2 AND c = 2").withColumn("duration", F.col("end") - F.col("start"))
    both = both.where("size > 1 AND _least = 1") if "size" in own else both
    both = both.where("NOT _any") if "round" in own else both
    return both.where(F.col("duration") <= most_frames).select("video", "track", "duration")


def end_point_pairing(rows: DataFrame) -> DataFrame:
    """straight: the summed distances of in1-out1 and in2-out2 are at most those of the crossed pairs. Columns x_in1, y_in1, ..."""
    d = lambda a, b: g.distance(f"x_{a}", f"y_{a}", f"x_{b}", f"y_{b}")
    return rows.withColumn("straight", d("in1", "out1") + d("in2", "out2") <= d("in1", "out2") + d("in2", "out1"))


def one_sided_pairing(rows: DataFrame) -> DataFrame:
    """partner: the nearer of out1 and out2 to the end point of in1, if it is a single animal (size_out1, size_out2); else null, as at a tie."""
    d = lambda k: g.distance("x_in1", "y_in1", f"x_out{k}", f"y_out{k}")
    nearer = F.when((d(1) < d(2)) & (F.col("size_out1") == 1), "out1").when((d(1) > d(2)) & (F.col("size_out2") == 1), "out2")
    return rows.withColumn("partner", nearer)


def partition_error(expected: DataFrame) -> DataFrame:
    """(candidate, error): summed differences of each part's area from its members' expected areas."""
    part = expected.groupBy("candidate", "part", "area").agg(F.sum("expected").alias("s"))
    return part.groupBy("candidate").agg(F.sum(F.abs(F.col("area") - F.col("s"))).alias("error"))


# logs and remaps


def columnised(events: DataFrame) -> DataFrame:
    """Event log to (id, merged_into, split1, split2, split3, origin, bundle); later events win, sizes are those of the last
    report, in the order of ids from 1. Later is by path and place of the line where the events have them, else by frame
    (reports without a frame after all), kind and ids."""
    order = ["path", "place"] if {"path", "place"} <= set(events.columns) else []
    events = events.withColumn("_n", F.struct(*order or [F.coalesce("frame", F.lit(2**31 - 1)).alias("f"), "kind", "ids", "to_ids", "sizes"]))
    last = lambda c: F.max_by(c, "_n")
    merged = events.where("kind = 'N->1'").select(F.explode("ids").alias("id"), F.get("to_ids", F.size("to_ids") - 1).alias("into"), "_n").groupBy("id").agg(last("into").alias("merged_into"))
    split = events.where("kind = '1->N'").select(F.get("ids", F.size("ids") - 1).alias("id"), "to_ids", "_n").groupBy("id").agg(last("to_ids").alias("s"))
    new = events.where("kind = 'NEW'").select(F.get("to_ids", F.size("to_ids") - 1).alias("id"), F.get("ids", 0).alias("o"), "_n").groupBy("id").agg(last("o").alias("origin"))
    sizes = events.where("kind = 'SIZES'").orderBy(F.desc("_n")).limit(1).select(F.posexplode("sizes").alias("k", "bundle")).select((F.col("k") + 1).cast("long").alias("id"), "bundle")
    ids = merged.select("id").unionAll(split.select("id")).unionAll(new.select("id")).unionAll(sizes.select("id")).distinct()
    out = ids.join(merged, "id", "left").join(split, "id", "left").join(new, "id", "left").join(sizes, "id", "left")
    return out.select("id", "merged_into", *[F.get("s", k).alias(f"split{k + 1}") for k in range(3)], "origin", F.coalesce("bundle", F.lit(0)).alias("bundle"))


def last_per_id(rows: DataFrame, order: Sequence[str], key: str = "id") -> DataFrame:
    """One row per id, the last in the given order."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")


def with_missing_ids(rows: DataFrame, key: str = "id", **fill) -> DataFrame:
    """Ids 1 to the greatest, absent ones with the given values."""
    top = rows.agg(F.max(key)).first()[0] or 0
    return rows.sparkSession.range(1, top + 1).withColumnRenamed("id", key).join(rows, key, "left").fillna(fill)


def resolved_map(pairs: DataFrame, rounds: int = 64) -> DataFrame:
    """(old, new) remaps followed to their ends, by pointer doubling; remaps must not form cycles."""
    rows = saved(pairs.select("old", "new").where("old <> new"))
    for _ in range(rounds):
        step = rows.select(F.col("old").alias("new"), F.col("new").alias("next"))
        rows = saved(rows.join(step, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved")))
        if not rows.where("moved AND old <> new").limit(1).count():
            break
        rows = rows.drop("moved")
    return rows.select("old", "new").where("old <> new")


def remapped(rows: DataFrame, pairs: DataFrame, columns: Sequence[str], removed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Ids in ``columns`` replaced through ``pairs`` (old, new); rows whose key is in ``removed`` (id) go first."""
    if removed is not None:
        rows = rows.join(removed.select(F.col("id").alias(key)).distinct(), key, "left_anti")
    ends = resolved_map(pairs)
    for c in columns:
        rows = rows.join(ends.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return rows


def location_checked(rows: DataFrame, first: bool = True, rim: float = 4450.0, cup: float = 40.0, odor: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(id, code, fine): first or last known place of each track against its code (0 rim, -1 and -2 cup)."""
    pick = F.min_by if first else F.max_by
    at = rows.where("centroid_x IS NOT NULL").groupBy("id").agg(pick("centroid_x", "frame").alias("x"), pick("centroid_y", "frame").alias("y"), F.first("code").alias("code"))
    far = F.col("x") * F.col("x") + F.col("y") * F.col("y") > rim
    near = (F.col("x") - odor[0]) * (F.col("x") - odor[0]) + (F.col("y") - odor[1]) * (F.col("y") - odor[1]) < cup
    return at.select("id", "code", F.when(F.col("code") == 0, far).otherwise(near).alias("fine"))


def gap_rows(tracks: DataFrame) -> DataFrame:
    """(id, frame) for each frame that lies between two rows of a track and has none."""
    rows = tracks.select("id", "frame", w.after("frame").alias("next")).where("next > frame + 1")
    return rows.select("id", F.explode(F.sequence(F.col("frame") + 1, F.col("next") - 1)).alias("frame"))


def with_gap_rows(tracks: DataFrame) -> DataFrame:
    return tracks.unionByName(gap_rows(tracks), allowMissingColumns=True)


def merged_tracks(tracks: DataFrame, assignments: DataFrame) -> DataFrame:
    """Tracks with ids replaced along assignments (incoming, outgoing): the later id stays, gaps become null rows."""
    out = remapped(tracks, assignments.select(F.col("incoming").alias("old"), F.col("outgoing").alias("new")), ["id"])
    return with_gap_rows(out)


# statistical resolution


def collision_stars(collisions: DataFrame) -> DataFrame:
    """(collision, bundle, incoming, outgoing): each cluster with the rows (id, bundle) that enter and that leave it, by id.

    collisions: (id, new1, new2, new3, bundle); who names the cluster as new1 enters it, whom the cluster names leaves.
    """
    row = lambda: F.sort_array(F.collect_list(F.struct("id", "bundle")))
    incoming = collisions.where("new1 IS NOT NULL").groupBy(F.col("new1").alias("collision")).agg(row().alias("incoming"))
    named = collisions.select(F.col("id").alias("collision"), F.explode(F.array_compact(F.array("new1", "new2", "new3"))).alias("id"))
    outgoing = named.join(collisions.select("id", "bundle"), "id").groupBy("collision").agg(row().alias("outgoing"))
    return collisions.select(F.col("id").alias("collision"), "bundle").join(incoming, "collision").join(outgoing, "collision")


def collision_samples(tracks: DataFrame, collisions: DataFrame, k: int, value: str, least: int = 10, most: int = 45) -> DataFrame:
    """(collision, role, id, frame, value) for ``k`` single animals that enter a bundle of k and k that leave it.

    Every animal needs ``least`` rows; of each the last (in) or first (out) rows are taken, as many as the shortest has and
    ``most`` at most. Roles are in1.., out1.. in the order of ids.
    """
    single = lambda c: (F.size(c) == k) & F.forall(c, lambda r: r["bundle"] == 1)
    stars = collision_stars(collisions).where((F.col("bundle") == k) & single("incoming") & single("outgoing"))
    named = lambda c, side: F.transform(c, lambda r, i: F.struct(r["id"].alias("id"), F.concat(F.lit(side), (i + 1).cast("string")).alias("role")))
    roles = F.concat(named("incoming", "in"), named("outgoing", "out"))
    members = stars.select("collision", F.explode(roles).alias("m")).select("collision", "m.id", "m.role")
    rows = members.join(tracks.select("id", "frame", F.col(value).alias("value")), "id")
    each = Window.partitionBy("collision", "role")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(each), "_r": F.row_number().over(each.orderBy(F.when(F.col("role").startswith("in"), -F.col("frame")).otherwise(F.col("frame"))))})
    whole = Window.partitionBy("collision")
    rows = rows.withColumns({"_least": F.min("_n").over(whole), "_roles": F.size(F.collect_set("role").over(whole))})
    return rows.where((F.col("_least") >= least) & (F.col("_roles") == 2 * k) & (F.col("_r") <= F.least(F.lit(most), "_least"))).select("collision", "role", "id", "frame", "value")


def _role_tests(samples: DataFrame, variable: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(collision, p): rank-sum p by pair of roles, a map with keys such as in1-out2."""
    listed = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("pair")
    # a role's rows, at most 45, go once into each of its pairs
    rows = samples.select("collision", "role", F.col(variable).alias("value"), listed).where((F.col("role") == F.col("pair.a")) | (F.col("role") == F.col("pair.b")))
    keyed = rows.select(F.to_json(F.struct(F.col("collision").alias("c"), F.concat_ws("-", "pair.a", "pair.b").alias("cell"))).alias("key"), F.when(F.col("role") == F.col("pair.a"), "a").otherwise("b").alias("g"), "value")
    tests = stats.rank_sums_by_key(keyed, "key", "g", "value")
    kind = dict(samples.dtypes)["collision"]
    parts = tests.select(F.from_json("key", f"c {kind}, cell string").alias("k"), "p")
    return parts.groupBy(F.col("k.c").alias("collision")).agg(F.map_from_entries(F.collect_list(F.struct("k.cell", "p"))).alias("p"))


def _gated(samples: DataFrame, variable: str) -> DataFrame:
    return stats.kruskal(samples, variable, "role", ["collision"]).select("collision", F.col("p").alias("p_gate"))


def resolve_two(samples: DataFrame, ratio: float = 1e-3, gate: float = 0.05, variable: str = "value", forced: bool = False) -> DataFrame:
    """(collision, straight, p_gate, forced): which incoming animal is which outgoing one, for two in and two out.

    samples: (collision, role in1 | in2 | out1 | out2, value), at most 45 rows a role. A Kruskal-Wallis test over the
    four roles must reject at ``gate``; then the pairs with the two largest rank-sum p must lie on one diagonal and the
    third p must be below ``ratio`` times the second, else straight is null. With ``forced`` the diagonal of the largest p
    is taken then, and forced is true; at a tie, or where the gate closes, the straight one.
    """
    p = _role_tests(samples, variable, [(f"in{i}", f"out{o}") for i in "12" for o in "12"])
    cells = F.sort_array(F.transform(F.map_entries("p"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("cell"))), False)
    four = p.withColumn("o", cells)
    top = F.array_sort(F.array(F.col("o")[0]["cell"], F.col("o")[1]["cell"]))
    clear = (F.size("o") == 4) & (F.col("o")[0]["p"] != 0) & (F.col("o")[2]["p"] < ratio * F.col("o")[1]["p"])
    one, two = F.array(F.lit("in1-out1"), F.lit("in2-out2")), F.array(F.lit("in1-out2"), F.lit("in2-out1"))
    straight = F.when(clear & (top == one), True).when(clear & (top == two), False)
    best = lambda pair: F.greatest(*[F.coalesce(F.col("p")[c], F.lit(0.0)) for c in pair])
    four = four.select("collision", straight.alias("_s"), (best(["in1-out1", "in2-out2"]) >= best(["in1-out2", "in2-out1"])).alias("_more"))
    out = _gated(samples, variable).join(four, "collision", "left")
    told = F.when(F.col("p_gate") <= gate, F.col("_s"))
    guess = F.when(F.col("p_gate") <= gate, F.col("_more")).otherwise(True)
    return out.select("collision", (F.coalesce(told, guess) if forced else told).alias("straight"), "p_gate", (told.isNull() & F.lit(forced)).alias("forced"))


def resolve_three(samples: DataFrame, ratio: float = 1e-3, gate: float = 0.05, variable: str = "value") -> DataFrame:
    """(collision, incoming, outgoing, p_gate): roles that belong together, for three in and three out.

    A Kruskal-Wallis test over the six roles must reject at ``gate``. An incoming animal's best partner has the largest of
    its three rank-sum p; it is sure when the second is below ``ratio`` times it, and so is the largest p of the tests among
    the incoming and among the outgoing that take in one of the two. If the three best partners are a permutation
    and all sure, three rows are returned; else those sure ones that are the only best of their partner.
    """
    ins, outs = [f"in{k}" for k in "123"], [f"out{k}" for k in "123"]
    cross = [(x[a], x[b]) for x in (ins, outs) for a, b in ((0, 1), (0, 2), (1, 2))]
    p = _role_tests(samples, variable, [(a, b) for a in ins for b in outs] + cross)
    value = lambda a, b: F.coalesce(F.col("p")[f"{a}-{b}"], F.lit(0.0))
    touching = lambda role: [value(a, b) for a, b in cross if role in (a, b)]

    def row(a: str) -> Column:
        order = F.sort_array(F.array(*[F.struct(value(a, b).alias("p"), F.greatest(*touching(a), *touching(b)).alias("cross"), F.lit(b).alias("out")) for b in outs]), False)
        sure = (order[0]["p"] > 0) & (order[1]["p"] < ratio * order[0]["p"]) & (order[0]["cross"] < ratio * order[0]["p"])
        return F.struct(F.lit(a).alias("incoming"), order[0]["out"].alias("outgoing"), sure.alias("sure"))

    rows = p.withColumn("rows", F.array(*map(row, ins))).join(_gated(samples, variable), "collision").where(F.col("p_gate") <= gate)
    alone = lambda r: F.size(F.filter("rows", lambda q: q["outgoing"] == r["outgoing"])) == 1
    found = rows.select("collision", "p_gate", F.explode(F.filter("rows", lambda r: r["sure"] & alone(r))).alias("r"))
    return found.select("collision", "r.incoming", "r.outgoing", "p_gate")


def assignments_of(samples: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """(incoming, outgoing, type, duration, forced) of resolved roles: pairs (collision, incoming, outgoing, forced).

    duration: frames between the last one of the incoming animal and the first one of the outgoing one.
    """
    ends = samples.groupBy("collision", "role").agg(F.first("id").alias("id"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    side = lambda n: ends.select("collision", F.col("role").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("id", "first", "last")])
    both = pairs.join(side("incoming"), ["collision", "incoming"]).join(side("outgoing"), ["collision", "outgoing"])
    return both.select(F.col("incoming_id").alias("incoming"), F.col("outgoing_id").alias("outgoing"), F.lit(kind).alias("type"), (F.col("outgoing_first") - F.col("incoming_last") - 1).alias("duration"), F.col("forced").cast("int").alias("forced"))


def counters(resolutions: DataFrame) -> DataFrame:
    """One row: collisions, resolved and open ones."""
    done = F.col("straight").isNotNull()
    return resolutions.agg(F.count("*").alias("collisions"), F.count_if(done).alias("resolved"), F.count_if(~done).alias("open"))


def collision_counters(lives: DataFrame, edges: DataFrame, resolved: DataFrame, most: DataFrame) -> DataFrame:
    """Per video: raw (bundles of several parents), single_in (bundles with a single animal among their parents), assignable (singles over
    the most animals at once), and of the collisions in ``resolved`` how many pairs were named: whole (2), partial (1), assignments.

    lives: (video, track, size), resolved: (video, track, pairs), most: (video, most). Videos without any have zeros; a parent that lives lacks
    counts as one of unknown size.
    """
    up = edges.select("video", "parent", F.col("child").alias("track")).distinct().join(lives.select("video", F.col("track").alias("parent"), F.col("size").alias("_size")), ["video", "parent"], "left")
    met = up.groupBy("video", "track").agg(F.count("*").alias("p"), F.max(F.coalesce(F.col("_size") == 1, F.lit(False))).alias("_single"))
    rows = lives.join(met, ["video", "track"], "left")
    bundle = F.col("size") > 1
    counts = rows.groupBy("video").agg(F.count_if(bundle & (F.col("p") > 1)).alias("raw"), F.count_if(bundle & F.col("_single")).alias("single_in"), F.count_if(~bundle).alias("_singles"))
    named = resolved.groupBy("video").agg(F.count_if(F.col("pairs") == 2).alias("whole"), F.count_if(F.col("pairs") == 1).alias("partial"), F.sum("pairs").alias("assignments"))
    out = counts.join(most, "video", "left").join(named, "video", "left").fillna(0)
    return out.select("video", "raw", "single_in", (F.col("_singles") - F.col("most")).alias("assignable"), "whole", "partial", "assignments")
