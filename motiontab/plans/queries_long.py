"""Registered queries on tracks in segments (with the SQL of whole tracks), identities at rims, partitions and sizes of bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from motiontab.functions import segments
from motiontab.operators import collisions, events, longtracks, partitions, queues, remaps
from motiontab.plans.fixtures import frames, measures
from motiontab.plans.queries import ORACLE_SQL, query, rnd
from motiontab.plans.queries_more import _STAR, _order_tracks, _stars, _steps


@query("c07_in_segments", ORACLE_SQL["c07_midpoint_speed"])
def _(spark, d):
    return rnd(longtracks.analysed(frames(spark, d), rows=256, halo=64).select("id", "frame", "midpoint_speed", "midpoint_distance"), digits=7)


@query("c08_in_segments", ORACLE_SQL["c08_distance_to_start"])
def _(spark, d):
    return rnd(longtracks.analysed(frames(spark, d), rows=256, halo=64).select("id", "frame", "distance_to_sp"))


@query("c19_in_segments", ORACLE_SQL["c19_head_cast_flags"])
def _(spark, d):
    df = measures(spark, d).select(*events.CASTS)
    with segments.segmented():
        out = events.with_head_casts(segments.cut(df, 256, 32), 60.0, 45.0, 20.0)
    return segments.whole(out).select("id", "frame", "HC_flag", "HCs", "HCs_left", "HCs_right")


@query("c30_in_segments", ORACLE_SQL["c30_steps_and_directions"])
def _(spark, d):
    df = _steps(spark, d).select(*events.STEPS)  # each stitch writes all columns
    with segments.segmented():
        out = events.with_steps(segments.cut(df, 256, 32))
    return segments.whole(out).select("id", "frame", "step_boolean", "run_direction")


@query("h28_rim_queue")
def _(spark, d):
    # customers are tracks; of ten in a row three go away to the rim, three come back, and the others do the same at a cup
    rows = _order_tracks(spark, d).withColumn("v", F.col("v") + 400 * (F.col("id") % 3))
    k = F.col("id") % 10
    code = F.when(k < 6, 0).otherwise(-1)
    out = (k % 6) < F.when(k < 6, 3).otherwise(2)
    lives = rows.groupBy("id").agg(F.count("*").alias("n")).select(
        F.floor(F.col("id") / 50).alias("video"), "id", F.when(out, 0).otherwise(100 * F.floor(F.col("id") / 10) + 10 + k).alias("start"), F.when(out, 100 * F.floor(F.col("id") / 10) + k).otherwise(10**9).alias("end"),
        F.when(~out, code).alias("origin"), F.when(out, code).alias("into"), F.lit(1).alias("bundle"),
    )
    tracks = rows.select(F.floor(F.col("id") / 50).alias("video"), "id", "frame", "v")
    return queues.resolved_returns(lives, tracks, "v")


_FLOW = """WITH o AS (SELECT DISTINCT o_orderkey // 200 AS video, o_custkey % 50 AS track FROM orders), a AS (SELECT video, track, 50 + track % 7 AS child, 1 + track % 3 AS size FROM o),
b AS (SELECT video, child AS track, sum(size) AS size FROM a GROUP BY ALL), c AS (SELECT video, 100 + track % 2 AS track, sum(size) AS size FROM b GROUP BY ALL)"""


@query("h17_balanced_sizes", f"{_FLOW} SELECT video, track, CAST(size AS BIGINT) AS size FROM a UNION ALL SELECT video, track, CAST(size AS BIGINT) FROM b UNION ALL SELECT video, track, CAST(size AS BIGINT) FROM c")
def _(spark, d):
    # first tracks of known sizes merge twice; later sizes follow from the balance
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.expr("o_orderkey div 200").alias("video"), (F.col("o_custkey") % 50).alias("parent")).distinct()
    one = o.withColumn("child", 50 + F.col("parent") % 7)
    two = one.select("video", F.col("child").alias("parent")).distinct().withColumn("child", 100 + F.col("parent") % 2)
    edges = one.unionByName(two)
    size = (1 + F.col("parent") % 3).cast("long")
    known = o.select("video", F.col("parent").alias("track"), size.alias("low"), size.alias("high"))
    later = edges.select("video", F.col("child").alias("track")).distinct().select("video", "track", F.lit(1).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    sizes, _ = partitions.balanced(known.unionByName(later), collisions.families(edges))
    return sizes


@query("h19_best_partitions", """WITH RECURSIVE i AS (SELECT l_orderkey AS bundle, list(CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber) AS q FROM lineitem GROUP BY ALL),
b AS (SELECT bundle, q, CAST(o_orderkey % 60 AS DOUBLE) AS a0, CAST(o_custkey % 80 AS DOUBLE) AS a1 FROM i JOIN orders ON o_orderkey = bundle WHERE len(q) > 1),
s AS (SELECT bundle, 0 AS k, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1, 0 AS n0, 0 AS n1 FROM b UNION ALL
      SELECT s.bundle, k + 1, s0 + CASE WHEN p = 0 THEN q[k + 1] ELSE 0 END, s1 + CASE WHEN p = 1 THEN q[k + 1] ELSE 0 END, n0 + CAST(p = 0 AS INT), n1 + CAST(p = 1 AS INT) FROM s JOIN b USING (bundle), (VALUES (0), (1)) v(p) WHERE k < len(q)),
e AS (SELECT bundle, len(q) AS items, min(abs(a0 - s0) + abs(a1 - s1)) AS error FROM s JOIN b USING (bundle) WHERE k = len(q) AND n0 > 0 AND n1 > 0 GROUP BY ALL)
SELECT * FROM e""")
def _(spark, d):
    # an order's lines are the singles, two areas of the order its bundles
    line, order = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    items = line.select(F.lit("v").alias("video"), F.col("l_orderkey").alias("bundle"), F.col("l_linenumber").alias("item"), F.col("l_quantity").cast("double").alias("area"))
    areas = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), (F.col(c) % n).cast("double").alias("area")) for k, c, n in ((0, "o_orderkey", 60), (1, "o_custkey", 80))])).alias("p")
    parts = order.select(F.lit("v").alias("video"), F.col("o_orderkey").alias("bundle"), areas).select("video", "bundle", "p.*")
    return partitions.best_partitions(items, parts).groupBy("bundle").agg(F.count("*").alias("items"), F.first("error").alias("error"))


_BOTH = """WITH e AS (SELECT DISTINCT o_orderkey // 200 AS video, o_custkey % 50 AS parent, 50 + o_orderkey % 53 AS child FROM orders), b AS (SELECT video, parent, child FROM e UNION SELECT video, parent + 50, child + 1000 FROM e),
l AS (SELECT DISTINCT video, child AS track, CASE WHEN child % 3 = 0 THEN 1 ELSE 2 END AS size, child % 11 = 0 AS round, 1 + child % 9 AS duration FROM b),
u AS (SELECT b.video, b.child AS track, count(*) AS p, min(coalesce(l.size, 1)) AS least, bool_or(coalesce(l.round, false)) AS rounded, bool_or(l.size = 1) AS single FROM b LEFT JOIN l ON l.video = b.video AND l.track = b.parent GROUP BY ALL),
c AS (SELECT video, parent AS track, count(DISTINCT child) AS c FROM b GROUP BY ALL)"""


def _bundles(spark, d):
    """(lives, edges): parents are renumbered onto children, so that tracks have both sides."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    e = o.select(F.expr("o_orderkey div 200").alias("video"), (F.col("o_custkey") % 50).alias("parent"), (50 + F.col("o_orderkey") % 53).alias("child")).distinct()
    edges = e.unionAll(e.select("video", (F.col("parent") + 50).alias("parent"), (F.col("child") + 1000).alias("child"))).distinct()
    t = F.col("track")
    lives = edges.select("video", F.col("child").alias("track")).distinct().withColumns({"start": F.lit(0), "end": 1 + t % 9, "size": F.when(t % 3 == 0, 1).otherwise(2), "round": t % 11 == 0})
    return lives, edges


@query("h20_all_conditions", f"{_BOTH} SELECT l.video, l.track, l.duration FROM l JOIN u USING (video, track) JOIN c USING (video, track) WHERE p = 2 AND c = 2 AND size > 1 AND least = 1 AND NOT rounded AND duration <= 8")
def _(spark, d):
    return collisions.collision_candidates(*_bundles(spark, d), 8)


@query("h22_collision_counters", f"""{_BOTH}, n AS (SELECT l.video, count(CASE WHEN size > 1 AND p > 1 THEN 1 END) AS raw, count(CASE WHEN size > 1 AND single THEN 1 END) AS single_in, count(CASE WHEN size = 1 THEN 1 END) - 3 AS assignable FROM l LEFT JOIN u USING (video, track) GROUP BY l.video),
r AS (SELECT video, count(CASE WHEN track % 4 = 2 THEN 1 END) AS whole, count(CASE WHEN track % 4 = 1 THEN 1 END) AS partial, CAST(sum(track % 4 % 3) AS BIGINT) AS assignments FROM l WHERE size > 1 GROUP BY video)
SELECT n.video, raw, single_in, assignable, coalesce(whole, 0) AS whole, coalesce(partial, 0) AS partial, coalesce(assignments, 0) AS assignments FROM n LEFT JOIN r USING (video)""")
def _(spark, d):
    lives, edges = _bundles(spark, d)
    resolved = lives.where("size > 1").select("video", "track", (F.col("track") % 4 % 3).alias("pairs"))
    return collisions.collision_counters(lives, edges, resolved, lives.select("video").distinct().withColumn("most", F.lit(3)))


@query("h21_one_sided_pairing", """SELECT o_orderkey AS id, CASE WHEN abs(a) < abs(b) AND o_custkey % 3 <> 0 THEN 'out1' WHEN abs(a) > abs(b) AND o_custkey % 5 <> 0 THEN 'out2' END AS partner
FROM (SELECT *, o_orderkey % 40 - o_custkey % 30 AS a, o_orderkey % 40 - o_orderkey % 33 AS b FROM orders)""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    places = {"x_in1": k % 40, "x_out1": c % 30, "x_out2": k % 33, "y_in1": F.lit(0), "y_out1": F.lit(0), "y_out2": F.lit(0)}
    rows = o.select(k.alias("id"), *[x.cast("double").alias(n) for n, x in places.items()], F.when(c % 3 == 0, 2).otherwise(1).alias("size_out1"), F.when(c % 5 == 0, 2).otherwise(1).alias("size_out2"))
    return collisions.one_sided_pairing(rows).select("id", "partner")


@query("h25_remapped_collisions", f"""{_STAR}, g AS (SELECT *, id % 5 AS k, id // 5 % 3 AS turn FROM c), f AS (SELECT id // 5 AS five, count(*) AS n FROM g GROUP BY 1),
w AS (SELECT g.* FROM g JOIN f ON f.five = g.id // 5 AND n = 5), r AS (SELECT CASE WHEN k = 3 THEN id - 3 WHEN k = 4 AND turn <> 1 THEN id - 3 ELSE id END AS id, k, turn, new1, id // 50 AS video FROM w)
SELECT video, CAST(id AS BIGINT) AS id, CAST(new1 AS BIGINT) AS new1, CAST(1 AS BIGINT) AS bundle FROM r WHERE k >= 3 OR k = 1 AND turn <> 0""")
def _(spark, d):
    # of five customers two meet in a bundle and two leave it: both named, one named, or one named of a bundle of three
    c = _stars(spark, d).withColumn("five", F.expr("id div 5"))
    c = c.join(c.groupBy("five").agg(F.count("*").alias("n")).where("n = 5"), "five")
    turn, k = F.col("five") % 3, F.col("id") % 5
    rows = c.select(F.expr("id div 50").alias("video"), "id", "new1", "new2", "new3", F.lit(0).alias("origin"), F.when((turn == 2) & (k == 2), 3).otherwise(F.col("bundle")).alias("bundle"))
    pairs = c.where((k == 3) | (k == 4) & (turn == 0)).select(F.expr("id div 50").alias("video"), F.col("id").alias("place"), F.col("id").alias("new"), (F.col("id") - 3).alias("old"))
    return remaps.remapped_collisions(rows, pairs).select("video", "id", "new1", "bundle")
