"""Registered queries on links, collisions, pixels, logs and learning, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiontab.operators import collisions, learning, linking, pixels
from motiontab.plans.fixtures import frames, frames_sql, measures, measures_sql
from motiontab.plans.queries import query, rnd
from motiontab.sources import detections

OBJECTS = f"""WITH {frames_sql()},
o AS (SELECT trial AS video, frame, id AS label, 400 + 8 * spinepoint_x_6 AS cx, 400 + 8 * spinepoint_y_6 AS cy FROM frames),
objects AS (SELECT *, cx - 6 AS minx, cx + 6 AS maxx, cy - 4 AS miny, cy + 4 AS maxy FROM o),
j AS (SELECT b.video, b.frame, a.label AS a, b.label AS b, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) AS w, (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS h
      FROM objects a JOIN objects b ON a.video = b.video AND a.frame + 1 = b.frame),
links AS (SELECT video, frame, a, b, w * h / 96 AS overlap FROM j WHERE w > 0 AND h > 0 AND w * h / 96 > 0.1),
c0 AS (SELECT *, count(*) OVER (PARTITION BY video, frame, a) AS o, count(*) OVER (PARTITION BY video, frame, b) AS i FROM links),
classed AS (SELECT video, frame, a, b, (CASE WHEN i > 1 THEN 'N' ELSE '1' END) || '->' || (CASE WHEN o > 1 THEN 'N' ELSE '1' END) AS kind FROM c0
  UNION ALL SELECT o.video, o.frame, NULL, o.label, 'NEW' FROM objects o LEFT JOIN links l ON l.video = o.video AND l.frame = o.frame AND l.b = o.label WHERE l.b IS NULL
  UNION ALL SELECT o.video, o.frame + 1, o.label, NULL, 'LOST' FROM objects o JOIN (SELECT video, max(frame) AS m FROM objects GROUP BY 1) z ON z.video = o.video AND o.frame < z.m
            LEFT JOIN links l ON l.video = o.video AND l.frame = o.frame + 1 AND l.a = o.label WHERE l.a IS NULL),
heads AS (SELECT o.video, o.frame, o.label FROM objects o LEFT JOIN classed c ON c.video = o.video AND c.frame = o.frame AND c.b = o.label AND c.kind = '1->1' WHERE c.b IS NULL),
p AS (SELECT o.video, o.frame, o.label, c.a AS before FROM objects o LEFT JOIN classed c ON c.video = o.video AND c.frame = o.frame AND c.b = o.label AND c.kind = '1->1')"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select(F.col("trial").alias("video"), "frame", F.col("id").alias("label"), (400 + 8 * F.col("spinepoint_x_6")).alias("cx"), (400 + 8 * F.col("spinepoint_y_6")).alias("cy"), "width", "perimeter")
    return f.withColumns({"minx": F.col("cx") - 6, "maxx": F.col("cx") + 6, "miny": F.col("cy") - 4, "maxy": F.col("cy") + 4, "area": F.lit(96.0)})


@query("e05_box_links", f"{OBJECTS} SELECT video, frame, a, b, overlap FROM links")
def _(spark, d):
    return linking.box_links(objects(spark, d))


@query("e07_neighbours", f"""{OBJECTS}, n AS (SELECT a.video, a.frame, a.label AS a, b.label AS b, abs(a.cx - b.cx) + abs(a.cy - b.cy) AS d FROM objects a JOIN objects b ON a.video = b.video AND b.frame + 1 = a.frame
  AND b.cx BETWEEN a.minx - 9 AND a.maxx + 9 AND b.cy BETWEEN a.miny - 9 AND a.maxy + 9) SELECT video, frame, a, b, CAST(row_number() OVER (PARTITION BY video, frame, a ORDER BY d, b) AS INT) AS rank FROM n""")
def _(spark, d):
    return linking.neighbours(objects(spark, d))


@query("h02_classified_links", f"{OBJECTS} SELECT * FROM classed")
def _(spark, d):
    o = objects(spark, d)
    return linking.classified(o, linking.box_links(o))


@query("h05_track_ids", f"""{OBJECTS.replace('WITH', 'WITH RECURSIVE', 1)}, t AS (SELECT video, frame, label, dense_rank() OVER (PARTITION BY video ORDER BY frame, label) AS track FROM heads
  UNION ALL SELECT p.video, p.frame, p.label, t.track FROM t JOIN p ON p.video = t.video AND p.frame = t.frame + 1 AND p.before = t.label)
SELECT video, frame, label, CAST(track AS INT) AS track FROM t""")
def _(spark, d):
    o = objects(spark, d)
    return linking.track_ids(o, linking.classified(o, linking.box_links(o)))


@query("h06_edges", f"""{OBJECTS.replace('WITH', 'WITH RECURSIVE', 1)}, t AS (SELECT video, frame, label, dense_rank() OVER (PARTITION BY video ORDER BY frame, label) AS track FROM heads
  UNION ALL SELECT p.video, p.frame, p.label, t.track FROM t JOIN p ON p.video = t.video AND p.frame = t.frame + 1 AND p.before = t.label)
SELECT DISTINCT c.video, CAST(x.track AS INT) AS parent, CAST(y.track AS INT) AS child, c.frame, c.kind FROM classed c JOIN t x ON x.video = c.video AND x.frame + 1 = c.frame AND x.label = c.a JOIN t y ON y.video = c.video AND y.frame = c.frame AND y.label = c.b WHERE c.kind LIKE '%N%' AND c.kind <> 'NEW'""")
def _(spark, d):
    o = objects(spark, d)
    c = linking.classified(o, linking.box_links(o))
    return linking.edges(c, linking.track_ids(o, c))


@query("d34_object_statistics", f"WITH {frames_sql()} SELECT trial AS video, id AS track, count(*) AS n, CAST(96 AS DOUBLE) AS area_mean, round(stddev_samp(width), 6) AS width_sd, round(stddev_samp(perimeter), 6) AS perimeter_sd FROM frames GROUP BY ALL")
def _(spark, d):
    o = objects(spark, d).withColumnRenamed("label", "track")
    return rnd(linking.object_statistics(o).select("video", "track", "n", "area_mean", "width_sd", "perimeter_sd"))


_LIVES = """WITH l AS (SELECT 'T' || (c_custkey % 5) AS video, c_custkey % 97 AS start, c_custkey % 97 + 2 + c_custkey % 31 AS finish, 1 + c_custkey % 3 AS size FROM customer)"""


@query("d35_most_at_once", f"{_LIVES}, f AS (SELECT DISTINCT video, start + 1 AS f FROM l) SELECT f.video, CAST(max(s) AS BIGINT) AS most FROM (SELECT f.video, f.f, sum(size) AS s FROM f JOIN l ON l.video = f.video AND l.start < f.f AND f.f < l.finish GROUP BY ALL) f GROUP BY 1")
def _(spark, d):
    c = F.col("c_custkey")
    lives = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("T"), c % 5).alias("video"), (c % 97).alias("start"), (c % 97 + 2 + c % 31).alias("end"), (1 + c % 3).alias("size"))
    return linking.most_at_once(lives)


@query("h10_best_pairing", """WITH c AS (SELECT 'v' AS video, o_orderkey // 40 AS frame, o_custkey % 3 AS a, o_orderkey % 7 % 3 AS b, min(o_totalprice) AS d FROM orders GROUP BY ALL),
s AS (SELECT video, frame, [struct_pack(a := a, b := b, d := d)] AS ps FROM c UNION ALL
      SELECT x.video, x.frame, [struct_pack(a := x.a, b := x.b, d := x.d), struct_pack(a := y.a, b := y.b, d := y.d)] FROM c x JOIN c y USING (video, frame) WHERE x.a < y.a AND x.b <> y.b UNION ALL
      SELECT x.video, x.frame, [struct_pack(a := x.a, b := x.b, d := x.d), struct_pack(a := y.a, b := y.b, d := y.d), struct_pack(a := z.a, b := z.b, d := z.d)]
      FROM c x JOIN c y USING (video, frame) JOIN c z USING (video, frame) WHERE x.a < y.a AND y.a < z.a AND x.b <> y.b AND x.b <> z.b AND y.b <> z.b),
r AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY len(ps) DESC, list_sum(list_transform(ps, lambda p: p.d)) / (1 + (len(ps) - 1) * 1.5), ps) AS r FROM s),
u AS (SELECT video, frame, unnest(ps) AS p FROM r WHERE r = 1) SELECT video, frame, p.a AS a, p.b AS b, p.d AS d FROM u""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = o.select(F.lit("v").alias("video"), F.expr("o_orderkey div 40").alias("frame"), (F.col("o_custkey") % 3).alias("a"), (F.col("o_orderkey") % 7 % 3).alias("b"), F.col("o_totalprice").alias("d"))
    return linking.best_pairing(c.groupBy("video", "frame", "a", "b").agg(F.min("d").alias("d")))


@query("h12_shape_breaks", f"""WITH {measures_sql()}, z AS (SELECT id, frame, (spine_length - avg(spine_length) OVER w) / stddev_samp(spine_length) OVER w - (width - avg(width) OVER w) / stddev_samp(width) OVER w
  + (area - avg(area) OVER w) / stddev_samp(area) OVER w + (perimeter - avg(perimeter) OVER w) / stddev_samp(perimeter) OVER w AS s FROM measures WINDOW w AS (PARTITION BY id)),
y AS (SELECT *, (s - avg(s) OVER w) / stddev_samp(s) OVER w AS t FROM z WINDOW w AS (PARTITION BY id))
SELECT id, frame, coalesce(avg(t) OVER (PARTITION BY id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) < -1.0009, false) AS shape_break FROM y""")
def _(spark, d):
    return collisions.shape_breaks(measures(spark, d).withColumn("roundness", F.col("area")), -1.0009).select("id", "frame", "shape_break")


@query("h13_straightened_ends")
def _(spark, d):
    return collisions.straightened_ends(frames(spark, d)).select("id", "frame", "swapped")


@query("h31_shape_features", f"WITH {frames_sql()} SELECT id, frame, round(perimeter * perimeter / (2 * pi() * area), 6) AS roundness FROM frames")
def _(spark, d):
    return rnd(collisions.shape_features(frames(spark, d)).select("id", "frame", "roundness"))


@query("h34_gap_velocities", f"""WITH {frames_sql()}, x AS (SELECT * FROM frames WHERE frame % 7 <> 3), v AS (SELECT id, frame, 16 * sqrt(power(spinepoint_x_6 - lag(spinepoint_x_6) OVER t, 2) + power(spinepoint_y_6 - lag(spinepoint_y_6) OVER t, 2)) / (frame - lag(frame) OVER t) AS v FROM x WINDOW t AS (PARTITION BY id ORDER BY frame))
SELECT id, frame, round(v, 6) AS velocity, round(max(v) OVER (PARTITION BY id ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS velocity_max FROM v""")
def _(spark, d):
    return rnd(collisions.gap_velocities(frames(spark, d).where("frame % 7 <> 3")).select("id", "frame", "velocity", "velocity_max"))


_EDGES = "WITH e AS (SELECT DISTINCT o_orderkey // 200 AS video, o_custkey % 50 AS parent, 50 + o_orderkey % 53 AS child FROM orders)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.expr("o_orderkey div 200").alias("video"), (F.col("o_custkey") % 50).alias("parent"), (50 + F.col("o_orderkey") % 53).alias("child")).distinct()


@query("h17_families", f"""{_EDGES.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT DISTINCT a.video, a.parent AS p, b.parent AS q FROM e a JOIN e b ON a.video = b.video AND a.child = b.child),
r AS (SELECT video, p, q FROM s UNION SELECT r.video, r.p, s.q FROM r JOIN s ON s.video = r.video AND s.p = r.q), m AS (SELECT video, p, min(q) AS family FROM r GROUP BY ALL)
SELECT e.video, e.parent, e.child, m.family FROM e JOIN m ON m.video = e.video AND m.p = e.parent""")
def _(spark, d):
    return collisions.families(_edges(spark, d))


@query("h16_bundle_bounds", f"""{_EDGES}, t AS (SELECT video, parent AS track FROM e UNION SELECT video, child FROM e), p AS (SELECT video, child AS track, count(DISTINCT parent) AS p FROM e GROUP BY ALL), c AS (SELECT video, parent AS track, count(DISTINCT child) AS c FROM e GROUP BY ALL)
SELECT t.video, t.track, CAST(greatest(1, coalesce(p, 0), coalesce(c, 0)) AS BIGINT) AS low FROM t LEFT JOIN p ON p.video = t.video AND p.track = t.track LEFT JOIN c ON c.video = t.video AND c.track = t.track""")
def _(spark, d):
    e = _edges(spark, d)
    lives = e.select("video", F.col("parent").alias("track")).unionAll(e.select("video", "child")).distinct().withColumn("area", F.lit(None).cast("double"))
    return collisions.bundle_bounds(lives, e).select("video", "track", "low")


@query("h20_collision_candidates", f"""{_EDGES}, p AS (SELECT video, child AS track FROM e GROUP BY ALL HAVING count(DISTINCT parent) = 2), c AS (SELECT video, parent - 50 + 100 AS track FROM e GROUP BY video, parent HAVING count(DISTINCT child) = 2)
SELECT p.video, p.track, 1 + p.track % 9 AS duration FROM p JOIN c ON c.video = p.video AND c.track = p.track WHERE 1 + p.track % 9 <= 6""")
def _(spark, d):
    e = _edges(spark, d)
    # parents are renumbered onto children, so that tracks have both sides
    both = e.select("video", "parent", "child").unionAll(e.select("video", (F.col("parent") + 50).alias("parent"), (F.col("child") + 1000).alias("child")))
    lives = both.select("video", F.col("child").alias("track")).distinct().withColumns({"start": F.lit(0), "end": 1 + F.col("track") % 9})
    return collisions.collision_candidates(lives, both, 6)


_REMAP = "WITH RECURSIVE m AS (SELECT c_custkey AS old, c_custkey + 1 + c_custkey % 3 AS new FROM customer WHERE c_custkey % 7 <> 0)"


@query("h25_remap", f"{_REMAP}, r AS (SELECT old, new FROM m UNION SELECT r.old, m.new FROM r JOIN m ON m.old = r.new) SELECT old, max(new) AS new FROM r GROUP BY old")
def _(spark, d):
    c = F.col("c_custkey")
    return collisions.resolved_map(spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 7 <> 0").select(c.alias("old"), (c + 1 + c % 3).alias("new")))


@query("f07_gap_rows", f"WITH {measures_sql()}, x AS (SELECT id, frame FROM measures WHERE frame % 7 NOT IN (3, 4)), z AS (SELECT id, min(frame) AS a, max(frame) AS b FROM x GROUP BY id) SELECT m.id, m.frame FROM measures m JOIN z ON z.id = m.id AND m.frame BETWEEN a AND b WHERE m.frame % 7 IN (3, 4)")
def _(spark, d):
    return collisions.gap_rows(measures(spark, d).where("frame % 7 NOT IN (3, 4)").select("id", "frame"))


@query("f08_last_per_id", "SELECT o_custkey AS id, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_custkey", "id")
    return collisions.last_per_id(o, ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey", "o_totalprice")


@query("f09_missing_ids", "WITH r AS (SELECT o_custkey AS id, count(*) AS bundle FROM orders WHERE o_custkey > 0 GROUP BY 1) SELECT i AS id, coalesce(bundle, 0) AS bundle FROM range(1, (SELECT max(id) + 1 FROM r)) t(i) LEFT JOIN r ON r.id = i")
def _(spark, d):
    r = spark.read.parquet(f"{d}/orders.parquet").where("o_custkey > 0").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("bundle"))
    return collisions.with_missing_ids(r, bundle=0)


@query("h26_two_by_two")
def _(spark, d):
    # every 90 frames of a pair are a collision, 45 before and 45 after
    m = measures(spark, d).where("midpoint_speed IS NOT NULL")
    collision = F.concat_ws("-", F.floor(F.col("id") / 2), F.floor(F.col("frame") / 90))
    role = F.concat(F.when(F.col("frame") % 90 < 45, "in").otherwise("out"), (F.col("id") % 2 + 1).cast("string"))
    # outgoing animals keep a shift of their own, so that pairs can be told apart
    value = F.col("midpoint_speed") + F.when(F.col("id") % 2 == 1, 8.0).otherwise(0.0)
    return rnd(collisions.resolve_two(m.select(collision.alias("collision"), role.alias("role"), value.alias("value"))), digits=9)


# logs and detections derived from the events table

_LINES = """WITH e AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS c FROM events)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")
    line = F.when(i % 4 == 0, F.format_string("CNTTRACK: %d,NEW ,%d->c(%d)", i, -(i % 3), u)).when(i % 4 == 1, F.format_string("CNTTRACK: %d,LOST,%d->%d", i, u, -(i % 3))).when(i % 4 == 2, F.format_string("CNTTRACK: %d,N->1,[%d,%d]->c(%d)", i, u, u + 1, u + 2)).otherwise(F.format_string("MODEL: ID: %d>%d", u, u + 1))
    return e.select(line.alias("value"))


@query("a15_event_log", f"""{_LINES} SELECT CASE event_id % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'LOST' WHEN 2 THEN 'N->1' ELSE 'MODEL' END AS kind, CASE WHEN event_id % 4 < 3 THEN CAST(event_id AS INT) END AS frame,
CASE event_id % 4 WHEN 0 THEN -(event_id % 3) ELSE user_id END AS first_id, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN -(event_id % 3) WHEN 2 THEN user_id + 2 ELSE user_id + 1 END AS to_id FROM e""")
def _(spark, d):
    p = detections.parse_log(_lines(spark, d))
    return p.select("kind", "frame", F.get("ids", 0).alias("first_id"), F.get("to_ids", 0).alias("to_id"))


@query("a10_detections", f"{OBJECTS} SELECT video, frame AS frame_index, label, 96 AS area, cx, cy FROM objects")
def _(spark, d):
    o = objects(spark, d).select("video", F.col("frame").alias("frame_index"), "label", F.lit(96).alias("area"), "cx", "cy", F.col("minx").cast("int").alias("x"), F.col("miny").cast("int").alias("y"), F.lit(12).alias("width"), F.lit(8).alias("height"))
    # a video's detections are one log; here all logs travel as lines of one table
    lines = detections.nested(o, ["video"]).select("video", F.to_json(F.struct("frame_index", "n_blobs", "blobs")).alias("line"))
    back = lines.select("video", F.from_json("line", detections.SCHEMA).alias("r")).select("video", "r.*")
    return detections.exploded(back, ["video"]).select("video", "frame_index", "label", "area", "cx", "cy")


# pixels

PIXELS = """WITH v AS (SELECT label AS video, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, embedding FROM embeddings),
pixels AS (SELECT video, frame, CAST(p % 8 AS INT) AS x, CAST(p // 8 AS INT) AS y, CAST(greatest(0, least(255, floor((CAST(embedding[p + 1] AS DOUBLE) + 1) * 127.5))) AS INT) AS grey FROM v, range(64) t(p))"""


def pixel_table(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    e.createOrReplaceTempView("_embeddings")
    v = spark.sql("SELECT label AS video, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, embedding FROM _embeddings")
    v = v.select("video", "frame", F.posexplode("embedding").alias("p", "v"))
    return v.select("video", "frame", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 1) * 127.5))).cast("int").alias("grey"))


@query("i01_min_background", f"{PIXELS} SELECT video, x, y, min(grey) AS background FROM pixels WHERE frame % 10 = 0 AND frame < 1000 GROUP BY ALL")
def _(spark, d):
    # the background job's own sample: 100 frames, every tenth
    return pixels.min_background(pixel_table(spark, d))


@query("i06_mean_clamp", f"""{PIXELS}, c AS (SELECT *, greatest(grey, CAST(floor(avg(grey) OVER w) AS INT)) AS g FROM pixels WINDOW w AS (PARTITION BY video, frame))
SELECT video, frame, x, y, CAST(coalesce(floor((g - min(g) OVER w) * 255.0 / nullif(max(g) OVER w - min(g) OVER w, 0)), 0) AS INT) AS grey FROM c WINDOW w AS (PARTITION BY video, frame)""")
def _(spark, d):
    return pixels.mean_clamped(pixel_table(spark, d)).select("video", "frame", "x", "y", "grey")


@query("i08_circle", f"{PIXELS} SELECT video, frame, count(*) AS n FROM pixels WHERE power(x - 3.5, 2) + power(y - 3.5, 2) <= 9 AND grey > 0 GROUP BY ALL")
def _(spark, d):
    return pixels.inside_circle(pixel_table(spark, d), (3.5, 3.5, 3.0)).where("grey > 0").groupBy("video", "frame").agg(F.count("*").alias("n"))


_OTSU = f"""{PIXELS}, h AS (SELECT video, frame, grey, count(*)::DOUBLE AS n FROM pixels GROUP BY ALL),
q AS (SELECT video, frame, grey, sum(n) OVER s AS w0, sum(n * grey) OVER s AS s0, sum(n) OVER a AS w, sum(n * grey) OVER a AS s FROM h WINDOW s AS (PARTITION BY video, frame ORDER BY grey ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY video, frame)),
t AS (SELECT video, frame, grey AS threshold FROM q QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY coalesce(power(s0 * w - s * w0, 2) / nullif(w0 * (w - w0), 0), 0) DESC, grey) = 1)"""


@query("i09_otsu", f"{_OTSU} SELECT * FROM t")
def _(spark, d):
    return pixels.otsu(pixel_table(spark, d))


@query("i10_dilation", f"""{_OTSU}, f AS (SELECT p.* FROM pixels p JOIN t USING (video, frame) WHERE grey > threshold), g AS (SELECT DISTINCT video, frame, x + dx AS x, y + dy AS y FROM f, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy))
SELECT video, frame, count(*) AS n, CAST(sum(grey) AS BIGINT) AS total FROM pixels JOIN g USING (video, frame, x, y) GROUP BY ALL""")
def _(spark, d):
    p = pixel_table(spark, d)
    return pixels.dilated(pixels.foreground(p), p).groupBy("video", "frame").agg(F.count("*").alias("n"), F.sum("grey").alias("total"))


def _labels(source: str) -> str:
    """CTEs r, m, z: pixels reached from each pixel of the CTE ``source``, least positions, and blobs of 2 to 60 pixels."""
    return f"""r AS (SELECT video, frame, x, y, x AS a, y AS b FROM {source} UNION SELECT r.video, r.frame, r.x, r.y, f.x, f.y FROM r JOIN {source} f ON f.video = r.video AND f.frame = r.frame AND abs(f.x - r.a) <= 1 AND abs(f.y - r.b) <= 1),
m AS (SELECT video, frame, x, y, min(a * 8 + b) AS c FROM r GROUP BY ALL), z AS (SELECT video, frame, c, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM m GROUP BY ALL HAVING count(*) BETWEEN 2 AND 60)
SELECT video, frame, area, round(cx, 6) AS cx, round(cy, 6) AS cy, minx, maxx, miny, maxy, CAST(row_number() OVER (PARTITION BY video, frame ORDER BY c) AS INT) AS label FROM z"""


@query("i12_blobs", f"""{_OTSU.replace('WITH', 'WITH RECURSIVE', 1)}, f AS (SELECT video, frame, x, y FROM pixels p JOIN t USING (video, frame) WHERE grey > threshold), {_labels('f')}""")
def _(spark, d):
    return rnd(pixels.blobs(pixels.labelled(pixels.foreground(pixel_table(spark, d))), 2, 60))


def _stretch(c: str, source: str, name: str) -> str:
    return f"""{name} AS (SELECT video, frame, x, y, CAST(coalesce(floor(({c} - min({c}) OVER w) * 255.0 / nullif(max({c}) OVER w - min({c}) OVER w, 0)), 0) AS INT) AS grey FROM {source} WINDOW w AS (PARTITION BY video, frame))"""


_CLEAN = f"""{PIXELS.replace('WITH', 'WITH RECURSIVE', 1)}, c AS (SELECT *, greatest(grey, CAST(floor(avg(grey) OVER (PARTITION BY video, frame)) AS INT)) AS g FROM pixels),
{_stretch('g', 'c', 'clamped')}, back AS (SELECT video, x, y, min(grey) AS background FROM pixels WHERE frame % 10 = 0 AND frame < 1000 GROUP BY ALL),
d AS (SELECT q.video, q.frame, q.x, q.y, greatest(0, least(255, q.grey - background)) AS g FROM clamped q JOIN back USING (video, x, y)), {_stretch('g', 'd', 's')},
clean AS (SELECT video, frame, x, y, CASE WHEN power(x - 3.5, 2) + power(y - 3.5, 2) <= 25 THEN grey ELSE 0 END AS grey FROM s),
h AS (SELECT video, frame, grey, count(*)::DOUBLE AS n FROM clean GROUP BY ALL),
q AS (SELECT video, frame, grey, sum(n) OVER s AS w0, sum(n * grey) OVER s AS s0, sum(n) OVER a AS w, sum(n * grey) OVER a AS s FROM h WINDOW s AS (PARTITION BY video, frame ORDER BY grey ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY video, frame)),
t AS (SELECT video, frame, grey AS threshold FROM q QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY coalesce(power(s0 * w - s * w0, 2) / nullif(w0 * (w - w0), 0), 0) DESC, grey) = 1),
front AS (SELECT clean.* FROM clean JOIN t USING (video, frame) WHERE grey > threshold),
g AS (SELECT DISTINCT video, frame, x + dx AS x, y + dy AS y FROM front, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)),
f AS (SELECT video, frame, x, y FROM clean JOIN g USING (video, frame, x, y) WHERE grey > 0)"""


@query("i14_detection", f"{_CLEAN}, {_labels('f')}")
def _(spark, d):
    return rnd(pixels.detect(pixel_table(spark, d), (3.5, 3.5, 5.0), 2, 60))


@query("i04_replaced_frames", f"""{PIXELS.replace('WITH', 'WITH RECURSIVE', 1)}, g AS (SELECT video, frame, list(grey ORDER BY y, x) AS v FROM pixels GROUP BY ALL),
k AS (SELECT video, frame, frame AS shown, v FROM g WHERE frame = 0 UNION ALL
      SELECT g.video, g.frame, CASE WHEN near THEN g.frame ELSE k.shown END, CASE WHEN near THEN g.v ELSE k.v END
      FROM k JOIN g ON g.video = k.video AND g.frame = k.frame + 1, LATERAL (SELECT list_distance(CAST(g.v AS DOUBLE[]), CAST(k.v AS DOUBLE[])) <= 64 * 13.0 AS near))
SELECT k.video, k.frame, p.x, p.y, p.grey FROM k JOIN pixels p ON p.video = k.video AND p.frame = k.shown""")
def _(spark, d):
    return pixels.with_replaced_frames(pixel_table(spark, d), 13.0)


@query("i02_mean_background", f"""{PIXELS}, a AS (SELECT video, x, y, avg(grey) AS m FROM pixels GROUP BY ALL) SELECT video, x, y, round(coalesce((m - min(m) OVER w) * 255 / nullif(max(m) OVER w - min(m) OVER w, 0), 0)) AS background FROM a WINDOW w AS (PARTITION BY video)""")
def _(spark, d):
    return pixels.mean_background(pixel_table(spark, d))


@query("i03_first_frame", f"{PIXELS} SELECT p.video, p.frame - 1 AS frame, p.x, p.y, p.grey, b.grey AS background FROM pixels p JOIN pixels b ON b.video = p.video AND b.x = p.x AND b.y = p.y AND b.frame = 0 WHERE p.frame > 0")
def _(spark, d):
    background, rest = pixels.first_frame_background(pixel_table(spark, d))
    return rest.join(background, pixels.PIXEL).select("video", "frame", "x", "y", "grey", "background")


@query("i05_adjusted", f"{PIXELS} SELECT video, frame, x, y, 255 - CAST(greatest(0, least(255, round(1.5 * grey - 40))) AS INT) AS grey FROM pixels")
def _(spark, d):
    return pixels.adjusted(pixel_table(spark, d), contrast=1.5, brightness=215.0, invert=True)


@query("i07_subtracted", f"""{PIXELS}, back AS (SELECT video, x, y, min(grey) AS background FROM pixels WHERE frame % 10 = 0 AND frame < 1000 GROUP BY ALL),
d AS (SELECT q.video, q.frame, q.x, q.y, greatest(0, least(255, q.grey - background)) AS g FROM pixels q JOIN back USING (video, x, y)), {_stretch('g', 'd', 's')} SELECT * FROM s""")
def _(spark, d):
    p = pixel_table(spark, d)
    return pixels.subtracted(p, pixels.min_background(p))


@query("i13_away_from_rim", f"{OBJECTS} SELECT video, frame, label FROM objects WHERE power(cx - 400, 2) + power(cy - 400, 2) <= power(0.95 * 160, 2)")
def _(spark, d):
    return pixels.away_from_rim(objects(spark, d), 160.0, 400.0, 400.0).select("video", "frame", "label")


@query("i10_remasked", f"""{_OTSU}, f AS (SELECT p.* FROM pixels p JOIN t USING (video, frame) WHERE grey > threshold), g AS (SELECT DISTINCT video, frame, x + dx AS x, y + dy AS y FROM f, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy))
SELECT video, frame, x, y, CASE WHEN g.video IS NOT NULL THEN grey ELSE 0 END AS grey FROM pixels LEFT JOIN g USING (video, frame, x, y)""")
def _(spark, d):
    p = pixel_table(spark, d)
    return pixels.remasked(p, pixels.dilated(pixels.foreground(p), p))


# learning

_FEATURES = ["midpoint_speed", "bending_angle", "tail_vel_forward", "area", "grey"]


@query("g10_principal_components")
def _(spark, d):
    return rnd(learning.principal_components(measures(spark, d), _FEATURES, 2, ["id", "frame"])[0])


@query("g09_clusters")
def _(spark, d):
    return learning.clusters(measures(spark, d), _FEATURES, 3, ["id", "frame"])[0]


@query("g12_forest_importance")
def _(spark, d):
    return learning.forest(measures(spark, d), _FEATURES, "condition", trees=40, folds=3, seeds=(1,))[1]


@query("g13_balanced_classes", f"WITH {measures_sql()}, n AS (SELECT condition, count(*) AS n FROM measures GROUP BY 1) SELECT condition, (SELECT max(n) FROM n) AS n FROM n")
def _(spark, d):
    return learning.balanced(measures(spark, d), "condition").groupBy("condition").agg(F.count("*").alias("n"))


@query("g16_mixture")
def _(spark, d):
    return learning.mixture(measures(spark, d), _FEATURES[:3], (2, 3), ["id", "frame"])[0]
