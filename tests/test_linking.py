import itertools
import random

from motiontab.operators import collisions, linking, partitions
from motiontab.streaming.linking import PROVIDER, stream_links, stream_statistics
from pyspark.sql import functions as F

SCHEMA = "video string, frame long, label long, cx double, cy double, minx double, maxx double, miny double, maxy double, area double"


def box(frame, label, x, y=0.0, w=10.0):
    return ("v", frame, label, float(x), y, x - w / 2, x + w / 2, y - 4, y + 4, float(w * 8))


def meeting(spark):
    """1 and 2 merge to 3, which splits to 4 and 5; 6 appears and goes."""
    rows = [box(0, 1, 0), box(0, 2, 20), box(1, 1, 2), box(1, 2, 18), box(2, 3, 10, w=26), box(3, 3, 10, w=26), box(4, 4, 2), box(4, 5, 18), box(2, 6, 100)]
    return spark.createDataFrame(rows, SCHEMA)


def test_merge_split_new_and_lost(spark):
    o = meeting(spark)
    c = linking.classified(o, linking.box_links(o))
    kinds = sorted((r.frame, r.a or 0, r.b or 0, r.kind) for r in c.collect())
    assert kinds == sorted([(0, 0, 1, "NEW"), (0, 0, 2, "NEW"), (1, 1, 1, "1->1"), (1, 2, 2, "1->1"), (2, 0, 6, "NEW"), (2, 1, 3, "N->1"), (2, 2, 3, "N->1"), (3, 3, 3, "1->1"), (3, 6, 0, "LOST"), (4, 3, 4, "1->N"), (4, 3, 5, "1->N")])
    t = linking.track_ids(o, c)
    track = {(r.frame, r.label): r.track for r in t.collect()}
    assert track[0, 1] == track[1, 1] == 1 and track[2, 3] == track[3, 3] == 3 and track[4, 4] != track[4, 5]
    e = linking.edges(c, t)
    assert e.count() == 4
    assert {r.family for r in collisions.families(e.where("frame = 2").select("video", "parent", "child")).collect()} == {1}
    lives = t.join(o, ["video", "frame", "label"]).groupBy("video", "track").agg(F.min("frame").alias("start"), F.avg("area").alias("area")).selectExpr("video", "track", "start", "start + 2 AS end", "area")
    sizes = {r.track: r.low for r in collisions.bundle_bounds(lives, e).collect()}
    assert sizes[track[2, 3]] == 2 and sizes[1] == 1
    assert [r.track for r in collisions.collision_candidates(lives, e, 5).collect()] == [track[2, 3]]
    flow, open_ = partitions.balanced(collisions.bundle_bounds(lives, e), collisions.families(e))
    assert open_.count() == 0 and {r.track: r["size"] for r in flow.collect()}[track[2, 3]] == 2
    ends = collisions.end_objects(flow, e)
    assert {r.single for r in ends.collect()} == {track[4, 4], track[4, 5]}


def test_end_objects_end_with_a_scan(spark):
    """Cycles, a chain of many rounds, a null child and rows given twice; the last plan joins, sorts and gathers nothing."""
    edges = [("v", k, k + 1) for k in range(20)] + [("v", 5, 2), ("v", 3, 30), ("v", 20, 21), ("v", 4, None), ("w", 1, 1), ("w", 1, 2), ("w", 2, 3)]
    sizes = [("v", k, 2) for k in range(20)] * 2 + [("v", 30, 1), ("w", 1, 3), ("w", 2, 1)]
    out = collisions.end_objects(spark.createDataFrame(sizes, "video string, track int, size int"), spark.createDataFrame(edges, "video string, parent int, child int"))
    want = [("v", k, 20) for k in range(20)] + [("v", k, x) for k in range(6) for x in (30, None)] + [("w", 1, 2)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Join", "Sort", "Aggregate", "Exchange"))


def test_stream_equals_batch(spark, tmp_path):
    """However the objects are split over batches, also within a frame and out of order."""
    pick = random.Random(3)
    rows = [r for r in map(tuple, meeting(spark).collect())]
    rows += [("w", f, n, *x[3:]) for f in range(6) for n in range(4) for x in [box(f, n, 12 * n + 3 * f * (n % 2))]]
    o = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r.video, r.frame, r.a, r.b, r.overlap) for r in linking.box_links(o).collect())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for turn in range(2):
        folder, parts = str(tmp_path / f"in{turn}"), [[] for _ in range(4)]
        for r in rows:
            pick.choice(parts).append(r)
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        q = stream_links(source).writeStream.format("memory").queryName(f"links{turn}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{turn}")).start()
        q.processAllAvailable()
        q.stop()
        assert sorted((r.video, r.frame, r.a, r.b, r.overlap) for r in spark.table(f"links{turn}").collect()) == want and len(want) > 15
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_silent_video_is_cleared(spark, tmp_path):
    """The second of two adjacent frames comes after the timer and finds none to link with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    folder = str(tmp_path / "in")
    spark.createDataFrame([box(0, 1, 0), box(1, 1, 0)], SCHEMA).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(SCHEMA).parquet(folder)
    q = stream_links(source, silent_seconds=1).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(12)
    spark.createDataFrame([box(2, 1, 0), box(3, 1, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    q.awaitTermination(12)
    q.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(r.frame for r in spark.table("silent").collect()) == [1, 3]


def test_stream_statistics(spark, tmp_path):
    schema = "id long, area double, width double, perimeter double, spine_length double, velocity double"
    spark.createDataFrame([(1, 2.0, 1.0, 3.0, 4.0, None), (1, 4.0, 1.0, 5.0, 6.0, 2.5)], schema).write.parquet(str(tmp_path / "s"))
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    q = stream_statistics(rows).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("running").first()
    assert (r.n, r.area_mean, r.perimeter_max, r.spine_length_mean, r.velocity_max) == (2, 3.0, 5.0, 5.0, 2.5)


def test_remap_gaps_and_queue(spark):
    pairs = spark.createDataFrame([(5, 3), (3, 2), (9, 8)], "old long, new long")
    assert sorted(map(tuple, collisions.resolved_map(pairs).collect())) == [(3, 2), (5, 2), (9, 8)]
    tracks = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 4, 3.0)], "id long, frame int, x double")
    merged = collisions.merged_tracks(tracks, spark.createDataFrame([(1, 2)], "incoming long, outgoing long"))
    assert sorted((r.id, r.frame, r.x) for r in merged.where("x IS NOT NULL").collect()) == [(2, 0, 1.0), (2, 1, 2.0), (2, 4, 3.0)]
    assert sorted(r.frame for r in merged.where("x IS NULL").collect()) == [2, 3]
    far = spark.createDataFrame([(1, 0, 80.0, 0.0, 0), (2, 0, 1.0, 1.0, 0), (3, 0, 1.0, 1.0, -1)], "id long, frame int, centroid_x double, centroid_y double, code int")
    assert {r.id: r.fine for r in collisions.location_checked(far).collect()} == {1: True, 2: False, 3: True}


def test_two_by_two(spark):
    rows = [(1, role, base + k * 0.01) for role, base in (("in1", 0.0), ("in2", 9.0), ("out1", 9.001), ("out2", 0.001)) for k in range(40)]
    rows += [(2, role, float(k)) for role in ("in1", "in2", "out1", "out2") for k in range(20)]
    got = {r.collision: r.straight for r in collisions.resolve_two(spark.createDataFrame(rows, "collision long, role string, value double")).collect()}
    assert got == {1: False, 2: None}


def test_two_by_two_takes_every_block_of_frames(spark):
    from motiontab.operators.stats import chi_square_tail
    from motiontab.plans.fixtures import measures
    from motiontab.plans import queries_linking  # noqa: F401
    from motiontab.plans.queries import QUERIES

    blocks = {}
    for r in measures(spark, "/root/testdata/sf0.01").where("midpoint_speed IS NOT NULL").select("id", "frame", "midpoint_speed").collect():
        role = ("in" if r.frame % 90 < 45 else "out") + str(r.id % 2 + 1)
        blocks.setdefault(f"{r.id // 2}-{r.frame // 90}", {}).setdefault(role, []).append(r.midpoint_speed + 8 * (r.id % 2))
    got = {r.collision: r for r in QUERIES["h26_two_by_two"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(blocks) and len(got) > 5
    for k, roles in blocks.items():
        if len(roles) < 4:
            assert got[k].straight is None
            continue
        values = sorted(v for some in roles.values() for v in some)
        n, rank = len(values), {v: (values.index(v) + 1 + len(values) - values[::-1].index(v)) / 2 for v in set(values)}
        h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in some) ** 2 / len(some) for some in roles.values()) - 3 * (n + 1)
        h /= 1 - sum(values.count(v) ** 3 - values.count(v) for v in set(values)) / (n**3 - n)
        assert abs(got[k].p_gate - chi_square_tail(h, 3)) < 1e-8


def test_least_pairs_equal_enumeration():
    pick = random.Random(5)
    for _ in range(300):
        n, m = pick.randint(1, 5), pick.randint(1, 5)
        edges = {(i, j): pick.choice([pick.random(), pick.randint(0, 3)]) for i in range(n) for j in range(m) if pick.random() < 0.6}
        best = (0, 0.0)
        for k in range(1, min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for columns in itertools.permutations(range(m), k):
                    pairs = list(zip(rows, columns, strict=True))
                    if all(p in edges for p in pairs):
                        total = sum(edges[p] for p in pairs)
                        best = max(best, (k, -total))
        found = linking.least_pairs(edges)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert (len(found), round(-sum(edges[p] for p in found), 9)) == (best[0], round(best[1], 9))


def test_pairing_of_a_crowded_frame(spark):
    """A hundred rows a side, which no enumeration would end, beside small frames, nulls and repeats."""
    rows = [("v", 1, a, b, float(abs(a - b))) for a in range(100) for b in range(100) if abs(a - b) < 4 and b != a]
    rows += [("v", 2, 1, 1, 5.0), ("v", 2, 1, 1, 3.0), ("v", 2, 2, None, 1.0), ("v", 2, None, 2, 1.0), ("w", 2, 9, 9, None)]
    out = linking.best_pairing(spark.createDataFrame(rows, "video string, frame int, a int, b int, d double")).collect()
    crowd = [r for r in out if r.frame == 1]
    assert len(crowd) == 100 == len({r.b for r in crowd}) and sum(r.d for r in crowd) == 100.0
    assert [(r.video, r.a, r.b, r.d) for r in out if r.frame == 2] == [("v", 1, 1, 3.0)]


def brute_links(rows, least):
    out = set()
    for f, a, ax, aX, ay, aY in rows:
        for g, b, bx, bX, by, bY in rows:
            w, h = min(aX, bX) - max(ax, bx), min(aY, bY) - max(ay, by)
            if g == f + 1 and w > 0 and h > 0 and w * h / ((bX - bx) * (bY - by)) > least:
                out.add((g, a, b))
    return out


def test_grid_links_of_boxes_of_every_size(spark):
    pick = random.Random(8)
    rows = []
    for frame in range(4):
        for label in range(60):
            size = pick.choice([0.3, 2, 10, 10, 64, 500])
            x, y = pick.uniform(-300, 300), pick.choice([pick.uniform(-300, 300), 0.0])
            rows.append((frame, label, x, x + size * pick.uniform(0.2, 1), y, y + size * pick.uniform(0.2, 1)))
    objects = spark.createDataFrame([("v", f, n, a, b, c, d, (a + b) / 2, (c + d) / 2, 1.0) for f, n, a, b, c, d in rows] + [("v", 1, 99, None, 1.0, 0.0, 1.0, None, 0.5, 1.0)], "video string, frame int, label int, minx double, maxx double, miny double, maxy double, cx double, cy double, area double")
    found = [(r.frame, r.a, r.b) for r in linking.box_links(objects, 0.05).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_links(rows, 0.05) and len(found) > 100
    near = {(r.frame, r.a): [] for r in linking.neighbours(objects).collect()}
    for r in sorted(linking.neighbours(objects).collect(), key=lambda r: r.rank):
        near[r.frame, r.a].append(r.b)
    for f, a, ax, aX, ay, aY in rows:
        more, cx, cy = 0.75 * max(aX - ax, aY - ay), (ax + aX) / 2, (ay + aY) / 2
        want = sorted((abs((x + X) / 2 - cx) + abs((y + Y) / 2 - cy), b) for g, b, x, X, y, Y in rows if g == f - 1 and ax - more <= (x + X) / 2 <= aX + more and ay - more <= (y + Y) / 2 <= aY + more)
        assert near.get((f, a), []) == [b for _, b in want]


def test_grid_spares_most_pairs_of_a_crowded_frame(spark):
    """Ten thousand objects in each of two frames: the join makes a few rows an object, not 10^8."""
    o = spark.range(20_000).select(F.lit("v").alias("video"), (F.col("id") % 2).cast("int").alias("frame"), F.expr("id div 2").alias("label"), F.expr("(id div 2) % 100 * 12.0D").alias("minx"), F.expr("(id div 200) * 12.0D").alias("miny"))
    o = o.withColumns({"maxx": F.col("minx") + 10, "maxy": F.col("miny") + 10, "cx": F.col("minx") + 5, "cy": F.col("miny") + 5, "area": F.lit(1.0)})
    links = linking.box_links(o)
    assert links.count() == 10_000
    plan = links._jdf.queryExecution().executedPlan()
    assert "Cartesian" not in plan.toString() and "NestedLoop" not in plan.toString()
    cells = linking._in_cells(o.withColumn("l", F.lit(4)), F.col("l"), "minx", "maxx", "miny", "maxy").groupBy("frame", "gx", "gy").count()
    assert cells.agg(F.max("count")).first()[0] <= 9


def test_track_ids_over_many_blocks(spark):
    """Chains that begin, end and cross borders of blocks, with labels that change from frame to frame."""
    pick, rows, links, want = random.Random(2), [], [], {}
    for chain in range(30):
        start, n = pick.randint(0, 80), pick.randint(1, 60)
        labels = [100 * chain + pick.randint(0, 99) for _ in range(n)]
        for k, label in enumerate(labels):
            rows.append(("v" if chain % 3 else "w", start + k, label))
            want[rows[-1]] = (rows[-1][0], start, labels[0])
            if k:
                links.append((rows[-1][0], start + k, labels[k - 1], label, "1->1"))
        if n > 1:
            links.append((rows[-1][0], start + n, labels[-1], 7, "N->1"))
    o = spark.createDataFrame(rows, "video string, frame long, label long")
    c = spark.createDataFrame(links, "video string, frame long, a long, b long, kind string")
    numbers = {}
    for head in sorted(set(want.values())):
        numbers[head] = sum(h[0] == head[0] for h in numbers) + 1
    got = {(r.video, r.frame, r.label): r.track for r in linking.track_ids(o, c, block=8).collect()}
    assert got == {k: numbers[h] for k, h in want.items()}


def test_no_table_of_objects_is_broadcast(spark):
    """The driver held the boxes of all cells where their file was small; one row for each video may go to all tasks."""
    o = meeting(spark)
    c = linking.classified(o, linking.box_links(o))
    shares = c.where("a IS NOT NULL AND b IS NOT NULL").select("video", "frame", "a", "b", F.lit(0.1).alias("of_a"), F.lit(0.9).alias("of_b"))
    rim = linking.rim_guarded(c, o, shares, 1.0)
    plan = rim._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1 < plan.count("SortMergeJoin")
    assert sorted((r.frame, r.a, r.b) for r in rim.where("rim = 'split'").collect()) == [(1, 1, 1), (1, 2, 2), (3, 3, 3)]


def test_boxes_of_one_level_are_dealt_once(spark):
    """Copies for finer boxes are only made where there are any."""
    o = spark.createDataFrame([box(f, k, 30.0 * k + 8.0) for f in (1, 2) for k in range(4)], SCHEMA)
    rows = linking._side(o, "b_").withColumn("own", F.lit(4))
    dealt = lambda levels: linking._ways(rows, "b_", levels, "x", "y").select("way").collect()
    assert {r.way for r in dealt([4])} == {"alike"} and {r.way for r in dealt([3, 4, 5])} == {"alike", "x", "y"}
