import random

from motiontab.operators import pixels


def square(spark, side, low, high, grey, ground=30, frames=1):
    rows = [(0, f, x, y, grey if f == frames - 1 and low <= x < high and low <= y < high else ground) for f in range(frames) for x in range(side) for y in range(side)]
    return spark.createDataFrame(rows, "video int, frame int, x int, y int, grey int")


def test_bright_square_is_one_blob(spark):
    df = square(spark, 32, 10, 20, 200, frames=2)
    found = pixels.detect(df, None, 20, 2000).collect()
    big = max(found, key=lambda r: r.area)
    assert big.frame == 1 and big.area > 50 and abs(big.cx - 14.5) < 1e-9 and big.label == 1
    # the image is masked by the grown foreground, and what is above zero in it is labelled
    assert (big.area, big.minx, big.maxx, big.miny, big.maxy) == (100, 10, 19, 10, 19) and len(found) == 1


def test_mean_clamp_reaches_255(spark):
    out = pixels.mean_clamped(square(spark, 16, 3, 8, 200, 0))
    assert out.agg({"grey": "max"}).first()[0] == 255 and out.agg({"grey": "min"}).first()[0] == 0


def test_area_filter_and_components(spark):
    cells = [(0, 0, x, y) for x, y in ((10, 10), (11, 11), (10, 11), (20, 20), (1, 5), (2, 6), (3, 7), (4, 8), (5, 9))]
    lab = pixels.labelled(spark.createDataFrame(cells, "video int, frame int, x int, y int"))
    sizes = sorted(r.area for r in pixels.blobs(lab).collect())
    assert sizes == [1, 3, 5]
    assert pixels.blobs(lab, 100, 200).count() == 0 and pixels.blobs(lab, 2, 3).first().label == 1


def test_components_equal_a_flood_fill(spark):
    pick = random.Random(4)
    cells = {(f, x, y) for f in range(3) for x in range(-4, 20) for y in range(15) if pick.random() < 0.45}
    lab = pixels.labelled(spark.createDataFrame([("v", f, x, y, 1) for f, x, y in cells], "video string, frame int, x int, y int, grey int"))
    got = {(r.frame, r.x, r.y): (r.c.x, r.c.y) for r in lab.collect()}
    for cell in cells:
        seen, todo = {cell}, [cell]
        while todo:
            f, x, y = todo.pop()
            for near in ((f, x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if near in cells and near not in seen:
                    seen.add(near)
                    todo.append(near)
        assert got[cell] == min((x, y) for _, x, y in seen)
    assert len(got) == len(cells)
    assert pixels.labelled(spark.createDataFrame([("v", 0, 1, 1, 0)], "video string, frame int, x int, y int, grey int")).count() == 0


def test_replaced_frames_compare_with_the_last_kept_one(spark):
    pick = random.Random(6)
    for _ in range(4):
        greys = {v: [pick.choice([0, 1, 2, 9, 10, 11, 30]) for _ in range(25)] for v in ("a", "b")}
        df = spark.createDataFrame([(v, f, x, 0, g) for v, gs in greys.items() for f, g in enumerate(gs) for x in (0, 1)], "video string, frame int, x int, y int, grey int")
        got = {(r.video, r.frame): r.grey for r in pixels.with_replaced_frames(df, 1.5).where("x = 0").collect()}
        for v, gs in greys.items():
            kept = gs[0]
            for f, g in enumerate(gs):
                kept = g if (2 * (g - kept) ** 2) ** 0.5 <= 2 * 1.5 else kept
                assert got[v, f] == kept


def test_frame_steps(spark):
    df = square(spark, 4, 0, 2, 200, 30, frames=3)
    ground, rest = pixels.first_frame_background(df)
    assert ground.count() == 16 and {r.frame for r in rest.select("frame").distinct().collect()} == {0, 1}
    shown = pixels.with_replaced_frames(df, 1.0)
    assert shown.where("frame = 2").agg({"grey": "max"}).first()[0] == 30  # the third frame jumps, so the second shows
    assert pixels.adjusted(df, invert=True).where("grey = 225").count() == 16 * 3 - 4
    assert pixels.adjusted(df, contrast=2.0).agg({"grey": "max"}).first()[0] == 255
    assert pixels.mean_background(df).agg({"background": "max"}).first()[0] == 255.0
    assert pixels.away_from_rim(pixels.blobs(pixels.labelled(df.where("grey = 200 AND frame = 2").drop("grey"))), 10.0).count() == 1
