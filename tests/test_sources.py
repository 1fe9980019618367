from motiontab.operators import collisions
from motiontab.sources import detections, tracks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def row(frame, missing=False):
    points = ["na"] * 68 if missing else [str(k / 4) for k in range(68)]
    return ",".join([str(frame), *points, "1.5", "2.5", "0.1", "100", "900", "3.5", "1.0", "9.0", "0", "0.05"])


def test_track_folder(spark, tmp_path):
    home = tmp_path / "G1" / "C1" / "T1"
    write(home / "12.csv", "\n".join([row(0), row(1, True)]) + "\n")
    write(home / "3.csv", row(5) + "\n")
    write(home / "4.csv", "")
    write(home / "collisions.csv", "1,2,3\n")
    write(home / "vidAndLogs" / "metadata.txt", "[Trial Data]\nOdorA=x\nOdorB=y\nFPS=16\nn=1\nm=2\nplace=10.5, -4\n")
    write(tmp_path / "G1" / "C1" / "T2" / "vidAndLogs" / "metadata.txt", "")
    write(tmp_path / "G1" / "C1" / "T3" / "vidAndLogs" / "metadata.txt", "[Trial Data]\nOdorALocation=1, 2\n")
    read = tracks.read_tracks(spark, str(tmp_path), contours=True)
    got = {(r.name, r.frame): r for r in read.collect()}
    assert set(got) == {("12.csv", 0), ("12.csv", 1), ("3.csv", 5)}
    first, second = got["12.csv", 0], got["12.csv", 1]
    assert (first.group, first.condition, first.trial, first.track, first.id) == ("G1", "C1", "T1", 12, 1) and got["3.csv", 5].id == 2
    assert first.spinepoint_x_1 == 0.0 and first.contourpoint_y_22 == 67 / 4 and first.centroid_x == 1.5 and first.perimeter == 9.0
    assert second.spinepoint_x_1 is None and second.contourpoint_x_1 is None and second.collision_flag == 0
    assert not [c for c in tracks.read_tracks(spark, str(tmp_path)).columns if c.startswith("contour")]
    meta = {r.trial: r for r in tracks.read_metadata(spark, str(tmp_path)).collect()}
    assert (meta["T1"].odor_a_x, meta["T1"].odor_a_y) == (10.5, -4.0) and meta["T1"].pairs["FPS"] == "16"
    assert "T2" not in meta and (meta["T3"].odor_a_x, meta["T3"].odor_a_y) == (1.0, 2.0)
    assert {r.odor_a_x for r in tracks.with_odor(read, tracks.read_metadata(spark, str(tmp_path))).collect()} == {10.5}


def test_analysis_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "A", "x", 2.0)], "id int, frame int, `group` string, condition string, speed double")
    tracks.write_analysis(df, str(tmp_path / "a"), radius=42.5, frame_rate=16)
    frames, parameters = tracks.read_analysis(spark, str(tmp_path / "a"))
    assert frames.first().group_condition == "A-x" and parameters.first().radius == 42.5
    tracks.write_table(df, str(tmp_path / "t"))
    assert tracks.read_table(spark, str(tmp_path / "t")).first().speed == 2.0
    tracks.write_tracks(df.select("id", "frame", "speed"), str(tmp_path / "w"))
    assert [p.name for p in (tmp_path / "w").glob("id=*")] == ["id=1"]


def test_catalogue(spark, tmp_path):
    write(tmp_path / "v.csv", "variable,name,unit,category\nspeed,Speed,mm/s,TS\n,blank,,\nHCs,Casts,,HC\n")
    assert [r.variable for r in tracks.read_catalogue(spark, str(tmp_path / "v.csv"), ["HC"]).collect()] == ["HCs"]
    assert tracks.read_catalogue(spark, str(tmp_path / "v.csv")).count() == 2


def test_log_to_collisions(spark, tmp_path):
    lines = ["CNTTRACK: 1,NEW ,-1->c(1)", "CNTTRACK: 1,NEW ,0->c(2)", "CNTTRACK: 5,N->1,[1,2]->c(3)", "CNTTRACK: 9,1->N,3->[4,5](4 5 )", "CNTTRACK: 12,LOST,4->0", "RES: OK Sizes: 9, 9, 9", "RES: OK Sizes: 1, 1, 2, 1, 1", "MODEL: ID: 4>1", "noise"]
    write(tmp_path / "log.txt", "\n".join(lines))
    events = detections.read_log(spark, str(tmp_path / "log.txt"))
    assert events.count() == 8
    got = {r.id: r for r in collisions.columnised(events).collect()}
    assert got[1].merged_into == 3 and got[2].merged_into == 3 and got[1].origin == -1 and got[2].origin == 0
    assert (got[3].split1, got[3].split2, got[3].split3, got[3].bundle) == (4, 5, None, 2)
    assert collisions.resolved_map(events.where("kind = 'MODEL'").selectExpr("ids[0] AS old", "to_ids[0] AS new")).collect() == [(4, 1)]


def test_detections_round_trip(spark, tmp_path):
    blobs = spark.createDataFrame([(0, 1, 50, 1.5, 2.5, 1, 2, 3, 4), (0, 2, 60, 5.5, 6.5, 5, 6, 7, 8), (3, 1, 70, 0.0, 0.0, 0, 0, 1, 1)], "frame_index int, label int, area int, cx double, cy double, x int, y int, width int, height int")
    detections.write_detections(blobs, str(tmp_path / "d"))
    back = detections.read_detections(spark, str(tmp_path / "d"))
    assert sorted(back.collect()) == sorted(blobs.collect())
    assert tuple(detections.run_counts(back).first()) == (2, 3, 60.0)
