"""Per-animal track files, trial metadata, variable catalogues and analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motiontab.operators.orientation import tail_first
from motiontab.operators.stats import running_below

SPINE, CONTOUR = 12, 22


def fields() -> list[str]:
    """The 79 positional fields of a track row."""
    points = [f"{kind}_{a}_{k}" for kind, n in (("spinepoint", SPINE), ("contourpoint", CONTOUR)) for k in range(1, n + 1) for a in "xy"]
    return ["frame", *points, "centroid_x", "centroid_y", "blob_orient", "area", "grey", "spine_length", "width", "perimeter", "collision_flag", "ppm"]


TRACK_SCHEMA = T.StructType([T.StructField(c, T.IntegerType() if c in ("frame", "collision_flag") else T.DoubleType()) for c in fields()])


#: So many names of files are ranked in one task and sent to all; more are ranked by ranges and joined.
FEW_FILES = 100_000


def numbered(listing: DataFrame, few: bool) -> DataFrame:
    """(path, id): the place of each path in the order of paths, from 1."""
    if few:
        return listing.withColumn("id", F.row_number().over(Window.orderBy("path")).cast("int"))
    ranks = running_below(listing.withColumn("_one", F.lit(1)), [], "path", "_one")
    return ranks.select("path", (F.col("below") + 1).cast("int").alias("id"))


def read_tracks(spark: SparkSession, folder: str, contours: bool = False) -> DataFrame:
    """All track files below ``folder`` (names that end in a digit and .csv), without header.

    Keys come from the last four parts of a path: group, condition, trial, name; ``id`` is the file's place in the sorted
    listing, ``track`` the number in its name. Tokens that are no numbers, such as ``na``, are null. Empty files give
    no rows, but have a place in the listing. Contours are only parsed on demand.
    """
    rows = spark.read.schema(TRACK_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*[0-9].csv").option("nullValue", "na").option("mode", "PERMISSIVE").csv(folder)
    rows = rows.withColumn("path", F.col("_metadata.file_path")).drop("ppm")
    if not contours:
        rows = rows.drop(*[c for c in rows.columns if c.startswith("contourpoint_")])
    parts = F.split("path", "/")
    # files without rows take a number, too
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*[0-9].csv").load(folder).select("path")
    few = listing.count() <= FEW_FILES
    ids = numbered(listing, few)
    rows = rows.join(F.broadcast(ids) if few else ids, "path")
    rows = rows.withColumns({n: F.element_at(parts, -k) for k, n in enumerate(("name", "trial", "condition", "group"), 1)})
    return rows.withColumn("track", F.regexp_extract("name", r"(\d+)\.csv$", 1).cast("long")).drop("path")


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(group, condition, trial, pairs, odor_a_x, odor_a_y) from vidAndLogs/metadata.txt of each trial, or as ``write_metadata`` left it.

    pairs: the key=value lines as a map. The odour's place is the value of ``OdorALocation``, else of the sixth data row,
    else (0, 0). An empty file gives no row, which ``with_odor`` reads as (0, 0).
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{metadata,part-*}.txt").text(folder, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    data = F.filter(F.split("value", r"\r?\n"), lambda x: x.contains("="))
    pairs = F.map_from_entries(F.transform(data, lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))), F.trim(F.regexp_replace(x, "^[^=]*=", "")))))
    place = F.coalesce(F.try_element_at(pairs, F.lit("OdorALocation")), F.regexp_replace(F.get(data, 5), "^[^=]*=", ""))
    xy = F.split(place, ",")
    parts = F.split("path", "/")
    at = lambda k: F.coalesce(F.expr(f"try_cast(trim(get(xy, {k})) AS double)"), F.lit(0.0))
    # .../group/condition/trial/vidAndLogs/metadata.txt, or .../group=../condition=../trial=../part-...txt
    plain = lambda x: F.url_decode(F.regexp_replace(x, r"\+", "%2B"))
    # escaped as a partition's value, then as a path
    named = lambda n: plain(plain(F.nullif(F.regexp_extract("path", f"/{n}=([^/]*)/", 1), F.lit(""))))
    keys = {n: F.coalesce(named(n), F.element_at(parts, k)) for n, k in (("group", -5), ("condition", -4), ("trial", -3))}
    rows = lines.select(*[c.alias(n) for n, c in keys.items()], pairs.alias("pairs"), xy.alias("xy"))
    return rows.select("group", "condition", "trial", "pairs", at(0).alias("odor_a_x"), at(1).alias("odor_a_y"))


def with_odor(tracks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Tracks with the odour's place of their trial, (0, 0) where none is known."""
    keys = ["group", "condition", "trial"]
    out = tracks.join(metadata.select(*keys, "odor_a_x", "odor_a_y"), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("odor_a_x", "odor_a_y")})


def track_rows(objects: DataFrame, centre: tuple[float, float], ppm: float) -> DataFrame:
    """The 79 fields of track rows, with id, from objects in pixels.

    objects: id, frame, spine (array of 12 points x, y), pairs (array of 10 structs a, b: contour points on either side of the
    inner spine points), tail_x, tail_y, centroid_x, centroid_y, blob_orient, area, grey, spine_length, width, perimeter, collision_flag.
    Points become ((x - cx) ppm, (cy - y) ppm), the centroid's y is not mirrored. Spines go from the tail; where not just one
    end is the tail, points are null and the flag is 1. The contour runs along b from the first point and back along a.
    """
    turned, confused = tail_first("spine", F.struct(F.col("tail_x").alias("x"), F.col("tail_y").alias("y")))
    place = lambda p: F.struct(((p["x"] - centre[0]) * ppm).alias("x"), ((centre[1] - p["y"]) * ppm).alias("y"))
    known = F.coalesce(~confused, F.lit(False))
    side = lambda c: F.transform("pairs", lambda p: p[c])
    one, other = F.array(F.element_at("spine", 1)), F.array(F.element_at("spine", -1))
    out, back = side("b"), F.reverse(side("a"))
    contour = F.when(turned, F.concat(other, back, one, out)).otherwise(F.concat(one, out, other, back))
    rows = objects.withColumns({"_spine": F.when(known, F.transform(F.when(turned, F.reverse("spine")).otherwise(F.col("spine")), place)), "_contour": F.when(known, F.transform(contour, place))})
    points = {f"{kind}_{a}_{k}": F.get(f"_{array}", k - 1)[a] for kind, array, n in (("spinepoint", "spine", SPINE), ("contourpoint", "contour", CONTOUR)) for k in range(1, n + 1) for a in "xy"}
    scaled = {c: F.col(c) * ppm for c in ("spine_length", "width", "perimeter")}
    rows = rows.withColumns({**points, **scaled, "centroid_x": (F.col("centroid_x") - centre[0]) * ppm, "centroid_y": (F.col("centroid_y") - centre[1]) * ppm, "collision_flag": F.when(known, F.col("collision_flag")).otherwise(1), "ppm": F.lit(float(ppm))})
    return rows.select("id", *fields())


def model_rows(tracks: DataFrame, points: DataFrame) -> DataFrame:
    """``tracks`` with rows that a model supplies during a collision: (id, frame, any track columns), flag 2, the rest null."""
    return tracks.unionByName(points.withColumn("collision_flag", F.lit(2)), allowMissingColumns=True)


def long_tracks(df: DataFrame, least_rows: int, remap: DataFrame | None = None) -> DataFrame:
    """Rows of tracks of more than ``least_rows`` rows; with ``remap`` (old, new) the pieces of one new id count together."""
    if remap is not None:
        df = df.join(remap.select(F.col("old").alias("id"), F.col("new").alias("_new")), "id", "left").withColumn("id", F.coalesce("_new", "id")).drop("_new")
    long = df.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > least_rows).select("id")
    return df.join(long, "id", "left_semi")


def write_tracks(df: DataFrame, folder: str, least_rows: int = 0, remap: DataFrame | None = None) -> None:
    """One folder ``id=...`` of CSV per track of more than ``least_rows`` rows, points as written by trackers (``na``)."""
    rows = long_tracks(df, least_rows, remap)
    rows.repartition("id").sortWithinPartitions("id", "frame").write.partitionBy("id").option("nullValue", "na").csv(folder)


def write_collisions(collisions: DataFrame, path: str) -> None:
    """id, new1, new2, new3, origin, bundle, with header."""
    write_table(collisions.select("id", "new1", "new2", "new3", "origin", "bundle"), path)


def write_assignments(assignments: DataFrame, path: str) -> None:
    """incoming, outgoing, type, duration, forced, with header."""
    write_table(assignments.select("incoming", "outgoing", "type", "duration", "forced"), path)


def with_place(metadata: DataFrame) -> DataFrame:
    """Metadata whose pairs hold the odour's place as ``OdorALocation``, as it is written back."""
    place = F.concat_ws(",", F.col("odor_a_x").cast("string"), F.col("odor_a_y").cast("string"))
    kept = F.map_filter("pairs", lambda k, _: k != "OdorALocation")
    return metadata.withColumn("pairs", F.map_concat(kept, F.create_map(F.lit("OdorALocation"), place)))


def write_metadata(metadata: DataFrame, folder: str) -> None:
    """One text file below group=, condition= and trial= with the [Trial Data] lines, the odour's place among them."""
    lines = F.concat(F.lit("[Trial Data]\n"), F.array_join(F.transform(F.array_sort(F.map_entries("pairs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n"))
    with_place(metadata).select("group", "condition", "trial", lines.alias("value")).repartition("group", "condition", "trial").write.partitionBy("group", "condition", "trial").text(folder)


def write_analysis(frames: DataFrame, folder: str, **parameters) -> None:
    """Frames as Parquet by group and condition, parameters as one JSON row."""
    frames.write.partitionBy("group", "condition").parquet(f"{folder}/frames")
    spark = frames.sparkSession
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in parameters.items()] or [F.lit(None).cast("string").alias("none")]).write.json(f"{folder}/parameters")


def read_analysis(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(frames with group_condition, parameters)."""
    frames = spark.read.parquet(f"{folder}/frames").withColumn("group_condition", F.concat_ws("-", "group", "condition"))
    return frames, spark.read.json(f"{folder}/parameters")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A summary or binned table with header."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_catalogue(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """Variable catalogue (variable, name, unit, category, ..., has_ci boolean, min and max double where it has them); blank variables go."""
    rows = spark.read.option("header", True).csv(path).where("trim(coalesce(variable, '')) <> ''")
    kinds = {"has_ci": F.lower(F.trim("has_ci")).isin("1", "true", "yes", "t")} if "has_ci" in rows.columns else {}
    kinds |= {c: F.expr(f"try_cast(`{c}` AS double)") for c in ("min", "max") if c in rows.columns}
    rows = rows.withColumns(kinds) if kinds else rows
    return rows.where(F.col("category").isin(categories)) if categories else rows


def catalogued(table: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """A wide table as rows (keys, variable, name, unit, has_ci, value): named by the catalogue, values outside its min and max null.

    Variables that the catalogue lacks are left out, as are those of it that the table lacks.
    """
    named = {r.variable for r in catalogue.select("variable").distinct().collect()}  # a few dozen rows
    values = [c for c in table.columns if c in named and c not in keys]
    long = table.select(*keys, *[F.col(c).cast("double") for c in values]).unpivot(keys, values, "variable", "value")
    has = set(catalogue.columns)
    rows = long.join(catalogue.select("variable", *[c for c in ("name", "unit", "has_ci", "min", "max") if c in has]), "variable")
    inside = F.lit(True)
    for c, test in (("min", F.col("value") >= F.col("min") if "min" in has else None), ("max", F.col("value") <= F.col("max") if "max" in has else None)):
        inside = inside & F.coalesce(test, F.lit(True)) if c in has else inside
    return rows.withColumn("value", F.when(inside, F.col("value"))).drop("min", "max")
