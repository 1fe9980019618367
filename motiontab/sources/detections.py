"""Per-frame detections as JSON lines and flat tables, and tracker event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "frame_index int, n_blobs int, blobs array<struct<label:int, area:int, cx:double, cy:double, bbox:array<int>>>"


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One row per blob: frame_index, label, area, cx, cy, x, y, width, height."""
    return exploded(spark.read.schema(SCHEMA).json(path))


def exploded(frames: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    blobs = frames.select(*keys, "frame_index", F.explode("blobs").alias("b"))
    return blobs.select(*keys, "frame_index", "b.label", "b.area", "b.cx", "b.cy", *[F.col("b.bbox")[k].alias(n) for k, n in enumerate(("x", "y", "width", "height"))])


def nested(blobs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Blob rows to one row per frame (and keys, such as the video), blobs in the order of labels."""
    b = F.struct("label", "area", "cx", "cy", F.array("x", "y", "width", "height").alias("bbox"))
    return blobs.groupBy(*keys, "frame_index").agg(F.count("*").cast("int").alias("n_blobs"), F.array_sort(F.collect_list(b)).alias("blobs"))


def write_detections(blobs: DataFrame, path: str) -> None:
    nested(blobs).write.json(path)


def run_counts(blobs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Frames with blobs, blobs and mean area, one row (for each of keys)."""
    return blobs.groupBy(*keys).agg(F.countDistinct("frame_index").alias("frames"), F.count("*").alias("blobs"), F.avg("area").alias("mean_area"))


def write_run(blobs: DataFrame, folder: str, **metadata) -> None:
    """A run's folder: detections (CSV with header), log (its counts as JSON) and metadata (one JSON row)."""
    flat = blobs.select("frame_index", "label", "area", "cx", "cy", "x", "y", "width", "height")
    flat.write.option("header", True).csv(f"{folder}/detections")
    run_counts(flat).write.json(f"{folder}/log")
    named = [F.lit(v).alias(k) for k, v in metadata.items()] or [F.lit(None).cast("string").alias("none")]
    blobs.sparkSession.range(1).select(*named).write.json(f"{folder}/metadata")


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Typed events (kind, frame, ids, to_ids, sizes) of log lines; lines of other kinds go.

    CNTTRACK lines give NEW, LOST, N->1 and 1->N with the ids named before and after ->; RES: OK Sizes give sizes;
    MODEL: ID: a>b gives a remap. Columns path and place, a line's file and number, are kept where ``lines`` has them.
    """
    text = F.col(line)
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("long"))
    listed = lambda c: F.when(c.contains("["), F.regexp_extract(c, r"\[([^\]]*)\]", 1)).otherwise(c)
    kind = F.when(text.startswith("RES: OK Sizes"), "SIZES").when(text.startswith("MODEL: ID:"), "MODEL").when(text.startswith("CNTTRACK:"), F.trim(F.regexp_extract(text, r"^CNTTRACK:\s*\d+,\s*(NEW|LOST|N->1|1->N)", 1)))
    order = [c for c in ("path", "place") if c in lines.columns]
    rows = lines.select(text.alias("line"), kind.alias("kind"), *order).where("kind <> ''")
    rest = F.regexp_replace("line", r"^(CNTTRACK:\s*\d+,\s*(NEW|LOST|N->1|1->N)\s*,?|RES: OK Sizes:|MODEL: ID:)", "")
    sides = F.split(rest, "->|>")
    return rows.select(
        "kind",
        F.when(F.col("line").startswith("CNTTRACK:"), F.regexp_extract("line", r"^CNTTRACK:\s*(\d+)", 1).cast("int")).alias("frame"),
        F.when(F.col("kind") != "SIZES", numbers(F.get(sides, 0))).alias("ids"),
        F.when(F.col("kind") != "SIZES", numbers(listed(F.coalesce(F.get(sides, 1), F.lit(""))))).alias("to_ids"),
        F.when(F.col("kind") == "SIZES", numbers(rest)).alias("sizes"),
        *order,
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of log files with path and place, the number of the line; a run's log is read as a whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_log(files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("place", "value")))
