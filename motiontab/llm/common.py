"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII capitals and their small letters; other letters keep their case.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text, split at space and \\x09-\\x0D, with A-Z lower-cased."""
    return text.encode().translate(LOWER).split() if text else []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is the one in ``spark.checkpoint.dir``; only where a local session has none (as in tests) a temporary
    one is set.
    """
    folder(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed Parquet table in the shared folder: for wide or long intermediate results."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Of queries that run in here Spark removes the shuffle files as they end, in place of some time after the driver's next garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def removed(tables: list[DataFrame]) -> None:
    """Remove the files of results of ``table`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share; an error on a cluster that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def finite(column: str) -> F.Column:
    """True when a vector is not null and has no null, NaN or infinite component."""
    x = F.col(column)
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge table: (node, component), component = the smallest node reachable.

    Alternating large-star and small-star steps; each halves the distance to the smallest node, so the number
    of rounds is about the square of the logarithm of the number of nodes. Every round is cut to the checkpoint folder, edges never reach
    the driver. Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    before = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of u go to the smallest one; partial minima keep hot nodes cheap
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first())
        if now == before:
            break
        before = now
    pairs = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return pairs.unionAll(pairs.select(F.col("component").alias("node"), "component").distinct())
