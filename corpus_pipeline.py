"""A corpus pipeline of five stages; each reads what its predecessor kept and returns the columns of documents.

Documents may have nulls in any column, empty and very long texts, equal rows and rows of one id; other columns are left
out. What becomes of such rows stands at each stage; an empty table stays empty through all of them.

1. Quality classifier: documents that it rejects go.
2. Line dedup: near-duplicate lines go, and documents that lose their last line with words.
3. N-gram Jaccard join: of each group of linked documents the one with the smallest id stays.
4. Source mixing: each document is kept in as many copies as its rate says; rates lie between one and MOST_COPIES and come as near to the
   targets as they can.
5. Packing: the pieces of the corpus in training windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiontab.llm import linededup, mixing, ngramjoin, packing, quality
from motiontab.llm.common import folder, read
from motiontab.llm.queries import TARGETS, language_labels, tokenizer_path

#: Copies of a document that the mixing stage makes at most.
MOST_COPIES = 8
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score of good quality is high enough; null texts count as empty, and equal rows have one fate. Without labels of
    both kinds all rows score the labels' share, or 1/2, and stay if that is high enough."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return model.apply(docs.select(*COLUMNS)).where("accepted").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line matches. A document goes when its last line with words does, so of equal rows one
    stays; null texts, and texts that had no words, stay as they are. n_chars is counted anew where lines went."""
    out = linededup.dedup_lines(docs.select(*COLUMNS), percent=80)
    out = out.where("n_removed = 0 OR n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the rows with the smallest id. Null, empty and blank texts link with nothing and stay, as do
    rows without an id; rows of one id stay or go together."""
    docs = docs.select(*COLUMNS)
    groups = ngramjoin.jaccard_components(docs, n=5, percent=80).select("doc_id", "component_id")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once or more often, MOST_COPIES times at most, its copies equal; null and empty texts have the prior's rate. Rows of one id
    and text have equally many copies. Where the bound keeps a language from its weight the fit warns."""
    docs = docs.select(*COLUMNS)
    mixture = mixing.fit(docs, language_labels(docs, read(spark, sf_dir, "labels")), TARGETS, least=1.0, most=float(MOST_COPIES))
    rows = mixture.apply(docs).withColumn("copies", mixing.copies(F.col("rate"), "doc_id"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in training windows; null and empty texts are an end mark alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), length=4096, end_id=2)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the rates and the tokenizer are not to be said in SQL; tests/llm/test_corpus_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written to the cluster's shared folder and read again; what a stage has
    read is removed once its own result is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _remove(spark, before)
            before = path
    return docs
