"""Exact top-k search: tiled matrix products of query and candidate blocks, partial selection, tree merging.

Vectors are packed to blocks. Candidate blocks lie in shards, query blocks in groups, and a tile is one group against
one shard, both of about ``side`` rows. Each side is sent once for every ``side`` rows of the other, so ``side`` should be as large
as a task's memory allows (a row of 64 components takes 128 bytes on its way, and 512 in a product). A tile is a few matrix products; of each product only the k best per query stay.
The lists of a query from its shards are merged as a tree of bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motiontab.llm.common import cut

#: Rows of a block, mean rows of a shard or a query group, and lists that one merge reads.
BLOCK, SIDE, FAN_IN = 2048, 16_384, 16
_EXACT = 2.0**53


def rows_of(batch: pa.RecordBatch, vec: str, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) of a batch's valid vectors, by dimension."""
    column = batch.column(vec)
    sizes = np.array([-1 if x is None else x for x in column.value_lengths().to_pylist()])
    flat = column.flatten()
    values = np.array(flat.to_numpy(zero_copy_only=False), dtype=np.float64)
    if flat.null_count:
        values[np.array(flat.is_null())] = np.nan
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        matrix = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(matrix).all(axis=1) & (wanted[rows] if wanted is not None else True)
        yield rows[good], matrix[good]


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64; exact below 2^53, else rounded as doubles and kept within a long."""
    scores = queries @ candidates.T
    return np.clip(scores, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k best; ids ascend along the columns, so the first of equal scores are the smaller ids."""
    own = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for row, a, b in zip(scores, *own, strict=True):
        keep = None
        if b > a:
            keep = np.delete(np.arange(len(ids)), slice(a, b))
            row = row[keep]
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            above = np.flatnonzero(row > least)
            at = np.concatenate([above, np.flatnonzero(row == least)[: k - len(above)]])
        else:
            at = np.arange(len(row))
        yield ids[at if keep is None else keep[at]], row[at]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", side: int = SIDE) -> DataFrame:
    """For each query row its ``k`` best other rows: (query_id, rank from 1, vec_id, score).

    A component x counts as floor(scale * x) of its double value; score is the inner product, exact below 2^53 and else as
    doubles round it, within a long; ties go to the smaller id. ``is_query`` says over ``vectors`` which rows are queries (null: not); all rows are candidates. Vectors that
    are null or hold null or non-finite components, and rows without an id, take no part. A query meets the vectors
    of its own dimension, without those of its own id. Repeated candidate rows are ranked each; repeated query rows
    give one list each. Fewer candidates than k: all of them; none: no row. Extra columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id IS NOT NULL AND vec IS NOT NULL")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = np.array(batch.column("id")), np.array(batch.column("asks"), dtype=bool)
            out: list[tuple] = []
            for asked in (False, True):
                for at, matrix in rows_of(batch, "vec", asks if asked else None):
                    order = np.argsort(ids[at], kind="stable")
                    at, whole = at[order], np.floor(scale * matrix[order])
                    for s in range(0, len(at), BLOCK):
                        some = whole[s : s + BLOCK]
                        small = not some.size or np.abs(some).max() < 2**15
                        out.append((asked, some.shape[1], len(some), small, ids[at[s : s + BLOCK]].tobytes(), some.astype("<i2" if small else "<f8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["asked", "dim", "n", "small", "ids", "data"])

    packed = rows.mapInArrow(blocks, "asked boolean, dim long, n long, small boolean, ids binary, data binary")
    packed = cut(packed.withColumn("block", F.monotonically_increasing_id()))
    sizes = {r.asked: r.n for r in packed.groupBy("asked").agg(F.sum("n").alias("n")).collect()}
    shards, groups = (max(1, -(-(sizes.get(asked) or 0) // side)) for asked in (False, True))
    sides = {asked: packed.where(F.col("asked") == asked).drop("asked") for asked in (False, True)}
    at = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    payload = ["block", "n", "small", "ids", "data"]
    candidates = sides[False].select("dim", at[0].alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), *[F.col(c).alias(f"c_{c}") for c in payload])
    queries = sides[True].select("dim", at[1].alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), *payload)

    def unpacked(row: dict, dim: int, mark: str = "") -> tuple[int, np.ndarray, np.ndarray]:
        data = np.frombuffer(row[f"{mark}data"], "<i2" if row[f"{mark}small"] else "<f8")
        return row[f"{mark}block"], np.frombuffer(row[f"{mark}ids"], np.int64), data.reshape(row[f"{mark}n"], dim).astype(np.float64)

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[tuple[int, int], list] = {}
        dim, _, shard = (x.as_py() for x in key)
        asking = [unpacked(r, dim) for r in left.to_pylist()]
        for row in right.to_pylist() if asking else ():
            _, ids, data = unpacked(row, dim, "c_")
            for block, query_ids, query in asking:
                for s in range(0, len(query), 256):
                    for i, found in enumerate(select(products(query[s : s + 256], data), ids, query_ids[s : s + 256], k)):
                        best.setdefault((block, s + i), [query_ids[s + i], shard]).append(found)
        out: list[tuple] = []
        for (block, i), (query_id, shard, *found) in best.items():
            ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids, -scores))[:k]
            out.append((block, i, query_id, shard, (-scores[order]).tolist(), ids[order].tolist()))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "i", "query_id", "shard", "minus", "ids"])

    lists = queries.groupBy("dim", "grp", "shard").cogroup(candidates.groupBy("dim", "grp", "shard")).applyInArrow(tile, "block long, i long, query_id long, shard int, minus array<long>, ids array<long>")
    top = lists.select("block", "i", "query_id", "shard", F.arrays_zip("minus", "ids").alias("top"))
    while shards > 1:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        top = top.groupBy("block", "i", "query_id", (F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(merged.alias("top"))
        shards = -(-shards // FAN_IN)
    one = top.select("query_id", F.posexplode("top").alias("at", "x"))
    return one.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), (-F.col("x.minus")).alias("score"))
