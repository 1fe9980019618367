"""Best-fit packing of tokenized documents under several capacities.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths). A piece's three demands
follow from its length, so pieces of one length are alike, and so are open sequences with the same residual capacities.
Packing then needs only how many pieces there are of each length, which is at most ``length`` numbers whatever the corpus:
lengths are taken from the longest down, and each goes to the open sequences that fit it best, as many at once as are
alike. Best is the least weighted norm of what would be left, or the largest weighted dot product of demand and residual
capacity; every capacity must hold. The plan says, for the k-th piece of a length, its sequence and place; pieces look
themselves up in their tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motiontab.llm.bytebpe import vocabulary
from motiontab.llm.common import table


class Placed(NamedTuple):
    """Pieces first .. first + n * copies - 1 of a length: the k-th goes to sequence ``sequence`` + k % n, place ``offset`` + (k // n) * length."""

    length: int
    first: int
    n: int
    copies: int
    sequence: int
    offset: int


def demands(length: np.ndarray | int) -> np.ndarray:
    """Tokens, documents and attention cost of a piece."""
    x = np.asarray(length, np.float64)
    return np.stack([x, np.ones_like(x), x * x], -1)


def best_fit(counts: Mapping[int, int], capacity: Sequence[float], score: str = "norm", weights: Sequence[float] | None = None) -> tuple[list[Placed], int]:
    """(placements, number of sequences) for ``counts`` pieces of each length.

    Weights are by default each capacity's share of the total demand. Ties go to the sequences that were opened first.
    """
    cap = np.asarray(capacity, np.float64)
    lengths = sorted((n for n in counts if counts[n] > 0), reverse=True)
    if lengths and (demands(lengths[0]) > cap).any():
        raise ValueError(f"a piece of {lengths[0]} tokens fits no sequence")
    if weights is None:
        total = sum((counts[n] * demands(n) / cap for n in lengths), np.zeros(3))
        weights = total / max(total.sum(), 1e-300)
    weights = np.asarray(weights, np.float64)
    # open sequences that are alike: residual capacities, first number, how many, tokens so far
    residual, first, alike, used = np.empty((0, 3)), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    placed, opened = [], 0
    for length in lengths:
        need, left, done = demands(length), counts[length], 0
        while left:
            fits = np.flatnonzero((residual >= need).all(1))
            if len(fits):
                open_ = residual[fits]
                value = -(weights * ((open_ - need) / cap) ** 2).sum(1) if score == "norm" else (weights * (need / cap) * (open_ / cap)).sum(1)
                g = int(fits[np.argmax(value)])
            else:
                g, n = len(first), -(-left // int(np.floor(cap / need).min()))
                residual, first, alike, used = np.vstack([residual, cap]), np.append(first, opened), np.append(alike, n), np.append(used, 0)
                opened += n
            copies = min(int(np.floor(residual[g] / need).min()), left)
            n = min(int(alike[g]), left // copies)
            placed.append(Placed(length, done, n, copies, int(first[g]), int(used[g])))
            if n < alike[g]:  # the others stay as they are
                residual, first = np.vstack([residual, residual[g]]), np.append(first, first[g] + n)
                alike, used = np.append(alike, alike[g] - n), np.append(used, used[g])
            residual[g], alike[g], used[g] = residual[g] - copies * need, n, used[g] + copies * length
            done, left = done + n * copies, left - n * copies
        live = residual[:, 0] >= 1
        residual, first, alike, used = residual[live], first[live], alike[live], used[live]
    return placed, opened


def pieces_of(total: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, size) of a document's pieces: whole ones of ``length``, a shorter one in front."""
    start = 0
    while start < total:
        size = (total - start) % length or length
        yield start, size
        start += size


def pack(docs: DataFrame, tokenizer_file: str, length: int = 1024, end_id: int = 2, most_docs: int | None = None, most_cost: int | None = None, score: str | None = None, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id_col, piece, start, length, ids_crc32, sequence_id, offset) of all of ``docs``.

    A document's ids are those of its text by the tokenizer, then ``end_id``; a null or empty text has that id alone. Only
    documents over ``length`` are cut, into pieces of ``length`` ids after a first one that may be shorter. A sequence holds
    at most ``length`` ids, ``most_docs`` pieces (by default as many as ids) and an attention cost of ``most_cost`` (by default length
    squared, which the other two imply). ``score`` is norm or dot; by default the one that needs fewer sequences. Null and
    repeated ids are documents like any other, other columns are not read, an empty table gives no piece.

    The plan has at most 2 * length entries for each length; tasks get it as it is. A piece's number among those of its length is its
    number within its task plus the counts of the tasks before.
    """
    if score not in (None, "norm", "dot"):
        raise ValueError("score is norm or dot")
    ids_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    columns = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "number": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = vocabulary(tokenizer_file), TaskContext.get().partitionId()
        seen = [0] * (length + 1)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column("text")):
                ids = np.append(known.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                for piece, (start, size) in enumerate(pieces_of(len(ids), length)):
                    at.append(k)
                    rows.append((piece, start, size, zlib.crc32(ids[start : start + size]), part, seen[size]))
                    seen[size] += 1
            values = zip(*rows, strict=True) if rows else [()] * len(columns)
            yield pa.record_batch([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, t in zip(values, columns.values(), strict=True))], ["id", *columns])

    pieces = table(docs.mapInArrow(cut, docs.select("id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("part", "integer").add("number", "long")))
    counted = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    starts = table(counted.withColumn("before", before))
    counts = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    capacity = (length, most_docs or length, most_cost or length * length)
    plans = [best_fit(counts, capacity, s, weights) for s in ([score] if score else ["norm", "dot"])]
    placed = min(plans, key=lambda p: p[1])[0]
    order = sorted(placed)
    lists = [np.array(x, np.int64) for x in zip(*order, strict=True)] if order else [np.empty(0, np.int64)] * 6
    most = max([1, *counts.values()])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, firsts, n, _, sequence, offset = lists
        keys = sizes * most + firsts
        for batch in batches:
            size, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, size * most + number, "right") - 1
            k = number - firsts[at]
            where = (pa.array(sequence[at] + k % n[at]), pa.array(offset[at] + k // n[at] * size))
            yield pa.record_batch([*(batch.column(c) for c in batch.schema.names if c != "number"), *where], [*(c for c in batch.schema.names if c != "number"), "sequence_id", "offset"])

    kept = ["id", "piece", "start", "length", "ids_crc32"]
    numbered = pieces.join(starts.drop("n"), ["length", "part"]).select(*kept, (F.col("before") + F.col("number")).alias("number"))
    out = numbered.mapInArrow(put, numbered.select(*kept).schema.add("sequence_id", "long").add("offset", "long"))
    return out.select(F.col("id").cast(ids_type).alias(id_col), *kept[1:], "sequence_id", "offset")
