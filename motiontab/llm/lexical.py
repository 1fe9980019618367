"""Ranked lexical search of many queries at once, with common term sets evaluated once.

One pass over the documents keeps, for each, its length and the frequencies of terms that some item asks for. The items
of a block are then compiled to a graph: terms that the same items hold equally often form a class; an item's shared classes,
the most held first, are a path in a tree whose nodes are the term sets that several items begin with. A document's
accumulator of a class and of a node is made once, a node's from its parent's and one class; an item adds to the node at the end of
its path what it alone holds. Each task keeps the best documents of each item, and these lists are merged in two levels.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from motiontab.llm.common import LOWER, table

#: Terms (with repeats) that a block of items aims at; further items are searched in further blocks.
BLOCK_TERMS = 200_000
#: Numbers in one array of accumulators.
CELLS = 2_000_000
#: Rows of candidates that a task gathers before it keeps the best of each item.
WAITING = 100_000
#: First level of the merge: lists of so many parts of the tasks meet for each item.
PARTS = 64

#: Bytes that stand in no term, as spaces; A-Z as a-z.
_SPLIT = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters a-z, digits and characters beyond ASCII; A-Z are read as a-z."""
    return text.encode().translate(_SPLIT).split() if text else []


class Plan:
    """The items of a block as a graph over numbered terms.

    Classes are joined arrays of terms, each starting at its ``class_at``; the class after the last is empty. The tree is given level by
    level as (node, parent, class, times), node 0 is empty. An item has a node to start from and classes to add.
    """

    def __init__(self, items: Sequence[Mapping[int, int]]):
        holders: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # term -> (item, times)
        for k, item in enumerate(items):
            for term, times in item.items():
                holders[term].append((k, times))
        shared: defaultdict[tuple, list[int]] = defaultdict(list)  # (item, times).. -> terms
        alone: defaultdict[int, list[int]] = defaultdict(list)  # item -> terms that only it holds
        for term, held in holders.items():
            if len(held) > 1:
                shared[tuple(held)].append(term)
            else:
                alone[held[0][0]].append(term)
        order = sorted(shared, key=lambda held: (-len(held), held))
        flat, times, self.class_at = [], [], []
        for of in [*map(shared.get, order), *alone.values()]:
            self.class_at.append(len(flat))
            flat += of
        for held in order:
            times += [1] * len(shared[held])
        times += [holders[term][0][1] for of in alone.values() for term in of]
        self.class_terms, self.class_times = np.array(flat, np.int64), np.array(times, np.int64)
        paths: list[list[tuple[int, int]]] = [[] for _ in items]  # shared classes and how often the item counts them
        for c, held in enumerate(order):
            for k, n in held:
                paths[k].append((c, n))
        visits: Counter[int] = Counter()
        number: dict[tuple[int, tuple[int, int] | None], int] = {(0, None): 0}
        walked = []
        for path in paths:
            at, nodes = 0, []
            for step in path:
                at = number.setdefault((at, step), len(number))
                nodes.append(at)
            visits.update(nodes)
            walked.append(nodes)
        come_from = {v: k for k, v in number.items()}
        kept, depth = {0: 0}, {0: 0}
        levels: defaultdict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for node in sorted(visits):  # parents have smaller numbers
            if visits[node] > 1:
                parent, (c, n) = come_from[node]
                depth[node], kept[node] = depth[parent] + 1, len(kept)
                levels[depth[node]].append((kept[node], kept[parent], c, n))
        self.levels = [tuple(map(np.array, zip(*levels[d], strict=True))) for d in sorted(levels)]
        self.nodes, self.item_node = len(kept), np.zeros(len(items), np.int64)
        empty, own_class = len(self.class_at), {k: len(order) + c for c, k in enumerate(alone)}
        rest, factor, self.rest_at = [], [], []
        for k, (path, nodes) in enumerate(zip(paths, walked, strict=True)):
            on = sum(n in kept for n in nodes)  # these are the first of the path
            self.item_node[k] = kept[nodes[on - 1]] if on else 0
            self.rest_at.append(len(rest))
            rest += [own_class.get(k, empty), *(c for c, _ in path[on:])]
            factor += [1, *(n for _, n in path[on:])]
        self.rest, self.factor = np.array(rest, np.int64), np.array(factor, np.int64)
        #: additions for one document with sharing and without
        self.work = (len(flat) + self.nodes + len(rest), sum(map(len, items)))

    def scores(self, values: np.ndarray) -> np.ndarray:
        """(items, documents) from (terms, documents)."""
        n = values.shape[1]
        classes = np.zeros((len(self.class_at) + 1, n), np.int64)
        if len(self.class_at):
            classes[:-1] = np.add.reduceat(values[self.class_terms] * self.class_times[:, None], self.class_at, axis=0)
        nodes = np.zeros((self.nodes, n), np.int64)
        for node, parent, c, times in self.levels:
            nodes[node] = nodes[parent] + classes[c] * times[:, None]
        return nodes[self.item_node] + np.add.reduceat(classes[self.rest] * self.factor[:, None], self.rest_at, axis=0)


class Best:
    """The ``k`` best documents of each item, equal scores by ascending id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.rows.append((item, scores[item, doc], ids[doc]))
        self.waiting += len(item)
        if self.waiting > WAITING:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, doc = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.empty(0, np.int64),) * 3
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        fine = rank < self.k
        full = rank == self.k - 1
        self.least[item[full]] = score[full]
        self.rows, self.waiting = [(item[fine], score[fine], doc[fine])], 0
        return self.rows[0]


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_col, rank, id_col, score): the ``k`` documents of highest score above 0 for each row of ``items``.

    With N documents that have a term, L their terms and n one document's, a term in df documents weighs w = floor(1000 ln((2N + 2) / (2df + 1)))
    and, tf times in a document, counts w * (10^9 tf // (1000 tf + 12 m)) there, m = 75 + 25 n N // L; an item counts its terms as often as
    it has them. Ranks go from 1 by score and ascending id. Null and empty texts have no terms. Each row of ``docs`` is a
    document: rows without an id count in the statistics and are not returned, a repeated id may be returned twice. Each row of
    ``items`` is searched alone, also where ids are null or repeat. Ids of documents are integers; other columns are not read, and empty tables give no rows.

    Items are searched in blocks of about ``block_terms`` terms (one item at least), each with one pass over the documents.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 6 / block_terms))
    found = [_search_block(docs, items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b), k, id_col, text_col) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "score")


def _search_block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    kind = items.schema["item"].dataType
    rows = [(r.item, Counter(words)) for r in items.collect() if (words := terms(r.text))]  # one block
    number: dict[bytes, int] = {}
    asked = [{number.setdefault(t, len(number)): n for t, n in words.items()} for _, words in rows]
    names = pa.array([r[0] for r in rows], to_arrow_type(kind))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            sizes, hits, at = [], [], [0]
            for text in batch.column("text"):
                words = terms(text.as_py())
                sizes.append(len(words))
                hits += [t for t in map(get, words) if t is not None]
                at.append(len(hits))
            doc = np.repeat(np.arange(len(sizes)), np.diff(at))
            key, tf = np.unique(doc * max(1, len(number)) + np.array(hits, np.int64), return_counts=True)
            doc, term = np.divmod(key, max(1, len(number)))
            stops = np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(stops), pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), *lists], ["id", "n", "term", "tf"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    postings = table(docs.mapInArrow(read, "id long, n long, term array<int>, tf array<int>").where("n > 0"))
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most the block's terms
    df = dict(postings.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*")).collect())
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(number))], np.int64)
    plan = Plan(asked)
    height = max(len(number), len(plan.rest), plan.nodes, len(plan.class_terms), 1)
    width = max(1, CELLS // height)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(rows), k)
        for batch in batches:
            ids, n = (batch.column(c).to_numpy() for c in ("id", "n"))
            term, tf = (batch.column(c).flatten().to_numpy() for c in ("term", "tf"))
            ends = np.cumsum(batch.column("term").value_lengths().to_numpy())
            for s in range(0, len(ids), width):
                e = min(len(ids), s + width)
                a, b = (ends[s - 1] if s else 0), ends[e - 1]
                doc = np.searchsorted(ends[s:e], np.arange(a, b), "right")
                m = 75 + 25 * n[s:e] * n_docs // n_terms
                times = tf[a:b].astype(np.int64)
                values = np.zeros((len(number), e - s), np.int64)
                values[term[a:b], doc] = weight[term[a:b]] * (1_000_000_000 * times // (1000 * times + 12 * m[doc]))
                best.add(plan.scores(values), ids[s:e])
        item, score, doc = best.cut()
        yield pa.record_batch([pa.array(item), pa.array(score), pa.array(doc)], ["number", "score", "id"])

    if not rows:
        return docs.sparkSession.createDataFrame([], docs.select("id").schema).select(F.lit(None).cast(kind).alias("item"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    lists = postings.where("id IS NOT NULL AND size(term) > 0").mapInArrow(ranked, "number long, score long, id long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    order = [F.desc("score"), F.col("id")]
    some = lists.withColumn("r", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))).where(F.col("r") <= k)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([names.take(batch.column("number")), *(batch.column(c) for c in ("rank", "id", "score"))], ["item", "rank", "id", "score"])

    return top.select("number", "rank", "id", "score").mapInArrow(named, f"item {kind.simpleString()}, rank int, id long, score long")
