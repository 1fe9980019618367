"""Exact metric range join of embeddings: pivots, boundary replication, independent cells.

On the unit sphere, cosine >= c is distance <= r with r^2 = 2 - 2c. Every vector's home cell is that of its nearest
pivot. If x at home with p and y at home with q are within r, the triangle inequality gives d(y,p) <= d(y,q) + 2r, and
y is as near as r to the plane halfway between p and q: (d(y,p)^2 - d(y,q)^2) / (2 d(p,q)) <= r. A vector is copied to
each other cell for which both hold, so a home row meets all its partners in its own cell and cells join alone.
Large cells are dealt out as tiles of bounded size. A tile returns counts, and a forest in place of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motiontab.llm.common import components, cut, finite

#: Rows a cell aims at, pivots at most (they are sent to every task), and rows on each side of a tile.
CELL, PIVOTS, SIDE = 2048, 16_384, 4096
_SLACK = 1e-9


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), dim)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True) if vectors.size else vectors
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def linked(home: np.ndarray, others: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row of home, rows of others with cosine >= least) by blocks of home rows."""
    for s in range(0, len(home), 512):
        hits = home[s : s + 512] @ others.T >= least
        for i in np.flatnonzero(hits.any(axis=1)):
            yield s + int(i), np.flatnonzero(hits[i])


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cell: int = CELL, pivots: int = PIVOTS, side: int = SIDE) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one for each row of ``vectors``.

    Two rows link when their labels are equal and not null, their dimensions are equal and their cosine, in doubles,
    is ``least`` or more. Rows without an id, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing. component_id: the smallest id reachable by links, itself included; kept: it is its
    own. A null id has a null component and is kept. Repeated rows link with each other; rows of one id with different
    vectors each have their own links. Extra columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    zero = F.forall("vec", lambda v: v == 0)
    joins = F.col("id").isNotNull() & F.col("label").isNotNull() & finite("vec") & ~F.coalesce(zero, F.lit(True))
    rows = rows.withColumn("joins", joins)
    # equal vectors become one row with a number of its own; partial aggregation keeps a large group of copies off the network
    reps = rows.where("joins").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    reps = cut(reps.withColumn("dim", F.size("vec")).withColumn("rep", F.monotonically_increasing_id()))
    found = _join(reps, least, cell, pivots, side)
    links = found.where("kind = 0").groupBy("rep").agg(F.sum("n").alias("n"))
    whole = components(found.where("kind = 1").select("rep", F.col("n").alias("other")), "rep", "other").withColumnRenamed("node", "rep")
    told = reps.select("label", "vec", "rep", "least", "copies").join(links, "rep", "left").join(whole, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(smallest, "component").select("label", "vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    inside = rows.where("joins").select("id", "vec", "label").join(told, ["label", "vec"]).select("id", "n_links", "component_id")
    out = inside.unionAll(rows.where(~F.col("joins")).select("id", F.lit(0).cast("long"), F.col("id")))
    kind = vectors.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _join(reps: DataFrame, least: float, cell: int, most: int, side: int) -> DataFrame:
    """(rep, kind, n): kind 0, n partners found in a tile (copies counted); kind 1, n a linked representative."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    total = reps.count()
    # pivots by hash, about one in ``cell``; the bound holds for any table
    chosen = reps.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < F.lit(int((1 << 20) / cell) + 1)).orderBy(F.xxhash64("vec", "label"), "rep").limit(min(most, -(-total // cell)))
    by_label: dict[tuple, np.ndarray] = {}
    for r in chosen.select("label", "dim", "vec").collect():
        by_label.setdefault((r.label, r.dim), []).append(r.vec)
    by_label = {k: unit(np.array(v, dtype=np.float64)) for k, v in by_label.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), np.array(batch.column("dim"))
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(labels, dims.tolist(), strict=True)):
                groups.setdefault(k, []).append(i)
            row, at, home = [], [], []
            for k, members in groups.items():
                pivot = by_label.get(k)
                index = np.array(members)
                if pivot is None or len(pivot) < 2:
                    row.append(index)
                    at.append(np.zeros(len(index), np.int64))
                    home.append(np.ones(len(index), bool))
                    continue
                x = unit(matrix(batch.column("vec").take(pa.array(members)), k[1]))
                square = np.maximum(0.0, 2 - 2 * (x @ pivot.T))
                near = square.argmin(axis=1)
                nearest = square[np.arange(len(x)), near]
                between = np.sqrt(np.maximum(0.0, 2 - 2 * (pivot @ pivot.T)))[near]
                inside = (np.sqrt(square) <= np.sqrt(nearest)[:, None] + 2 * radius + _SLACK) & (square - nearest[:, None] <= 2 * between * (radius + _SLACK) + _SLACK)
                inside[np.arange(len(x)), near] = True
                i, p = np.nonzero(inside)
                row.append(index[i])
                at.append(p)
                home.append(p == near[i])
            if row:
                row, at, home = np.concatenate(row), np.concatenate(at), np.concatenate(home)
                yield pa.record_batch([*(c.take(pa.array(row)) for c in batch.columns), pa.array(at.astype(np.int32)), pa.array(home)], [*batch.schema.names, "cell", "home"])

    rows = reps.select("label", "dim", "rep", "copies", "vec")
    cells = cut(rows.mapInArrow(placed, rows.select("*").schema.add("cell", "integer").add("home", "boolean")))
    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(F.expr("count_if(home)").alias("h"), F.count("*").alias("m"))
    sizes = sizes.select(*key, F.ceil(F.col("h") / side).cast("int").alias("hs"), F.ceil(F.col("m") / side).cast("int").alias("ms")).where("hs > 0")
    dealt = cells.join(sizes, key)
    salt = F.xxhash64("rep")
    left = dealt.where("home").withColumn("a", F.pmod(salt, "hs").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)))
    right = dealt.withColumn("b", F.pmod(salt, "ms").cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)))
    columns = [*key, "a", "b", "rep", "copies", "vec"]

    def joined(key: tuple, home: pa.Table, others: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        others = others.rename_columns([c.removeprefix("o_") for c in others.column_names])
        one, two = np.array(home.column("rep")), np.array(others.column("rep"))
        weight = np.array(others.column("copies"))
        x, y = (unit(matrix(t.column("vec").combine_chunks(), dim)) if t.num_rows else np.zeros((0, dim)) for t in (home, others))
        ids, where = np.unique(np.concatenate([one, two]), return_inverse=True)
        mine, theirs = where[: len(one)], where[len(one) :]
        root = np.arange(len(ids))
        n = np.zeros(len(one), np.int64)
        for i, hits in linked(x, y, least):
            n[i] = weight[hits].sum() - weight[hits][two[hits] == one[i]].sum()
            met = np.unique(np.append(root[theirs[hits]], root[mine[i]]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
        some = np.flatnonzero(n)
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table([pa.array(np.concatenate([one[some], ids[moved]])), pa.array(np.repeat(np.array([0, 1], np.int32), [len(some), len(moved)])), pa.array(np.concatenate([n[some], ids[root[moved]]]))], ["rep", "kind", "n"])

    tile = [*key, "a", "b"]
    right = right.select(*[F.col(c).alias(f"o_{c}") for c in columns])
    return cut(left.select(*columns).groupBy(*tile).cogroup(right.groupBy(*[f"o_{c}" for c in tile])).applyInArrow(joined, "rep long, kind int, n long"))
