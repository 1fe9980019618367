"""Exact n-gram Jaccard join of documents.

A document is the set of its hashed word n-grams. Sets are ordered by one global order, rarest first, and two sets
with Jaccard >= t share an n-gram among the first n - ceil(t n) + 1 of each. All rows that hold an n-gram in this prefix
form a tile, sorted by set size, and a row meets only its size band (partners of 1 to 1/t times its size). A pair
must pass the band, the positions of the shared n-gram, and the hashed bitmap signatures: the bits in which
two signatures differ bound the symmetric difference from below, so the overlap from above. What passes is verified
by intersecting the sorted hash arrays.

Only connectivity is wanted, so tiles of many rows first give each row one partner (a leader that passes); what the
verified links join needs no more tests, and the last round tests every pair that is still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motiontab.llm.common import components, cut, words

#: Odd 64-bit multipliers that mix word hashes; fixed so that hashes agree between runs.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Frequent n-grams are moved to the end of the order: those seen LOCAL times among ROWS documents and OFTEN times in all, the
#: MOST most frequent of them. Any list gives the same links; it only keeps tiles small.
LOCAL, OFTEN, MOST = 3, 64, 100_000
#: Tiles up to SMALL rows test all pairs at once; tiles over BLOCK rows are dealt out as pairs of blocks.
SMALL, BLOCK = 8, 2048
#: Two block numbers make one number of a pair.
PAIR = 1 << 31
WORDS_KEPT = 300_000
#: Rows whose sets a task holds at once.
ROWS = 2048
BROADCAST_ROWS = 1_000_000


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.slice(start, ROWS)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(texts: list[str | None], n: int, hashes: WordHashes) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams; with fewer words, of the whole sequence."""
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    out: list[np.ndarray] = []
    for s in range(0, len(texts), 256):
        found = [words(t) for t in texts[s : s + 256]]
        sizes = np.array([len(w) for w in found])
        ends = np.cumsum(sizes)
        # each word's hash by its place in the n-gram; n - 1 zeros at the end complete the last windows
        w = np.fromiter((h for x in found for h in map(hashes.__getitem__, x)), np.uint64, int(ends[-1]))
        w = np.concatenate([w, np.zeros(n - 1, np.uint64)])
        total = w[: len(w) - n + 1] * np.uint64(MIX[0])
        for k in range(1, n):
            total += w[k : len(w) - n + 1 + k] * np.uint64(MIX[0] * (2 * k + 1) ** 5 & (1 << 64) - 1)
        total = (total ^ (total >> np.uint64(32))) * np.uint64(MIX[1])
        total ^= total >> np.uint64(29)
        for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
            if 0 < size < n:
                out.append(np.array([xxhash.xxh64_intdigest(w[end - size : end].tobytes(), size)], np.uint64))
                continue
            own = np.sort(total[end - size : max(end - size, end - n + 1)])
            out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def signature(hashes: np.ndarray) -> bytes:
    """Bitmap of 1 to 2 bits for each member, a power of two of at least 64 bits."""
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


class Signatures:
    """Signatures of the rows of a table, by size; larger ones are folded to meet smaller ones."""

    def __init__(self, column: pa.Array):
        sizes = np.array(pc.binary_length(column), dtype=np.int64)
        self.size, self.at, self.data = sizes, np.zeros(len(sizes), np.int64), {}
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            self.at[rows] = np.arange(len(rows))
            self.data[size] = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of rows i and j."""
        out = np.zeros(len(i), np.int64)
        for a in np.unique(self.size[i]).tolist() if len(i) else ():
            for b in np.unique(self.size[j[self.size[i] == a]]).tolist():
                at = np.flatnonzero((self.size[i] == a) & (self.size[j] == b))
                x, y = self.data[a][self.at[i[at]]], self.data[b][self.at[j[at]]]
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
                out[at] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


class Threshold:
    """Jaccard >= up / down as whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def overlap(self, total: np.ndarray) -> np.ndarray:
        """Least intersection of two sets of ``total`` members."""
        return -(-self.percent * total // (100 + self.percent))

    def holds(self, common: int, total: int) -> bool:
        return 100 * common >= self.percent * (total - common)


def partners(tile: dict[str, np.ndarray], bits: Signatures, need: Threshold, lo: int, hi: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows lo..hi (one tile, sorted by size) that pass all bounds: every one, or one leader for each row."""
    n, at, comp, block = tile["n"], tile["at"], tile["comp"], tile["block"]
    order = range(lo, hi) if every else (np.argsort(tile["turn"][lo:hi], kind="stable") + lo).tolist()
    free = np.ones(hi - lo, bool)
    split = bool(tile["cross"][lo])  # a tile of two blocks: each has its inner pairs elsewhere
    for x in order:
        if not every and not free[x - lo]:
            continue
        a = x + 1 if every else lo + int(np.searchsorted(n[lo:hi], -(-need.percent * n[x] // 100), "left"))
        b = lo + int(np.searchsorted(n[lo:hi], 100 * n[x] // need.percent, "right"))
        j = np.arange(a, b)
        fine = comp[j] != comp[x]
        if split:
            fine &= block[j] != block[x]
        if not every:
            fine &= free[j - lo]
        j = j[fine]
        j = j[1 + np.minimum(n[x] - 1 - at[x], n[j] - 1 - at[j]) >= need.overlap(n[x] + n[j])]
        i = np.full(len(j), x)
        fine = bits.differ(i, j) <= n[i] + n[j] - 2 * need.overlap(n[i] + n[j])
        if fine.any():
            yield i[fine], j[fine]
        if not every:
            free[x - lo] = False
            free[j[fine] - lo] = False


def small_pairs(tile: dict[str, np.ndarray], need: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """All passing pairs of tiles of at most SMALL rows, over a whole batch at once."""
    n, at, comp, key = tile["n"], tile["at"], tile["comp"], tile["key"]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, SMALL):
        i = np.flatnonzero(key[:-k] == key[k:]) if len(key) > k else np.zeros(0, np.int64)
        j = i + k
        fine = (comp[i] != comp[j]) & (100 * n[i] >= need.percent * n[j]) & (1 + np.minimum(n[i] - 1 - at[i], n[j] - 1 - at[j]) >= need.overlap(n[i] + n[j]))
        found.append((i[fine], j[fine]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def tiles_to_pairs(rows: DataFrame, need: Threshold, every: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of tile rows (key, pair, block, rep, n, at, comp, turn, rows), and bits in wide tiles.

    Small tiles test all pairs by size and position; wide ones also by signature, every pair or a leader for each row.
    """
    wide = "bits" in rows.columns

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def told(table: pa.Table) -> pa.RecordBatch:
            tile = {c: np.array(table.column(c)) for c in ("n", "at", "comp", "turn", "block", "rep")}
            tile["key"] = np.array(table.column("key"))
            pair = np.array(table.column("pair"))
            tile["cross"] = pair // PAIR != pair % PAIR
            starts = np.flatnonzero(np.append(True, (tile["key"][1:] != tile["key"][:-1]) | (pair[1:] != pair[:-1])))
            sizes = np.diff(np.append(starts, table.num_rows))
            tile["key"] = np.repeat(np.arange(len(starts)), sizes)
            found: list = []
            if wide:
                bits = Signatures(table.column("bits").combine_chunks())
                for lo, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                    found += partners(tile, bits, need, lo, lo + size, every)
            else:
                found.append(small_pairs(tile, need))
            i, j = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
            a, b = tile["rep"][i], tile["rep"][j]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            key, pair = np.array(table.column("key")), np.array(table.column("pair"))
            last = np.flatnonzero((key != key[-1]) | (pair != pair[-1])) if len(key) else np.zeros(0, np.int64)
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield told(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield told(rest)

    dealt = rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "n", "rep")
    return dealt.mapInArrow(paired, "a long, b long").distinct()


def _small(keys: DataFrame) -> DataFrame:
    """Ids to be sent to every task if they are few (16 MB at most), else to be shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_shingles, component_id), one for each row of ``docs``.

    Words are split at space and \\x09-\\x0D with A-Z lower-cased. A document's set: its distinct word ``n``-grams, with
    fewer words the whole sequence as one; null, empty and blank texts have an empty set and link with nothing. Two
    documents link when 100 * intersection >= percent * union. component_id: the smallest id reachable by links,
    itself included. A row without an id links with nothing and has a null component. Ids are meant to be unique: equal
    rows share their result, and of rows with one id and different texts each may get the other's links. Members are told apart by 64-bit hashes, equal sets by 128-bit ones. Extra columns are not read.
    """
    need = Threshold(percent)
    ids_type = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in portions(batches):
            found = shingle_sets(batch.column("text").to_pylist(), n, hashes)
            sizes, keys = [len(x) for x in found], list(map(set_key, found))
            sets = dict(zip(keys, found, strict=True))
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], ["id", "n", "key"])
            values, counts = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often = counts >= LOCAL
            yield pa.record_batch([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64)), pa.nulls(int(often.sum()), pa.binary())], ["id", "n", "key"])

    told = cut(source.mapInArrow(sized, "id long, n long, key binary"))  # rows without key: n-grams and their counts
    frequent = told.where("key IS NULL").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "id").limit(MOST).collect()
    last = np.array([r.id for r in frequent][::-1], np.int64).view(np.uint64)  # in their order, rarest first
    by_value = np.argsort(last)
    sorted_last = last[by_value]

    def ordered_prefix(found: np.ndarray) -> np.ndarray:
        p = need.prefix(len(found))
        if len(last):
            at = np.minimum(np.searchsorted(sorted_last, found), len(last) - 1)
            often = sorted_last[at] == found
            found = np.concatenate([found[~often], last[np.sort(by_value[at[often]])]])
        return found[:p]

    members = told.where("key IS NOT NULL")
    sets = cut(members.where("n > 0 AND id IS NOT NULL").groupBy("n", "key").agg(F.min("id").alias("rep")))
    copies = members.where("n > 0 AND id IS NOT NULL").select("id").distinct().join(sets.select(F.col("rep").alias("id")), "id", "left_anti")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in portions(batches):
            found = shingle_sets(batch.column("text").to_pylist(), n, hashes)
            rows = [k for k, x in enumerate(found) if len(x)]
            prefix = [ordered_prefix(found[k]).view(np.int64) for k in rows]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            prefixes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            bits = pa.array([signature(found[k]) for k in rows], pa.binary())
            yield pa.record_batch([batch.column("id").take(pa.array(rows, pa.int64())), pa.array([len(found[k]) for k in rows], pa.int64()), prefixes, bits], ["rep", "n", "prefix", "bits"])

    single = source.where("id IS NOT NULL").join(_small(cut(copies)), "id", "left_anti")
    signs = cut(single.mapInArrow(signed, "rep long, n long, prefix array<long>, bits binary"))
    bits = signs.select("rep", "n", "bits").distinct()
    held = signs.select("rep", "n", F.posexplode("prefix").alias("at", "key"))
    held = held.withColumn("rows", F.count("*").over(Window.partitionBy("key"))).where("rows > 1")
    held = cut(held.select("key", "rep", "n", F.col("at").cast("long").alias("at"), "rows"))
    small = held.where(F.col("rows") <= SMALL).withColumns({"pair": F.lit(0).cast("long"), "block": F.lit(0).cast("long")})
    # a tile over BLOCK rows becomes tiles of two blocks each; every pair meets in one of them, pairs of one block in its own
    last_block = F.ceil(F.col("rows") / BLOCK).cast("long") - 1
    wide = held.where(F.col("rows") > SMALL).join(bits, ["rep", "n"]).withColumn("block", F.pmod(F.xxhash64("rep"), last_block + 1))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), last_block), lambda t: F.least("block", t) * PAIR + F.greatest("block", t))
    wide = cut(wide.withColumn("pair", F.explode(pairs)))

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures leave room for the overlap needed."""

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches):
                rows = len(batch)
                both = Signatures(pa.concat_arrays([batch.column("x"), batch.column("y")]))
                total = np.array(batch.column("n")) + np.array(batch.column("m"))
                fine = both.differ(np.arange(rows), np.arange(rows, 2 * rows)) <= total - 2 * need.overlap(total)
                yield batch.select(["a", "b"]).filter(pa.array(fine))

        x, y = bits.select(F.col("rep").alias("a"), "n", F.col("bits").alias("x")), bits.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(passed, "a long, b long").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by exact intersection of whole sets."""
        asked = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()

        def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in portions(batches):
                data = [x.tobytes() for x in shingle_sets(batch.column("text").to_pylist(), n, hashes)]
                yield pa.record_batch([batch.column("id"), pa.array(data, pa.binary())], ["id", "data"])

        whole = source.join(_small(cut(asked)), "id").mapInArrow(gathered, "id long, data binary").dropDuplicates(["id", "data"])

        def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches):
                keep = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    at = np.minimum(np.searchsorted(large, small), max(0, len(large) - 1))
                    common = int((large[at] == small).sum()) if len(large) else 0
                    keep.append(bool(common) and need.holds(common, len(x) + len(y)))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = pairs.join(whole.select(F.col("id").alias("a"), F.col("data").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("data").alias("y")), "b")
        return joined.select("a", "b", "x", "y").mapInArrow(tested, "a long, b long").distinct()

    alone = {"comp": F.col("rep"), "turn": F.col("rep")}
    near = bounded(tiles_to_pairs(small.withColumns(alone), need, True)).unionAll(tiles_to_pairs(wide.withColumns(alone), need, False))
    links = cut(verified(cut(near.distinct())))
    for every in (False, True):
        whole = components(links, "a", "b").withColumnRenamed("node", "rep")
        apart = wide.join(whole, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        several = apart.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        apart = apart.join(several, "key").withColumn("turn", F.xxhash64("comp", "rep"))
        more = tiles_to_pairs(apart, need, every).join(links, ["a", "b"], "left_anti")
        links = cut(links.unionAll(verified(cut(more))))
    whole = components(links, "a", "b")
    named = sets.select("n", "key", "rep").join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("n", "key", F.coalesce("component", "rep").alias("component_id"))
    out = members.where("n > 0 AND id IS NOT NULL").join(named, ["n", "key"]).select("id", "n", "component_id")
    out = out.unionAll(members.where("n = 0 OR id IS NULL").select("id", "n", "id"))
    return out.select(F.col("id").cast(ids_type).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(ids_type).alias("component_id"))
