"""Text scores by context-tree weighting over bytes, beside a smoothed word model.

A byte is eight binary decisions, each a node (the bits so far) below a context of the last 0 to ``depth`` bytes. With
counts a and b of a node's zeros and ones, the Krichevsky-Trofimov estimate of its sequence is
P_e(a, b) = G(a + 1/2) G(b + 1/2) / (pi G(a + b + 1)), and the weighted one mixes stopping here with going deeper:
P_w = P_e at the full depth, else (P_e + product of P_w over the contexts one byte longer) / 2. After training, a node
predicts a one with (b + 1/2) / (a + b + 1), and P_e / (2 P_w) is the weight of stopping at it. A context that was never
seen predicts as the longest one seen does.

Words are lower-cased (A-Z) and set apart by one space; an end mark closes each text and stands before it as context.
Counts of context-and-byte strings are taken over all training documents. Subtrees below two bytes of context are
solved in groups of bounded size, what lies above has at most 256 x 255 nodes. Each distinct string is rated once.
Frequent strings and words go to every task, in tables of a fixed size; the rest meets its value in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motiontab.llm.common import cut, words

DEPTH = 5
#: Entries of the tables that go to every task.
TOP_STRINGS, TOP_WORDS = 1 << 19, 1 << 17
WORDS_KEPT = 400_000
END = 255
_BITS = np.arange(8)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    low = x < 8
    while low.any():
        shift[low] += np.log(x[low])
        x = np.where(low, x + 1, x)
        low = x < 8
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def weighted(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln P_w, weight of stopping) of inner nodes; below: the sum of ln P_w over longer contexts."""
    kt = log_kt(a, b) - np.log(2)
    total = np.logaddexp(kt, below - np.log(2))
    return total, np.exp(kt - total)


def packed(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings of a context and a byte as integers, text by text; where each text starts). The byte is lowest."""
    gap = bytes([END]) * depth
    joined = [b" ".join(t) for t in texts]
    data = np.frombuffer(gap + gap.join(j + b"\xff" for j in joined), np.uint8)
    sizes = np.array([len(j) + 1 for j in joined], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    whole = data.astype(np.uint64)
    strings = whole[depth:].copy()
    for k in range(1, depth + 1):
        strings |= whole[depth - k : len(whole) - k] << np.uint64(8 * k)
    keep = np.ones(len(strings), bool)
    for k in range(depth):  # the marks between texts are contexts only
        keep[starts[1:] + depth * np.arange(len(starts) - 1) + k] = False
    return strings[keep], starts


def portions(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each text) of successive texts with about ``most`` characters together."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, [words(x) for x in texts[start:k]]
            start, size = k, 0
        size += len(t or "") + 1
    if size:
        yield start, [words(x) for x in texts[start:]]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


class Logs(dict):
    """word -> log10 probability, null for words that are not in the table (sorted hashes and their counts)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, whole: float):
        order = np.argsort(keys)
        self.keys, self.values_ = keys[order], np.log10(counts[order] + 0.1) - whole

    def __missing__(self, word: bytes) -> float | None:
        if len(self) > WORDS_KEPT:
            self.clear()
        key = np.uint64(xxhash.xxh64_intdigest(word))
        at = int(np.searchsorted(self.keys, key))
        value = self[word] = float(self.values_[at]) if at < len(self.keys) and self.keys[at] == key else None
        return value


class Subtree:
    """The nodes below one two-byte context, from strings (uint64) and their counts."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, depth: int):
        seen = counts > 0
        strings, counts = strings[seen], counts[seen].astype(np.float64)
        self.levels: dict[int, tuple] = {}
        x = (strings & np.uint64(255)).astype(np.int64)
        node, ones = self.path(x)
        keys = ((strings >> np.uint64(8) << np.uint64(8))[:, None] | node.astype(np.uint64)).ravel()
        b = (ones * counts[:, None]).ravel()
        a = ((1 - ones) * counts[:, None]).ravel()
        below = np.zeros(len(keys))
        for d in range(depth, 1, -1):
            if d < depth:
                keys = keys & np.uint64((1 << 8 * (d + 1)) - 1)
            keys, at = np.unique(keys, return_inverse=True)
            a, b, below = (np.bincount(at, v, len(keys)).astype(np.float64) for v in (a, b, below))
            stop = np.ones(len(keys))
            if d == depth:
                below = log_kt(a, b)
            else:
                below, stop = weighted(a, b, below)
            self.levels[d] = keys, a, b, stop
        self.top = keys, a, b, below

    @staticmethod
    def path(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, bits) of a byte: the bits so far after a leading one, and the next bit."""
        x = x[:, None]
        return (1 << _BITS) | (x >> (8 - _BITS)), (x >> (7 - _BITS)) & 1

    def predict(self, strings: np.ndarray, depth: int) -> np.ndarray:
        """Probability of each of a string's 8 bits by contexts of two bytes or more; 0 where such a node was never seen."""
        node, ones = self.path((strings & np.uint64(255)).astype(np.int64))
        p = np.zeros((len(strings), 8))
        for d in range(depth, 1, -1):
            keys, a, b, stop = self.levels[d]
            if not len(keys):
                continue
            want = ((strings >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8))[:, None] | node.astype(np.uint64)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            found = keys[at] == want
            kt = (np.where(ones == 1, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
            p = np.where(found, np.where(p > 0, stop[at] * kt + (1 - stop[at]) * p, kt), p)
        return p


class Crown:
    """Contexts of one byte and of none, as full tables [context, node]."""

    def __init__(self, columns: list[np.ndarray]):
        """columns: context, node, zeros, ones, sum of ln P_w over longer contexts."""
        a, b, below = np.zeros((3, 256, 256))
        a[columns[0], columns[1]], b[columns[0], columns[1]], below[columns[0], columns[1]] = columns[2:]
        whole, self.stop = weighted(a, b, below)
        whole = np.where(a + b > 0, whole, 0.0)
        self.a, self.b = a, b
        self.a0, self.b0 = a.sum(axis=0), b.sum(axis=0)
        _, self.stop0 = weighted(self.a0, self.b0, whole.sum(axis=0))

    def mixed(self, strings: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each string's byte after its context."""
        node, ones = Subtree.path((strings & np.uint64(255)).astype(np.int64))
        context = (strings >> np.uint64(8) & np.uint64(255)).astype(np.int64)[:, None]
        for a, b, stop in ((self.a[context, node], self.b[context, node], self.stop[context, node]), (self.a0[node], self.b0[node], self.stop0[node])):
            kt = (np.where(ones == 1, b, a) + 0.5) / (a + b + 1)
            p = np.where(a + b > 0, np.where(p > 0, stop * kt + (1 - stop) * p, kt), p)
        return np.log10(np.where(p > 0, p, 0.5)).sum(axis=1)


class Table:
    """uint64 key -> value, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, np.nan)
        taken = np.zeros(1 << self.bits, bool)
        at, left = self.slot(keys), np.arange(len(keys))
        self.rounds = 0
        while len(left):
            free = left[~taken[at[left]]]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]], taken[at[put]] = keys[put], values[put], True
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.rounds += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN for keys that are not held."""
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], np.nan)
        left = np.flatnonzero((self.keys[at] != keys) & ~np.isnan(self.values[at]))
        for _ in range(1, self.rounds):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & ~np.isnan(self.values[at[left]])]
        return out


def score(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", top_strings: int = TOP_STRINGS, top_words: int = TOP_WORDS) -> DataFrame:
    """Rows (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), one for each row.

    Documents with crc32(id as text) % 10 = 0 are held out, the others are learned from; a null id is held out. Null
    and empty texts have the end alone. Tokens are the lower-cased (A-Z) words and the end; n_known counts those that
    training held. base_score: log10 of the words' add-0.1 probabilities. score: log10 of the probability
    that context-tree weighting gives to the words' bytes and the end. n_bytes counts these, bits_per_byte is the code
    length. Without training documents each bit has 1/2. Repeated ids are rows of their own; extra columns are not read.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6")
    ids_type = docs.schema[id_col].dataType
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(True))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array(batch.column("held_out"), dtype=bool)
            counts: Counter[bytes] = Counter()
            seen, unseen, learned = [], [], 0
            for start, found in portions(batch.column("text").to_pylist()):
                mine = [w for w, h in zip(found, out[start:], strict=False) if not h]
                for w in mine:
                    counts.update(w)
                learned += len(mine)
                for some, to in ((mine, seen), ([w for w, h in zip(found, out[start:], strict=False) if h], unseen)):
                    if some:
                        to.append(np.unique(packed(some, depth)[0], return_counts=True))
            yield rows(0, np.zeros(1, np.uint64), np.array([learned]))
            yield rows(1, np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts)))
            if seen:
                yield rows(2, *merged(seen))
            if unseen:
                keys = merged(unseen)[0]
                yield rows(2, keys, np.zeros(len(keys), np.int64))

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    gathered = source.mapInArrow(counted, "kind int, key long, n long")
    totals = cut(gathered.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    counts = {r.kind: (r.n or 0, r.keys) for r in totals.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()}
    ends = counts.get(0, (0, 0))[0]
    train_tokens = ends + counts.get(1, (0, 0))[0]
    distinct = counts.get(1, (0, 0))[1] + (ends > 0)

    # subtrees of two bytes of context
    strings = totals.where("kind = 2").select("key", "n", F.expr("(key >> 8) & 65535").cast("int").alias("below"))

    def solved(table: pa.Table) -> pa.Table:
        keys, n = np.array(table.column("key")).view(np.uint64), np.array(table.column("n"))
        tree = Subtree(keys, n, depth)
        p = tree.predict(keys, depth)
        nodes, a, b, log = tree.top
        rated = pa.table([pa.array(keys.view(np.int64)), pa.array(n.astype(np.float64)), pa.nulls(len(n), pa.float64()), pa.nulls(len(n), pa.float64()), pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(n) + 1, 8, dtype=np.int32)), pa.array(p.ravel()))], list(TREE))
        above = pa.table([pa.array(nodes.view(np.int64)), pa.array(a), pa.array(b), pa.array(log), pa.nulls(len(a), pa.list_(pa.float64()))], list(TREE))
        return pa.concat_tables([rated, above])

    TREE = {"key": "long", "a": "double", "b": "double", "log": "double", "p": "array<double>"}
    solved_rows = cut(strings.groupBy("below").applyInArrow(solved, ", ".join(f"{k} {v}" for k, v in TREE.items())))
    upper = solved_rows.where("p IS NULL").groupBy(F.expr("cast((key >> 8) & 255 as int)").alias("context"), F.expr("cast(key & 255 as int)").alias("node")).agg(F.sum("a"), F.sum("b"), F.sum("log"))
    crown = Crown([c.to_numpy() for c in upper.toArrow().columns])  # at most 256 x 255 rows

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key")).view(np.uint64)
            p = np.array(batch.column("p").flatten()).reshape(len(keys), 8)
            yield pa.record_batch([batch.column("key"), batch.column("a"), pa.array(crown.mixed(keys, p))], ["key", "n", "value"])

    rated = cut(solved_rows.where("p IS NOT NULL").select("key", "a", "p").mapInArrow(combined, "key long, n double, value double"))
    named = totals.where("kind = 1")
    best = rated.orderBy(F.desc("n"), "key").limit(top_strings).select("key", "value").toArrow()
    frequent = named.orderBy(F.desc("n"), "key").limit(top_words).select("key", "n").toArrow()
    context = docs.sparkSession.sparkContext
    tables = context.broadcast([t.column(c).to_numpy() for t in (best, frequent) for c in t.column_names])
    whole = np.log10(train_tokens + 0.1 * (distinct + 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, names, n = tables.value
        table, logs = Table(keys.view(np.uint64), values), Logs(names.view(np.uint64), n, float(whole))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for s, found in portions(batch.column("text").to_pylist()):
                strings, starts = packed(found, depth)
                value = table.get(strings)
                missing = np.flatnonzero(np.isnan(value))
                value[missing] = 0.0
                parts = np.add.reduceat(value, starts)
                of = np.searchsorted(starts, missing, "right") - 1
                pairs, times = np.unique(np.stack([of.astype(np.uint64), strings[missing]]), axis=1, return_counts=True) if len(missing) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
                base, n_known, rare = [], [], Counter()
                for i, w in enumerate(found):
                    got = list(map(logs.__getitem__, w))
                    if None in got:
                        unknown = [x for x, g in zip(w, got, strict=True) if g is None]
                        rare.update((i, x) for x in unknown)
                        got = [g for g in got if g is not None]
                    base.append(sum(got) + float(np.log10(ends + 0.1) - whole))
                    n_known.append(len(got) + (ends > 0))
                size = len(found)
                here = np.arange(row, row + size)
                kinds = np.repeat(np.array([0, 1, 2], np.int32), [size, len(rare), len(times)])
                rare_rows = np.fromiter((i for i, _ in rare), np.int64, len(rare))
                rare_keys = np.fromiter((xxhash.xxh64_intdigest(x) for _, x in rare), np.uint64, len(rare)).view(np.int64)
                pad = len(kinds) - size
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([here, here[rare_rows], here[pairs[0].astype(np.int64)]])),
                        pa.array(kinds),
                        pa.array(np.concatenate([here, rare_keys, pairs[1].view(np.int64)])),
                        pa.array(np.concatenate([np.ones(size, np.int64), np.fromiter(rare.values(), np.int64, len(rare)), times])),
                        pa.concat_arrays([batch.column("id")[s : s + size], pa.nulls(pad, batch.column("id").type)]),
                        pa.concat_arrays([batch.column("held_out")[s : s + size], pa.nulls(pad, pa.bool_())]),
                        *(pa.concat_arrays([pa.array(x, t), pa.nulls(pad, t)]) for x, t in (([len(w) + 1 for w in found], pa.int64()), (n_known, pa.int64()), (base, pa.float64()), (parts, pa.float64()), (np.diff(np.append(starts, len(strings))), pa.int64()))),
                    ],
                    ["row", "kind", "key", "times", "id", "held_out", "n_tokens", "n_known", "base", "part", "n_bytes"],
                )
                row += size

    schema = spark_schema(ids_type)
    # (kind, key): a row of its own for each document, and a row for each rare word and string in it
    parts = source.mapInArrow(read, schema)
    values = named.select(F.lit(1).alias("kind"), "key", F.col("n").cast("double").alias("value")).unionAll(rated.select(F.lit(2), "key", "value"))
    joined = parts.join(values, ["kind", "key"], "left")
    count = F.coalesce("value", F.lit(0.0))
    word = F.col("times") * (F.log10(count + 0.1) - float(whole))
    out = joined.groupBy("row").agg(
        F.first("id", ignorenulls=True).alias("id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when((F.col("kind") == 1) & (count > 0), F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.when(F.col("kind") == 0, F.col("base")).when(F.col("kind") == 1, word)).alias("base_score"),
        F.sum(F.when(F.col("kind") == 0, F.col("part")).when(F.col("kind") == 2, F.col("times") * F.col("value"))).alias("score"),
        F.max("n_bytes").alias("n_bytes"),
    )
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))


def spark_schema(ids_type):
    from pyspark.sql import types as T

    kinds = {"row": T.LongType(), "kind": T.IntegerType(), "key": T.LongType(), "times": T.LongType(), "id": ids_type, "held_out": T.BooleanType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "base": T.DoubleType(), "part": T.DoubleType(), "n_bytes": T.LongType()}
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
