"""Alignment of two tokenizers over a corpus.

Tokenizer A is a byte-level BPE, B a byte-fallback BPE over pieces. Both spell the same bytes, so places where tokens of
both end cut a text into groups. Most groups hold one token a side with the same bytes: an array from A's ids to B's ids of
the same bytes, made once, tells them, and they are counted in a vector as long as A's vocabulary. Tokens of all other
groups are paired where their bytes overlap, and only these pairs are shuffled.

A task reads documents in chunks of bounded size. A chunk's row holds its documents' figures, its distinct links with their
counts, and for each document which of these links it has how often, packed in one compressed value. Once the corpus-wide counts are known each chunk
meets the counts of its own links alone, whatever the number of pairs in the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motiontab.llm.bytebpe import vocabulary
from motiontab.llm.common import table

#: Bytes of text in a chunk, and characters that are encoded at once; longer texts are cut before a space after a character
#: that is none, where both tokenizers start anew.
CHUNK, PART = 4_000_000, 1_000_000
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 32-bit integers in one compressed value; differences of rising numbers take about a byte each."""
    planes = [np.ascontiguousarray(x, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    sizes = np.array([len(arrays), *map(len, planes)], "<i4").tobytes()
    return sizes + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(value: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(value, "<i4", 1)[0])
    sizes = np.frombuffer(value, "<i4", count, 4)
    whole = pa.decompress(value[4 + 4 * count :], decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True)
    stops = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return [np.frombuffer(whole, np.uint8, e - s, s).reshape(4, -1).T.copy().view("<i4")[:, 0] for s, e in zip(stops, stops[1:], strict=False)]


class Aligner:
    """Both vocabularies, A's ids with the same bytes in B, and the links of batches of documents."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece

        self.a = vocabulary(a_file)
        self.b = model = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_size = model.vocab_size()
        spelled = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [spelled(i) for i in range(self.b_size)]
        of_bytes: dict[bytes, int] = {}
        for i, piece in enumerate(self.b_bytes):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and (piece not in of_bytes or model.is_byte(of_bytes[piece])):
                of_bytes[piece] = i
        self.same = np.array([of_bytes.get(x, -1) for x in self.a.bytes_of], np.int64)
        self.a_lengths, self.b_lengths = (np.array(list(map(len, x)), np.int64) for x in (self.a.bytes_of, self.b_bytes))
        #: codes of links: A's id for a pair in ``same`` that is a group, else span of A + a * b_size + b
        self.span = self.a.size * (self.b_size + 1)
        width = len(str(max(self.a.size, self.b_size))) + 1
        self.a_marked, self.b_marked = (np.array([f"{i}{mark}" for mark in marks for i in range(n)], f"S{width}") for n, marks in ((self.a.size, ",|"), (self.b_size, ",;")))

    def encoded(self, text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A's ids, B's ids) of each part of the text; none where there are no tokens."""
        if not text:
            return []
        parts, rest = [], " " + text
        while len(rest) > PART:
            at = rest.rfind(" ", 1, PART)
            while at > 1 and (rest[at - 1].isspace() or rest[at + 1].isspace()):
                at = rest.rfind(" ", 1, at)
            at = at if at > 1 else len(rest)
            parts.append(rest[:at])
            rest = rest[at:]
        out = []
        for part in filter(None, [*parts, rest]):
            ids = self.b.encode(part[1:])
            if b"".join(map(self.b_bytes.__getitem__, ids)) != part.encode():
                return []
            out.append((self.a.plain_ids(part), np.array(ids, np.int64)))
        return out

    def linked(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
        """Links' keys (document * span + code), the documents' figures and their groups as text with ``;`` after each.

        a, b: ids of joined documents; ends: where each ends, in bytes."""
        at_a, at_b = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        is_a, is_b = np.zeros((2, ends[-1] + 1), np.int32)
        is_a[at_a], is_b[at_b] = 1, 1
        both, sum_a, sum_b = is_a & is_b, np.cumsum(is_a, dtype=np.int32), np.cumsum(is_b, dtype=np.int32)
        groups = np.cumsum(both, dtype=np.int32)  # that end here or before
        stops = np.concatenate([[0], np.flatnonzero(both)])
        at = np.flatnonzero(is_a | is_b)  # each link ends where a token of either ends
        i, j = sum_a[at] - is_a[at], sum_b[at] - is_b[at]
        group = groups[at] - both[at]
        alone = (np.diff(sum_a[stops]) == 1) & (np.diff(sum_b[stops]) == 1)
        left, right = a[i].astype(np.int64), b[j]
        code = np.where(alone[group] & (self.same[left] == right), left, self.a.size + left * self.b_size + right)
        key = np.searchsorted(ends, at) * self.span + code
        before = np.concatenate([[0], ends])
        figures = [np.diff(c[before]) for c in (sum_a, sum_b, groups)]
        figures.append(np.diff(np.searchsorted(at, before, "right")))
        group_a, group_b = groups[at_a] - both[at_a], groups[at_b] - both[at_b]
        said = np.empty(len(a) + len(b), self.a_marked.dtype)
        said[np.arange(len(a)) + sum_b[stops[group_a]]] = self.a_marked[a + both[at_a] * self.a.size]
        said[np.arange(len(b)) + sum_a[stops[group_b + 1]]] = self.b_marked[b + both[at_b] * self.b_size]
        at_token = sum_a[before] + sum_b[before]
        text = [said[s:e].tobytes().translate(None, b"\0") for s, e in zip(at_token, at_token[1:], strict=False)]
        return key, figures, text


class Chunk:
    """Documents that are gathered until they hold ``CHUNK`` bytes."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.bytes = aligner, 0
        self.ids: list = []
        self.figures: list[list[int]] = []
        self.texts: list = []  # a running hash for each document with tokens, else None
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.waiting: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        self.size = 0

    def add(self, doc_id, text: str | None) -> None:
        parts = self.aligner.encoded(text)
        self.ids.append(doc_id)
        self.figures.append([0, 0, 0, 0])
        self.texts.append(None)
        for a, b in parts:
            size = int(self.aligner.a_lengths[a].sum())
            self.waiting.append((len(self.ids) - 1, a, b, size))
            self.size, self.bytes = self.size + size, self.bytes + size
            if self.size >= PART:
                self.link()

    def link(self) -> None:
        if not self.waiting:
            return
        docs, a, b, sizes = zip(*self.waiting, strict=True)
        keys, figures, said = self.aligner.linked(np.concatenate(a), np.concatenate(b), np.cumsum(sizes))
        number = np.array(docs, np.int64)
        keys, times = np.unique(number[keys // self.aligner.span] * self.aligner.span + keys % self.aligner.span, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        for k, (doc, text) in enumerate(zip(docs, said, strict=True)):
            for f, x in enumerate(figures):
                self.figures[doc][f] += int(x[k])
            if self.texts[doc] is None:
                self.texts[doc] = hashlib.sha256(text[:-1])
            else:
                self.texts[doc].update(b";" + text[:-1])
        self.waiting, self.size = [], 0

    def row(self) -> dict:
        """The chunk's columns; ``links`` packs steps between the links' places in ``codes``, how often each is there, where each
        document's end, and the codes of pairs in ``same``."""
        self.link()
        keys, times = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.keys, self.times))
        keys, at = np.unique(keys, return_inverse=True)
        times = np.bincount(at, times, len(keys)).astype(np.int64)
        doc, code = np.divmod(keys, self.aligner.span)
        codes, own = np.unique(code, return_inverse=True)
        return {
            "ids": self.ids,
            **{name: [f[k] for f in self.figures] for k, name in enumerate(FIGURES)},
            "groups_sha256": [t.hexdigest() if t else "" for t in self.texts],
            "codes": codes,
            "totals": np.bincount(own, times, len(codes)).astype(np.int64),
            "links": packed([np.diff(own, prepend=0), times, np.searchsorted(doc, np.arange(1, len(self.ids) + 1)), codes[codes < self.aligner.a.size]]),
        }


_known: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    if (a_file, b_file) not in _known:
        _known[a_file, b_file] = Aligner(a_file, b_file)
    return _known[a_file, b_file]


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of all of ``docs``: one for each row.

    A reads a space and the text, B the text; special strings are plain text. A link joins a token of A and one of B that
    share bytes; a pair's count is the number of its links in the corpus. n_best: links whose count is the highest of their B
    id, count_sum: the sum of the counts over links. A text that is null or empty, or that B does not spell byte for byte
    (it writes its word mark as a space), has no tokens: zeros and ''. Ids may be null or repeat, each row counts;
    other columns are not read, an empty table gives no rows. Texts of any length are encoded in parts.
    """
    spark, ids = docs.sparkSession, docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = {"ids": None} | {f: "array<int>" for f in FIGURES} | {"groups_sha256": "array<string>", "codes": "array<long>", "totals": "array<long>", "links": "binary"}
    arrow = {"array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = aligner(a_file, b_file), TaskContext.get().partitionId() << 32
        chunk, kind = Chunk(known), None

        def row() -> pa.RecordBatch:
            made = chunk.row()
            return pa.record_batch([pa.array([number], pa.int64()), *(pa.array([made[c]], arrow[k] if k else pa.list_(kind)) for c, k in kinds.items())], ["chunk", *kinds])

        for batch in batches:
            kind = batch.column("id").type
            for doc_id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                chunk.add(doc_id.as_py(), text.as_py())
                if chunk.bytes >= CHUNK or len(chunk.ids) >= 100_000:
                    yield row()
                    chunk, number = Chunk(known), number + 1
        if chunk.ids:
            yield row()

    schema = f"chunk long, ids array<{ids.simpleString()}>, " + ", ".join(f"{c} {k}" for c, k in kinds.items() if k)
    chunks = table(docs.mapInArrow(encoded, schema))
    known = aligner(a_file, b_file)
    size, b_size = known.a.size, known.b_size
    links = chunks.select("chunk", F.explode(F.arrays_zip("codes", "totals")).alias("x")).select("chunk", F.col("x.codes").alias("code"), F.col("x.totals").alias("n"))
    # at most A's vocabulary
    alone = dict(links.where(F.col("code") < size).groupBy("code").agg(F.sum("n")).collect())
    same = spark.createDataFrame([(int(size + a * b_size + known.same[a]), n) for a, n in alone.items()], "code long, n long")
    pairs = table(links.where(F.col("code") >= size).groupBy("code").agg(F.sum("n").alias("n")).unionAll(same).groupBy("code").agg(F.sum("n").alias("n")))
    b_id = ((F.col("code") - size) % b_size).cast("int")
    # at most B's vocabulary
    best = F.broadcast(pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("most")))
    scored = pairs.withColumn("b", b_id).join(best, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    of_a = np.zeros((2, size), np.int64)
    whole = F.broadcast(same.select("code"))  # at most A's vocabulary
    for code, n, top in scored.join(whole, "code", "left_semi").collect():
        a = (code - size) // b_size
        of_a[:, a] = n, top
    met = links.where(F.col("code") >= size).select("chunk", "code").join(scored, "code")
    met = met.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("code", "n", "best"))).alias("m")).select("chunk", F.col("m.n").alias("n"), F.col("m.best").alias("best"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].values for c in batch.schema.names if c != "links" and batch.column(c)[k].is_valid}
                steps, times, stops, plain = unpacked(batch.column("links")[k].as_py())
                own = np.cumsum(steps, dtype=np.int64)
                n, top = of_a[0, plain], of_a[1, plain]
                if "n" in one:
                    n, top = (np.concatenate([x, one[c].to_numpy(zero_copy_only=False).astype(np.int64)]) for x, c in ((n, "n"), (top, "best")))
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[own])])[np.concatenate([[0], stops])]) for x in (top, n)]
                columns = [one["ids"], *(one[f].cast(pa.int64()) for f in FIGURES), *(pa.array(x, pa.int64()) for x in sums), one["groups_sha256"]]
                yield pa.record_batch(columns, ["id", *FIGURES, "n_best", "count_sum", "groups_sha256"])

    rows = chunks.select("chunk", "ids", *FIGURES, "groups_sha256", "links").join(met, "chunk", "left").drop("chunk")
    out = rows.mapInArrow(told, f"id {ids.simpleString()}, " + ", ".join(f"{c} long" for c in (*FIGURES, "n_best", "count_sum")) + ", groups_sha256 string")
    return out.withColumnRenamed("id", id_col)
