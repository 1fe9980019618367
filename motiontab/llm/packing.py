"""Order-preserving packing of tokenized documents into training windows.

Documents follow each other in the order of their ids. Windows are cut at the end of a document, at the end of a
sentence, or (dearest, and only offered where a sentence is long) between two words. Dynamic programming over these
places minimises padding plus penalties for what is cut apart:

    cost[k] = penalty[k] + min over j of cost[j] + padding(place[k] - place[j]),  place[k] - place[j] <= length

Padding is length - size, so the minimum over a sliding window of cost[j] + place[j] decides; a monotone queue gives
it in constant time. A window whose size is a power of two needs no padding, so these few sizes, from 1 on, are tried too.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties in tokens of padding: a cut at a sentence's end, and one inside a sentence.
SENTENCE_CUT, INSIDE_CUT = 24.0, 96.0
#: Places inside sentences are offered every so many tokens where a gap between other places is over LONG_GAP.
INSIDE_STEP, LONG_GAP = 32, 256
#: Bytes of text that one packing task aims at; a task then ends with one padded window among hundreds.
BYTES_PER_TASK = 4_000_000
#: Tokens that are gathered before their places are added to the programme and settled windows come out.
SOLVE = 1_000_000
WORDS_KEPT = 500_000
ENDS = ".!?…。！？"
#: Marks that end a word and are one pre-token of their own there; an apostrophe is none.
MARKS = ".,;:!?|#$%&*-"
#: Byte-level tokenizers write each byte as a letter: printable ones as themselves, the rest in order from 256.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Cutter:
    """The dynamic programme over places that come in portions.

    Costs, back pointers and the queue go on from portion to portion. A cut is settled once every place that a later
    window can start from leads back to it, so the cuts are those of the whole stream's minimum.
    """

    def __init__(self, length: int):
        self.length, self.powers = length, [2**k for k in range(length.bit_length()) if 2**k < length]
        self.places, self.cost, self.back = [0], [0.0], [0]
        self.queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])

    def at_powers(self, places: list[int]) -> dict[int, list[int]]:
        """For new places that lie a power of two behind others: the indices of these."""
        old = len(self.places)
        first = next((k for k in range(old - 1, -1, -1) if places and places[0] - self.places[k] > self.length), 0)
        known, new = np.array(self.places[first:] + places), np.array(places)
        found: dict[int, list[int]] = {}
        for power in self.powers:
            at = np.searchsorted(known, new - power)
            for k in np.flatnonzero(known[at] == new - power).tolist():
                found.setdefault(old + k, []).append(first + int(at[k]))
        return found

    def extend(self, places: list[int], penalties: list[float]) -> None:
        """Later places, increasing, no gap over ``length``, and the penalty of a cut at each."""
        length, queue, cost, back = self.length, self.queue, self.cost, self.back
        behind = self.at_powers(places).get
        for k, (place, penalty) in enumerate(zip(places, penalties, strict=True), len(self.places)):
            while place - queue[0][1] > length:
                queue.popleft()
            least, _, j = queue[0]
            least += length - place
            for i in behind(k, ()):
                if cost[i] < least:
                    least, j = cost[i], i
            total = least + penalty
            cost.append(total)
            back.append(j)
            value = total + place
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, place, k))
        self.places += places

    def settle(self, last: bool) -> list[int]:
        """Places to cut at that are certain, the start among them; all after the last portion. What lies before goes."""
        end = len(self.places) - 1
        if not last:
            live = {k for k in range(len(self.places)) if self.places[k] > self.places[-1] - self.length}
            while len(live) > 1:
                k = max(live)
                live.discard(k)
                live.add(self.back[k])
            end = live.pop()
        found = [end]
        while found[-1]:
            found.append(self.back[found[-1]])
        settled = [self.places[k] for k in reversed(found)]
        if end:
            self.places, self.cost = self.places[end:], self.cost[end:]
            self.back = [max(0, k - end) for k in self.back[end:]]
            self.queue = deque((v, p, k - end) for v, p, k in self.queue if k >= end)
        return settled


def cuts(places: list[int], penalties: list[float], length: int) -> list[int]:
    """Indices of the cheapest places to cut at, the first and the last place included.

    places: increasing, starts with 0, no gap over ``length``; penalties: of a cut at each place.
    """
    cutter = Cutter(length)
    cutter.extend(places[1:], penalties[1:])
    at = {p: k for k, p in enumerate(places)}
    return [at[p] for p in cutter.settle(True)]


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes; texts split at white space without changing ids."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.read = self.tokenizer.model.tokenize
        if self.ids("a b\nc") != self.ids("a") + self.ids("b") + self.ids("c"):
            raise ValueError("this tokenizer does not drop white space; it cannot be read word by word")
        # lower-cases, marks stand alone, and bytes are written as letters before the model reads them
        read = [t.id for w in ("Ã©a", ".!") for t in self.read(w)]
        self.simple = self.ids("Éa.!") == self.ids("éa") + self.ids(".!") == read
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)  # ids that end a sentence
        self.ends[[i for c in ENDS for i in self.ids(c)[-1:] if self.tokenizer.decode([i]).strip() == c]] = True

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        """A plain word is a lower-case core and its closing marks, which the tokenizer's model reads alone."""
        if len(self) > WORDS_KEPT:
            self.clear()
        core = word.rstrip(MARKS)
        if core.isalpha() and self.simple:
            low = core.lower()
            if core.isascii():
                value = array("I", [t.id for t in self.read(low)]).tobytes()
            elif len(low) == len(core) and max(low) < "\u0250":
                value = array("I", [t.id for t in self.read(low.encode().decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
            else:
                value, core = array("I", self.ids(word)).tobytes(), word
            if len(core) < len(word):
                value += self[word[len(core) :]]
        else:
            value = array("I", self.ids(word)).tobytes()
        self[word] = value
        return value


_known: dict[str, WordIds] = {}


def word_ids(tokenizer_file: str) -> WordIds:
    if tokenizer_file not in _known:
        _known[tokenizer_file] = WordIds(tokenizer_file)
    return _known[tokenizer_file]


def split(text: str) -> list[str]:
    """Words between spaces, tabs and line ends; other white space stays inside, the tokenizer drops it there."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def places_of(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of joined documents from their ids, their ends and the ids that end a sentence; 0 comes first."""
    sentences = np.flatnonzero(stops[ids]) + 1
    places = np.unique(np.concatenate([[0], sentences, ends]))
    penalties = np.full(len(places), SENTENCE_CUT)
    gaps = np.diff(places)
    long = np.flatnonzero(gaps > LONG_GAP)
    if len(long):
        more = np.concatenate([np.arange(p + INSIDE_STEP, p + g, INSIDE_STEP) for p, g in zip(places[long], gaps[long], strict=True)])
        order = np.argsort(np.concatenate([places, more]), kind="stable")
        places, penalties = np.concatenate([places, more])[order], np.concatenate([penalties, np.full(len(more), INSIDE_CUT)])[order]
    penalties[np.searchsorted(places, ends)] = 0.0
    return places, penalties


class Packer:
    """Packs one ordered stream; rows of pieces come out as windows are settled."""

    def __init__(self, length: int, first_sequence: int, stops: np.ndarray):
        self.sequence, self.stops, self.cutter = first_sequence, stops, Cutter(length)
        self.docs: list[tuple] = []  # (id, ids, ids already packed), from the last settled cut on
        self.new: list[bytes] = []  # ids of the documents whose places are not added yet
        self.waiting = self.total = self.start = 0  # tokens of these, added tokens, and the last settled cut

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.new.append(ids)
        self.waiting += len(ids) >> 2
        return self.settle(False) if self.waiting >= SOLVE else []

    def settle(self, last: bool) -> list[tuple]:
        if self.new:
            ends = np.cumsum([len(ids) >> 2 for ids in self.new])
            places, penalties = places_of(np.frombuffer(b"".join(self.new), "<u4"), ends, self.stops)
            self.cutter.extend((places[1:] + self.total).tolist(), penalties[1:].tolist())
            self.total += self.waiting
            self.new, self.waiting = [], 0
        out, k = [], 0
        for stop in self.cutter.settle(last)[1:]:
            offset = 0
            while self.start < stop:
                doc_id, ids, done = self.docs[k]
                total = len(ids) >> 2
                size = min(total - done, stop - self.start)
                out.append((doc_id, done, size, zlib.crc32(memoryview(ids)[4 * done : 4 * (done + size)]), total, self.sequence, offset))
                offset, self.start = offset + size, self.start + size
                self.docs[k] = (doc_id, ids, done + size)
                if done + size == total:
                    k += 1
            self.sequence += 1
        self.docs = self.docs[k:]
        return out


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_file: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all of ``docs``.

    A document's ids are those of its text by the tokenizer, then ``end_id``; a null or empty text has that id alone.
    Each id lies in exactly one piece, pieces of a sequence follow each other from offset 0, and a sequence holds at
    most ``length`` ids. Null and repeated ids are documents like any other; equal ids are ordered by a hash of the text.
    Other columns are not read, an empty table gives no piece. Tasks take ranges of (id, hash), so that one id with many
    rows spreads over tasks, and stream them: each packs its range at the least cost over the places offered, holding
    about a million tokens at once, what is not settled yet, and one document whole.
    """
    ids_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    docs = docs.withColumn("turn", F.xxhash64("text"))
    ranges = docs.repartitionByRange(max(1, size // BYTES_PER_TASK), "id", "turn").sortWithinPartitions("id", "turn").select("id", "text")
    schema = ranges.select("id").schema
    for field in PIECES.split(", "):
        schema = schema.add(*field.split())
    arrow = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = word_ids(tokenizer_file), np.array([end_id], "<u4").tobytes()
        packer = Packer(length, TaskContext.get().partitionId() << 32, known.ends)
        kind = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(columns[0], kind), *(pa.array(c, f.type) for c, f in zip(columns[1:], arrow, strict=True))], ["id", *arrow.names])

        for batch in batches:
            kind = batch.schema.field("id").type
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += packer.add(doc_id, b"".join(map(known.__getitem__, split(text))) + end)
            if rows:
                yield batch_of(rows)
        if rows := packer.settle(True):
            yield batch_of(rows)

    return ranges.mapInArrow(packed, schema).select(F.col("id").cast(ids_type).alias(id_col), *[f.split()[0] for f in PIECES.split(", ")])
