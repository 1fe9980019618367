"""Token counts by a tokenizer that is compiled to a counting transducer.

The tokenizer is a byte-fallback BPE over pieces that hold the word mark only in front. Texts fall apart at
resets: places that no piece crosses (before a word mark, around a line end). Between resets a deterministic
transducer reads character by character. A state holds what decides the future: the longest suffix that some piece
may continue, and at each position in it the last token of the prefix that ends there, with its count relative to
now. A transition is annotated with the change in the number of emitted tokens, so the deltas of a path sum to the count.
States are made when first needed, and the counts of whole units are kept, both within a bound.

Texts over ``chunk_chars`` are split into chunks that any task may read. A chunk's state map takes the state that it is
entered with to the state that it leaves and the tokens it adds. All chunks are first mapped from the state that their last
CONTEXT characters before lead to; the maps compose along a document where each is entered with the state that its
predecessor leaves, and those that are not are mapped again from there. States, not texts, pass from chunk to chunk.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motiontab.llm.common import cut

MARK = "▁"
#: Units between two resets: marks with what follows, a line end, or marks alone.
UNITS = re.compile(f"[ {MARK}]*[^ {MARK}\n]+|\n|[ {MARK}]+")
CHUNK = 65_536
#: Characters before a chunk from which its entry state is guessed.
CONTEXT = 64
#: States and units that one Python worker keeps before it starts anew.
KEPT = 300_000
UNITS_KEPT = 1_000_000


class Transducer(dict):
    """unit -> number of tokens; a unit not seen yet is read through the transducer."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any("\n" in p and len(p) > 1 or MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece crosses a reset; this vocabulary is not compiled")
        self.starts = {p[:k] for p in self.score for k in range(len(p))}
        order = sorted((p for p in self.score if len(p) > 1), key=lambda p: -self.score[p])
        self.rank = {p: k for k, p in enumerate(order)}  # earlier merges rank lower
        self.halves = {p: x for p in order if (x := self.last_merge(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.restart()

    def restart(self) -> None:
        start = ("", ((0, "", 0),))
        self.start = State(self, *start)
        self.states: dict[tuple, State] = {start: self.start}

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge last into this piece; null if its own characters end up as something else."""
        parts = list(piece)
        while len(parts) > 2:
            found = [(self.rank[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.rank]
            if not found:
                return None
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1])

    def fits(self, left: str, right: str) -> bool:
        """May ``right`` follow ``left`` as neighbouring tokens? left is empty at a reset.

        Undoes the latest merge on either side of the border, again and again: no pair that met at the border may
        have merged before the merge that hid it.
        """
        if not left:
            return True
        key = (left, right)
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) > KEPT:
            self.pairs.clear()
        rank, bound, fine = self.rank, float("inf"), True
        while True:
            if rank.get(left + right, bound) < bound:
                fine = False
                break
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a > b:
                bound, left = a, self.halves[left][1]
            elif b >= 0:
                bound, right = b + 1, self.halves[right][0]
            else:
                break
        self.pairs[key] = fine
        return fine

    def step(self, state: State, char: str) -> tuple[State, int]:
        """The next state and the tokens that this transition adds."""
        text, halves, open_at = state.suffix + char, self.halves, state.open_at
        for at, last, n in open_at:
            token = text[at:]
            if (token in halves or len(token) == 1) and self.fits(last, token):
                break
        total = n + (1 if token in self.score else len(char.encode()))
        kept = [(at, last, n - total) for at, last, n in open_at if text[at:] in self.starts]
        skip = kept[0][0] if kept else len(text)
        key = (text[skip:], (*((at - skip, last, n) for at, last, n in kept), (len(text) - skip, token, 0)))
        if key not in self.states:
            self.states[key] = State(self, *key)
        return self.states[key], total

    def entered(self, key: str) -> State:
        """The state of that key, as ``State.key`` wrote it."""
        suffix, open_at = json.loads(key)
        found = (suffix, tuple(map(tuple, open_at)))
        if found not in self.states:
            self.states[found] = State(self, *found)
        return self.states[found]

    def walk(self, state: State, text: str) -> tuple[State, int]:
        """The state and the tokens added after reading the text character by character."""
        total = 0
        for char in text.replace(" ", MARK):
            state, n = state[char]
            total += n
        return state, total

    def read(self, state: State, text: str) -> tuple[State, int]:
        """The same, with the units between the first and the last reset looked up."""
        units = UNITS.findall(text)
        if len(self.states) > KEPT:
            key = state.key()
            self.restart()
            state = self.entered(key)
        if not units:
            return state, 0
        state, total = self.walk(state, units[0])
        if len(units) > 1:
            total += sum(map(self.__getitem__, units[1:-1]))
            state, n = self.walk(self.start, units[-1])
            total += n
        return state, total

    def __missing__(self, unit: str) -> int:
        if len(self.states) > KEPT:
            self.restart()
        if len(self) > UNITS_KEPT:
            self.clear()
        _, count = self.walk(self.start, unit)
        if len(unit) < 64:
            self[unit] = count
        return count


class State(dict):
    """char -> (next state, tokens added); open_at: (position, last token before it, its count) where a piece may begin."""

    __slots__ = ("machine", "suffix", "open_at")

    def __init__(self, machine: Transducer, suffix: str, open_at: tuple):
        self.machine, self.suffix, self.open_at = machine, suffix, open_at

    def key(self) -> str:
        return json.dumps([self.suffix, self.open_at])

    def __missing__(self, char: str) -> tuple[State, int]:
        move = self[char] = self.machine.step(self, char)
        return move


_compiled: dict[str, Transducer] = {}


def compiled(model_file: str) -> Transducer:
    if model_file not in _compiled:
        _compiled[model_file] = Transducer(model_file)
    return _compiled[model_file]


def count(text: str, model_file: str) -> int:
    """Tokens of one text, without chunks."""
    return sum(map(compiled(model_file).__getitem__, UNITS.findall(" " + text))) if text else 0


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, chunk_chars: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens, over_limit) for all of ``docs``: one for each row.

    A null or empty text has no bytes and no tokens; ids may be null or repeat, equal rows are counted each; other columns
    are not read. Texts of any length are read in chunks of ``chunk_chars`` characters, which different tasks may hold.
    """
    ids = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_file)
        for batch in batches:
            n = [sum(map(machine.__getitem__, UNITS.findall(" " + t))) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk, a long text in one pass; key numbers the documents of all tasks."""
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, at in enumerate(range(0, len(text), chunk_chars)):
                    chunk = text[at : at + chunk_chars]
                    values = ([key], [k], [chunk], [text[max(0, at - CONTEXT) : at]], [len(chunk.encode())])
                    yield pa.record_batch([batch.column("id")[i : i + 1], *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))], ["id", "key", "k", "text", "before", "n_bytes"])
                key += 1

    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's map at one entry state: the given one, or else the one its context leads to."""
        machine = compiled(model_file)
        for batch in batches:
            rows = []
            for k, text, before, entry in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "before", "entry")), strict=True):
                state = machine.entered(entry) if entry is not None else machine.walk(machine.start, before)[0]
                entry = state.key()
                state, n = machine.read(state, text if k else " " + text)
                rows.append((entry, state.key(), n))
            entry, leaves, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column("key"), batch.column("k"), pa.array(entry, pa.string()), pa.array(leaves, pa.string()), pa.array(n, pa.int64())], ["key", "k", "entry", "leaves", "n"])

    few = docs.where(F.length("text") <= chunk_chars).withColumn("n_bytes", F.octet_length("text").cast("long"))
    few = few.mapInArrow(short, few.select("id", "n_bytes").schema.add("n_tokens", "long"))
    long = docs.where(F.length("text") > chunk_chars)
    schema = long.select("id").schema
    for name, kind in (("key", "long"), ("k", "integer"), ("text", "string"), ("before", "string"), ("n_bytes", "long")):
        schema = schema.add(name, kind)
    chunks = cut(long.mapInArrow(split, schema))
    maps = "key long, k int, entry string, leaves string, n long"
    runs = cut(chunks.select("key", "k", "text", "before", F.lit(None).cast("string").alias("entry")).repartition("key", "k").mapInArrow(mapped, maps))
    while True:
        left = F.lag("leaves").over(Window.partitionBy("key").orderBy("k"))  # states of one document's chunks
        wrong = cut(runs.withColumn("left", left).where("left <> entry").select("key", "k", F.col("left").alias("entry")))
        if wrong.isEmpty():
            break
        again = chunks.select("key", "k", "text", "before").join(wrong, ["key", "k"]).select("key", "k", "text", "before", "entry")
        runs = cut(runs.join(wrong.select("key", "k"), ["key", "k"], "left_anti").unionAll(again.mapInArrow(mapped, maps)))
    sizes = chunks.groupBy("key").agg(F.first("id").alias("id"), F.sum("n_bytes").alias("n_bytes"))
    many = sizes.join(runs.groupBy("key").agg(F.sum("n").alias("n_tokens")), "key").select("id", "n_bytes", "n_tokens")
    out = few.unionAll(many)
    return out.select(F.col("id").cast(ids).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
