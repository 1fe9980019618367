import random
import zlib

import numpy as np
import pytest
from motiontab.llm import bestfit

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, part int"


def expanded(placed):
    """(sequence, offset, length) of each piece, and that pieces of a length are numbered without gaps."""
    rows, numbers = [], {}
    for p in placed:
        assert numbers.get(p.length, 0) == p.first
        numbers[p.length] = p.first + p.n * p.copies
        rows += [(p.sequence + k % p.n, p.offset + k // p.n * p.length, p.length) for k in range(p.n * p.copies)]
    return rows, numbers


def one_by_one(lengths, capacity, weights):
    """Best fit by norm, a piece at a time, over all open sequences."""
    cap, open_ = np.array(capacity, float), []
    for x in sorted(lengths, reverse=True):
        need = bestfit.demands(x)
        fine = [k for k, r in enumerate(open_) if (r >= need).all()]
        if not fine:
            open_.append(cap.copy())
            fine = [len(open_) - 1]
        k = min(fine, key=lambda k: (weights * ((open_[k] - need) / cap) ** 2).sum())
        open_[k] = open_[k] - need
    return len(open_)


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(64, 64, 4096), (64, 5, 4096), (64, 64, 1200), (64, 3, 1500)])
def test_every_capacity_holds_and_no_piece_is_lost(score, capacity):
    pick = random.Random(2)
    for n in (0, 1, 30, 2000):
        lengths = [pick.choice([pick.randint(1, 34), 17, 1]) for _ in range(n)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        placed, opened = bestfit.best_fit(counts, capacity, score)
        rows, numbers = expanded(placed)
        assert numbers == counts
        fill = {}
        for sequence, offset, size in sorted(rows):
            tokens, docs, cost = fill.get(sequence, (0, 0, 0))
            assert tokens == offset
            fill[sequence] = (tokens + size, docs + 1, cost + size * size)
        assert len(fill) == opened and all(x <= c for v in fill.values() for x, c in zip(v, capacity, strict=True))
    with pytest.raises(ValueError):
        bestfit.best_fit({65: 1}, capacity)


def test_alike_sequences_at_once_need_no_more_than_one_by_one():
    pick = random.Random(6)
    for capacity in ((100, 100, 10_000), (100, 4, 10_000)):
        lengths = [pick.randint(1, 100) for _ in range(1500)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        weights = np.array([1.0, 0.0, 0.0])
        assert bestfit.best_fit(counts, capacity, "norm", weights)[1] <= one_by_one(lengths, capacity, weights) + 2
    placed, opened = bestfit.best_fit({x: 10**9 for x in range(1, 1025)}, (1024, 1024, 1024**2))
    assert opened * 1024 <= 1.001 * sum(x * 10**9 for x in range(1, 1025)) and len(placed) < 20_000


def holds(rows, out, length):
    """Every id lies in one piece with the library's ids, only long documents are cut, sequences are gapless. Returns their number and the ids."""
    tokenizer = Tokenizer.from_file(FILE)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows}
    at, fill, last = dict.fromkeys(ids, 0), {}, {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        total = len(ids[r.doc_id]) // 4
        assert r.piece == last.get(r.doc_id, -1) + 1 and r.start == at[r.doc_id]
        assert r.length == length or r.piece == 0 and r.length == (total - 1) % length + 1
        last[r.doc_id] = r.piece
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * at[r.doc_id]])
    assert all(4 * n == len(ids[i]) for i, n in at.items())
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        assert fill[r.sequence_id] <= length
    return len(fill), sum(fill.values())


def test_pieces_of_odd_documents(spark):
    texts = [None, "", "One. Two!", "no end " * 900, "x" * 5000, "Café é ́x. \x01 a\x01b \x0b\x0c   y\x00\x85", "<|endoftext|> it's <|endoftext|>2024<|endoftext|>", " \n\n\t x", "日本語 🙂", "same " * 40, "same " * 40]
    pick = random.Random(1)
    odd = [*" \n\t\r\x0b\x1c\x85\xa0　", *"aZé'ñß日🙂0５.,=<>|", "'ll", "<|endoftext|>", "  ", "the"]
    texts += ["".join(pick.choice(odd) for _ in range(pick.randint(1, 80))) for _ in range(400)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    for length in (50, 1024):
        n, total = holds(rows, bestfit.pack(docs, FILE, length=length).collect(), length)
        assert n <= total / length * 1.02 + 1
    tight = bestfit.pack(docs, FILE, length=50, most_docs=3, score="dot").collect()
    holds(rows, tight, 50)
    assert max(sum(r.sequence_id == s for r in tight) for s in {r.sequence_id for r in tight}) == 3
    null = bestfit.pack(spark.createDataFrame([(None, "a b", "", 0)] * 2, SCHEMA), FILE).collect()
    assert sorted((r.doc_id, r.length, r.offset) for r in null) == [(None, 3, 0), (None, 3, 3)] and len({r.sequence_id for r in null}) == 1
    assert bestfit.pack(spark.createDataFrame([], SCHEMA), FILE).count() == 0
