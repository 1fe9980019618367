import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from motiontab.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, length int"


def padding(size, length):
    return 0 if size & (size - 1) == 0 else length - size


def test_dynamic_programme_is_cheapest():
    pick = random.Random(3)
    for _ in range(60):
        places = [0, *sorted(pick.sample(range(1, 1400), 9))]
        length = max(512, max(b - a for a, b in zip(places, places[1:], strict=False)))
        penalties = [pick.choice([0.0, 24.0, 96.0]) for _ in places]

        def price(chosen, places=places, penalties=penalties, length=length):
            sizes = [places[b] - places[a] for a, b in zip(chosen, chosen[1:], strict=False)]
            return sum(padding(s, length) for s in sizes) + sum(penalties[k] for k in chosen[1:]) if max(sizes) <= length else float("inf")

        last = len(places) - 1
        best = min(price([0, *inner, last]) for n in range(last) for inner in combinations(range(1, last), n))
        assert price(packing.cuts(places, penalties, length)) == best


def test_portions_are_cut_as_the_whole():
    pick = random.Random(8)
    for length in (64, 100, 4096):
        gaps = [pick.randint(1, min(length, 60)) for _ in range(3000)]
        places = np.cumsum([0, *gaps]).tolist()
        penalties = [pick.choice([0.0, 24.0, 96.0]) for _ in places]
        whole = [places[k] for k in packing.cuts(places, penalties, length)]
        cutter, found, most = packing.Cutter(length), [0], 0
        for s in range(1, len(places), 300):
            cutter.extend(places[s : s + 300], penalties[s : s + 300])
            settled = cutter.settle(s + 300 >= len(places))
            assert settled[0] == found[-1]
            found += settled[1:]
            most = max(most, len(cutter.places))
        cost = lambda cut: sum(padding(b - a, length) for a, b in zip(cut, cut[1:], strict=False)) + sum(penalties[places.index(c)] for c in cut[1:])
        assert cost(found) == cost(whole) and (most < 1500 or length == 4096)


def pieces_hold(rows, out, length):
    """Every id of every document lies in one piece, with the library's ids; sequences are gapless. Returns the padding."""
    tokenizer = Tokenizer.from_file(FILE)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows}
    at, fill = dict.fromkeys(ids, 0), {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0
        at[r.doc_id] += r.length
        assert r.doc_tokens * 4 == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * at[r.doc_id]])
    assert all(4 * n == len(ids[i]) for i, n in at.items())
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        assert fill[r.sequence_id] <= length
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)
    return sum(padding(n, length) for n in fill.values()), sum(fill.values())


def test_pieces_of_odd_documents(spark, monkeypatch):
    texts = [None, "", "One. Two three! Four", "no end " * 900, "x" * 5000, "Café é ́x. \x01 a\x01b \x0b\x0c   y", "<|endoftext|> it's 2024", "A. " * 300, "A. " * 300]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    for length in (256, 512):
        pieces_hold(rows, packing.pack(docs, FILE, length=length).collect(), length)
    null = packing.pack(spark.createDataFrame([(None, "a b", "", 0), (None, "a b", "", 0)], SCHEMA), FILE).collect()
    assert [r.length for r in null] == [3, 3] and {r.doc_id for r in null} == {None}
    assert packing.pack(spark.createDataFrame([], SCHEMA), FILE).count() == 0


def test_little_padding_over_many_solutions(spark):
    pick = random.Random(5)
    rows = [(i, " ".join("".join(pick.choice(["on", "ti", "er", "es"]) for _ in range(3)) + pick.choice(["", "", "", "."]) for _ in range(pick.randint(1, 900)))) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    lost, total = pieces_hold(rows, packing.pack(docs, FILE, length=1024).collect(), 1024)
    assert lost < 0.03 * total
