import hashlib
import random
from collections import Counter

import pytest
from motiontab.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, chunk int"
LETTERS = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
LETTERS |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in LETTERS.values())}


def brute(rows):
    """Every pair of tokens of every text is looked at; counts by a plain dictionary."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    told, counts = [], Counter()
    for doc, text in rows:
        pairs, groups, a, b = [], [], [], []
        if text:
            a = [(i, bytes(LETTERS[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_tok.id_to_piece(i)[3:-1], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()) for i in b_tok.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
            spans = []
            for side in (a, b):
                at, out = 0, []
                for i, x in side:
                    out.append((at, at + len(x), i))
                    at += len(x)
                spans.append(out)
            k = 0
            for s, e, i in spans[0]:
                while k < len(spans[1]) and spans[1][k][1] <= s:
                    k += 1
                m = k
                while m < len(spans[1]) and spans[1][m][0] < e:
                    pairs.append((i, spans[1][m][2]))
                    m += 1
            ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
            for s, e in zip([0, *ends], ends, strict=False):
                groups.append("|".join(",".join(str(i) for x, y, i in side if s <= x and y <= e) for side in spans) if len(ends) < 500 else (s, e))
            if groups and isinstance(groups[0], tuple):
                cut, edge = [[""] * len(ends), [""] * len(ends)], {e: k for k, e in enumerate(ends)}
                for n, side in enumerate(spans):
                    g, now = 0, []
                    for _, y, i in side:
                        now.append(str(i))
                        if y in edge:
                            cut[n][g], g, now = ",".join(now), g + 1, []
                groups = ["|".join(x) for x in zip(*cut, strict=True)]
        counts.update(pairs)
        told.append((doc, len(a), len(b), groups, pairs))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(d, a, b, len(g), len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), sha(g)) for d, a, b, g, p in told]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


ODD = [None, "", " ", "a", "a ▁ b", "▁", "<|endoftext|> x </s> <s> <unk>", "  two  spaces \n\n\n and\ttabs \r\n", "é́ ñandú 日本語 🙂🙂 \x00\x01\x1c\x85\xa0 x", "it's we're I'LL 'tis", "aaaa" * 400, "= " * 300, "123 4567 89,000.50"]


def test_odd_texts_and_repeats(spark):
    rows = [*enumerate(ODD), (3, "a"), (3, "a b a b")]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA).repartition(3)
    assert rows_of(alignment.align(docs, A, B)) == sorted(brute(rows))
    null = alignment.align(spark.createDataFrame([(None, "a b", "", 0)] * 2, SCHEMA), A, B).collect()
    assert [r.doc_id for r in null] == [None, None] and {r.count_sum for r in null} == {4}
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_parts_and_chunks_are_as_the_whole(monkeypatch):
    """Long texts in parts and documents over many blocks give what one pass gives."""
    pick = random.Random(4)
    word = lambda: "".join(pick.choice(["on", "ti", "ñ", "er", "es", " ", "\n", "▂", "7", ".", "'s", "\t"]) for _ in range(pick.randint(1, 6)))
    texts = [" ".join(word() for _ in range(n)) for n in (3, 400, 1, 900, 0, 60)]
    known = alignment.Aligner(A, B)

    def row():
        chunk = alignment.Chunk(known)
        for k, t in enumerate(texts):
            chunk.add(k, t)
        return chunk.row()

    whole = row()
    monkeypatch.setattr(alignment, "PART", 70)
    parts = row()
    assert all(list(whole[c]) == list(parts[c]) for c in whole)
    assert len(known.encoded(texts[3])) > 20


def test_fuzzed_units(spark):
    pick = random.Random(9)
    odd = [*" \n\t\r\x0b\x0c\x1c\x1d\x85\xa0  　", *"aZé'ñß日🙂0５.,=<>|▁", "'ll", "<|endoftext|>", "<0x41>", "  ", "the", "ing"]
    rows = [(k, "".join(pick.choice(odd) for _ in range(pick.randint(1, 30)))) for k in range(1500)]
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    assert rows_of(alignment.align(docs, A, B)) == sorted(brute(rows))


def test_a_chunk_is_small(spark):
    """Of a chunk's links the last step reads one compressed value, some bytes a link in place of eight and more."""
    pick = random.Random(6)
    word = ["the ", "ing ", "ñandú ", "on ", "stations ", "ti", "7", "\n", "zürich ", "''ll "]
    known, texts = alignment.Aligner(A, B), ["".join(pick.choice(word) + pick.choice("abcdefgh") for _ in range(2000)) for _ in range(12)]
    chunk = alignment.Chunk(known)
    for k, t in enumerate(texts):
        chunk.add(k, t)
    row = chunk.row()
    steps, times, stops, plain = alignment.unpacked(row["links"])
    assert len(steps) == len(times) == stops[-1] and times.sum() == sum(row["n_links"]) == row["totals"].sum()
    assert len(row["links"]) < 4 * len(steps) + 4 * len(plain) and (plain == row["codes"][row["codes"] < known.a.size]).all()
    assert [list(x) for x in alignment.unpacked(alignment.packed([[], [-1, 2**31 - 1], [5]]))] == [[], [-1, 2**31 - 1], [5]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    assert rows_of(alignment.align(docs, A, B)) == sorted(brute(rows))
