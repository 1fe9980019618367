import random

import pytest
from motiontab.llm import tokencount

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, key int"


def library(texts):
    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=MODEL).encode([t or "" for t in texts])]


def test_transducer_equals_library_on_random_texts():
    pick = random.Random(7)
    letters = ["a", "b", "the", " ", "  ", "\n", "é", "▁", "ing", "s", "中", "ａ", "\t", "nation", "0", "12", "😀", "'", "er", "<s>", "\x00"]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 16))) for _ in range(3000)]
    assert [tokencount.count(t, MODEL) for t in texts] == library(texts)


def test_state_maps_compose(spark):
    """Any cut of a text: entered with the state left before, the maps add up to the library's count."""
    pick = random.Random(11)
    machine = tokencount.compiled(MODEL)
    letters = ["a", "the", " ", "  ", "\n", "é", "ing", "s", "中", "nation", "0", "12", "er", "internationalization"]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 60))) for _ in range(400)]
    for text, want in zip(texts, library(texts), strict=True):
        state, total, rest = machine.start, 0, " " + text
        while rest:
            size = pick.randint(1, 20)
            state, n = machine.read(machine.entered(state.key()), rest[:size])
            total, rest = total + n, rest[size:]
        assert total == want


def test_long_texts_without_resets(spark, monkeypatch):
    """Guessed entry states may be wrong; the chunks are then read again until they fit."""
    monkeypatch.setattr(tokencount, "CONTEXT", 1)
    pick = random.Random(12)
    texts = ["".join(pick.choice(["international", "ization", "al", "s", "aaa", "12"]) for _ in range(40)), "a" * 250, "=" * 199]
    docs = spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, MODEL, chunk_chars=37).collect()}
    assert [got[k] for k in range(3)] == library(texts)


def test_table_with_odd_rows_and_any_chunk_length(spark):
    texts = [None, "", " ", "hello  world", "hello  world", "x" * 301, ("ab \n cd  " * 90), " " * 77, "no-break" * 40 + " end"]
    rows = [(i % 7 if i else None, t, "clash", 1) for i, t in enumerate(texts)] + [(5, "x" * 301, "clash", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), n) for r, n in zip(rows, library([r[1] for r in rows]), strict=True))
    for chunk in (1, 7, 64, 10_000):
        out = tokencount.token_counts(docs, MODEL, limit=20, chunk_chars=chunk)
        assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        got = out.collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 20) for r in got)


def test_empty_table(spark):
    assert tokencount.token_counts(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
