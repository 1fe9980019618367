import random

import pytest
from motiontab.llm import ngramjoin

SCHEMA = "doc_id long, text string, n int, rep string, key long"


def sets_of(text, n):
    w = (text or "").encode().translate(ngramjoin.words.__globals__["LOWER"]).split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = [sets_of(t, n) for _, t in rows]
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for b, (j, _) in enumerate(rows):
                if b not in seen and sets[x] and sets[b] and rows[x][0] is not None and j is not None:
                    if 100 * len(sets[x] & sets[b]) >= percent * len(sets[x] | sets[b]):
                        seen.add(b)
                        todo.append(b)
        out.append((i is None, i or 0, len(sets[a]), None if i is None else min(rows[b][0] for b in seen)))
    return sorted(out, key=str)


def run(spark, rows, n=5, percent=80):
    df = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], SCHEMA)
    out = ngramjoin.jaccard_components(df, n, percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def near_copies(seed, size):
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = [pick.choice(vocabulary) for _ in range(30)]
    rows, texts = [], []
    for i in range(size):
        if texts and pick.random() < 0.6:
            text = list(pick.choice(texts))
            for _ in range(pick.randint(0, 5)):
                text[pick.randrange(len(text))] = pick.choice(vocabulary)
        else:
            text = [pick.choice(vocabulary) for _ in range(pick.randint(1, 130))]
            if pick.random() < 0.5:
                text += passage
        texts.append(text)
        rows.append((i * 13 % 1009, pick.choice([" ", "  ", "\n"]).join(w.upper() if pick.random() < 0.1 else w for w in text)))
    return rows


@pytest.mark.parametrize("block", [2048, 4])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "SMALL", 3)
    monkeypatch.setattr(ngramjoin, "OFTEN", 8)
    rows = near_copies(block, 160)
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one two"), (2004, "ONE  two"), (None, "one two"), (2005, "a b c d e"), (2006, "a b c d e " * 3000), rows[3], rows[3]]
    assert run(spark, rows) == brute(rows, 5, 80)


def test_empty_table(spark):
    assert run(spark, []) == []
