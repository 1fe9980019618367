import math
import random
import re
from collections import Counter

import numpy as np
from motiontab.llm import lexical

SCHEMA = "doc_id long, text string, item_id string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    read = [(i, Counter(terms(t))) for i, t in docs]
    read = [(i, c) for i, c in read if c]
    n, total = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in read:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k, **options):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA).repartition(3)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id int, text string, doc_id int")
    return sorted((tuple(r) for r in lexical.search(d, q, k, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_brute_force_with_ties_repeats_and_odd_texts(spark):
    pick = random.Random(3)
    word = lambda: pick.choice(["the", "The", "of", "Ñu", "ñu", "é9", "日本", "a_b", "x-1", "dé", "7", "été"]) + pick.choice(["", "", "q", "r", "5"])
    text = lambda n: pick.choice([" ", ", ", "\n", " "]).join(word() for _ in range(n))
    docs = [(k, text(pick.randint(1, 30))) for k in range(300)]
    docs += [(400 + k, docs[7][1]) for k in range(30)] + [(500, None), (501, ""), (502, " ,.\x00"), (None, text(9)), (503, text(6000)), (8, docs[8][1]), (8, docs[8][1])]
    items = [(k, text(pick.randint(1, 12))) for k in range(20)]
    items += [(20, items[0][1]), (20, items[0][1] + " the the"), (None, "the"), (21, None), (22, ""), (23, "absent"), (24, docs[334][1])]
    for options in ({}, {"block_terms": 200}):
        assert found(spark, docs, items, 5, **options) == brute(docs, items, 5)
    assert found(spark, [], items, 5) == [] and found(spark, docs, [], 5) == []


def test_graph_shares_and_sums_as_items_do():
    pick = np.random.default_rng(1)
    items = [{int(t): int(pick.integers(1, 4)) for t in set(np.minimum(pick.geometric(0.05, pick.integers(0, 40)), 99))} for _ in range(60)]
    items += [items[3], {}, {k: 1 for k in range(50)}, {k: 1 for k in range(60)}]
    plan = lexical.Plan(items)
    values = pick.integers(0, 1000, (100, 17))
    want = np.array([sum((n * values[t] for t, n in item.items()), np.zeros(17, np.int64)) for item in items])
    assert (plan.scores(values) == want).all()
    phrases = [{10 * p + t: 1 for t in range(10)} for p in range(8)]
    plan = lexical.Plan([phrases[a] | phrases[b] | {80 + k: 2} for k in range(20) for a, b in [pick.choice(8, 2, replace=False)]])
    assert plan.work[0] < plan.work[1] / 2 and plan.nodes > 5


def test_best_rows_of_many_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "WAITING", 50)
    pick = np.random.default_rng(2)
    scores, ids = pick.integers(0, 9, (3, 400)), pick.permutation(400)
    best = lexical.Best(3, 7)
    for s in range(0, 400, 23):
        best.add(scores[:, s : s + 23], ids[s : s + 23])
    item, score, doc = best.cut()
    for k in range(3):
        assert [(-a, b) for a, b in zip(score[item == k], doc[item == k], strict=True)] == sorted((-a, b) for a, b in zip(scores[k], ids, strict=True) if a > 0)[:7]
