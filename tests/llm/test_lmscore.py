import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from motiontab.llm import lmscore

SCHEMA = "doc_id long, text string, row int, kind string, n long"


def brute(rows, depth):
    """Context-tree weighting by dictionaries, one bit after another."""
    docs = [((t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split(), i is None or zlib.crc32(str(i).encode()) % 10 == 0) for i, t in rows]
    data = [b" ".join(w) + b"\xff" for w, _ in docs]
    counts = {}

    def steps(x):
        x = b"\xff" * depth + x
        for k in range(depth, len(x)):
            for bit in range(8):
                yield [(x[k - d : k], 1 << bit | x[k] >> 8 - bit) for d in range(depth + 1)], x[k] >> 7 - bit & 1

    for x, (_, held) in zip(data, docs, strict=True):
        if not held:
            for path, one in steps(x):
                for node in path:
                    counts.setdefault(node, [0, 0])[one] += 1
    lg = math.lgamma
    kt = {n: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi) for n, (a, b) in counts.items()}
    log, stop, below = {}, {}, Counter()
    for node in sorted(counts, key=lambda n: -len(n[0])):
        if len(node[0]) == depth:
            log[node] = kt[node]
        else:
            log[node] = np.logaddexp(kt[node], below[node]) - math.log(2)
            stop[node] = math.exp(kt[node] - math.log(2) - log[node])
        if node[0]:
            below[node[0][1:], node[1]] += log[node]
    words = Counter(w for (d, held) in docs if not held for w in d)
    ends = sum(not held for _, held in docs)
    n, v = sum(words.values()) + ends, len(words) + (ends > 0)
    out = []
    for x, (d, held) in zip(data, docs, strict=True):
        total = 0.0
        for path, one in steps(x):
            p = None
            for node in reversed(path):
                if node in counts:
                    here = (counts[node][one] + 0.5) / (sum(counts[node]) + 1)
                    p = here if p is None else stop[node] * here + (1 - stop[node]) * p
            total += math.log10(0.5 if p is None else p)
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(words[w] for w in d), ends])
        out.append((held, len(d) + 1, sum(words[w] > 0 for w in d) + (ends > 0), n, base, total, len(x)))
    return out


def texts(seed, size):
    pick = random.Random(seed)
    parts = ["the", "an", "er", "In", "ß", "ti", "on"]
    return [" ".join("".join(pick.choice(parts) for _ in range(pick.randint(1, 3))) for _ in range(pick.randint(0, 25))) for _ in range(size)]


@pytest.mark.parametrize(("top", "depth"), [(1, 3), (40, 3), (100_000, 5)])
def test_equals_brute_force(spark, top, depth):
    rows = list(enumerate(texts(top, 50))) + [(60, None), (61, ""), (62, " \n "), (63, "x" * 2000), (None, "the the")]
    df = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], SCHEMA)
    out = lmscore.score(df, depth, top_strings=top, top_words=top).collect()
    want = {i: w for (i, _), w in zip(rows, brute(rows, depth), strict=True)}
    assert len(out) == len(rows)
    for r in out:
        held, tokens, known, train, base, score, size = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.n_bytes) == (held, tokens, known, train, size)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-8)
        assert r.bits_per_byte == pytest.approx(-score / math.log10(2) / size)


def test_next_byte_probabilities_sum_to_one():
    strings, _ = lmscore.packed([t.encode().split() for t in texts(5, 60)], 4)
    keys, n = np.unique(strings, return_counts=True)
    context = keys[len(keys) // 2] >> np.uint64(8)
    every = context << np.uint64(8) | np.arange(256, dtype=np.uint64)
    group = (keys >> np.uint64(8)) & np.uint64(65535)
    tops = [lmscore.Subtree(keys[group == g], n[group == g], 4) for g in np.unique(group)]
    rows = {}
    for t in tops:
        for key, *v in zip(*t.top, strict=True):
            at = (int(key) >> 8 & 255, int(key) & 255)
            rows[at] = [x + y for x, y in zip(rows.get(at, (0, 0, 0)), v, strict=True)]
    crown = lmscore.Crown([np.array(c) for c in zip(*((*k, *v) for k, v in rows.items()), strict=True)])
    tree = tops[int(np.searchsorted(np.unique(group), context & np.uint64(65535)))]
    assert (10 ** crown.mixed(every, tree.predict(every, 4))).sum() == pytest.approx(1.0)


def test_empty_table_and_repeats(spark):
    assert lmscore.score(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", 0, "", 0)] * 3, SCHEMA)
    assert len({(r.score, r.base_score) for r in lmscore.score(df).collect()}) == 1
