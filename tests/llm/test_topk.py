import random

import numpy as np
from motiontab.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute(rows, k, scale=64.0):
    good = [(i, np.floor(scale * np.array(v, np.float32).astype(float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 5 == 0:
            scores = sorted((-int(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=k, side=64).select("query_id", "rank", "vec_id", "score").collect())


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    pick = random.Random(1)
    rows = [(i, [pick.choice([-0.5, 0.1, 0.25, 0.3]) for _ in range(4)]) for i in range(400)]
    rows += [(1000, None), (1005, [0.1, None, 0.2, 0.3]), (1010, [float("nan"), 0.0, 0.0, 0.0]), (1015, [float("inf")] * 4), (None, [0.1] * 4), (1020, []), (1025, []), (1030, [0.5, 0.5]), (1031, [600.0, -700.0])]
    rows += [(7, [0.1] * 4), (7, [0.1] * 4)]
    pick.shuffle(rows)
    assert run(spark, rows, 20) == brute(rows, 20)
    assert run(spark, rows[:15], 20) == brute(rows[:15], 20)


def test_empty_tables(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [(5, [1.0])], 3) == []
    assert run(spark, [(6, [1.0]), (7, [1.0])], 3) == []
