import numpy as np
from motiontab.llm import neardup

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, cell int"


def brute(rows, least):
    out = {}
    ok = [i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, c in rows]
    links = {k: set() for k in range(len(rows))}
    for a, (_, v, c) in enumerate(rows):
        for b, (_, w, d) in enumerate(rows):
            if a != b and ok[a] and ok[b] and c == d and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        i = rows[a][0]
        low = None if i is None else min(rows[b][0] for b in seen)
        out[a] = (i is None, i or 0, len(links[a]), low, i is None or low == i)
    return sorted(map(str, out.values()))


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, c, "clash", 1) for i, v, c in rows], SCHEMA)
    out = neardup.near_duplicates(df, 0.98, **sizes)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(str((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept)) for r in out.collect())


def test_cells_and_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(260):  # chains of near copies, exact copies, several labels
        v = base[i % 12] + rng.normal(scale=0.12, size=8) * (i % 3 > 0)
        rows.append((int(i * 7 % 521), [float(np.float32(x)) for x in v], i % 2))
    rows += [(9001, None, 0), (9002, [0.0] * 8, 0), (9003, [1.0, None] * 4, 0), (9004, [float("nan")] * 8, 1), (9005, rows[0][1], None), (None, rows[0][1], 0), (9006, [3.0, 4.0], 0), (9007, [6.0, 8.0], 0), (9008, [], 0), (9, rows[0][1], 0), (9, rows[0][1], 0)]
    want = brute(rows, 0.98)
    assert run(spark, rows) == want
    assert run(spark, rows, cell=10, side=16) == want


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (3, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.0], 1), (0, [1.0, 0.001], 1)]
    assert run(spark, rows) == brute(rows, 0.98) and run(spark, rows, cell=1, side=1) == brute(rows, 0.98)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == ["(False, 1, 0, 1, True)"]
