import itertools
import random

from motiontab.operators import collisions, partitions
from motiontab.operators.saving import saved


def enumerated(items, parts):
    best = None
    for picked in itertools.product(range(len(parts)), repeat=len(items)):
        if set(picked) == set(range(len(parts))):
            error = sum(abs(p - sum(a for a, k in zip(items, picked, strict=True) if k == j)) for j, p in enumerate(parts))
            best = error if best is None else min(best, error)
    return best


def test_best_partitions_equal_enumeration(spark):
    pick, items, parts = random.Random(7), {}, {}
    for b in range(60):
        items[b] = [float(pick.choice([pick.randint(1, 30), 10])) for _ in range(pick.randint(1, 6))]
        parts[b] = [float(pick.randint(0, 60)) for _ in range(pick.randint(1, 4))]
    rows = [("v", b, 100 + k, a) for b, xs in items.items() for k, a in enumerate(xs)]
    areas = [("v", b, k, a) for b, xs in parts.items() for k, a in enumerate(xs)]
    out = partitions.best_partitions(spark.createDataFrame(rows, "video string, bundle int, item int, area double"), spark.createDataFrame([*areas, ("v", 99, 1, 1.0)], "video string, bundle int, part int, area double")).collect()
    for b in items:
        got = [r for r in out if r.bundle == b]
        want = enumerated(items[b], parts[b])
        assert (want is None) == (not got)
        if got:
            assert sorted(r.item for r in got) == [100 + k for k in range(len(items[b]))] and {r.part for r in got} == set(range(len(parts[b])))
            error = sum(abs(p - sum(items[b][r.item - 100] for r in got if r.part == j)) for j, p in enumerate(parts[b]))
            assert abs(error - want) < 1e-9 and all(abs(r.error - want) < 1e-9 for r in got)


def test_best_partitions_write_no_partial_ones(spark, monkeypatch):
    """Deals are tried where a bundle is; bundles with more deals than DEALS grow by rounds to the same rows."""
    pick, rows, areas = random.Random(3), [], []
    for b in range(40):
        n, m = pick.randint(1, 10), pick.randint(1, 3)
        rows += [("v", b, k, None if b == 7 else pick.choice([0.1, 0.7, 3.0]) * pick.randint(0, 9)) for k in range(n)]
        areas += [("v", b, k, None if b == 8 and k == 0 else float(pick.randint(0, 20))) for k in range(m)]
    items, parts = spark.createDataFrame(rows, "video string, bundle int, item int, area double"), spark.createDataFrame(areas, "video string, bundle int, part int, area double")
    written = []

    def counted(df):
        out = saved(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(partitions, "saved", counted)
    at_once = sorted(map(str, partitions.best_partitions(items, parts).collect()))
    assert sum(written) == 0 and any("bundle=7" in r and "error=None" in r for r in at_once)
    monkeypatch.setattr(partitions, "DEALS", 8)
    monkeypatch.setattr(partitions, "CELLS", 5)
    assert sorted(map(str, partitions.best_partitions(items, parts).collect())) == at_once and sum(written) > 40


def graph(pick, layers):
    """A random history: groups of tracks that meet, layer by layer."""
    edges, tracks, last = [], 0, []
    for _ in range(layers):
        new = []
        if not last:
            last = list(range(pick.randint(1, 3)))
            tracks = len(last)
        pool = last[:]
        while pool:
            group = [pool.pop() for _ in range(min(len(pool), pick.randint(1, 2)))]
            children = list(range(tracks, tracks + pick.randint(1, 2)))
            tracks += len(children)
            edges += [(p, c) for p in group for c in children]
            new += children
        last = new
    return edges, tracks


def test_balanced_sizes_equal_brute_force(spark):
    pick = random.Random(11)
    every, edges, kinds = [], [], {}
    for v in range(14):
        e, n = graph(pick, pick.randint(1, 2))
        low = [pick.randint(1, 2) for _ in range(n)]
        high = [pick.choice([None, None, low[k], low[k] + 1, 3]) for k in range(n)]
        high = [h if h is None or h >= low[k] else low[k] for k, h in enumerate(high)]
        every += [(v, k, low[k], high[k]) for k in range(n)]
        edges += [(v, p, c) for p, c in e]
        kinds[v] = (e, low, high)
    bounds = spark.createDataFrame(every, "video int, track int, low long, high long")
    family = collisions.families(spark.createDataFrame(edges, "video int, parent int, child int"))
    groups = {}
    for r in family.collect():
        groups.setdefault((r.video, r.family), (set(), set()))
        groups[r.video, r.family][0].add(r.parent)
        groups[r.video, r.family][1].add(r.child)
    tight = {(r.video, r.track): (r.low, r.high) for r in partitions.propagated(bounds, family)[0].collect()}
    sizes, unbalanced = partitions.balanced(bounds, family)
    size, open_ = {(r.video, r.track): r.size for r in sizes.collect()}, {r.video for r in unbalanced.collect()}
    seen = set()
    for v, (e, low, high) in kinds.items():
        own = [g for (w, _), g in groups.items() if w == v]
        fits = [x for x in itertools.product(*[range(a, (a + 3 if b is None else b) + 1) for a, b in zip(low, high, strict=True)]) if all(sum(x[k] for k in p) == sum(x[k] for k in c) for p, c in own)]
        if fits:
            mine = [size[v, k] for k in range(len(low))]
            assert v not in open_ and all(sum(mine[k] for k in p) == sum(mine[k] for k in c) for p, c in own)
            assert all(a <= s and (b is None or s <= b) for a, s, b in zip(low, mine, high, strict=True))
            assert all(tight[v, k][0] == min(x[k] for x in fits) for k in range(len(low)))
        else:
            assert v in open_
        seen.add(bool(fits))
    assert seen == {True, False}
