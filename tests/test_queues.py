import random

from motiontab.operators import queues
from motiontab.operators.stats import chi_square_tail, rank_sum_p

LIFE = "video string, id long, start long, end long, origin int, into int, bundle int"


def ranks(values):
    return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]


def p_two(a, b):
    r = ranks(a + b)
    tied = sum(n**3 - n for n in (sum(x == v for x in a + b) for v in set(a + b)))
    return rank_sum_p(sum(r[: len(a)]) - len(a) * (len(a) + 1) / 2, len(a), len(b), tied) or 0.0


def p_all(samples):
    pooled = [v for s in samples for v in s]
    r, n, at, h = ranks(pooled), len(pooled), 0, 0.0
    for s in samples:
        h += sum(r[at : at + len(s)]) ** 2 / len(s)
        at += len(s)
    tied = sum(k**3 - k for k in (sum(x == v for x in pooled) for v in set(pooled)))
    return chi_square_tail((12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - tied / (n**3 - n)), len(samples) - 1) if tied < n**3 - n else 1.0


def row_loop(lives, values, least=10, most=45):
    """The same by loops over whole tracks."""
    out = []
    for video in sorted({x[0] for x in lives}):
        life = {x[1]: list(x[1:]) for x in lives if x[0] == video}
        rows = {i: list(values.get((video, i), [])) for i in life}
        for origin in (0, -1, -2):
            again = True
            while again:
                again, events, before = False, [], {i: list(r) for i, r in rows.items()}
                for i, start, end, come, go, bundle in life.values():
                    events += [(end, 1, i, bundle)] * (go == origin) + [(start, 0, i, bundle)] * (come == origin)
                events.sort()
                if sum(e[3] for e in events) != len(events):
                    break
                inside, merges = [], []
                for k, (frame, way, i, _) in enumerate(events):
                    if way:
                        inside.append((i, frame))
                    elif len(inside) == 1:
                        merges.append((inside[0], i, 1, not events[k - 1][1], frame))
                        inside = []
                    elif 2 <= len(inside) <= 5:
                        n = min([len(before[i]), most, *(len(before[j]) for j, _ in inside)])
                        if n >= least:
                            ins, back = [before[j][-n:] for j, _ in inside], before[i][:n]
                            if p_all([*ins, back]) <= 0.05:
                                p = [p_two(x, back) for x in ins]
                                order = sorted(p, reverse=True)
                                j = p.index(order[0])
                                re = max(p_two(ins[j], x) for m, x in enumerate(ins) if m != j)
                                if order[0] > 0 and order[1] / order[0] < 0.001 and re / order[0] < 0.001:
                                    merges.append((inside[j], i, len(inside), False, frame))
                                    del inside[j]
                for (a, left), b, n, dependent, frame in merges:
                    out.append((video, a, b, origin, "1x1" if n == 1 else "Nx1", n, dependent, frame - left - 1, 0))
                    life[b][3], life[b][1] = life[a][3], life[a][1]
                    rows[b] = rows.pop(a) + rows[b]
                    del life[a]
                    again = True
    return sorted(out)


def test_returns_equal_the_row_loop(spark):
    pick = random.Random(12)
    lives, values = [], {}
    for v in range(40):
        animals, now, i = list(range(pick.randint(1, 5))), 0, 0
        current, code = {}, {}
        for a in animals:
            current[a] = (i, now, None)
            i += 1
        for _ in range(pick.randint(2, 14)):
            now += pick.randint(1, 60)
            here, gone = [a for a in current if current[a] is not None], [a for a in animals if current[a] is None]
            if gone and (not here or pick.random() < 0.5):
                a = pick.choice(gone)
                current[a] = (i, now, code[a])
                i += 1
            else:
                a = pick.choice(here)
                track, start, come = current[a]
                code[a] = pick.choice([0, 0, 0, -1, -2])
                lives.append((f"v{v}", track, start, now, come, code[a], 2 if v == 7 and a == 0 else 1))
                values[f"v{v}", track] = [100.0 * a + pick.randint(0, 60 if v % 3 else 2) for _ in range(pick.choice([4, 12, 30, 60]))]
                current[a] = None
        for a, x in current.items():
            if x is not None:
                lives.append((f"v{v}", x[0], x[1], now + 5, x[2], None, 1))
                values[f"v{v}", x[0]] = [100.0 * a + pick.randint(0, 60) for _ in range(pick.choice([0, 12, 30, 60]))]
    tracks = [(v, i, k, x) for (v, i), xs in values.items() for k, x in enumerate(xs)]
    got = queues.resolved_returns(spark.createDataFrame(lives, LIFE), spark.createDataFrame(tracks, "video string, id long, frame long, v double"), "v")
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == row_loop(lives, values) and len(rows) > 40
    seen = {(r[3], min(r[5], 3)) for r in rows}
    assert {(0, 1), (0, 2), (0, 3)} <= seen and any(r[6] for r in rows) and "v7" not in {r[0] for r in rows if r[3] == 0}


def test_what_stays_open(spark):
    """Alike animals, short tracks, six away and bundles are left open; one alone is always taken."""
    def run(lives, values):
        tracks = [("v", i, k, float(x)) for i, xs in values.items() for k, x in enumerate(xs)]
        out = queues.resolved_returns(spark.createDataFrame([("v", *x) for x in lives], LIFE), spark.createDataFrame(tracks, "video string, id long, frame long, v double"), "v")
        return [(r.incoming, r.outgoing, r.away) for r in out.collect()]

    two = [(1, 0, 10, None, 0, 1), (2, 0, 12, None, 0, 1), (3, 20, 99, 0, None, 1)]
    apart = {1: range(20), 2: range(100, 120), 3: range(100, 120)}
    assert run(two, apart) == [(2, 3, 2)]
    assert run(two, {**apart, 2: range(20)}) == [] and run(two, {**apart, 3: range(9)}) == []
    assert run([*two[:2], (3, 20, 99, 0, None, 2)], apart) == []
    assert run([(1, 0, 10, None, 0, 1), (3, 20, 99, 0, None, 1)], {1: [1.0]}) == [(1, 3, 1)]
    six = [(k, 0, 10 + k, None, 0, 1) for k in range(6)] + [(9, 30, 99, 0, None, 1)]
    assert run(six, {k: range(100 * k, 100 * k + 30) for k in [*range(6), 9]}) == []
    assert run(two[:2], apart) == []
