import random
import re

from motiontab.operators import remaps


def line_by_line(rows, pairs):
    """The rows as lines of text that are searched, dropped and rewritten."""
    lines = [",".join("" if x is None else str(x) for x in r) for r in rows]
    swap = lambda a, b: [re.sub(rf"(^|,){a}(?=,)", rf"\g<1>{b}", x) for x in lines]
    for new, old in pairs:
        own = [k for k, x in enumerate(lines) if x.startswith(f"{old},")][-1:]
        cluster = lines[own[0]].split(",")[1] if own else ""
        row = [k for k, x in enumerate(lines) if cluster and x.startswith(f"{cluster},") and new in [int(v) for v in x.split(",")[1:4] if v]][:1]
        mate = [x.split(",")[0] for x in lines if cluster and x.split(",")[1] == cluster and not x.startswith(f"{old},")][:1]
        other = [v for v in lines[row[0]].split(",")[1:4] if v and v != str(new)][:1] if row else []
        size = int(lines[row[0]].rsplit(",", 1)[1]) if row else 0
        lines = [x for k, x in enumerate(lines) if k not in own + row]
        lines = swap(new, old)
        if size > 2 and mate and other:
            lines = swap(other[0], mate[0])
    return sorted(lines)


def history(pick):
    """Singles that meet in twos and threes and part again, one after the other, with remaps for some of those that come out."""
    rows, pairs, now, next_id = {}, [], list(range(1, 7)), 7
    for i in now:
        rows[i] = [i, None, None, None, 0, 1]
    for _ in range(pick.randint(1, 5)):
        pick.shuffle(now)
        n = pick.choice([2, 2, 3])
        into, cluster = sorted(now[:n]), next_id
        out = list(range(next_id + 1, next_id + 1 + pick.choice([2, n])))
        next_id += 1 + len(out)
        for i in into:
            rows[i][1] = cluster
        rows[cluster] = [cluster, *(out + [None] * 3)[:3], None, n]
        for i in out:
            rows[i] = [i, None, None, None, None, 1]
        for a, b in zip(out, pick.sample(into, len(into)), strict=False):
            if pick.random() < 0.7:
                pairs.append((a, b))
        now = now[n:] + out
    return [tuple(r) for r in rows.values()], pairs


def test_remaps_equal_a_loop_over_lines(spark):
    pick, rows, maps, want = random.Random(21), [], [], []
    for v in range(60):
        own, pairs = history(pick)
        if v % 10 == 0:
            pairs = []
        # names change as remaps are applied; later lines speak of the new ones
        names, told = {}, []
        for new, old in pairs:
            told.append((new, names.get(old, old)))
            names[new] = names.get(old, old)
        rows += [(v, *r) for r in own]
        maps += [(v, k, *p) for k, p in enumerate(told)]
        want += [f"{v}:{x}" for x in line_by_line(sorted(own), told)]
    frame = spark.createDataFrame(rows, "video int, id int, new1 int, new2 int, new3 int, origin int, bundle int").repartition(4)
    out = remaps.remapped_collisions(frame, spark.createDataFrame(maps, "video int, place int, new int, old int").repartition(3))
    text = lambda x: "" if x is None else str(x)
    assert sorted(f"{r.video}:" + ",".join(text(r[c]) for c in remaps.FIELDS) for r in out.collect()) == sorted(want)


def test_names_and_rows_that_are_missing():
    rows = [(1, 3, None, None, 0, 1), (2, 3, None, None, 0, 1), (3, 4, 5, None, None, 2), (4, None, None, None, None, 1), (5, None, None, None, None, 1)]
    out, names = remaps.through_collisions(rows, [(5, 1), (4, 2), (9, 8)])
    assert sorted(r[0] for r in out) == [1, 2] and names == {5: 1, 4: 2, 9: 8}
    three = [*rows[:2], (3, 4, 5, None, None, 3), *rows[3:]]
    out, names = remaps.through_collisions(three, [(5, 1)])
    assert sorted(r[0] for r in out) == [1, 2, 2] and names == {5: 1, 4: 2}
