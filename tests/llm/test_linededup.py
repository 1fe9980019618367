import random
import time
from pathlib import Path

import pytest
from motiontab.llm import linededup
from motiontab.llm.common import folder
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, k string, n_lines string, kept int"
SPACE = " \t\x0b\f\r"


def tokens(line):
    for c in SPACE:
        line = line.replace(c, " ")
    return frozenset(w for w in line.lower().split(" ") if w)


def brute(spark, rows, percent):
    """Rows in the order of (id, content hash); equal rows: one keeps its lines."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.xxhash64("doc_id", "text"))
    order = [(r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in df.collect()]
    seen, out = [], []
    for _, i, _, text in sorted(order, key=lambda r: r[:3]):
        if text is None:
            out.append((i, None, 0, 0))
            continue
        kept, lines, gone = [], 0, 0
        for line in text.split("\n"):
            t = tokens(line)
            if t:
                lines += 1
                match = any(100 * len(t & s) >= percent * len(t | s) for s in seen)
                seen.append(t)
                if match:
                    gone += 1
                    continue
            kept.append(line)
        out.append((i, "\n".join(kept), lines, gone))
    return sorted(out, key=str)


def run(spark, rows, percent=80):
    df = spark.createDataFrame(rows, SCHEMA)
    out = linededup.dedup_lines(df, percent)
    assert out.columns == ["doc_id", "text", "k", "kept", "n_lines", "n_removed"]
    return sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)


def rows_of(pairs):
    return [(i, t, "clash", "x", 7) for i, t in pairs]


@pytest.mark.parametrize("bounds", [{}, {"MOST": 8, "LONG": 6, "RARE": 3, "COUNTERS": 10}, {"LONG": 5, "RARE": 1, "COUNTERS": 14}, {"MOST": 6, "LONG": 4, "RARE": 0, "COUNTERS": 8}, {"LONG": 3, "RARE": 4, "COUNTERS": 14}])
def test_equals_brute_force(spark, monkeypatch, bounds):
    """With the operator's own bounds, and with small ones: words as pairs, long sets by shared words, full counters."""
    for name, value in bounds.items():
        monkeypatch.setattr(linededup, name, value)
    pick = random.Random(2)
    vocabulary = [f"w{min(k, int(pick.expovariate(0.05)))}" for k in range(200)]
    lines = []
    for _ in range(150):
        if lines and pick.random() < 0.5:
            line = list(pick.choice(lines))
            for _ in range(pick.randint(0, 2)):
                line[pick.randrange(len(line))] = pick.choice(vocabulary)
        else:
            line = [pick.choice(vocabulary) for _ in range(pick.randint(1, 22))]
        lines.append(line)
    texts = ["\n".join(pick.choice([" ", "\t", "  "]).join(w.upper() if pick.random() < 0.1 else w for w in pick.choice(lines)) for _ in range(pick.randint(1, 9))) for _ in range(60)]
    pairs = [(k * 7 % 61, t) for k, t in enumerate(texts)]
    pairs += [(None, "w1 w2"), (100, None), (101, ""), (102, "\n \n\t"), (103, "w1  w2\n\nW2 w1"), (104, "long " * 4000 + "\nend of it"), pairs[5], pairs[5], (pairs[6][0], "other text w3")]
    rows = rows_of(pairs)
    assert run(spark, rows) == brute(spark, rows, 80)
    if bounds:
        assert run(spark, rows, 60) == brute(spark, rows, 60)


def test_a_hot_word_and_many_variants_of_one_line(spark, monkeypatch):
    monkeypatch.setattr(linededup, "COUNTERS", 12)
    monkeypatch.setattr(linededup, "RARE", 4)
    base = [f"b{k}" for k in range(18)]
    texts = [" ".join([*base, f"x{k}", f"y{k}"]) for k in range(90)]  # 18 of 22 words are common to any two
    texts += [f"hot u{k} v{k} z{k}" for k in range(90)]
    rows = rows_of([(k * 7 % 180, t) for k, t in enumerate(texts)])
    got = run(spark, rows)
    assert got == brute(spark, rows, 80) and sum(r[3] for r in got) == 89


def test_empty_table_and_plan_without_python(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame(rows_of([(1, "a b c")]), SCHEMA)
    plan = linededup.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_meet_once_or_twice_at_frequent_pairs(spark, monkeypatch):
    """Lines that nearly match meet at few of the pairs of frequent words that they share, and match as by brute force."""
    for name, value in {"COUNTERS": 12, "RARE": 2, "HALVES": 10}.items():
        monkeypatch.setattr(linededup, name, value)
    pick = random.Random(3)
    base = [f"w{k}" for k in range(48)]
    lines = [" ".join(sorted({f"v{pick.randrange(12)}" if pick.random() < 0.1 else w for w in base})) for _ in range(60)]
    met, cut = [], linededup.cut

    def counted(df):
        df = cut(df)
        if "c" in df.columns:
            met.append(df.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first())
        return df

    monkeypatch.setattr(linededup, "cut", counted)
    rows = rows_of(enumerate(lines))
    assert run(spark, rows, 92) == brute(spark, rows, 92)
    pairs, times = met[-1]
    assert len(met) == 2 and 0 < pairs and times <= 2 * pairs


def test_matched_sets_leave_before_their_keys_are_made(spark, monkeypatch):
    """What is joined to the matched lines has a row for each set, not one for each pair of its frequent words."""
    for name, value in {"COUNTERS": 12, "RARE": 2}.items():
        monkeypatch.setattr(linededup, name, value)
    pick = random.Random(4)
    lines = [" ".join(f"w{k}" for k in pick.sample(range(40), 24)) for _ in range(20)]
    kind, sizes = type(spark.range(0)), []
    join = kind.join

    def counted(self, other, on=None, how=None):
        if how in ("left", "left_anti") and {"key", "prefix"} & {*self.columns}:
            sizes.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", counted)
    rows = rows_of(enumerate(lines))
    assert run(spark, rows) == brute(spark, rows, 80)
    assert sizes and max(sizes) <= len(lines)


def test_disk_of_many_keys_and_of_candidates(spark, monkeypatch, tmp_path):
    """Keys in slices, and text shuffled of candidates alone, match as by brute force; shuffles and tables go as they are done with."""
    for name, value in {"COUNTERS": 12, "RARE": 2, "SLICE": 2, "LEAST_ROWS": 1, "BROADCAST_ROWS": 0}.items():
        monkeypatch.setattr(linededup, name, value)
    pick = random.Random(5)
    lines = [" ".join(f"w{k}" for k in pick.sample(range(40), 9)) for _ in range(20)]
    lines += [f"{line} more" for line in lines[:6]] + [" ".join(f"alone{n} {k}x{n}" for n in range(6)) for k in range(150)]
    kind, sizes = type(spark.range(0)), []
    join = kind.join

    def counted(self, other, on=None, how=None):
        if "line" in self.columns and "mark_at" not in other.columns and other.count():  # lines with their text
            sizes.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", counted)
    place = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    bytes_of = lambda known=(): {x: x.stat().st_size for top in place for x in Path(top).glob("*/shuffle_*.data") if x not in known}
    tables = lambda: {*Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("table-*")}
    rows = rows_of(enumerate(lines))
    docs = spark.createDataFrame(rows, SCHEMA)
    folder(spark)
    there, known = tables(), bytes_of()
    out = linededup.dedup_lines(docs)
    time.sleep(2)  # files go in the background
    left = sum(bytes_of(known).values())  # of counts
    assert left < 10_000 and len(tables() - there) == 1
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert got == brute(spark, rows, 80) and sum(r[3] for r in got) >= 6
    assert sizes and max(sizes) <= 60
