"""Each stage of the corpus pipeline against brute force on a small table."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from motiontab.llm import mixing, quality
from test_linededup import tokens
from test_ngramjoin import brute as components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
BASE = {"de": "über die größe schöner häuser", "en": "why the key walks with him", "es": "el niño más pequeño corrió", "fr": "été où le garçon à l'école"}


def rows_of(texts, langs=None):
    return [(i, t, (langs or {}).get(i, "en"), f"s{i % 3}", len(t)) for i, t in texts]


@pytest.fixture
def stage(spark, tmp_path):
    def run(function, rows, labels=()):
        spark.createDataFrame(list(labels), "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        out = function(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
        return out.columns, sorted(out.collect())

    return run


def mixed(size=240, seed=1):
    """Three of five documents are English."""
    pick = random.Random(seed)
    langs = {i: ("en", "en", "en", "de", "es", "en", "en", "fr", "en", "de")[i % 10] for i in range(size)}
    texts = [(i, " ".join(pick.choice(BASE[langs[i]].split()) for _ in range(pick.randint(40, 120)))) for i in range(size)]
    return rows_of(texts, langs), [(i, 1) for i in range(size) if i % 4]


def test_quality_stage(spark, stage):
    pick = random.Random(2)
    texts = [" ".join(pick.choice(["on", "tie", "era", "estuary"]) for _ in range(40)) for _ in range(120)]
    rows = rows_of([(i, t.upper().replace(" ", "!! ") if i % 5 == 0 else t) for i, t in enumerate(texts)])
    labels = [(i, int(i % 5 > 0)) for i in range(0, 120, 2)]
    columns, got = stage(corpus_pipeline.quality_stage, rows, labels)
    model = quality.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"))
    score = model.combined(quality.text_view([r[1] for r in rows]), model.metadata_view([r[2] for r in rows], [r[3] for r in rows], [len(r[1]) for r in rows]))
    assert columns == list(corpus_pipeline.COLUMNS)
    assert [tuple(r) for r in got] == [r for r, s in zip(rows, score, strict=True) if s >= quality.REJECT_BELOW]
    assert {r.doc_id for r in got} == {i for i in range(120) if i % 5}


def test_line_stage(stage):
    rows = rows_of([(1, "a b c d e\nf g h"), (2, "A b c d e"), (3, "new line here\na b c d e"), (4, ""), (5, "f g h\n\nF g h"), (6, "q r s t u v w x y z\nq r s t u v w x y k")])
    _, got = stage(corpus_pipeline.line_stage, rows)
    seen, want = [], []
    for i, text, lang, source, n in rows:
        kept, lines = [], [tokens(t) for t in text.split("\n")]
        for line, t in zip(text.split("\n"), lines, strict=True):
            if t and any(100 * len(t & s) >= 80 * len(t | s) for s in seen):
                continue
            seen += [t] if t else []
            kept.append(line)
        if any(map(tokens, kept)) or not any(lines):
            out = "\n".join(kept)
            want.append((i, out, lang, source, n if out == text else len(out)))
    assert [tuple(r) for r in got] == want and [r[0] for r in want] == [1, 3, 4, 6]


def test_near_duplicate_stage(stage):
    pick = random.Random(4)
    texts = [[f"w{pick.randrange(50)}" for _ in range(60)] for _ in range(20)]
    texts += [[*t[:59], "end"] for t in texts[:8]] + texts[8:12]
    rows = rows_of([((i * 7) % 32, " ".join(t)) for i, t in enumerate(texts)])
    _, got = stage(corpus_pipeline.near_duplicate_stage, rows)
    keep = {i for _, i, _, least in components([r[:2] for r in rows], 5, 80) if i == least}
    assert [tuple(r) for r in got] == sorted(r for r in rows if r[0] in keep) and len(keep) == 20


def test_mixing_stage_keeps_all_and_meets_the_weights(spark, stage):
    rows, labels = mixed()
    _, got = stage(corpus_pipeline.mixing_stage, rows, labels)
    copies, size = Counter(r.doc_id for r in got), {r[0]: max(1, -(-len(r[1].encode()) // 4)) for r in rows}
    assert {tuple(r) for r in got} == set(rows) and set(copies) == {r[0] for r in rows}
    total = sum(size[i] * c for i, c in copies.items())
    for lang, weight in corpus_pipeline.TARGETS.items():
        assert abs(sum(size[r[0]] * copies[r[0]] for r in rows if r[2] == lang) / total - weight) < 0.03
    assert np.mean([copies[r[0]] for r in rows if r[2] == "en"]) < 1.05


def test_least_rate_needs_positive_targets(spark):
    docs, labels = spark.createDataFrame(mixed(10)[0], SCHEMA), spark.createDataFrame([], "doc_id long, domain string")
    for targets, least in (({"en": 1.0, "fr": 0.0}, 1.0), ({"en": 1.0}, 2.0)):
        with pytest.raises(ValueError):
            mixing.fit(docs, labels, targets, least=least)


def test_packing_stage_and_run(spark, stage, tmp_path):
    from test_packing import pieces_hold

    rows, labels = mixed(40)
    _, got = stage(corpus_pipeline.packing_stage, rows, labels)
    pieces_hold([r[:2] for r in rows], got, 4096)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, str(tmp_path))
    totals = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert totals(corpus_pipeline.run(spark, str(tmp_path))) == totals(docs)


def odd_documents(spark):
    text = "the quick line of words that says a thing about the other line\n" * 3
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (None, "some words that stand alone here and say nothing else at all", "en", "src1", 60), (3, text, "en", "src1", 200), (3, text, "en", "src1", 200), (4, "wort und " * 20_000, "de", "src2", 180_000), (5, " \n\t\n ", "fr", "src3", 5)]
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rate string, line double")


def test_stages_on_odd_rows_and_extra_columns(spark):
    """What the docstrings say of nulls, empty, blank and long texts, equal rows, rows without an id and other columns."""
    docs = odd_documents(spark)
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, docs, DATA)
        assert tuple(df.columns) == corpus_pipeline.COLUMNS
        out[name] = [(r.doc_id, r.text) for r in df.collect()]
    ids = lambda name: sorted((i is None, i or 0) for i, _ in out[name])
    count = lambda name, i: sum(d == i for d, _ in out[name])
    assert count("quality classifier", 3) in (0, 2) and all(count("quality classifier", i) <= 1 for i in (1, 2, 4, 5, None))
    assert (count("line dedup", 1), count("line dedup", 2), count("line dedup", 5), count("line dedup", 3)) == (1, 1, 1, 1)
    assert [t.count("\n") for i, t in out["line dedup"] if i == 3] != [3]
    assert ids("n-gram Jaccard join") == [(False, 1), (False, 2), (False, 3), (False, 3), (False, 4), (False, 5), (True, 0)]
    copies = {i: count("source mixing", i) for i in (1, 2, 3, 4, 5, None)}
    assert all(1 <= n <= corpus_pipeline.MOST_COPIES for i, n in copies.items() if i != 3) and copies[3] % 2 == 0 and 2 <= copies[3] <= 2 * corpus_pipeline.MOST_COPIES
    pieces = corpus_pipeline.packing_stage(spark, docs, DATA).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, None} and sum(r.doc_tokens == 1 for r in pieces) == 3 and max(r.length for r in pieces) <= 4096


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents(spark).where("false"), DATA).count() == 0
