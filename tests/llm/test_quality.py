import random

import numpy as np
from motiontab.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, accepted string, quality_score int"


def corpus(size, seed=3):
    pick = random.Random(seed)
    rows, labels = [], []
    for i in range(size):
        words = ["".join(pick.choice(["on", "ti", "er", "es", "the"]) for _ in range(pick.randint(1, 3))) for _ in range(pick.randint(3, 60))]
        good = pick.random() < 0.8
        if not good:
            kind = pick.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w for w in words for _ in range(3)] if kind == 1 else [f"{w}%%%" for w in words]
        source = f"s{pick.randrange(5)}" if good else f"s{pick.randrange(3, 8)}"
        rows.append((i, " ".join(words) + ".", pick.choice(["en", "fr"]), source, "clash", 1))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels, {r[0]: r for r in rows}


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels, _ = corpus(500)
    truth = dict(labels)
    learned = [(i, q) for i, q in labels if i % 4 == 1] + [(None, 1), (1, None), (99_999, 0), labels[0], labels[0]]
    odd = [(None, None, None, None, "c", 1), (600, "", "en", "s1", "c", 1), (601, "x" * 200_000, None, "new", "c", 1), rows[4], rows[4]]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    model = quality.fit(docs, spark.createDataFrame(learned, "doc_id long, quality int"), rounds=3)
    out = model.apply(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "quality_score", "accepted"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.quality_score <= 1 and r.accepted == (r.quality_score >= quality.REJECT_BELOW) for r in got)
    held = [(r.accepted, truth[r.doc_id] == 1) for r in got if r.doc_id in truth and r.doc_id % 4 == 3]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def newton(x, y, weight, steps=40):
    """Ridge logistic regression on standardised columns, one row of the normal equations at a time."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.full(z.shape[1], 1.0)
    ridge[0] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        h, g = np.diag(ridge), -ridge * w
        for row, t, s in zip(z, y, weight, strict=True):
            p = 1 / (1 + np.exp(-row @ w))
            h, g = h + s * p * (1 - p) * np.outer(row, row), g + s * (t - p) * row
        w = w + np.linalg.solve(h, g)
    return lambda v: w[0] + (np.asarray(v) - mean) / scale @ w[1:]


def loop(texts, langs, sources, labels, rounds):
    """The co-training on a small table, row by row; every sure row is lent."""
    ids = sorted(labels)
    y = np.array([float(labels[i]) for i in ids])
    turn = np.arange(len(ids)) % 8
    tune, mix = turn == 3, turn == 7
    learn = ~(tune | mix)

    def odds(values):
        prior, out = y[learn].mean(), {}
        for key in set(values[i] for i, m in zip(ids, learn, strict=True) if m):
            own = [labels[i] for i, m in zip(ids, learn, strict=True) if m and values[i] == key]
            out[key] = np.log((sum(own) + 5 * prior) / (len(own) - sum(own) + 5 * (1 - prior))) - np.log(prior / (1 - prior))
        return out

    tables = odds(langs), odds(sources)
    views = [quality.text_view([texts[i] for i in range(len(texts))]), np.array([[tables[0].get(langs[i], 0), tables[1].get(sources[i], 0), np.log1p(len(texts[i] or ""))] for i in range(len(texts))])]
    rest = [i for i in range(len(texts)) if i not in labels]
    lent = [([], []), ([], [])]
    for k in range(rounds + 1):
        fits = []
        for v in (0, 1):
            rows = [i for i, m in zip(ids, learn, strict=True) if m] + lent[v][0]
            weight = [1.0] * int(learn.sum()) + [0.5] * len(lent[v][0])
            fits.append(newton(views[v][rows], np.concatenate([y[learn], lent[v][1]]), weight))
        if k == rounds:
            break
        sure = np.log(quality.SURE / (1 - quality.SURE))
        for v in (0, 1):
            score = {i: fits[v](views[v][i]) for i in rest}
            taken = [i for i in rest if abs(score[i]) >= sure]
            lent[1 - v] = taken, [float(score[i] > 0) for i in taken]
    own = [np.array([fits[v](views[v][i]) for i in ids])[:, None] for v in (0, 1)]
    single = [newton(x[tune], y[tune], np.ones(tune.sum())) for x in own]
    both = np.column_stack([s(x) for s, x in zip(single, own, strict=True)])
    last = newton(both[mix], y[mix], np.ones(mix.sum()))
    scores = np.column_stack([single[v](np.array([fits[v](views[v][i]) for i in range(len(texts))])[:, None]) for v in (0, 1)])
    return 1 / (1 + np.exp(-last(scores))), sum(len(x) for x, _ in lent)


def test_equals_a_loop_over_rows(spark):
    rows, _, _ = corpus(70, 5)
    rows = [(i, None if i == 9 else text, lang if i % 11 else None, source, *rest) for i, text, lang, source, *rest in rows]
    labels = {i: int("!!" not in (t or "") and "%%%" not in (t or "") and len(set((t or "").split())) > 0.5 * len((t or "x").split())) for i, t, *_ in rows if i % 10 < 7}
    docs = spark.createDataFrame(rows, SCHEMA)
    model = quality.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), rounds=2)
    got = {r.doc_id: r.quality_score for r in model.apply(docs).collect()}
    want, n = loop([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], labels, 2)
    assert n > 0
    np.testing.assert_allclose([got[i] for i in range(70)], want, atol=1e-5)


def test_what_is_lent_is_bounded(spark, monkeypatch):
    rows, labels, _ = corpus(300)
    seen = []
    real = quality.Logistic.fit.__func__
    monkeypatch.setattr(quality.Logistic, "fit", classmethod(lambda cls, x, y, *a, **k: seen.append(len(x)) or real(cls, x, y, *a, **k)))
    quality.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), lend=2, rounds=2)
    assert seen[0] == seen[1] < seen[2] <= seen[0] + 2 * 8  # about two of either label in the first round


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame(corpus(20)[0], SCHEMA)
    for labels, score in (([], 0.5), ([(1, 1), (3, 1)], 1.0)):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.quality_score for r in model.apply(docs).collect()} == {score}
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.fit(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).apply(empty).count() == 0


def test_text_view_is_of_whole_texts():
    x = quality.text_view(["ab! " * 5, None, "a a b"])
    assert np.isclose(x[0, 0], np.sqrt(5 / 20)) and np.isclose(x[2, -3], 1 / 3) and not x[1].any()


def test_repeats_after_the_first_window_count():
    head = [f"w{i}" for i in range(2000)]
    varied, tail = [f"v{i}" for i in range(6500)], ["buy", "cheap", "pills", "now"] * 1625
    x = quality.text_view([" ".join(head), " ".join(head + varied), " ".join(head + tail)])
    assert np.isclose(x[0, -1], 1) and np.isclose(x[1, -1], 1)
    assert np.isclose(x[2, -1], (2000 + 4 * 4) / 8500)  # windows 2000, 2000, 2000, 2000 and 500


def test_scores_do_not_depend_on_how_rows_are_dealt_out(spark):
    """Ids with two texts, one good and one bad: the same row is fitted on at every partitioning."""
    rows, labels, _ = corpus(240)
    again = [(i, rows[(i + 7) % 240][1], *r[2:]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows + again, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    seen = []
    for parts in (1, 3, 7):
        dealt = docs.repartition(parts, "text")
        out = quality.fit(dealt, known).apply(dealt)
        seen.append(sorted((r.doc_id, r.text, round(r.quality_score, 12)) for r in out.collect()))
    assert seen[0] == seen[1] == seen[2]
