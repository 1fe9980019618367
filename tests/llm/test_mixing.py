import numpy as np
import pytest
from motiontab.llm import mixing
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, rate string, x string, n int"
TARGETS = {"de": 1.0, "en": 2.0, "fr": 1.0}


def corpus():
    base = {"de": "über die größe schöner häuser ", "en": "why the key walks with him ", "fr": "été où le garçon à l'école "}
    rows, labels = [], []
    for i in range(120):
        d = ("en", "en", "en", "de", "fr", "en")[i % 6]
        rows.append((i, base[d] * (1 + i % 5) + "word " * (i % 7), "clash", "x", 1))
        if i % 4:
            labels.append((i, d))
    return rows + [(None, None, "c", "x", 1), (500, "", "c", "x", 1), (501, "é" * 100_000, "c", "x", 1), rows[3], rows[3]], labels + [(5, None), (6, "xx"), (9999, "de")]


def fitted(spark, rows, labels, rounds=200):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, mixing.fit(docs, spark.createDataFrame(labels, "doc_id long, domain string"), TARGETS, rounds)


def test_equals_numpy_and_meets_targets(spark):
    rows, labels = corpus()
    docs, mixture = fitted(spark, rows, labels)
    out = mixture.apply(docs)
    assert out.columns == ["doc_id", "text", "x", "n", "posterior", "n_tokens", "rate"]
    got = out.collect()
    assert len(got) == len(rows)

    words = sorted({w for r in got for w in (r.text or "").lower().split()})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.hash("w").bitwiseAND(F.lit(mixing.BUCKETS - 1)).alias("b")).collect()}
    texts = [[bucket[w] for w in (r.text or "").lower().split()] for r in got]
    n = np.array([max(1, -(-len((r.text or "").encode()) // 4)) for r in got], float)
    seen = [(t, d) for r, t in zip(got, texts, strict=True) for i, d in labels if r.doc_id == i and d in TARGETS]
    logs = []
    for d in sorted(TARGETS):
        own = [t for t, e in seen if e == d]
        counts = np.bincount(np.concatenate(own), minlength=mixing.BUCKETS) + mixing.ADDED
        log = np.log(counts / counts.sum())
        logs.append([np.log((len(own) + 1) / (len(seen) + 3)) + log[t].sum() * min(1, mixing.EFFECTIVE / max(1, len(t))) for t in texts])
    logs = np.array(logs)
    odds = np.exp(logs.T - logs.max(axis=0)[:, None]) + mixing.LEAST
    p = odds / odds.sum(axis=1, keepdims=True)
    assert np.allclose(p, [r.posterior for r in got], atol=1e-6)
    r, wanted = np.ones(len(n)), np.array([0.25, 0.5, 0.25]) * n.sum()
    bound = np.maximum(1e-12, (p.T @ (p * n[:, None])).sum(axis=1) / n.sum())
    for _ in range(len(mixture.steps)):
        r = np.maximum(0, r - p @ ((p.T @ (n * r) - wanted) / n.sum() / bound))
    assert np.allclose(r, [v.rate for v in got], atol=1e-6)
    assert np.allclose(p.T @ (n * r), wanted, rtol=1e-2)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert abs(mixture.residual - np.abs((p.T @ (n * r) - wanted) / n.sum()).max()) < 1e-6


def test_copies_have_the_rate_as_mean(spark):
    df = spark.range(20000).withColumn("c", mixing.copies(F.lit(1.3), "id"))
    assert abs(df.agg(F.avg("c")).first()[0] - 1.3) < 0.02 and df.select("c").distinct().count() == 2


def test_without_labels_or_documents(spark):
    docs, mixture = fitted(spark, [], [])
    assert mixture.apply(docs).count() == 0
    with pytest.warns(UserWarning, match="away from its target"):
        docs, mixture = fitted(spark, [(1, "a b", "", "", 0)], [], 5)
    assert mixture.apply(docs).first().rate >= 0 and mixture.residual > mixing.RESIDUAL


def test_greatest_rate_bounds_copies(spark):
    """A rare domain cannot be copied without end; the fit says how far it stays from its target."""
    rows, labels = corpus()
    rows = [r for r in rows if r[0] is None or r[0] % 6 not in (3, 4) or r[0] == 3]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (3, "de")], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="away from its target"):
        mixture = mixing.fit(docs, known, TARGETS, least=1.0, most=4.0)
    rates = [r.rate for r in mixture.apply(docs).collect()]
    assert max(rates) == 4.0 and min(rates) >= 1.0 and mixture.residual > mixing.RESIDUAL
    with pytest.raises(ValueError):
        mixing.fit(docs, known, TARGETS, most=0.5)
