"""Models on planted tables."""

import math
import random

import numpy as np
import pytest
from motiontab.operators import learning, stats
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import functions as F

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """Two groups that a and b tell apart; c is noise."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(160):
        g = k % 2
        rows.append((k, "uv"[g], *map(float, rng.normal([4.0 * g, -6.0 * g, 0.0], [0.5, 0.7, 1.0]))))
    rows.append((999, "u", None, 1.0, 1.0))
    return spark.createDataFrame(rows, "id int, label string, a double, b double, c double").cache()


def test_components_equal_numpy(planted):
    scores, loadings, shares = learning.principal_components(planted, NAMES, 2, ["id"])
    x = np.array([[r.a, r.b, r.c] for r in planted.orderBy("id").collect() if r.a is not None])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(-values)
    assert np.allclose(shares, values[order][:2] / values.sum())
    for k in range(2):
        v = vectors[:, order[k]]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        assert np.allclose(loadings[k], v, atol=1e-9)
        assert np.allclose([r[f"pc{k + 1}"] for r in scores.orderBy("id").collect()], z @ v, atol=1e-9)
    one, weights, share = learning.shape_score(planted, NAMES, ["id"])
    assert np.allclose(weights, loadings[0]) and np.isclose(share, shares[0]) and one.columns == ["id", "shape_pc1"]


def test_clusters_and_mixtures_find_the_groups(planted):
    truth = {r.id: r.label for r in planted.collect()}
    found, silhouette = learning.clusters(planted, NAMES[:2], 2, ["id"])
    sides = {(truth[r.id], r.cluster) for r in found.collect()}
    assert len(sides) == 2 and silhouette > 0.7 and found.count() == 160
    found, k = learning.mixture(planted, NAMES[:2], (2, 3), ["id"])
    assert k == 2 and len({(truth[r.id], r.component) for r in found.collect()}) == 2


def test_mixture_steps_over_distinct_rows_as_spark_ml_over_all(spark, monkeypatch):
    pick = random.Random(5)
    rows = [(k, float(round(pick.gauss(c, 1.5))), float(round(pick.gauss(-c, 1.0)))) for k, c in enumerate([0, 4, 4, 9] * 150)] + [(999, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double").repartition(3)
    different, steps = [], learning._fitted
    monkeypatch.setattr(learning, "_fitted", lambda counts, *rest: different.append(counts.count()) or steps(counts, *rest))
    monkeypatch.setattr(learning, "TASK_ROWS", 40)
    found, k = learning.mixture(df, ["a", "b"], (2, 3), ["id"])
    assert different == [len({r[1:] for r in rows if r[1] is not None})]
    z = learning.standardised(df, ["a", "b"], ["id"]).localCheckpoint()
    fits = {n: GaussianMixture(k=n, seed=7, featuresCol="z", predictionCol="component").fit(z) for n in (2, 3)}
    bic = {n: (6 * n - 1) * math.log(600) - 2 * m.summary.logLikelihood for n, m in fits.items()}
    assert k == min(bic, key=bic.get)
    assert {r.id: r.component for r in found.collect()} == {r.id: r.component for r in fits[k].transform(z).collect()}


def test_forest_finds_what_matters(planted):
    predictions, importance, accuracy = learning.forest(planted, NAMES, "label", trees=8, folds=2, seeds=(1,))
    order = [r.variable for r in importance.collect()]
    assert order[-1] == "c" and accuracy[0] > 0.95 and len(accuracy) == 1
    table = learning.confusion(predictions).collect()
    assert sum(r.n for r in table) == 161 and sum(r.n for r in table if r.label == r.prediction) >= 159


def test_balanced_classes(spark):
    pick = random.Random(2)
    rows = [(c, pick.randrange(40)) for c, n in (("x", 7), ("y", 23), ("z", 50)) for _ in range(n)] + [(None, k) for k in range(3)]
    df = spark.createDataFrame(rows, "label string, v int").repartition(3)
    whole = {c: sorted(v for k, v in rows if k == c) for c in ("x", "y", "z")}
    for way, goal in (("up", 50), ("down", 3)):
        out = learning.balanced(df if way == "down" else df.where("label IS NOT NULL"), "label", way)
        again = learning.balanced(df.repartition(5) if way == "down" else df.where("label IS NOT NULL").coalesce(1), "label", way)
        got = {c: sorted(r.v for r in out.where(F.col("label") == c).collect()) for c in whole}
        assert all(len(v) == goal for v in got.values()) and sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
        for c, v in got.items():
            times = [v.count(x) / whole[c].count(x) for x in set(whole[c])]
            assert set(v) <= set(whole[c]) and (way == "down" or min(times) >= goal // len(whole[c]))


def test_ranks_over_partitions(spark):
    """Ranks by ranges equal a sort of the whole column, ties and hot values included."""
    pick = random.Random(3)
    rows = [(k % 3, float(pick.choice([1, 1, 1, 2, 3, pick.randrange(500)]))) for k in range(900)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    counts = df.groupBy("k", "v").agg(F.count("*").alias("c"))
    for r in stats.running_below(counts, ["k"], "v", "c").collect():
        assert r.below == sum(1 for k, v in rows if k == r.k and v < r.v)
    everything = counts.groupBy("v").agg(F.sum("c").alias("c"))
    for r in stats.running_below(everything, [], "v", "c").collect():
        assert r.below == sum(1 for _, v in rows if v < r.v)
    for r in stats.quantiles(df, "v", ["k"], (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)).collect():
        assert np.allclose(r.q, np.quantile([v for k, v in rows if k == r.k], (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)))


def test_mahalanobis_distance(spark):
    rng = np.random.default_rng(5)
    track = [(1, k, *map(float, rng.normal(size=3))) for k in range(14)] + [(2, k, 1.0, 1.0, 1.0) for k in range(5)]
    new = [(1, *map(float, rng.normal(size=3))), (2, 1.0, 2.0, 3.0), (3, 1.0, 2.0, 3.0), (1, None, 1.0, 1.0)]
    out = stats.mahalanobis(spark.createDataFrame(new, "id int, a double, b double, c double"), spark.createDataFrame(track, "id int, frame int, a double, b double, c double"), NAMES)
    last = np.array([t[2:] for t in track[4:14]])
    d = np.array(new[0][1:]) - last.mean(axis=0)
    got = {(r.id, r.a): r.distance for r in out.collect()}
    assert np.isclose(got[1, new[0][1]], np.sqrt(d @ np.linalg.inv(np.cov(last.T)) @ d))
    assert got[2, 1.0] is None and got[3, 1.0] is None and got[1, None] is None
