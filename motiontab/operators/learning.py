"""Components, clusters and classifiers over summary tables, by Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motiontab.operators import stats
from motiontab.operators.saving import saved


def standardised(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Complete rows with a vector ``z`` of the variables at mean 0 and variance 1."""
    rows = df.select(*keys, *[F.col(v).cast("double") for v in variables]).dropna(subset=list(variables))
    rows = VectorAssembler(inputCols=list(variables), outputCol="x").transform(rows)
    return StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(rows).transform(rows)


def principal_components(df: DataFrame, variables: Sequence[str], k: int, keys: Sequence[str] = ()) -> tuple[DataFrame, list[list[float]], list[float]]:
    """(scores pc1..pck with keys, loadings by component, explained shares). The largest loading of each is positive."""
    rows = standardised(df, variables, keys)
    model = PCA(k=k, inputCol="z", outputCol="pc").fit(rows)
    matrix = model.pc.toArray()
    signs = [1.0 if max(column, key=abs) >= 0 else -1.0 for column in matrix.T]
    scores = model.transform(rows).withColumn("_pc", vector_to_array("pc"))
    scores = scores.select(*keys, *[(F.col("_pc")[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])
    return scores, [[float(v * s) for v in column] for column, s in zip(matrix.T, signs, strict=True)], [float(v) for v in model.explainedVariance]


SHAPE = ("area", "spine_length", "width", "perimeter")


def shape_score(df: DataFrame, variables: Sequence[str] = SHAPE, keys: Sequence[str] = ("id", "frame")) -> tuple[DataFrame, list[float], float]:
    """(keys and shape_pc1, loadings, explained share): the first component of standardised shape features of every frame."""
    scores, loadings, shares = principal_components(df, variables, 1, keys)
    return scores.withColumnRenamed("pc1", "shape_pc1"), loadings[0], shares[0]


def clusters(df: DataFrame, variables: Sequence[str], k: int, keys: Sequence[str] = (), seed: int = 7) -> tuple[DataFrame, float]:
    """(keys and cluster, silhouette) of complete, standardised rows."""
    rows = standardised(df, variables, keys)
    found = KMeans(k=k, seed=seed, featuresCol="z", predictionCol="cluster").fit(rows).transform(rows)
    return found.select(*keys, "cluster"), ClusteringEvaluator(featuresCol="z", predictionCol="cluster").evaluate(found)


#: Distinct rows of a task of the mixture's steps, at least.
TASK_ROWS = 100_000
_EPSILON = float(np.finfo(float).eps)


def _whitened(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """(root of the pseudo-inverse, constant term of the log density), as Spark ML has them."""
    values, vectors = np.linalg.eigh(cov)
    large = values > _EPSILON * values.max() * len(values)
    if not large.any():
        raise ValueError("Covariance matrix has no non-zero singular values")
    root = np.where(large, 1 / np.sqrt(np.where(large, values, 1.0)), 0.0)[:, None] * vectors.T
    return root, -0.5 * (len(values) * math.log(2 * math.pi) + np.log(values[large]).sum())


def _weighted_densities(x: np.ndarray, parts: list) -> np.ndarray:
    """weight * density of each component (weight, mean, root, constant) at rows x, as Spark ML has it."""
    return np.stack([_EPSILON + weight * np.exp(const - 0.5 * (((x - mean) @ root.T) ** 2).sum(1)) for weight, mean, root, const in parts], 1)


def _moments(x: np.ndarray, n: np.ndarray, parts: list) -> np.ndarray:
    """Log likelihood of rows x that occur n times, then by component the sums of shares, of vectors and of their products."""
    p = _weighted_densities(x, parts)
    total = p.sum(1)
    p *= (n / total)[:, None]
    found = [np.array([np.log(total) @ n])]
    for k in range(p.shape[1]):
        found += [p[:, k].sum()[None], p[:, k] @ x, ((x * p[:, [k]]).T @ x).ravel()]
    return np.concatenate(found)


def _fitted(counts: DataFrame, z: list[str], starts: dict[int, list], tol: float, most: int) -> dict[int, tuple[list, float]]:
    """By number of components (weight, mean, covariance) of each, and the log likelihood before the last step, by expectation
    maximisation over rows z that occur n times. All fits share a pass; a task returns a row of sums for each fit."""
    d = len(z)
    models = {k: (parts, -math.inf) for k, parts in starts.items()}
    live = set(models)
    for _ in range(most):
        ready = {k: [(w, m, *_whitened(c)) for w, m, c in models[k][0]] for k in sorted(live)}

        def sums(frames, ready=ready):
            found = dict.fromkeys(ready, 0.0)
            for f in frames:
                x, n = f[z].to_numpy(), f["n"].to_numpy(dtype=float)
                for k in ready:
                    found[k] = found[k] + _moments(x, n, ready[k])
            yield pd.DataFrame({"k": list(found), "s": [v.tolist() if isinstance(v, np.ndarray) else [] for v in found.values()]})

        rows = sorted((r.k, r.s) for r in counts.mapInPandas(sums, "k int, s array<double>").where("size(s) > 0").collect())
        for k in sorted(live):
            s = np.array([v for at, v in rows if at == k]).sum(0)
            by = s[1:].reshape(k, 1 + d + d * d)
            weights, means = by[:, 0] / by[:, 0].sum(), by[:, 1 : 1 + d] / by[:, :1]
            covs = by[:, 1 + d :].reshape(k, d, d) / by[:, 0, None, None] - means[:, :, None] * means[:, None, :]
            if abs(s[0] - models[k][1]) <= tol:
                live.discard(k)
            models[k] = ([*zip(weights, means, covs, strict=True)], float(s[0]))
        if not live:
            break
    return models


def mixture(df: DataFrame, variables: Sequence[str], sizes: Sequence[int], keys: Sequence[str] = (), seed: int = 7, tol: float = 0.01, most: int = 100) -> tuple[DataFrame, int]:
    """(keys and component, number of components) of the Gaussian mixture with the least BIC.

    Spark ML draws where each fit starts, from all rows; the steps are those of its GaussianMixture, over distinct rows with their counts.
    """
    rows = saved(standardised(df, variables, keys))
    z = [f"z{i}" for i in range(len(variables))]
    rows_z = rows.withColumn("_z", vector_to_array("z"))
    rows_z = rows_z.select(*keys, *[F.col("_z")[i].alias(c) for i, c in enumerate(z)])
    counts = rows_z.groupBy(*z).agg(F.count("*").alias("n")).persist()
    different, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    d = len(variables)
    starts = {}
    for k in sizes:
        model = GaussianMixture(k=k, seed=seed, maxIter=0, featuresCol="z", predictionCol="component").fit(rows)
        starts[k] = [(w, g.mean.toArray(), g.cov.toArray()) for w, g in zip(model.weights, model.gaussiansDF.collect(), strict=True)]
    models = _fitted(counts.coalesce(1 + different // TASK_ROWS), z, starts, tol, most)
    counts.unpersist()
    free = lambda k: k - 1 + k * d + k * d * (d + 1) / 2
    best = min(sizes, key=lambda k: free(k) * math.log(max(1, n)) - 2 * models[k][1])
    parts = [(w, m, *_whitened(c)) for w, m, c in models[best][0]]

    @F.pandas_udf("int")
    def component(*columns: pd.Series) -> pd.Series:
        return pd.Series(_weighted_densities(np.column_stack(columns), parts).argmax(1))

    return rows_z.select(*keys, component(*z).alias("component")), best


def balanced(df: DataFrame, label: str, way: str = "up", seed: int = 7) -> DataFrame:
    """Classes resampled to the size of the greatest (up: rows repeat in turn) or the least (down).

    Every row is taken floor(goal / n) times, and once more if it comes early in the order of a hash of its columns. Only the
    bucket of hashes in which the last such row lies is put in order, so that no class is sorted whole.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    goal = sizes.agg((F.max if way == "up" else F.min)("_n")).first()[0]
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *df.columns)).withColumn("_bucket", F.shiftrightunsigned("_h", 48))
    counts = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("_c"))  # 65,536 buckets a class at most
    so_far = F.sum("_c").over(Window.partitionBy(label).orderBy("_bucket"))
    parts = counts.withColumn("_upto", so_far).join(sizes, label).select(label, "_bucket", (F.col("_upto") - F.col("_c")).alias("_before"), "_upto", "_n", (F.lit(goal) % F.col("_n")).alias("_more"))
    same = hashed[label].eqNullSafe(parts[label]) & (hashed["_bucket"] == parts["_bucket"])
    rows = hashed.join(parts, same).drop(parts[label]).drop(parts["_bucket"])
    cut = (F.col("_before") < F.col("_more")) & (F.col("_more") < F.col("_upto"))
    place = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_h"))
    sure = rows.where(~cut).withColumn("_again", (F.col("_upto") <= F.col("_more")).cast("int"))
    open_ = rows.where(cut).withColumn("_again", (place + F.col("_before") <= F.col("_more")).cast("int"))
    times = F.floor(F.lit(goal) / F.col("_n")).cast("int") + F.col("_again")
    rows = sure.unionByName(open_).withColumn("_k", times).where("_k > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    return rows.select(*df.columns)


def forest(df: DataFrame, variables: Sequence[str], label: str, trees: int = 500, folds: int = 10, seeds: Sequence[int] = (1, 2, 3)) -> tuple[DataFrame, DataFrame, list[float]]:
    """(predictions, importance by variable, accuracy of each repeated cross validation); nulls count as 0.

    predictions: class (the label as it is), label (its index) and prediction.
    """
    rows = df.select(label, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in variables]).where(F.col(label).isNotNull())
    rows = VectorAssembler(inputCols=list(variables), outputCol="features").transform(StringIndexer(inputCol=label, outputCol="_index").fit(rows).transform(rows))
    rows = saved(rows)
    accuracy, model = [], None
    for seed in seeds:
        tree = RandomForestClassifier(numTrees=trees, seed=seed, labelCol="_index")
        cv = CrossValidator(estimator=tree, estimatorParamMaps=ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(metricName="accuracy", labelCol="_index"), numFolds=folds, seed=seed).fit(rows)
        accuracy.append(cv.avgMetrics[0])
        model = model or cv.bestModel
    importance = df.sparkSession.createDataFrame([(v, float(model.featureImportances[k])) for k, v in enumerate(variables)], "variable string, importance double")
    return model.transform(rows).select(F.col(label).alias("class"), F.col("_index").alias("label"), "prediction"), importance.orderBy(F.desc("importance"), "variable"), accuracy


def confusion(predictions: DataFrame) -> DataFrame:
    """(label, prediction, n, share of the label)."""
    counts = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def top_importance(importance: DataFrame, catalogue: DataFrame, n: int = 10) -> DataFrame:
    """(place, name, variable, importance): the n most important variables by the names of a catalogue (variable, name); without one
    there, the variable's own."""
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "variable"))  # a row for each variable
    first = importance.withColumn("place", place).where(F.col("place") <= n)
    names = catalogue.groupBy("variable").agg(F.min("name").alias("_name"))
    return first.join(names, "variable", "left").select("place", F.coalesce("_name", "variable").alias("name"), "variable", "importance").orderBy("place")


#: Lance-Williams updates by linkage: the new distance from those to both parts, the one between them, and the three sizes.
LINKAGES = {
    "single": lambda a, b, d, na, nb, n: np.minimum(a, b),
    "complete": lambda a, b, d, na, nb, n: np.maximum(a, b),
    "average": lambda a, b, d, na, nb, n: (na * a + nb * b) / (na + nb),
    "ward": lambda a, b, d, na, nb, n: np.sqrt(((na + n) * a**2 + (nb + n) * b**2 - n * d**2) / (na + nb + n)),
}


def _merged(distance: np.ndarray, linkage: str) -> list[np.ndarray]:
    """Cluster numbers of the rows for one cluster, two, and so on, by agglomeration."""
    n, far = len(distance), distance.astype(float).copy()
    np.fill_diagonal(far, np.inf)
    sizes, label, found = np.ones(n), np.arange(n), [np.arange(n)]
    for _ in range(n - 1):
        a, b = sorted(divmod(int(np.argmin(far)), n))
        new = LINKAGES[linkage](far[a], far[b], far[a, b], sizes[a], sizes[b], sizes)
        far[a], far[:, a] = new, new
        far[b], far[:, b], far[a, a] = np.inf, np.inf, np.inf
        sizes[a] += sizes[b]
        label = np.where(label == b, a, label)
        found.append(label)
    return found[::-1]


def _silhouettes(distance: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(b - a) / max(a, b) of each row: its mean distances within its cluster and to the nearest other one; 0 for one alone."""
    names = np.unique(label)
    sums = np.stack([distance[:, label == c].sum(1) for c in names], 1)
    sizes = np.array([(label == c).sum() for c in names])
    own = np.searchsorted(names, label)
    rows = np.arange(len(label))
    within = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    others = sums / sizes
    others[rows, own] = np.inf
    near = others.min(1)
    return np.where(sizes[own] > 1, (near - within) / np.maximum(np.maximum(near, within), 1e-300), 0.0)


def variable_groups(df: DataFrame, variables: Sequence[str], k: int | None = None, most: int = 10, method: str = "pearson", absolute: bool = False, linkage: str = "ward") -> DataFrame:
    """(variable, cluster, silhouette, x, y): variables grouped by their rows of the correlation matrix.

    Rows are merged by the distance between them; ``k`` clusters, or as many up to ``most`` as give the greatest mean silhouette. x and y
    are plane coordinates from the doubly centred squared distances. Spark makes the correlations; what is left is one
    number for each pair of variables. Clusters are numbered in the order of variables; a correlation that is not known counts as 0.
    """
    names = list(variables)
    at = {v: i for i, v in enumerate(names)}
    matrix = np.eye(len(names))
    for r in stats.correlations(df, names, method, absolute).collect():
        matrix[at[r.a], at[r.b]] = matrix[at[r.b], at[r.a]] = r.r or 0.0
    squared = ((matrix[:, None] - matrix[None]) ** 2).sum(-1)
    distance = np.sqrt(squared)
    by_size = _merged(distance, linkage)
    sizes = [k] if k else range(2, min(most, len(names) - 1) + 1)
    chosen = max(sizes, key=lambda n: (_silhouettes(distance, by_size[n - 1]).mean(), -n), default=1)
    label = by_size[chosen - 1]
    order = {c: n for n, c in enumerate(dict.fromkeys(label.tolist()), 1)}
    middle = np.eye(len(names)) - 1 / len(names)
    values, vectors = np.linalg.eigh(-0.5 * middle @ squared @ middle)
    plane = vectors[:, ::-1][:, :2] * np.sqrt(np.maximum(values[::-1][:2], 0))
    plane = plane * np.where(plane[np.abs(plane).argmax(0), range(plane.shape[1])] < 0, -1, 1)
    width = _silhouettes(distance, label) if chosen > 1 else np.zeros(len(names))
    rows = [(v, order[int(label[i])], float(width[i]), *map(float, [*plane[i], 0.0][:2])) for i, v in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "variable string, cluster int, silhouette double, x double, y double")
