"""Document quality by co-training of two views.

One view reads the text (shares of character classes, repeated words, word length), the other the page's metadata
(language, source and length). Both are logistic regressions, fitted on the driver over at most ``fit_rows`` labelled rows,
those with the smallest hashes of their ids. In each round each view scores all documents without a label, in Spark, and
labels those it is sure of; of these at most ``lend`` of either label and round, taken evenly by hash, go to the other view to
learn from. In the end the views' scores are calibrated, and then combined, each on labelled rows that nothing before
it learned from. All documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motiontab.llm.common import cut

#: Labelled rows that the driver fits on (about 200 bytes a row), rows of either label that a view lends in the first round (twice
#: as many in the second, and so on), and the rounds of co-training.
FIT_ROWS, LEND, ROUNDS = 20_000, 1_000, 5
#: A view lends rows of which it is at least this sure.
SURE = 0.95
#: Documents below this probability of good quality are rejected.
REJECT_BELOW = 0.4
#: Byte classes of the text view. Fixed values.
BYTES = (b"!", b"#$%&*@^~", b"|<>{}[]\\", bytes(range(65, 91)), b"0123456789", b".,;:?", b" \t\r", b"\n", bytes(range(97, 123)), bytes(range(128, 256)))
#: Words of a window in which distinct ones are counted; the share in a longer stretch falls with its length alone.
WINDOW = 2000
_SHARES = np.zeros((256, len(BYTES)))
for _k, _some in enumerate(BYTES):
    _SHARES[list(_some), _k] = 1.0
TEXT_FEATURES = len(BYTES) + 3


def distinct_share(words: list[bytes]) -> float:
    """Share of distinct words, the mean over consecutive windows that cover all words, a shorter last one by its size."""
    return sum(len(set(words[k : k + WINDOW])) for k in range(0, len(words), WINDOW)) / len(words)


def text_view(texts: list[str | None]) -> np.ndarray:
    """One row of features for each text; null as empty."""
    counts, more = np.zeros((len(texts), 256)), np.zeros((len(texts), 3))
    for k, text in enumerate(texts):
        data = (text or "").encode()
        counts[k] = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        words = data.split()
        if words:
            more[k] = sum(map(eq, words, words[1:])) / len(words), len(data) / len(words) / 10, distinct_share(words)
    shares = counts @ _SHARES / np.maximum(1, counts.sum(axis=1))[:, None]
    return np.hstack([np.sqrt(shares), more])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression with a ridge penalty on standardised features, by Newton's method."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
        s = np.ones(len(x)) if sample_weight is None else sample_weight
        penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (s * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (s * (y - p)) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]

    def logit_of(self, x: Column) -> Column:
        """The same of an array column."""
        slope = self.weights[1:] / self.scale
        out = F.lit(float(self.weights[0] - slope @ self.mean))
        for k, v in enumerate(slope):
            out = out + F.lit(float(v)) * x[k]
        return out


@dataclass
class Quality:
    """What ``fit`` found. Without labels of both kinds every document scores the labels' share, or 1/2."""

    constant: float = 0.5
    text: Logistic | None = None
    meta: Logistic | None = None
    calibration: tuple[Logistic, Logistic, Logistic] | None = None
    values: list[dict[str, float]] = field(default_factory=list)

    def metadata_view(self, langs: list, sources: list, sizes: list[int]) -> np.ndarray:
        """Log odds of a language's and a source's labelled rows (0 if not seen) and the length."""
        return np.array([[self.values[0].get(a, 0.0), self.values[1].get(b, 0.0), np.log1p(n)] for a, b, n in zip(langs, sources, sizes, strict=True)]).reshape(-1, 3)

    def combined(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(text), self.constant)
        a, b, both = self.calibration
        views = np.column_stack([a.logit(self.text.logit(text)[:, None]), b.logit(self.meta.logit(meta)[:, None])])
        return sigmoid(both.logit(views))

    def apply(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reject_below: float = REJECT_BELOW) -> DataFrame:
        """Rows of ``docs`` with quality_score (probability) and accepted; columns of those names are replaced.

        Each row is scored by itself: null texts are empty, texts of any length are read whole, nulls elsewhere are values of
        their own. An empty table stays empty.
        """
        rows = docs.drop("quality_score", "accepted")

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                meta = self.metadata_view(batch.column(lang_col).to_pylist(), batch.column(source_col).to_pylist(), [len(t or "") for t in texts]) if self.values else np.zeros((len(texts), 3))
                p = self.combined(text_view(texts), meta)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= reject_below)], [*batch.schema.names, "quality_score", "accepted"])

        return rows.mapInArrow(scored, rows.select("*").schema.add("quality_score", "double").add("accepted", "boolean"))


def log_odds(keys: list, y: np.ndarray) -> dict:
    """Smoothed log odds of the label by key, against all rows'."""
    prior = y.mean()
    found: dict = {}
    for k, v in zip(keys, y, strict=True):
        s = found.setdefault(k, [0.0, 0.0])
        s[0] += v
        s[1] += 1
    return {k: float(np.log((s + 5 * prior) / (n - s + 5 * (1 - prior))) - np.log(prior / (1 - prior))) for k, (s, n) in found.items()}


def listed(matrix: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(matrix.ravel()))


def matrix_of(column, width: int) -> np.ndarray:
    return np.array([np.asarray(v) for v in column], dtype=float).reshape(-1, width)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, lend: int = LEND, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality") -> Quality:
    """Co-train on the labelled rows of ``docs``; labels: (id_col, label_col 0 or 1).

    Labels with null parts are left out, several of one id count by their mean (1/2 and more is good), ids without a
    document too. Null texts are empty, null languages and sources values of their own, texts of any length are read whole.
    Rows without an id have no label; of several rows of one id one is fitted on. What is sampled is chosen by hash, so it is the same in every run. Of eight labelled
    rows one calibrates and one combines; where either of these lacks a kind of label, all labelled rows do all of it.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    few = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(fit_rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.record_batch([batch.column("id"), batch.column("y"), batch.column("lang"), batch.column("source"), pa.array([len(t or "") for t in texts], pa.int64()), listed(text_view(texts))], ["id", "y", "lang", "source", "size", "x"])

    # of several rows of one id the one with the least hash, whichever way rows are dealt out
    turn = F.struct(F.xxhash64("text", "lang", "source"), F.octet_length("text"))
    found = rows.join(few, "id").groupBy("id", "y").agg(F.min_by(F.struct("lang", "source", "text"), turn).alias("r")).select("id", "y", "r.lang", "r.source", "r.text")
    schema = found.select("id", "y", "lang", "source").schema.add("size", "long").add("x", T.ArrayType(T.DoubleType()))
    data = found.mapInArrow(read, schema).toArrow().to_pandas().sort_values("id", ignore_index=True)
    y = data["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Quality(float(y.mean()) if len(y) else 0.5)
    turn = np.arange(len(y)) % 8
    folds = [turn == 3, turn == 7]
    if any(len(set(y[f])) < 2 for f in (*folds, (turn != 3) & (turn != 7))):
        folds = [np.ones(len(y), bool)] * 2
        learn = folds[0]
    else:
        learn = ~(folds[0] | folds[1])
    model = Quality(float(y.mean()), values=[log_odds([k for k, m in zip(data[c], learn, strict=True) if m], y[learn]) for c in ("lang", "source")])
    own = matrix_of(data["x"], TEXT_FEATURES), model.metadata_view(data["lang"].tolist(), data["source"].tolist(), data["size"].tolist())

    def viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            meta = model.metadata_view(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), [len(t or "") for t in texts])
            yield pa.record_batch([batch.column("id"), listed(text_view(texts)), listed(meta)], ["id", "v0", "v1"])

    views = T.ArrayType(T.DoubleType())
    every = rows.mapInArrow(viewed, rows.select("id").schema.add("v0", views).add("v1", views))
    pool = cut(every.join(known, "id", "left_anti").select("v0", "v1", F.pmod(F.xxhash64("id", "v0", "v1"), F.lit(1 << 30)).alias("turn")))
    sure = float(np.log(SURE / (1 - SURE)))
    lent: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, own[v].shape[1])), np.zeros(0)) for v in (0, 1)]  # rows and labels for each view
    fitted: list[Logistic] = []
    for k in range(rounds + 1):
        fitted = []
        for v in (0, 1):
            x, labels_ = lent[v]
            weight = np.concatenate([np.ones(learn.sum()), np.full(len(x), 0.5)])
            fitted.append(Logistic.fit(np.vstack([own[v][learn], x]), np.concatenate([y[learn], labels_]), weight))
        if k == rounds:
            break
        scored = pool.withColumns({f"l{v}": fitted[v].logit_of(F.col(f"v{v}")) for v in (0, 1)})
        tests = {(v, label): F.col(f"l{v}") >= sure if label else F.col(f"l{v}") <= -sure for v in (0, 1) for label in (0, 1)}
        counts = scored.agg(*[F.count_if(t) for t in tests.values()]).first()
        share = [min(1 << 30, -(-lend * (k + 1) * (1 << 30) // n)) if n else 0 for n in counts]
        chosen = scored.where(F.greatest(*[F.when(t, F.lit(n)).otherwise(0) for t, n in zip(tests.values(), share, strict=True)]) > F.col("turn"))
        told = chosen.select("v0", "v1", *[F.when(t & (F.col("turn") < n), label).alias(f"t{v}{label}") for ((v, label), t), n in zip(tests.items(), share, strict=True)], "turn").orderBy("turn", "v0", "v1").toArrow().to_pandas()
        for v in (0, 1):
            taken = told[[f"t{v}0", f"t{v}1"]].notna().to_numpy()
            at = taken.any(axis=1)
            lent[1 - v] = matrix_of(told[f"v{1 - v}"][at], own[1 - v].shape[1]), taken[at, 1].astype(float)
    model.text, model.meta = fitted
    logits = [fitted[v].logit(own[v])[:, None] for v in (0, 1)]
    single = [Logistic.fit(x[folds[0]], y[folds[0]]) for x in logits]
    both = np.column_stack([s.logit(x) for s, x in zip(single, logits, strict=True)])
    model.calibration = (*single, Logistic.fit(both[folds[1]], y[folds[1]]))
    return model
