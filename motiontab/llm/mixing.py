"""Document rates that bring a corpus to target weights of domains, with soft memberships, in DataFrame functions alone.

A naive Bayes classifier over hashed words, counted in the labelled table, gives each document a posterior over domains.
A document weighs as at most EFFECTIVE words in it, so that memberships stay soft. Rates r >= 0 are then fitted by least
squares: the expected tokens of a domain, sum of r_i n_i p_ik, are to match its target. Projected gradient descent keeps
the rates as a fold over the residuals so far (one number a domain and round), so a round is one aggregation of (n, p, r);
rates are written back every FOLD rounds. The step is taken in the metric of the token counts, in which all documents of
a profile change alike.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motiontab.llm.common import cut

#: Hash buckets of words, added counts, words that a document counts for at most, and least posterior.
BUCKETS, ADDED, EFFECTIVE, LEAST = 4096, 0.5, 20.0, 1e-9
#: Labelled rows that the classifier is fitted on at most.
FIT_ROWS = 20_000
#: Gradient steps, steps between two writings of the rates, and the residual (share of all tokens) over which a fit warns.
ROUNDS, FOLD, RESIDUAL = 60, 20, 0.01


def features(text: Column) -> Column:
    """Hash buckets of a text's lower-cased words between spaces and line ends."""
    text = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.transform(F.array_remove(F.split(text, " "), ""), lambda w: F.hash(w).bitwiseAND(F.lit(BUCKETS - 1)))


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("double")


Model = list[tuple[float, list[float]]]


def fit_classifier(labelled: DataFrame, domains: list[str]) -> Model:
    """(log prior, log probability of each bucket) for each domain, from all rows (domain, x); a domain without rows is even and rare."""
    rows = labelled.where(F.col("domain").isin(domains))
    n = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = {d: [ADDED] * BUCKETS for d in domains}
    for r in rows.select("domain", F.explode("x").alias("b")).groupBy("domain", "b").agg(F.count("*").alias("c")).collect():  # domains x BUCKETS at most
        counts[r.domain][r.b] += r.c
    total = sum(n.values())
    return [(math.log((n.get(d, 0) + 1) / (total + len(domains))), [math.log(c / sum(counts[d])) for c in counts[d]]) for d in domains]


def _summed(x: str, weights: list[float]) -> Column:
    """Sum of the weights of the buckets in ``x``."""
    table = F.from_json(F.lit("[" + ",".join(f"{v:.9g}" for v in weights) + "]"), "array<double>")
    return F.aggregate(x, F.lit(0.0), lambda s, b: s + F.coalesce(F.get(table, b), F.lit(0.0)))


def with_posterior(rows: DataFrame, model: Model, x: str, name: str) -> DataFrame:
    """Add posteriors over the domains, in their order, from the buckets in column ``x``, which goes. Each step is a
    projection of its own, so that no expression is repeated."""
    logs = []
    size = F.greatest(F.lit(1), F.size(x))
    for prior, weights in model:
        logs.append(F.lit(prior) + _summed(x, weights) * F.least(F.lit(1.0), F.lit(EFFECTIVE) / size))
    rows = rows.withColumn(name, F.array(*logs)).withColumn(x, F.array_max(name))
    rows = rows.withColumn(name, F.transform(name, lambda v: F.exp(v - F.col(x)) + LEAST))
    rows = rows.withColumn(x, F.aggregate(name, F.lit(0.0), lambda s, w: s + w))
    return rows.withColumn(name, F.transform(name, lambda v: v / F.col(x))).drop(x)


def rate(p: Column, steps: list[list[float]], least: float = 0.0, start: Column | None = None, most: float = math.inf) -> Column:
    """A document's rate after the given gradient steps, from one or ``start``: r - step . p, within least and most."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    flat = F.from_json(F.lit(str(steps)), "array<array<double>>")
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(flat, start, lambda r, g: F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), r - dot(g))))


@dataclass
class Mixture:
    """What ``fit`` found: domains in the order of posteriors, the classifier, gradient steps, target tokens, least and greatest rate, and
    the largest distance of a domain's expected tokens from its target, as a share of all tokens."""

    domains: list[str]
    model: Model
    steps: list[list[float]]
    wanted: list[float]
    least: float = 0.0
    residual: float = 0.0
    most: float = math.inf

    def apply(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Rows of ``docs`` with n_tokens (a quarter of the bytes), posterior and rate; columns of those names are replaced.

        Each row is rated by itself, without a shuffle; null and empty texts have the prior, texts of any length are read whole.
        """
        out = docs.drop("n_tokens", "posterior", "rate")
        x = "".join(out.columns) + "_x"  # a name that no column has
        out = with_posterior(out.withColumn(x, features(F.col(text_col))), self.model, x, "posterior")
        return out.withColumn("n_tokens", tokens(F.col(text_col)).cast("long")).withColumn("rate", rate(F.col("posterior"), self.steps, self.least, most=self.most))


def fit(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0, fit_rows: int = FIT_ROWS, most: float = math.inf) -> Mixture:
    """Fit rates of ``docs`` to ``targets``, weights of domains scaled to the corpus' tokens in all.

    labels: rows (id_col, domain), of which the ``fit_rows`` with the smallest hashes train the classifier; rows whose domain is
    null or no target are left out, as are ids that docs lacks.
    Null and empty texts count as one token; null ids take part but cannot be labelled. Each document has a finite
    rate >= ``least`` (0 or 1), and where the targets can be met expected tokens approach them. Without documents rates
    stay one. With ``least`` 1 all documents stay, and the targets are scaled to the total at which the domain furthest
    above its weight keeps its tokens; no weight may be 0 then. No rate exceeds ``most``: where that keeps a domain from its
    target the fit warns and ``residual`` says how far it is.
    """
    domains = sorted(targets)
    weight = sum(targets.values())
    if not domains or weight <= 0 or min(targets.values()) < 0:
        raise ValueError("targets need a positive sum and no negative weight")
    if least not in (0, 1) or (least and min(targets.values()) == 0):
        raise ValueError("the least rate is 0, or 1 if all targets are positive")
    if most < 1:
        raise ValueError("the greatest rate is 1 or more")
    few = labels.where(F.col("domain").isin(domains)).select(F.col(id_col).alias("id"), "domain").orderBy(F.xxhash64(id_col, "domain"), id_col, "domain").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit_classifier(rows.join(F.broadcast(few), "id").select("domain", features(F.col("text")).alias("x")), domains)
    base = cut(with_posterior(rows.select(tokens(F.col("text")).alias("n"), features(F.col("text")).alias("x")), model, "x", "p").withColumn("r", F.lit(1.0)))
    k = range(len(domains))
    p = [F.col("p")[i] for i in k]
    first = base.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * p[i] * p[j]).alias(f"g{i}_{j}") for i in k for j in k], *[F.sum(F.col("n") * p[i]).alias(f"t{i}") for i in k]).first()
    total = first.n or 0.0
    scaled = max((first[f"t{i}"] or 0.0) * weight / targets[d] for i, d in enumerate(domains)) if least else total
    wanted = [targets[d] / weight * scaled for d in domains]
    # squares are weighted by the inverse row sums of the Gram matrix, which bounds the gradient's Lipschitz constant by one
    bound = [max(1e-12, sum(first[f"g{i}_{j}"] for j in k) / total) if total else 1.0 for i in k]
    steps: list[list[float]] = []
    written, largest = 0, 0.0
    for turn in range(rounds + 1 if total else 0):
        now = rate(F.col("p"), steps[written:], least, F.col("r"), most)
        if len(steps) - written == FOLD:
            base, written = cut(base.withColumn("r", now)), len(steps)
            now = F.col("r")
        sums = base.select("n", "p", now.alias("r")).agg(*[F.sum(F.col("n") * F.col("r") * p[i]) for i in k]).first()
        residual = [(s - w) / total for s, w in zip(sums, wanted, strict=True)]
        largest = max(map(abs, residual))
        if largest < 1e-6 or turn == rounds:
            break
        steps.append([v / b for v, b in zip(residual, bound, strict=True)])
    if largest > RESIDUAL:
        warnings.warn(f"after {len(steps)} rounds a domain is {largest:.3g} of all tokens away from its target", stacklevel=2)
    return Mixture(domains, model, steps, wanted, least, largest, most)


def copies(rate_col: Column, *keys: str) -> Column:
    """Whole copies with the rate as their mean: its floor, and one more where a hash of the keys falls below the rest."""
    chance = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate_col + chance).cast("int")
