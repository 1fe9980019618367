"""Tests, correlations and table statistics. Ranks and sums are Spark's; kernels see aggregated rows only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.operators.saving import saved


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) > 0 else -1)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(|T| > t)."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


@cache
def t_value(df: int, p: float) -> float:
    """Quantile p > 1/2 of Student's t, by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_tail(high, df) / 2 < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_tail(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def chi_square_tail(x: float, df: float) -> float:
    """P(X > x), by the series of the lower or the fraction of the upper incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for k in range(1, 500):
        top = -k * (k - a)
        b += 2
        d, c = 1 / (top * d + b), b + top / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_quantiles(df: Sequence[Column], p: float) -> Column:
    """Student quantiles of columns of degrees of freedom, as one array; null below one."""

    @F.pandas_udf("array<double>")
    def found(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ks: [t_value(int(min(k, 100_000)), p) if k is not None and k == k and k >= 1 else None for k in ks])

    return found(F.array(*[c.cast("double") for c in df]))


#: So many counted values are summed up by a plain window, one task a key; so many ranks are sent to all tasks.
FEW_VALUES, FEW_RANKS = 1_000_000, 200_000


def running_below(counts: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "below") -> DataFrame:
    """Add the sum of ``weight`` over smaller values of the same keys; counts has one row for each of keys and value.

    Over FEW_VALUES rows are dealt out by ranges of (keys, value), summed within each range, and each range starts at the total of those
    before it. So one key with all rows spreads over tasks; only totals, one a range and key, are ordered together.
    """
    keys = list(keys)
    counts = saved(counts)
    if counts.count() <= FEW_VALUES:
        smaller = Window.partitionBy(*keys or [F.lit(0)]).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(name, F.coalesce(F.sum(weight).over(smaller), F.lit(0)))
    dealt = saved(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_part").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(starts, [*keys, "_part"])
    return rows.withColumn(name, F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("_part", "_start")


def quantiles(df: DataFrame, value: str, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(keys, n, q): exact quantiles between neighbouring values (linear), from ranks of distinct values; nulls do not count."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    rows = running_below(counts, keys, "_v", "_c", "_below")
    n = rows.groupBy(*keys).agg(F.sum("_c").alias("n"))
    rows = rows.join(n, keys) if keys else rows.crossJoin(F.broadcast(n))  # one row
    at = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")), F.col("_v")))
    place = [(F.col("n") - 1) * share for share in shares]
    ends = [x for p in place for x in (at(F.floor(p)), at(F.ceil(p)))]
    found = rows.groupBy(*keys, "n").agg(*[x.alias(f"_q{k}") for k, x in enumerate(ends)])
    q = [F.col(f"_q{2 * k}") + (F.col(f"_q{2 * k + 1}") - F.col(f"_q{2 * k}")) * (p - F.floor(p)) for k, p in enumerate(place)]
    return found.select(*keys, "n", F.array(*q).alias("q"))


@cache
def _rank_sum_counts(m: int, n: int) -> np.ndarray:
    """How many samples of m out of m + n ranks have each value of the statistic 0..mn."""
    counts = np.zeros((m + 1, m * n + 1))
    counts[0, 0] = 1
    for rank in range(1, m + n + 1):
        for taken in range(min(m, rank), 0, -1):
            shift = rank - taken
            if shift <= n:
                counts[taken, shift:] += counts[taken - 1, : counts.shape[1] - shift] if shift else counts[taken - 1]
    return counts[m]


def rank_sum_p(w: float, m: int, n: int, tied: float) -> float | None:
    """Two-sided p of the rank-sum statistic w = rank sum - m(m+1)/2: exact below 50 each without ties, else normal
    with corrections for ties (tied: sum of t^3 - t) and continuity."""
    if m < 1 or n < 1:
        return None
    if m < 50 and n < 50 and not tied:
        counts = _rank_sum_counts(m, n)
        total = counts.sum()
        p = counts[int(w) :].sum() / total if w > m * n / 2 else counts[: int(w) + 1].sum() / total
        return float(min(1.0, 2 * p))
    z = w - m * n / 2
    sigma = math.sqrt(m * n / 12 * ((m + n + 1) - tied / ((m + n) * (m + n - 1)))) if m + n > 1 else 0.0
    if sigma <= 0:
        return None
    z = (z - math.copysign(0.5, z) * (z != 0)) / sigma
    return float(math.erfc(abs(z) / math.sqrt(2)))


def rank_sum_tests(df: DataFrame, variables: Sequence[str], group: str = "group_condition") -> DataFrame:
    """(a, b, variable, n_a, n_b, w, p) for all pairs of groups and variables, by p within a pair; a null group takes no part.

    Each pair ranks its own rows: values are counted per group first, so what is ranked are distinct values.
    """
    long = df.select(group, *[F.col(v).cast("double") for v in variables]).unpivot([group], list(variables), "variable", "value").where(f"value IS NOT NULL AND {group} IS NOT NULL")
    counts = long.groupBy("variable", "value", F.col(group).alias("g")).agg(F.count("*").alias("c"))
    groups = counts.select("g").distinct()
    pairs = groups.select(F.col("g").alias("a")).join(groups.select(F.col("g").alias("b")), F.col("a") < F.col("b"))
    rows = counts.join(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("g")), "g")
    values = rows.groupBy("a", "b", "variable", "value").agg(F.sum(F.when(F.col("g") == F.col("a"), F.col("c")).otherwise(0)).alias("ca"), F.sum("c").alias("t"))
    values = running_below(values, ["a", "b", "variable"], "value", "t")
    sums = values.withColumn("rank", F.col("below") + (F.col("t") + 1) / 2).groupBy("a", "b", "variable").agg(F.sum("ca").alias("n_a"), (F.sum("t") - F.sum("ca")).alias("n_b"), F.sum(F.col("ca") * F.col("rank")).alias("r"), F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("tied"))

    @F.pandas_udf("double")
    def p(w: pd.Series, m: pd.Series, n: pd.Series, tied: pd.Series) -> pd.Series:
        return pd.Series([rank_sum_p(*x) for x in zip(w, m, n, tied, strict=True)], dtype="float64")

    out = sums.withColumn("w", F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    out = out.withColumn("p", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), p("w", "n_a", "n_b", "tied")))
    return out.select("a", "b", "variable", "n_a", "n_b", "w", "p").orderBy("a", "b", F.asc_nulls_last("p"), "variable")


def rank_sums_by_key(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(key, w, n_a, n_b, p): rank-sum test of the two groups 'a' and 'b' of each key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count_if(F.col(group) == "a").alias("ca"), F.count("*").alias("t"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumn("rank", below + (F.col("t") + 1) / 2).groupBy(key).agg(F.sum("ca").alias("n_a"), (F.sum("t") - F.sum("ca")).alias("n_b"), F.sum(F.col("ca") * F.col("rank")).alias("r"), F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("tied"))

    @F.pandas_udf("double")
    def p(w: pd.Series, m: pd.Series, n: pd.Series, tied: pd.Series) -> pd.Series:
        return pd.Series([rank_sum_p(*x) for x in zip(w, m, n, tied, strict=True)], dtype="float64")

    out = sums.withColumn("w", F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    return out.select(key, "w", "n_a", "n_b", p("w", "n_a", "n_b", "tied").alias("p"))


def kruskal(df: DataFrame, value: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, groups, h, p): Kruskal-Wallis with tie correction, from counts of distinct values."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, value, group).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*keys, value).agg(F.sum("c").alias("t"))
    ranks = running_below(totals, keys, value, "t").withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    sums = counts.join(ranks, [*keys, value]).groupBy(*keys, group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    h = sums.groupBy(*keys).agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    ties = ranks.groupBy(*keys).agg(F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("tied"))
    both = h.join(ties, keys) if keys else h.crossJoin(F.broadcast(ties))
    n = F.col("n").cast("double")
    both = both.withColumn("h", F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide(F.col("tied"), n * n * n - n)))

    @F.pandas_udf("double")
    def p(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi_square_tail(v, g - 1) if v == v and g > 1 else None for v, g in zip(x, k, strict=True)], dtype="float64")

    return both.select(*keys, "groups", "h", p("h", "groups").alias("p"))


def correlations(df: DataFrame, variables: Sequence[str], method: str = "pearson", absolute: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, r, n) for a < b in the order of ``variables``, on rows where none is null; Spearman by average ranks."""
    rows = df.select(*keys, *[F.col(v).cast("double") for v in variables]).dropna(subset=list(variables))
    if method == "spearman":
        rows = _as_ranks(rows, variables, keys)
    pairs = list(combinations(variables, 2))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    listed = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.abs(f"r{k}") if absolute else F.col(f"r{k}")).alias("r")) for k, (a, b) in enumerate(pairs)]))
    return out.select(*keys, "n", listed.alias("x")).select(*keys, "x.a", "x.b", F.when(~F.isnan("x.r"), F.col("x.r")).alias("r"), "n")


def _as_ranks(rows: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The variables replaced by their average ranks within keys, from counts of distinct values."""
    keys = list(keys)
    counts = rows.unpivot(keys, list(variables), "_variable", "_value").groupBy(*keys, "_variable", "_value").agg(F.count("*").alias("_t"))
    ranks = saved(running_below(counts, [*keys, "_variable"], "_value", "_t", "_below").withColumn("_rank", F.col("_below") + (F.col("_t") + 1) / 2))
    few = ranks.count() <= FEW_RANKS
    for v in variables:
        own = ranks.where(F.col("_variable") == v).select(*keys, F.col("_value").alias(v), "_rank")
        rows = rows.join(F.broadcast(own) if few else own, [*keys, v]).withColumn(v, F.col("_rank")).drop("_rank")
    return rows


def significance(pairs: DataFrame) -> DataFrame:
    """Add p of r = 0 to correlation rows."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x != x or k < 3 else 0.0 if abs(x) >= 1 else t_tail(abs(x) * math.sqrt((k - 2) / (1 - x * x)), k - 2) for x, k in zip(r, n, strict=True)], dtype="float64")

    return pairs.withColumn("p", p("r", "n"))


def strongest(pairs: DataFrame, n: int) -> DataFrame:
    """The n pairs of the greatest absolute correlation."""
    return pairs.withColumn("r", F.abs("r")).orderBy(F.desc("r"), "a", "b").limit(n)


def network_edges(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs whose absolute correlation is ``least`` or more, as edges of a network."""
    return pairs.where(F.abs("r") >= least)


def mahalanobis(new: DataFrame, track: DataFrame, variables: Sequence[str], key: str = "id", rows: int = 10) -> DataFrame:
    """``new`` with distance: of its variables from the mean of its track's last ``rows`` rows, in their covariance.

    new: (key, variables), track: (key, frame, variables). Means and covariances are sums over the last rows; the kernel
    inverts one small matrix for each row of ``new``. Null where the covariance has no inverse or the track no rows.
    """
    names = list(variables)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("frame")))
    recent = track.withColumn("_r", last).where(F.col("_r") <= rows)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    known = recent.groupBy(key).agg(F.array(*[F.avg(v) for v in names]).alias("_mean"), F.array(*[F.covar_samp(a, b) for a, b in pairs]).alias("_cov"))

    @F.pandas_udf("double")
    def distance(x: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.Series:
        at = np.triu_indices(len(names))

        def one(v, m, c) -> float | None:
            if m is None or any(z is None or z != z for part in (v, m, c) for z in part):
                return None
            whole = np.zeros((len(names), len(names)))
            whole[at] = c
            whole = whole + whole.T - np.diag(np.diag(whole))
            if np.linalg.cond(whole) > 1e12:
                return None
            d = np.asarray(v, float) - np.asarray(m, float)
            return float(np.sqrt(max(0.0, d @ np.linalg.solve(whole, d))))

        return pd.Series([one(*r) for r in zip(x, mean, cov, strict=True)], dtype="float64")

    out = new.join(known, key, "left")
    return out.withColumn("distance", distance(F.array(*names), "_mean", "_cov")).drop("_mean", "_cov")


def without_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null what lies beyond 1.5 interquartile ranges from the quartiles of its column over the whole table."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "_variable", "_value")
    found = quantiles(long, "_value", ["_variable"], (0.25, 0.75))
    bounds = F.broadcast(found.groupBy().agg(*[F.max(F.when(F.col("_variable") == c, F.col("q"))).alias(f"_q_{c}") for c in columns]))  # one row
    new = {}
    for c in columns:
        a, b = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        new[c] = F.when(F.col(c).between(a - 1.5 * (b - a), b + 1.5 * (b - a)), F.col(c))
    return df.crossJoin(bounds).withColumns(new).drop(*[f"_q_{c}" for c in columns])


def box_statistics(df: DataFrame, value: str, group: str = "group_condition") -> DataFrame:
    """Quartiles, whiskers, outliers and count by group."""
    rows = df.where(F.col(value).isNotNull())
    rows = rows.join(quantiles(rows, value, [group], (0.25, 0.5, 0.75)), group)
    low, high = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col(value).between(low, high)
    return rows.groupBy(group).agg(F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers"), F.first("n").alias("n"))


def parallel_coordinates(df: DataFrame, variables: Sequence[str], group: str = "group_condition") -> DataFrame:
    """(group, variable, z_mean, f): mean z score by group with missing values at the mean, and the F statistic of the groups."""
    long = df.select(group, *[F.col(v).cast("double") for v in variables]).unpivot([group], list(variables), "variable", "value")
    stats = long.groupBy("variable").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("s")), F.lit(0.0))
    by = long.join(stats, "variable").withColumn("z", z).groupBy("variable", group).agg(F.avg("z").alias("z_mean"), F.count("*").alias("n"), F.var_pop("z").alias("v"))
    over = Window.partitionBy("variable")
    grand = F.sum(F.col("n") * F.col("z_mean")).over(over) / F.sum("n").over(over)
    by = by.withColumn("_between", F.col("n") * F.pow(F.col("z_mean") - grand, F.lit(2.0))).withColumn("_k", F.count(F.lit(1)).over(over))
    f = F.try_divide(F.sum("_between").over(over) / (F.col("_k") - 1), F.sum(F.col("n") * F.col("v")).over(over) / (F.sum("n").over(over) - F.col("_k")))
    return by.where("_k > 1").withColumn("f", f).select(group, "variable", "z_mean", "f")


def skewness_order(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, skewness, place): variables as axes in the order of their absolute skewness, the most skewed first; unknown ones last."""
    found = df.select(*[F.skewness(F.col(v).cast("double")).alias(v) for v in variables])
    long = found.unpivot([], list(variables), "variable", "skewness").withColumn("skewness", F.when(~F.isnan("skewness"), F.col("skewness")))
    return long.withColumn("place", F.row_number().over(Window.orderBy(F.abs("skewness").desc_nulls_last(), "variable")))  # a row for each variable
