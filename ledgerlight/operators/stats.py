"""Outliers, correlations and distribution shape of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import as_double, literal_rows, ratio, require_columns, rows_from
from ..functions.ordering import exact_quantiles, mid_ranks, running_totals, settle


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, *, approx: bool = False) -> dict[str, tuple]:
    """Lower and upper fence per column, (None, None) for a column without values."""
    q = exact_quantiles(df, cols, [0.25, 0.75], approx=approx)
    fences = {}
    for c in cols:
        q1, q3 = q[c]
        fences[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return fences


def outside(df: DataFrame, c: str, fence: tuple) -> Column:
    low, high = fence
    if low is None:
        return F.lit(False)
    v = as_double(df, c)
    return F.coalesce((v < F.lit(low)) | (v > F.lit(high)), F.lit(False))


def anomaly_detect(df: DataFrame, cols: Sequence[str], k: float = 1.5, *, approx: bool = False) -> DataFrame:
    """Fences, outlier count and rate over all rows, per column."""
    require_columns(df, cols)
    fences = iqr_bounds(df, cols, k, approx=approx)
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(outside(df, c, fences[c])).alias(f"o{i}")
                                              for i, c in enumerate(cols)])
    return rows_from(wide, [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(fences[c][0]).cast("double").alias("lower_bound"),
            F.lit(fences[c][1]).cast("double").alias("upper_bound"),
            F.col(f"o{i}").alias("outlier_count"),
            ratio(F.col(f"o{i}"), F.col("_n")).alias("outlier_rate"),
        )
        for i, c in enumerate(cols)
    ])


def anomaly_summary(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """All outliers together and the column with the highest rate (the first of equals)."""
    at = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return anomaly_detect(df, cols, k).agg(
        F.sum("outlier_count").alias("total_anomalies"),
        F.count("*").alias("columns_analyzed"),
        F.min_by("column", F.struct(-F.col("outlier_rate"), at[F.col("column")])).alias("worst_column"),
    )


# Variance below this share of the squared mean is rounding noise of a constant.
CONSTANT_SHARE = 1e-28


def corr_pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """r of every column pair over the rows where both are present; NULL for a constant.

    A first scan takes means. The second sums products of the values less their
    mean, which keeps the digits: per batch of rows as products of matrices, so the
    plan does not grow with the number of columns.
    """
    require_columns(df, cols)
    names = [f"c{i}" for i in range(len(cols))]
    values = df.select(*[as_double(df, c).alias(n) for c, n in zip(cols, names)])
    return _pearson(values, names, list(combinations(names, 2)), dict(zip(names, cols)))


def _pearson(values: DataFrame, names: list[str], pairs: list[tuple[str, str]], label: dict[str, str],
             means: dict[str, float] | None = None) -> DataFrame:
    means = values.agg(*[F.avg(n).alias(n) for n in names]).first() if means is None else means
    mean = np.array([means[n] or 0.0 for n in names])
    spot = {n: i for i, n in enumerate(names)}
    left, right = (np.array([spot[p[k]] for p in pairs], dtype=int) for k in (0, 1))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(pairs)))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - mean
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            counts, firsts, squares, products = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
            total += np.stack([
                counts[left, right], firsts[left, right], squares[left, right], firsts[right, left], squares[right, left],
                products[left, right],
            ])
        yield pd.DataFrame(dict(zip(("pair", "n", "sx", "sxx", "sy", "syy", "sxy"), (np.arange(len(pairs)), *total))))

    summed = values.select(*names).mapInPandas(sums, "pair int, n double, sx double, sxx double, sy double, syy double, sxy double")
    got = summed.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sy", "syy", "sxy")])
    known = values.sparkSession.createDataFrame(
        [(i, label[a], label[b], float(mean[spot[a]] ** 2), float(mean[spot[b]] ** 2)) for i, (a, b) in enumerate(pairs)],
        "pair int, col_a string, col_b string, ma double, mb double")
    n = F.col("n")
    vx, vy = F.col("sxx") - ratio(F.col("sx") * F.col("sx"), n), F.col("syy") - ratio(F.col("sy") * F.col("sy"), n)
    varies = (vx > n * CONSTANT_SHARE * F.col("ma")) & (vy > n * CONSTANT_SHARE * F.col("mb"))
    r = ratio(F.col("sxy") - ratio(F.col("sx") * F.col("sy"), n), F.sqrt(F.when(varies, vx)) * F.sqrt(F.when(varies, vy)))
    # rounding may push |r| past 1
    r = F.when(F.abs(r) > 1, F.signum(r)).otherwise(r)
    return got.join(known, "pair").select("col_a", "col_b", n.cast("long").alias("n"), r.alias("r"))


def corr_spearman(df: DataFrame, cols: Sequence[str],
                  pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pearson's r of the mean ranks, ranked within the rows where both are present.

    Pairs whose gaps are in the same columns share their ranks, and all ranks of a
    column are looked up at once; they go straight into the sums, for the mean of
    ranks is known. `pairs` limits the work to those pairs, in the order of `cols`.
    """
    require_columns(df, cols)
    names = [f"c{i}" for i in range(len(cols))]
    label = dict(zip(names, cols))
    chosen = [(a, b) for a, b in combinations(names, 2) if pairs is None or (label[a], label[b]) in pairs]
    if not chosen:
        return corr_pearson(df, cols).limit(0).withColumnRenamed("r", "rho")
    used = [n for n in names if any(n in pair for pair in chosen)]
    values = df.select(*[as_double(df, label[n]).alias(n) for n in used])
    missing = values.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in used]).first()
    groups: dict[tuple, list[tuple[str, str]]] = {}
    for a, b in chosen:
        groups.setdefault(tuple(n for n in (a, b) if missing[n]), []).append((a, b))
    # every column once per set of gaps
    views: dict[str, tuple[str, tuple]] = {}
    wanted = []
    for g, (holes, members) in enumerate(groups.items()):
        for pair in members:
            for n in pair:
                views[f"{n}_{g}"] = (n, holes)
            wanted.append((f"{pair[0]}_{g}", f"{pair[1]}_{g}"))
    there = [reduce(lambda x, y: x & y, [F.col(h).isNotNull() for h in holes], F.lit(True)) for holes in groups]
    counted = values.agg(*[F.count_if(t) for t in there]).first()
    means = {view: (counted[int(view.split("_")[1])] + 1) / 2 for view in views}
    ranked = mid_ranks(values, used, views)
    found = _pearson(ranked, list(views), wanted, {view: label[n] for view, (n, _) in views.items()}, means)
    return found.withColumnRenamed("r", "rho")


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for i in range(1, 10_000):
        for num in (
            i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)),
            -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def _t_two_sided(n: pd.Series, r: pd.Series) -> pd.Series:
    def one(k, v):
        if k < 3 or pd.isna(v):
            return None
        # with t² = r²(n-2)/(1-r²) the two-sided tail is I_{1-r²}((n-2)/2, 1/2)
        return _beta_tail((k - 2) / 2, 0.5, max(0.0, 1.0 - v * v))

    return pd.Series([one(k, v) for k, v in zip(n, r)], dtype="float64")


def corr_p_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two-sided Student-t p-value of every r, for pairs with at least 3 rows."""
    pairs = corr_pearson(df, cols).filter("n >= 3")
    return pairs.withColumn("p_value", _t_two_sided(F.col("n").cast("double"), F.col("r")))


def _pairs_between(df: DataFrame, cols: Sequence[str], low: float, high: float) -> DataFrame:
    """Pairs with low < |r| <= high, with both coefficients; only these are ranked."""
    found = corr_pearson(df, cols).filter((F.abs("r") > low) & (F.abs("r") <= high)).collect()
    if not found:
        rows = [F.struct(F.lit("").alias("col_a"), F.lit("").alias("col_b"), F.lit(0.0).alias("r"))]
        hits = literal_rows(df.sparkSession, rows).limit(0).withColumn("rho", F.lit(None).cast("double"))
    else:
        ranked = corr_spearman(df, cols, [(p["col_a"], p["col_b"]) for p in found]).drop("n")
        hits = literal_rows(df.sparkSession, [
            F.struct(F.lit(p["col_a"]).alias("col_a"), F.lit(p["col_b"]).alias("col_b"), F.lit(p["r"]).alias("r"))
            for p in found
        ]).join(ranked, ["col_a", "col_b"])
    return hits.select(
        "col_a", "col_b", F.col("r").alias("pearson_r"), F.col("rho").alias("spearman_rho"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("type"),
    )


def strong_pairs(df: DataFrame, cols: Sequence[str], low: float = 0.7, high: float = 0.95) -> DataFrame:
    """Pairs with low < |r| <= high."""
    return _pairs_between(df, cols, low, high)


def redundant_pairs(df: DataFrame, cols: Sequence[str], high: float = 0.95) -> DataFrame:
    """Pairs with |r| > high, which are likely to carry the same information."""
    return _pairs_between(df, cols, high, 1.0)


def _moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    wide = df.agg(*[
        x for i, c in enumerate(cols) for x in (
            F.count(as_double(df, c)).alias(f"n{i}"),
            F.skewness(as_double(df, c)).alias(f"s{i}"),
            F.kurtosis(as_double(df, c)).alias(f"k{i}"),
        )
    ])
    return rows_from(wide, [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("skewness"),
                 F.col(f"k{i}").alias("kurtosis"))
        for i, c in enumerate(cols)
    ]).filter("n >= 3")


def distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population skewness, excess kurtosis and the shape they indicate at four decimals."""
    s, k = F.round("skewness", 4), F.round("kurtosis", 4)
    return _moments(df, cols).withColumn(
        "shape",
        F.when((F.abs(s) < 0.5) & (F.abs(k) < 1), "near_normal")
        .when(s > 1, "heavy_right")
        .when(s < -1, "heavy_left")
        .when(s > 0.5, "mild_right")
        .when(s < -0.5, "mild_left")
        .when(k > 1, "heavy_tailed")
        .otherwise("near_normal"),
    )


def normality_test(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Jarque-Bera test; it needs only moments and so has no row limit."""
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return (
        _moments(df, cols)
        .withColumn("jb", jb)
        .withColumn("p_value", F.exp(-F.col("jb") / 2))
        .withColumn("is_normal", F.col("p_value") > alpha)
    )


def _log_below(z: np.ndarray) -> np.ndarray:
    """Logarithm of the standard normal distribution function."""
    near = np.maximum(z, -30.0)
    value = np.log(np.array([math.erfc(-x / math.sqrt(2)) / 2 for x in near.tolist()]).reshape(near.shape))
    # far below, the density over the distance, with the first terms of its series
    far = np.minimum(z, -30.0)
    return np.where(z < -30, -far * far / 2 - np.log(-far) - math.log(2 * math.pi) / 2 + np.log1p(-1 / far**2 + 3 / far**4), value)


def _anderson_p(a: float) -> float:
    """The published approximation of the p-value for unknown mean and variance, by the adjusted statistic."""
    if a >= 0.6:
        return math.exp(1.2937 - 5.709 * a + 0.0186 * a * a) if a < 150 else 0.0
    if a >= 0.34:
        return math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    if a >= 0.2:
        return 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a)
    return 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)


def anderson_darling(df: DataFrame, cols: Sequence[str], *, alpha: float = 0.05) -> DataFrame:
    """Test of normality by the whole distribution function: column, n, statistic, adjusted, p_value, is_normal.

    The statistic is -n - 1/n * sum((2i - 1) ln F(x_i) + (2(n - i) + 1) ln(1 - F(x_i)))
    over the values in order, F the normal distribution of their mean and sample
    deviation. Equal values are counted first and share their mean rank, which leaves
    the sum as it is; ranks are running totals over ranges, so n is not limited. The
    adjusted statistic is statistic * (1 + 0.75 / n + 2.25 / n^2), the p-value
    Stephens' approximation by it. Columns with fewer than 8 values or without
    variation give no result: NULL.
    """
    require_columns(df, cols)
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), as_double(df, c).alias("v")) for i, c in enumerate(cols)
    ]))).filter("v IS NOT NULL AND abs(v) < double('infinity')")
    counts = settle(values.groupBy("c", "v").agg(F.count("*").alias("times")))
    moments = df.agg(*[x for c in cols for v in (as_double(df, c),) for x in (
        F.avg(F.when(F.abs(v) < float("inf"), v)), F.stddev_samp(F.when(F.abs(v) < float("inf"), v)), F.count(F.when(F.abs(v) < float("inf"), v)))]).first()
    known = {i: tuple(moments[3 * i : 3 * i + 3]) for i in range(len(cols))}
    varies = {i: (mean, std, n) for i, (mean, std, n) in known.items() if n >= 8 and std and std * std > CONSTANT_SHARE * mean * mean}

    @F.pandas_udf("double")
    def weight(c: pd.Series, v: pd.Series, times: pd.Series, upto: pd.Series) -> pd.Series:
        mean, std, n = (np.array([varies[i][k] for i in c], dtype=float) for k in range(3))
        z = (v.to_numpy() - mean) / std
        rank = upto.to_numpy() - (times.to_numpy() - 1) / 2
        return pd.Series(times.to_numpy() * ((2 * rank - 1) * _log_below(z) + (2 * (n - rank) + 1) * _log_below(-z)))

    sums = {}
    if varies:
        ranked = running_totals(counts.filter(F.col("c").isin(list(varies))), {"times": "upto"}, ["v"], by=["c"])
        sums = {r["c"]: r["s"] for r in ranked.groupBy("c").agg(F.sum(weight("c", "v", "times", "upto")).alias("s")).collect()}
    rows = []
    for i, c in enumerate(cols):
        n = known[i][2]
        statistic = -n - sums[i] / n if i in sums else None
        adjusted = None if statistic is None else statistic * (1 + 0.75 / n + 2.25 / n**2)
        p = None if adjusted is None else _anderson_p(adjusted)
        rows.append((c, n, statistic, adjusted, p, None if p is None else p > alpha))
    return df.sparkSession.createDataFrame(rows, "column string, n long, statistic double, adjusted double, p_value double, is_normal boolean")
