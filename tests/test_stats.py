import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import ledgerlight as L
from ledgerlight.functions import ordering
from ledgerlight.operators import stats


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, 400), 1)
    pdf = pd.DataFrame({"x": x, "y": x * 3 + rng.normal(0, 1, 400), "z": rng.exponential(1, 400), "k": 2.5})
    pdf.loc[::7, "y"] = np.nan
    pdf.loc[::5, "z"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def pairs(df, value):
    return {(r.col_a, r.col_b): r[value] for r in df.collect()}


def test_pearson_and_spearman_match_pandas(data):
    pdf, df = data
    cols = ["x", "y", "z", "k"]
    for op, method, value in ((L.corr_pearson, "pearson", "r"), (L.corr_spearman, "spearman", "rho")):
        want = pdf[cols].corr(method=method)
        got = pairs(op(df, cols), value)
        assert len(got) == 6
        for (a, b), r in got.items():
            w = want.loc[a, b]
            assert (r is None and math.isnan(w)) or r == pytest.approx(w, abs=1e-12)


def test_constant_far_from_zero_is_still_constant(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("c"), F.col("id").cast("double").alias("v"))
    assert pairs(L.corr_pearson(df, ["c", "v"]), "r") == {("c", "v"): None}


def test_small_spread_around_a_large_mean(spark):
    df = spark.range(1000).select((F.lit(1e9) + F.col("id") % 7).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    assert pairs(L.corr_pearson(df, ["a", "b"]), "r")[("a", "b")] == pytest.approx(1.0)


def test_p_values(spark):
    # t = 2.228 with 10 degrees of freedom is the 5 % point
    for df_, t, p in ((10, 2.2281388519649385, 0.05), (1, 12.706204736432095, 0.05), (30, 2.7499956535670305, 0.01)):
        r2 = t * t / (t * t + df_)
        assert stats._beta_tail(df_ / 2, 0.5, 1 - r2) == pytest.approx(p, abs=1e-9)
    assert stats._beta_tail(5e5, 0.5, 1 - 1e-6) == pytest.approx(math.erfc(math.sqrt(1e6 * 1e-6 / 2)), rel=1e-3)
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    assert L.corr_p_values(df, ["a", "b"]).first().p_value == pytest.approx(0.0, abs=1e-6)
    assert L.corr_p_values(df.limit(2), ["a", "b"]).count() == 0


def test_strong_and_redundant_pairs_do_not_overlap(data):
    pdf, df = data
    df = df.withColumn("w", F.col("x") * 2)
    assert pairs(L.redundant_pairs(df, ["x", "y", "w"]), "type") == {("x", "w"): "positive"}
    strong = pairs(L.strong_pairs(df.withColumn("v", -F.col("y")), ["x", "v"]), "type")
    want = abs(pdf.x.corr(pdf.y))
    assert strong == ({("x", "v"): "negative"} if want <= 0.95 else {})


def test_strong_pairs_shuffle_rare_values_only(spark, monkeypatch):
    monkeypatch.setattr(ordering, "LOOK_UP", 15)
    rng = np.random.default_rng(8)
    x = np.where(rng.random(3000) < 0.4, 2.0, rng.normal(0, 1, 3000))
    pdf = pd.DataFrame({"x": x, "y": x + rng.normal(0, 0.5, 3000), "z": -np.round(x) + rng.normal(0, 0.4, 3000)})
    pdf.loc[::6, "y"] = np.nan
    got = {(r.col_a, r.col_b): r.spearman_rho for r in L.strong_pairs(spark.createDataFrame(pdf), ["x", "y", "z"]).collect()}
    want = pdf.corr(method="spearman")
    assert len(got) >= 2
    for (a, b), rho in got.items():
        assert rho == pytest.approx(want.loc[a, b], abs=1e-12)


def test_rank_correlation_with_gaps_in_every_column(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({f"v{i}": rng.normal(0, 1, 300).round(1) for i in range(6)})
    for i in range(6):
        pdf.loc[i :: 11 + i, f"v{i}"] = np.nan
    got, want = pairs(L.corr_spearman(spark.createDataFrame(pdf), list(pdf)), "rho"), pdf.corr(method="spearman")
    assert len(got) == 15
    for (a, b), rho in got.items():
        assert rho == pytest.approx(want.loc[a, b], abs=1e-12)


def test_outliers_are_strictly_outside(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 7.0, 7.000001, None)], "v double")
    # quartiles 2.25 and 6.25, fences -3.75 and 12.25
    r = L.anomaly_detect(df, ["v"]).first()
    assert (r.lower_bound, r.upper_bound, r.outlier_count) == (pytest.approx(-3.75), pytest.approx(12.25, abs=1e-5), 0)
    hot = spark.createDataFrame([(1.0,)] * 9 + [(2.0,), (None,)], "v double")
    r = L.anomaly_detect(hot, ["v"]).first()
    assert (r.outlier_count, r.outlier_rate) == (1, pytest.approx(1 / 11))


def test_first_of_equal_worst_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 9 + [(2.0, 2.0)], "b double, a double")
    assert L.anomaly_summary(df, ["b", "a"]).first().worst_column == "b"


def test_empty_column_has_no_outliers(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "e double, v double")
    got = {r["column"]: (r.lower_bound, r.outlier_count) for r in L.anomaly_detect(df, ["e", "v"]).collect()}
    assert got["e"] == (None, 0)


@pytest.mark.parametrize("values,shape", [
    ([1.0, 2.0, 3.0, 4.0, 5.0, 3.0, 3.0], "near_normal"),
    ([1.0] * 20 + [100.0], "heavy_right"),
    ([-1.0] * 20 + [-100.0], "heavy_left"),
    ([5.0, 5.0, 5.0], "near_normal"),
])
def test_shapes(spark, values, shape):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert L.distribution(df, ["v"]).first()["shape"] == shape


def test_normality(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"n": rng.normal(0, 1, 3000), "e": rng.exponential(1, 3000)})
    got = {r["column"]: r.is_normal for r in L.normality_test(spark.createDataFrame(pdf), ["n", "e"]).collect()}
    assert got == {"n": True, "e": False}


def test_anderson_darling_equals_the_plain_sum(spark):
    import math
    import random

    rng = random.Random(5)
    columns = {
        "normal": [rng.gauss(3, 2) for _ in range(600)], "skewed": [rng.expovariate(1) for _ in range(600)],
        "ties": [float(round(rng.gauss(0, 3))) for _ in range(600)], "far": [rng.gauss(0, 1) for _ in range(599)] + [900.0],
        "constant": [2.5] * 600, "few": [None if i > 5 else float(i) for i in range(600)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    got = {r["column"]: r for r in L.anderson_darling(df, list(columns)).collect()}
    below = lambda z: math.erfc(-z / math.sqrt(2)) / 2
    for c in ("normal", "skewed", "ties"):
        x = sorted(columns[c])
        n, mean = len(x), sum(x) / len(x)
        std = math.sqrt(sum((v - mean) ** 2 for v in x) / (n - 1))
        z = [(v - mean) / std for v in x]
        want = -n - sum((2 * i + 1) * (math.log(below(z[i])) + math.log(below(-z[n - 1 - i]))) for i in range(n)) / n
        assert got[c].statistic == pytest.approx(want, rel=1e-9) and got[c].n == n
    assert got["normal"].is_normal and got["normal"].p_value > 0.05
    assert not got["skewed"].is_normal and not got["far"].is_normal and got["far"].p_value == 0
    assert got["constant"].statistic is None and got["few"].p_value is None and got["few"].n == 6
