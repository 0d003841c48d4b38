import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import ledgerlight as L
from ledgerlight.operators import customers


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("a", "n", 50.0), ("b", "n", 20.0), ("b", "s", 10.0), ("c", "s", 10.0), ("d", "s", 10.0), (None, "s", 99.0),
         ("e", None, 0.0)], "k string, r string, m double")


def test_ties_go_by_item_and_null_keys_are_dropped(sales):
    got = [(r.side, r["rank"], r["item"]) for r in L.top_ranking(sales, "k", "m", 3, 2).orderBy("side", "rank").collect()]
    assert got == [("bottom", 1, "d"), ("bottom", 2, "e"), ("top", 1, "a"), ("top", 2, "b"), ("top", 3, "c")]


def test_concentration_by_hand(sales):
    r = L.concentration(sales, "k", "m").first()
    assert (r.unique_items, r.total, r.cr1, r.cr5, r.cr10) == (5, 100.0, 0.5, 1.0, 1.0)
    assert r.hhi == pytest.approx(0.25 + 0.09 + 0.01 + 0.01)
    assert (r.mean_per_item, r.median_per_item, r.above_mean_rate, r.band) == (20.0, 10.0, 0.4, "high")


def test_shares_of_a_total_that_is_not_positive(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 5.0)], "k string, m double")
    r = L.concentration(df, "k", "m").first()
    assert (r.cr1, r.hhi) == (0.0, None)
    assert {x.share for x in L.region_analysis(df, "k", "m").collect()} == {0.0}
    assert {x.abc_class for x in L.pareto_abc(df, "k", "m").collect()} == {None}


def test_pareto_counts_the_row_itself(spark):
    df = spark.createDataFrame([("big", 80.0), ("mid", 15.0), ("low", 5.0)], "k string, m double")
    got = {r.abc_class: (r["items"], r.revenue_share) for r in L.pareto_summary(df, "k", "m").collect()}
    assert got["A"] == (0, 0.0)
    assert got["B"] == (1, pytest.approx(0.8))
    assert got["C"] == (2, pytest.approx(0.2))


def test_region_counts_values_but_keeps_empty_regions(spark):
    df = spark.createDataFrame([("n", 1.0), ("n", None), ("s", None), ("t", 3.0)], "k string, m double")
    got = {r.region: (r.total, r.share, r["mean"], r["count"]) for r in L.region_analysis(df, "k", "m").collect()}
    assert got == {"n": (1.0, 0.25, 1.0, 1), "s": (0.0, 0.0, None, 0), "t": (3.0, 0.75, 3.0, 1)}
    x = L.region_extremes(df, "k", "m").first()
    assert (x.region_count, x.top_region, x.bottom_region) == (3, "t", "s")


def test_drill_down(sales):
    got = {(r.k, r.r): r.total for r in L.drill_down(sales, ["k", "r"], "m").collect()}
    assert got == {("a", "n"): 50.0, ("b", "n"): 20.0, ("b", "s"): 10.0, ("c", "s"): 10.0, ("d", "s"): 10.0}
    with pytest.raises(ValueError):
        L.drill_down(sales, ["k"], "m")


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 11, 50, 333])
def test_scores_equal_quantile_cuts_of_ranks(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"c": [f"c{i:04d}" for i in range(n)], "d": dt.datetime(2024, 1, 1), "m": rng.integers(1, 5, n) * 1.0})
    pdf["d"] = pdf["d"] + pd.to_timedelta(rng.integers(0, 40, n), unit="D")
    got = L.rfm_scores(spark.createDataFrame(pdf), "c", "d", "m").toPandas().sort_values("customer")
    base = pdf.sort_values("c").reset_index(drop=True)
    recency = (base.d.max() + pd.Timedelta(days=1) - base.d).dt.days
    cut = lambda s, labels: pd.qcut(s.rank(method="first"), 5, labels=labels).astype(int).tolist()
    assert got.r_score.tolist() == cut(recency, [5, 4, 3, 2, 1])
    assert got.f_score.tolist() == cut(pd.Series([1] * n), [1, 2, 3, 4, 5])
    assert got.m_score.tolist() == cut(base.m, [1, 2, 3, 4, 5])


def test_recency_floors_by_time_of_day(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 10, 1), 1.0), ("b", dt.datetime(2024, 1, 9, 2), 1.0),
                                ("c", None, 5.0)], "c string, d timestamp, m double")
    got = {r.customer: r.recency for r in customers.rfm_values(df, "c", "d", "m").collect()}
    assert got == {"a": 1, "b": 1}


def test_one_customer_gives_no_scores(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "c string, d date, m double")
    assert L.rfm_segments(df, "c", "d", "m").count() == 0


def test_hot_customer(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("c"),
        F.expr("date_add(date'2024-01-01', cast(id % 100 as int))").alias("d"), F.lit(1.0).alias("m"))
    seg = L.rfm_summary(df, "c", "d", "m")
    assert seg.agg(F.sum("customers")).first()[0] == df.select("c").distinct().count()
    assert seg.agg(F.sum("revenue_share")).first()[0] == pytest.approx(1.0)


def test_cube_has_every_level_and_null_dimensions_are_no_rollup(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 5.0), (None, "x", 9.0), ("b", "x", None)], "k string, total string, m double")
    got = {(r.k, r[1], r.grouping_id): (r.level, r[4], r.share) for r in L.drill_down_cube(df, ["k", "total"], "m").collect()}
    assert got == {
        ("a", "x", 0): (2, 1.0, 0.125), ("a", "y", 0): (2, 2.0, 0.25), ("b", "x", 0): (2, 5.0, 0.625), ("a", None, 1): (1, 3.0, 0.375),
        ("b", None, 1): (1, 5.0, 0.625), (None, "x", 2): (1, 6.0, 0.75), (None, "y", 2): (1, 2.0, 0.25), (None, None, 3): (0, 8.0, 1.0)}
    assert L.drill_down_cube(df.limit(0), ["k", "total"], "m").count() == 0
