import datetime as dt

import pytest
from pyspark.sql import functions as F

import ledgerlight as L


def rows(spark, data, schema="d string, m double"):
    return spark.createDataFrame(data, schema)


def totals(df):
    return [(str(r.period), r.total) for r in df.orderBy("period").collect()]


def test_gap_months_are_zero_and_bad_dates_are_dropped(spark):
    df = rows(spark, [("2024-01-31", 1.0), ("2024-01-01", 2.0), ("2024-04-10 12:00:00", 4.0), ("no date", 9.0),
                      ("2024-02-01", None), ("2024-03-05", float("nan"))])
    assert totals(L.monthly_series(df, "d", "m")) == [
        ("2024-01-31", 3.0), ("2024-02-29", 0.0), ("2024-03-31", 0.0), ("2024-04-30", 4.0)]


def test_growth_is_null_after_a_zero_month(spark):
    df = rows(spark, [("2024-01-01", 2.0), ("2024-03-01", 4.0), ("2024-04-01", 6.0)])
    growth = [r.growth for r in L.mom_growth(df, "d", "m").orderBy("period").collect()]
    assert growth == [None, -1.0, None, 0.5]


def test_moving_average_starts_with_one_month(spark):
    df = rows(spark, [("2024-01-01", 3.0), ("2024-02-01", 6.0), ("2024-03-01", 9.0), ("2024-04-01", 0.0)])
    assert [r.ma3 for r in L.moving_avg_3(df, "d", "m").orderBy("period").collect()] == [3.0, 4.5, 6.0, 5.0]


def test_inflections(spark):
    df = rows(spark, [(f"2024-0{i + 1}-01", v) for i, v in enumerate([1.0, 2.0, 1.0, 0.5, 4.0])])
    got = [(str(r.period), r.direction) for r in L.inflection_points(df, "d", "m").orderBy("period").collect()]
    assert got == [("2024-03-31", "down"), ("2024-05-31", "up")]


def test_summary_takes_the_first_of_equal_extremes(spark):
    df = rows(spark, [("2024-01-01", 5.0), ("2024-02-01", 1.0), ("2024-03-01", 5.0), ("2024-04-01", 1.0)])
    r = L.time_series(df, "d", "m").first()
    assert (str(r.peak_period), str(r.trough_period)) == ("2024-01-31", "2024-02-29")
    assert (r.period_count, r.total, r.mean, r.cagr) == (4, 12.0, 3.0, None)
    assert r.trend_direction == "down"
    assert r.trend_magnitude == pytest.approx((5 - 7 / 3) / 5)


def test_one_month_has_no_trend(spark):
    r = L.time_series(rows(spark, [("2024-01-01", 5.0)]), "d", "m").first()
    assert (r.trend_direction, r.trend_magnitude, r.avg_mom) == ("insufficient", 0.0, None)


def test_cagr_needs_a_year(spark):
    df = rows(spark, [(f"{2020 + i // 12}-{i % 12 + 1:02d}-01", 100.0 + 10 * i) for i in range(24)])
    assert L.time_series(df, "d", "m").first().cagr == pytest.approx((330 / 100) ** 0.5 - 1)


def test_yoy_skips_zero_years(spark):
    df = rows(spark, [("2023-01-01", 10.0), ("2023-02-01", 0.0), ("2024-01-01", 15.0), ("2024-02-01", 3.0)])
    got = [(str(r.period), r.yoy) for r in L.yoy_comparison(df, "d", "m").collect()]
    assert got == [("2024-01-31", 0.5)]
    assert tuple(L.yoy_summary(df, "d", "m").first()) == (0.5, 1, 1, 0)


def test_short_series_gives_no_forecast(spark):
    df = rows(spark, [(f"2024-{i + 1:02d}-01", 1.0) for i in range(11)])
    assert L.simple_forecast(df, "d", "m").count() == 0
    assert L.forecast_fitted(df, "d", "m").count() == 0


def test_forecast_of_a_line_and_of_a_constant(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2024, i + 1, 5), 10.0 + 2 * i) for i in range(12)]
        + [("b", dt.date(2024, i + 1, 5), 7.0) for i in range(12)], "k string, d date, m double")
    a, b = L.simple_forecast(df, "d", "m", by=["k"]).orderBy("k").collect()
    assert (a.slope, a.intercept, a.r2) == (pytest.approx(2), pytest.approx(10), pytest.approx(1))
    assert a.next_forecast == pytest.approx(34)
    assert a.sigma == pytest.approx(0, abs=1e-6)
    assert (b.slope, b.r2, b.next_forecast) == (pytest.approx(0), 0.0, pytest.approx(7))
    assert str(a.next_period) == "2025-01-31"


def test_annual_summary_only_for_long_series(spark):
    months = [(f"{2020 + i // 12}-{i % 12 + 1:02d}-15", 1.0) for i in range(25)]
    got = L.annual_summary(rows(spark, months), "d", "m")
    assert {(r.label, r.total) for r in got.filter("kind = 'year'").collect()} == {
        ("2020", 12.0), ("2021", 12.0), ("2022", 1.0)}
    assert got.filter("kind = 'month'").count() == 12
    assert L.annual_summary(rows(spark, months[:24]), "d", "m").count() == 0


def test_date_range_includes_both_days(spark):
    df = rows(spark, [("2024-01-01 00:00:00", 1.0), ("2024-01-02 23:59:59", 2.0), ("2024-01-03 00:00:00", 3.0)])
    assert L.date_range_filter(df, "d", "2024-01-01", "2024-01-02").count() == 2
    typed = L.coerce_date(df, "d")
    assert L.date_range_filter(typed, "d", "2024-01-02", None).count() == 2


def test_date_layouts(spark):
    df = rows(spark, [("2024/1/5", 1.0), ("1/31/2024", 1.0), ("20240105", 1.0), ("2024-01-05T10:00:00", 1.0), ("4-NOT", 1.0),
                      ("2024-13-01", 1.0)])
    got = [r.d.date().isoformat() if r.d else None for r in L.coerce_date(df, "d").collect()]
    assert got == ["2024-01-05", "2024-01-31", "2024-01-05", "2024-01-05", None, None]


def test_more_date_layouts(spark):
    texts = ["1/5/2024 10:30", "2024/01/05 10:30", "Jan 5, 2024", "05-Jan-2024", "January 5, 2024", "5 Jan 2024", "2024.1.5 08:00:00"]
    got = L.coerce_date(rows(spark, [(t, 1.0) for t in texts]), "d").collect()
    assert [r.d.date().isoformat() for r in got] == ["2024-01-05"] * len(texts) and got[0].d.hour == 10 and got[6].d.hour == 8


def test_day_first_is_decided_once_for_the_column(spark):
    def read(*texts):
        return [r.d.date().isoformat() if r.d else None for r in L.coerce_date(rows(spark, [(t, 1.0) for t in texts]), "d").collect()]
    assert read("13/01/2024", "05/02/2024") == ["2024-01-13", "2024-02-05"]
    assert read("01/13/2024", "05/02/2024") == ["2024-01-13", "2024-05-02"]
    assert read("13/01/2024", "01/13/2024") == [None, "2024-01-13"]
    monthly = L.monthly_series(rows(spark, [("13/01/2024", 1.0), ("05/02/2024", 2.0)]), "d", "m").collect()
    assert [r.total for r in monthly] == [1.0, 2.0]


def test_unknown_column_is_named(spark):
    with pytest.raises(ValueError, match="nope"):
        L.monthly_series(rows(spark, [("2024-01-01", 1.0)]), "nope", "m")


def test_windows_run_on_months_not_on_rows(spark):
    df = spark.range(1000).select(F.expr("date_add(date'2024-01-01', cast(id % 300 as int))").alias("d"),
                                  F.col("id").cast("double").alias("m"))
    plan = L.mom_growth(df, "d", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rfind("Window") < plan.rfind("Aggregate")
