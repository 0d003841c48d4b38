import datetime as dt

import pytest
from pyspark.sql import functions as F

import ledgerlight as L

ALL_ROLES = {"日期": "date", "产品": "product_name", "区域": "region", "客户": "customer_name", "销售额": "revenue",
             "数量": "quantity", "成本": "cost"}


@pytest.fixture(scope="module")
def sales(spark):
    data = [(dt.datetime(2024 + i // 12, i % 12 + 1, 28), "ABC"[i % 3], "NSW"[i % 2], f"c{i % 5}", 100 + 10 * i, i % 4 + 1, 60 + 5 * i)
            for i in range(15)]
    return spark.createDataFrame(data, "`日期` timestamp, `产品` string, `区域` string, `客户` string, `销售额` long, `数量` long, `成本` long")


def test_all_analyses_run(sales):
    report = L.report_suite(sales, ALL_ROLES)
    assert list(report) == [
        "desc_overview", "desc_stats", "time_series", "monthly", "growth", "inflection_points", "annual_summary",
        "yoy_comparison", "top_ranking", "concentration", "pareto_abc", "anomaly_detect", "anomaly_summary", "correlation",
        "rank_correlation", "strong_pairs", "redundant_pairs", "distribution", "region_analysis", "region_extremes",
        "drill_down", "rfm_analysis", "rfm_overview", "simple_forecast", "forecast_fitted", "columns", "roles",
        "cleaning_log", "quality", "insights"]
    assert all(report[n].count() >= 0 for n in report)
    assert report["time_series"].first().period_count == 15
    assert report["redundant_pairs"].count() == 1


def test_task_limit_and_missing_roles(sales):
    assert list(L.report_suite(sales, ALL_ROLES, max_tasks=3)) == [
        "desc_overview", "desc_stats", "time_series", "monthly", "growth", "inflection_points", "annual_summary",
        "yoy_comparison", "columns", "roles", "cleaning_log", "quality", "insights"]
    # no date column: the other analyses still run
    no_date = L.report_suite(sales.drop("日期"), {k: v for k, v in ALL_ROLES.items() if k != "日期"})
    assert "time_series" not in no_date and "pareto_abc" in no_date
    text = sales.select("产品", "区域")
    assert list(L.report_suite(text, {"产品": "product_name", "区域": "region"})) == [
        "desc_overview", "columns", "roles", "cleaning_log", "quality", "insights"]


def test_roles_are_inferred_when_not_given(sales):
    report = L.report_suite(sales)
    # 产品, 区域, 客户 and the numbers are known by name
    assert {"drill_down", "rfm_analysis"} <= set(report)


def test_date_range(sales):
    report = L.report_suite(sales, ALL_ROLES, date_range=("2024-02-01", "2024-06-30"))
    assert report["time_series"].first().period_count == 5
    assert report["desc_overview"].first().row_count == 5


def test_a_failing_analysis_does_not_stop_the_others(sales, tmp_path):
    report = L.report_suite(sales, ALL_ROLES, max_tasks=1)
    report._builders["broken"] = lambda: sales.select("nope")
    status = report.write(str(tmp_path))
    assert status.pop("broken").startswith("error")
    assert set(status.values()) == {"success"}


def test_slim_keeps_aggregates_only(sales):
    report = L.report_suite(sales, ALL_ROLES)
    cut = L.slim(report)
    assert "top_ranking" not in cut and "abc_class" in cut["pareto_abc"].columns
    assert "peak_period" not in cut["time_series"].columns


def test_insights(spark, sales):
    got = L.report_suite(sales, ALL_ROLES)["insights"].collect()
    assert [r.id for r in got] == [f"i{i:02d}" for i in range(len(got))]
    titles = [r.title for r in got]
    assert titles[0] == "The table has 15 records"
    assert titles[1] == "Overall trend up by 140.0%" and got[1].severity == "warning"
    assert titles[2].startswith("High concentration, top five hold 100%")
    assert titles[3].startswith("Good data quality")
    with pytest.raises(ValueError):
        L.insights({})


def test_quality_insight_levels(spark):
    for score, severity in ((49, "critical"), (69, "warning"), (70, "info")):
        q = spark.range(1).select(F.lit(score).alias("score"), F.lit(0).alias("duplicate_rows"), F.lit(2).alias("high_null_columns"))
        assert L.insights({"quality": q}).first().severity == severity


def test_trend_insight_bounds(spark):
    def trend(values):
        rows = [(dt.date(2024 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(values)]
        got = L.insights({"monthly": spark.createDataFrame(rows, "period date, total double")}).collect()
        return [(r.title, r.severity) for r in got]
    assert trend([100, 129]) == [("Overall trend up by 29.0%", "info")]
    assert trend([100, 70]) == [("Overall trend down by 30.0%", "warning")]
    assert trend([0, 70]) == [("Overall trend down by 0.0%", "info")]
    assert trend([5]) == []
    assert trend([1] * 25) == [("Overall trend down by 0.0%", "info")]


def test_facts(sales):
    assert L.monthly_facts(sales, "日期", "销售额").count() == L.monthly_series(sales, "日期", "销售额").count()
    year = L.date_range_filter(sales, "日期", "2024-01-01", "2024-12-31")
    assert L.monthly_facts(year, "日期", "销售额").count() == 12
    shares = [r.share for r in L.region_facts(sales, "区域", "销售额").collect()]
    assert shares == sorted(shares, reverse=True)
