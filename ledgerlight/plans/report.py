"""The whole analysis of one table, planned from its column roles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, numeric_columns
from ..functions.keywords import CUSTOMER_ROLES, NUMERIC_ROLES, PRODUCT_ROLES
from ..functions.ordering import settle, sort_keys
from ..operators.clean import clean, cleaning_log, quality_score
from ..operators.customers import rfm_overview, rfm_summary
from ..operators.insights import insights
from ..operators.profile import desc_overview, desc_stats, profile_columns
from ..operators.ranking import concentration, drill_down, pareto_summary, region_analysis, region_extremes, top_ranking
from ..operators.roles import infer_roles, roles_dict
from ..operators.series import (
    annual_summary, date_range_filter, forecast_fitted, inflection_points, mom_growth, monthly_series, moving_avg_3,
    simple_forecast, time_series, yoy_summary,
)
from ..operators.stats import (
    anomaly_detect, anomaly_summary, corr_p_values, corr_spearman, distribution, redundant_pairs, strong_pairs,
)

# Columns per analysis that the short form keeps; None for all.
SLIM_FIELDS = {
    "desc_overview": ("row_count", "col_count", "numeric_col_count", "overall_null_rate"),
    "time_series": ("period_count", "total", "mean", "avg_mom", "std_mom", "trend_direction", "trend_magnitude",
                    "cagr", "positive_periods", "negative_periods", "max_growth", "max_decline"),
    "yoy_comparison": ("avg_yoy", "positive_yoy", "negative_yoy", "comparable_periods"),
    "concentration": ("unique_items", "cr1", "cr5", "cr10", "hhi", "above_mean_rate", "mean_per_item",
                      "median_per_item"),
    "pareto_abc": ("abc_class", "items", "revenue_share"),
    "strong_pairs": ("col_a", "col_b", "pearson_r", "spearman_rho", "type"),
    "redundant_pairs": ("col_a", "col_b", "pearson_r", "spearman_rho", "type"),
    "rfm_analysis": ("segment", "customers", "revenue_share"),
    "simple_forecast": ("slope", "r2", "next_forecast", "low_95", "high_95"),
    "anomaly_detect": ("column", "outlier_count", "outlier_rate"),
    "anomaly_summary": ("total_anomalies", "columns_analyzed", "worst_column"),
    "distribution": ("column", "skewness", "kurtosis", "shape"),
    "region_extremes": None,
    "rfm_overview": None,
}


class Report(Mapping):
    """Analyses by name. Each is planned when it is first asked for, so the others cost nothing."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def write(self, path: str, format: str = "parquet") -> dict[str, str]:
        """Write every analysis to its own folder; one that fails does not stop the others."""
        status = {}
        for name in self:
            try:
                self[name].write.mode("overwrite").format(format).save(f"{path}/{name}")
                status[name] = "success"
            except Exception as e:  # noqa: BLE001 - reported per analysis
                status[name] = f"error: {e}"
        return status


class _Plan:
    def __init__(self, df: DataFrame, roles: dict[str, str] | None, approx: bool):
        self.raw, self.approx = df, approx
        self.roles = roles_dict(df, roles)
        # hinted roles keep the order in which they were given
        self.numbers = self.all_of(*NUMERIC_ROLES)
        self.date, self.region = self.first("date"), self.first("region")
        self.product, self.customer = self.first(*PRODUCT_ROLES), self.first(*CUSTOMER_ROLES)
        self.metric = self.first("revenue") or (self.numbers[0] if self.numbers else None)

    def all_of(self, *wanted: str) -> list[str]:
        return [c for c, r in self.roles.items() if r in wanted]

    def first(self, *wanted: str) -> str | None:
        return next(iter(self.all_of(*wanted)), None)

    @cached_property
    def cleaned(self) -> DataFrame:
        """The filled columns that have a role, written once for all analyses."""
        wanted = [c for c in self.raw.columns if c in self.roles]
        return settle(clean(self.raw.select(*[col(c) for c in wanted]), {c: self.roles[c] for c in wanted}, approx=self.approx))

    def analyses(self) -> dict[str, list[tuple[str, Callable[[], DataFrame]]]]:
        """Result tables per analysis, in running order, for the roles that are present."""
        raw, d, m, k, numbers = self.raw, self.date, self.metric, self.product, self.numbers
        dims = [c for c in (k, self.region) if c]
        plan: dict[str, list[tuple[str, Callable[[], DataFrame]]]] = {
            "desc_stats": [("desc_overview", lambda: desc_overview(raw))]
            + ([("desc_stats", lambda: desc_stats(raw, approx=self.approx))] if numeric_columns(raw) else []),
        }
        if d and numbers:
            plan["time_series"] = [
                ("time_series", lambda: time_series(self.cleaned, d, m)),
                ("monthly", lambda: moving_avg_3(self.cleaned, d, m)),
                ("growth", lambda: mom_growth(self.cleaned, d, m)),
                ("inflection_points", lambda: inflection_points(self.cleaned, d, m)),
                ("annual_summary", lambda: annual_summary(self.cleaned, d, m)),
            ]
            plan["yoy_comparison"] = [("yoy_comparison", lambda: yoy_summary(self.cleaned, d, m))]
        if k and m:
            plan["top_ranking"] = [
                ("top_ranking", lambda: top_ranking(self.cleaned, k, m)),
                ("concentration", lambda: concentration(self.cleaned, k, m)),
            ]
            plan["pareto_abc"] = [("pareto_abc", lambda: pareto_summary(self.cleaned, k, m))]
        if numbers:
            plan["anomaly_detect"] = [
                ("anomaly_detect", lambda: anomaly_detect(self.cleaned, numbers, approx=self.approx)),
                ("anomaly_summary", lambda: anomaly_summary(self.cleaned, numbers)),
            ]
        if len(numbers) >= 3:
            plan["correlation"] = [
                ("correlation", lambda: corr_p_values(self.cleaned, numbers)),
                ("rank_correlation", lambda: corr_spearman(self.cleaned, numbers)),
                ("strong_pairs", lambda: strong_pairs(self.cleaned, numbers)),
                ("redundant_pairs", lambda: redundant_pairs(self.cleaned, numbers)),
            ]
        if numbers:
            plan["distribution"] = [("distribution", lambda: distribution(self.cleaned, numbers))]
        if self.region and numbers:
            plan["region_analysis"] = [
                ("region_analysis", lambda: region_analysis(self.cleaned, self.region, m)),
                ("region_extremes", lambda: region_extremes(self.cleaned, self.region, m)),
            ]
        if len(dims) == 2 and m:
            plan["drill_down"] = [("drill_down", lambda: drill_down(self.cleaned, dims, m))]
        if self.customer and d and m:
            plan["rfm_analysis"] = [
                ("rfm_analysis", lambda: rfm_summary(self.cleaned, self.customer, d, m)),
                ("rfm_overview", lambda: rfm_overview(self.cleaned, self.customer, d, m)),
            ]
        if d and numbers:
            plan["simple_forecast"] = [
                ("simple_forecast", lambda: simple_forecast(self.cleaned, d, m)),
                ("forecast_fitted", lambda: forecast_fitted(self.cleaned, d, m)),
            ]
        return plan

    def insights(self) -> DataFrame:
        found = {"overview": desc_overview(self.raw), "quality": quality_score(self.raw, self.roles, approx=self.approx)}
        if self.date and self.numbers:
            found["monthly"] = monthly_series(self.cleaned, self.date, self.metric)
        if self.product and self.metric:
            found["concentration"] = concentration(self.cleaned, self.product, self.metric)
            found["pareto"] = pareto_summary(self.cleaned, self.product, self.metric)
        return insights(found)


def report_suite(
    df: DataFrame,
    roles: dict[str, str] | None = None,
    *,
    max_tasks: int | None = None,
    date_range: tuple[str, str] | None = None,
    approx: bool = False,
) -> Report:
    """Every analysis the roles allow, the quality score and the insights, by name.

    `max_tasks` keeps the first analyses only (3, 6 and 10 are the usual quick,
    standard and deep limits); by default all are kept.
    """
    plan = _Plan(df, roles, approx)
    if date_range and plan.date:
        plan.raw = date_range_filter(df, plan.date, *date_range)
    chosen = list(plan.analyses().values())[:max_tasks]
    builders = {name: build for tables in chosen for name, build in tables}
    builders["columns"] = lambda: profile_columns(plan.raw)
    builders["roles"] = lambda: infer_roles(plan.raw, roles)
    builders["cleaning_log"] = lambda: cleaning_log(plan.raw, plan.roles, approx=approx)
    builders["quality"] = lambda: quality_score(plan.raw, plan.roles, approx=approx)
    builders["insights"] = plan.insights
    return Report(builders)


def slim(results: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The results cut to their key columns; detail tables are left out."""
    return {n: results[n].select(*SLIM_FIELDS[n] or results[n].columns) for n in results if n in SLIM_FIELDS}


def quick_summary(
    df: DataFrame, roles: dict[str, str] | None = None, *, approx: bool = False, order_by: Sequence[str] = (), samples: int = 3,
) -> DataFrame:
    """Rows, columns and their names, quality score, and whether dates and numbers are present.

    With `order_by` also `sample_rows`: the first rows in that order, each as JSON.
    Columns are ascending, or descending after a '-', and should tell rows apart.
    """
    named = roles_dict(df, roles)
    numbers = sum(r in NUMERIC_ROLES for r in named.values())
    has_date = "date" in named.values()
    score = quality_score(df, named, approx=approx)
    shown = []
    if order_by:
        # `samples` rows reach the driver, whatever the table's size
        rows = df.orderBy(*sort_keys(order_by)).limit(samples).select(F.to_json(F.struct("*")).alias("row")).collect()
        shown = [F.array(*[F.lit(r["row"]) for r in rows]).cast("array<string>").alias("sample_rows")]
    return score.select(
        "row_count",
        F.lit(len(df.columns)).alias("col_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
        F.col("score").alias("quality_score"),
        F.lit(has_date).alias("has_date"),
        F.lit(numbers > 0).alias("has_numeric"),
        F.lit(numbers).alias("numeric_columns"), *shown,
    )


def monthly_facts(df: DataFrame, d: str, m: str) -> DataFrame:
    """Months with total and growth."""
    return mom_growth(df, d, m)


def region_facts(df: DataFrame, k: str, m: str) -> DataFrame:
    """Regions by share, largest first."""
    return region_analysis(df, k, m).select("region", "total", "share").orderBy(F.col("share").desc(), "region")
