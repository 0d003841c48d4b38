"""Rule-based insights over the results of other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio

# Thresholds of the rules.
TREND_WARNING = 0.3
CR5_WARNING = 0.6
QUALITY_CRITICAL, QUALITY_WARNING = 50, 70
LONG_TAIL_WARNING = 20


def _pct(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(value * 100, digits), F.lit("%"))


def _rule(df: DataFrame, order: int, severity: Column, title: Column, evidence: list[Column], meaning: Column) -> DataFrame:
    return df.select(
        F.lit(order).alias("_order"), title.alias("title"), severity.alias("severity"),
        F.array(*evidence).alias("evidence"), meaning.alias("interpretation"))


def size_insight(overview: DataFrame) -> DataFrame:
    n, c = F.col("row_count").cast("string"), F.col("col_count").cast("string")
    return _rule(overview, 1, F.lit("info"), F.concat(F.lit("The table has "), n, F.lit(" records")),
                 [F.concat(n, F.lit(" rows, "), c, F.lit(" columns"))],
                 F.lit("Groups and periods of this table can be compared."))


def trend_insight(monthly: DataFrame) -> DataFrame:
    """Change from the first to the last month, for series of 2 months or more."""
    ends = monthly.agg(
        F.count("*").alias("n"),
        F.round(F.min_by("total", "period"), 2).alias("first"),
        F.round(F.max_by("total", "period"), 2).alias("last"),
    ).filter(F.col("n") >= 2)
    change = F.coalesce(ratio(F.col("last") - F.col("first"), F.col("first")), F.lit(0.0))
    up = change > 0
    return _rule(
        ends, 2,
        F.when(F.abs(change) < TREND_WARNING, "info").otherwise("warning"),
        F.concat(F.lit("Overall trend "), F.when(up, "up").otherwise("down"), F.lit(" by "), _pct(F.abs(change))),
        [F.concat(F.lit("first "), F.format_number("first", 0), F.lit(", last "), F.format_number("last", 0)),
         F.concat(F.lit("change "), _pct(change))],
        F.when(up, "More came in at the end than at the start.").otherwise("Less came in at the end than at the start."))


def concentration_insight(concentration: DataFrame) -> DataFrame:
    return _rule(
        concentration.filter(F.col("cr5") > CR5_WARNING), 3, F.lit("warning"),
        F.concat(F.lit("High concentration, top five hold "), _pct(F.col("cr5"), 0)),
        [F.concat(F.lit("top five share "), _pct(F.col("cr5")))],
        F.lit("Losing one of these items would be felt in the total."))


def quality_insight(quality: DataFrame) -> DataFrame:
    s = F.col("score")
    low = s < QUALITY_WARNING
    copies = F.concat(F.lit("duplicate rows "), F.col("duplicate_rows").cast("string"))
    empty = F.concat(F.lit("columns with many missing values "), F.col("high_null_columns").cast("string"))
    return _rule(
        quality, 4,
        F.when(s < QUALITY_CRITICAL, "critical").when(low, "warning").otherwise("info"),
        F.concat(F.when(low, "Low").otherwise("Good"), F.lit(" data quality, score "), s.cast("string")),
        [F.when(low, empty).otherwise(copies), copies],
        F.when(low, "Figures below rest on incomplete or repeated rows.").otherwise("Few rows are missing, repeated or far out."),
    ).withColumn("evidence", F.array_distinct("evidence"))


def long_tail_insight(pareto: DataFrame) -> DataFrame:
    tail = pareto.filter((F.col("abc_class") == "C") & (F.col("items") > 0))
    n = F.col("items").cast("string")
    return _rule(
        tail, 5, F.when(F.col("items") > LONG_TAIL_WARNING, "warning").otherwise("info"),
        F.concat(F.lit("Long tail of "), n, F.lit(" class C items")),
        [F.concat(n, F.lit(" class C items bring "), _pct(F.col("revenue_share")))],
        F.lit("Each of these items matters little on its own."))


RULES = {
    "overview": size_insight,
    "monthly": trend_insight,
    "concentration": concentration_insight,
    "quality": quality_insight,
    "pareto": long_tail_insight,
}


def insights(results: dict[str, DataFrame]) -> DataFrame:
    """All insights the given results allow, numbered in the order of the rules.

    Keys: overview, monthly, concentration, quality, pareto; any may be missing.
    """
    parts = [rule(results[name]) for name, rule in RULES.items() if name in results]
    if not parts:
        raise ValueError(f"no usable result; known are {', '.join(RULES)}")
    rows = reduce(DataFrame.unionByName, parts)
    # one row per rule at most
    at = F.row_number().over(Window.orderBy("_order")) - 1
    return rows.withColumn("_at", at).select(
        F.concat(F.lit("i"), F.lpad(F.col("_at").cast("string"), 2, "0")).alias("id"),
        "title", "severity", "evidence", "interpretation")
