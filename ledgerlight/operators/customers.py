"""Recency, frequency and monetary value of customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_time, floor_days, missing_to_null, ratio, require_columns, with_total
from ..functions.ordering import rows_at_ranks, settle


def rfm_values(df: DataFrame, c: str, d: str, m: str) -> DataFrame:
    """Days since the last order (from one day after the newest), orders, and revenue."""
    require_columns(df, [c, d, m])
    rows = df.select(
        missing_to_null(df, c).alias("customer"), as_time(df, d).alias("_t"), missing_to_null(df, m).alias("_m")
    ).dropna()
    per = rows.groupBy("customer").agg(
        F.max("_t").alias("_last"), F.count("_t").alias("frequency"), F.sum("_m").alias("monetary"))
    as_of = per.agg(F.max("_last") + F.expr("interval 1 day")).scalar()
    return per.select("customer", floor_days(F.col("_last"), as_of).alias("recency"), "frequency", "monetary")


def _cuts(values: DataFrame, customers: int) -> dict[str, list]:
    """The four customers per measure after which the next fifth begins.

    Rank r of n falls into fifth ceil(5(r-1)/(n-1)), so fifth j ends at rank
    1 + j(n-1)/5, rounded down. Equal values rank by customer.
    """
    long = values.select("customer", F.inline(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(name).cast("decimal(38,4)" if decimal else "double").alias("v"))
        for name, decimal in _measures(values)
    ])))
    ranks = [1 + j * (customers - 1) // 5 for j in (1, 2, 3, 4)]
    return rows_at_ranks(long, "measure", ["v", "customer"], {n: ranks for n, _ in _measures(values)})


def _measures(values: DataFrame) -> list[tuple[str, bool]]:
    decimal = values.schema["monetary"].dataType.typeName() == "decimal"
    return [("recency", decimal), ("frequency", decimal), ("monetary", decimal)]


def _fifth(name: str, cuts: list) -> Column:
    value, who = F.col(name), F.col("customer")
    return sum(
        (F.when((value > F.lit(r["v"])) | ((value == F.lit(r["v"])) & (who > F.lit(r["customer"]))), 1).otherwise(0)
         for r in cuts),
        F.lit(1),
    )


def rfm_scores(df: DataFrame, c: str, d: str, m: str) -> DataFrame:
    """Scores 1 to 5 per measure by fifths of the ranked customers; recent is high.

    Only 12 cut points are looked up; scoring is then a projection. Fewer than
    two customers give no rows.
    """
    values = settle(rfm_values(df, c, d, m))
    n = values.count()
    if n < 2:
        cuts = {"recency": [], "frequency": [], "monetary": []}
        values = values.limit(0)
    else:
        cuts = _cuts(values, n)
    scored = values.select(
        "customer", "recency", "frequency", F.col("monetary"),
        (F.lit(6) - _fifth("recency", cuts["recency"])).alias("r_score"),
        _fifth("frequency", cuts["frequency"]).alias("f_score"),
        _fifth("monetary", cuts["monetary"]).alias("m_score"),
    )
    return scored.withColumn("monetary", F.col("monetary").cast("double")).withColumn(
        "rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def rfm_segments(df: DataFrame, c: str, d: str, m: str) -> DataFrame:
    """Scores with the customer segment; the first rule that holds decides."""
    r, f, v = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return rfm_scores(df, c, d, m).withColumn(
        "segment",
        F.when((r >= 4) & (f >= 4) & (v >= 4), "high_value")
        .when((r >= 3) & (f <= 3) & (v >= 3), "important_develop")
        .when((r <= 2) & (f >= 3) & (v >= 3), "important_retain")
        .when((r >= 3) & (f <= 3) & (v <= 3), "general")
        .when((r <= 2) & (f <= 2), "at_risk")
        .otherwise("general"),
    )


def rfm_summary(df: DataFrame, c: str, d: str, m: str) -> DataFrame:
    """Customers, revenue share and mean R, F, M per segment."""
    grouped = rfm_segments(df, c, d, m).groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.sum("monetary").alias("revenue"),
        F.avg("recency").alias("r_mean"),
        F.avg("frequency").alias("f_mean"),
        F.avg("monetary").alias("m_mean"),
    )
    return grouped.select("*", ratio(F.col("revenue"), with_total(grouped, "revenue")).alias("revenue_share"))


def rfm_overview(df: DataFrame, c: str, d: str, m: str) -> DataFrame:
    """Number of customers and the means of the three measures."""
    return rfm_values(df, c, d, m).agg(
        F.count("*").alias("total_customers"),
        F.avg("recency").alias("r_mean"),
        F.avg("frequency").alias("f_mean"),
        F.avg(F.col("monetary").cast("double")).alias("m_mean"),
    )
