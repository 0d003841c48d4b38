"""Rankings, concentration and ABC classes of a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, missing_to_null, ratio, require_columns, with_total
from ..functions.ordering import exact_quantiles, running_totals, settle


def item_totals(df: DataFrame, k: str, m: str) -> DataFrame:
    """One row per item with its sum; rows without an item do not count."""
    require_columns(df, [k, m])
    return (
        df.select(missing_to_null(df, k).alias("item"), missing_to_null(df, m).alias("_m"))
        .filter(F.col("item").isNotNull())
        .groupBy("item")
        .agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("total"))
    )


def top_ranking(df: DataFrame, k: str, m: str, top: int = 10, bottom: int = 5) -> DataFrame:
    """The first `top` and last `bottom` items by total; equal totals go by item."""
    totals = settle(item_totals(df, k, m))
    best = totals.orderBy(F.col("total").desc(), "item").limit(top)
    worst = totals.orderBy("total", F.col("item").desc()).limit(bottom)
    sides = [rows.select(F.lit(side).alias("side"), "item", F.col("total").cast("double").alias("sum"))
             for side, rows in (("top", best), ("bottom", worst))]
    order = Window.partitionBy("side").orderBy(F.col("sum").desc(), "item")
    ranked = sides[0].unionByName(sides[1]).withColumn("rank", F.row_number().over(order))
    return ranked.select("side", "rank", "item", F.col("sum").alias("total"))


def concentration(df: DataFrame, k: str, m: str, high: float = 0.7, medium: float = 0.4) -> DataFrame:
    """Shares of the 1, 5 and 10 largest items, HHI, and the items above the mean.

    The shares are 0 and HHI is NULL where the total is not positive.
    """
    totals = settle(item_totals(df, k, m))
    value = F.col("total").cast("double")
    mean = totals.agg(F.avg(value)).scalar()
    sums = totals.agg(
        F.count("*").alias("unique_items"),
        F.sum("total").cast("double").alias("total"),
        F.sum(value * value).alias("_squares"),
        F.avg(value).alias("mean_per_item"),
        F.count_if(value > mean).alias("_above"),
    )
    leaders = totals.orderBy(F.col("total").desc(), "item").limit(10)
    leaders = leaders.withColumn("_rn", F.row_number().over(Window.orderBy(F.col("total").desc(), "item")))
    heads = leaders.agg(*[
        F.coalesce(F.sum(F.when(F.col("_rn") <= n, F.col("total"))).cast("double"), F.lit(0.0)).alias(f"_top{n}")
        for n in (1, 5, 10)
    ])
    median = exact_quantiles(totals, ["total"], [0.5])["total"][0]
    tops = {n: heads.select(f"_top{n}").scalar() for n in (1, 5, 10)}
    positive = F.col("total") > 0
    share = {n: F.when(positive, ratio(tops[n], F.col("total"))).otherwise(0.0) for n in tops}
    out = sums.select(
        "unique_items", "total",
        *[share[n].alias(f"cr{n}") for n in (1, 5, 10)],
        F.when(positive, ratio(F.col("_squares"), F.col("total") * F.col("total"))).alias("hhi"),
        "mean_per_item",
        F.lit(median).cast("double").alias("median_per_item"),
        ratio(F.col("_above"), F.col("unique_items")).alias("above_mean_rate"),
    )
    return out.withColumn(
        "band",
        F.when(F.col("cr5") > high, "high").when(F.col("cr5") > medium, "medium").otherwise("low"),
    )


def pareto_abc(df: DataFrame, k: str, m: str, a: float = 0.7, b: float = 0.9) -> DataFrame:
    """Items with their cumulative share, counted with the item itself, and their class."""
    totals = item_totals(df, k, m)
    run = running_totals(totals, {"total": "cum_total"}, ["-total", "item"])
    whole = with_total(run, "total")
    out = run.select(
        "item",
        F.col("total").cast("double").alias("total"),
        ratio(F.col("cum_total"), whole).alias("cum_share"),
        ratio(F.col("total"), whole).alias("share"),
    )
    return out.withColumn(
        "abc_class",
        F.when(F.col("cum_share") <= a, "A").when(F.col("cum_share") <= b, "B").when(F.col("cum_share") > b, "C"),
    )


def pareto_summary(df: DataFrame, k: str, m: str, a: float = 0.7, b: float = 0.9) -> DataFrame:
    """Item count and revenue share of the classes A, B and C; empty classes are kept."""
    items = pareto_abc(df, k, m, a, b)
    return items.agg(*[
        x for c in ("A", "B", "C") for x in (
            F.count_if(F.col("abc_class") == c).alias(f"n{c}"),
            F.sum(F.when(F.col("abc_class") == c, F.col("share"))).alias(f"s{c}"),
        )
    ]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("abc_class"), F.col(f"n{c}").alias("items"),
                 F.coalesce(F.col(f"s{c}"), F.lit(0.0)).alias("revenue_share"))
        for c in ("A", "B", "C")
    ])))


def region_analysis(df: DataFrame, k: str, m: str) -> DataFrame:
    """Sum, mean, count and share per region; shares are 0 if the total is not positive."""
    require_columns(df, [k, m])
    grouped = (
        df.select(missing_to_null(df, k).alias("region"), missing_to_null(df, m).alias("_m"))
        .filter(F.col("region").isNotNull())
        .groupBy("region")
        .agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_sum"), F.count("_m").alias("count"))
    )
    total = with_total(grouped, "_sum")
    return grouped.select(
        "region",
        F.col("_sum").cast("double").alias("total"),
        F.when(total > 0, ratio(F.col("_sum"), total)).otherwise(0.0).alias("share"),
        ratio(F.col("_sum"), F.col("count")).alias("mean"),
        "count",
    )


def region_extremes(df: DataFrame, k: str, m: str) -> DataFrame:
    """Number of regions, the total, and the regions with most and least."""
    r = region_analysis(df, k, m)
    return r.agg(
        F.count("*").alias("region_count"),
        F.sum("total").alias("total"),
        F.min_by("region", F.struct(-F.col("total"), "region")).alias("top_region"),
        F.max_by("region", F.struct(-F.col("total"), "region")).alias("bottom_region"),
    )


def drill_down(df: DataFrame, keys: list[str], m: str) -> DataFrame:
    """Sum and share of every combination of two (or more) dimensions."""
    if len(keys) < 2:
        raise ValueError("drill_down needs at least two dimensions")
    require_columns(df, [*keys, m])
    rows = df.select(*[missing_to_null(df, k).alias(k) for k in keys], missing_to_null(df, m).alias("_m"))
    grouped = rows.dropna(subset=keys).groupBy(*[col(k) for k in keys]).agg(
        F.coalesce(F.sum("_m"), F.lit(0)).alias("_sum"))
    total = with_total(grouped, "_sum")
    return grouped.select(
        *[col(k) for k in keys],
        F.col("_sum").cast("double").alias("total"),
        F.when(total > 0, ratio(F.col("_sum"), total)).otherwise(0.0).alias("share"),
    )


def drill_down_cube(df: DataFrame, keys: list[str], m: str) -> DataFrame:
    """Sum and share at every level: for each subset of the dimensions, those left out are NULL.

    `level` counts the dimensions of a row, and `grouping_id` has a bit for each one
    left out, the first dimension's the highest. Shares are of the level's total and
    0 if that is not positive. Rows with a missing dimension are left out at all
    levels. Combinations are summed once, and the levels from those sums.
    """
    if len(keys) < 2:
        raise ValueError("drill_down_cube needs at least two dimensions")
    require_columns(df, [*keys, m])
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[missing_to_null(df, k).alias(n) for k, n in zip(keys, names)], missing_to_null(df, m).alias("_m"))
    lowest = settle(rows.dropna(subset=names).groupBy(*names).agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_sum")))
    levels = lowest.cube(*names).agg(F.sum("_sum").alias("_sum"), F.grouping_id().alias("grouping_id"))
    total = with_total(lowest, "_sum")
    return levels.filter(F.col("_sum").isNotNull()).select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        "grouping_id", (F.lit(len(keys)) - F.bit_count("grouping_id")).cast("int").alias("level"),
        F.col("_sum").cast("double").alias("total"),
        F.when(total > 0, ratio(F.col("_sum"), total)).otherwise(0.0).alias("share"),
    )


def drill_down_top(df: DataFrame, keys: list[str], m: str, n: int = 3) -> DataFrame:
    """The n combinations with the largest share."""
    return drill_down(df, keys, m).orderBy(F.col("share").desc(), *[col(k) for k in keys]).limit(n)
