"""Profiles that grow with their table: sketches per partition, kept on disk and merged.

For each partition of a table the store has one row per column: counts, extremes,
mean and squared deviations, a HyperLogLog sketch of the distinct values and a KLL
sketch of the order. Profiling after an append reads the new partitions only, and
the profile of the table merges rows of the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.exprs import as_double, col, is_numeric, missing_to_null, ratio, require_columns

#: Distinct counts are within 2 % (three standard errors), quantiles within 1 % of the ranks in 99 of 100 cases.
HLL_BITS, KLL_SIZE = 14, 800


def stored_parts(spark: SparkSession, store: str) -> list[str]:
    """Partitions that the store knows."""
    try:
        return sorted(r["part"] for r in spark.read.parquet(store).select("part").distinct().collect())
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def update_profile(df: DataFrame, store: str, by: str) -> int:
    """Add the partitions of `df` that the store does not know; their number.

    `by` is the column that the table is partitioned by; its known values are excluded
    by literals, so that a scan of a partitioned table skips their files. A partition
    is taken as it is when it is first seen. A null partition is called ''.
    """
    require_columns(df, [by])
    part = F.coalesce(col(by).cast("string"), F.lit(""))
    known = stored_parts(df.sparkSession, store)
    new = df.filter(~(col(by).cast("string").isin(known) & col(by).isNotNull())) if known else df
    new = new.filter(col(by).isNotNull()) if "" in known else new
    columns = [c for c in df.columns if c != by]
    aggregates = []
    for i, c in enumerate(columns):
        value = missing_to_null(df, c)
        number = as_double(df, c) if is_numeric(df.schema[c].dataType) else F.lit(None).cast("double")
        aggregates += [
            F.count(value).alias(f"n{i}"), F.hll_sketch_agg(value.cast("string"), F.lit(HLL_BITS)).alias(f"hll{i}"),
            F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.avg(number).alias(f"mean{i}"),
            (F.var_pop(number) * F.count(number)).alias(f"m2{i}"), F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)).alias(f"kll{i}"),
        ]
    wide = new.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), *aggregates)
    rows = wide.select("part", "rows", F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            *[F.col(f"{name}{i}").alias(name) for name in ("n", "hll", "lo", "hi", "mean", "m2", "kll")])
        for i, c in enumerate(columns)
    ])))
    rows.write.mode("append").parquet(store)
    return len(stored_parts(df.sparkSession, store)) - len(known)


def stored_profile(spark: SparkSession, store: str) -> DataFrame:
    """One row per column of all partitions: counts, approximate distinct values, extremes, mean, deviation, approximate quartiles."""
    rows = spark.read.parquet(store)
    total = rows.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("all_mean"))
    quantiles = F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])
    merged = rows.join(total, "column").groupBy("column", "all_mean").agg(
        F.min("position").alias("position"), F.max_by("dtype", "part").alias("dtype"), F.sum("rows").alias("row_count"), F.sum("n").alias("n"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("unique_count"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("all_mean")) * (F.col("mean") - F.col("all_mean"))).alias("m2"),
        F.kll_merge_agg_double(F.when(F.col("mean").isNotNull(), F.col("kll"))).alias("kll"))
    q = F.when(F.col("all_mean").isNotNull(), F.kll_sketch_get_quantile_double("kll", quantiles))
    return merged.withColumn("q", q).select(
        "column", "dtype", "row_count", (F.col("row_count") - F.col("n")).alias("null_count"),
        ratio(F.col("row_count") - F.col("n"), F.col("row_count")).alias("null_rate"), "unique_count", "min", "max",
        F.col("all_mean").alias("mean"), F.sqrt(F.try_divide(F.col("m2"), (F.col("n") - 1).cast("double"))).alias("std"),
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
    )
