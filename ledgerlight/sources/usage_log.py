"""Reading and appending the usage log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.usage import month as month_of, since, usage_cost

USAGE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("depth", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("token_input", T.LongType()),
    T.StructField("token_output", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("status", T.StringType()),
])


def parse_usage_lines(lines: DataFrame) -> DataFrame:
    """Records from JSON lines in `value`; broken lines and lines with other fields are skipped."""
    names = F.array_sort(F.array(*[F.lit(n) for n in USAGE_SCHEMA.names]))
    return (
        lines.filter(F.array_sort(F.json_object_keys("value")) == names)
        .select(F.from_json("value", USAGE_SCHEMA).alias("r"))
        .select("r.*")
    )


def read_usage_log(
    spark: SparkSession,
    path: str,
    *,
    format: str = "json",
    tenant: str | None = None,
    day: str | None = None,
    month: str | None = None,
    user: str | None = None,
    days: int | None = None,
    as_of: str | date | None = None,
) -> DataFrame:
    """The log, filtered by tenant, day, month, user or the last `days` days.

    On the partitioned Parquet form the tenant and month filters prune folders.
    """
    if format == "parquet":
        # folder values are text, whatever they look like
        log = spark.read.schema(T.StructType([*USAGE_SCHEMA, T.StructField("month", T.StringType())])).parquet(path)
        if month is not None:
            log = log.filter(F.col("month") == month)
        log = log.drop("month")
    else:
        log = parse_usage_lines(spark.read.text(path))
        if month is not None:
            log = log.filter(month_of() == month)
    if tenant is not None:
        log = log.filter(F.col("tenant_id") == tenant)
    if day is not None:
        log = log.filter(F.col("timestamp").startswith(day))
    if user is not None:
        log = log.filter(F.col("user_id") == user)
    if days is not None:
        log = since(log, days, date.today() if as_of is None else as_of)
    return log.select(*USAGE_SCHEMA.names)


def append_usage_log(df: DataFrame, path: str, *, format: str = "json",
                     prices: dict[str, tuple[float, float]] | None = None) -> None:
    """Append calls, with their cost computed now; `cost_usd` need not be present.

    'json' writes lines with all fields; 'parquet' writes folders by tenant and month.
    """
    priced = usage_cost(df.withColumn("elapsed_seconds", F.round("elapsed_seconds", 1)), prices)
    priced = priced.select(*USAGE_SCHEMA.names)
    if format == "parquet":
        # rows of one folder meet in few files, and a busy tenant is split over several tasks
        placed = priced.withColumn("month", month_of()).hint("rebalance", F.col("tenant_id"), F.col("month"))
        placed.write.mode("append").partitionBy("tenant_id", "month").parquet(path)
    else:
        priced.write.mode("append").option("ignoreNullFields", False).json(path)
