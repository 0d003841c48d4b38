"""Column profiles. Each operator scans the table once for all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (
    as_double, as_times, col, floor_days, is_temporal, missing_to_null, numeric_columns, ratio,
    require_columns, rows_from, text_columns,
)
from ..functions.ordering import quantiles_with, settle


def sample_rows(df: DataFrame, n: int = 3, order_by: Sequence[str] = ()) -> DataFrame:
    """The first n rows; give `order_by` for a repeatable choice."""
    return (df.orderBy(*[col(c) for c in order_by]) if order_by else df).limit(n)


def sample_values(df: DataFrame, c: str, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first n values of the column that are present."""
    require_columns(df, [c])
    return sample_rows(df.filter(missing_to_null(df, c).isNotNull()), n, order_by).select(col(c).alias("value"))


def _as_key(df: DataFrame, c: str) -> Column:
    """A short text that differs for different values. Texts go by their SHA-256, so that documents are not shuffled."""
    dtype, v = df.schema[c].dataType, missing_to_null(df, c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (v + 0.0).cast("string")  # -0.0 equals 0.0
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(v).cast("string")  # clock changes repeat local times
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.sha2(v, 256)
    return v.cast("string") if isinstance(dtype, T.AtomicType) else F.to_json(F.struct(v.alias("v")))


def _exact_counts(df: DataFrame) -> DataFrame:
    """One row: n, and per column i its present values f<i> and distinct values d<i>.

    Values are grouped as narrow (column, key) pairs that combine before the
    shuffle, where distinct counts side by side would shuffle rows of all columns.
    """
    pairs = df.select(F.inline(F.array(
        F.struct(F.lit(-1).alias("c"), F.lit("").alias("k")),
        *[F.struct(F.lit(i).alias("c"), F.when(missing_to_null(df, c).isNotNull(), _as_key(df, c)).alias("k"))
          for i, c in enumerate(df.columns)],
    ))).filter("k IS NOT NULL")
    counts = pairs.groupBy("c", "k").agg(F.count("*").alias("n")).groupBy("c").agg(
        F.sum("n").alias("n"), F.count("*").alias("d"))

    def at(i: int, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("c") == i, F.col(name))), F.lit(0))

    return counts.agg(at(-1, "n").alias("_n"), *[
        x for i in range(len(df.columns)) for x in (at(i, "n").alias(f"f{i}"), at(i, "d").alias(f"d{i}"))
    ])


def profile_columns(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """Type, missing values and distinct values of every column.

    `approx=True` counts distinct values by sketch, which needs no shuffle.
    """
    if approx:
        wide = df.agg(F.count("*").alias("_n"), *[
            x for i, c in enumerate(df.columns) for x in (
                F.count(missing_to_null(df, c)).alias(f"f{i}"),
                F.approx_count_distinct(missing_to_null(df, c)).alias(f"d{i}"),
            )
        ])
    else:
        wide = _exact_counts(df)
    return rows_from(wide, [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("_n").alias("row_count"),
            (F.col("_n") - F.col(f"f{i}")).alias("null_count"),
            ratio(F.col("_n") - F.col(f"f{i}"), F.col("_n")).alias("null_rate"),
            F.col(f"d{i}").alias("unique_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ])


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None, *, approx: bool = False) -> DataFrame:
    """Extremes, mean, deviation, quartiles, share of zeros and skew per column, in two scans."""
    cols = numeric_columns(df) if cols is None else list(cols)
    require_columns(df, cols)
    moments = [
        x for c in cols for v in (as_double(df, c),) for x in (
            F.count(v), F.min(v), F.max(v), F.avg(v), F.stddev_samp(v), F.count_if(v == 0), F.skewness(v))
    ]
    q, found = quantiles_with(df, cols, [0.25, 0.5, 0.75], moments, approx=approx) if cols else ({}, ())
    rows = []
    for i, c in enumerate(cols):
        n, low, high, mean, std, zeros, skew = found[7 * i : 7 * i + 7]
        rows.append((c, n, low, high, mean, q[c][1], std, q[c][0], q[c][2], zeros / n if n else None, skew if n > 3 else None))
    schema = "column string, count long, min double, max double, mean double, median double, std double, q1 double, q3 double, zero_rate double, skew double"
    return df.sparkSession.createDataFrame(rows, schema)


def date_like_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_temporal(f.dataType)] + text_columns(df)


def profile_dates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Span and continuity of date columns, and of text columns that are mostly dates.

    Columns with fewer than two dates, or text with at most half of the rows
    parsable, give no row.
    """
    cols = date_like_columns(df) if cols is None else list(cols)
    require_columns(df, cols)
    native = {f.name for f in df.schema.fields if is_temporal(f.dataType)}
    times = df.select(*[t.alias(f"t{i}") for i, t in enumerate(as_times(df, cols).values())])
    # (column, day) pairs that combine before the shuffle; distinct counts side by side would copy every row per column
    days = times.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(f"t{i}").cast("date").alias("day")) for i in range(len(cols))
    ]))).filter("day IS NOT NULL").distinct().groupBy("c").count()
    at = F.map_from_entries(F.collect_list(F.struct("c", "count")))
    counted = days.agg(at.alias("_days"))
    wide = times.agg(F.count("*").alias("_n"), *[
        x for i in range(len(cols)) for x in (
            F.count(f"t{i}").alias(f"n{i}"), F.min(f"t{i}").alias(f"lo{i}"), F.max(f"t{i}").alias(f"hi{i}"),
        )
    ])
    rows = rows_from(wide.withColumn("_days", counted.scalar()), [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("valid"),
            F.col(f"lo{i}").alias("first"), F.col(f"hi{i}").alias("last"),
            floor_days(F.col(f"lo{i}"), F.col(f"hi{i}")).alias("time_span_days"),
            F.coalesce(F.element_at("_days", F.lit(i)), F.lit(0)).alias("distinct_days"),
            (F.lit(c in native) | (F.col(f"n{i}") > F.col("_n") * 0.5)).alias("_is_date"),
        )
        for i, c in enumerate(cols)
    ])
    return rows.filter(F.col("_is_date") & (F.col("valid") >= 2)).drop("_is_date").withColumn(
        "is_continuous", F.col("distinct_days") >= (F.col("time_span_days") + 1) * 0.9)


def profile_text(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Mean length and the k most frequent values per text column; ties go by value."""
    cols = text_columns(df) if cols is None else list(cols)
    require_columns(df, cols)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols
    ]))).filter(F.col("value").isNotNull())
    # counted by digest, which partial sums keep short of the shuffle; the k-th count then bounds which texts are fetched
    digest = F.sha2("value", 256).alias("digest")
    counts = settle(long.select("column", digest, F.length("value").cast("long").alias("length")).groupBy("column", "digest").agg(
        F.count("*").alias("count"), F.min("length").alias("length")))
    lengths = counts.groupBy("column").agg(
        ratio(F.sum(F.col("count") * F.col("length")), F.sum("count")).alias("avg_length"))
    # the rank limit is applied before the shuffle too, so no task sorts a whole column
    often = counts.withColumn("at", F.row_number().over(Window.partitionBy("column").orderBy(F.col("count").desc(), "digest")))
    least = often.filter(F.col("at") <= k).groupBy("column").agg(F.min("count").alias("least"))
    likely = settle(counts.join(F.broadcast(least), "column").filter("count >= least").select("column", "digest", "count"))
    texts = long.withColumn("digest", digest).join(likely, ["column", "digest"]).groupBy("column", "digest", "count").agg(
        F.any_value("value").alias("value"))
    order = Window.partitionBy("column").orderBy(F.col("count").desc(), "value")
    top = (
        texts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("_top"))
    )
    return lengths.join(top, "column").select(
        "column", "avg_length",
        F.transform("_top", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))).alias("top_values"),
    )


def desc_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric columns, and the mean of the column null rates."""
    wide = df.agg(F.count("*").alias("row_count"), *[
        F.count(missing_to_null(df, c)).alias(f"f{i}") for i, c in enumerate(df.columns)
    ])
    present = sum((F.col(f"f{i}") for i in range(len(df.columns))), F.lit(0))
    cells = F.col("row_count") * len(df.columns)
    return wide.select(
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("col_count"),
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_col_count"),
        ratio(cells - present, cells).alias("overall_null_rate"),
    )


def desc_stats(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column."""
    return profile_numeric(df, approx=approx).select(
        "column", "count", "mean", "std", "min", F.col("q1").alias("p25"), F.col("median").alias("p50"),
        F.col("q3").alias("p75"), "max",
    )
