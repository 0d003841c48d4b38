"""Monthly series: growth, moving average, turning points, year over year, forecast.

Every operator takes an optional `by`, so many series are computed at once.
Without it the windows run over one row per month, which stays small whatever
the size of the input; the input itself is only ever pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_time, col, is_temporal, missing_to_null, ratio, require_columns


def date_range_filter(df: DataFrame, d: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keep rows with start <= d < end + 1 day; both days are included."""
    require_columns(df, [d])
    dtype = df.schema[d].dataType
    # A typed date column is compared as it is, so that the scan can prune by it.
    value = col(d) if is_temporal(dtype) else as_time(df, d)
    kind = dtype if is_temporal(dtype) else "timestamp_ntz"
    if start is not None:
        df = df.filter(value >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(value < F.date_add(F.lit(end).cast("date"), 1).cast(kind))
    return df


def coerce_date(df: DataFrame, d: str) -> DataFrame:
    """Parse the column; text that is no date becomes NULL."""
    require_columns(df, [d])
    return df.withColumn(d, as_time(df, d))


def drop_null_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a missing value in any of the columns."""
    require_columns(df, cols)
    keep = F.lit(True)
    for c in cols:
        keep = keep & missing_to_null(df, c).isNotNull()
    return df.filter(keep)


def _by(by: Sequence[str]) -> list[Column]:
    return [col(b) for b in by]


def _months(by: Sequence[str]):
    return Window.partitionBy(*_by(by)).orderBy("period")


def monthly_series(df: DataFrame, d: str, m: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of `m` per month-end `period`; months without rows count 0."""
    require_columns(df, [d, m, *by])
    sums = (
        drop_null_keys(df.select(*_by(by), as_time(df, d).alias("_t"), missing_to_null(df, m).alias("_m")),
                       ["_t", "_m"])
        .groupBy(*_by(by), F.trunc(F.col("_t").cast("date"), "MM").alias("_month"))
        .agg(F.sum("_m").cast("double").alias("_sum"))
    )
    # each month also emits the empty months before the next one
    nxt = F.lead("_month").over(Window.partitionBy(*_by(by)).orderBy("_month"))
    run = F.sequence("_month", F.coalesce(F.add_months(nxt, -1), F.col("_month")), F.expr("interval 1 month"))
    return (
        sums.withColumn("_run", run)
        .select(*_by(by), "_month", "_sum", F.explode("_run").alias("_at"))
        .select(
            *_by(by),
            F.last_day("_at").alias("period"),
            F.when(F.col("_at") == F.col("_month"), F.col("_sum")).otherwise(F.lit(0.0)).alias("total"),
        )
    )


def _growth(by: Sequence[str]) -> Column:
    prev = F.lag("total").over(_months(by))
    return ratio(F.col("total") - prev, prev)


def mom_growth(df: DataFrame, d: str, m: str, by: Sequence[str] = ()) -> DataFrame:
    """Month-over-month growth; NULL for the first month and after a zero month."""
    return monthly_series(df, d, m, by).withColumn("growth", _growth(by))


def _ma3(by: Sequence[str]) -> Column:
    return F.avg("total").over(_months(by).rowsBetween(-2, 0))


def moving_avg_3(df: DataFrame, d: str, m: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of this month and the two before, or of as many as there are."""
    return monthly_series(df, d, m, by).withColumn("ma3", _ma3(by))


def series_table(df: DataFrame, d: str, m: str, by: Sequence[str] = ()) -> DataFrame:
    """period, total, growth and moving average in one table."""
    return monthly_series(df, d, m, by).withColumn("growth", _growth(by)).withColumn("ma3", _ma3(by))


def inflection_points(df: DataFrame, d: str, m: str, by: Sequence[str] = ()) -> DataFrame:
    """Months in which growth changes its sign."""
    s = mom_growth(df, d, m, by)
    s = s.withColumn("_prev", F.lag("growth").over(_months(by)))
    return (
        s.filter(F.col("growth") * F.col("_prev") < 0)
        .withColumn("direction", F.when(F.col("growth") > 0, "up").otherwise("down"))
        .select(*_by(by), "period", "growth", "direction")
    )


def time_series(df: DataFrame, d: str, m: str, by: Sequence[str] = ()) -> DataFrame:
    """One summary row per series: size, extremes, growth statistics, trend, CAGR."""
    s = series_table(df, d, m, by)
    first_ma, last_ma = F.min_by("ma3", "period"), F.max_by("ma3", "period")
    first, last = F.min_by("total", "period"), F.max_by("total", "period")
    n = F.count("*")
    change = F.abs(last_ma - first_ma)
    return s.groupBy(*_by(by)).agg(
        n.alias("period_count"),
        F.sum("total").alias("total"),
        F.avg("total").alias("mean"),
        F.min_by("period", F.struct(-F.col("total"), "period")).alias("peak_period"),
        F.min_by("period", F.struct("total", "period")).alias("trough_period"),
        F.avg("growth").alias("avg_mom"),
        F.stddev_samp("growth").alias("std_mom"),
        F.count_if(F.col("growth") > 0).alias("positive_periods"),
        F.count_if(F.col("growth") < 0).alias("negative_periods"),
        F.max("growth").alias("max_growth"),
        F.min("growth").alias("max_decline"),
        F.when(n < 2, "insufficient").when(last_ma > first_ma, "up").otherwise("down").alias("trend_direction"),
        F.when((n < 2) | (first_ma == 0), 0.0).otherwise(ratio(change, F.abs(first_ma))).alias("trend_magnitude"),
        F.when((n >= 12) & (first > 0) & (last > 0),
               F.pow(ratio(last, first), F.lit(12.0) / n) - 1).alias("cagr"),
    )


def annual_summary(df: DataFrame, d: str, m: str, by: Sequence[str] = (), over: int = 24) -> DataFrame:
    """Condensed form of a series of more than `over` months: years, then the last 12 months.

    `kind` is 'year' (label yyyy) or 'month' (label yyyy-MM-dd); shorter series give no rows.
    """
    whole = Window.partitionBy(*_by(by))
    s = series_table(df, d, m, by).withColumn("_n", F.count("*").over(whole)).filter(F.col("_n") > over)
    years = s.groupBy(*_by(by), F.year("period").alias("_y")).agg(F.sum("total").alias("total"))
    latest = Window.partitionBy(*_by(by)).orderBy(F.col("period").desc())
    recent = s.withColumn("_rn", F.row_number().over(latest)).filter("_rn <= 12")
    none = F.lit(None).cast("double")
    return years.select(
        *_by(by), F.lit("year").alias("kind"), F.col("_y").cast("string").alias("label"), "total",
        none.alias("ma3"), none.alias("growth"),
    ).unionByName(recent.select(
        *_by(by), F.lit("month").alias("kind"), F.col("period").cast("string").alias("label"), "total",
        "ma3", "growth",
    ))


def yoy_comparison(df: DataFrame, d: str, m: str, by: Sequence[str] = ()) -> DataFrame:
    """Growth against the same month a year before; months after a zero are skipped."""
    s = monthly_series(df, d, m, by).withColumn("prior", F.lag("total", 12).over(_months(by)))
    return s.filter(F.col("prior") != 0).withColumn("yoy", ratio(F.col("total") - F.col("prior"), F.col("prior")))


def yoy_summary(df: DataFrame, d: str, m: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sign counts of the yearly growth, taken at four decimals."""
    v = F.round("yoy", 4)
    return yoy_comparison(df, d, m, by).groupBy(*_by(by)).agg(
        F.avg(v).alias("avg_yoy"),
        F.count("*").alias("comparable_periods"),
        F.count_if(v > 0).alias("positive_yoy"),
        F.count_if(v < 0).alias("negative_yoy"),
    )


def _fit(s: DataFrame, by: Sequence[str], min_periods: int) -> DataFrame:
    x, y = F.col("_x"), F.col("total")
    indexed = s.withColumn("_x", (F.row_number().over(_months(by)) - 1).cast("double"))
    return (
        indexed.groupBy(*_by(by))
        .agg(
            F.count("*").alias("periods"),
            F.max("period").alias("last_period"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            # a constant series has r2 0, its residuals are 0
            F.coalesce(F.when(F.var_pop(y) > 0, F.regr_r2(y, x)), F.lit(0.0)).alias("r2"),
            F.sqrt(F.greatest(F.lit(0.0), ratio(F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x),
                                                 F.count("*")))).alias("sigma"),
        )
        .filter(F.col("periods") >= min_periods)
    )


def simple_forecast(df: DataFrame, d: str, m: str, by: Sequence[str] = (), min_periods: int = 12) -> DataFrame:
    """Straight line through the months, next month's value and its 80 % and 95 % bands."""
    f = _fit(monthly_series(df, d, m, by), by, min_periods)
    nxt = F.col("slope") * F.col("periods") + F.col("intercept")
    return f.select(
        *_by(by), "periods", "slope", "intercept", "r2", "sigma",
        F.last_day(F.add_months(F.trunc("last_period", "MM"), 1)).alias("next_period"),
        nxt.alias("next_forecast"),
        (nxt - 1.28 * F.col("sigma")).alias("low_80"),
        (nxt + 1.28 * F.col("sigma")).alias("high_80"),
        (nxt - 1.96 * F.col("sigma")).alias("low_95"),
        (nxt + 1.96 * F.col("sigma")).alias("high_95"),
    )


def forecast_fitted(df: DataFrame, d: str, m: str, by: Sequence[str] = (), min_periods: int = 12) -> DataFrame:
    """Fitted value of the line for every month."""
    w = Window.partitionBy(*_by(by))
    x, y = F.col("_x"), F.col("total")
    s = monthly_series(df, d, m, by).withColumn("_x", (F.row_number().over(_months(by)) - 1).cast("double"))
    return (
        s.withColumn("_n", F.count("*").over(w))
        .filter(F.col("_n") >= min_periods)
        .withColumn("fitted", F.regr_slope(y, x).over(w) * x + F.regr_intercept(y, x).over(w))
        .select(*_by(by), "period", "total", "fitted")
    )
