"""Column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000

# Date layouts by the look of the text. The cheap pattern decides, since a
# failing parse is costly and most text columns hold no dates.
ISO_LIKE = r"^[+-]?\d{4,6}(-\d{1,2}(-\d{1,2}([T ].*)?)?)?$"
CLOCK = r"( \d{1,2}:\d{1,2}(:\d{1,2})?)?$"
DATE_FORMATS = {
    r"^\d{4}/\d{1,2}/\d{1,2}" + CLOCK: "yyyy/M/d[ H:m[:s]]",
    r"^\d{4}\.\d{1,2}\.\d{1,2}" + CLOCK: "yyyy.M.d[ H:m[:s]]",
    r"^\d{8}$": "yyyyMMdd",
    r"^[A-Za-z]{3} \d{1,2}, \d{4}" + CLOCK: "MMM d, yyyy[ H:m[:s]]",
    r"^[A-Za-z]{4,9} \d{1,2}, \d{4}" + CLOCK: "MMMM d, yyyy[ H:m[:s]]",
    r"^\d{1,2}-[A-Za-z]{3}-\d{4}" + CLOCK: "d-MMM-yyyy[ H:m[:s]]",
    r"^\d{1,2} [A-Za-z]{3} \d{4}" + CLOCK: "d MMM yyyy[ H:m[:s]]",
}
# Which comes first is decided once for the column.
SLASHED = r"^(\d{1,2})/(\d{1,2})/\d{4}" + CLOCK
MONTH_FIRST, DAY_FIRST = "M/d/yyyy[ H:m[:s]]", "d/M/yyyy[ H:m[:s]]"


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; have {', '.join(df.columns)}")


def money(name: str) -> Column:
    """Exact money value: decimal sums do not depend on the order of the rows."""
    return col(name).cast("decimal(18,4)")


def ratio(num: Column, den: Column) -> Column:
    """Division that is NULL, not an error, at a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def missing_to_null(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing, as well as NULL."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def as_double(df: DataFrame, name: str) -> Column:
    return missing_to_null(df, name).cast("double")


def _day_first(df: DataFrame, name: str) -> Column:
    """Whether the column's slashed dates start with the day: some first number is no month, and no second one is a day only."""
    parts = df.select(F.trim(col(name)).alias("t")).filter(F.col("t").rlike(SLASHED)).select(
        *[F.regexp_extract("t", SLASHED, i).cast("int").alias(f"p{i}") for i in (1, 2)])
    return parts.agg(F.coalesce((F.max("p1") > 12) & (F.max("p2") <= 12), F.lit(False))).scalar()


def as_time(df: DataFrame, name: str, formats: dict[str, str] = DATE_FORMATS, *, day_first: bool | None = None) -> Column:
    """The column as a zone-less timestamp; text that is no date becomes NULL.

    Dates like 13/01/2024 are read month first unless the column shows that days
    come first, which takes a scan of it; `day_first` settles that without one.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        text = F.trim(col(name))
        parsed = F.when(text.rlike(ISO_LIKE), text.try_cast("timestamp_ntz"))
        for look, layout in formats.items():
            parsed = parsed.when(text.rlike(look), F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz"))
        first = _day_first(df, name) if day_first is None else F.lit(day_first)
        month = F.try_to_timestamp(text, F.lit(MONTH_FIRST))
        day = F.try_to_timestamp(text, F.lit(DAY_FIRST))
        return parsed.when(text.rlike(SLASHED), F.when(first, day).otherwise(month).cast("timestamp_ntz"))
    if is_temporal(dtype):
        return col(name).cast("timestamp_ntz")
    if is_numeric(dtype):
        # numbers count nanoseconds since the epoch
        return F.timestamp_micros(F.floor(col(name) / 1000).cast("long")).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def day_first(df: DataFrame, names: Sequence[str]) -> dict[str, bool]:
    """Which text columns write dates day first, of all columns in one scan; see `as_time`."""
    texts = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    if not texts:
        return {}
    slashed = [F.when(F.trim(col(n)).rlike(SLASHED), F.trim(col(n))) for n in texts]
    most = df.agg(*[F.max(F.regexp_extract(t, SLASHED, i).cast("int")) for t in slashed for i in (1, 2)]).first()
    return {n: (most[2 * k] or 0) > 12 and most[2 * k + 1] <= 12 for k, n in enumerate(texts)}


def as_times(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """`as_time` of several columns, whose order of day and month takes one scan for all."""
    first = day_first(df, names)
    return {n: as_time(df, n, day_first=first.get(n, False)) for n in names}


def floor_days(start: Column, end: Column) -> Column:
    """Whole days between two times, rounded down; the time of day counts."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(DAY_US)).cast("long")


def with_total(grouped: DataFrame, value: str) -> Column:
    """Sum of `value` over a grouped table, as a scalar subquery.

    No window over the whole table, so the groups stay where they are.
    """
    return grouped.agg(F.sum(col(value))).scalar()


def literal_rows(spark: SparkSession, structs: Sequence[Column]) -> DataFrame:
    """A small table of literals, made inside the JVM."""
    return spark.range(1).select(F.inline(F.array(*structs)))


def rows_from(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn one wide aggregate row into one row per struct."""
    return df.select(F.inline(F.array(*structs)))
