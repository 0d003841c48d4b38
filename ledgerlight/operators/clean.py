"""Role-aware cleaning and the quality score. Rows are marked, never deleted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import as_double, as_times, col, missing_to_null, ratio, require_columns, rows_from
from ..functions.keywords import LABEL_ROLES, NUMERIC_ROLES
from ..functions.ordering import exact_quantiles, settle
from .roles import roles_dict
from .stats import iqr_bounds, outside

# Fixed values of the score.
NULL_RATE_LIMIT, NULL_PENALTY = 0.2, 10
OUTLIER_RATE_LIMIT, OUTLIER_PENALTY = 0.05, 5
DUPLICATE_PENALTY = 50


def _copies(df: DataFrame) -> DataFrame:
    """Distinct contents that occur more than once, with their row count.

    First only 8-byte row hashes are shuffled; whole rows are grouped just for
    hashes seen twice. Counts combine before the shuffle. The hashes are written
    first, so that adaptive execution can split the rows of a hash by their size.
    """
    rows = df.withColumn("_h", F.xxhash64(*[col(c) for c in df.columns]))
    seen = settle(rows.groupBy("_h").agg(F.count("*").alias("_c")).filter("_c > 1"))
    suspects = rows.join(seen, "_h", "left_semi")
    return suspects.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("copies")).filter("copies > 1")


def find_duplicates(df: DataFrame) -> DataFrame:
    """Rows that have an equal, all copies counted, and the number of such groups."""
    return _copies(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicate_rows"),
        F.count("*").alias("duplicate_groups"),
    )


def mark_duplicates(df: DataFrame, flag: str = "is_duplicate") -> DataFrame:
    """Flag every row that has an equal."""
    keys = [col(c).alias(f"_k{i}") for i, c in enumerate(df.columns)]
    copied = settle(_copies(df).select(*keys, "copies"))
    same = reduce(lambda a, b: a & b, [col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(df.columns)])
    return df.join(copied, same, "left").select(*[col(c) for c in df.columns], F.col("copies").isNotNull().alias(flag))


def medians(df: DataFrame, cols: Sequence[str], *, approx: bool = False) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, cols, [0.5], approx=approx).items()}


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest of equals; grouped by value, not in one map."""
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    parts = [[c] for c in cols if c not in texts] + ([texts] if texts else [])
    found = {}
    # text columns share one scan; other types are compared in their own type
    for part in parts:
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("c"), missing_to_null(df, c).alias("v")) for c in part
        ]))).filter("v IS NOT NULL")
        best = long.groupBy("c", "v").count().groupBy("c").agg(
            F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v"))
        found.update({r["c"]: r["v"] for r in best.collect()})
    return {c: found.get(c) for c in cols}


def fill_median(df: DataFrame, cols: Sequence[str], *, approx: bool = False) -> DataFrame:
    """Missing numbers become the column's median; filled columns are doubles."""
    require_columns(df, cols)
    values = medians(df, cols, approx=approx)
    return df.withColumns({c: F.coalesce(as_double(df, c), F.lit(v).cast("double")) for c, v in values.items()})


def fill_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing labels become the column's most frequent value."""
    require_columns(df, cols)
    return df.withColumns({
        c: F.coalesce(missing_to_null(df, c), F.lit(v).cast(df.schema[c].dataType)) for c, v in modes(df, cols).items()
    })


def mark_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5, *, approx: bool = False) -> DataFrame:
    """Add a flag `<column>_outlier` per column: strictly outside the quartile fences."""
    require_columns(df, cols)
    fences = iqr_bounds(df, cols, k, approx=approx)
    return df.withColumns({f"{c}_outlier": outside(df, c, fences[c]) for c in cols})


def _by_kind(df: DataFrame, roles: dict[str, str] | None) -> tuple[list[str], list[str], list[str]]:
    named = roles_dict(df, roles)
    return tuple([c for c in df.columns if named.get(c) in kind] for kind in (("date",), NUMERIC_ROLES, LABEL_ROLES))


def clean(df: DataFrame, roles: dict[str, str] | None = None, *, mark: bool = False, approx: bool = False) -> DataFrame:
    """Parse dates, fill numbers by median and labels by mode; `mark` adds outlier and copy flags."""
    dates, numbers, labels = _by_kind(df, roles)
    out = mark_duplicates(df) if mark else df
    if dates:
        out = out.withColumns(as_times(df, dates))
    if numbers:
        out = fill_median(out, numbers, approx=approx)
    if labels:
        out = fill_mode(out, labels)
    return mark_outliers(out, numbers, approx=approx) if mark and numbers else out


def _column_facts(df: DataFrame, roles: dict[str, str] | None, approx: bool) -> DataFrame:
    """Per column: rows, missing values before the fill, and outliers after it, in one scan."""
    dates, numbers, labels = _by_kind(df, roles)
    middle = medians(df, numbers, approx=approx)
    filled = df.withColumns({c: F.coalesce(as_double(df, c), F.lit(middle[c]).cast("double")) for c in numbers})
    fences = iqr_bounds(filled, numbers, approx=approx)
    wide = df.agg(F.count("*").alias("_n"), *[
        x for i, c in enumerate(df.columns) for x in (
            (F.count("*") - F.count(missing_to_null(df, c))).alias(f"null{i}"),
            # the median lies between the fences, so a filled row is never an outlier
            (F.count_if(outside(df, c, fences[c])) if c in fences else F.lit(None).cast("long")).alias(f"out{i}"),
        )
    ])
    kind = {**{c: "date" for c in dates}, **{c: "number" for c in numbers if middle[c] is not None},
            **{c: "label" for c in labels}}
    return rows_from(wide, [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kind.get(c, "other")).alias("kind"),
            F.col("_n").alias("rows"), F.col(f"null{i}").alias("nulls"), F.col(f"out{i}").alias("outliers"),
        )
        for i, c in enumerate(df.columns)
    ])


def cleaning_log(
    df: DataFrame, roles: dict[str, str] | None = None, *, approx: bool = False, unparsed: bool = False,
) -> DataFrame:
    """One row per cleaning action with the number of rows it touches; `unparsed` adds texts in date columns that are no date."""
    facts = _column_facts(df, roles, approx)
    touched = {
        "type_converted": F.when(F.col("kind") == "date", F.col("rows")),
        "filled_na": F.when(F.col("kind").isin("number", "label") & (F.col("nulls") > 0)
                            & (F.col("nulls") < F.col("rows")), F.col("nulls")),
        "marked_outlier": F.when(F.col("outliers") > 0, F.col("outliers")),
    }
    actions = facts.select("column", F.inline(F.array(*[
        F.struct(F.lit(name).alias("action"), rows.alias("affected_rows")) for name, rows in touched.items()
    ]))).filter(F.col("affected_rows").isNotNull())
    copies = find_duplicates(df).filter("duplicate_rows > 0").select(
        F.lit("__all__").alias("column"), F.lit("marked_duplicate").alias("action"),
        F.col("duplicate_rows").alias("affected_rows"))
    if unparsed:
        bad = unparsed_dates(df, roles).filter("unparsed_rows > 0")
        actions = actions.unionByName(bad.select("column", F.lit("unparsed_date").alias("action"), F.col("unparsed_rows").alias("affected_rows")))
    return copies.unionByName(actions)


def unparsed_dates(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Per date column: filled rows, and those whose text is no date, with their share."""
    dates, _, _ = _by_kind(df, roles)
    if not dates:
        return df.sparkSession.createDataFrame([], "column string, filled_rows long, unparsed_rows long, unparsed_share double")
    filled = {c: F.trim(col(c).cast("string")) != "" for c in dates}
    times = as_times(df, dates)
    wide = df.select(*[F.struct(filled[c].alias("filled"), times[c].isNull().alias("bad")).alias(f"c{i}") for i, c in enumerate(dates)]).agg(*[
        x for i in range(len(dates)) for x in (
            F.count_if(F.col(f"c{i}.filled")).alias(f"n{i}"), F.count_if(F.col(f"c{i}.filled") & F.col(f"c{i}.bad")).alias(f"bad{i}"))
    ])
    return rows_from(wide, [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("filled_rows"), F.col(f"bad{i}").alias("unparsed_rows"),
                 ratio(F.col(f"bad{i}"), F.col(f"n{i}")).alias("unparsed_share"))
        for i, c in enumerate(dates)
    ])


def quality_score(df: DataFrame, roles: dict[str, str] | None = None, *, approx: bool = False) -> DataFrame:
    """Score 0 to 100 with what lowered it: empty columns, outlier columns, copies."""
    facts = _column_facts(df, roles, approx)
    null_rate = F.round(ratio(F.col("nulls"), F.col("rows")), 4)
    outlier_rate = ratio(F.col("outliers"), F.col("rows"))
    copies = find_duplicates(df).select("duplicate_rows").scalar()
    counted = facts.agg(
        F.max("rows").alias("row_count"),
        F.count_if(null_rate > NULL_RATE_LIMIT).alias("high_null_columns"),
        F.count_if(outlier_rate > OUTLIER_RATE_LIMIT).alias("high_outlier_columns"),
    ).withColumn("duplicate_rows", copies)
    lost = F.coalesce(F.floor(ratio(F.col("duplicate_rows"), F.col("row_count")) * DUPLICATE_PENALTY), F.lit(0))
    score = 100 - NULL_PENALTY * F.col("high_null_columns") - OUTLIER_PENALTY * F.col("high_outlier_columns") - lost
    return counted.select(
        F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("score"),
        "row_count", "duplicate_rows", "high_null_columns", "high_outlier_columns",
    )
