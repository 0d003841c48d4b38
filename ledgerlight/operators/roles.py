"""Business roles of columns, from names and, failing that, from the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keywords import (
    AMBIGUOUS_BELOW, DATE_CONFIDENCE, HINT_CONFIDENCE, KEYWORD_CONFIDENCE, KEYWORDS, METRIC_CONFIDENCE,
    NO_MATCH_CONFIDENCE, ROLES,
)
from ..functions.exprs import literal_rows
from .profile import profile_dates


def role_by_name(name: Column) -> Column:
    """Role of a column name by keyword, NULL if none matches."""
    low = F.lower(name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, words in KEYWORDS.items():
        out = out.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words]), role)
    return out


def assign_roles(columns: DataFrame) -> DataFrame:
    """Roles for a table of columns: (column, is_number, is_date, ...) of one or many tables."""
    known = role_by_name(F.col("column"))
    role = (
        F.when(known.isNotNull(), known)
        .when(F.col("is_number"), "metric")
        .when(F.col("is_date"), "date")
        .otherwise("ignore")
    )
    confidence = (
        F.when(known.isNotNull(), KEYWORD_CONFIDENCE)
        .when(F.col("is_number"), METRIC_CONFIDENCE)
        .when(F.col("is_date"), DATE_CONFIDENCE)
        .otherwise(NO_MATCH_CONFIDENCE)
    )
    reason = (
        F.when(known.isNotNull(), F.concat(F.lit("name contains a word for "), known))
        .when(F.col("is_number"), "numeric column without a known name")
        .when(F.col("is_date"), "values are dates")
        .otherwise("no rule applies")
    )
    return columns.select("*", role.alias("role"), confidence.alias("confidence"), reason.alias("reason"))


def _name_roles(df: DataFrame) -> set[str]:
    """Columns of `df` whose name alone decides the role."""
    return {c for c in df.columns if any(w.lower() in c.lower() for words in KEYWORDS.values() for w in words)}


def infer_roles(df: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    """One row per column with its role; hints, if given, are the only roles.

    Only columns that no name rule and no type decides are read.
    """
    spark = df.sparkSession
    if hints:
        bad = sorted(set(hints.values()) - set(ROLES))
        if bad:
            raise ValueError(f"unknown role: {', '.join(bad)}")
        given = [(c, r) for c, r in hints.items() if c in df.columns]
        if not given:
            raise ValueError("no hinted column is in the table")
        return literal_rows(spark, [
            F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), F.lit(HINT_CONFIDENCE).alias("confidence"),
                     F.lit("given").alias("reason"))
            for c, r in given
        ])
    number = (T.IntegralType, T.DoubleType, T.FloatType, T.DecimalType)
    rows = [(i, f.name, isinstance(f.dataType, number)) for i, f in enumerate(df.schema.fields)]
    columns = literal_rows(spark, [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(is_number).alias("is_number"))
        for i, name, is_number in rows
    ])
    decided = _name_roles(df) | {name for _, name, is_number in rows if is_number}
    open_ = [c for c in df.columns if c not in decided]
    if open_:
        dates = profile_dates(df, open_).select("column", F.lit(True).alias("is_date"))
        columns = columns.join(dates, "column", "left").fillna(False, ["is_date"])
    else:
        columns = columns.withColumn("is_date", F.lit(False))
    return assign_roles(columns).select("column", "role", "confidence", "reason", "position").orderBy("position").drop("position")


def role_ambiguity(roles: DataFrame, threshold: float = AMBIGUOUS_BELOW) -> DataFrame:
    """Columns whose role needs a look."""
    return roles.filter(F.col("confidence") < threshold)


def roles_dict(df: DataFrame, roles: dict[str, str] | None = None) -> dict[str, str]:
    """Roles as a plain mapping; one entry per column of the schema."""
    if roles is not None:
        return {c: r for c, r in roles.items() if c in df.columns}
    return {r["column"]: r["role"] for r in infer_roles(df).collect()}
