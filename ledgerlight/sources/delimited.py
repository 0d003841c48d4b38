"""Delimited text as typed tables."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col
from ..functions.ordering import join_facts, settle
from .intake import detect_delimiter_text
from .records import whole_records

# Texts that stand for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_BAD = "_bad_line"
SPARK_CHARSETS = ("utf-8", "iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32")
WHOLE = r"^[+-]?\d{1,19}$"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?[Ii]nf(inity)?$"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip the column names; empty ones become Unnamed_<position>."""
    return df.toDF(*[c.strip() or f"Unnamed_{i}" for i, c in enumerate(df.columns)])


def validate_input(df: DataFrame) -> DataFrame:
    """The table with stripped names; ValueError if it is empty or has one column."""
    if len(df.columns) < 2:
        raise ValueError(f"at least 2 columns are needed, found {len(df.columns)}")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return normalize_columns(df)


def _read_missing(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.when(~F.trim(col(c)).isin(*MISSING), col(c)).alias(c) for c in df.columns
    ])


def _infer_types(df: DataFrame) -> DataFrame:
    """Type text columns as bigint, double, boolean or text, in one scan."""
    value = F.trim("value")
    # one row per value: a short plan, where tests on every column would be a very long one
    fits = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("at"), col(c).alias("value")) for i, c in enumerate(df.columns)
    ]))).filter("value IS NOT NULL").groupBy("at").agg(
        F.count("*").alias("n"),
        F.count_if(F.lower(value).isin("true", "false")).alias("boolean"),
        # the pattern first: a failing cast is far slower
        F.count(F.when(value.rlike(WHOLE), value.try_cast("bigint"))).alias("bigint"),
        F.count(F.when(value.rlike(DECIMAL), value.try_cast("double"))).alias("double"),
    ).collect()
    kinds = {r["at"]: next((k for k in ("boolean", "bigint", "double") if r[k] == r["n"]), None) for r in fits}
    typed = []
    for i, c in enumerate(df.columns):
        kind = kinds.get(i, "double")
        typed.append((F.trim(col(c)).cast(kind) if kind else col(c)).alias(c))
    return df.select(*typed)


def _keep_short_lines(df: DataFrame, sep: str, width: int) -> DataFrame:
    """Drop lines with too many fields; lines with too few stay, padded with NULL."""
    unquoted = F.regexp_replace(F.col(_BAD), '"[^"]*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1
    # Spark refuses to read the bad-line column alone, as a bare count would,
    # so the filter looks at a data column too; the test itself always holds.
    read = F.coalesce(F.length(col(df.columns[0])), F.lit(0)) >= 0
    return df.filter(read & (F.col(_BAD).isNull() | (fields <= width))).drop(_BAD)


def _finish(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    if schema is None:
        return _infer_types(_read_missing(df))
    return _read_missing(df).select(*[
        F.trim(col(f.name)).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else col(f.name)
        for f in schema
    ])


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(_BAD, T.StringType())])


def _parse(lines: DataFrame, line: Column, names: Sequence[str], sep: str) -> DataFrame:
    options = {"sep": sep, "columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE", "escape": '"', "multiLine": "true"}
    ddl = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in [*names, _BAD])
    return lines.select(F.from_csv(line, ddl, options).alias("r")).select("r.*")


def _split_names(line: str, sep: str) -> list[str]:
    names = [n.strip() for n in next(csv.reader([line], delimiter=sep), [])]
    return [n or f"Unnamed_{i}" for i, n in enumerate(names)]


def _without_comment(line: Column, comment: str) -> Column:
    """The line up to a comment mark outside quotes."""
    mark = re.escape(comment)
    return F.regexp_replace(line, rf'^((?:[^"{mark}]|"[^"]*")*+){mark}.*$', "$1")


def _whole_record(line: Column) -> Column:
    """The line; an error if a quoted field goes on in the next one."""
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 1, F.raise_error(F.concat(
        F.lit("a quoted field spans lines, read with multiline=True: "), F.substring(line, 1, 200))).cast("string")).otherwise(line)


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    skip_rows: int = 0,
    comment: str | None = None,
    schema: T.StructType | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Delimited files as a table. Missing-value texts are NULL, types inferred if not given.

    `skip_rows` drops that many physical lines at the head of each file. Files whose
    headers differ are refused. A line break inside quotes is an error unless
    `multiline` is set. Files are then still read in splits; records are joined from
    their lines and written once, lines end with a line feed, and comments are known
    at the start of a record only. UTF-16 and UTF-32 have no splits at lines: such
    files are read whole, one task each, without `skip_rows`. `comment` is one
    character.
    """
    require_charset(spark, encoding)
    if _is_wide(encoding):
        if skip_rows:
            raise ValueError(f"skip_rows counts lines and cannot be used with {encoding}")
        return _read_files(spark, path, sep, encoding, header, comment, schema)
    return _read_lines(spark, path, sep, encoding, header, skip_rows, comment, schema, multiline)


def require_charset(spark: SparkSession, encoding: str) -> None:
    """Spark reads the Unicode and Latin-1 charsets; for the JVM's others the caller's session must allow them."""
    setting = "spark.sql.legacy.javaCharsets"
    if encoding.lower() not in SPARK_CHARSETS and spark.conf.get(setting, "false") != "true":
        raise ValueError(f"set {setting} to true to read {encoding}")


def _is_wide(encoding: str) -> bool:
    return encoding.lower().startswith(("utf-16", "utf-32"))


def _text_lines(spark: SparkSession, path: str, encoding: str, **options: str) -> DataFrame:
    """_file, _start, _id, value: lines as the text source gives them, decoded here, since it takes all bytes for UTF-8."""
    raw = F.col("value")
    value = raw if encoding.lower() in ("utf-8", "us-ascii") else F.decode(raw.cast("binary"), encoding)
    return spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), value.alias("value"))


def _one_header(found: Sequence[str], sep: str) -> list[str]:
    headers = {tuple(_split_names(line, sep)) for line in found}
    if len(headers) > 1:
        raise ValueError("the files have different headers: " + "; ".join(sorted(map(str, headers))))
    return list(headers.pop()) if headers else []


def _read_files(spark, path, sep, encoding, header, comment, schema) -> DataFrame:
    options = {"sep": sep, "encoding": encoding, "multiLine": True, "quote": '"', "escape": '"'}
    if comment:
        options["comment"] = comment
    names = schema.names if schema is not None else [c.strip() for c in spark.read.options(**options).option("header", header).csv(path).columns]
    # without pruning, since a pruned parse does not notice lines with too many fields
    rows = (
        spark.read.options(**options).option("header", header).option("columnPruning", False).schema(_text_schema(names))
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).option("enforceSchema", True).csv(path)
    )
    return _finish(_keep_short_lines(rows, sep, len(names)), schema)


def _read_lines(spark, path, sep, encoding, header, skip_rows, comment, schema, multiline) -> DataFrame:
    value = F.col("value")
    lines = _text_lines(spark, path, encoding, **({"lineSep": "\n"} if multiline else {}))
    # Ids grow along a file. Only the head of each file is ranked, and the rank
    # limit is applied before the shuffle.
    order = Window.partitionBy("_file").orderBy("_id")
    body = lines
    if skip_rows:
        skipped = lines.filter(F.col("_start") == 0).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= skip_rows)
        marked = join_facts(lines, skipped.groupBy("_file").agg(F.max("_id").alias("_last")), ["_file"], "left")
        body = marked.filter(F.col("_last").isNull() | (F.col("_id") > F.col("_last")))
    if multiline:
        body = whole_records(body.select("_file", "_start", "_id", "value"), sep, comment)
    elif comment:
        body = body.withColumn("value", _without_comment(value, comment))
    body = body.filter(F.length(F.trim("value")) > 0)
    first = body.filter(F.col("_start") == 0).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") == 1)
    if header:
        tops = settle(first.select("_file", F.col("_id").alias("_top"), "value"))
        names = _one_header([r["value"] for r in tops.select("value").distinct().limit(2).collect()], sep)
        marked = join_facts(body, tops.select("_file", "_top"), ["_file"], "left")
        body = marked.filter(F.col("_top").isNull() | (F.col("_id") > F.col("_top")))
    else:
        top = first.select("value").first()
        names = [f"_c{i}" for i in range(len(_split_names(top[0], sep)))] if top else []
    names = schema.names if schema is not None else names
    records = body if multiline else body.select(_whole_record(value).alias("value"))
    parsed = _parse(records, value, names, sep)
    return _finish(_keep_short_lines(parsed, sep, len(names)), schema)


def read_inline(spark: SparkSession, text: str, sep: str | None = None, *, header: bool = True, skip_rows: int = 0,
                comment: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A table from text held by the caller; the separator is detected if not given."""
    if not text.strip():
        raise ValueError("the text is empty")
    kept = "\n".join(_cut_comment(l, comment) for l in text.splitlines()[skip_rows:])
    if sep is None:
        held = spark.createDataFrame([("inline", kept)], "path string, text string")
        sep = detect_delimiter_text(held).first()["delimiter"]
    lines = _records(kept)
    names = schema.names if schema else _split_names(lines[0], sep)
    if not header and not schema:
        names = [f"_c{i}" for i in range(len(names))]
    rows = spark.createDataFrame([(l,) for l in lines[int(header):]], "value string")
    return _finish(_keep_short_lines(_parse(rows, F.col("value"), names, sep), sep, len(names)), schema)


def _cut_comment(line: str, comment: str | None) -> str:
    if not comment:
        return line
    mark = re.escape(comment)
    return re.sub(rf'^((?:[^"{mark}]|"[^"]*")*){mark}.*$', r"\1", line)


def _records(text: str) -> list[str]:
    """Lines, joined where a quoted field goes on in the next one; blank ones left out."""
    out, open_ = [], ""
    for line in text.split("\n"):
        open_ = f"{open_}\n{line}" if open_ else line
        if open_.count('"') % 2 == 0:
            out.append(open_)
            open_ = ""
    if open_:
        raise ValueError("the text ends inside quotes")
    return [l for l in out if l.strip()]
