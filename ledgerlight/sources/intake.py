"""Checks over many files at once: separators, file kinds, encodings.

File kinds and encodings need the first bytes of each file only, and no more is read.
"""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charsets import likely_charsets
from .heads import file_heads

# Separators in order of preference, and where lines end.
DELIMITERS = (",", "\t", ";", "|")
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"

# Leading bytes of files that are not text.
MAGIC = {
    "7F454C46": "elf",
    "4D5A": "windows_executable",
    "FFD8FF": "jpeg",
    "89504E47": "png",
    "504B0304": "zip",
    "25504446": "pdf",
}

# Encodings tried in order; the last one always fits.
ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-16", "latin-1")


# Bytes of a file that its encoding is told from, and the confidence below which the fixed list decides.
ENCODING_BYTES, SURE = 10_240, 0.7


# ASCII text; other control characters are parts of wider characters.
_PLAIN = re.compile(rb"[\t-\r\x1b -~]*")


def file_magic_audit(spark: SparkSession, path: str) -> DataFrame:
    """Kind of every file by its first 8 bytes, and whether it may be text. Files without a byte have no row."""
    heads = file_heads(spark, path, 8).filter("length > 0").withColumn("_hex", F.hex("head"))
    kind = F.when(F.col("_hex").rlike("^(00)*$"), "empty")
    for prefix, name in MAGIC.items():
        kind = kind.when(F.col("_hex").startswith(prefix), name)
    return heads.select("path", "length", kind.otherwise("text").alias("kind")).withColumn(
        "accepted", F.col("kind") == "text")


def _first_fitting(heads: pd.Series, whole: pd.Series) -> pd.DataFrame:
    def fits(head: bytes, name: str, end: bool) -> bool:
        try:
            # a head may end within a character
            codecs.getincrementaldecoder(name)().decode(head, end)
            return True
        except UnicodeDecodeError:
            return False

    listed = [next((n for n in ENCODINGS if fits(h, n, bool(w))), None) for h, w in zip(heads, whole)]
    return pd.DataFrame({"listed": listed, "ascii": [_PLAIN.fullmatch(h) is not None for h in heads]})


def detect_encoding(spark: SparkSession, path: str, model: DataFrame | None = None, *, size: int = ENCODING_BYTES) -> DataFrame:
    """path, encoding and confidence of every file, from its first `size` bytes.

    With a `model` (see `fit_charsets`), the charset under which the file's pairs of
    bytes are likeliest; without one, or below a confidence of 0.7, the first of the
    known encodings that decodes the head, without a confidence. Heads of plain ASCII
    are UTF-8. Files without a byte have no row.
    """
    fitting = F.pandas_udf(_first_fitting, "listed string, ascii boolean")
    heads = file_heads(spark, path, size).filter("length > 0")
    listed = heads.select("path", fitting("head", F.col("length") <= size).alias("f")).select("path", "f.*")
    if model is None:
        return listed.select("path", F.col("listed").alias("encoding"), F.lit(None).cast("double").alias("confidence"))
    likely = likely_charsets(heads.select("path", F.col("head").alias("data")), model)
    sure = ~F.col("ascii") & (F.col("confidence") >= SURE)
    return listed.join(likely, "path", "left").select(
        "path", F.when(sure, F.col("charset")).otherwise(F.col("listed")).alias("encoding"),
        F.when(sure, F.col("confidence")).alias("confidence"))


def _regular_delimiter(lines: DataFrame, key: str) -> DataFrame:
    """key, delimiter and score from rows (key, line); lines are counted before they are compared."""
    counted = lines.filter(F.col("line").rlike(r"\S")).select(key, F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(d).alias("delimiter"),
                 (F.length("line") - F.length(F.replace("line", F.lit(d), F.lit("")))).alias("n"))
        for i, d in enumerate(DELIMITERS)
    ])))
    hist = counted.groupBy(key, "pos", "delimiter", "n").agg(F.count("*").alias("lines"))
    # one row per number of separators in a line
    typical = F.floor(F.expr(f"percentile(n, 0.5D, lines) OVER (PARTITION BY `{key}`, pos)"))
    scored = (
        hist.withColumn("_typical", typical)
        .filter(F.col("_typical") >= 1)
        .groupBy(key, "pos", "delimiter")
        .agg((F.sum(F.when(F.col("n") == F.col("_typical"), F.col("lines")).otherwise(0)) / F.sum("lines")).alias("score"))
        .filter(F.col("score") > 0)
    )
    return scored.groupBy(key).agg(
        F.min_by("delimiter", F.struct(-F.col("score"), "pos")).alias("delimiter"), F.max("score").alias("score"))


def _or_comma(keys: DataFrame, best: DataFrame, key: str) -> DataFrame:
    return keys.join(best, key, "left").select(
        key, F.coalesce("delimiter", F.lit(DELIMITERS[0])).alias("delimiter"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def detect_delimiter_text(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Separator of every text: the one whose count per line is the most regular.

    The score is the share of non-blank lines with exactly the median count;
    the earlier separator wins ties, and comma stands for no answer.
    """
    lines = texts.select(F.col(key), F.explode(F.split(F.col(text), LINE_END)).alias("line"))
    return _or_comma(texts.select(key), _regular_delimiter(lines, key), key)


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Separator of every file under `path`, from all its lines. Separators are ASCII, so any charset that keeps ASCII will do."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    if encoding.lower() not in ("utf-8", "us-ascii"):
        lines = lines.withColumn("line", F.decode(F.col("line").cast("binary"), encoding))
    return _or_comma(lines.select("path").distinct(), _regular_delimiter(lines, "path"), "path")
