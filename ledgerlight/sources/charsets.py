"""Charsets told by their pairs of bytes.

A model holds, per charset, how likely each pair of neighbouring bytes is in texts
written with it. It is fitted on texts that are known: they are encoded with every
charset and their pairs counted. A file's pairs are counted by Spark's own
expressions and joined with the model, of at most 65,536 rows per charset; the
charset under which the pairs are likeliest wins, and its share of the likelihood
is the confidence.
"""

from __future__ import annotations

import codecs
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = 1 << 16
#: Charsets that texts are tried with, unless others are given.
CHARSETS = ("utf-8", "utf-16", "utf-16-be", "utf-16-le", "cp1252", "cp850", "mac_roman", "gbk", "shift_jis", "euc_kr", "big5", "cp1251", "koi8-r")


def byte_pairs(data: Column) -> Column:
    """Pairs of neighbouring bytes, each as a number; one step per byte."""
    values = F.transform(F.filter(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: c != ""), F.ascii)
    n = F.octet_length(data) - 1
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda a, b: a * 256 + b)


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pair, n: how often each pair is there. Data of fewer than two bytes has none."""
    return rows.filter(F.octet_length("data") > 1).select(*keys, F.explode(byte_pairs(F.col("data"))).alias("pair")).groupBy(*keys, "pair").agg(
        F.count("*").alias("n"))


def fit_charsets(texts: DataFrame, *, text: str = "text", charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """charset, pair, weight (log of the pair's share, one added to every count), for each pair seen, and for pair -1 any other.

    A text that a charset cannot write is left out for it; a charset that can write
    none has no rows. UTF-16 without a byte order is as written by the codecs, with a mark.
    """
    names = [codecs.lookup(c).name for c in charsets]

    # few rows at a time go to Python and back, as a whole Arrow batch of texts in all charsets is large
    @F.udf("array<binary>", useArrow=False)
    def written(text: str | None) -> list[bytes | None] | None:
        def one(name: str) -> bytes | None:
            try:
                return text.encode(name)
            except UnicodeEncodeError:
                return None

        return None if text is None else [one(n) for n in names]

    encoded = texts.select(F.posexplode(written(F.col(text))).alias("at", "data")).filter("data IS NOT NULL")
    charset = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1)
    counts = _counted(encoded.withColumn("charset", charset), ["charset"])
    totals = counts.groupBy("charset").agg(F.sum("n").alias("total"))
    seen = counts.join(F.broadcast(totals), "charset").select("charset", "pair", F.log((F.col("n") + 1) / (F.col("total") + PAIRS)).alias("weight"))
    return seen.unionByName(totals.select("charset", F.lit(-1).alias("pair"), F.log(1 / (F.col("total") + PAIRS)).alias("weight")))


def likely_charsets(files: DataFrame, model: DataFrame, key: str = "path") -> DataFrame:
    """key, charset, confidence for rows (key, data: binary) of two bytes or more; ties go to the earlier name. The model holds a charset at least."""
    other = model.filter("pair = -1").select("charset", F.col("weight").alias("least"))
    names = F.array(*[F.struct(F.lit(r["charset"]).alias("charset"), F.lit(r["least"]).alias("least")) for r in other.collect()])
    counts = _counted(files.select(key, "data"), [key])
    # the model's size is bounded by its charsets, a few megabytes
    known = counts.join(F.broadcast(model.filter("pair >= 0").join(other, "charset")), "pair").groupBy(key, "charset").agg(
        F.sum(F.col("n") * (F.col("weight") - F.col("least"))).alias("gain"))
    size = counts.groupBy(key).agg(F.sum("n").alias("pairs"))
    scored = size.select(key, "pairs", F.inline(names)).join(known, [key, "charset"], "left").select(
        key, "charset", (F.col("pairs") * F.col("least") + F.coalesce("gain", F.lit(0.0))).alias("score"))
    best = scored.groupBy(key).agg(F.max("score").alias("top"), F.collect_list(F.struct("score", "charset")).alias("all"))
    share = F.aggregate("all", F.lit(0.0), lambda total, x: total + F.exp(x["score"] - F.col("top")))
    first = F.array_min(F.transform(F.filter("all", lambda x: x["score"] == F.col("top")), lambda x: x["charset"]))
    return best.select(key, first.alias("charset"), (1 / share).alias("confidence"))
