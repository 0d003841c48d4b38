"""From raw documents to token ids, stage by stage.

Each stage takes all that the one before kept, is written as Parquet and read
again. All but the last give the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.ordering import settle
from ledgerlight.llm.decontaminate import with_leaks
from ledgerlight.llm.jaccard import jaccard_components
from ledgerlight.llm.lines import drop_site_lines, fresh
from ledgerlight.llm.quality import fit_rules, quality_rules
from ledgerlight.llm.tokens import encode

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go."""
    verdict = fresh(docs.columns, "_quality")
    forest = fit_rules(docs, _table(spark, sf_dir, "labels"))
    return quality_rules(docs, forest, into=verdict).filter(F.col(f"{verdict}.kept")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that their source repeats too often; n_chars follows the text."""
    cut = drop_site_lines(docs, "source", "text")
    changed = F.col(cut.columns[-1]) > 0
    kinds = dict(docs.dtypes)
    return cut.select(*[
        F.when(changed, F.length("text")).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns
    ])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id: five-word shingles, Jaccard of 0.8 or more.

    Rows are compared, not ids: different texts of one doc_id both stay, and of copies
    without doc_id one stays. A row without doc_id stays only if no other row of its
    group has one. Rows without words are no copies of anything.
    """
    row, of = fresh(docs.columns, "_row"), fresh(docs.columns, "_group")
    # written once: whatever made the rows, each keeps its number
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard_components(numbered, words=5, threshold=(80, 100), key=row)
    ids = numbered.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("order"))
    groups = settle(found.select(F.col("doc_id").alias(row), F.col("component_id").alias(of)).join(ids, row))
    first = settle(groups.groupBy(of).agg(F.count("*").alias("rows"), F.min_by(row, "order").alias("first")).filter("rows > 1").select(of, "first"))
    # the rows that go are fewer than those that stay, and written first: where they are small, texts are not shuffled
    gone = settle(groups.join(first, of).filter(F.col(row) != F.col("first")).select(row))
    return numbered.join(gone, row, "left_anti").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    held = fresh(docs.columns, "_leaks")
    return with_leaks(docs, _table(spark, sf_dir, "benchmark"), into=held).filter(F.size(held) == 0).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact (the ids decode to the text)."""
    return encode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

# Trees, edit distances and merges are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = settle(stage(spark, rows, sf_dir))
    return rows


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
