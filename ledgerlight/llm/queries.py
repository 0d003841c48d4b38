"""The operators applied to the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import settle
from .alignment import align_tokens
from .decontaminate import leaks
from .importance import importance_ranks
from .jaccard import jaccard_components
from .language import fit_parser, predict_language
from .licenses import scan_licenses
from .linecrf import fit_line_field, line_quality
from .lines import drop_site_lines, host_of, html_lines
from .neighbours import nearest_neighbours
from .quality import fit_rules, quality_rules
from .sharding import shuffled_places
from .tokens import count_tokens, round_trip


VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_rules(docs, _table(spark, sf_dir, "labels"))
    return quality_rules(docs, forest).select("doc_id", "_quality.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict_language(docs, fit_parser(docs))


def op4_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = shuffled_places(_table(spark, sf_dir, "documents"), 8)
    return places.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = settle(_table(spark, sf_dir, "pages").select(
        "page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines")))
    return drop_site_lines(pages, "host", "lines").select(
        "page_id", "host", F.col("dropped_lines").cast("long").alias("dropped_lines"), F.md5("lines").alias("kept_md5"))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality(docs, fit_line_field(docs, _table(spark, sf_dir, "labels")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path("piece_bpe_32k.model"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP9_SQL = r"""
WITH bare AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS host,
    regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g') AS html FROM pages),
cut AS (
  SELECT page_id, host, regexp_replace(html,
    '(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|footer|article|title|header|head|body|html|table|tr)\b[^>]*>', chr(10), 'g') AS html FROM bare),
texts AS (
  SELECT page_id, host, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), ' *\n[ \n]*', chr(10), 'g') AS lines FROM cut),
sites AS (SELECT host, count(DISTINCT lines) AS site_pages FROM texts GROUP BY host),
each AS (SELECT DISTINCT host, lines, unnest(list_transform(string_split(lines, chr(10)), lambda x: trim(x))) AS line FROM texts),
bad AS (
  SELECT e.host, list(e.line) AS cut FROM (
    SELECT host, line, count(*) AS pages FROM each WHERE line <> '' GROUP BY host, line HAVING count(*) >= 2) e
  JOIN sites s ON e.host = s.host WHERE e.pages / s.site_pages > 0.1 GROUP BY e.host)
SELECT page_id, t.host,
  CAST(len(string_split(lines, chr(10))) - len(list_filter(string_split(lines, chr(10)), lambda x: NOT list_contains(coalesce(cut, []), trim(x)))) AS BIGINT) AS dropped_lines,
  md5(array_to_string(list_filter(string_split(lines, chr(10)), lambda x: NOT list_contains(coalesce(cut, []), trim(x))), chr(10))) AS kept_md5
FROM texts t LEFT JOIN bad b ON t.host = b.host
"""


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_token_counts": op2_token_counts,
        "op3_language": op3_language,
        "op4_shard_shuffle": op4_shard_shuffle,
        "op5_bpe_round_trip": op5_bpe_round_trip,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_license_scan": op7_license_scan,
        "op8_benchmark_leaks": op8_benchmark_leaks,
        "op9_site_lines": op9_site_lines,
        "op10_line_quality": op10_line_quality,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_token_alignment": op12_token_alignment,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_site_lines": OP9_SQL}
