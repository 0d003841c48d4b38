"""Two-pass external shuffle of a corpus into shards.

Pass one scatters the records, texts and all, by a seeded hash of their places in
the input into buckets sized to fit in memory. Pass two shuffles each bucket with
Spark's `shuffle`, which is a seeded Fisher-Yates pass over the bucket's array, and
writes it. Buckets laid end to end make one random order of the corpus, which is
cut into shards of equal length.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import settle, work_path
from .lines import fresh

BUCKET_BYTES = 64 << 20
#: Buckets at least; and at most, which bounds the broadcast table of their starts: from 64 TB on, buckets grow instead.
MIN_BUCKETS, MAX_BUCKETS = 1024, 1 << 20


def _placed(docs: DataFrame) -> DataFrame:
    """All columns as one, and the file (its path's hash) and row where the record stands; that does not change when a task is repeated."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(record, *place)
    except AnalysisException:
        return settle(docs).select(record, *place)


def write_shards(
    docs: DataFrame, path: str, shards: int = 8, *, text: str = "text", seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES, min_buckets: int = MIN_BUCKETS,
) -> None:
    """Write the records as one folder per shard, in slot order within each file.

    Columns written: all of `docs`, slot, and shard as the folder (`_` is added to
    either name if `docs` has it). Files of a shard hold consecutive ranges of slots.

    Shard lengths differ by one at most; slots run from 0 without gaps. Records
    are carried whole and never looked up again, so a null text stays null, and
    equal records or a null key are scattered apart like any others.

    The seed fixes the scatter of given Parquet files at their paths. Other inputs
    are written first, and their scatter also depends on how Spark deals them out.

    The number of buckets follows the corpus's bytes, so that a bucket's texts fit
    in memory, and a task takes about one bucket's bytes, or less.
    """
    rows = _placed(docs)
    size = F.octet_length(F.coalesce(F.col("record").getField(text), F.lit(""))).cast("long") + 1
    total, volume = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    full = min(-(-int(volume) // bucket_bytes), MAX_BUCKETS)
    buckets = max(min_buckets, full)
    tasks = min(buckets, max(full, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    scattered = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "file", "row"), F.lit(buckets)))

    held = settle(scattered.groupBy("bucket").agg(F.count("*").alias("held")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))

    task = F.floor(F.col("bucket") * tasks / F.lit(buckets)).cast("int")
    item = F.struct(F.xxhash64(F.lit(seed + 1), "file", "row").alias("turn"), "file", "row", "record")
    packed = (
        scattered.withColumn("task", task).repartitionById(tasks, F.col("task"))
        .groupBy("task", "bucket").agg(F.collect_list(item).alias("items"))
        .select("bucket", F.shuffle(F.array_sort("items"), seed).alias("items"))
    )
    placed = packed.join(F.broadcast(starts), "bucket").select("start", F.posexplode("items").alias("pos", "item"))
    shard, slot = _cut(F.col("start") + F.col("pos"), int(total), shards)
    slot_name, shard_name = (fresh(docs.columns, name) for name in ("slot", "shard"))
    (
        placed.select("item.record.*", slot.alias(slot_name), shard.alias(shard_name))
        .sortWithinPartitions(shard_name, slot_name).write.partitionBy(shard_name).parquet(path)
    )


def shuffled_places(docs: DataFrame, shards: int = 8, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Where each record went, read from shards written to the shared folder: doc_id, size, text_crc32, shard, slot.

    A null text counts as no bytes. An empty table gives no rows. Other columns are
    not looked at. Options are those of write_shards.
    """
    path = work_path(docs.sparkSession, "shards")
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    write_shards(named, path, shards, **options)
    kinds = named.select("doc_id", "text", F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard"))
    whole = F.coalesce(F.col("text"), F.lit(""))
    return docs.sparkSession.read.schema(kinds.schema).parquet(path).select(
        "doc_id", (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(whole).alias("text_crc32"), "shard", "slot")


def _cut(place: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place when the first total % shards shards take one record more."""
    short, longer = divmod(total, shards)
    edge = longer * (short + 1)
    inside = place < edge
    first, rest = F.lit(short + 1).cast("long"), F.lit(max(short, 1)).cast("long")
    past = place - F.lit(edge)
    shard = F.when(inside, F.floor(place / first)).otherwise(longer + F.floor(past / rest)).cast("int")
    return shard, F.when(inside, place % first).otherwise(past % rest).cast("long")
