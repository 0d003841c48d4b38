"""Target-distribution importance resampling on hashed word n-grams.

A document's features are its words and its pairs of neighbouring words; a
feature's bucket is the CRC-32 of its bytes modulo the number of buckets. The
corpus's and the target's totals per bucket give each bucket a gain, a
document's weight is the mean gain of its features, and the sample is drawn by
weight plus Gumbel noise from a seeded hash of the key.

Head and tail. Frequent words travel to the workers with the exact CRC-32 state
after the word and after the word and a space, frequent pairs with their
bucket. All other words take their CRC-32 directly, and all other pairs go on
from the state of their first word. What is frequent is counted over all
documents, with rare entries dropped on the way; it decides only how fast a
bucket is found, never which one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running_totals, settle

#: Bounds of what is broadcast: so many words of so many bytes at most, and so many pairs of their numbers.
HEAD_WORDS, HEAD_WORD_BYTES, HEAD_PAIRS = 50_000, 32, 200_000
_SLOTS = 1 << 19
# Frequent words and pairs that a task reports, and how many it holds before it drops those seen once.
_REPORT, _HOLD = 20_000, 400_000
_PIECE, _FLUSH = 1 << 20, 200_000

# Digits, a-z and everything beyond ASCII make words; A-Z are lower-cased before.
_APART = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about a megabyte that end between words."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + _PIECE) if at + _PIECE < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def _blocks(texts) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """Words of all texts in blocks, each word's text number, and 1 where the first word only leads on from the block before."""
    words: list[bytes] = []
    owners: list[int] = []
    counts: list[int] = []
    lead = 0
    for i, data in enumerate(texts):
        for piece in _pieces(data or b""):
            found = piece.lower().translate(_APART).split()
            words += found
            owners.append(i)
            counts.append(len(found))
            if len(words) >= _FLUSH:
                yield words, np.repeat(owners, counts), lead
                words, owners, counts, lead = words[-1:], [i], [1], 1
    if len(words) > lead:
        yield words, np.repeat(owners, counts), lead


def _slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * 0x9E3779B1 + second * 0x85EBCA77 >> 7) & (_SLOTS - 1)


class Head:
    """Frequent words with their CRC-32 states, and frequent pairs with their buckets."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.buckets = buckets
        self.number = {w: i for i, w in enumerate(words)}
        # the last place is for words that are not frequent
        self.crc = np.array([*map(crc32, words), 0], dtype=np.uint32)
        self.state = np.array([*(crc32(w + b" ") for w in words), 0], dtype=np.uint32)
        known = [(self.number[a], self.number[b], crc32(a + b" " + b) % buckets) for a, b in pairs if a in self.number and b in self.number]
        rows = np.array(known, dtype=np.int64).reshape(-1, 3)
        slots = _slot(rows[:, 0], rows[:, 1])
        self.pair = np.full(_SLOTS, -1, dtype=np.int64)
        self.pair_bucket = np.zeros(_SLOTS, dtype=np.int64)
        # of pairs that share a slot the most frequent one, which comes first, stays
        self.pair[slots[::-1]] = (rows[:, 0] << 32 | rows[:, 1])[::-1]
        self.pair_bucket[slots[::-1]] = rows[::-1, 2]

    def features(self, words: list[bytes], owners: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """Owner and bucket of each word and pair of a block."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        crc, state = self.crc[ids], self.state[ids]
        tail = np.flatnonzero(ids < 0)
        crc[tail] = direct = list(map(crc32, map(words.__getitem__, tail.tolist())))
        state[tail] = list(map(crc32, repeat(b" "), direct))
        at = np.flatnonzero(owners[1:] == owners[:-1])
        first, second = ids[at], ids[at + 1]
        slots = _slot(first, second)
        known = (self.pair[slots] == (first << 32 | second)) & (first >= 0) & (second >= 0)
        found = self.pair_bucket[slots]
        rest = at[~known]
        found[~known] = np.fromiter(
            map(crc32, map(words.__getitem__, (rest + 1).tolist()), state[rest].tolist()), np.int64, len(rest)) % self.buckets
        return np.concatenate((owners[lead:], owners[at])), np.concatenate((crc[lead:].astype(np.int64) % self.buckets, found))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).cast("binary").alias("_text"))


def _thin(counts: Counter) -> Counter:
    """Drops what was seen once, and more if that is not enough."""
    least = 1
    while len(counts) > _HOLD // 2:
        counts = Counter({k: n for k, n in counts.items() if n > least})
        least *= 2
    return counts


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter = Counter()
    pairs: Counter = Counter()
    for batch in batches:
        for block, owners, lead in _blocks(batch["_text"]):
            local = Counter(block)
            names = [w for w, n in local.items() if n > 1 and len(w) <= HEAD_WORD_BYTES]
            words.update({w: local[w] for w in names})
            number = {w: i for i, w in enumerate(names)}
            ids = np.fromiter(map(number.get, block, repeat(-1)), np.int64, len(block))
            at = np.flatnonzero((owners[1:] == owners[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0))
            codes, n = np.unique(ids[at] * len(names) + ids[at + 1], return_counts=True)
            for code, k in zip(codes[n > 1].tolist(), n[n > 1].tolist()):
                pairs[names[code // len(names)], names[code % len(names)]] += k
            words, pairs = (_thin(c) if len(c) > _HOLD else c for c in (words, pairs))
    rows = [(w, None, n) for w, n in words.most_common(_REPORT)] + [(a, b, n) for (a, b), n in pairs.most_common(_REPORT)]
    yield pd.DataFrame(rows, columns=["first", "second", "times"])


def frequent_head(docs: DataFrame, *, text: str = "text", buckets: int = 10_000) -> Head:
    """The head of the vocabulary, from all documents; its size is bounded whatever the corpus's."""
    counts = settle(_texts(docs, text).mapInPandas(_frequent, "first binary, second binary, times long")
                    .groupBy("first", "second").agg(F.sum("times").alias("times")))
    top = [counts.filter(kind).orderBy(F.desc("times"), "first", "second").limit(n).collect()
           for kind, n in (("second IS NULL", HEAD_WORDS), ("second IS NOT NULL", HEAD_PAIRS))]
    return Head([bytes(r["first"]) for r in top[0]], [(bytes(r["first"]), bytes(r["second"])) for r in top[1]], buckets)


def bucket_totals(docs: DataFrame, head: Head, *, text: str = "text") -> np.ndarray:
    """How many features of all documents fall into each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = shared.value
        total = np.zeros(head.buckets, dtype=np.int64)
        for batch in batches:
            for block in _blocks(batch["_text"]):
                total += np.bincount(head.features(*block)[1], minlength=head.buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "times": total[used]})

    rows = _texts(docs, text).mapInPandas(counted, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times"))
    total = np.zeros(head.buckets, dtype=np.int64)
    for r in rows.collect():
        total[r["bucket"]] = r["times"]
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, with one added to every count."""
    here, there, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([
        math.floor(1000 * math.log((t + 1) * (here + n) / ((s + 1) * (there + n)))) for s, t in zip(corpus.tolist(), target.tolist())
    ], dtype=np.int64)


def importance_weights(docs: DataFrame, head: Head, gains: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight, the mean gain of the features rounded down (0 without features)."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gains.astype(float)))

    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        head, gains = shared.value
        for texts in batches:
            n = len(texts)
            features, gain, words = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=np.int64)
            for block in _blocks(texts):
                owners, found = head.features(*block)
                features += np.bincount(owners, minlength=n)
                gain += np.bincount(owners, weights=gains[found], minlength=n)
                words += np.bincount(block[1][block[2]:], minlength=n)
            yield pd.DataFrame({"n_words": words, "n_features": features, "weight": gain.astype(np.int64) // np.maximum(features, 1)})

    udf = F.pandas_udf(weighed, "n_words long, n_features long, weight long")
    return docs.select(F.col(key).alias("doc_id"), udf(F.col(text).cast("binary")).alias("w")).select("doc_id", "w.*")


def importance_ranks(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int = 10_000,
    percent: int = 25, min_words: int = 20, seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank, 1 for the highest score.

    Of the N documents with `min_words` words or more, the floor(percent * N / 100)
    highest scores are drawn; the others' rank is null. Ties go to the smaller key, a
    null key comes last and hashes as an empty one. Repeated rows are ranked row by
    row. A null or empty text has no features and weight 0. Other columns are not
    looked at; neither table needs rows.
    """
    head = frequent_head(docs, text=text, buckets=buckets)
    gains = bucket_gains(bucket_totals(docs, head, text=text), bucket_totals(target, head, text=text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296)))
    scored = settle(importance_weights(docs, head, gains, key=key, text=text)
                    .withColumn("score", F.col("weight") + noise).withColumn("_in", F.when(F.col("n_words") >= min_words, 1).otherwise(0)))
    drawn = percent * (scored.agg(F.sum("_in")).first()[0] or 0) // 100
    rows = scored.withColumns({"_last": F.col("doc_id").isNull(), "_row": F.monotonically_increasing_id()})
    ranked = running_totals(rows, {"_in": "rank"}, ["-_in", "-score", "_last", "doc_id", "_row"])
    return ranked.select(
        "doc_id", "n_features", "weight", "score", F.when((F.col("_in") == 1) & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose key is drawn, all columns, see `importance_ranks`. Rows with a null key are left out."""
    drawn = importance_ranks(docs, target, key=key, **options).filter("rank IS NOT NULL AND doc_id IS NOT NULL")
    return docs.join(settle(drawn.select(F.col("doc_id").alias(key)).distinct()), key, "left_semi")
