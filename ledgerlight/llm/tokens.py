"""Token counts, and encoding to ids and back, for whole texts.

Both read a vocabulary file on the driver and broadcast the merge list, whose
size is that of the vocabulary. Python workers keep what they learnt about
chunks of text from one task to the next, up to a fixed number of chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PRETOKEN, Decoder, Encoder, Memo, Merges, no_collection

_KEPT: dict = {}


def _kept(shared, make):
    """What `make` builds from a broadcast value, once per Python worker."""
    key = (make.__name__, shared.value.digest)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(shared.value)
    return _KEPT[key]


def whole_tokens(merges: Merges) -> frozenset[str]:
    """Strings proven to be one pre-token that merges to one token."""
    found = set()
    for i, data in merges.bytes_of.items():
        try:
            piece = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if PRETOKEN.fullmatch(piece) and merges.merge(data) == [i]:
            found.add(piece)
    return frozenset(found)


class Counter:
    """Numbers of tokens: one for a whole token, merged and counted for any other pre-token."""

    def __init__(self, merges: Merges):
        whole = merges.whole
        rest = Memo(lambda piece: len(merges.pretoken(piece)), limit=300_000)
        self.merges = merges
        self.chunks = Memo(lambda chunk: sum([1 if piece in whole else rest[piece] for piece in PRETOKEN.findall(chunk)]))

    def count(self, text: str) -> int:
        total = 0
        for part, special in self.merges.segments(text):
            total += 1 if special is not None else sum(map(self.chunks.__getitem__, self.merges.chunks(part)))
        return total


def _broadcast(docs: DataFrame, path: str, prove: bool = False):
    merges = Merges(path)
    merges.whole = whole_tokens(merges) if prove else frozenset()
    return docs.sparkSession.sparkContext.broadcast(merges)


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: no bytes, no tokens. Special tokens' strings in a
    text are one token each. Repeated rows and null keys give a row each; other
    columns are not looked at.
    """
    shared = _broadcast(docs, path, prove=True)

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _kept(shared, Counter)
        for batch in texts:
            with no_collection():
                counts = [counter.count(t) if t else 0 for t in batch]
            yield pd.Series(counts, dtype="int64")

    return docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        counted(F.col(text)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def _frugal_encoder(merges: Merges) -> Encoder:
    """Ids of whole texts take their own room, so less is remembered."""
    return Encoder(merges, words_kept=100_000, chunks_kept=200_000)


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, `ids` (the token ids of the whole text) and `exact` (whether decoding them gives the text back).

    A null or empty text has no ids and is exact. Repeated rows and null keys give a
    row each; other columns are not looked at.
    """
    shared = _broadcast(docs, path)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _kept(shared, _frugal_encoder)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                texts = [t or "" for t in part["text"]]
                with no_collection():
                    ids = [[i for block in encoder.blocks(t) for i in block] for t in texts]
                    exact = [Decoder(encoder.merges).feed(x, True) == t for x, t in zip(ids, texts)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": list(map(len, ids)), "ids": ids, "exact": exact})

    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    made = rows.mapInPandas(encoded, "doc_id string, n_tokens long, ids array<int>, exact boolean")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))


def decode(encoded: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and `text`, read back from token ids; '' for null or no ids. Bytes that
    are no UTF-8 become U+FFFD; an unknown id is an error."""
    shared = _broadcast(encoded, path)

    @F.pandas_udf("string")
    def decoded(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = shared.value
        for batch in rows:
            yield pd.Series(["" if x is None else Decoder(merges).feed(list(x), True) for x in batch])

    return encoded.select(F.col(key).alias("doc_id"), decoded(F.col(ids)).alias("text"))


def _digests(encoder: Encoder, names: list[str], text: str) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the text decoded from them; one block of either is held at a time."""
    n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(encoder.merges)
    for ids in encoder.blocks(text):
        if ids:
            ids_hash.update(("," * (n > 0) + ",".join(map(names.__getitem__, ids))).encode())
            text_hash.update(decoder.feed(ids).encode())
            n += len(ids)
    text_hash.update(decoder.feed([], True).encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def round_trip(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes block by block and decodes what was emitted, without holding a text's
    ids. A null text counts as empty: no ids, digests of nothing. Repeated rows and
    null keys give a row each; other columns are not looked at.
    """
    shared = _broadcast(docs, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _kept(shared, Encoder)
        names = list(map(str, range(max(shared.value.bytes_of) + 1)))
        for batch in texts:
            with no_collection():
                rows = [_digests(encoder, names, t or "") for t in batch]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).alias("doc_id"), digests(F.col(text)).alias("d")).select("doc_id", "d.*")
