"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line is good or bad. Its features are its own statistics and those of the
lines before and after it. The marginals of the forward-backward pass, weighted
by line length, make the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import train_rows

#: Labelled documents that the field is fitted on, at most: those with the smallest hash of their key.
SAMPLE = 3_000
#: Longer texts are not fitted on, so that the sample's bytes are bounded too; they are scored whole.
SAMPLE_CHARS = 50_000
#: Lines of them used in fitting, at most; all lines are used in scoring.
SAMPLE_LINES = 60_000
GOOD_FROM = 0.7

_CLASSES = (b"#*$%&<>", b"|", b"!", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".?", b" \t\x0b\x0c\r")
_TABLE = np.zeros((len(_CLASSES), 256), dtype=np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _TABLE[_k, list(_chars)] = 1
_OWN = 9
N_FEATURES = 1 + 3 * _OWN


@dataclass(frozen=True)
class LineField:
    """weights: score of good over bad by feature; step: scores of (bad, good) after (bad, good)."""

    weights: np.ndarray
    step: np.ndarray


@dataclass
class Lines:
    """Lines of many documents one after another. first and count: by document, longest document first; order: their places."""

    features: np.ndarray
    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    order: np.ndarray


def read_lines(texts: list[str | None]) -> Lines:
    """A null or empty text has one empty line."""
    data = [(t or "").encode("utf-8") for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lines = ends - starts
    sums = np.zeros((len(_CLASSES), len(lines)))
    filled = lines > 0
    for k in range(len(_CLASSES)):
        sums[k] = np.add.reduceat(_TABLE[k][joined], starts, dtype=np.int64)
    size = np.maximum(lines, 1)
    words = sums[7] + 1
    letters = np.maximum(sums[3] + sums[4], 1)
    again = np.fromiter(
        (sum(map(eq, w, w[1:])) for d in data for w in map(bytes.split, d.split(b"\n"))), dtype=float, count=len(lines))
    own = np.stack([
        np.minimum(sums[0] / words, 3) / 3, np.minimum(sums[1] / words, 1), np.minimum(sums[2] / words, 2) / 2, sums[3] / letters,
        sums[5] / size, np.minimum(sums[6] / words, 1), np.minimum(lines / words, 20) / 20, np.log1p(lines) / 10, again / words,
    ], axis=1) * filled[:, None]
    count = np.array([d.count(b"\n") + 1 for d in data], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64) if len(count) else np.zeros(0, np.int64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[first + count - 1] = 0
    order = np.argsort(-count, kind="stable")
    return Lines(np.hstack([np.ones((len(own), 1)), own, before, after]), size.astype(float), first[order], count[order], order)


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(a.take(0, axis), a.take(1, axis))


def marginals(field: LineField, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each (state, next state) in all.

    All documents advance together, one line a step; those that have ended drop out.
    """
    n = len(lines.features)
    emit = np.zeros((n, 2))
    emit[:, 1] = lines.features @ field.weights
    ahead, back = emit.copy(), np.zeros((n, 2))
    longest = int(lines.count[0]) if len(lines.count) else 0
    live = np.searchsorted(-lines.count, -np.arange(1, longest + 1), side="right")
    for t in range(1, longest):
        at = lines.first[: live[t]] + t
        ahead[at] += _log_add(ahead[at - 1][:, :, None] + field.step, 1)
    for t in range(longest - 1, 0, -1):
        at = lines.first[: live[t]] + t
        back[at - 1] = _log_add(field.step + (emit[at] + back[at])[:, None, :], 2)
    good = 1 / (1 + np.exp(np.clip(ahead[:, 0] + back[:, 0] - ahead[:, 1] - back[:, 1], -700, 700)))
    inner = np.ones(n, dtype=bool)
    inner[lines.first] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] + field.step + (emit[at] + back[at])[:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    return good, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit_field(texts: list[str | None], labels: np.ndarray, *, rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> LineField:
    """Maximum likelihood by Adam; a line's label is its document's. Documents count alike, whatever their number of lines.
    Without both labels the field is flat."""
    field = LineField(np.zeros(N_FEATURES), np.zeros((2, 2)))
    if not len(texts) or labels.min() == labels.max():
        return field
    lines = read_lines(texts)
    label = labels[lines.order]
    line_label, weight = np.zeros(len(lines.features)), np.zeros(len(lines.features))
    for first, count, y in zip(lines.first, lines.count, label):
        line_label[first : first + count] = y
        weight[first : first + count] = 1 / count
    inner = np.ones(len(line_label), dtype=bool)
    inner[lines.first] = False
    same = np.array([(inner & (line_label == s)).sum() for s in (0, 1)], dtype=float)
    total, pairs = weight.sum(), max(inner.sum(), 1)
    flat = np.zeros(N_FEATURES + 4)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for k in range(1, rounds + 1):
        field = LineField(flat[:N_FEATURES], flat[N_FEATURES:].reshape(2, 2))
        good, expected = marginals(field, lines)
        up = np.concatenate([((line_label - good) * weight) @ lines.features / total, ((np.diag(same) - expected) / pairs).ravel()])
        up -= decay * flat
        mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up**2
        flat = flat + rate / np.sqrt(k) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        flat[N_FEATURES:] = np.clip(flat[N_FEATURES:], -1.5, 1.5)
    return LineField(flat[:N_FEATURES], flat[N_FEATURES:].reshape(2, 2))


def score_texts(field: LineField, texts: list[str | None]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    lines = read_lines(texts)
    good, _ = marginals(field, lines)
    starts = np.sort(lines.first)
    return np.add.reduceat(good * lines.length, starts) / np.add.reduceat(lines.length, starts)


def _slices(texts: list[str | None], rows: int = 500, chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts in order, so many rows and characters at a time, one text at least."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if len(part) >= rows or size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit_line_field(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE,
    sample_chars: int = SAMPLE_CHARS, sample_lines: int = SAMPLE_LINES,
) -> LineField:
    """The field from labelled documents that may be learnt from: `sample` at most, of up to `sample_chars` characters each
    and `sample_lines` lines in all, in the order of a hash of their keys. A repeated key counts with each of its texts."""
    chosen = (
        labels.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_label")).dropna().filter(train_rows(F.col("_id")))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    pairs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, F.col("_key") == F.col("_id"))
    pairs = pairs.filter(F.length("_text") <= sample_chars)
    got = pairs.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).select("_text", "_label").limit(sample).toPandas()
    room = np.cumsum([(t or "").count("\n") + 1 for t in got["_text"]]) <= sample_lines
    got = got[room] if len(got) else got
    return fit_field(got["_text"].tolist(), got["_label"].to_numpy(dtype=float))


def line_quality(docs: DataFrame, field: LineField, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text is one empty line and is scored as such. A null key is
    not held out. Repeated rows get a row each; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(score_texts(shared.value, part) for part in _slices(texts.tolist()))]))

    held = F.coalesce(~train_rows(F.col(key)), F.lit(False))
    return docs.select(F.col(key).alias("doc_id"), held.alias("held_out"), scored(F.col(text)).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0))
