"""Quality rules: fixed rules on word statistics, then boosted trees over document statistics.

Statistics are taken in Python workers from whole texts. Trees are fitted on the
driver on a bounded sample of labelled documents' statistics and broadcast as
node arrays of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import Forest, fit

#: Labelled documents that the trees are fitted on, at most: those with the smallest hash of their key.
SAMPLE = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Feature and direction: +1 quality never falls with it, -1 never rises, 0 free.
FEATURES = {
    "symbol_share": -1, "upper_share": -1, "dup_line_share": -1, "repeat_share": -1, "exclaim_per_word": -1,
    "bar_per_word": -1, "log_words": 1, "word_length": 0, "stop_per_word": 0, "digit_share": 0, "short_line_share": 0,
}
_NUMPY_FROM = 20_000

_SYMBOL, _BAR, _EXCLAIM, _UPPER, _DIGIT, _STOP = range(6)
_KINDS = np.zeros((6, 256), dtype=bool)
for _kind, _chars in enumerate((b"#*$%&|<>", b"|", b"!", bytes(range(65, 91)), b"0123456789", b".?,;:")):
    _KINDS[_kind, list(_chars)] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_START = (np.arange(256) & 0xC0) != 0x80


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(words)
    if n < 4 or n <= _NUMPY_FROM and len(set(zip(words, words[1:], words[2:]))) == n - 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(codes[:-1] * len(number) + codes[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(number) + codes[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def document_stats(text: str | None) -> list[float]:
    """BASE counts, then FEATURES."""
    data = (text or "").encode("utf-8")
    words, lines = data.split(), data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    array = np.frombuffer(data, dtype=np.uint8)
    hist = np.bincount(array, minlength=256)
    kinds = _KINDS @ hist
    chars = int(hist[_START & ~_SPACE].sum())
    n, dup, repeat = len(words), len(filled) - len(set(filled)), _repeated(words)
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    return [
        n, chars, int(kinds[_SYMBOL]), dup, repeat,
        kinds[_SYMBOL] * per_char, kinds[_UPPER] * per_char, dup / max(len(filled), 1), repeat * per_word, kinds[_EXCLAIM] * per_word,
        kinds[_BAR] * per_word, np.log1p(n), chars * per_word, kinds[_STOP] * per_word, kinds[_DIGIT] * per_char,
        sum([len(x) < 20 for x in filled]) / max(len(filled), 1),
    ]


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _frame(texts: pd.Series) -> tuple[pd.DataFrame, np.ndarray]:
    stats = np.array([document_stats(t) for t in texts], dtype=float).reshape(len(texts), len(BASE) + len(FEATURES))
    return pd.DataFrame(stats[:, : len(BASE)].astype(np.int64), columns=list(BASE)), stats[:, len(BASE) :]


def train_rows(key: Column) -> Column:
    """True for keys that models may learn from; the rest is held out."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(4)) != 2


def fit_rules(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE,
) -> Forest:
    """Trees from `sample` labelled documents at most, whatever the corpus's size; their keys and labels are broadcast."""
    chosen = (
        labels.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_label")).dropna().filter(train_rows(F.col("_id")))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_frame(texts)[1]))

    pairs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"))
    got = pairs.select(features("_text").alias("x"), "_label").limit(sample).toPandas()
    rows = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return fit(rows, got["_label"].to_numpy(dtype=float), np.array(list(FEATURES.values())))


def quality_rules(
    docs: DataFrame, forest: Forest, *, text: str = "text", keep_from: float = KEEP_FROM, into: str = "_quality",
) -> DataFrame:
    """All rows and columns, with a struct `into`: the BASE counts, base_failed, quality_score, kept.

    A null or empty text has no words, so it fails the base rules (fewer than 50
    words, or more than half of the words in repeated windows) and is not kept.
    Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf(f"{_STATS}, base_failed boolean, quality_score double, kept boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out, rows = _frame(texts)
            out["base_failed"] = (out.n_words < MIN_WORDS) | (100 * out.n_repeat_words > MAX_REPEAT_PERCENT * out.n_words)
            out["quality_score"] = shared.value.probability(rows)
            out["kept"] = ~out.base_failed & (out.quality_score >= keep_from)
            yield out

    return docs.withColumn(into, judged(F.col(text)))
