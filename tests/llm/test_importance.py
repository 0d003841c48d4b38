"""Importance resampling against a plain version."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from ledgerlight.llm import importance
from ledgerlight.llm.importance import importance_ranks, resample
from ledgerlight.llm.queries import op11_importance_resampling

SCHEMA = "doc_id long, text string, rank string, score int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def plain(docs, target):
    """Rows of (doc_id, n_features, weight, score, rank) by the definition; docs have no equal keys."""
    here, there = Counter(), Counter()
    for _, t in docs:
        here.update(features(t)[1])
    for t in target:
        there.update(features(t)[1])
    S, T = sum(here.values()), sum(there.values())
    gain = lambda b: math.floor(1000 * math.log((there[b] + 1) * (S + 10_000) / ((here[b] + 1) * (T + 10_000))))
    rows, eligible = {}, []
    for i, t in docs:
        n, found = features(t)
        weight = math.floor(sum(map(gain, found)) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= 20:
            eligible.append(i)
    eligible.sort(key=lambda i: (-rows[i][2], i is None, i))
    for k, i in enumerate(eligible[: 25 * len(eligible) // 100]):
        rows[i][3] = k + 1
    return {i: tuple(r) for i, r in rows.items()}


def result(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()}


TEXTS = [
    *(f"Some Words about number {i % 7} and the same words again, {'again ' * (i % 30)}" for i in range(60)),
    None, "", " ,;: ", "one", "É é ÀB àb 日本語 テキスト x" * 9, "a" * 3000 + " b " * 40, "Word\nword\tWORD_word-word'word" * 30,
    "tail" * 20 + " x y z " * 25,
]


@pytest.mark.parametrize("flush,piece,words,pairs", [(200_000, 1 << 20, 50_000, 200_000), (7, 16, 50_000, 200_000), (50, 64, 3, 2), (50, 64, 0, 0)])
def test_equals_plain_version_at_any_head_and_block_size(spark, monkeypatch, flush, piece, words, pairs):
    docs = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)]
    target = ["again and again the words", "日本語 x", None, ""]
    for name, value in (("_FLUSH", flush), ("_PIECE", piece), ("HEAD_WORDS", words), ("HEAD_PAIRS", pairs)):
        monkeypatch.setattr(importance, name, value)
    # the size of blocks reaches the workers with the functions' module only in this process, so blocks are compared here
    data = [t.encode() if t else b"" for t in TEXTS]
    head = importance.Head([b"words", b"again", b"and"][:words], [(b"words", b"again")][:pairs], 10_000)
    got = Counter()
    for block in importance._blocks(data):
        got.update(zip(*(x.tolist() for x in head.features(*block))))
    assert got == Counter((i, b) for i, t in enumerate(TEXTS) for b in features(t)[1])
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA).repartition(3)
    assert result(importance_ranks(df, spark.createDataFrame([(t,) for t in target], "text string"))) == plain(docs, target)


def test_ties_and_repeated_rows(spark):
    text = "twenty words " * 10
    df = spark.createDataFrame([(5, text, "x", 1)] * 8 + [(None, text, "x", 1)] * 4, SCHEMA)
    got = importance_ranks(df, df.limit(1)).collect()
    assert len(got) == 12 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    scores = sorted((r.score for r in got), reverse=True)
    assert min(r.score for r in got if r["rank"]) >= scores[3]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b " * 20, "x", 1)], SCHEMA)
    assert importance_ranks(none, some).count() == 0
    assert result(importance_ranks(some, none))[1][3] is None


def test_sample_holds_whole_rows(spark):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS)], SCHEMA)
    want = {i for i, r in plain(list(enumerate(TEXTS)), TEXTS[:5]).items() if r[3]}
    got = resample(df, df.limit(5)).collect()
    assert {r.doc_id for r in got} == want and all(r.text == TEXTS[r.doc_id] and r.score == r.doc_id for r in got)


def test_query_equals_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = op11_importance_resampling(spark, sf)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert result(df) == plain(docs, target)
