"""Benchmark passages against a scan of every document for every item."""

import random

import pytest

from ledgerlight.llm.decontaminate import _APART, Items, allowed_edits, best_match, find_items, leaks, with_leaks
from ledgerlight.llm.hashing import word_hashes

SCHEMA = "doc_id long, text string, item_id string, _leaks int"


def plain_distance(item, words):
    """Least edits to any stretch, by the textbook table."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(words, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1))
    return min(row)


def words_of(text):
    return word_hashes(text, _APART).tolist()


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = f"e{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"i{rng.randrange(10**6)}")
        else:
            del out[at]
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    some = lambda n: [f"w{int(rng.paretovariate(0.7))}" for _ in range(n)]
    items = [(i, some(rng.choice((6, 12, 20, 33, 50, 70)))) for i in range(60)]
    docs = []
    for k in range(240):
        body = some(rng.choice((0, 30, 300)))
        if k % 3:
            _, item = items[k % 60]
            at = rng.randrange(len(body) + 1)
            body[at:at] = edited(rng, item, rng.randint(0, allowed_edits(len(item)))) if k % 3 == 1 else item
        docs.append((k, ", ".join(body).upper()))
    return [(i, " ".join(w)) for i, w in items], docs


def test_bit_parallel_distance_equals_table():
    rng = random.Random(2)
    import numpy as np
    for _ in range(200):
        item, text = ([rng.randrange(4) for _ in range(rng.randint(1, n))] for n in (12, 30))
        assert best_match(np.array(item), np.array(text))[0] == plain_distance(item, text)


def test_recall_and_exactness(planted):
    items, docs = planted
    index = Items(items)
    want = {}
    for k, text in docs:
        w = words_of(text)
        for i, item in items:
            m = words_of(item)
            edits = plain_distance(m, w) if w else len(m)
            if edits <= allowed_edits(len(m)):
                want[k, i] = edits
    got = {(k, i): e for (k, _), found in zip(docs, find_items([t for _, t in docs], index)) for i, e, _ in found}
    assert all(want[x] <= e for x, e in got.items())
    whole = {x for x, e in want.items() if e == 0}
    assert whole <= set(got) and len(set(want) & set(got)) >= 0.97 * len(want)
    assert sum(want[x] == e for x, e in got.items()) >= 0.99 * len(got)


def test_table(spark, planted):
    items, docs = planted
    rows = [(*d, "x", 1) for d in docs] + [(900, None, "x", 1), (901, "", "x", 1), (None, items[2][1], "x", 1), (902, "word " * 20_000 + items[3][1], "x", 1)]
    rows += [rows[1], rows[1]]
    bench = spark.createDataFrame([*items, (70, None), (71, "two words"), (None, items[1][1]), (72, items[3][1])], "item_id long, text string")
    table = spark.createDataFrame(rows, SCHEMA)
    got = leaks(table, bench).collect()
    assert {(r.item_id, r.edits) for r in got if r.doc_id == 902} == {(3, 0), (72, 0)}
    assert (2, 0) in {(r.item_id, r.edits) for r in got if r.doc_id is None} and not {70, 71} & {r.item_id for r in got}
    assert sum(r.doc_id == 1 and r.item_id == 1 for r in got) == 3
    assert with_leaks(table, bench).count() == len(rows)
    assert leaks(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert leaks(table, bench.limit(0)).count() == 0


def test_items_of_few_words_are_found_as_they_stand(spark):
    items = [(1, "Capital of France: Paris"), (2, "日本の首都はどこですか。東京"), (3, "capital, of France (paris)?"), (4, "x1"), (5, " .,"), (6, "été")]
    docs = [(1, "The CAPITAL of France -- Paris. And more"), (2, "質問：日本の首都はどこですか。東京です"), (3, "capital of old France paris"), (4, "ax1 x12 1x1"),
            (5, "so: x1!"), (6, None), (7, ""), (8, "un étét"), (9, "capital of france parisian"), (10, "paris capital of france")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    assert sorted(map(tuple, leaks(df, bench).collect())) == [
        (1, 1, 0, 5), (1, 3, 0, 5), (2, 2, 0, 1), (5, 4, 0, 2), (8, 6, 0, 2)]


def test_several_blocks_find_what_one_finds(spark, planted, monkeypatch):
    from ledgerlight.llm import decontaminate

    items, docs = planted
    bench = spark.createDataFrame([*items, (900, "w1 w2")], "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs[:60]], SCHEMA)
    exact = lambda found: sorted((r.doc_id, r.item_id) for r in found.collect() if r.edits == 0)
    whole = exact(leaks(df, bench))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 800)
    assert whole and exact(leaks(df, bench)) == whole
