"""The Jaccard join against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from ledgerlight.llm import jaccard
from ledgerlight.llm.components import connected
from ledgerlight.llm.jaccard import Tree, block_keys, jaccard_components, shingle_set

SCHEMA = "doc_id long, text string, node long, keys string"


def plain(rows, words=4, num=85, den=100):
    """Component of each row by brute force."""
    sets = []
    for _, text in rows:
        w = bytes(text or "", "utf-8").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, min(len(w), 1)))})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if (a and b and den * both >= num * (len(a) + len(b) - both)) or same:
                parent[find(i)] = find(j)
    small = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            small[find(i)] = min(small.get(find(i), key), key)
    return [(key, len(s), small.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets))]


def words(rng, n, pool=3000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"y{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[at]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    line = words(rng, 14)
    texts = []
    for n in (1, 2, 3, 4, 5, 7, 9, 13, 20, 33, 60, 64, 65, 127, 128, 150, 260, 400, 900, 3000):
        for _ in range(3):
            base = words(rng, n)
            texts.append(base)
            for e in (0, 1, 1, 2, 2, 3, max(1, n // 60), max(1, n // 40), max(1, n // 25)):
                texts.append(edited(rng, base, e))
            texts.append(line + base)
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(9000, ""), (9001, None), (9002, " \t\n"), (9003, texts[0].upper()), (5, texts[5]), (5, texts[5]), (None, texts[7]), (None, "lonely text of no one"), (None, None)]
    return rows


def check(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in rows], SCHEMA).repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, **options).collect()), key=str)
    threshold = options.get("threshold", (85, 100))
    want = sorted(plain(rows, options.get("words", 4), *threshold), key=str)
    assert [g for g in got if g not in want] == [w for w in want if w not in got] == []
    assert got == want


def test_equals_all_pairs(spark, corpus):
    check(spark, corpus)


def test_five_words_and_other_threshold(spark, corpus):
    check(spark, corpus[:300], words=5, threshold=(80, 100))


def test_large_class_is_split_into_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_SETS", 12)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [(i, " ".join(edited(rng, base, rng.choice((0, 1, 2, 3, 4))))) for i in range(150)]
    chain = [base]
    for _ in range(60):
        chain.append(edited(rng, chain[-1], 2))
    rows += [(1000 + i, " ".join(t)) for i, t in enumerate(chain)] + [(2000, rows[3][1])] * 40
    check(spark, rows)


def test_sets_with_a_common_passage_are_no_class(spark, monkeypatch):
    classes, write = [], jaccard.settle

    def settle(df):
        out = write(df)
        if out.columns == ["root", "parts", "sets"]:
            classes.extend(r.sets for r in out.collect())
        return out

    monkeypatch.setattr(jaccard, "settle", settle)
    rng = random.Random(8)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, 20) + passage + words(rng, rng.randrange(20, 40)))) for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} more") for i in range(5)]
    check(spark, rows)
    assert 5 <= len(classes) and max(classes) < 10


def test_many_sets_of_a_key_meet_in_parts(spark, monkeypatch, corpus):
    monkeypatch.setattr(jaccard, "MEET_SETS", 3)
    check(spark, corpus[:400])


def test_linked_sets_are_joined_by_sizes_and_counts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 60, 130, 500, 520, 1030, 4100):
        sets = []
        for _ in range(4):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            sets += [np.unique(np.concatenate((a[int(n * cut) :], rng.integers(0, 1 << 63, int(n * more), dtype=np.uint64)))) for cut, more in ((0, 0), (0, 0.1), (0.1, 0), (0.07, 0.07), (0, 0.24))]
        bucket = pd.DataFrame({"node": np.arange(len(sets)), "n_shingles": [len(s) for s in sets], "point": [jaccard._point(s) for s in sets]})
        joined = {u: v for u, v in jaccard._stars(bucket, 80, 100)}
        linked = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard._linked(sets[i], sets[j], 80, 100)]
        assert len(linked) >= 4 and all(joined.get(i, i) == joined.get(j, j) for i, j in linked)
        assert n < 60 or len({joined.get(i, i) for i in range(len(sets))}) >= 4


def test_counts_that_do_not_fit_bound_nothing():
    full = np.array([jaccard._FULL, 3] + [0] * 62, dtype=np.uint16).tobytes()
    bucket = pd.DataFrame({"node": [4, 2], "n_shingles": [200_000, 200_000], "point": [full, full]})
    assert jaccard._stars(bucket, 80, 100) == [(4, 2)]


def test_empty_table(spark):
    check(spark, [])


def test_linked_sets_share_a_key_whatever_the_difference():
    rng = np.random.default_rng(2)
    for n in [*range(1, 70), 100, 170, 255, 256, 257, 290]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            gone = rng.integers(0, max(1, n * 15 // 100 + 1))
            more = rng.integers(0, max(1, n * 15 // 100 + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
                assert set(block_keys(a, 85, 100)) & set(block_keys(b, 85, 100)), (n, gone, more)


def test_tree_loses_no_pair_within_the_bound():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (300, 16)) + (rng.random((300, 1)) < 0.3) * rng.poisson(2, (300, 16))
    sizes = points.sum(axis=1)
    tree = Tree(sizes, points)
    for i in range(0, 300, 7):
        bound = np.minimum(points, points[i]).sum(axis=1)
        may = (bound * 185 >= 85 * (sizes + sizes[i])) & (sizes * 100 >= sizes[i] * 85) & (sizes[i] * 100 >= sizes * 85)
        assert sorted(tree.near(int(sizes[i]), points[i], 85, 100)[0]) == np.flatnonzero(may).tolist()


def test_shingles_split_words_at_ascii_space_only():
    assert len(shingle_set("a\xa0b c d e", 4)) == 1 and len(shingle_set("a b c d e", 4)) == 2
    assert (shingle_set("A b", 4) == shingle_set("a\tB\n", 4)).all() and len(shingle_set("É é", 1)) == 2


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 200)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {(r.node, r.root) for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(i, find(i)) for i in parent if find(i) != i}


def test_all_texts_of_one_key_take_part(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    c = b + " more"
    rows = [(5, a), (5, b), (7, c), (8, a + " also"), (9, "alone with some other words here"), (7, "alone with some other words here"), (None, b), (3, "x"), (3, "y"), (3, None)]
    check(spark, rows, threshold=(80, 100))


@pytest.mark.parametrize("num", [85, 70, 50, 40])
def test_long_sets_at_the_threshold_meet_at_any_threshold(num):
    rng = np.random.default_rng(num)
    missed = 0
    for _ in range(300):
        n = 600
        common = int(np.ceil(2 * n * num / (100 + num)))
        both = rng.integers(0, 1 << 64, common, dtype=np.uint64)
        sets = [np.unique(np.concatenate((both, rng.integers(0, 1 << 64, n - common, dtype=np.uint64)))) for _ in range(2)]
        missed += not set(block_keys(sets[0], num, 100)) & set(block_keys(sets[1], num, 100))
    assert missed == 0
    with pytest.raises(ValueError):
        block_keys(both, 0, 100)
