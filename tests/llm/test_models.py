"""Quality rules, line classifier and language: plain counts, held-out accuracy, odd input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm.language import CrossParser, fit_parser, phrases, predict_language, suffix_automaton
from ledgerlight.llm.linecrf import N_FEATURES, LineField, fit_line_field, line_quality, marginals, read_lines, score_texts
from ledgerlight.llm.quality import FEATURES, fit_rules, quality_rules
from ledgerlight.llm.trees import fit

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, kept int, score string"
ODD = ["", None, " \n\t", "one", "a b c a b c", "x\n\nx\nx \n y", "é\x0bü\xa0ß c", "the " * 200, "| # ! \n" * 40, "word " * 30_000 + "end", "AB CD\n" * 3000]


def odd_rows(spark):
    rows = [(i, t, None, 1, "x") for i, t in enumerate(ODD)] + [(0, "", None, 1, "x"), (None, "some words here", None, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 5000 else len(lines) - len(set(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def forest(tables):
    return fit_rules(*tables)


def test_base_counts(spark, tables, forest):
    docs = odd_rows(spark).select("doc_id", "text").unionByName(tables[0].select("doc_id", "text").limit(300))
    got = quality_rules(docs, forest).select("text", "_quality.*").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(r.text)
        assert not (r.kept and r.base_failed)
    assert len(got) == len(ODD) + 2 + 300


def test_rules_on_held_out_labels(tables, forest):
    docs, labels = tables
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    rows = quality_rules(docs.join(labels, "doc_id").filter(held), forest).select("quality", "_quality.*").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in rows)


def test_trees_keep_their_direction_and_flat_scoring():
    rng = np.random.default_rng(0)
    rows = rng.random((2000, 3))
    labels = (rows[:, 0] + 0.3 * np.sin(9 * rows[:, 1]) + 0.3 * rng.random(2000) > 0.6).astype(float)
    forest = fit(rows, labels, np.array([1, 0, -1]))
    assert ((forest.probability(rows) > 0.5) == labels).mean() > 0.85
    grid = np.linspace(0, 1, 40)
    for base in rng.random((60, 3)):
        for f, way in ((0, 1), (2, -1)):
            line = np.repeat(base[None], 40, axis=0)
            line[:, f] = grid
            assert (way * np.diff(forest.raw(line)) >= -1e-9).all()
    node = [0] * len(forest.feature)
    one = rows[:1]
    total = forest.base
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if one[0, feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    assert abs(total - forest.raw(one)[0]) < 1e-9


def test_no_labels_reject_nothing_more(spark, tables):
    docs, labels = tables
    empty = fit_rules(docs, labels.limit(0))
    rows = quality_rules(docs.limit(50), empty).select("_quality.*").collect()
    assert len(FEATURES) and all(r.kept != r.base_failed for r in rows)
    assert quality_rules(docs.limit(0), empty).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    texts = ["a\nB C!\n***\nlast one.", "", "one\ntwo | |"]
    field = LineField(rng.normal(size=N_FEATURES), rng.normal(size=(2, 2)))
    lines = read_lines(texts)
    good, pairs = marginals(field, lines)
    want_pairs = np.zeros((2, 2))
    for first, count in zip(lines.first, lines.count):
        emit = lines.features[first : first + count] @ field.weights
        weight, on = 0.0, np.zeros(count)
        pair = np.zeros((2, 2))
        for code in range(1 << count):
            path = [code >> k & 1 for k in range(count)]
            w = np.exp(sum(e for e, s in zip(emit, path) if s) + sum(field.step[a, b] for a, b in zip(path, path[1:])))
            weight += w
            on += w * np.array(path)
            for a, b in zip(path, path[1:]):
                pair[a, b] += w
        assert np.allclose(good[first : first + count], on / weight)
        want_pairs += pair / weight
    assert np.allclose(pairs, want_pairs)
    assert len(score_texts(field, [])) == 0


def test_line_quality_on_held_out_labels(spark, tables):
    docs, labels = tables
    field = fit_line_field(docs, labels)
    got = line_quality(docs.join(labels.select("doc_id", "quality"), "doc_id"), field)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    odd = line_quality(odd_rows(spark), field).collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    assert line_quality(odd_rows(spark).limit(0), field).count() == 0


def test_automaton_holds_all_substrings():
    words = ["banana", "bandana", "abba", "na", "straße"]
    keys, values = suffix_automaton(words)
    edges = dict(zip(keys.tolist(), values.tolist()))
    inside = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}

    def plain(word):
        count = at = 0
        while at < len(word):
            end = at + 1
            while end < len(word) and word[at : end + 1] in inside:
                end += 1
            count, at = count + 1, end
        return count

    for w in [*inside, "bananabba", "xyz", "nanax", "dabbana", "ßa", ""]:
        assert phrases(edges, w) == plain(w)


def test_language_on_held_out_documents(spark, tables):
    docs, _ = tables
    parser = fit_parser(docs)
    rows = predict_language(docs, parser).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    odd = {r.doc_id: r for r in predict_language(odd_rows(spark), parser).collect()}
    assert {odd[i].lang_pred for i in (0, 1, 2)} == {"und"} and odd[1].score == 0 and odd[9].lang_pred in parser.languages
    assert all(0 <= r.score <= 1 for r in odd.values())
    nothing = CrossParser((), ())
    assert fit_parser(docs.withColumn("lang", F.lit(None).cast("string"))) == nothing
    assert {r.lang_pred for r in predict_language(docs.limit(20), nothing).collect()} == {"und"}


def test_language_without_spaces_is_learnt(spark):
    rng = random.Random(4)
    glued = lambda syllables, n: "".join(rng.choice(syllables) for _ in range(n))
    rows = [(i, glued(("ka", "mo", "ri", "tu"), 60), "glued") for i in range(60)]
    rows += [(100 + i, " ".join(glued(("bel", "dor", "fen"), 2) for _ in range(30)), "spaced") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = fit_parser(docs)
    assert parser.languages == ("glued", "spaced")
    got = predict_language(docs, parser).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got)


def _labelled(spark, rows):
    return spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string")


def test_every_learnt_language_can_be_predicted_and_ties_go_to_the_first(spark):
    from ledgerlight.llm.language import fit_parser, predict_language

    rows = [("red green blue " * 5, "a")] * 40 + [("red green", "b")] * 40 + [("one two three", "q"), ("one two three", "p")] * 30
    parser = fit_parser(_labelled(spark, rows))
    assert parser.languages == ("a", "b", "p", "q")
    got = {r.doc_id: r.lang_pred for r in predict_language(_labelled(spark, [("one two", None), ("two three one", None), ("zzz", None), ("", None)]), parser).collect()}
    assert got[0] == got[1] == "p" and got[2] in parser.languages and got[3] == "und"


def test_a_language_learnt_from_little_text(spark):
    import random

    from ledgerlight.llm.language import fit_parser, predict_language

    rng = random.Random(12)
    syllables = {"much": "ka to mi re sol va nu pi da ler".split(), "little": "sha gro uf elt ym orv ast idj kwe zo".split()}
    text = lambda l: " ".join("".join(rng.choice(syllables[l]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    parser = fit_parser(_labelled(spark, [(text("much"), "much") for _ in range(1500)] + [(text("little"), "little") for _ in range(30)]))
    fresh = [(text(l), l) for l in ("much", "little") for _ in range(200)]
    got = {r.doc_id: r.lang_pred for r in predict_language(_labelled(spark, fresh), parser).collect()}
    assert sum(got[i] == l for i, (_, l) in enumerate(fresh)) >= 0.9 * len(fresh)
    assert all(sum(got[i] == l for i, (_, l) in enumerate(fresh) if l == name) >= 180 for name in syllables)


def test_line_field_takes_bounded_samples_in_hash_order(spark):
    from ledgerlight.llm.linecrf import fit_line_field

    docs = spark.createDataFrame([(i, ("good line\n" if i % 2 else "$$$ ###\n") * 20, i) for i in range(300)], "doc_id long, text string, x long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    one, other = (fit_line_field(d, labels, sample_lines=500) for d in (docs.repartition(5), docs.repartition(2, "x")))
    assert (one.weights == other.weights).all() and (one.step == other.step).all()
    assert not fit_line_field(docs, labels, sample_chars=10).weights.any()
