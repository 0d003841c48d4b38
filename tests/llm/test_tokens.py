"""Token counts and BPE round trips against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlight.llm.bpe import WINDOW, Encoder, Merges
from ledgerlight.llm.tokens import count_tokens, decode, encode, round_trip, whole_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return Merges(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["a", "aa", " ", "  ", "\n", "\t", "\x1c", "\xa0", "\x85", "!", "'s", "'ll", "7", "é", "日本", "----", "<|endoftext|>", "the", "\r\n", "𝄞", "ﬀ"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    long = ["a" * 20_000, "=" * 9000, " " * 7001, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "word and more. " * 12_000]
    return [*made, *long, "", None, "<|endoftext|>", "The cat.", "The cat."]


def test_transducer_equals_library_on_long_pretokens(merges, library):
    rng = random.Random(5)
    for alphabet in (["a"], ["a", "b"], list("abcdefghijklmnopqrstuvwxyz"), ["tion", "er", "ing", "the", "re"], ["Ã", "Â"], ["-", "="]):
        text = "".join(rng.choice(alphabet) for _ in range(3 * WINDOW))
        assert [i for ids in merges.transduce([text.encode()[k : k + 100] for k in range(0, len(text.encode()), 100)]) for i in ids] \
            == library.encode(text, add_special_tokens=False).ids


def test_blocks_of_any_size_give_the_same_ids(merges, library):
    text = "Some words, é and\n\n  more 123 <|endoftext|> here's the rest " * 50
    for size in (1, 7, 100, 1 << 16):
        assert [i for ids in Encoder(merges).blocks(text, size) for i in ids] == library.encode(text, add_special_tokens=False).ids


def test_blocks_of_a_long_pretoken_are_short(merges, library):
    rng = random.Random(8)
    run = "".join(rng.choice("abcdefghé") for _ in range(200_000))
    for text in (f"Some words {run} and more", run + " " * 70_000 + "x", "1!" * 50_000):
        blocks = list(Encoder(merges).blocks(text))
        assert [i for ids in blocks for i in ids] == library.encode(text, add_special_tokens=False).ids
        assert max(map(len, blocks)) <= 1 << 16


def test_whole_tokens_are_single_tokens(merges, library):
    whole = whole_tokens(merges)
    assert len(whole) > 40_000 and " the" in whole
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[::20])


def test_queries_equal_library(spark, library, texts):
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i or None] = (len((t or "").encode()), ids, back)
    counts = count_tokens(docs, PATH).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counts} == {i: (b, len(x), len(x) > 512) for i, (b, x, _) in want.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    trips = round_trip(docs, PATH).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in trips} == {
        i: (len(x), sha(",".join(map(str, x))), sha(back)) for i, (_, x, back) in want.items()}
    ids = encode(docs, PATH)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: x for i, (_, x, _) in want.items()} and ids.filter("not exact").isEmpty()
    assert {r.doc_id: r.text for r in decode(ids, PATH).collect()} == {i: back for i, (_, _, back) in want.items()}


def test_broken_bytes_and_no_rows(spark, library):
    rows = spark.createDataFrame([(1, [447]), (2, None), (3, [447, 247, 12520])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode(rows, PATH).collect()} == {
        1: library.decode([447], skip_special_tokens=False), 2: "", 3: library.decode([447, 247, 12520], skip_special_tokens=False)}
    none = spark.createDataFrame([], SCHEMA)
    assert count_tokens(none, PATH).count() == round_trip(none, PATH).count() == encode(none, PATH).count() == 0
