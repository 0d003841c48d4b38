"""Alignment of two tokenizers against both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlight.llm.alignment import Aligner, Vocabularies, align_tokens, byte_ranges, token_groups
from ledgerlight.llm.queries import op12_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, links int"


@pytest.fixture(scope="module")
def aligner():
    return Aligner(Vocabularies(A, B))


class Libraries:
    """Both libraries on whole texts, and all pairs of tokens tried for an overlap."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}

    def tokens(self, text):
        if not text:
            return [], []
        want = (" " + text).encode()
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == want else ([], [])

    def align(self, text):
        """Counts, links and groups text."""
        spans = []
        for tokens in self.tokens(text):
            at, rows = 0, []
            for i, data in tokens:
                rows.append((i, at, at + len(data)))
                at += len(data)
            spans.append(rows)
        a, b = spans
        both = {x[2] for x in a} & {x[2] for x in b}
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        groups, ga, gb, j = [], [], [], 0
        for i, _, e in a:
            ga.append(str(i))
            while j < len(b) and b[j][2] <= e:
                gb.append(str(b[j][0]))
                j += 1
            if e in both:
                groups.append(f"{','.join(ga)}|{','.join(gb)}")
                ga, gb = [], []
        return len(a), len(b), len(groups), links, ";".join(groups)


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def plain(libraries, docs):
    found = [(i, libraries.align(t)) for i, t in docs]
    counts = Counter(x for _, f in found for x in f[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = [
        (i, f[0], f[1], f[2], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]),
         hashlib.sha256(f[4].encode()).hexdigest() if f[0] else "")
        for i, f in found
    ]
    return sorted(rows, key=str)


PARTS = ["a", "The", " ", "  ", "\n", "\t", "\r\n", ";\r", "\x1c", "\xa0", "!", "'s", "don't", "7", "é", "日本語", "----", "<s>", "<|endoftext|>", "</s>", "𝄞",
         "ﬀ", "é", "{}", "word", " tokenizer", "\x00", "🙂", "‍", "　", "();", "Größe", "ёлка", "ÀÀ", "<0x41>", "﻿"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(250)]
    return [*made, "", None, " ", "  ", "\n", "a▁b", "▁", " lead", "trail ", "x" * 500, "日本語" * 90, "The cat.", "The cat."]


def test_parts_give_the_tokens_of_the_whole(aligner, libraries, texts):
    for t in texts:
        if t:
            found, want = aligner.closed([" " + t])[0], libraries.align(t)
            assert (found.n_a, found.n_b, found.n_groups, found.text) == (*want[:3], want[4]), t
            assert [divmod(x, 1 << 20) for x in found.links.tolist()] == want[3]


@pytest.mark.parametrize("span", [1, 2, 3, 7, 20])
def test_any_ranges_compose_to_the_whole_in_any_order(aligner, libraries, texts, span):
    rng = random.Random(span)
    for t in texts:
        want = libraries.align(t)
        if not want[0]:
            continue
        closed = []
        emit = lambda at, c: closed.append((at, c)) if c.n_groups else None
        rows = [aligner.range(*r, emit) for r in byte_ranges(" " + t, span, aligner.shared.together)]
        while len(rows) > 1:
            i = rng.randrange(len(rows) - 1)
            rows[i : i + 2] = [aligner.compose(rows[i], rows[i + 1], emit)]
        assert rows[0].head == rows[0].tail == ([], []) and rows[0].last == len((" " + t).encode())
        pieces = [c for _, c in sorted(closed, key=lambda x: x[0])]
        assert ";".join(c.text for c in pieces) == want[4], t
        assert sorted(x for c in pieces for x in c.links.tolist()) == sorted(a << 20 | b for a, b in want[3])


@pytest.mark.parametrize("span,fan,head_links", [(1 << 16, 8, 500_000), (16, 3, 20), (50, 2, 0)])
def test_equals_libraries(spark, libraries, texts, span, fan, head_links):
    docs = [(i or None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA).repartition(3)
    got = align_tokens(df, A, B, span=span, fan=fan, head_links=head_links)
    assert sorted(map(tuple, got.collect()), key=str) == plain(libraries, docs)


def test_groups_as_text(spark, libraries, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    found = {}
    for r in token_groups(df, A, B, span=64).orderBy("doc_id", "at").collect():
        found.setdefault(r.doc_id, []).append(r.groups)
    assert {i: ";".join(x) for i, x in found.items()} == {i: g for i, t in enumerate(texts) if (g := libraries.align(t)[4])}


def test_very_long_texts_and_no_rows(spark, libraries):
    rng = random.Random(9)
    words = "".join(rng.choice([" one", " and", ", two", "\nthree", "é", "日本", " 12", "'t"]) for _ in range(60_000))
    docs = [(1, words), (2, "y" * 70_000), (3, words[:70_000] + "▁"), (4, words)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    assert sorted(map(tuple, align_tokens(df, A, B, span=5000, fan=3).collect())) == plain(libraries, docs)
    assert align_tokens(df.limit(0), A, B).count() == 0


def test_query_equals_libraries(spark, libraries):
    sf = "/root/testdata/sf0.001"
    got = op12_token_alignment(spark, sf)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", "string")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain(libraries, docs)
