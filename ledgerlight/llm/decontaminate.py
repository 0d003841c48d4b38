"""Passages of a benchmark in documents, by edit distance over words.

Item-sized windows of a document and the items themselves are walked by the same
random bits (CGK embedding): step j reads the word under the pointer and moves on
if the step's bit for that word says so, so that texts a few edits apart fall back
into step and agree in many places. Tables of sampled places find items that a
window may hold; the edit distance to the document is then computed exactly.

Windows are laid where they can matter: an item of n words within e edits leaves a
run of (n - e) / (e + 1) of its words whole, so a window without any of the items'
runs of that length holds no item.

Items of few words would be found by chance within edits: they are looked for word
by word as they stand, by one automaton over all of them. So are texts in scripts
without spaces, character by character.

The benchmark is broadcast in blocks of bounded size, and documents are scanned
once per block; with several blocks, what was found is written after each, so that
one block's index is alive at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import settle
from .hashing import ODD, mix, word_hashes

#: An item is found within this share of its words in edits.
MAX_EDITS = 0.15
#: Items with fewer words are looked for without edits.
MIN_WORDS = 5
#: Items of a block: no more words than this are broadcast at once.
BLOCK_WORDS = 1_000_000
WALKS = 4
TABLES_PER_WALK = 8
PLACES = 3
CLASS_RATIO = 1.25

# Words are runs of letters, digits and non-ASCII characters.
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


_SPACED = bytes(32 if _APART[b] else b for b in range(256))
_PLAIN = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")


def _spaced(text: str) -> str:
    """The words of a text, A-Z lower-cased, one space between them; one character per byte."""
    return b" ".join(text.encode("utf-8").lower().translate(_SPACED).split()).decode("latin-1")


def allowed_edits(n: int, share: float = MAX_EDITS) -> int:
    return int(share * n)


def _runs(words: np.ndarray, q: int) -> np.ndarray:
    turn = np.full(max(len(words) - q + 1, 0), q, dtype=np.uint64)
    for k in range(q):
        turn = turn * ODD + words[k : k + len(turn)]
    return mix(turn)


@dataclass
class SizeClass:
    """Items of similar length; keys are those of their tables, sorted, with the item of each."""

    longest: int
    bits: np.ndarray
    places: np.ndarray
    keys: np.ndarray
    items: np.ndarray

    def table_keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys of the windows at `starts`, one column per table. `words` ends in zeros enough for any walk."""
        columns = []
        for walk, bits in enumerate(self.bits):
            at, seen = starts.copy(), np.empty((len(bits), len(starts)), dtype=np.uint64)
            for j, bit in enumerate(bits):
                seen[j] = words[at]
                at += (mix_bit(seen[j], bit)).astype(np.int64)
            for t, places in enumerate(self.places[walk]):
                key = np.full(len(starts), walk * TABLES_PER_WALK + t + 1, dtype=np.uint64)
                for place in places:
                    key = mix(key * ODD + seen[place])
                columns.append(key)
        return np.stack(columns, axis=1)


def mix_bit(words: np.ndarray, turn: np.uint64) -> np.ndarray:
    return (words * turn) >> np.uint64(63)


class Items:
    """Index of benchmark items: word hashes, runs, and the tables of their embeddings by size class."""

    def __init__(self, items: list[tuple[int, str]], share: float = MAX_EDITS, seed: int = 5):
        few: dict[str, list[int]] = defaultdict(list)
        for i, text in items:
            plain = _spaced(text)
            if plain and plain.count(" ") + 1 < MIN_WORDS:
                few[plain].append(i)
        self.few = ahocorasick.Automaton() if few else None
        for plain, ids in few.items():
            self.few.add_word(plain, (plain, ids))
        if few:
            self.few.make_automaton()
        pairs = [(i, word_hashes(text, _APART)) for i, text in items]
        pairs = [(i, w) for i, w in pairs if len(w) >= MIN_WORDS]
        self.ids, self.words = [i for i, _ in pairs], [w for _, w in pairs]
        self.edits = [allowed_edits(len(w), share) for w in self.words]
        self.q = min(((len(w) - e) // (e + 1) for w, e in zip(self.words, self.edits)), default=1)
        rng = np.random.default_rng(seed)
        by_class = defaultdict(list)
        for k, w in enumerate(self.words):
            by_class[int(np.log(len(w)) / np.log(CLASS_RATIO))].append(k)
        self.classes = [self._size_class(members, rng) for _, members in sorted(by_class.items())]
        runs = [(run, c) for c, (_, members) in enumerate(sorted(by_class.items())) for k in members for run in _runs(self.words[k], self.q)]
        order = np.argsort(np.array([r for r, _ in runs], dtype=np.uint64), kind="stable")
        self.runs = np.array([r for r, _ in runs], dtype=np.uint64)[order]
        self.run_class = np.array([c for _, c in runs], dtype=np.int64)[order]
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.runs >> np.uint64(44)).astype(np.int64)] = True

    def _size_class(self, members: list[int], rng) -> SizeClass:
        shortest, longest = (f(len(self.words[k]) for k in members) for f in (min, max))
        steps = 2 * shortest
        bits = rng.integers(0, 1 << 63, (WALKS, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        places = np.sort(rng.integers(0, max(1, steps * 9 // 10), (WALKS, TABLES_PER_WALK, PLACES)), axis=2)
        made = SizeClass(longest, bits, places, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        pad = np.zeros(steps + 1, dtype=np.uint64)
        keys = np.concatenate([made.table_keys(np.concatenate((self.words[k], pad)), np.zeros(1, np.int64))[0] for k in members])
        owner = np.repeat(np.array(members, dtype=np.int64), WALKS * TABLES_PER_WALK)
        order = np.argsort(keys, kind="stable")
        made.keys, made.items = keys[order], owner[order]
        return made

    def windows(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Window starts by size class, around the items' runs."""
        runs = _runs(words, self.q)
        at = np.flatnonzero(self.sieve[(runs >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return []
        low, high = np.searchsorted(self.runs, runs[at], "left"), np.searchsorted(self.runs, runs[at], "right")
        found = []
        hits = defaultdict(list)
        for place, a, b in zip(at[high > low], low[high > low], high[high > low]):
            for c in set(self.run_class[a:b].tolist()):
                hits[c].append(place)
        for c, places in sorted(hits.items()):
            reach = self.classes[c].longest
            ends = np.array(places, dtype=np.int64)
            marks = np.zeros(len(words) + 2, dtype=np.int64)
            np.add.at(marks, np.maximum(ends - reach, 0), 1)
            np.add.at(marks, ends + 1, -1)
            found.append((c, np.flatnonzero(np.cumsum(marks)[:-1] > 0)))
        return found


def best_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any stretch of `words`, and where the first such stretch ends (bit-parallel)."""
    m = len(item)
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for place, w in enumerate(words.tolist()):
        x = masks.get(w, 0) | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d | plus)), d & plus
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(d | up)), d & up
        if score < best:
            best, end = score, place + 1
    return best, end


def find_few(text: str | None, items: Items) -> list[tuple[int, int, int]]:
    """Items of few words that stand in the text as they are: (item, 0, place where the first one ends, in words).

    Where an item begins or ends with an ASCII letter or digit, no other one may
    touch it; in scripts without spaces an item may be a part of a longer run.
    """
    if not text or items.few is None:
        return []
    plain = _spaced(text)
    found: dict[int, int] = {}
    for last, (item, ids) in items.few.iter(plain):
        first = last - len(item) + 1
        cut = first and item[0] in _PLAIN and plain[first - 1] in _PLAIN or last + 1 < len(plain) and item[-1] in _PLAIN and plain[last + 1] in _PLAIN
        if not cut and ids[0] not in found:
            found.update(dict.fromkeys(ids, plain.count(" ", 0, last + 1) + 1))
    return [(i, 0, end) for i, end in found.items()]


def find_items(texts: list[str | None], items: Items) -> list[list[tuple[int, int, int]]]:
    """Per text: (item, edits, place where the passage ends, in words), least edits first for each item."""
    words, starts, place = [], {}, 0
    pad = np.zeros(max((c.bits.shape[1] for c in items.classes), default=0) + 1, dtype=np.uint64)
    per_class = defaultdict(list)
    for k, text in enumerate(texts):
        w = word_hashes(text, _APART) if text else np.zeros(0, np.uint64)
        if len(w) < items.q or not items.classes:
            continue
        near = items.windows(w)
        if near:
            for c, at in near:
                per_class[c].append((k, at, at + place))
            starts[k] = w
            words += [w, pad]
            place += len(w) + len(pad)
    found = [find_few(text, items) for text in texts]
    if not words:
        return [sorted(x) for x in found]
    joined = np.concatenate(words)
    regions: dict[tuple[int, int], list[int]] = {}
    for c, parts in per_class.items():
        size = items.classes[c]
        owner = np.concatenate([np.full(len(at), k) for k, at, _ in parts])
        local = np.concatenate([at for _, at, _ in parts])
        keys = size.table_keys(joined, np.concatenate([g for _, _, g in parts]))
        low, high = np.searchsorted(size.keys, keys, "left"), np.searchsorted(size.keys, keys, "right")
        for row, column in zip(*np.nonzero(high > low)):
            for item in size.items[low[row, column] : high[row, column]]:
                span = regions.setdefault((int(owner[row]), int(item)), [int(local[row]), int(local[row])])
                span[0], span[1] = min(span[0], int(local[row])), max(span[1], int(local[row]))
    for (k, item), (first, last) in regions.items():
        w, e = items.words[item], items.edits[item]
        begin = max(0, first - e)
        edits, end = best_match(w, starts[k][begin : last + len(w) + e])
        if edits <= e:
            found[k].append((items.ids[item], edits, begin + end))
    return [sorted(x) for x in found]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    rows, size = [], 0
    for row in benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).dropna().toLocalIterator():
        words = len(row["t"]) // 2 + 1
        if rows and size + words > BLOCK_WORDS:
            yield rows
            rows, size = [], 0
        rows.append((row["i"], row["t"]))
        size += words
    if rows:
        yield rows


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS,
    into: str = "_leaks",
) -> DataFrame:
    """All rows and columns, with an array `into`: the items found in the text, as (item_id, edits, end_word).

    An item is found if a stretch of the text is within int(max_edits * n) word
    edits of its n words; words are compared without case and punctuation. end_word
    counts the words up to the stretch's end. Null and empty texts hold nothing.
    Items with fewer than MIN_WORDS words are found as they stand only, word by word,
    or character by character at an edge beyond ASCII. Items without id, text or
    words are not looked for. Equal items are all reported. Repeated rows are judged
    alike. A column named like `into` is replaced.
    """
    kind = "array<struct<item_id:long,edits:int,end_word:int>>"
    rows, shared = docs.withColumn(into, F.expr(f"cast(array() as {kind})")), None
    for block in _blocks(benchmark, item, item_text):
        if shared is not None:
            rows = settle(rows)
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, max_edits))
        rows = rows.withColumn(into, F.concat(into, _searched(shared, kind)(F.col(text))))
    return rows


def _searched(shared, kind: str):
    @F.pandas_udf(kind)
    def searched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = find_items(texts.tolist(), shared.value)
            yield pd.Series([[{"item_id": i, "edits": e, "end_word": at} for i, e, at in r] for r in rows], dtype=object)

    return searched


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, end_word."""
    rows = with_leaks(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    return rows.select("doc_id", F.inline("_leaks"))
