"""Byte-level BPE: the merge list, its sufficient lookahead, and streaming encoder and decoder.

Text is cut into pre-tokens by the vocabulary's pattern and each pre-token is
merged on its own. Short pre-tokens are merged whole. Longer ones go through a
transducer that holds a window of bytes: whatever follows, tokens that end a
lookahead's length before the window's end are final and are emitted.

Lookahead. Whether the rule (x, y) applies can depend on bytes to its right only
if y, or a token at y's right edge that would have become y, is taken first by a
rule (y', z) of smaller rank. That rule can in turn be kept from applying by one
further right, of smaller rank still. So influence travels along chains of rules
with falling ranks, each starting at the right edge of the one before; the
longest chain, measured in bytes, bounds how far ahead a decision can look.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import regex

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRETOKEN = regex.compile(PATTERN)
# White space as the pattern sees it. A cut before white space that follows something else never divides a pre-token.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

SHORT = 48
WINDOW = 4096


def _byte_chars() -> dict[str, int]:
    """The vocabulary file writes printable bytes as themselves and the others as the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Merges:
    """A merge list over bytes, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        spec = json.loads(data)
        self.digest = hashlib.sha256(data).hexdigest()
        chars = _byte_chars()
        of = lambda s: bytes(chars[c] for c in s)
        vocab = spec["model"]["vocab"]
        ids = {of(token): i for token, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.bytes_of = {i: token for token, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.lookahead = self._lookahead()
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _lookahead(self) -> int:
        """Bytes after which no later byte can change a decision."""
        rules = sorted(self.rank_of, key=self.rank_of.get)
        parts = {self.made[self.rank_of[pair]]: pair for pair in reversed(rules)}
        reach: dict[int, int] = {}
        longest = 0
        for left, right in rules:
            edge, further = right, reach.get(right, 0)
            while edge in parts:
                edge = parts[edge][1]
                further = max(further, reach.get(edge, 0))
            span = len(self.bytes_of[right]) + further
            reach[left] = max(reach.get(left, 0), span)
            longest = max(longest, span)
        return longest + max(map(len, self.bytes_of.values()))

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one pre-token held in memory."""
        tokens = [self.byte_ids[b] for b in data]
        return self._merge_short(tokens) if len(tokens) <= SHORT else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        rank, made, none = self.rank_of.get, self.made, len(self.made)
        ranks = [rank(pair, none) for pair in zip(tokens, tokens[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            tokens[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((tokens[i - 1], tokens[i]), none)
            if i < len(ranks):
                ranks[i] = rank((tokens[i], tokens[i + 1]), none)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        rank, n = self.rank_of.get, len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, pair) for i, pair in enumerate(zip(tokens, tokens[1:])) if (found := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (tokens[i], tokens[j]) != pair:
                continue
            tokens[i], tokens[j] = self.made[best], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (found := rank((tokens[a], tokens[b]))) is not None:
                    heapq.heappush(heap, (found, a, (tokens[a], tokens[b])))
        return [t for t in tokens if t >= 0]

    def transduce(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one pre-token that arrives in blocks; holds WINDOW + lookahead bytes and one block at most."""
        held = b""
        for block in blocks:
            held += block
            while len(held) > WINDOW + self.lookahead:
                tokens, end, final = self.merge(held[: WINDOW + self.lookahead]), 0, 0
                for t in tokens:
                    if end + len(self.bytes_of[t]) > WINDOW:
                        break
                    end += len(self.bytes_of[t])
                    final += 1
                yield tokens[:final]
                held = held[end:]
        if held:
            yield self.merge(held)

    def pretoken(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        if len(data) <= WINDOW + self.lookahead:
            return self.merge(data)
        blocks = (data[i : i + WINDOW] for i in range(0, len(data), WINDOW))
        return [t for tokens in self.transduce(blocks) for t in tokens]

    @staticmethod
    def chunks(part: str) -> list[str]:
        return CHUNK.findall(part)

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text's parts, with the id of those that are special tokens."""
        if self._special is None or not any(s in text for s in self.special):
            yield text, None
            return
        for i, part in enumerate(self._special.split(text)):
            if part:
                yield part, self.special[part] if i % 2 else None


@contextmanager
def no_collection():
    """Within it no garbage is collected: memos hold no cycles, and walking them again and again takes half of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memo(dict):
    """Results by chunk of text, made on demand; forgets all when full. Long chunks are not kept."""

    def __init__(self, make, limit: int = 500_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, chunk: str):
        made = self.make(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = made
        return made


class Encoder:
    """Streams texts to token ids, block by block."""

    def __init__(self, merges: Merges, words_kept: int = 300_000, chunks_kept: int = 500_000):
        self.merges = merges
        self.words = words = Memo(lambda piece: tuple(merges.pretoken(piece)), limit=words_kept)
        self.chunks = Memo(lambda chunk: tuple(t for piece in PRETOKEN.findall(chunk) for t in words[piece]), limit=chunks_kept)

    def _long(self, part: str, start: int, end: int, size: int) -> Iterator[list[int]]:
        """The same for a long chunk of a part; long pre-tokens are encoded and emitted window by window."""
        ids: list[int] = []
        seen = start
        for piece in PRETOKEN.finditer(part, start, end):
            a, b = piece.span()
            if b - a > WINDOW:
                yield ids
                yield from self.merges.transduce(part[i : min(i + WINDOW, b)].encode("utf-8") for i in range(a, b, WINDOW))
                ids, seen = [], b
                continue
            ids += self.words[piece[0]]
            if b - seen >= size:
                yield ids
                ids, seen = [], b
        yield ids

    def blocks(self, text: str, size: int = 1 << 16) -> Iterator[list[int]]:
        """Lists of ids that follow one another; each covers about `size` characters."""
        for part, special in self.merges.segments(text):
            if special is not None:
                yield [special]
                continue
            ids: list[int] = []
            known, seen = self.chunks, 0
            if len(part) <= size:
                for found in map(known.__getitem__, CHUNK.findall(part)):
                    ids += found
                yield ids
                continue
            for chunk in CHUNK.finditer(part):
                if chunk.end() - chunk.start() > size:
                    yield ids
                    yield from self._long(part, *chunk.span(), size)
                    ids, seen = [], chunk.end()
                    continue
                ids += known[chunk[0]]
                if chunk.end() - seen >= size:
                    yield ids
                    ids, seen = [], chunk.end()
            yield ids


class Decoder:
    """Ids to text, keeping only the bytes of an unfinished character between calls."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)
