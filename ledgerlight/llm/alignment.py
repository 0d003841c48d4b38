"""Alignment of two tokenizers' tokens over the same bytes.

Where a token of both ends at the same byte, the text falls into groups: the
fewest tokens of either side that cover the same bytes. Two tokens are linked if
their bytes overlap, so links lie within groups.

Fragments. The tokens that either side has on a byte range form a fragment: an
open prefix before the first byte where both end, closed groups, and an open
suffix. Fragments of neighbouring ranges compose: the left one's suffix and the
right one's prefix meet and may close groups. Composition is associative, so the
ranges of a very long document are tokenized in tasks of their own and then
composed as a tree, several at a time. Closed groups stay where they were made;
only open ends travel.

Ranges. Each tokenizer has its own safe cuts, so the two sides of a range may
differ by some bytes. Byte-level BPE may be cut where a letter is followed by
something else, or white space follows something else: no pre-token goes across.
Piece BPE may be cut between two characters that stand side by side in no piece:
no merge goes across. A text without safe cuts stays in one range.

The places where both may be cut at once, mostly word ends, divide a text into
short fragments closed on both sides, which workers remember.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import settle
from .bpe import PATTERN, Merges

#: Characters of a range; longer texts are divided. Fragments that one task composes. Most frequent id pairs that are broadcast.
SPAN, FAN, HEAD_LINKS = 1 << 16, 8, 500_000
# Texts that a worker remembers, and texts that it takes at a time.
_MEMO, _SOME = 150_000, 200
# Rows that cross to a worker at once.
_BATCH = 1000

# Ends where a letter is followed by something else, or white space by none before it.
_PART = regex.compile(r"\s*[^\s\p{L}]*\p{L}+|\s*[^\s\p{L}]+|\s+")
_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\S)(?=\s)")
_SHIFT = 20
# Between tokens of one side, between the sides, between groups, between texts.
_SEPARATORS = ",|;\n"


@contextmanager
def _small_batches(df: DataFrame):
    """Tables written meanwhile send their rows to Python a thousand at a time, so that long texts and lists do not pile up there."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(min(_BATCH, int(before)) if int(before) > 0 else _BATCH))
    try:
        yield
    finally:
        conf.set(name, before)


class Vocabularies:
    """What both tokenizers' files say, read on the driver: sizes are those of the vocabularies."""

    def __init__(self, bytes_path: str, pieces_path: str):
        merges = Merges(bytes_path)
        if [merges.made[r] for r in range(len(merges.made))] != list(range(256, 256 + len(merges.made))) or max(merges.byte_ids) > 255:
            raise ValueError(f"{bytes_path}: token ids must follow the order of the merges")
        plain = range(256 + len(merges.made))
        self.ranks = {merges.bytes_of[i]: i for i in plain}
        self.a_size = [len(merges.bytes_of[i]) for i in plain]
        with open(pieces_path, "rb") as file:
            self.model = file.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = list(map(len, self.b_bytes))
        texts = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.together = {t[k : k + 2] for t in texts for k in range(len(t) - 1)}
        if any("\n" in t for t in texts) or sp.encode("\n") != [sp.piece_to_id("▁"), sp.piece_to_id("<0x0A>")]:
            raise ValueError(f"{pieces_path}: a line feed must be a byte piece, a space must be put before texts")
        self.digest = hashlib.sha256(self.model + merges.digest.encode()).hexdigest()


class Closed(NamedTuple):
    """Groups that are closed on both sides."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    links: np.ndarray
    valid: bool = True


NOTHING = Closed(0, 0, 0, "", np.zeros(0, dtype=np.int64))
BROKEN = NOTHING._replace(valid=False)


class Fragment(NamedTuple):
    """Tokens of a byte range: starts and ends of either side, the first and last byte where both end, open tokens before and after."""

    starts: tuple[int, int]
    ends: tuple[int, int]
    first: int | None
    last: int | None
    head: tuple[list[int], list[int]]
    tail: tuple[list[int], list[int]]
    valid: bool = True


class Store:
    """Short texts that are closed on both sides, with their groups; emptied when full."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        # per text: tokens of either side, groups, links, whether the pieces give it back, and where its links begin
        self.facts = np.zeros((0, 6), dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int64)

    def add(self, parts: list[str], texts: list[str], facts: np.ndarray, links: np.ndarray) -> None:
        self.number.update(zip(parts, range(len(self.texts), len(self.texts) + len(parts))))
        self.texts += texts
        begins = len(self.links) + np.cumsum(facts[:, 3]) - facts[:, 3]
        self.facts = np.concatenate((self.facts, np.column_stack((facts, begins))))
        self.links = np.concatenate((self.links, links))

    def full(self) -> bool:
        return len(self.texts) > _MEMO or len(self.links) > 20 * _MEMO


class Aligner:
    """Both tokenizers of one Python worker, with the short texts it has seen."""

    def __init__(self, shared: Vocabularies):
        self.shared = shared
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=shared.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=shared.model)
        self.a_size, self.b_size = np.array(shared.a_size), np.array(shared.b_size)
        self.b_bytes = shared.b_bytes
        self.glue = {pair[1] for pair in shared.together if _CUT.search(pair)}
        self.shown = [f"{i}{sep}" for i in range(max(len(self.a_size), len(self.b_size))) for sep in _SEPARATORS]
        self.store = Store()

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        """Pieces of parts that stand within a text, so no space is to be put before them."""
        plain = [p[0] == " " and len(p) > 1 for p in parts]
        ids = self.b.encode([p[1:] if x else "\n" + p for p, x in zip(parts, plain)], num_threads=1)
        return [i if x else i[2:] for i, x in zip(ids, plain)]

    def parts(self, text: str) -> list[str]:
        """The text divided where both tokenizers may be cut."""
        found = _PART.findall(text)
        if any(c in text for c in self.glue):
            glued = found[:1]
            for part in found[1:]:
                if glued[-1][-1] + part[0] in self.shared.together:
                    glued[-1] += part
                else:
                    glued.append(part)
            return glued
        return found

    def groups(self, a: list[list[int]], b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For texts of some bytes each: their groups as text, the numbers of tokens of either side, groups and links, and all links.

        Every token end is a link's end: no other token ends between two neighbouring
        ends, so one token of either side covers the bytes between them.
        """
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        of_a, of_b = np.repeat(np.arange(len(a)), n_a), np.repeat(np.arange(len(b)), n_b)
        both_a = end_b[np.searchsorted(end_b, end_a)] == end_a
        both_b = end_a[np.searchsorted(end_a, end_b)] == end_b
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        links = ids_a[at_a] << _SHIFT | ids_b[at_b]
        n_groups = np.bincount(of_a[both_a], minlength=len(a))
        side = np.concatenate((2 * (np.cumsum(both_a) - both_a), 2 * (np.cumsum(both_b) - both_b) + 1))
        order = np.argsort(side, kind="stable")
        side, of = side[order], np.concatenate((of_a, of_b))[order]
        step = np.where(side[1:] == side[:-1], 0, np.where(side[1:] >> 1 == side[:-1] >> 1, 1, np.where(of[1:] == of[:-1], 2, 3)))
        shown = np.concatenate((ids_a, ids_b))[order] * len(_SEPARATORS) + np.concatenate((step, [3]))
        texts = "".join(map(self.shown.__getitem__, shown.tolist())).split(_SEPARATORS[3])[:-1]
        facts = np.column_stack((n_a, n_b, n_groups, np.bincount(of_a[at_a], minlength=len(a))))
        return texts, facts, links

    def one(self, a: list[int], b: list[int]) -> Closed:
        """Groups of tokens that start at one byte and end at one byte."""
        (text,), facts, links = self.groups([a], [b])
        return Closed(*facts[0, :3].tolist(), text, links)

    def learn(self, parts: list[str]) -> None:
        """Puts the groups of parts into the store."""
        a, b = [self.a.encode_ordinary(p) for p in parts], self.encode_b(parts)
        same = np.array([b"".join(map(self.b_bytes.__getitem__, y)) == p.encode() for p, y in zip(parts, b)])
        good = np.flatnonzero(same).tolist()
        if not good:
            self.store.add(parts, [""] * len(parts), np.zeros((len(parts), 5), dtype=np.int64), NOTHING.links)
            return
        texts, facts, links = self.groups([a[i] for i in good], [b[i] for i in good])
        all_facts = np.zeros((len(parts), 5), dtype=np.int64)
        all_facts[good] = np.column_stack((facts, np.ones(len(good), dtype=np.int64)))
        all_texts = [""] * len(parts)
        for i, t in zip(good, texts):
            all_texts[i] = t
        self.store.add(parts, all_texts, all_facts, links)

    def closed(self, texts: list[str]) -> list[Closed]:
        """Groups of texts that begin and end where both tokenizers may be cut."""
        if self.store.full():
            self.store = Store()
        store = self.store
        parts = [self.parts(t) for t in texts]
        new = list({p for found in parts for p in found if p not in store.number})
        if new:
            self.learn(new)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(store.number.__getitem__, chain.from_iterable(parts)), np.int64)
        facts = store.facts[at]
        edges = np.concatenate(([0], np.cumsum(sizes)))
        sums = np.concatenate((np.zeros((1, 5), dtype=np.int64), np.cumsum(facts[:, :5], axis=0)))
        total = (sums[edges[1:]] - sums[edges[:-1]]).tolist()
        n_links = facts[:, 3]
        links = store.links[np.repeat(facts[:, 5] - (sums[1:, 3] - n_links), n_links) + np.arange(sums[-1, 3])]
        begins, out, at = sums[edges, 3].tolist(), [], at.tolist()
        for k, (n_a, n_b, n, _, valid) in enumerate(total):
            if valid < edges[k + 1] - edges[k]:
                out.append(BROKEN)
            else:
                shown = ";".join(map(store.texts.__getitem__, at[edges[k] : edges[k + 1]]))
                out.append(Closed(n_a, n_b, n, shown, links[begins[k] : begins[k + 1]]))
        return out

    def fragment(self, a: list[int], b: list[int], starts: tuple[int, int], emit: Callable[[int, Closed], None]) -> Fragment:
        """The fragment of tokens from the given bytes on; closed groups are emitted with their first byte."""
        at_a, at_b = (
            start + np.concatenate(([0], np.cumsum(size[np.array(ids, dtype=np.int64)])))
            for start, size, ids in ((starts[0], self.a_size, a), (starts[1], self.b_size, b)))
        ends = int(at_a[-1]), int(at_b[-1])
        both = np.intersect1d(at_a, at_b, assume_unique=True)
        if not len(both):
            return Fragment(starts, ends, None, None, (a, b), ([], []))
        (i, k), (j, m) = np.searchsorted(at_a, both[[0, -1]]).tolist(), np.searchsorted(at_b, both[[0, -1]]).tolist()
        if k > i:
            emit(int(both[0]), self.one(a[i:k], b[j:m]))
        return Fragment(starts, ends, int(both[0]), int(both[-1]), (a[:i], b[:j]), (a[k:], b[m:]))

    def compose(self, left: Fragment, right: Fragment, emit: Callable[[int, Closed], None]) -> Fragment:
        """The fragment of two neighbouring ranges; associative."""
        if not (left.valid and right.valid):
            return Fragment(left.starts, right.ends, None, None, ([], []), ([], []), False)
        if left.ends != right.starts:
            raise ValueError(f"ranges do not meet: {left.ends} and {right.starts}")
        open_a, open_b = (left.tail if left.last is not None else left.head)
        starts = (left.last, left.last) if left.last is not None else left.starts
        seam = self.fragment([*open_a, *right.head[0]], [*open_b, *right.head[1]], starts, emit)
        first, head = (left.first, left.head) if left.first is not None else (seam.first, seam.head)
        last, tail = (right.last, right.tail) if right.last is not None else (seam.last, seam.tail)
        return Fragment(left.starts, right.ends, first, last, head, tail)

    def range(self, part: str, starts: tuple[int, int], a: tuple[int, int], b: tuple[int, int], emit: Callable[[int, Closed], None]) -> Fragment:
        """The fragment of part[a] for one side, which starts at byte starts[0], and of part[b] for the other."""
        ends = starts[0] + len(part[slice(*a)].encode()), starts[1] + len(part[slice(*b)].encode())
        low, high = max(a[0], b[0]), min(a[1], b[1])
        # Both sides may be cut where two parts of the overlap meet; its own ends are cuts of one side only.
        ends_of = np.cumsum([low, *map(len, self.parts(part[low:high]))]).tolist() if low < high else []
        if len(ends_of) < 4:
            return self._edge(part, a, b, starts, ends, emit)
        cuts = ends_of[1], ends_of[-2]
        first, last = (starts[0] + len(part[a[0] : c].encode()) for c in cuts)
        middle = self.closed([part[slice(*cuts)]])[0]
        if not middle.valid:
            return Fragment(starts, ends, None, None, ([], []), ([], []), False)
        emit(first, middle)
        left = self._edge(part, (a[0], cuts[0]), (b[0], cuts[0]), starts, (first, first), emit)
        right = self._edge(part, (cuts[1], a[1]), (cuts[1], b[1]), (last, last), ends, emit)
        whole = Fragment((first, first), (last, last), first, last, ([], []), ([], []))
        return self.compose(self.compose(left, whole, emit), right, emit)

    def _edge(self, part, a, b, starts, ends, emit) -> Fragment:
        ids_a = self.a.encode_ordinary(part[slice(*a)])
        ids_b = self.encode_b([part[slice(*b)]])[0] if b[0] < b[1] else []
        if b"".join(map(self.b_bytes.__getitem__, ids_b)) != part[slice(*b)].encode():
            return Fragment(starts, ends, None, None, ([], []), ([], []), False)
        return self.fragment(ids_a, ids_b, starts, emit)


_KEPT: dict[str, Aligner] = {}


def _aligner(shared: Vocabularies) -> Aligner:
    if shared.digest not in _KEPT:
        _KEPT.clear()
        _KEPT[shared.digest] = Aligner(shared)
    return _KEPT[shared.digest]


def byte_ranges(text: str, span: int, together: set[str]) -> Iterator[tuple[str, tuple[int, int], tuple[int, int], tuple[int, int]]]:
    """Characters, both sides' first bytes and both sides' places in the characters, of each range of a text."""
    n, size_a, size_b = len(text), 0, 0
    a = b = 0
    for at in range(span, n + span, span):
        next_a, next_b = max(a, min(at, n)), max(b, min(at, n))
        if a < next_a < n:
            found = _CUT.search(text, next_a)
            next_a = found.start() if found else n
        while b < next_b < n and text[next_b - 1 : next_b + 1] in together:
            next_b += 1
        sides = [x for x in ((a, next_a), (b, next_b)) if x[0] < x[1]]
        low, high = min((x[0] for x in sides), default=0), max((x[1] for x in sides), default=0)
        yield (text[low:high], (size_a, size_b),
               (a - low, next_a - low) if a < next_a else (0, 0), (b - low, next_b - low) if b < next_b else (0, 0))
        size_a, size_b = size_a + len(text[a:next_a].encode()), size_b + len(text[b:next_b].encode())
        a, b = next_a, next_b


_RANGE = "_row long, k long, part string, at_a long, at_b long, i long, j long, m long, n long"
_CLOSED = "at long, text string, n_a long, n_b long, n_groups long, links array<long>"
_ENDS = "head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"
_FRAGMENT = f"_row long, k long, a0 long, b0 long, a1 long, b1 long, first long, last long, {_ENDS}, valid boolean, closed array<struct<{_CLOSED}>>"


def _record(row: int, k: int, f: Fragment, closed: list) -> tuple:
    return (row, k, *f.starts, *f.ends, f.first, f.last, *f.head, *f.tail, f.valid, closed)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _FRAGMENT.split(", closed")[0].split(", ")] + ["closed"])
    return out.astype({"first": "Int64", "last": "Int64"})


def _emitter(closed: list) -> Callable[[int, Closed], None]:
    return lambda at, c: closed.append((at, c.text, c.n_a, c.n_b, c.n_groups, c.links)) if c.n_groups else None


def _read(r) -> Fragment:
    known = lambda x: None if pd.isna(x) else int(x)
    ids = [list(map(int, x)) for x in (r.head_a, r.head_b, r.tail_a, r.tail_b)]
    return Fragment((r.a0, r.b0), (r.a1, r.b1), known(r.first), known(r.last), (ids[0], ids[1]), (ids[2], ids[3]), bool(r.valid))


def _long_texts(docs: DataFrame, shared, span: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """For texts longer than a range: key and validity by row, and closed groups by row and first byte."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["_row"], batch["_text"]):
                for k, (part, starts, a, b) in enumerate(byte_ranges(" " + text, span, shared.value.together)):
                    yield pd.DataFrame([(row, k, part, *starts, *a, *b)], columns=_RANGE.replace(" long", "").replace(" string", "").split(", "))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(shared.value)
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                closed: list = []
                rows.append(_record(r._1, r.k, aligner.range(r.part, (r.at_a, r.at_b), (r.i, r.j), (r.m, r.n), _emitter(closed)), closed))
            yield _frame(rows)

    def composed(batch: pd.DataFrame) -> pd.DataFrame:
        aligner, closed = _aligner(shared.value), []
        rows = list(batch.sort_values("k").itertuples())
        whole = _read(rows[0])
        for r in rows[1:]:
            whole = aligner.compose(whole, _read(r), _emitter(closed))
        return _frame([_record(rows[0]._1, rows[0].k // fan, whole, closed)])

    keyed = settle(docs.withColumn("_row", F.monotonically_increasing_id()))
    ranges = settle(keyed.select("_row", "_text").mapInPandas(cut, _RANGE))
    now = settle(ranges.repartition("_row", "k").mapInPandas(made, _FRAGMENT))
    levels = [now]
    most = now.agg(F.max("k")).first()[0] or 0
    while most:
        now = settle(now.drop("closed").withColumn("closed", F.expr(f"CAST(NULL AS array<struct<{_CLOSED}>>)"))
                     .groupBy("_row", F.expr(f"k div {fan}")).applyInPandas(composed, _FRAGMENT))
        levels.append(now)
        most //= fan
    pieces = levels[0].select("_row", F.inline("closed"))
    for level in levels[1:]:
        pieces = pieces.unionByName(level.select("_row", F.inline("closed")))
    roots = keyed.select("_row", "_key").join(now.select("_row", "valid"), "_row")
    return roots, settle(pieces.join(now.filter("valid").select("_row"), "_row", "left_semi"))


def _in_order(pieces: DataFrame) -> DataFrame:
    """Counts and digest of each long text's groups, its pieces read in order, one at a time."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, sha, n = None, None, [0, 0, 0, 0]
        columns = ["_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        for batch in batches:
            done = []
            for r in batch.itertuples():
                if r._1 != row:
                    if sha:
                        done.append((row, *n, sha.hexdigest()))
                    row, sha, n = r._1, hashlib.sha256(), [0, 0, 0, 0]
                sha.update((";" * (n[2] > 0) + r.text).encode())
                n = [x + int(y) for x, y in zip(n, (r.n_a, r.n_b, r.n_groups, r.n_links))]
            yield pd.DataFrame(done, columns=columns)
        if sha:
            yield pd.DataFrame([(row, *n, sha.hexdigest())], columns=columns)

    rows = pieces.select("_row", "at", "text", "n_a", "n_b", "n_groups", F.size("links").alias("n_links"))
    return rows.repartition("_row").sortWithinPartitions("_row", "at").mapInPandas(
        digest, "_row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")


def _slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The rows of all batches, some at a time."""
    for batch in batches:
        for at in range(0, len(batch), _SOME):
            yield batch.iloc[at : at + _SOME]


_DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


def _short_texts(docs: DataFrame, shared) -> DataFrame:
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(shared.value)
        for some in _slices(batches):
            rows = []
            for c in aligner.closed([" " + t if t else "" for t in some]):
                sha = hashlib.sha256(c.text.encode()).hexdigest() if c.n_groups else ""
                rows.append((c.n_a, c.n_b, c.n_groups, len(c.links), sha, c.links))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DIGEST.split(", ")])

    return docs.select("_key", F.pandas_udf(digests, _DIGEST)("_text").alias("d")).select("_key", "d.*")


def link_counts(links: DataFrame) -> DataFrame:
    """How many links hold each pair of ids: a, b, times; `links` has one array column of that name."""
    mask = (1 << _SHIFT) - 1
    each = links.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("times"))
    return each.select("link", F.shiftright("link", _SHIFT).alias("a"), F.col("link").bitwiseAND(F.lit(mask)).alias("b"), "times")


def _scored(units: DataFrame, counts: DataFrame, head_links: int) -> DataFrame:
    """`units` with n_best and count_sum instead of links.

    The most frequent pairs' counts are broadcast, of bounded number; links of all
    other pairs are joined with theirs.
    """
    best = settle(counts.groupBy("b").agg(F.max("times").alias("most")))
    top = counts.orderBy(F.desc("times"), "link").limit(head_links).select("link", "times").toPandas().sort_values("link")
    most = best.toPandas()
    highest = np.zeros(int(most["b"].max()) + 1 if len(most) else 1, dtype=np.int64)
    highest[most["b"].to_numpy(dtype=np.int64)] = most["most"]
    shared = units.sparkSession.sparkContext.broadcast((top["link"].to_numpy(dtype=np.int64), top["times"].to_numpy(dtype=np.int64), highest))

    def looked_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        _KEPT.clear()  # the worker's tokenizers are not needed any more
        known, times, highest = shared.value
        for links in _slices(batches):
            sizes = links.map(len).to_numpy(dtype=np.int64)
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *links])
            owner = np.repeat(np.arange(len(links)), sizes)
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), dtype=bool)
            count = np.where(hit, times[at] if len(known) else 0, 0)
            is_best = hit & (count == highest[flat & ((1 << _SHIFT) - 1)])
            sums = np.concatenate(([0], np.cumsum(count)))
            ends = np.cumsum(sizes)
            rest = np.split(flat[~hit], np.cumsum(np.bincount(owner[~hit], minlength=len(links)))[:-1]) if not hit.all() else [flat[:0]] * len(links)
            yield pd.DataFrame({"n_best": np.bincount(owner[is_best], minlength=len(links)), "count_sum": sums[ends] - sums[ends - sizes], "rest": rest})

    kept = [c for c in units.columns if c != "links"]
    udf = F.pandas_udf(looked_up, "n_best long, count_sum long, rest array<long>")
    scored = settle(units.select(*kept, F.monotonically_increasing_id().alias("_unit"), udf("links").alias("s")).select(*kept, "_unit", "s.*"))
    if counts.count() > head_links:
        rest = (
            scored.select("_unit", F.explode("rest").alias("link")).groupBy("_unit", "link").agg(F.count("*").alias("n"))
            .join(counts, "link").join(best, "b").groupBy("_unit").agg(
                F.sum(F.when(F.col("times") == F.col("most"), F.col("n"))).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more")))
        scored = scored.join(rest, "_unit", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return scored.select(*kept, "n_best", "count_sum")


def align_tokens(
    docs: DataFrame, bytes_path: str, pieces_path: str, *, key: str = "doc_id", text: str = "text", span: int = SPAN, fan: int = FAN,
    head_links: int = HEAD_LINKS,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, or one that the pieces do not give back byte by byte, has
    no tokens: zeros and an empty digest. Repeated rows and null keys give a row each
    and count each; ties for a piece's most frequent partner all count as best. Other
    columns are not looked at. Without rows there are none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabularies(bytes_path, pieces_path))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    is_long = F.coalesce(F.length("_text") >= span, F.lit(False))
    with _small_batches(docs):
        short = settle(_short_texts(texts.filter(~is_long), shared))
        roots, pieces = _long_texts(texts.filter(is_long), shared, span, fan)
        counts = settle(link_counts(short.select("links").unionByName(pieces.select("links"))))
        of_pieces, of_short = (_scored(units, counts, head_links) for units in (pieces.select("_row", "links"), short))
    best = of_pieces.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    long = roots.join(_in_order(pieces), "_row", "left").join(best, "_row", "left").select(
        "_key", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    both = of_short.select("_key", *numbers, "groups_sha256").unionByName(long)
    return both.withColumnRenamed("_key", "doc_id")


def token_groups(docs: DataFrame, bytes_path: str, pieces_path: str, *, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """The groups themselves: doc_id, `at` (first byte, the space before the text included) and `groups`, as text like `a1,a2|b1;a3|b2`.

    Texts longer than a range have several rows. Texts without tokens have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabularies(bytes_path, pieces_path))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > 0)

    @F.pandas_udf("string")
    def groups(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        aligner = _aligner(shared.value)
        for some in _slices(batches):
            yield pd.Series([c.text or None for c in aligner.closed([" " + t for t in some])])

    is_long = F.length("_text") >= span
    roots, pieces = _long_texts(texts.filter(is_long), shared, span, FAN)
    short = texts.filter(~is_long).select("_key", F.lit(0).cast("long").alias("at"), groups("_text").alias("groups")).filter("groups IS NOT NULL")
    long = pieces.join(roots, "_row").select("_key", "at", F.col("text").alias("groups"))
    return short.unionByName(long).withColumnRenamed("_key", "doc_id")
