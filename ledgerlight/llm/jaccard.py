"""Jaccard join of documents' shingle sets; exact for short sets, with a stated bound on misses for long ones.

1. A set's shingles are hashed into groups; the group counts make the set a point.
   Sets within the threshold differ in few shingles, so of many blocks of groups
   at least one has equal counts in both. Blocks are the index's top level: their
   count vectors (as hashes) are keys, and sets with an equal key meet.
2. Sets that meet are held against each other by sizes and counts. Those that may be
   linked by them, directly or over others, form a candidate class. Within a class
   an R-tree over coarser count vectors bounds the overlap with a node's sets by
   the summed minima of coordinates; surviving pairs are verified on whole sets.
   Only pairs that are not linked already are verified, since links over others
   decide the component.

Equal sets count once; all steps move hashes and counts, and whole texts are read
again only for sets that met another one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import settle
from .components import connected
from .hashing import ODD, SPACE, mix, word_hashes

#: Blocks that a set is looked up by: as many at least, and so many that a linked pair is missed with a probability below
#: MISS, as the hash draws the blocks. Sets that have no more blocks are found for certain.
BLOCKS, MISS = 48, 1e-8
#: Sets of a candidate class that one task compares with one another.
PART_SETS = 256
PART_SHINGLES = 2_000_000
PIVOTS = 32
#: Sets of one key that are compared with one another at once.
MEET_SETS = 4096
GROUPS = 64
#: Most groups that a point has on the way to the classes; one has a group for four to eight shingles, GROUPS at least.
MOST_GROUPS = 4096
FANOUT = 16
#: Stands for a set none of whose documents has an id; ids are smaller.
NO_ID = 1 << 62
_BUCKET = ["key", "a", "b"]
#: Stands for this count and any larger one.
_FULL = (1 << 16) - 1


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `words` words; of all words as one if there are fewer."""
    word = word_hashes(text, SPACE)
    n = len(word)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    width = min(words, n)
    turn = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        part = word[k : n - width + 1 + k]
        turn = turn * ODD + part
    return np.unique(mix(turn))


def _band(n: np.ndarray | int) -> int:
    return max(int(n) - 1, 0).bit_length()


def _tau(size: int, num: int, den: int) -> int:
    """Most shingles that two linked sets of `size` shingles in all can have apart from one another."""
    return size * (den - num) // (den + num)


@cache
def looked_up(num: int, den: int) -> tuple[int, int]:
    """How many blocks a long set is looked up by, and the least shingles that a block counts with.

    Two sets at the threshold share num / (den - num) shingles for each one that is in
    one of them only. With x of those per block, x from 1/2 to 1 over a size band, a
    block is alike with probability exp(-x), and holds a number of common shingles
    that is Poisson with mean x num / (den - num).
    """
    if not 0 < num <= den:
        raise ValueError(f"a threshold between 0 and 1 is needed, not {num}/{den}")
    if num == den:
        return BLOCKS, 2
    shared = num / (den - num)
    least = 2 if 3 * num >= 2 * den else 1
    alike = min(math.exp(-x) * (1 - math.exp(-x * shared) * (1 + (x * shared if least == 2 else 0))) for x in (0.5, 0.625, 0.75, 0.875, 1.0))
    return max(BLOCKS, math.ceil(math.log(MISS) / math.log1p(-alike))), least


def block_keys(s: np.ndarray, num: int, den: int) -> list[int]:
    """Keys of a set in its size band and in the next if a linked set can lie there.

    Bands end at powers of two. A band has so many blocks that linked sets are alike
    in one at least. Blocks with few shingles are left out as long as enough others
    remain to be sure of that.
    """
    n = len(s)
    own = _band(n)
    bands = [own] if n * den <= (1 << own) * num else [own, own + 1]
    keys: list[int] = []
    mixed = mix(s ^ ODD)
    most, long_least = looked_up(num, den)
    for band in bands:
        top = 1 << band
        apart = _tau(2 * top, num, den)
        blocks = apart + 1
        used = min(blocks, most)
        edges = (np.arange(1, used + 1, dtype=object) * (1 << 64) // blocks)
        cut = np.searchsorted(s, np.array([min(int(e), (1 << 64) - 1) for e in edges], dtype=np.uint64), side="left")
        if used == blocks:
            cut[-1] = n
        begin = np.concatenate(([0], cut[:-1]))
        count = cut - begin
        if used == blocks:
            enough = _tau(n + min(top, n * den // num), num, den) + 1
            least = next(c for c in (3, 2, 1, 0) if (count >= c).sum() >= enough or c == 0)
        else:
            least = long_least
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        vector = sums[cut] - sums[begin]
        place = np.uint64(band << 32) + np.arange(used, dtype=np.uint64)
        keys += mix(vector + mix(place * ODD + count.astype(np.uint64)))[count >= least].astype(np.int64).tolist()
    return keys


def _point(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by group; the more groups, the larger the set."""
    groups = min(max(GROUPS, 1 << max(_band(len(s)) - 3, 0)), MOST_GROUPS)
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, _FULL).astype(np.uint16).tobytes()


def _points(parts: list[bytes]) -> np.ndarray:
    """The points as rows, folded to the groups of the one that has least."""
    groups = min(map(len, parts)) // 2
    counts = np.array([np.minimum(np.frombuffer(p, dtype=np.uint16).reshape(-1, groups).sum(axis=0), _FULL) for p in parts])
    return np.where(counts == _FULL, 1 << 40, counts).astype(np.int64) if counts.max() == _FULL else counts.astype(np.uint16)


def _set_hash(s: np.ndarray) -> list[int]:
    """128 bits for a set, as two longs."""
    return mix(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s)) if len(s) else 0], dtype=np.uint64)).astype(np.int64).tolist()


def _unnamed(h1: int) -> int:
    return NO_ID + abs(h1) % NO_ID


def _some(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The rows of all batches, so many at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def _signatures(words: int, num: int, den: int):
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _some(batches):
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set(text, words)
                h1, h2 = _set_hash(s)
                rows.append((key, len(s), h1, h2, _unnamed(h1), block_keys(s, num, den) if len(s) else [], _point(s)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "h1", "h2", "unnamed", "keys", "point"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return signed


def _name(words: int):
    """Node numbers for texts without a key."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = [_unnamed(_set_hash(shingle_set(t, words))[0]) for t in batch["text"]]
            yield pd.DataFrame({"read": pd.Series(nodes, dtype="int64"), "text": batch["text"].to_numpy()})

    return named


def _sets(words: int):
    """The wanted sets; of the texts of one key only those whose set it is."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _some(batches):
            sets = [shingle_set(t, words) for t in batch["text"]]
            same = [_set_hash(s) == [a, b] for s, a, b in zip(sets, batch["h1"], batch["h2"])]
            out = batch.drop(columns=["text", "h1", "h2"])
            out["shingles"] = [s.tobytes() for s in sets]
            yield out[np.array(same, dtype=bool)]

    return read


class Tree:
    """R-tree of count vectors, packed by size: nodes of FANOUT sets with the largest count per coordinate."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.points = sizes, points
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, small, large = self.levels[-1]
            starts = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(small, starts), np.maximum.reduceat(large, starts)))

    def near(self, size: int, point: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets whose summed coordinate minima allow a link, and those sums."""
        here = np.arange(len(self.levels[-1][0]))
        bound = np.zeros(0, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, small, large = (x[here] for x in self.levels[depth])
            bound = np.minimum(top, point).sum(axis=1)
            may = (bound * (num + den) >= num * (size + small)) & (large * den >= size * num) & (size * den >= small * num)
            here, bound = here[may], bound[may]
            if depth:
                below = len(self.levels[depth - 1][0])
                here = (here[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                here = here[here < below]
        return self.order[here], bound


def _stars(bucket: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """Links of the sets that sizes and counts join, directly or over others, with the smallest of them."""
    nodes, sizes, points = bucket["node"].to_numpy(), bucket["n_shingles"].to_numpy(), _points(bucket["point"].tolist())
    links, rest = [], np.arange(len(nodes))
    while len(rest) > 1:
        joined, rest = [rest[0]], rest[1:]
        for i in joined:
            fits = (sizes[rest] * den >= sizes[i] * num) & (sizes[i] * den >= sizes[rest] * num)
            near = rest[fits]
            bound = np.minimum(points[near], points[i]).sum(axis=1, dtype=np.int64)
            fits[fits] = bound * (num + den) >= num * (sizes[near] + sizes[i])
            joined += rest[fits].tolist()
            rest = rest[~fits]
        first = nodes[joined].min()
        links += [(u, first) for u in nodes[joined].tolist() if u != first]
    return links


def _may_link(num: int, den: int):
    """The stars of each bucket; the rows of a bucket follow one another."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            names = held[_BUCKET].to_numpy()
            starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist()]
            found = [x for a, b in zip(starts, starts[1:]) for x in _stars(held.iloc[a:b], num, den)]
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")
            held = held.iloc[starts[-1] :]
        if held is not None:
            yield pd.DataFrame(_stars(held, num, den), columns=["u", "v"], dtype="int64")

    return links


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _verify(num: int, den: int):
    """The links that hold among the sets of a part, as stars: each label with the smallest it is joined to. Sets of a
    `label` are linked already; only sets that `asks` marks look for links to others."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(dtype=bool)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
        labels = group["label"].tolist()
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        points = np.array([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets], dtype=np.int64)
        tree = Tree(sizes, points)
        first: dict[int, int] = {}
        parent = [first.setdefault(label, i) for i, label in enumerate(labels)]
        for i in np.flatnonzero(asks):
            other, bound = tree.near(int(sizes[i]), points[i], num, den)
            for j in other[np.argsort(-bound, kind="stable")]:
                a, b = _find(parent, i), _find(parent, j)
                if a != b and _linked(sets[i], sets[j], num, den):
                    parent[max(a, b)] = min(a, b)
        least: dict[int, int] = {}
        for label, i in first.items():
            least[_find(parent, i)] = min(label, least.get(_find(parent, i), label))
        out = [(label, least[_find(parent, i)]) for label, i in first.items()]
        return pd.DataFrame([x for x in out if x[0] != x[1]], columns=["u", "v"], dtype="int64")

    return links


def jaccard_components(
    docs: DataFrame, *, words: int = 4, threshold: tuple[int, int] = (85, 100), key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents are linked if den * common >= num * union for their sets of
    shingles of `words` words (A-Z lower-cased; fewer words: all of them as one
    shingle). component_id is the smallest doc_id reachable over links, also through
    documents with equal sets. A null text, or one without words, has an empty set,
    is linked with nothing and is its own component. Rows with a null key take part
    in links; their component_id is null if no linked document has a key. Rows of
    one key count as one document. Other columns are not looked at.
    """
    num, den = threshold
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = settle(rows.mapInPandas(_signatures(words, num, den), "doc_id long, n_shingles long, h1 long, h2 long, unnamed long, keys array<long>, point binary"))
    full = signed.filter("n_shingles > 0")
    nodes = _nodes(full)
    placed = full.join(nodes, ["h1", "h2", "n_shingles"])

    met = _meetings(placed, num, den)
    classes = connected(met)
    roots = settle(_roots_within(rows, placed, classes, words, num, den))
    same_key = _same_keys(placed)
    if not same_key.isEmpty():
        roots = settle(connected(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(same_key)))

    named = nodes.join(roots, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("root", "node").alias("root"))
    named = settle(named)
    found = signed.join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("root") < NO_ID, F.col("root"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def _nodes(full: DataFrame) -> DataFrame:
    """node and rep of each set: rep is the smallest key of its documents, node too, but for sets that share it with another one."""
    sets = settle(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("unnamed").alias("unnamed")))
    shared = settle(sets.filter("rep IS NOT NULL").groupBy("rep").agg(
        F.count("*").alias("sets"), F.min(F.struct("h1", "h2")).alias("first")).filter("sets > 1").select("rep", "first"))
    own = F.col("rep").isNotNull() & (F.col("first").isNull() | (F.col("first") == F.struct("h1", "h2")))
    return settle(sets.join(shared, "rep", "left").select(
        "h1", "h2", "n_shingles", "rep", F.when(own, F.col("rep")).otherwise(F.col("unnamed")).alias("node")))


def _same_keys(placed: DataFrame) -> DataFrame:
    """Links between the sets of documents with one key."""
    keyed = placed.filter("doc_id IS NOT NULL").select("doc_id", "node")
    several = settle(keyed.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter("v < last").select("doc_id", "v"))
    return settle(keyed.join(several, "doc_id").filter("node != v").select(F.col("node").alias("u"), "v").distinct())


def _meetings(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Links of sets that have a key in common and may be linked by sizes and counts, as stars, unverified.

    Sets with a passage in common have keys in common too. Links by keys alone would
    chain them to classes that grow faster than the table.
    """
    own = placed.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("rep")))
    keys = own.select("node", F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter("v < last").select("key")
    shared = settle(keys.join(several, "key").select("key", "node").distinct())
    members = [F.count("*").alias("sets"), F.min("node").alias("v"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("all")]
    # keys of the same sets count once
    once = settle(shared.groupBy("key").agg(*members).groupBy("sets", "v", "last", "all").agg(F.min("key").alias("key")).select("key", "sets"))
    asked = settle(shared.join(once, "key").select("key", "sets", "node"))
    points = settle(own.select("node", "n_shingles", "point").join(asked.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))

    parts = F.ceil(F.col("sets") / MEET_SETS).cast("int")
    placed_in = asked.select("key", "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    # each two parts of a key's sets meet
    pairs = placed_in.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).filter("parts = 1 OR part != other")
    dealt = pairs.select("node", "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")).join(points, "node")
    return dealt.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET).mapInPandas(_may_link(num, den), "u long, v long")


def _roots_within(rows: DataFrame, placed: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """node and root: the components of each class by verified links.

    Classes are dealt out in parts, each with the class's pivots. Sets that a part's
    links do not join to their class's largest component then ask all parts.
    """
    classes = settle(classes)
    member = classes.unionByName(classes.select(F.col("root").alias("node"), "root").distinct())
    one = placed.groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("rep").alias("rep"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    sized = settle(member.join(one, "node"))
    plan = sized.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("volume"))
    parts = F.greatest(F.ceil(F.col("sets") / PART_SETS), F.ceil(F.col("volume") / PART_SHINGLES))
    plan = settle(plan.select("root", parts.cast("int").alias("parts"), "sets"))
    of_class = sized.join(plan, "root")
    key = F.xxhash64("node")
    pivot = (F.col("parts") > 1) & (F.pmod(F.shiftright(key, 20), F.ceil(F.col("sets") / PIVOTS).cast("long")) == 0)
    own = F.pmod(key, F.col("parts").cast("long")).cast("int")

    wanted = of_class.select("node", F.coalesce("rep", "node").alias("read"), "h1", "h2", "root", "parts", own.alias("part"), pivot.alias("pivot"))
    read = rows.filter(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "read").unionByName(
        rows.filter(F.col("doc_id").isNull()).select("text").mapInPandas(_name(words), "read long, text string"))
    shape = "node long, root long, parts int, part int, pivot boolean, shingles binary"
    texts = read.join(wanted, "read").select("node", "h1", "h2", "root", "parts", "part", "pivot", "text")
    sets = settle(texts.mapInPandas(_sets(words), shape).dropDuplicates(["node"]))

    where = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    dealt = sets.select("node", "root", "shingles", F.explode(where).alias("part"), F.col("node").alias("label"), F.lit(True).alias("asks"))
    verify = _verify(num, den)
    first = settle(dealt.groupBy("root", "part").applyInPandas(verify, "u long, v long"))

    roots = settle(connected(first))
    split = sets.filter("parts > 1")
    if split.isEmpty():
        return roots
    split = split.join(roots.select("node", F.col("root").alias("label")), "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    split = settle(split)
    held = split.groupBy("root", "label").agg(F.count("*").alias("sets"))
    most = settle(held.groupBy("root").agg(F.max(F.struct("sets", F.col("label").alias("main"))).alias("m"), F.sum("sets").alias("all")))
    most = most.select("root", F.col("m.main").alias("main"), F.ceil((F.col("all") - F.col("m.sets")) / PART_SETS).cast("int").alias("blocks"))
    known = split.join(most.filter("blocks > 0"), "root")
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    columns = ["node", "root", "shingles", "label"]
    asking = known.filter(F.col("label") != F.col("main")).select(
        *columns, block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"))
    asked = known.select(*columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", F.lit(False).alias("asks"))
    second = asking.unionByName(asked).groupBy("root", "part", "block").applyInPandas(verify, "u long, v long")
    return connected(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(second))
