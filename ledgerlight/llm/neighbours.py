"""Approximate nearest neighbours by inner product: NN-descent and greedy search of its graph.

Index. Every distinct vector is a node; rows with equal vectors share it. First,
nodes are dealt into blocks by random hyperplanes, several times over, and take
their nearest of each block as neighbours. Then a round of NN-descent joins every
node's neighbours, and those whose neighbour it is, with one another: neighbours
of neighbours become neighbours where they are nearer. Only pairs of which one
came with the last round are looked at; rounds end when few lists change.

Search. A query starts from its own node's list, as queries are rows of the
table, and keeps the nearest nodes seen as its beam. Each round joins the
nearest nodes of all beams that were not opened yet with their neighbours, until
nearly all are open. Queries with equal vectors are one search.

Graph and beams work on vectors rounded to 8 bits per component; the nodes of a
beam's top are then scored exactly on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running_totals, settle

#: Neighbours of a node, those of them that a round of NN-descent joins, how often blocks are dealt, and nodes of a block.
LIST, JOINED, DEALS, BLOCK = 40, 24, 12, 2048
#: Vectors that hyperplanes are drawn from. Share of lists' places that still change when rounds end, and rounds at most.
SAMPLE, STILL, ROUNDS = 4096, 0.02, 8
#: Nodes that a beam keeps, and those it opens in a round. Share of beams' places that still open when a search ends.
BEAM, OPENED, LEFT = 160, 160, 0.01
# Nodes joined at once: larger groups around one node are divided anew in each round.
_GROUP = 96

_GRAPH = "node long, code binary, scale float, ids array<long>, sims array<float>, seen array<boolean>"
_NEAR = "node long, ids array<long>, sims array<float>"


def _real(codes, scales) -> np.ndarray:
    """Vectors from their codes."""
    rows = np.frombuffer(b"".join(codes), dtype=np.int8).reshape(len(codes), -1).astype(np.float32)
    return rows * np.asarray(scales, dtype=np.float32)[:, None]


def _rounded(vectors: pd.Series) -> pd.DataFrame:
    rows = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    scale = np.abs(rows).max(axis=1) / 127
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    return pd.DataFrame({"code": [c.tobytes() for c in codes], "scale": scale.astype(np.float32)})


def _tops(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, seen: np.ndarray, most: int):
    """Per owner its `most` nearest ids, nearest first, each once; of equal ones those seen before. Owners in order, their ends, and the rows."""
    order = np.lexsort((~seen, ids, owner))
    owner, ids, sims, seen = owner[order], ids[order], sims[order], seen[order]
    once = np.ones(len(owner), dtype=bool)
    once[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, sims, seen = owner[once], ids[once], sims[once], seen[once]
    order = np.lexsort((ids, -sims, owner))
    owner, ids, sims, seen = owner[order], ids[order], sims[order], seen[order]
    owners, begins, counts = np.unique(owner, return_index=True, return_counts=True)
    kept = np.arange(len(owner)) - np.repeat(begins, counts) < most
    return owners, np.cumsum(np.minimum(counts, most)), ids[kept], sims[kept], seen[kept]


def _lists(owner, ids, sims, most: int) -> pd.DataFrame:
    owners, ends, ids, sims, _ = _tops(owner, ids, sims, np.zeros(len(ids), dtype=bool), most)
    return pd.DataFrame({"node": owners, "ids": np.split(ids, ends[:-1]), "sims": np.split(sims, ends[:-1])}) if len(owners) else \
        pd.DataFrame({"node": [], "ids": [], "sims": []})


def _merged(state: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """`state` (columns of a graph) with the nearer ones of what was found; `seen` is false for ids that are new."""
    rows = state.unionByName(found.select("node", "ids", "sims", F.transform("ids", lambda _: F.lit(False)).alias("seen")), allowMissingColumns=True)
    lists = rows.groupBy("node").agg(
        F.first("code", ignorenulls=True).alias("code"), F.first("scale", ignorenulls=True).alias("scale"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "sims", "seen")])

    def topped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.iloc[at : at + 1000]
                sizes = some["ids"].map(len).to_numpy(dtype=np.int64)
                ids, sims, seen = (np.concatenate([np.zeros(0, dtype=kind), *some[c]]).astype(kind) for c, kind in (("ids", np.int64), ("sims", np.float32), ("seen", bool)))
                owners, ends, ids, sims, seen = _tops(np.repeat(np.arange(len(some)), sizes), ids, sims, seen, most)
                full = np.zeros(len(some), dtype=np.int64)
                full[owners] = np.diff(np.concatenate(([0], ends)))
                cuts = np.cumsum(full)[:-1]
                yield pd.DataFrame({
                    "node": some["node"].to_numpy(), "code": some["code"].to_numpy(), "scale": some["scale"].to_numpy(),
                    "ids": np.split(ids, cuts), "sims": np.split(sims, cuts), "seen": np.split(seen, cuts)})

    return settle(lists.mapInPandas(topped, _GRAPH))


def _dealt(codes: DataFrame, n: int, sample: np.ndarray, deals: int, block: int, most: int) -> DataFrame:
    """Each node's nearest in each of its blocks."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / block)))
    rng = np.random.default_rng(13)
    deals = deals if bits else 0
    if deals:
        ends = rng.integers(0, len(sample), (2, deals * bits))
        planes = (sample[ends[0]] - sample[ends[1]]).T.astype(np.float32)
        cuts = np.median(sample @ planes, axis=0)

    @F.pandas_udf("array<long>")
    def cells(code: pd.Series, scale: pd.Series) -> pd.Series:
        above = (_real(code, scale) @ planes > cuts).reshape(len(code), deals, bits)
        return pd.Series(list(above @ (1 << np.arange(bits))))

    # the first deal is by hash alone, so that every node has neighbours whatever the vectors
    by_hash = F.array(F.pmod(F.xxhash64("node"), F.lit(1 << bits)))
    places = F.concat(by_hash, cells("code", "scale")) if deals else by_hash
    dealt = settle(codes.select("node", "code", "scale", F.posexplode(places).alias("deal", "cell")))
    large = settle(dealt.groupBy("deal", "cell").count().filter(F.col("count") > 2 * block).select(
        "deal", "cell", F.ceil(F.col("count") / block).alias("parts")))
    blocks = dealt.join(large, ["deal", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("node", "deal"), F.coalesce("parts", F.lit(1))))

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        real, nodes = _real(rows["code"], rows["scale"]), rows["node"].to_numpy()
        k = min(most, len(nodes) - 1)
        ids, sims = [], []
        for at in range(0, len(nodes), 256):
            near = real[at : at + 256] @ real.T
            near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
            top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(near), 0), dtype=np.int64)
            ids += list(nodes[top])
            sims += list(np.take_along_axis(near, top, 1))
        return pd.DataFrame({"node": nodes, "ids": ids, "sims": sims})

    return blocks.groupBy("deal", "cell", "part").applyInPandas(nearest, _NEAR)


def _joined(graph: DataFrame, round_: int, most: int, joined: int) -> DataFrame:
    """What each node's neighbours, and those whose neighbour it is, find among one another."""
    least = F.when(F.size("sims") >= most, F.element_at("sims", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    member = F.struct("node", "code", "scale", "least")
    graph = graph.withColumn("least", least)
    edges = graph.select(member.alias("a"), F.explode(F.slice(F.arrays_zip("ids", "seen"), 1, joined)).alias("e")).select("a", "e.ids", "e.seen")
    asked = settle(edges.groupBy("ids").count().filter(F.col("count") > 2 * _GROUP).select(
        F.col("ids").alias("node"), F.ceil(F.col("count") / _GROUP).alias("parts")))
    parts = graph.join(asked, "node", "left").select(F.col("node").alias("ids"), member.alias("b"), F.coalesce("parts", F.lit(1)).alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("a.node", F.lit(round_)), F.col("parts"))).otherwise(0)
    # an edge brings its end to the group around its start, and its start to the group around its end
    groups = edges.join(parts, "ids").select(F.inline(F.array(
        F.struct(F.col("a.node").alias("around"), F.lit(0).cast("long").alias("part"), F.col("b").alias("m"), "seen"),
        F.struct(F.col("ids").alias("around"), part.cast("long").alias("part"), F.col("a").alias("m"), "seen"),
    ))).groupBy("around", "part").agg(*[F.collect_list(c).alias(c.split(".")[-1]) for c in ("m.node", "m.code", "m.scale", "m.least", "seen")])

    def among(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, ids, sims = [], [], []
            for nodes, code, scale, least, seen in zip(batch["node"], batch["code"], batch["scale"], batch["least"], batch["seen"]):
                real = _real(code, scale)
                near = real @ real.T
                nodes, new = np.asarray(nodes), ~np.asarray(seen, dtype=bool)
                i, j = np.nonzero((near > np.asarray(least)[:, None]) & (new[:, None] | new) & (nodes[:, None] != nodes))
                owner.append(nodes[i])
                ids.append(nodes[j])
                sims.append(near[i, j])
            yield _lists(*map(np.concatenate, (owner, ids, sims)), most)

    return groups.mapInPandas(among, _NEAR)


def neighbour_graph(
    nodes: DataFrame, n: int, *, size: int = LIST, joined: int = JOINED, deals: int = DEALS, block: int = BLOCK, still: float = STILL, rounds: int = ROUNDS,
) -> DataFrame:
    """NN-descent over `nodes` (node, v): node, code, scale, and ids, sims of its nearest nodes, nearest first."""
    sample = np.array([r["v"] for r in nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").collect()], dtype=np.float64)
    codes = settle(nodes.select("node", F.pandas_udf(_rounded, "code binary, scale float")("v").alias("c")).select("node", "c.*"))
    none = codes.select("*", *[F.expr(f"CAST(array() AS array<{kind}>)").alias(c) for c, kind in (("ids", "long"), ("sims", "float"), ("seen", "boolean"))])
    graph = _merged(none, _dealt(codes, n, sample, deals, block, -(-size // 2) if n > block else size), size)
    for k in range(rounds if n > block else 0):
        known = graph.withColumn("seen", F.transform("seen", lambda _: F.lit(True)))
        graph = _merged(known, _joined(graph, k, size, joined), size)
        changed = graph.agg(F.sum(F.size(F.filter("seen", lambda x: ~x)))).first()[0]
        if changed <= still * size * n:
            break
    return graph


def _searched(graph: DataFrame, asked: DataFrame, beam: int, opened: int, left: float) -> DataFrame:
    """The beams of the asked nodes: node, ids, sims, nearest first."""
    at = graph.select("node", F.posexplode("ids").alias("pos", "id")).join(graph.select(F.col("node").alias("id"), "code", "scale"), "id")
    near = settle(at.groupBy("node").agg(*[F.collect_list(c).alias(f"near_{c}") for c in ("id", "code", "scale")]))
    now = settle(graph.join(asked, "node", "left_semi").withColumn("seen", F.transform("seen", lambda _: F.lit(False))))

    def looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, ids, sims = [], [], []
            for node, code, scale, near_id, near_code, near_scale in zip(*(batch[c] for c in ("query", "code", "scale", "near_id", "near_code", "near_scale"))):
                sims.append(_real(near_code, near_scale) @ _real([code], [scale])[0])
                ids.append(np.asarray(near_id))
                owner.append(np.full(len(near_id), node))
            owner, ids, sims = map(np.concatenate, (owner, ids, sims))
            other = owner != ids
            yield _lists(owner[other], ids[other], sims[other], beam)

    # the places of the nearest `opened` of the beam that were not opened yet
    closed = F.expr(f"slice(filter(transform(seen, (s, i) -> if(s, NULL, i)), i -> i IS NOT NULL), 1, {opened})")
    n = now.count()
    while (now.agg(F.sum(F.size(closed))).first()[0] or 0) > left * beam * n:
        work = now.withColumn("open", closed)
        steps = work.select(F.col("node").alias("query"), "code", "scale", F.explode(F.transform("open", lambda i: F.get("ids", i))).alias("node"))
        found = steps.join(near, "node").mapInPandas(looked, _NEAR)
        opened_now = work.withColumn(
            "seen", F.transform("seen", lambda s, i: s | F.array_contains("open", i))).drop("open")
        now = _merged(opened_now, found, beam)
    return now.select("node", "ids", "sims")


def nearest_neighbours(
    vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, beam: int = BEAM, opened: int = OPENED, left: float = LEFT, **graph,
) -> DataFrame:
    """The k nearest rows of each row for which `queries` holds: query_id, rank from 1, vec_id, score.

    Nearness is the inner product in double precision, ties go to the smaller key; a
    row is never its own neighbour. Null keys and vectors that are null, zero, hold a
    null or non-finite component, or are not of the most frequent length (the larger
    one, if two are), take no part. A row that is there several times counts once; an
    id with several vectors is as many candidates. Other columns are not looked at.
    """
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col(key).isNotNull() & F.coalesce(~odd, F.lit(False)) & F.exists(v, lambda x: x != 0)).select(
        F.col(key).alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).groupBy("vec_id", "v").agg(F.max("asks").alias("asks"))
    length = usable.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    rows = settle(usable.filter(F.size("v") == (length[0]["length"] if length else 0)))
    # of rows with equal vectors, the smallest ids are all that a result can hold, besides the query's own
    numbered = running_totals(rows.select("vec_id", "v", F.lit(1).alias("one")), {"one": "n"}, ["vec_id"], by=["v"])
    nodes = settle(numbered.filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
                   .withColumn("node", F.monotonically_increasing_id()))
    asks = settle(rows.filter("asks").select("vec_id", "v").join(nodes.select("v", "node"), "v").select("vec_id", "node"))
    beams = _searched(neighbour_graph(nodes, nodes.count(), **graph), settle(asks.select("node").distinct()), beam, opened, left)
    close = beams.select(F.col("node").alias("query"), F.explode(F.concat(F.array("node"), F.slice("ids", 1, 3 * k))).alias("node"))
    score = F.aggregate(
        F.zip_with("v", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)
    scored = close.join(nodes, "node").join(nodes.select(F.col("node").alias("query"), F.col("v").alias("q")), "query").select(
        "query", F.transform("members", lambda m: F.struct((-score).alias("far"), m.alias("vec_id"))).alias("found"))
    best = settle(scored.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")))
    own = F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))
    return (
        asks.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(best, "query")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "f"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", (-F.col("f.far")).alias("score"))
    )
