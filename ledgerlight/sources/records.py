"""Records of delimited text whose quoted fields may hold line breaks, read in splits.

A line is read from one of two states, outside or inside a quoted field, and ends
in one of them. So a block of lines maps the state before it to the state after
it, and such maps compose. A first scan takes every block's map from both states
at once; the states before the blocks of a file follow from the maps of the
blocks ahead; a second scan joins lines to records, and only what goes on across
a block's edge, at most two parts per block, is put together apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import settle

WHOLE, HEAD, MIDDLE, TAIL = range(4)


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that begins inside or outside a quoted field ends inside one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line.startswith('"', quote + 1):
                at = quote + 2
                continue
            # what follows the closing quote belongs to the field
            inside, at = False, line.find(sep, quote + 1)
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _line_ends(line: str, inside: bool, sep: str, comment: str | None) -> bool:
    if comment and not inside and line.startswith(comment):
        return False
    return ends_inside(line, inside, sep)


def _block_maps(lines: DataFrame, sep: str, comment: str | None) -> DataFrame:
    """_file, _start, and the state after the block if it begins outside (`out`) or inside (`in`) a quoted field."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, state, done = None, [False, True], []
        for batch in batches:
            for file, start, line in zip(batch["_file"], batch["_start"], batch["value"]):
                if (file, start) != block:
                    if block:
                        done.append((*block, *map(int, state)))
                    block, state = (file, start), [False, True]
                if line is not None:
                    state = [_line_ends(line, s, sep, comment) for s in state]
            yield pd.DataFrame(done, columns=["_file", "_start", "out", "in"])
            done = []
        if block:
            yield pd.DataFrame([(*block, *map(int, state))], columns=["_file", "_start", "out", "in"])

    quoted = lines.select("_file", "_start", F.when(F.col("value").contains('"'), F.col("value")).alias("value"))
    return quoted.mapInPandas(mapped, "_file string, _start long, out int, in int")


def _states(maps: DataFrame) -> DataFrame:
    """_file, _start, inside: the state before each block.

    A map is constant, or it keeps the state, or it turns it. The state is that of
    the last constant map ahead, turned once for each turning map since.
    """
    order = Window.partitionBy("_file").orderBy("_start")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = maps.withColumn("turn", ((F.col("out") == 1) & (F.col("in") == 0)).cast("int")).withColumn("turns", F.sum("turn").over(order))
    constant = F.when(F.col("out") == F.col("in"), F.struct("out", "turns"))
    seen = turns.withColumn("last", F.last(constant, ignorenulls=True).over(ahead)).withColumn("ahead", F.coalesce(F.sum("turn").over(ahead), F.lit(0)))
    state = F.coalesce("last.out", F.lit(0)) + F.col("ahead") - F.coalesce("last.turns", F.lit(0))
    return seen.select("_file", "_start", (state % 2 == 1).alias("inside"))


def whole_records(lines: DataFrame, sep: str, comment: str | None = None) -> DataFrame:
    """Records of `lines` (_file, _start, _id, value; ids grow along a file), with the place of their first line; written once.

    `comment` marks lines to leave out, at the start of a record. A file that ends
    inside a quoted field is an error.
    """
    states = settle(_states(settle(_block_maps(lines, sep, comment))))
    columns = ["_file", "_start", "_id", "part", "value"]

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, inside, held, first, part = None, False, [], 0, WHOLE
        for batch in batches:
            out = []
            for file, start, at, line, began in zip(batch["_file"], batch["_start"], batch["_id"], batch["value"], batch["inside"]):
                if (file, start) != block:
                    if held:
                        out.append((*block, first, MIDDLE if part == HEAD else TAIL, "\n".join(held)))
                    block, inside, held = (file, start), bool(began), []
                    first, part = at, HEAD if inside else WHOLE
                if not inside and not held:
                    if comment and line.startswith(comment):
                        continue
                    first, part = at, WHOLE
                inside = ends_inside(line, inside, sep)
                held.append(line if inside else line.removesuffix("\r"))
                if not inside:
                    out.append((file, start, first, part, "\n".join(held)))
                    held = []
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(*block, first, MIDDLE if part == HEAD else TAIL, "\n".join(held))], columns=columns)

    placed = lines.join(states, ["_file", "_start"]).sortWithinPartitions("_file", "_start", "_id")
    rows = settle(placed.select("_file", "_start", "_id", "value", "inside").mapInPandas(
        joined, "_file string, _start long, _id long, part int, value string"))
    begun = F.sum((F.col("part") == TAIL).cast("int")).over(
        Window.partitionBy("_file").orderBy("_start", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = rows.filter(F.col("part") != WHOLE).withColumn("record", begun)
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_start", "part", "value"))), lambda p: p["value"]))
    ended = F.max((F.col("part") == HEAD).cast("int")) == 1
    stitched = cut.groupBy("_file", "record").agg(
        F.min("_start").alias("_start"), F.min_by("_id", F.struct("_start", "part")).alias("_id"),
        F.when(ended, text).otherwise(F.raise_error(F.concat(F.lit("the file ends inside quotes: "), F.first("_file"))).cast("string")).alias("value"))
    return rows.filter(F.col("part") == WHOLE).drop("part").unionByName(stitched.drop("record"))
