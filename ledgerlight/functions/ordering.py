"""Exact order statistics and running totals for tables of any size.

A sort of the whole table in one task does not scale, and neither does the
built-in `percentile`, which merges every distinct value in one place. The
helpers here keep each task to one range partition or to a bounded number of
values, and are exact.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .exprs import as_double, col

# Order statistics are narrowed down until so many values are left to sort.
PICK_FROM = 100_000
SKETCH_ACCURACY = 10_000

# Values of a column that are sent whole to every task; more frequent ones than this share of the rows are never shuffled.
LOOK_UP = 100_000

# Spark's setting that removes the shuffle files of an execution at its end, rather than when the driver next collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders of intermediate tables, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach, taken from spark.checkpoint.dir."""
    ctx = spark.sparkContext
    known = ctx.getCheckpointDir()
    if known is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None:
            if not ctx.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            wanted = tempfile.mkdtemp(prefix="ledgerlight-")
        ctx.setCheckpointDir(wanted)
        known = ctx.getCheckpointDir()
    return known


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_work(spark: SparkSession) -> int:
    """Remove the intermediate tables of this session, once their results are no longer needed; their number."""
    jvm = spark.sparkContext._jvm
    gone = 0
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        gone += folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def settle(df: DataFrame) -> DataFrame:
    """Write the table to shared storage and go on from there.

    A lost executor then cannot change which rows a partition holds, and later
    steps read only the columns they need. What was shuffled for it is removed.
    """
    path, conf = work_path(df.sparkSession, "settled"), df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(DROP_SHUFFLES)
        else:
            conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed_by_range(df: DataFrame, order: Sequence) -> DataFrame:
    """Rows split into ordered ranges, with the range number as data in `_pid`."""
    return settle(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))


def sort_keys(order: Sequence[str]) -> list:
    """Sort columns from names; a leading '-' sorts descending."""
    return [col(o[1:]).desc() if o.startswith("-") else col(o).asc() for o in order]


def running_totals(
    df: DataFrame, measures: dict[str, str], order: Sequence[str], by: Sequence[str] = (),
) -> DataFrame:
    """Add, per measure, its total over all rows up to and including this one.

    `measures` maps a column to the name of its running total. Rows are sorted
    by `by` and then `order`, which together should be unique. A large group is
    spread over several ranges: totals are kept per range, and only groups that
    cross a range edge need an offset, so the offset table has at most two rows
    per partition and is safe to broadcast. `by` columns must not be NULL.
    """
    by = list(by)
    keys = sort_keys(order)
    placed = placed_by_range(df, [col(b).asc() for b in by] + keys)
    sums = [F.sum(col(m)).alias(out) for m, out in measures.items()]
    outs = list(measures.values())
    per_range = placed.groupBy("_pid", *[col(b) for b in by]).agg(*sums)
    if by:
        group = F.struct(*[col(c) for c in by + outs])
        edges = (
            per_range.groupBy("_pid")
            .agg(F.min(group).alias("first"), F.max(group).alias("last"))
            .select("_pid", F.explode(F.array_distinct(F.array("first", "last"))).alias("g"))
            .select("_pid", "g.*")
        )
    else:
        edges = per_range
    before = (
        Window.partitionBy(*[col(b) for b in by]).orderBy("_pid")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = edges.select(
        "_pid", *[col(b) for b in by],
        *[F.sum(col(o)).over(before).alias("_before_" + o) for o in outs],
    )
    local = (
        Window.partitionBy("_pid", *[col(b) for b in by]).orderBy(*keys)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = placed.join(F.broadcast(offsets), ["_pid", *by], "left")
    for m, out in measures.items():
        start = F.coalesce(col("_before_" + out), F.lit(0))
        joined = joined.withColumn(out, start + F.sum(col(m)).over(local))
    return joined.select(*[col(c) for c in df.columns], *[col(o) for o in outs])


def mid_ranks(
    values: DataFrame, names: Sequence[str], views: dict[str, tuple[str, Sequence[str]]] | None = None,
) -> DataFrame:
    """Replace every value of the columns by its mean rank among the column's values; NULLs stay.

    `views` (name: column, columns that must be there too) gives ranks within such rows
    instead, several per column. Values are counted first, so that only distinct ones
    are sorted, and a column's values are looked up once for all its views: frequent
    ones, and all of a column with few, by broadcast; the others by a shuffle of the
    rows. Without `views`, rows without any value are left out.
    """
    written = settle(values.select(*names))
    if views is None:
        # not on the ranks: the planner would infer a filter for every mixture of their names
        views = {n: (n, ()) for n in names}
        written = written.filter(" OR ".join(f"{n} IS NOT NULL" for n in names))
    groups = sorted({tuple(g) for _, g in views.values()})
    of = {n: [(view, f"_g{groups.index(tuple(g))}") for view, (c, g) in views.items() if c == n] for n in names}
    slots = range(max(map(len, of.values())))
    rows = written.select(*names, *[
        F.expr(" AND ".join(f"{h} IS NOT NULL" for h in g) or "TRUE").alias(f"_g{k}") for k, g in enumerate(groups)])
    long = rows.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(n).alias("v"), *[
            (F.col(of[n][j][1]) if j < len(of[n]) else F.lit(False)).alias(f"in{j}") for j in slots])
        for i, n in enumerate(names)
    ]))).filter("v IS NOT NULL")
    counts = settle(long.groupBy("c", "v").agg(
        F.count("*").alias("rows"), *[F.count_if(f"in{j}").alias(f"n{j}") for j in slots]))
    sizes = {r["c"]: r for r in counts.groupBy("c").agg(
        F.count("*").alias("values"), F.sum("rows").alias("rows"), F.max("rows").alias("most")).collect()}
    totals = running_totals(counts, {f"n{j}": f"upto{j}" for j in slots}, ["v"], by=["c"])
    ranked = settle(totals.select("c", "v", "rows", *[(F.col(f"upto{j}") - (F.col(f"n{j}") - 1) / 2).alias(f"mid{j}") for j in slots]))
    found = rows
    # the columns that take a shuffle come first, while the rows are narrow
    for i in sorted(range(len(names)), key=lambda i: -sizes[i]["values"] if i in sizes else 0):
        n = names[i]
        mids = [f"mid{j}" for j in range(len(of[n]))]
        known = ranked.filter(F.col("c") == i)
        many = i in sizes and sizes[i]["values"] > LOOK_UP
        hot = many and sizes[i]["most"] * LOOK_UP > sizes[i]["rows"]
        often = F.col("rows") * LOOK_UP > F.lit(sizes[i]["rows"] if many else 0)
        ranks = [[] for _ in mids]
        if hot or not many:
            few = known.filter(often).select(F.col("v").alias("_v"), *[F.col(m).alias(f"_{m}") for m in mids])
            found = found.join(F.broadcast(few), F.col(n) == F.col("_v"), "left")
            ranks = [[F.col(f"_{m}")] for m in mids]
        if many:
            # rows that find nothing here are spread by their hash
            done = F.col(n).isNull() | F.col("_v").isNotNull() if hot else F.col(n).isNull()
            found = found.withColumn("_spread", F.when(done, F.xxhash64(*found.columns)).otherwise(0)).drop("_v")
            rest = known.filter(~often).select(F.col("v").alias("_v"), F.lit(0).cast("long").alias("_at"), *mids)
            found = found.join(rest, (F.col(n) == F.col("_v")) & (F.col("_spread") == F.col("_at")), "left")
            ranks = [r + [F.col(m)] for r, m in zip(ranks, mids)]
        done = {n, "_v", "_spread", "_at", *mids, *[f"_{m}" for m in mids]}
        found = found.select(*[c for c in found.columns if c not in done], *[
            F.when(F.col(g), F.coalesce(*r)).alias(f"_r_{view}") for (view, g), r in zip(of[n], ranks)])
    return found.select(*[F.col(f"_r_{view}").alias(view) for view in views])


def rows_at_ranks(
    df: DataFrame, by: str, order: Sequence[str], ranks: dict[str, Sequence[int]]
) -> dict[str, list]:
    """The rows at given 1-based ranks of each `by` group.

    Only counts per range and the few wanted rows reach the driver; only the
    ranges that hold a wanted rank are sorted.
    """
    keys = sort_keys(order)
    placed = placed_by_range(df, [col(by).asc(), *keys])
    counts = placed.groupBy(col(by).alias("g"), "_pid").count().orderBy("g", "_pid").collect()
    wanted = []
    seen: dict[str, int] = {}
    for r in counts:
        start = seen.get(r["g"], 0)
        seen[r["g"]] = start + r["count"]
        for i, rank in enumerate(ranks.get(r["g"], ())):
            if start < rank <= start + r["count"]:
                wanted.append((r["g"], r["_pid"], rank - start, i))
    if not wanted:
        return {}
    spots = sorted({(g, pid) for g, pid, _, _ in wanted})
    holds = F.lit(False)
    for g, pid in spots:
        holds = holds | ((col(by) == F.lit(g)) & (F.col("_pid") == F.lit(pid)))
    numbered = placed.filter(holds).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(by, "_pid").orderBy(*keys))
    )
    hit = F.lit(False)
    for g, pid, rn, _ in wanted:
        hit = hit | ((col(by) == g) & (F.col("_pid") == pid) & (F.col("_rn") == rn))
    found = {(r[by], r["_pid"], r["_rn"]): r for r in numbered.filter(hit).collect()}
    result: dict[str, list] = {g: [None] * len(rs) for g, rs in ranks.items()}
    for g, pid, rn, i in wanted:
        result[g][i] = found[(g, pid, rn)]
    return result


@dataclass
class _Target:
    """One wanted order statistic and the open interval that still holds it."""

    name: str
    rank: int
    low: float | None
    high: float | None
    below: int
    inside: int
    value: float | None = None


def _num(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def _inside(t: _Target) -> str:
    parts = [f"{t.name} IS NOT NULL"]
    if t.low is not None:
        parts.append(f"{t.name} > {_num(t.low)}")
    if t.high is not None:
        parts.append(f"{t.name} < {_num(t.high)}")
    return " AND ".join(parts)


def _narrow(work: DataFrame, targets: list[_Target]) -> None:
    """Shrink every interval around its rank; two scans, no shuffle of rows."""
    # targets in the same interval share one sketch
    groups: dict[tuple, list[int]] = {}
    for i, t in enumerate(targets):
        groups.setdefault((t.name, t.low, t.high), []).append(i)
    sketches = []
    for members in groups.values():
        probs = []
        for i in members:
            t = targets[i]
            at, margin = (t.rank - t.below + 0.5) / t.inside, 3 / SKETCH_ACCURACY
            probs += [max(0.0, at - margin), min(1.0, at + margin)]
        t = targets[members[0]]
        array = ", ".join(f"{p!r}D" for p in probs)
        sketches.append(F.expr(
            f"percentile_approx(CASE WHEN {_inside(t)} THEN {t.name} END, array({array}), {SKETCH_ACCURACY})"))
    found = work.agg(*sketches).first()
    cuts: dict[str, set[float]] = {}
    for (name, _, _), values in zip(groups, found):
        cuts.setdefault(name, set()).update(values)
    for name, points in cuts.items():
        cuts[name] = sorted(points)
    slots = work.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("c"), F.expr(_slot(n, points)).alias("slot")) for n, points in cuts.items()
    ]))).filter("slot IS NOT NULL").groupBy("c", "slot").count()
    counted = {(r["c"], r["slot"]): r["count"] for r in slots.collect()}
    for t in targets:
        seen = 0
        for i, point in enumerate(cuts[t.name]):
            seen += counted.get((t.name, 2 * i), 0)
            equal = counted.get((t.name, 2 * i + 1), 0)
            if t.rank < seen:
                if t.high is None or point < t.high:
                    t.high, t.inside = point, seen - t.below
                break
            if t.rank < seen + equal:
                t.value = point
                break
            seen += equal
            if t.low is None or point > t.low:
                t.inside -= seen - t.below
                t.low, t.below = point, seen


def _slot(name: str, points: Sequence[float]) -> str:
    """2i below the i-th point, 2i + 1 at it; NULL stays NULL."""
    tests = [f"WHEN {name} IS NULL THEN NULL"]
    for i, p in enumerate(points):
        tests += [f"WHEN {name} < {_num(p)} THEN {2 * i}", f"WHEN {name} = {_num(p)} THEN {2 * i + 1}"]
    return f"CASE {' '.join(tests)} ELSE {2 * len(points)} END"


def _pick(work: DataFrame, targets: list[_Target]) -> None:
    """Read the wanted values from intervals that hold few; intervals do not overlap."""
    spans = sorted({(t.name, t.low, t.high) for t in targets}, key=str)
    number = {span: i for i, span in enumerate(spans)}
    by_column: dict[str, list[str]] = {}
    for t in targets:
        test = f"WHEN {_inside(t)} THEN {number[(t.name, t.low, t.high)]}"
        if test not in by_column.setdefault(t.name, []):
            by_column[t.name].append(test)
    inside = work.select(F.inline(F.array(*[
        F.struct(F.expr(f"CASE {' '.join(tests)} END").alias("span"), F.col(n).alias("v"))
        for n, tests in by_column.items()
    ]))).filter("span IS NOT NULL")
    order = Window.partitionBy("span").orderBy("v")
    numbered = inside.withColumn("at", F.row_number().over(order) - 1)
    wanted = {(number[(t.name, t.low, t.high)], t.rank - t.below): t for t in targets}
    hit = F.lit(False)
    for span, at in wanted:
        hit = hit | ((F.col("span") == span) & (F.col("at") == at))
    found = {(r["span"], r["at"]): r["v"] for r in numbered.filter(hit).collect()}
    for t in targets:
        t.value = found[(number[(t.name, t.low, t.high)], t.rank - t.below)]


def _bracketed(work: DataFrame, brackets: dict[str, list[tuple[float, float]]], targets: list[_Target], pick_from: int) -> None:
    """Place every target among the bracket ends, and read those that lie within a bracket; one scan.

    Values within brackets are counted one by one, all others by the slot that they
    fall into. Targets that a sketch missed, or whose slot holds more than `pick_from`
    values, are left with the interval that holds them.
    """
    cuts = {n: sorted({x for pair in pairs for x in pair}) for n, pairs in brackets.items()}
    wanted = {n: sorted({2 * i for low, high in brackets[n] for i in range(points.index(low) + 1, points.index(high) + 1)}) for n, points in cuts.items()}
    slots = work.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("c"), F.expr(_slot(n, points)).alias("slot"), F.col(n).alias("v")) for n, points in cuts.items()
    ]))).filter("slot IS NOT NULL")
    inside = F.lit(False)
    for n, found in wanted.items():
        inside = inside | ((F.col("c") == n) & F.col("slot").isin(found))
    counts = settle(slots.groupBy("c", "slot", F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("n")))
    held = {(r["c"], r["slot"]): r["n"] for r in counts.groupBy("c", "slot").agg(F.sum("n").alias("n")).collect()}
    within: dict[tuple[str, int, int], _Target] = {}
    for t in targets:
        points, seen = cuts[t.name], 0
        for slot in range(2 * len(points) + 1):
            n = held.get((t.name, slot), 0)
            if t.rank < seen + n:
                break
            seen += n
        if slot % 2:
            t.value = points[slot // 2]
            continue
        t.low, t.high = points[slot // 2 - 1] if slot else None, points[slot // 2] if slot < 2 * len(points) else None
        t.below, t.inside = seen, n
        if slot in wanted[t.name] and n <= pick_from:
            within[(t.name, slot, t.rank - seen)] = t
    if not within:
        return
    hit = F.lit(False)
    for name, slot, at in within:
        hit = hit | ((F.col("c") == name) & (F.col("slot") == slot) & (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at))
    upto = F.sum("n").over(Window.partitionBy("c", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = counts.filter("v IS NOT NULL").withColumn("upto", upto).filter(hit)
    found = [(r["c"], r["slot"], r["upto"] - r["n"], r["upto"], r["v"]) for r in few.collect()]
    for (name, slot, at), t in within.items():
        t.value = next(v for c, s, low, high, v in found if (c, s) == (name, slot) and low <= at < high)


def quantiles_with(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], also: Sequence[Column] = (), *, approx: bool = False, pick_from: int = PICK_FROM,
) -> tuple[dict[str, list[float | None]], Row]:
    """`exact_quantiles`, and a row of other aggregates of `df` taken in the same scan.

    The first scan counts and sketches, the second places the ranks and reads the
    values around them. More scans follow only where a bracket holds more than
    `pick_from` values, as from some 150 million rows on.
    """
    names = [f"c{i}" for i in range(len(cols))]
    values = [as_double(df, c) for c in cols]
    margin = 3 / SKETCH_ACCURACY
    at = [x for p in probs for x in ((p,) if approx else (max(0.0, p - margin), min(1.0, p + margin)))]
    sketches = [F.percentile_approx(v, F.array(*[F.lit(float(x)) for x in at]), F.lit(SKETCH_ACCURACY)) for v in values]
    row = df.agg(*[F.count(v) for v in values], *sketches, *also).first()
    counts, found, rest = row[: len(cols)], row[len(cols) : 2 * len(cols)], row[2 * len(cols) :]
    if approx:
        return {c: list(f) if f else [None] * len(probs) for c, f in zip(cols, found)}, rest
    work = df.select(*[v.alias(n) for v, n in zip(values, names)])
    targets: dict[tuple[str, int], _Target] = {}
    for n, k in zip(names, counts):
        for rank in {f((k - 1) * p) for p in probs for f in (math.floor, math.ceil)} if k else ():
            targets[(n, rank)] = _Target(n, rank, None, None, 0, k)
    brackets = {n: [(f[2 * i], f[2 * i + 1]) for i in range(len(probs))] for n, k, f in zip(names, counts, found) if k > pick_from}
    if brackets:
        _bracketed(work, brackets, [t for t in targets.values() if t.name in brackets], pick_from)
    while wide := [t for t in targets.values() if t.value is None and t.inside > pick_from]:
        _narrow(work, wide)
    if open_ := [t for t in targets.values() if t.value is None]:
        _pick(work, open_)
    result: dict[str, list[float | None]] = {}
    for c, n, k in zip(cols, names, counts):
        result[c] = [None] * len(probs)
        for i, p in enumerate(probs if k else ()):
            pos = (k - 1) * p
            lo, hi = targets[(n, math.floor(pos))].value, targets[(n, math.ceil(pos))].value
            result[c][i] = lo + (hi - lo) * (pos - math.floor(pos))
    return result, rest


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], *, approx: bool = False, pick_from: int = PICK_FROM,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns, NULL and NaN skipped.

    Values are selected by narrowing: a sketch gives a small interval around the
    rank, one scan places the rank and reads what is there, and this repeats until at
    most `pick_from` values are left to sort. `approx=True` takes the sketch as it is.
    """
    return quantiles_with(df, cols, probs, approx=approx, pick_from=pick_from)[0] if cols else {}


def join_facts(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join whose left side may hold a third of its rows under one key; the right side has one row per key.

    The right side is written first. Both sides are then shuffled for this join
    alone, so that adaptive execution can split a hot key by its measured size, or
    send the right side whole where it turns out to be small.
    """
    return left.join(settle(right), list(keys), how)
