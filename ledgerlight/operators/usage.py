"""Reports and audits over a usage log, for all tenants at once.

The log has the columns of `ledgerlight.sources.usage_log.USAGE_SCHEMA`;
`members` has tenant_id, user_id, user_name, role, daily_limit and
allowed_depths. Logs are pre-aggregated before they meet another table, so
one busy tenant or user does not weigh on a single task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import date, timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.ordering import join_facts, running_totals, settle

# Fixed values: $ per million input and output tokens, and the model priced for unknown ones.
PRICES = {
    "claude-opus-4-8": (15.0, 75.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-haiku-4-5": (0.80, 4.0),
    "gpt-4o": (2.5, 10.0),
    "deepseek-v3": (0.27, 1.10),
}
DEFAULT_MODEL = "claude-sonnet-4-6"

COST = "decimal(18,6)"
WINDOWS_PER_SLICE = 64


def day() -> Column:
    return F.substring("timestamp", 1, 10)


def month() -> Column:
    return F.substring("timestamp", 1, 7)


def tokens() -> Column:
    return F.col("token_input") + F.col("token_output")


def usage_cost(log: DataFrame, prices: dict[str, tuple[float, float]] | None = None,
               default_model: str = DEFAULT_MODEL) -> DataFrame:
    """Set `cost_usd` from the tokens, at six decimals.

    The price table is a literal, so nothing is joined, and the arithmetic is
    exact, so halves are always rounded the same way.
    """
    prices = PRICES if prices is None else prices
    per_in, per_out = prices[default_model]

    def cost(tokens_name: str, at: int, default: float) -> Column:
        table = F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), _price(p[at]))])
        price = F.coalesce(F.try_element_at(table, F.col("model")), _price(default))
        return F.col(tokens_name).cast("decimal(12,0)") * price * F.lit(Decimal("0.000001"))

    total = cost("token_input", 0, per_in) + cost("token_output", 1, per_out)
    return log.withColumn("cost_usd", F.round(total, 6).cast("double"))


def _price(dollars: float) -> Column:
    return F.lit(str(dollars)).cast("decimal(12,6)")


def _cost_sum() -> Column:
    return F.round(F.sum(F.col("cost_usd").cast(COST)), 4).cast("double")


def usage_daily(log: DataFrame) -> DataFrame:
    """Calls, successes, errors, tokens and cost per tenant and day."""
    return log.groupBy("tenant_id", day().alias("date")).agg(
        F.count("*").alias("total_calls"),
        F.count_if(F.col("status") == "success").alias("success_calls"),
        F.count_if(~F.col("status").eqNullSafe("success")).alias("error_calls"),
        F.sum(tokens()).alias("total_tokens"),
        _cost_sum().alias("total_cost_usd"),
    )


def usage_daily_by(log: DataFrame, key: str) -> DataFrame:
    """Calls per tenant, day and another column, such as depth or user_name."""
    return log.groupBy("tenant_id", day().alias("date"), key).agg(F.count("*").alias("calls"))


def usage_top_expensive(log: DataFrame, n: int = 3) -> DataFrame:
    """The n most expensive calls per tenant and day; the earlier of equals first.

    Spark applies the rank limit before the shuffle, so a busy day sends n rows per task.
    """
    order = Window.partitionBy("tenant_id", "date").orderBy(F.col("cost_usd").desc(), "timestamp", "user_id")
    return (
        log.withColumn("date", day())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def usage_monthly(log: DataFrame) -> DataFrame:
    """Calls, tokens, cost and means per tenant and month."""
    return log.groupBy("tenant_id", month().alias("month")).agg(
        F.count("*").alias("total_calls"),
        F.sum(tokens()).alias("total_tokens"),
        _cost_sum().alias("total_cost_usd"),
        F.round(F.sum(F.col("cost_usd").cast(COST)).cast("double") / F.count("*"), 4).alias("avg_cost_per_call"),
        F.round(F.sum(F.col("elapsed_seconds").cast("decimal(18,4)")).cast("double") / F.count("*"), 1)
        .alias("avg_elapsed_seconds"),
    )


def usage_calls_per_day(log: DataFrame) -> DataFrame:
    """The daily breakdown of the monthly report."""
    return log.groupBy("tenant_id", month().alias("month"), day().alias("date")).agg(F.count("*").alias("calls"))


def since(log: DataFrame, days: int, as_of: str | date) -> DataFrame:
    """Rows of the last `days` days before `as_of`, that day included."""
    end = date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return log.filter(F.col("timestamp") >= (end - timedelta(days=days)).isoformat())


def usage_user_stats(log: DataFrame, days: int, as_of: str | date) -> DataFrame:
    """Calls, tokens and cost per user over the last `days` days."""
    return since(log, days, as_of).groupBy("tenant_id", "user_id").agg(
        F.count("*").alias("total_calls"),
        F.sum(tokens()).alias("total_tokens"),
        _cost_sum().alias("total_cost_usd"),
    )


def usage_user_breakdown(log: DataFrame, days: int, as_of: str | date) -> DataFrame:
    """Calls per user by depth and by date: (tenant_id, user_id, kind, label, calls)."""
    base = since(log, days, as_of).groupBy("tenant_id", "user_id", "depth", day().alias("date")).count()
    kinds = base.select("tenant_id", "user_id", "count", F.inline(F.array(
        F.struct(F.lit("depth").alias("kind"), F.col("depth").alias("label")),
        F.struct(F.lit("date").alias("kind"), F.col("date").alias("label")),
    )))
    return kinds.groupBy("tenant_id", "user_id", "kind", "label").agg(F.sum("count").alias("calls"))


def budget_alert(log: DataFrame, budgets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Tenant months above `threshold` of their monthly_budget, with percent and remainder."""
    spent = usage_monthly(log).select("tenant_id", "month", "total_cost_usd")
    return (
        spent.join(budgets.select("tenant_id", "monthly_budget"), "tenant_id")
        .filter(F.col("total_cost_usd") > F.col("monthly_budget") * threshold)
        .withColumn("percent", ratio(F.col("total_cost_usd"), F.col("monthly_budget")) * 100)
        .withColumn("remaining", F.col("monthly_budget") - F.col("total_cost_usd"))
    )


def member_usage(log: DataFrame, members: DataFrame, budgets: DataFrame, as_of: str) -> DataFrame:
    """Calls today against the limit for every member, idle ones included.

    The team's calls count this tenant's users only, and the budget share is cost over budget.
    """
    per_user = log.filter(month() == as_of[:7]).groupBy("tenant_id", "user_id").agg(
        F.count_if(day() == as_of).alias("today"), F.sum(F.col("cost_usd").cast(COST)).alias("_cost"))
    team = per_user.groupBy("tenant_id").agg(
        F.sum("today").alias("team_today"), F.round(F.sum("_cost"), 4).cast("double").alias("month_cost_usd"))
    tenants = budgets.select("tenant_id", "monthly_budget").join(team, "tenant_id", "full")
    people = members.select("tenant_id", "user_id", "user_name", "role", "daily_limit").join(
        per_user.select("tenant_id", "user_id", "today"), ["tenant_id", "user_id"], "left")
    cost = F.coalesce("month_cost_usd", F.lit(0.0))
    # one tenant may hold many of the members
    return join_facts(people, tenants, ["tenant_id"], "left").select(
        "tenant_id", "user_id", "user_name", "role",
        F.coalesce("today", F.lit(0)).alias("today"), "daily_limit",
        F.coalesce("team_today", F.lit(0)).alias("team_today"),
        cost.alias("month_cost_usd"),
        "monthly_budget",
        F.coalesce(ratio(cost, F.col("monthly_budget")) * 100, F.lit(0.0)).alias("budget_pct"),
    )


def depth_violations(log: DataFrame, members: DataFrame) -> DataFrame:
    """Depths used without permission, per user, with calls and first and last time."""
    used = log.groupBy("tenant_id", "user_id", "depth").agg(
        F.count("*").alias("calls"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    return (
        used.join(members.select("tenant_id", "user_id", "role", "allowed_depths"), ["tenant_id", "user_id"])
        .filter(~F.array_contains("allowed_depths", F.col("depth")))
        .drop("allowed_depths")
    )


def quota_violations(log: DataFrame, members: DataFrame, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Calls beyond the daily limit, numbered within the user's day.

    Days over their limit are found by counting; only their calls are fetched
    and numbered, with large days split over several tasks. `order` should
    make the calls of a day distinct.
    """
    keys = ["tenant_id", "user_id", "date"]
    dated = log.withColumn("date", day())
    over = (
        dated.groupBy(*keys).agg(F.count("*").alias("_calls"))
        .join(members.select("tenant_id", "user_id", "daily_limit"), ["tenant_id", "user_id"])
        .filter(F.col("_calls") > F.col("daily_limit"))
        .select(*keys, "daily_limit")
    )
    calls = join_facts(dated, over, keys).withColumn("_one", F.lit(1).cast("long"))
    numbered = running_totals(calls, {"_one": "call_no"}, order, by=keys)
    return numbered.filter(F.col("call_no") > F.col("daily_limit")).drop("_one")


def _in_windows(log: DataFrame, span: int, key: str, time: str) -> DataFrame:
    """Moments with their calls and the attempts in the window that ends there.

    Attempts at one moment are merged first, and each key's time line is cut into
    slices that carry one window of history, so a busy key is spread over many tasks.
    """
    slice_us = span * WINDOWS_PER_SLICE
    at = F.unix_micros(F.col(time).cast("timestamp"))
    moments = log.groupBy(F.col(key), at.alias("_us")).agg(F.count("*").alias("calls"))
    own = F.floor(F.col("_us") / slice_us)
    last = F.floor((F.col("_us") + span - 1) / slice_us)
    sliced = moments.withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(own, last)))
    frame = Window.partitionBy(key, "_slice").orderBy("_us").rangeBetween(-(span - 1), 0)
    return sliced.withColumn("attempts", F.sum("calls").over(frame)).filter(F.col("_slice") == F.col("_own")).drop("_own")


def rate_violations(log: DataFrame, burst: int = 10, window_seconds: float = 1.0, key: str = "tenant_id",
                    time: str = "timestamp") -> DataFrame:
    """Moments at which more than `burst` attempts fell into the window that ends there.

    The window is half-open: an attempt exactly one window old is outside.
    Refused attempts count too, so this is an upper bound; `rate_refusals` is exact.
    """
    moments = _in_windows(log, round(window_seconds * 1_000_000), key, time)
    return moments.filter(F.col("attempts") > burst).select(key, F.timestamp_micros("_us").alias("at"), "calls", "attempts")


def rate_refusals(log: DataFrame, burst: int = 10, window_seconds: float = 1.0, key: str = "tenant_id",
                  time: str = "timestamp") -> DataFrame:
    """Moments at which a gate refuses calls: key, at, calls, admitted, refused. Refused calls do not use up the window.

    A moment whose window holds at most `burst` attempts admits all its calls,
    whatever the gate admitted before. So once a whole window has passed without a
    moment above `burst`, the gate holds just the attempts of that window, and the
    time line falls into busy periods that are decided on their own, also where a key
    never pauses. A period is read in order with `burst` times of state, so its length
    is not bounded by memory; a key that is above `burst` in every window from first
    to last is one period and so one task, which reads 16 bytes per moment. Rows
    without a key or time are left out.
    """
    span = round(window_seconds * 1_000_000)
    slice_us = span * WINDOWS_PER_SLICE
    # written once: which moments are above `burst` decides the periods, whose calls are then read from the same table
    moments = settle(_in_windows(log.filter(F.col(key).isNotNull() & F.col(time).cast("timestamp").isNotNull()), span, key, time))
    above = moments.filter(F.col("attempts") > burst).select(key, "_us")
    own, last = F.floor(F.col("_us") / slice_us), F.floor((F.col("_us") + span - 1) / slice_us)
    sliced = above.withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(own, last)))
    before = Window.partitionBy(key, "_slice").orderBy("_us").rangeBetween(-(span - 1), -1)
    starts = sliced.withColumn("_start", (F.count("*").over(before) == 0).cast("int")).filter(F.col("_slice") == F.col("_own"))
    numbered = running_totals(starts.select(key, "_us", "_start"), {"_start": "_period"}, ["_us"], by=[key])
    periods = numbered.groupBy(key, "_period").agg((F.min("_us") - span + 1).alias("_from"), F.max("_us").alias("_to"))
    slices = F.sequence(F.floor(F.col("_from") / slice_us), F.floor(F.col("_to") / slice_us))
    # at most as many periods as windows begin in a slice, so the join does not multiply moments
    held = join_facts(moments, periods.withColumn("_slice", F.explode(slices)), [key, "_slice"]).filter("_us BETWEEN _from AND _to")

    def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        period, kept, live = None, deque(), 0
        for batch in batches:
            out = []
            for k, p, us, calls in zip(batch["_key"], batch["_period"], batch["_us"], batch["calls"]):
                if (k, p) != period:
                    period, kept, live = (k, p), deque(), 0
                while kept and us - kept[0][0] >= span:
                    live -= kept.popleft()[1]
                admitted = min(int(calls), burst - live)
                if admitted:
                    kept.append((us, admitted))
                    live += admitted
                if admitted < calls:
                    out.append((k, us, calls, admitted))
            yield pd.DataFrame(out, columns=["_key", "_us", "calls", "admitted"])

    ordered = held.select(F.col(key).cast("string").alias("_key"), "_period", "_us", "calls").repartition("_key", "_period").sortWithinPartitions("_key", "_period", "_us")
    refused = ordered.mapInPandas(decided, "_key string, _us long, calls long, admitted long")
    return refused.select(
        F.col("_key").cast(log.schema[key].dataType).alias(key), F.timestamp_micros("_us").alias("at"), "calls", "admitted",
        (F.col("calls") - F.col("admitted")).alias("refused"))
