import pytest
from pyspark.sql import functions as F

import ledgerlight as L
from ledgerlight.operators import usage

COLUMNS = L.USAGE_SCHEMA.names


def call(ts, tenant="t", user="u1", depth="quick", model="gpt-4o", tin=1000, tout=500, cost=0.0, secs=1.0, status="success"):
    return (ts, tenant, user, "name " + user, depth, model, tin, tout, cost, secs, status)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([
        call("2024-01-01T10:00:00", cost=0.5), call("2024-01-01T10:00:00", user="u2", cost=0.5, status="partial"),
        call("2024-01-01T11:00:00", depth="deep", cost=2.0, status="error"), call("2024-01-01T12:00:00", cost=0.1),
        call("2024-01-02T09:00:00", cost=0.25), call("2024-02-01T09:00:00", cost=4.0), call("2024-01-01T10:00:00", tenant="x", cost=9.0),
    ], L.USAGE_SCHEMA)


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame(
        [("t", "u1", "one", "viewer", 2, ["quick"]), ("t", "u2", "two", "analyst", 5, ["quick", "deep"]),
         ("t", "idle", "none", "admin", 9, ["deep"]), ("x", "u1", "one", "admin", 9, ["quick"])],
        "tenant_id string, user_id string, user_name string, role string, daily_limit int, allowed_depths array<string>")


def test_cost_formula_and_default_price(spark):
    rows = spark.createDataFrame([
        call("2024-01-01T00:00:00", model="claude-sonnet-4-6", tin=1_000_000, tout=1_000_000),
        call("2024-01-01T00:00:00", model="deepseek-v3", tin=1_000_000, tout=0),
        call("2024-01-01T00:00:00", model="unknown", tin=1_000_000, tout=0),
        call("2024-01-01T00:00:00", model="gpt-4o", tin=1, tout=1),
    ], L.USAGE_SCHEMA)
    assert [r.cost_usd for r in L.usage_cost(rows).collect()] == [18.0, 0.27, 3.0, 0.000013]
    own = L.usage_cost(rows, {"base": (1.0, 2.0)}, "base")
    assert [r.cost_usd for r in own.collect()][:2] == [3.0, 1.0]


def test_daily(log):
    got = {(r.tenant_id, r.date): r for r in L.usage_daily(log).collect()}
    r = got[("t", "2024-01-01")]
    assert (r.total_calls, r.success_calls, r.error_calls, r.total_tokens, r.total_cost_usd) == (4, 2, 2, 6000, 3.1)
    assert got[("x", "2024-01-01")].total_calls == 1
    by = {(r.date, r.depth): r.calls for r in L.usage_daily_by(log.filter("tenant_id = 't'"), "depth").collect()}
    assert by[("2024-01-01", "quick")] == 3 and by[("2024-01-01", "deep")] == 1


def test_most_expensive_first_logged_wins(log):
    got = L.usage_top_expensive(log, 3).filter("tenant_id = 't' and date = '2024-01-01'").orderBy("rank").collect()
    assert [(r.cost_usd, r.user_id) for r in got] == [(2.0, "u1"), (0.5, "u1"), (0.5, "u2")]


def test_monthly_budget_and_days(spark, log):
    got = {(r.tenant_id, r.month): r for r in L.usage_monthly(log).collect()}
    assert got[("t", "2024-01")].total_cost_usd == 3.35
    assert got[("t", "2024-01")].avg_cost_per_call == 0.67
    budgets = spark.createDataFrame([("t", 4.0), ("x", 100.0)], "tenant_id string, monthly_budget double")
    alerts = {(r.tenant_id, r.month): (r.percent, r.remaining) for r in L.budget_alert(log, budgets).collect()}
    assert alerts == {("t", "2024-01"): (pytest.approx(83.75), pytest.approx(0.65)), ("t", "2024-02"): (100.0, 0.0)}
    assert L.budget_alert(log, budgets, 1.0).count() == 0
    assert {(r.date, r.calls) for r in L.usage_calls_per_day(log.filter("tenant_id = 't'")).collect()} == {
        ("2024-01-01", 4), ("2024-01-02", 1), ("2024-02-01", 1)}


def test_user_stats_include_the_cutoff_day(log):
    got = {(r.tenant_id, r.user_id): r.total_calls for r in L.usage_user_stats(log, 1, "2024-01-02").collect()}
    assert got[("t", "u1")] == 5  # the later call in February counts too
    days = {(r.kind, r.label): r.calls for r in L.usage_user_breakdown(log, 1, "2024-01-02")
            .filter("tenant_id = 't' and user_id = 'u1'").collect()}
    assert days[("date", "2024-01-01")] == 3 and days[("depth", "quick")] == 4


def test_member_usage_keeps_idle_members(spark, log, members):
    budgets = spark.createDataFrame([("t", 10.0)], "tenant_id string, monthly_budget double")
    got = {(r.tenant_id, r.user_id): r for r in L.member_usage(log, members, budgets, "2024-01-01").collect()}
    assert len(got) == 4
    assert (got[("t", "idle")].today, got[("t", "idle")].team_today) == (0, 4)
    assert got[("t", "u1")].budget_pct == pytest.approx(33.5)
    assert got[("x", "u1")].team_today == 1 and got[("x", "u1")].budget_pct == 0.0


def test_violations(log, members):
    depth = [(r.user_id, r.depth, r.calls) for r in L.depth_violations(log, members).collect()]
    assert depth == [("u1", "deep", 1)]
    quota = [(r.timestamp, r.call_no) for r in L.quota_violations(log, members).collect()]
    assert quota == [("2024-01-01T12:00:00", 3)]


def brute_rate(times, burst, span):
    return sorted({t for t in times if sum(1 for o in times if t - span < o <= t) > burst})


@pytest.mark.parametrize("burst", [1, 3])
def test_rate_violations_match_brute_force(spark, burst):
    # a busy key over several slices, with attempts exactly one window apart and at one moment
    times = [i * 250_000 for i in range(600) if i % 7 < 4] + [70_000_000] * 5 + [64_000_000, 63_000_000, 128_000_000]
    rows = spark.createDataFrame([("hot", t) for t in times] + [("other", 1)], "tenant_id string, us long")
    log = rows.withColumn("timestamp", F.timestamp_micros("us"))
    got = L.rate_violations(log, burst, 1.0)
    mine = sorted(r.us for r in got.select(F.unix_micros("at").alias("us")).collect())
    assert mine == brute_rate(times, burst, 1_000_000)
    assert got.agg(F.sum("calls")).first()[0] == sum(1 for t in times if t in set(mine))


def test_hot_user_quota_over_ranges(spark):
    rows = spark.range(300).select(
        F.format_string("2024-01-01T00:%02d:%02d", (F.col("id") / 60).cast("int"), (F.col("id") % 60).cast("int")).alias("timestamp"),
        F.lit("t").alias("tenant_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("user_id"))
    members = rows.select("tenant_id", "user_id").distinct().withColumn("daily_limit", F.lit(50))
    got = L.quota_violations(rows, members)
    assert got.count() == 150
    assert sorted(r.call_no for r in got.collect()) == list(range(51, 201))


def refused_one_by_one(times, burst, span):
    kept, out = [], {}
    for t in sorted(times):
        kept = [k for k in kept if t - k < span]
        calls, admitted = out.get(t, (0, 0))
        free = len(kept) < burst
        out[t] = calls + 1, admitted + free
        if free:
            kept.append(t)
    return {(t, c, a) for t, (c, a) in out.items() if a < c}


@pytest.mark.parametrize("burst,seed", [(1, 1), (2, 2), (3, 3), (10, 4)])
def test_refusals_match_a_gate(spark, burst, seed):
    import random

    rng = random.Random(seed)
    # one key that never pauses for a window, one that is always above the burst, one with bursts and pauses, one of ties
    times = {
        "steady": [t + rng.randint(0, 400) for t in range(0, 400_000, 1000 // (burst + 1) + 150)],
        "full": [i * 37 for i in range(3000)],
        "bursts": [b * 5000 + rng.randint(0, 900) for b in range(60) for _ in range(rng.randint(1, 3 * burst))],
        "ties": [rng.choice((0, 400, 999, 1000, 1001, 2000)) + 3000 * rng.randint(0, 9) for _ in range(200)],
    }
    rows = [(k, t) for k, ts in times.items() for t in ts] + [(None, 5), ("steady", None)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "tenant_id string, ms long").repartition(5).select("tenant_id", F.timestamp_millis("ms").alias("timestamp"))
    got = L.rate_refusals(log, burst, 1.0).select("tenant_id", F.unix_millis("at").alias("ms"), "calls", "admitted", "refused").collect()
    for k, ts in times.items():
        assert {(r.ms, r.calls, r.admitted) for r in got if r.tenant_id == k} == refused_one_by_one(ts, burst, 1000), k
    assert all(r.tenant_id in times and r.refused == r.calls - r.admitted for r in got)


def test_busy_periods_of_a_key_that_never_pauses_are_apart(spark):
    # an attempt every 400 ms for an hour, with 20 bursts: periods are as short as the bursts
    times = [i * 400 for i in range(9000)] + [b * 180_000 + j for b in range(20) for j in range(30)]
    log = spark.createDataFrame([("t", t) for t in times], "tenant_id string, ms long").select("tenant_id", F.timestamp_millis("ms").alias("timestamp"))
    got = L.rate_refusals(log, 5, 1.0)
    assert {(r.ms, r.calls, r.admitted) for r in got.select(F.unix_millis("at").alias("ms"), "calls", "admitted").collect()} == refused_one_by_one(times, 5, 1000)
    assert L.rate_refusals(log.limit(0), 5, 1.0).count() == 0
