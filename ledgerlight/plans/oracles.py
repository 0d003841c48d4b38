"""The registered queries as plain SQL over the driver tables, for comparison."""

from __future__ import annotations

ORDERS = """
orders_x AS (
  SELECT *, CAST(o_totalprice AS DECIMAL(18,4)) AS amount FROM orders)"""

MONTHLY = ORDERS + """,
sums AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, SUM(amount) AS s FROM orders_x GROUP BY 1),
spine AS (
  SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS mo
  FROM (SELECT min(mo) AS lo, max(mo) AS hi FROM sums)),
months AS (
  SELECT last_day(spine.mo) AS period, CAST(COALESCE(s, 0) AS DOUBLE) AS total FROM spine LEFT JOIN sums USING (mo)),
series AS (
  SELECT period, total,
         (total - lag(total) OVER w) / NULLIF(lag(total) OVER w, 0) AS growth,
         avg(total) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma3
  FROM months WINDOW w AS (ORDER BY period))"""


def grouped_monthly(key: str) -> str:
    return ORDERS + f""",
sums AS (
  SELECT {key} AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, SUM(amount) AS s FROM orders_x GROUP BY 1, 2),
spine AS (
  SELECT k, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS mo
  FROM (SELECT k, min(mo) AS lo, max(mo) AS hi FROM sums GROUP BY k)),
months AS (
  SELECT k, last_day(mo) AS period, CAST(COALESCE(s, 0) AS DOUBLE) AS total FROM spine LEFT JOIN sums USING (k, mo)),
series AS (
  SELECT k, period, total,
         (total - lag(total) OVER w) / NULLIF(lag(total) OVER w, 0) AS growth,
         avg(total) OVER (PARTITION BY k ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma3
  FROM months WINDOW w AS (PARTITION BY k ORDER BY period))"""


SUMMARY = """
  count(*) AS period_count, round(sum(total), 4) AS total, round(avg(total), 4) AS mean,
  CAST(arg_min(period, (-total, period)) AS VARCHAR) AS peak_period,
  CAST(arg_min(period, (total, period)) AS VARCHAR) AS trough_period,
  round(avg(growth), 4) AS avg_mom, round(stddev_samp(growth), 4) AS std_mom,
  count(*) FILTER (growth > 0) AS positive_periods, count(*) FILTER (growth < 0) AS negative_periods,
  round(max(growth), 4) AS max_growth, round(min(growth), 4) AS max_decline,
  CASE WHEN count(*) < 2 THEN 'insufficient' WHEN arg_max(ma3, period) > arg_min(ma3, period) THEN 'up'
       ELSE 'down' END AS trend_direction,
  round(CASE WHEN count(*) < 2 OR arg_min(ma3, period) = 0 THEN 0.0
       ELSE abs(arg_max(ma3, period) - arg_min(ma3, period)) / abs(arg_min(ma3, period)) END, 4) AS trend_magnitude,
  round(CASE WHEN count(*) >= 12 AND arg_min(total, period) > 0 AND arg_max(total, period) > 0
       THEN pow(arg_max(total, period) / arg_min(total, period), 12.0 / count(*)) - 1 END, 4) AS cagr"""

FORECAST = """
  SELECT {key} count(*) AS n, max(period) AS last_period,
         regr_slope(total, x) AS slope, regr_intercept(total, x) AS intercept, regr_r2(total, x) AS r2
  FROM (SELECT *, row_number() OVER ({part} ORDER BY period) - 1 AS x FROM months) {group}"""

FORECAST_OUT = """
  n AS periods, round(slope, 2) AS slope, round(intercept, 2) AS intercept, round(r2, 2) AS r2,
  round(sigma, 2) AS sigma, CAST(last_day(last_period + INTERVAL 1 DAY) AS VARCHAR) AS next_period,
  round(slope * n + intercept, 2) AS next_forecast,
  round(slope * n + intercept - 1.28 * sigma, 2) AS low_80, round(slope * n + intercept + 1.28 * sigma, 2) AS high_80,
  round(slope * n + intercept - 1.96 * sigma, 2) AS low_95, round(slope * n + intercept + 1.96 * sigma, 2) AS high_95"""

GAPS = """
gaps AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS sales,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS category,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS note
  FROM orders),
filled AS (
  SELECT *, COALESCE(sales, (SELECT quantile_cont(sales, 0.5) FROM gaps)) AS f_sales,
         COALESCE(category, (SELECT category FROM gaps WHERE category IS NOT NULL GROUP BY category
                             ORDER BY count(*) DESC, category LIMIT 1)) AS f_category
  FROM gaps),
fence AS (
  SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM (SELECT quantile_cont(f_sales, 0.25) AS q1, quantile_cont(f_sales, 0.75) AS q3 FROM filled)),
copies AS (
  SELECT COALESCE(sum(c), 0) AS dup FROM (
    SELECT count(*) AS c FROM gaps GROUP BY o_orderkey, o_custkey, order_date, sales, category, note HAVING count(*) > 1)),
facts AS (
  SELECT count(*) AS n, count(*) - count(o_orderkey) AS n_key, count(*) - count(o_custkey) AS n_cust,
         count(*) - count(order_date) AS n_date,
         count(*) - count(sales) AS n_sales, count(*) - count(category) AS n_cat, count(*) - count(note) AS n_note,
         count(*) FILTER (f_sales < lo OR f_sales > hi) AS out_sales
  FROM filled, fence),
quality AS (
  SELECT greatest(0, least(100, 100
           - 10 * (CAST(round(n_date / n, 4) > 0.2 AS INT) + CAST(round(n_sales / n, 4) > 0.2 AS INT)
                 + CAST(round(n_cat / n, 4) > 0.2 AS INT) + CAST(round(n_note / n, 4) > 0.2 AS INT))
           - 5 * CAST(out_sales / n > 0.05 AS INT) - CAST(floor(dup / n * 50) AS INT))) AS score,
         n AS row_count, dup AS duplicate_rows,
         CAST(round(n_date / n, 4) > 0.2 AS INT) + CAST(round(n_sales / n, 4) > 0.2 AS INT)
         + CAST(round(n_cat / n, 4) > 0.2 AS INT) + CAST(round(n_note / n, 4) > 0.2 AS INT) AS high_null_columns,
         CAST(out_sales / n > 0.05 AS INT) AS high_outlier_columns
  FROM facts, copies)"""

ITEMS = """
items AS (
  SELECT r_name, p_brand, l_partkey, CAST(l_extendedprice AS DECIMAL(18,4)) AS amount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""


def totals(key: str) -> str:
    return ITEMS + f""",
totals AS (SELECT {key} AS item, SUM(amount) AS total FROM items GROUP BY 1),
ranked AS (
  SELECT item, total, row_number() OVER (ORDER BY total DESC, item) AS rn,
         SUM(total) OVER (ORDER BY total DESC, item ROWS UNBOUNDED PRECEDING) AS cum,
         SUM(total) OVER () AS whole, count(*) OVER () AS n,
         avg(CAST(total AS DOUBLE)) OVER () AS mean
  FROM totals)"""


def top_ranking(key: str) -> str:
    return f"""WITH {totals(key)}
SELECT 'top' AS side, rn AS rank, item, round(CAST(total AS DOUBLE), 4) AS total FROM ranked WHERE rn <= 10
UNION ALL
SELECT 'bottom', rn - greatest(n - 5, 0), item, round(CAST(total AS DOUBLE), 4) FROM ranked WHERE rn > n - 5"""


def concentration(key: str) -> str:
    share = "CAST(SUM(total) FILTER (rn <= {n}) AS DOUBLE) / CAST(any_value(whole) AS DOUBLE)"
    return f"""WITH {totals(key)},
agg AS (
  SELECT count(*) AS unique_items, CAST(any_value(whole) AS DOUBLE) AS total,
         {share.format(n=1)} AS cr1, {share.format(n=5)} AS cr5, {share.format(n=10)} AS cr10,
         SUM(pow(CAST(total AS DOUBLE) / CAST(whole AS DOUBLE), 2)) AS hhi,
         any_value(mean) AS mean_per_item, quantile_cont(CAST(total AS DOUBLE), 0.5) AS median_per_item,
         count(*) FILTER (CAST(total AS DOUBLE) > mean) / count(*) AS above_mean_rate
  FROM ranked)
SELECT unique_items, round(total, 6) AS total, round(cr1, 6) AS cr1, round(cr5, 6) AS cr5, round(cr10, 6) AS cr10,
       round(hhi, 6) AS hhi, round(mean_per_item, 6) AS mean_per_item, round(median_per_item, 6) AS median_per_item,
       round(above_mean_rate, 6) AS above_mean_rate,
       CASE WHEN cr5 > 0.7 THEN 'high' WHEN cr5 > 0.4 THEN 'medium' ELSE 'low' END AS band
FROM agg"""


ABC = """,
abc AS (
  SELECT item, CAST(total AS DOUBLE) AS total, CAST(cum AS DOUBLE) / CAST(whole AS DOUBLE) AS cum_share,
         CAST(total AS DOUBLE) / CAST(whole AS DOUBLE) AS share FROM ranked),
classed AS (
  SELECT *, CASE WHEN cum_share <= 0.7 THEN 'A' WHEN cum_share <= 0.9 THEN 'B' ELSE 'C' END AS abc_class FROM abc)"""

RFM_CORE = """
per AS ({per}),
vals AS (
  SELECT customer, frequency, monetary,
         CAST(floor((epoch_us((SELECT max(last) FROM per) + INTERVAL 1 DAY) - epoch_us(last)) / 86400000000.0) AS BIGINT) AS recency
  FROM per),
ranks AS (
  SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY recency, customer) AS rr,
         row_number() OVER (ORDER BY frequency, customer) AS rf,
         row_number() OVER (ORDER BY monetary, customer) AS rm
  FROM vals),
scores AS (
  SELECT customer, recency, frequency, monetary,
         CAST(6 - greatest(1, (5 * (rr - 1) + n - 2) // (n - 1)) AS INTEGER) AS r_score,
         CAST(greatest(1, (5 * (rf - 1) + n - 2) // (n - 1)) AS INTEGER) AS f_score,
         CAST(greatest(1, (5 * (rm - 1) + n - 2) // (n - 1)) AS INTEGER) AS m_score
  FROM ranks),
segs AS (
  SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'high_value'
                 WHEN r_score >= 3 AND f_score <= 3 AND m_score >= 3 THEN 'important_develop'
                 WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'important_retain'
                 WHEN r_score >= 3 AND f_score <= 3 AND m_score <= 3 THEN 'general'
                 WHEN r_score <= 2 AND f_score <= 2 THEN 'at_risk' ELSE 'general' END AS segment
  FROM scores)"""

RFM = ORDERS + "," + RFM_CORE.format(per="""
  SELECT o_custkey AS customer, max(o_orderdate) AS last, count(o_orderdate) AS frequency,
         CAST(SUM(amount) AS DOUBLE) AS monetary
  FROM orders_x GROUP BY 1""")

STATS = """
stats AS (
  SELECT l_orderkey, l_quantity, l_extendedprice, round(pow(l_extendedprice / 10000, 3.0), 2) AS cubed,
         l_extendedprice * 2 + l_quantity * 700 AS mixed,
         CASE WHEN l_orderkey % 9 <> 0 THEN l_discount END AS l_discount, CAST(1.0 AS DOUBLE) AS constant
  FROM lineitem)"""

STAT_COLUMNS = ["l_quantity", "l_extendedprice", "cubed", "mixed", "l_discount"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def fences(columns: list[str]) -> str:
    return ",\nfences AS (\n" + _union([
        f"""SELECT {i} AS pos, '{c}' AS col, lo, hi, (SELECT count(*) FROM stats WHERE {c} < lo OR {c} > hi) AS k,
         (SELECT count(*) FROM stats) AS n
  FROM (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM stats))"""
        for i, c in enumerate(columns)
    ]) + ")"


def pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def pearson(columns: list[str]) -> str:
    return _union([
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n,
       CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END AS r
  FROM stats WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
        for a, b in pairs(columns)
    ])


def spearman(columns: list[str]) -> str:
    return _union([
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, corr(ra, rb) AS rho FROM (
    SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra,
           rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb
    FROM stats WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in pairs(columns)
    ])


def labelled_pairs(where: str) -> str:
    return f"""WITH {STATS}, p AS ({pearson(STAT_COLUMNS)}), s AS ({spearman(STAT_COLUMNS)})
SELECT col_a, col_b, round(r, 6) AS pearson_r, round(rho, 6) AS spearman_rho,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS type
FROM p JOIN s USING (col_a, col_b) WHERE {where}"""


def moments(columns: list[str]) -> str:
    return _union([
        f"""SELECT '{c}' AS "column", count({c}) AS n,
       avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) AS skewness,
       avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3 AS kurtosis
  FROM stats, (SELECT avg({c}) AS m FROM stats)"""
        for c in columns
    ])


def numeric_profile(source: str, column: str) -> str:
    v = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", count({v}) AS count, min({v}) AS min, max({v}) AS max, avg({v}) AS mean,
       quantile_cont({v}, 0.5) AS median, stddev_samp({v}) AS std, quantile_cont({v}, 0.25) AS q1,
       quantile_cont({v}, 0.75) AS q3, count(*) FILTER ({v} = 0) / count({v}) AS zero_rate,
       CASE WHEN count({v}) > 3 THEN avg(pow({v} - m, 3)) / pow(avg(pow({v} - m, 2)), 1.5) END AS skew
  FROM {source}, (SELECT avg({v}) AS m FROM {source})"""


P_VALUE_STEPS = 4000

USAGE = """
price(model, p_in, p_out) AS (VALUES
  ('claude-opus-4-8', 15.0, 75.0), ('claude-sonnet-4-6', 3.0, 15.0), ('claude-haiku-4-5', 0.8, 4.0),
  ('gpt-4o', 2.5, 10.0), ('deepseek-v3', 0.27, 1.1)),
raw AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", 'tenant_' || (user_id % 3) AS tenant_id,
         CAST(user_id AS VARCHAR) AS user_id, 'user_' || (user_id % 50) AS user_name, event_type AS depth,
         ['claude-opus-4-8', 'claude-sonnet-4-6', 'claude-haiku-4-5', 'gpt-4o', 'deepseek-v3', 'unlisted'][event_id % 6 + 1] AS model,
         event_id % 50000 AS token_input, event_id * 7 % 20000 AS token_output,
         round(value, 1) AS elapsed_seconds, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status
  FROM events),
log AS (
  SELECT raw.*, substr("timestamp", 1, 10) AS date, substr("timestamp", 1, 7) AS month,
         CAST(round((CAST(token_input AS DECIMAL(12,0)) * CAST(COALESCE(p_in, 3.0) AS DECIMAL(12,6))
             + CAST(token_output AS DECIMAL(12,0)) * CAST(COALESCE(p_out, 15.0) AS DECIMAL(12,6)))
             * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DOUBLE) AS cost_usd,
         token_input + token_output AS tokens
  FROM raw LEFT JOIN price USING (model)),
who AS (SELECT DISTINCT user_id AS u FROM events),
members AS (
  SELECT 'tenant_' || (u % 3) AS tenant_id, CAST(u AS VARCHAR) AS user_id, 'user_' || (u % 50) AS user_name,
         CASE WHEN u % 5 = 0 THEN 'admin' WHEN u % 5 < 3 THEN 'analyst' ELSE 'viewer' END AS role,
         CAST(u % 4 + 2 AS INTEGER) AS daily_limit
  FROM who),
budgets AS (SELECT tenant_id, count(*) * 10.0 AS monthly_budget FROM members GROUP BY 1),
monthly AS (
  SELECT tenant_id, month, count(*) AS total_calls, CAST(sum(tokens) AS BIGINT) AS total_tokens,
         CAST(round(sum(CAST(cost_usd AS DECIMAL(18,6))), 4) AS DOUBLE) AS total_cost_usd,
         round(CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE) / count(*), 4) AS avg_cost_per_call,
         round(CAST(sum(CAST(elapsed_seconds AS DECIMAL(18,4))) AS DOUBLE) / count(*), 1) AS avg_elapsed_seconds
  FROM log GROUP BY 1, 2)"""

DAILY = f"""WITH {USAGE}
SELECT tenant_id, date, count(*) AS total_calls, count(*) FILTER (status = 'success') AS success_calls,
       count(*) FILTER (status <> 'success') AS error_calls, CAST(sum(tokens) AS BIGINT) AS total_tokens,
       CAST(round(sum(CAST(cost_usd AS DECIMAL(18,6))), 4) AS DOUBLE) AS total_cost_usd
FROM log GROUP BY 1, 2"""


def oracles() -> dict[str, str]:
    gap_columns = {"o_orderkey": "bigint", "o_custkey": "bigint", "order_date": "string", "sales": "double",
                   "category": "string", "note": "string"}
    line_numbers = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]
    date_share = "(SELECT count(*) FILTER (order_date <> 'unknown') > count(*) * 0.5 FROM gaps)"
    return {
        # series
        "monthly_series": f"WITH {MONTHLY} SELECT CAST(period AS VARCHAR) AS period, round(total, 4) AS total FROM series",
        "monthly_series_by_customer": f"""WITH {grouped_monthly('o_custkey')}
SELECT k AS o_custkey, CAST(period AS VARCHAR) AS period, round(total, 4) AS total FROM months""",
        "mom_growth": f"""WITH {MONTHLY}
SELECT CAST(period AS VARCHAR) AS period, round(total, 4) AS total, round(growth, 4) AS growth FROM series""",
        "moving_avg_3": f"""WITH {MONTHLY}
SELECT CAST(period AS VARCHAR) AS period, round(total, 4) AS total, round(ma3, 4) AS ma3 FROM series""",
        "inflection_points": f"""WITH {MONTHLY},
g AS (SELECT *, lag(growth) OVER (ORDER BY period) AS prev FROM series)
SELECT CAST(period AS VARCHAR) AS period, round(growth, 4) AS growth,
       CASE WHEN growth > 0 THEN 'up' ELSE 'down' END AS direction
FROM g WHERE growth * prev < 0""",
        "time_series": f"WITH {MONTHLY} SELECT {SUMMARY} FROM series",
        "time_series_by_status": f"""WITH {grouped_monthly('o_orderstatus')}
SELECT k AS o_orderstatus, {SUMMARY} FROM series GROUP BY k""",
        "annual_summary": f"""WITH {MONTHLY}, n AS (SELECT count(*) AS n FROM series)
SELECT 'year' AS kind, CAST(year(period) AS VARCHAR) AS label, round(sum(total), 4) AS total,
       CAST(NULL AS DOUBLE) AS ma3, CAST(NULL AS DOUBLE) AS growth
FROM series, n WHERE n > 24 GROUP BY year(period)
UNION ALL
SELECT 'month', CAST(period AS VARCHAR), round(total, 4), round(ma3, 4), round(growth, 4)
FROM (SELECT *, row_number() OVER (ORDER BY period DESC) AS rn FROM series), n WHERE n > 24 AND rn <= 12""",
        "yoy_comparison": f"""WITH {MONTHLY}, y AS (SELECT period, total, lag(total, 12) OVER (ORDER BY period) AS prior FROM months)
SELECT CAST(period AS VARCHAR) AS period, round(total, 4) AS total, round(prior, 4) AS prior,
       round((total - prior) / prior, 4) AS yoy
FROM y WHERE prior <> 0""",
        "yoy_summary": f"""WITH {MONTHLY}, y AS (SELECT total, lag(total, 12) OVER (ORDER BY period) AS prior FROM months),
g AS (SELECT round((total - prior) / prior, 4) AS v FROM y WHERE prior <> 0)
SELECT round(avg(v), 4) AS avg_yoy, count(*) AS comparable_periods, count(*) FILTER (v > 0) AS positive_yoy,
       count(*) FILTER (v < 0) AS negative_yoy FROM g""",
        "simple_forecast": f"""WITH {MONTHLY}, fit AS ({FORECAST.format(key='', part='', group='')}),
fs AS (SELECT fit.*, (SELECT stddev_pop(total - (slope * x + intercept)) FROM (
  SELECT total, row_number() OVER (ORDER BY period) - 1 AS x FROM months)) AS sigma FROM fit WHERE n >= 12)
SELECT {FORECAST_OUT} FROM fs""",
        "simple_forecast_by_priority": f"""WITH {grouped_monthly('o_orderpriority')},
fit AS ({FORECAST.format(key='k,', part='PARTITION BY k', group='GROUP BY k')}),
res AS (SELECT m.k, stddev_pop(m.total - (slope * x + intercept)) AS sigma
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period) - 1 AS x FROM months) m JOIN fit USING (k) GROUP BY m.k)
SELECT k AS o_orderpriority, {FORECAST_OUT} FROM fit JOIN res USING (k) WHERE n >= 12""",
        "forecast_fitted": f"""WITH {MONTHLY}, x AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS x FROM months),
f AS (SELECT regr_slope(total, x) AS slope, regr_intercept(total, x) AS intercept FROM x)
SELECT CAST(period AS VARCHAR) AS period, round(total, 2) AS total, round(slope * x + intercept, 2) AS fitted FROM x, f""",
        "date_range_filter": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate,
  round(o_totalprice, 4) AS o_totalprice
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""",
        "coerce_date": f"""WITH {GAPS}
SELECT o_orderkey, strftime(TRY_CAST(order_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS order_date FROM gaps""",
        "drop_null_keys": f"""WITH {GAPS}
SELECT o_orderkey, o_custkey, order_date, round(sales, 4) AS sales, category, note
FROM gaps WHERE sales IS NOT NULL AND category IS NOT NULL""",
        # rankings and groups
        "top_ranking": top_ranking("l_partkey"),
        "top_ranking_brand": top_ranking("p_brand"),
        "concentration": concentration("p_brand"),
        "concentration_parts": concentration("l_partkey"),
        "pareto_abc": f"""WITH {totals('l_partkey')}{ABC}
SELECT item, round(total, 8) AS total, round(cum_share, 8) AS cum_share, round(share, 8) AS share, abc_class FROM classed""",
        "pareto_summary": f"""WITH {totals('p_brand')}{ABC}
SELECT c AS abc_class, count(item) AS items, round(COALESCE(sum(share), 0.0), 6) AS revenue_share
FROM (VALUES ('A'), ('B'), ('C')) v(c) LEFT JOIN classed ON abc_class = c GROUP BY c""",
        "region_analysis": f"""WITH {ITEMS}, g AS (
  SELECT r_name AS region, sum(amount) AS s, count(amount) AS n FROM items GROUP BY 1)
SELECT region, round(CAST(s AS DOUBLE), 4) AS total,
       round(CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 4) AS share,
       round(CAST(s AS DOUBLE) / n, 4) AS mean, n AS count FROM g""",
        "region_extremes": f"""WITH {ITEMS}, g AS (SELECT r_name AS region, CAST(sum(amount) AS DOUBLE) AS s FROM items GROUP BY 1)
SELECT count(*) AS region_count, round(sum(s), 4) AS total,
       (SELECT region FROM g ORDER BY s DESC, region LIMIT 1) AS top_region,
       (SELECT region FROM g ORDER BY s, region DESC LIMIT 1) AS bottom_region FROM g""",
        "drill_down": f"""WITH {ITEMS}, g AS (SELECT p_brand, r_name, sum(amount) AS s FROM items GROUP BY 1, 2)
SELECT p_brand, r_name, round(CAST(s AS DOUBLE), 6) AS total,
       round(CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 6) AS share FROM g""",
        "drill_down_cube": f"""WITH {ITEMS}
SELECT CASE WHEN GROUPING(p_brand) = 1 THEN '(all)' ELSE p_brand END AS p_brand,
  CASE WHEN GROUPING(r_name) = 1 THEN '(all)' ELSE r_name END AS r_name, CAST(GROUPING(p_brand, r_name) AS BIGINT) AS grouping_id,
  CAST(2 - GROUPING(p_brand) - GROUPING(r_name) AS INTEGER) AS level, round(CAST(sum(amount) AS DOUBLE), 6) AS total,
  round(CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM items), 6) AS share
FROM items GROUP BY CUBE (items.p_brand, items.r_name)""",
        "drill_down_top": f"""WITH {ITEMS}, g AS (SELECT p_brand, r_name, sum(amount) AS s FROM items GROUP BY 1, 2)
SELECT p_brand, r_name, round(CAST(s AS DOUBLE), 6) AS total,
       round(CAST(s AS DOUBLE) / (SELECT CAST(sum(s) AS DOUBLE) FROM g), 6) AS share
FROM g ORDER BY s DESC, p_brand, r_name LIMIT 3""",
        # customers
        "rfm_values": f"WITH {RFM} SELECT customer, recency, frequency, round(monetary, 4) AS monetary FROM vals",
        "rfm_scores": f"""WITH {RFM}
SELECT customer, recency, frequency, round(monetary, 4) AS monetary, r_score, f_score, m_score,
       r_score + f_score + m_score AS rfm_total FROM scores""",
        "rfm_segments": f"WITH {RFM} SELECT customer, segment FROM segs",
        "rfm_summary": f"""WITH {RFM}
SELECT segment, count(*) AS customers, round(sum(monetary), 4) AS revenue, round(avg(recency), 4) AS r_mean,
       round(avg(frequency), 4) AS f_mean, round(avg(monetary), 4) AS m_mean,
       round(sum(monetary) / (SELECT sum(monetary) FROM segs), 4) AS revenue_share
FROM segs GROUP BY segment""",
        "rfm_overview": f"""WITH {RFM}
SELECT count(*) AS total_customers, round(avg(recency), 4) AS r_mean, round(avg(frequency), 4) AS f_mean,
       round(avg(monetary), 4) AS m_mean FROM vals""",
        # statistics
        "anomaly_detect": f"""WITH {STATS}{fences(STAT_COLUMNS)}
SELECT col AS "column", round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, k AS outlier_count,
       round(k / n, 6) AS outlier_rate FROM fences""",
        "anomaly_summary": f"""WITH {STATS}{fences(STAT_COLUMNS)}
SELECT CAST(sum(k) AS BIGINT) AS total_anomalies, count(*) AS columns_analyzed,
       (SELECT col FROM fences ORDER BY k / n DESC, pos LIMIT 1) AS worst_column FROM fences""",
        "corr_pearson": f"""WITH {STATS}, p AS ({pearson([*STAT_COLUMNS, 'constant'])})
SELECT col_a, col_b, n, round(r, 6) AS r FROM p""",
        "corr_spearman": f"""WITH {STATS}, s AS ({spearman(STAT_COLUMNS)})
SELECT col_a, col_b, n, round(rho, 6) AS rho FROM s""",
        # Student's t tail by Simpson's rule on the angle, t = sqrt(v) tan(a)
        "corr_p_values": f"""WITH {STATS}, p AS ({pearson(STAT_COLUMNS)}),
t AS (SELECT *, n - 2 AS v, atan(abs(r) / sqrt(1 - r * r)) AS top FROM p WHERE n >= 3),
steps AS (SELECT unnest(range(0, {P_VALUE_STEPS} + 1)) AS i),
cut AS (SELECT *, least(top, 60 / sqrt(v)) AS upto FROM t),
area AS (SELECT col_a, col_b, n, r, v, sum(
    CASE WHEN i = 0 OR i = {P_VALUE_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp((v - 1) * ln(cos(upto * i / {P_VALUE_STEPS})))) * any_value(upto) / {P_VALUE_STEPS} / 3 AS s
  FROM cut, steps GROUP BY col_a, col_b, n, r, v)
SELECT col_a, col_b, n, round(r, 5) AS r,
       round(abs(1 - 2 * s * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi())), 5) AS p_value FROM area""",
        "strong_pairs": labelled_pairs("abs(r) > 0.7 AND abs(r) <= 0.95"),
        "redundant_pairs": labelled_pairs("abs(r) > 0.95"),
        "distribution": f"""WITH {STATS}, m AS ({moments(STAT_COLUMNS)}),
x AS (SELECT "column", n, round(skewness, 4) AS s, round(kurtosis, 4) AS k FROM m)
SELECT "column", n, s AS skewness, k AS kurtosis,
       CASE WHEN abs(s) < 0.5 AND abs(k) < 1 THEN 'near_normal' WHEN s > 1 THEN 'heavy_right'
            WHEN s < -1 THEN 'heavy_left' WHEN s > 0.5 THEN 'mild_right' WHEN s < -0.5 THEN 'mild_left'
            WHEN k > 1 THEN 'heavy_tailed' ELSE 'near_normal' END AS shape FROM x""",
        "normality_test": f"""WITH {STATS}, m AS ({moments(STAT_COLUMNS)}),
j AS (SELECT *, n / 6 * (pow(skewness, 2) + pow(kurtosis, 2) / 4) AS jb FROM m)
SELECT "column", n, round(skewness, 4) AS skewness, round(kurtosis, 4) AS kurtosis, round(jb, 1) AS jb,
       round(exp(-jb / 2), 4) AS p_value, exp(-jb / 2) > 0.05 AS is_normal FROM j""",
        # profiles
        "profile_columns": f"WITH {GAPS}\n" + _union([
            f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) / count(*), 4) AS null_rate, count(DISTINCT {c}) AS unique_count FROM gaps"""
            for c, t in gap_columns.items()]),
        "profile_numeric": f"WITH {GAPS}, p AS (" + _union(
            [numeric_profile("gaps", c) for c in ("o_orderkey", "o_custkey", "sales")]) + """)
SELECT "column", count, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(median, 4) AS median,
       round(std, 4) AS std, round(q1, 4) AS q1, round(q3, 4) AS q3, round(zero_rate, 4) AS zero_rate,
       round(skew, 4) AS skew FROM p""",
        "profile_dates": f"WITH {GAPS}, p AS (" + _union([
            f"""SELECT '{name}' AS "column", count(t) AS valid, min(t) AS lo, max(t) AS hi,
    count(DISTINCT CAST(t AS DATE)) AS days FROM (SELECT TRY_CAST(order_date AS TIMESTAMP) AS t FROM gaps)"""
            for name in ("order_date", "ordered_at")]) + """)
SELECT "column", valid, strftime(lo, '%Y-%m-%d %H:%M:%S.%f') AS "first", strftime(hi, '%Y-%m-%d %H:%M:%S.%f') AS "last",
       (epoch_us(hi) - epoch_us(lo)) // 86400000000 AS time_span_days, days AS distinct_days,
       days >= ((epoch_us(hi) - epoch_us(lo)) // 86400000000 + 1) * 0.9 AS is_continuous FROM p""",
        "profile_text": "WITH p AS (" + _union([
            f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS count,
    (SELECT avg(length({c})) FROM part) AS avg_length,
    row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn FROM part WHERE {c} IS NOT NULL GROUP BY {c}"""
            for c in ("p_name", "p_brand", "p_type")]) + """)
SELECT "column", round(avg_length, 4) AS avg_length, value, count FROM p WHERE rn <= 5""",
        "desc_overview": f"""WITH {GAPS}
SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS col_count, CAST(3 AS BIGINT) AS numeric_col_count,
       round((6 * count(*) - count(o_orderkey) - count(o_custkey) - count(order_date) - count(sales) - count(category)
              - count(note)) / (6 * count(*)), 4) AS overall_null_rate FROM gaps""",
        "desc_stats": "WITH p AS (" + _union([numeric_profile("lineitem", c) for c in line_numbers]) + """)
SELECT "column", count, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(q1, 4) AS p25,
       round(median, 4) AS p50, round(q3, 4) AS p75, round(max, 4) AS max FROM p""",
        "sample_rows": """SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice
FROM orders ORDER BY o_orderkey LIMIT 3""",
        "sample_values": f"""WITH {GAPS}
SELECT category AS value FROM (SELECT category, o_orderkey FROM gaps WHERE category IS NOT NULL ORDER BY o_orderkey LIMIT 5)""",
        "quick_summary_samples": f"""WITH {GAPS}
SELECT (SELECT count(*) FROM gaps) AS row_count, CAST(row_number() OVER (ORDER BY o_orderkey DESC) AS INTEGER) AS place, o_orderkey, order_date, category
FROM gaps ORDER BY o_orderkey DESC LIMIT 3""",
        "quick_summary": f"""WITH {GAPS}
SELECT row_count, 6 AS col_count, 'o_orderkey,o_custkey,order_date,sales,category,note' AS column_names,
       CAST(score AS INTEGER) AS quality_score, TRUE AS has_date, TRUE AS has_numeric, 1 AS numeric_columns FROM quality""",
        # the name decides unless the values have to; column d1 holds mostly dates, shipped too
        "infer_roles": f"WITH {GAPS}\n" + _union([
            """SELECT 'o_orderkey' AS "column", 'metric' AS role, CAST(0.5 AS DOUBLE) AS confidence""",
            "SELECT 'o_custkey', 'metric', 0.5", "SELECT 'sales', 'revenue', 0.85", "SELECT 'category', 'category', 0.85",
            "SELECT 'note', 'ignore', 0.3",
            f"SELECT 'd1', CASE WHEN {date_share} THEN 'date' ELSE 'ignore' END, CASE WHEN {date_share} THEN 0.7 ELSE 0.3 END",
            f"SELECT 'shipped', CASE WHEN {date_share} THEN 'date' ELSE 'ignore' END, CASE WHEN {date_share} THEN 0.7 ELSE 0.3 END",
        ]),
        "role_ambiguity": f"WITH {GAPS}\n" + _union([
            """SELECT 'o_orderkey' AS "column", 'metric' AS role, CAST(0.5 AS DOUBLE) AS confidence""",
            "SELECT 'o_custkey', 'metric', 0.5", "SELECT 'note', 'ignore', 0.3",
            f"SELECT 'shipped', 'ignore', 0.3 WHERE NOT {date_share}",
        ]),
        # cleaning
        "find_duplicates": """WITH c AS (
  SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority HAVING count(*) > 1)
SELECT CAST(COALESCE(sum(n), 0) AS BIGINT) AS duplicate_rows, count(*) AS duplicate_groups FROM c""",
        "mark_duplicates": """SELECT o_custkey, o_orderstatus, o_orderpriority,
  count(*) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority) > 1 AS is_duplicate FROM orders""",
        "fill_median": f"WITH {GAPS} SELECT o_orderkey, round(f_sales, 4) AS sales FROM filled",
        "fill_mode": f"WITH {GAPS} SELECT o_orderkey, f_category AS category FROM filled",
        "mark_outliers": f"""WITH {STATS}{fences(['cubed', 'l_quantity'])},
b AS (SELECT max(lo) FILTER (col = 'cubed') AS lo1, max(hi) FILTER (col = 'cubed') AS hi1,
             max(lo) FILTER (col = 'l_quantity') AS lo2, max(hi) FILTER (col = 'l_quantity') AS hi2 FROM fences)
SELECT cubed < lo1 OR cubed > hi1 AS cubed_outlier, l_quantity < lo2 OR l_quantity > hi2 AS l_quantity_outlier,
       count(*) AS rows, round(max(cubed), 4) AS max_cubed, round(min(cubed), 4) AS min_cubed
FROM stats, b GROUP BY 1, 2""",
        "clean": f"""WITH {GAPS}
SELECT o_orderkey, o_custkey, strftime(TRY_CAST(order_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS order_date,
       round(f_sales, 4) AS sales, f_category AS category, note FROM filled""",
        "cleaning_log": f"""WITH {GAPS}
SELECT "column", action, CAST(k AS BIGINT) AS affected_rows FROM (
  SELECT '__all__' AS "column", 'marked_duplicate' AS action, dup AS k FROM copies
  UNION ALL SELECT 'order_date', 'type_converted', n FROM facts
  UNION ALL SELECT 'order_date', 'unparsed_date', count(*) FROM gaps WHERE order_date = 'unknown'
  UNION ALL SELECT 'sales', 'filled_na', n_sales FROM facts
  UNION ALL SELECT 'sales', 'marked_outlier', out_sales FROM facts
  UNION ALL SELECT 'category', 'filled_na', n_cat FROM facts) WHERE k > 0""",
        "stored_profile": f"WITH {GAPS}\n" + _union([
            f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count,
  {f"CAST(min({c}) AS DOUBLE)" if number else "CAST(0 AS DOUBLE)"} AS min, {f"CAST(max({c}) AS DOUBLE)" if number else "CAST(0 AS DOUBLE)"} AS max,
  {f"round(avg({c}), 4)" if number else "CAST(0 AS DOUBLE)"} AS mean, {f"round(stddev_samp({c}), 4)" if number else "CAST(0 AS DOUBLE)"} AS std,
  TRUE AS unique_close, TRUE AS median_close FROM gaps"""
            for c, number in (("o_orderkey", True), ("o_custkey", True), ("order_date", False), ("sales", True), ("category", False), ("note", False))
        ]),
        "unparsed_dates": f"""WITH {GAPS}
SELECT 'order_date' AS "column", count(*) AS filled_rows, count(*) FILTER (order_date = 'unknown') AS unparsed_rows,
  round(CAST(count(*) FILTER (order_date = 'unknown') AS DOUBLE) / count(*), 4) AS unparsed_share
FROM gaps WHERE trim(order_date) <> ''""",
        "quality_score": f"""WITH {GAPS}
SELECT CAST(score AS INTEGER) AS score, row_count, CAST(duplicate_rows AS BIGINT) AS duplicate_rows,
       CAST(high_null_columns AS BIGINT) AS high_null_columns, CAST(high_outlier_columns AS BIGINT) AS high_outlier_columns
FROM quality""",
        # reports
        "insights": f"""WITH {MONTHLY}, {GAPS},
{totals('p_brand')}{ABC},
regions AS (SELECT CAST(sum(amount) AS DOUBLE) AS s FROM items GROUP BY r_name),
ends AS (SELECT count(*) AS n, arg_min(round(total, 2), period) AS f, arg_max(round(total, 2), period) AS l FROM months),
chg AS (SELECT n, COALESCE((l - f) / NULLIF(f, 0), 0) AS c FROM ends),
top5 AS (SELECT (SELECT sum(s) FROM (SELECT s FROM regions ORDER BY s DESC LIMIT 5)) / (SELECT sum(s) FROM regions) AS cr5),
tail AS (SELECT count(*) AS items FROM classed WHERE abc_class = 'C'),
found AS (
  SELECT 1 AS o, 'info' AS severity, 'The table has ' || count(*) || ' records' AS title FROM orders
  UNION ALL SELECT 2, CASE WHEN abs(c) < 0.3 THEN 'info' ELSE 'warning' END,
    'Overall trend ' || CASE WHEN c > 0 THEN 'up' ELSE 'down' END || ' by ' || printf('%.1f', abs(c) * 100) || '%'
    FROM chg WHERE n >= 2
  UNION ALL SELECT 3, 'warning', 'High concentration, top five hold ' || printf('%.0f', cr5 * 100) || '%' FROM top5 WHERE cr5 > 0.6
  UNION ALL SELECT 4, CASE WHEN score < 50 THEN 'critical' WHEN score < 70 THEN 'warning' ELSE 'info' END,
    CASE WHEN score < 70 THEN 'Low' ELSE 'Good' END || ' data quality, score ' || CAST(score AS INTEGER) FROM quality
  UNION ALL SELECT 5, CASE WHEN items > 20 THEN 'warning' ELSE 'info' END,
    'Long tail of ' || items || ' class C items' FROM tail WHERE items > 0)
SELECT printf('i%02d', row_number() OVER (ORDER BY o) - 1) AS id, severity, title FROM found""",
        "monthly_facts": f"""WITH {MONTHLY}
SELECT CAST(period AS VARCHAR) AS period, round(total, 4) AS total, round(growth, 4) AS growth
FROM series""",
        "region_facts": f"""WITH {ITEMS}, g AS (SELECT r_name AS region, sum(amount) AS s FROM items GROUP BY 1)
SELECT region, round(CAST(s AS DOUBLE), 4) AS total, round(CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 4) AS share
FROM g""",
        "report_suite": f"""WITH {GAPS}, t AS (SELECT f_category AS item, sum(f_sales) AS s FROM filled GROUP BY 1),
ranked AS (SELECT item, s, row_number() OVER (ORDER BY s DESC, item) AS up, row_number() OVER (ORDER BY s, item DESC) AS down FROM t),
abc AS (SELECT s / sum(s) OVER () AS share, sum(s) OVER (ORDER BY s DESC, item ROWS UNBOUNDED PRECEDING) / sum(s) OVER () AS cum FROM t),
timed AS (SELECT *, TRY_CAST(order_date AS TIMESTAMP) AS d FROM filled),
m AS (SELECT last_day(d) AS period, sum(f_sales) AS s FROM timed WHERE d IS NOT NULL GROUP BY 1),
spine AS (SELECT last_day(unnest(generate_series(date_trunc('month', min(period)), date_trunc('month', max(period)), INTERVAL 1 MONTH))) AS period FROM m),
months AS (SELECT spine.period, COALESCE(s, 0) AS s FROM spine LEFT JOIN m ON spine.period = m.period),
grown AS (SELECT period, s, (s - lag(s) OVER (ORDER BY period)) / NULLIF(lag(s) OVER (ORDER BY period), 0) AS growth,
                 lag(s, 12) OVER (ORDER BY period) AS before FROM months),
placed AS (SELECT *, COALESCE(note, (SELECT note FROM gaps WHERE note IS NOT NULL GROUP BY note ORDER BY count(*) DESC, note LIMIT 1)) AS f_note FROM filled),
regions AS (SELECT f_note AS region, sum(f_sales) AS s FROM placed GROUP BY 1),
outliers AS (SELECT count(*) AS n FROM filled, fence WHERE f_sales < lo OR f_sales > hi),
{RFM_CORE.format(per="""
  SELECT o_custkey AS customer, max(d) AS last, count(d) AS frequency, sum(f_sales) AS monetary
  FROM (SELECT *, TRY_CAST(order_date AS TIMESTAMP) AS d FROM filled) WHERE d IS NOT NULL AND f_sales IS NOT NULL
  GROUP BY 1""")},
every AS (
  SELECT 'desc_overview' AS analysis, 'row_count' AS label, CAST(count(*) AS DOUBLE) AS value FROM gaps
  UNION ALL SELECT 'desc_stats', 'o_orderkey', count(o_orderkey) FROM gaps
  UNION ALL SELECT 'desc_stats', 'o_custkey', count(o_custkey) FROM gaps
  UNION ALL SELECT 'desc_stats', 'sales', count(sales) FROM gaps
  UNION ALL SELECT 'time_series', 'total', sum(s) FROM months
  UNION ALL SELECT unnest(['monthly', 'forecast_fitted']), CAST(period AS VARCHAR), s FROM months
  UNION ALL SELECT 'growth', CAST(period AS VARCHAR), growth FROM grown
  UNION ALL SELECT 'yoy_comparison', 'comparable_periods', count(NULLIF(before, 0)) FROM grown
  UNION ALL SELECT 'top_ranking', 'top' || up || item, s FROM ranked WHERE up <= 10
  UNION ALL SELECT 'top_ranking', 'bottom' || (up - (SELECT count(*) FROM t) + least(5, (SELECT count(*) FROM t))) || item, s FROM ranked WHERE down <= 5
  UNION ALL SELECT 'concentration', 'cr5', (SELECT sum(s) FROM ranked WHERE up <= 5) / (SELECT sum(s) FROM t)
  UNION ALL SELECT 'pareto_abc', c, COALESCE(sum(share), 0) FROM (VALUES ('A'), ('B'), ('C')) v(c)
    LEFT JOIN abc ON c = CASE WHEN cum <= 0.7 THEN 'A' WHEN cum <= 0.9 THEN 'B' ELSE 'C' END GROUP BY c
  UNION ALL SELECT 'anomaly_detect', 'sales', n FROM outliers
  UNION ALL SELECT 'anomaly_summary', 'sales', n FROM outliers
  UNION ALL SELECT 'region_analysis', region, s FROM regions
  UNION ALL SELECT 'region_extremes', arg_max(region, s) || arg_min(region, s), sum(s) FROM regions
  UNION ALL SELECT 'drill_down', f_category || '/' || f_note, sum(f_sales) FROM placed GROUP BY f_category, f_note
  UNION ALL SELECT 'rfm_analysis', segment, count(*) FROM segs GROUP BY segment
  UNION ALL SELECT 'rfm_overview', 'customers', count(*) FROM segs
  UNION ALL SELECT 'simple_forecast', 'periods', count(*) FROM months
  UNION ALL SELECT 'distribution', 'sales', count(f_sales) FROM filled
  UNION ALL SELECT 'columns', v.c, v.n FROM (SELECT count(*) - count(o_orderkey) AS a, count(*) - count(o_custkey) AS b, count(*) - count(order_date) AS x,
    count(*) - count(sales) AS y, count(*) - count(category) AS z, count(*) - count(note) AS w FROM gaps) g,
    LATERAL (VALUES ('o_orderkey', a), ('o_custkey', b), ('order_date', x), ('sales', y), ('category', z), ('note', w)) v(c, n)
  UNION ALL SELECT 'roles', unnest(['order_datedate', 'salesrevenue', 'categoryproduct_name', 'noteregion', 'o_custkeycustomer_id']), 1
  UNION ALL SELECT 'quality', 'row_count', count(*) FROM gaps)
SELECT analysis, label, round(value, 2) AS value FROM every WHERE value IS NOT NULL""",
        "slim": f"""WITH {GAPS}, t AS (SELECT f_category AS item, sum(f_sales) AS s FROM filled GROUP BY 1),
c AS (SELECT s / sum(s) OVER () AS share, sum(s) OVER (ORDER BY s DESC, item ROWS UNBOUNDED PRECEDING) / sum(s) OVER () AS cum FROM t),
k AS (SELECT share, CASE WHEN cum <= 0.7 THEN 'A' WHEN cum <= 0.9 THEN 'B' ELSE 'C' END AS abc FROM c)
SELECT v.c AS abc_class, count(share) AS items, round(COALESCE(sum(share), 0.0), 4) AS revenue_share
FROM (VALUES ('A'), ('B'), ('C')) v(c) LEFT JOIN k ON abc = v.c GROUP BY v.c""",
        # usage log and tenants
        "usage_cost": f"""WITH {USAGE}
SELECT model, count(*) AS calls, round(CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE), 5) AS cost,
       round(max(cost_usd), 5) AS max_cost FROM log GROUP BY model""",
        "usage_daily": DAILY,
        "stream_usage_daily": DAILY,
        "usage_daily_by_depth": f"WITH {USAGE} SELECT tenant_id, date, depth, count(*) AS calls FROM log GROUP BY 1, 2, 3",
        "usage_daily_by_user": f"WITH {USAGE} SELECT tenant_id, date, user_name, count(*) AS calls FROM log GROUP BY 1, 2, 3",
        "usage_top_expensive": f"""WITH {USAGE}, r AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, date ORDER BY cost_usd DESC, "timestamp", user_id) AS rank FROM log)
SELECT tenant_id, date, rank, user_id, round(cost_usd, 6) AS cost_usd FROM r WHERE rank <= 3""",
        "usage_monthly": f"WITH {USAGE} SELECT * FROM monthly",
        "usage_calls_per_day": f"WITH {USAGE} SELECT tenant_id, month, date, count(*) AS calls FROM log GROUP BY 1, 2, 3",
        "usage_user_stats": f"""WITH {USAGE}
SELECT tenant_id, user_id, count(*) AS total_calls, CAST(sum(tokens) AS BIGINT) AS total_tokens,
       CAST(round(sum(CAST(cost_usd AS DECIMAL(18,6))), 4) AS DOUBLE) AS total_cost_usd
FROM log WHERE date >= '2024-01-23' GROUP BY 1, 2""",
        "usage_user_breakdown": f"""WITH {USAGE}
SELECT tenant_id, user_id, 'depth' AS kind, depth AS label, count(*) AS calls FROM log WHERE date >= '2024-01-23' GROUP BY ALL
UNION ALL
SELECT tenant_id, user_id, 'date', date, count(*) FROM log WHERE date >= '2024-01-23' GROUP BY ALL""",
        "budget_alert": f"""WITH {USAGE}
SELECT tenant_id, month, total_cost_usd, CAST(monthly_budget AS DOUBLE) AS monthly_budget,
       round(total_cost_usd / monthly_budget * 100, 4) AS percent, round(monthly_budget - total_cost_usd, 4) AS remaining
FROM monthly JOIN budgets USING (tenant_id) WHERE total_cost_usd > monthly_budget * 0.8""",
        "member_usage": f"""WITH {USAGE},
today AS (SELECT tenant_id, user_id, count(*) AS today FROM log WHERE date = '2024-01-15' GROUP BY 1, 2),
team AS (SELECT tenant_id, CAST(sum(today) AS BIGINT) AS team_today FROM today GROUP BY 1)
SELECT m.tenant_id, m.user_id, user_name, role, COALESCE(today, 0) AS today, daily_limit,
       COALESCE(team_today, 0) AS team_today, COALESCE(total_cost_usd, 0.0) AS month_cost_usd,
       CAST(monthly_budget AS DOUBLE) AS monthly_budget,
       round(COALESCE(total_cost_usd / monthly_budget * 100, 0.0), 4) AS budget_pct
FROM members m LEFT JOIN today USING (tenant_id, user_id) LEFT JOIN team USING (tenant_id)
LEFT JOIN (SELECT * FROM monthly WHERE month = '2024-01') x USING (tenant_id) LEFT JOIN budgets USING (tenant_id)""",
        "depth_violations": f"""WITH {USAGE}
SELECT tenant_id, user_id, depth, count(*) AS calls, min("timestamp") AS first_at, max("timestamp") AS last_at, any_value(role) AS role
FROM log JOIN members USING (tenant_id, user_id)
WHERE (role = 'analyst' AND depth NOT IN ('click', 'purchase', 'view')) OR (role = 'viewer' AND depth <> 'view')
GROUP BY 1, 2, 3""",
        "quota_violations": f"""WITH {USAGE}, r AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id, date ORDER BY "timestamp", token_input, token_output) AS call_no FROM log)
SELECT tenant_id, user_id, date, "timestamp", call_no, daily_limit
FROM r JOIN members USING (tenant_id, user_id) WHERE call_no > daily_limit""",
        # one attempt after the other, as a gate sees them
        "rate_refusals": f"""WITH RECURSIVE {USAGE},
a AS (SELECT tenant_id, epoch_us(CAST("timestamp" AS TIMESTAMP)) AS us,
             row_number() OVER (PARTITION BY tenant_id ORDER BY "timestamp") AS rn FROM log),
gate AS (
  SELECT tenant_id, rn, us, [us] AS kept, TRUE AS admitted FROM a WHERE rn = 1
  UNION ALL
  SELECT tenant_id, rn, us, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END, len(live) < 3
  FROM (SELECT a.tenant_id, a.rn, a.us, list_filter(g.kept, lambda k: a.us - k < 900000000) AS live
        FROM gate g JOIN a ON a.tenant_id = g.tenant_id AND a.rn = g.rn + 1))
SELECT tenant_id, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS at, count(*) AS calls,
  count(*) FILTER (admitted) AS admitted, count(*) FILTER (NOT admitted) AS refused
FROM gate GROUP BY tenant_id, us HAVING count(*) FILTER (NOT admitted) > 0""",
        "rate_violations": f"""WITH {USAGE},
m AS (SELECT tenant_id, epoch_us(CAST("timestamp" AS TIMESTAMP)) AS us, count(*) AS calls FROM log GROUP BY 1, 2),
w AS (SELECT *, sum(calls) OVER (PARTITION BY tenant_id ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) AS attempts FROM m)
SELECT tenant_id, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS at, calls, CAST(attempts AS BIGINT) AS attempts
FROM w WHERE attempts > 3""",
        "read_usage_log": f"""WITH {USAGE}
SELECT user_id, count(*) AS calls, CAST(sum(token_input) AS BIGINT) AS tokens,
       round(CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE), 6) AS cost
FROM log WHERE tenant_id = 'tenant_1' AND date >= '2024-01-20' GROUP BY 1""",
        "append_usage_log": f"""WITH {USAGE}
SELECT tenant_id, model, count(*) AS calls, round(CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE), 6) AS cost
FROM log WHERE tenant_id = 'tenant_2' AND month = '2024-01' GROUP BY 1, 2""",
        # files
        "read_delimited": """SELECT o_orderpriority, o_orderstatus, count(*) AS orders,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 4) AS total,
  strftime(max(o_orderdate), '%Y-%m-%d') AS last_date, CAST(sum(o_custkey) AS BIGINT) AS custkeys
FROM orders GROUP BY 1, 2""",
        "read_delimited_breaks": """SELECT doc_id, length('"' || lang || '", ' || text) AS length, md5('"' || lang || '", ' || text) AS text_md5, source
FROM documents""",
        # the files are written with commas, in UTF-8
        "detect_delimiter": """SELECT doc_id % 4 AS kind, [',', chr(9), ';', '|'][doc_id % 4 + 1] AS delimiter, 1.0::DOUBLE AS score
FROM documents GROUP BY ALL""",
        "file_magic_audit": """SELECT doc_id % 4 AS kind_no, ['text', 'pdf', 'windows_executable', 'zip'][doc_id % 4 + 1] AS kind,
  doc_id % 4 = 0 AS accepted FROM documents GROUP BY ALL""",
        "detect_encoding": "SELECT DISTINCT 'utf-8' AS encoding FROM documents",
        # each file's charset is the one that it was written with
        "detect_encoding_model": """SELECT DISTINCT w AS written, doc_id % 16 AS bucket, w AS encoding
FROM documents, (VALUES ('utf-8'), ('iso8859-1'), ('utf-16-le')) v(w)
WHERE doc_id % 2 = 0 AND regexp_matches(text, '[^\\x00-\\x7F]') AND NOT regexp_matches(text, '[^\\x00-\\x{FF}]')""",
        # one attempt after the other, as a gate sees them
        "stream_rate_limit": f"""WITH RECURSIVE {USAGE},
a AS (SELECT tenant_id, epoch_us(CAST("timestamp" AS TIMESTAMP)) AS us,
             row_number() OVER (PARTITION BY tenant_id ORDER BY "timestamp") AS rn FROM log),
gate AS (
  SELECT tenant_id, rn, [us] AS kept, TRUE AS admitted FROM a WHERE rn = 1
  UNION ALL
  SELECT tenant_id, rn, CASE WHEN len(live) < 2 THEN list_append(live, us) ELSE live END, len(live) < 2
  FROM (SELECT a.tenant_id, a.rn, a.us, list_filter(g.kept, lambda k: a.us - k < 600000000) AS live
        FROM gate g JOIN a ON a.tenant_id = g.tenant_id AND a.rn = g.rn + 1))
SELECT tenant_id, admitted, count(*) AS calls FROM gate GROUP BY 1, 2""",
        "detect_delimiter_text": """WITH l AS (
  SELECT doc_id, unnest(regexp_split_to_array(text,
    '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')) AS line FROM documents),
k AS (SELECT doc_id, pos, d, (length(line) - length(replace(line, d, ''))) AS n
  FROM l, (VALUES (0, ','), (1, chr(9)), (2, ';'), (3, '|')) v(pos, d) WHERE regexp_matches(line, '\\S')),
m AS (SELECT *, floor(median(n) OVER (PARTITION BY doc_id, pos)) AS med FROM k),
s AS (SELECT doc_id, pos, d, avg(CAST(n = med AS DOUBLE)) AS score FROM m WHERE med >= 1 GROUP BY 1, 2, 3 HAVING score > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM s)
SELECT documents.doc_id, COALESCE(d, ',') AS delimiter, round(COALESCE(score, 0.0), 6) AS score
FROM documents LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON documents.doc_id = b.doc_id""",
    }
