"""Registered queries: every operator on the driver tables.

Doubles are rounded here, and dates shown as text, so that results can be
compared with another engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import ledgerlight as L

from ..functions.exprs import money
from ..functions.ordering import settle, work_path
from ..streaming.sinks import drain_append, drain_update

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles and print dates."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "double":
            c = F.round(c, digits)
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("amount", money("o_totalprice"))


def orders_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with missing prices and priorities, and dates as text of which some are no dates."""
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderkey") % 11 == 0, "unknown")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("sales"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("category"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("note"),
    )


GAP_ROLES = {"order_date": "date", "sales": "revenue", "category": "category", "note": "ignore"}


def skewed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a cubed price, so that outliers exist, and missing discounts."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_quantity", "l_extendedprice",
        F.round(F.pow(F.col("l_extendedprice") / 10000, F.lit(3.0)), 2).alias("cubed"),
        (F.col("l_extendedprice") * 2 + F.col("l_quantity") * 700).alias("mixed"),
        F.when(F.col("l_orderkey") % 9 != 0, F.col("l_discount")).alias("l_discount"),
        F.lit(1.0).alias("constant"),
    )


STAT_COLUMNS = ["l_quantity", "l_extendedprice", "cubed", "mixed", "l_discount"]


def items_with_regions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate")
    su = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    re = table(spark, sf, "region").select("r_regionkey", "r_name")
    pa = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        li.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(na, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(re, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(pa, F.col("l_partkey") == F.col("p_partkey"))
        .select("r_name", "p_brand", "l_partkey", "l_shipdate", money("l_extendedprice").alias("amount"))
    )


MODELS = ("claude-opus-4-8", "claude-sonnet-4-6", "claude-haiku-4-5", "gpt-4o", "deepseek-v3", "unlisted")


def usage_log(spark: SparkSession, sf: str) -> DataFrame:
    """The event table read as a usage log of three tenants."""
    e = table(spark, sf, "events")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("event_id") % 6 + 1).cast("int"))
    log = e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("tenant_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("user_"), (F.col("user_id") % 50).cast("string")).alias("user_name"),
        F.col("event_type").alias("depth"),
        model.alias("model"),
        (F.col("event_id") % 50_000).alias("token_input"),
        (F.col("event_id") * 7 % 20_000).alias("token_output"),
        F.lit(0.0).alias("cost_usd"),
        F.round("value", 1).alias("elapsed_seconds"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )
    return L.usage_cost(log)


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Every user of the event table with a role, limit and permissions by rule."""
    who = table(spark, sf, "events").select("user_id").distinct()
    role = F.when(F.col("user_id") % 5 == 0, "admin").when(F.col("user_id") % 5 < 3, "analyst").otherwise("viewer")
    depths = {"admin": ["signup", "error", "click", "purchase", "view"], "analyst": ["click", "purchase", "view"],
              "viewer": ["view"]}
    allowed = F.create_map(*[x for r, ds in depths.items() for x in (F.lit(r), F.array(*[F.lit(d) for d in ds]))])
    return who.select(
        F.concat(F.lit("tenant_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("user_"), (F.col("user_id") % 50).cast("string")).alias("user_name"),
        role.alias("role"),
        (F.col("user_id") % 4 + 2).cast("int").alias("daily_limit"),
        allowed[role].alias("allowed_depths"),
    )


def budgets(spark: SparkSession, sf: str) -> DataFrame:
    """A budget per tenant that grows with its number of users."""
    return members(spark, sf).groupBy("tenant_id").agg((F.count("*") * 10.0).alias("monthly_budget"))


def _facts_year(spark: SparkSession, sf: str) -> DataFrame:
    return L.date_range_filter(orders(spark, sf), "o_orderdate", "1996-01-01", "1996-12-31")


def _of_orders(op: Callable[..., DataFrame], *args, digits: int = 4, **kw) -> Query:
    return lambda s, d: tidy(op(orders(s, d), *args, **kw), digits)


def _of_items(op: Callable[..., DataFrame], *args, digits: int = 4, **kw) -> Query:
    return lambda s, d: tidy(op(items_with_regions(s, d), *args, **kw), digits)


def _of_stats(op: Callable[..., DataFrame], *args, digits: int = 4, **kw) -> Query:
    return lambda s, d: tidy(op(skewed_items(s, d), *args, **kw), digits)


def _of_gaps(op: Callable[..., DataFrame], *args, digits: int = 4, **kw) -> Query:
    return lambda s, d: tidy(op(orders_with_gaps(s, d), *args, **kw), digits)


def _of_log(op: Callable[..., DataFrame], *args, digits: int = 4, **kw) -> Query:
    return lambda s, d: tidy(op(usage_log(s, d), *args, **kw), digits)


def _profile_text(s: SparkSession, d: str) -> DataFrame:
    p = L.profile_text(table(s, d, "part").select("p_name", "p_brand", "p_type"))
    return tidy(p.select("column", "avg_length", F.inline("top_values")), 4)


def _infer_roles(s: SparkSession, d: str) -> DataFrame:
    o = orders_with_gaps(s, d).withColumn("shipped", F.col("order_date"))
    return L.infer_roles(o.withColumnRenamed("order_date", "d1")).select("column", "role", "confidence")


def _role_ambiguity(s: SparkSession, d: str) -> DataFrame:
    o = orders_with_gaps(s, d).withColumn("shipped", F.col("order_date"))
    return L.role_ambiguity(L.infer_roles(o)).select("column", "role", "confidence")


def _quick_summary(s: SparkSession, d: str) -> DataFrame:
    q = L.quick_summary(orders_with_gaps(s, d), GAP_ROLES)
    return q.withColumn("column_names", F.array_join("column_names", ","))


def _stored_profile(s: SparkSession, d: str) -> DataFrame:
    """Orders by year, profiled in two steps; the second step adds the years from 1998 on."""
    path, store = work_path(s, "by-year"), work_path(s, "profile")
    rows = orders_with_gaps(s, d).join(table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), "o_orderkey")
    rows.write.partitionBy("year").parquet(path)
    L.update_profile(s.read.parquet(path).filter("year < 1998"), store, "year")
    L.update_profile(s.read.parquet(path), store, "year")
    found = L.stored_profile(s, store)
    exact = L.profile_columns(rows.drop("year")).select("column", F.col("unique_count").alias("exact"))
    median = found.filter("column = 'sales'").first()["median"]
    below = rows.agg(F.avg((F.col("sales") <= median).cast("double"))).first()[0]
    off = F.when(F.col("column") == "sales", F.abs(F.lit(below) - 0.5) <= 0.01).otherwise(True)
    # texts have no moments: 0 here
    return tidy(found.join(exact, "column").select(
        "column", "row_count", "null_count", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min", "max", "mean", "std")],
        (F.abs(F.col("unique_count") - F.col("exact")) <= 0.02 * F.col("exact")).alias("unique_close"), off.alias("median_close")), 4)


def _mark_outliers(s: SparkSession, d: str) -> DataFrame:
    marked = L.mark_outliers(skewed_items(s, d), ["cubed", "l_quantity"])
    return tidy(marked.groupBy("cubed_outlier", "l_quantity_outlier").agg(
        F.count("*").alias("rows"), F.max("cubed").alias("max_cubed"), F.min("cubed").alias("min_cubed")))


def _mark_duplicates(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return L.mark_duplicates(o)


def _insights(s: SparkSession, d: str) -> DataFrame:
    items = items_with_regions(s, d)
    found = L.insights({
        "overview": L.desc_overview(table(s, d, "orders")),
        "monthly": L.monthly_series(orders(s, d), "o_orderdate", "amount"),
        "concentration": L.concentration(items, "r_name", "amount"),
        "quality": L.quality_score(orders_with_gaps(s, d), GAP_ROLES),
        "pareto": L.pareto_summary(items, "p_brand", "amount"),
    })
    return found.select("id", "severity", "title")


SUITE_ROLES = {"order_date": "date", "sales": "revenue", "category": "product_name", "note": "region",
               "o_custkey": "customer_id"}


def _report_suite(s: SparkSession, d: str) -> DataFrame:
    """Values of the report's tables as (analysis, label, value)."""
    report = L.report_suite(orders_with_gaps(s, d), SUITE_ROLES)
    shown = {
        "desc_overview": ("'row_count'", "row_count"), "desc_stats": ("`column`", "count"), "time_series": ("'total'", "total"),
        "monthly": ("period", "total"), "growth": ("period", "growth"), "forecast_fitted": ("period", "total"),
        "yoy_comparison": ("'comparable_periods'", "comparable_periods"), "top_ranking": ("side || rank || item", "total"),
        "concentration": ("'cr5'", "cr5"), "pareto_abc": ("abc_class", "revenue_share"),
        "anomaly_detect": ("`column`", "outlier_count"), "anomaly_summary": ("worst_column", "total_anomalies"),
        "region_analysis": ("region", "total"), "region_extremes": ("top_region || bottom_region", "total"),
        "drill_down": ("category || '/' || note", "total"), "rfm_analysis": ("segment", "customers"),
        "rfm_overview": ("'customers'", "total_customers"), "simple_forecast": ("'periods'", "periods"),
        "distribution": ("`column`", "n"), "columns": ("`column`", "null_count"), "roles": ("`column` || role", "confidence"),
        "quality": ("'row_count'", "row_count"),
    }
    out = None
    for name, (label, value) in shown.items():
        rows = report[name].select(
            F.lit(name).alias("analysis"), F.expr(label).cast("string").alias("label"), F.round(F.col(value).cast("double"), 2).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter("value IS NOT NULL")


def _slim(s: SparkSession, d: str) -> DataFrame:
    report = L.report_suite(orders_with_gaps(s, d), SUITE_ROLES)
    return tidy(L.slim({"pareto_abc": report["pareto_abc"], "desc_stats": report["desc_stats"]})["pareto_abc"])


def _read_delimited(s: SparkSession, d: str) -> DataFrame:
    path = work_path(s, "delimited")
    table(s, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.option(
        "header", True).option("sep", "|").csv(path)
    back = L.validate_input(L.read_delimited(s, path, sep="|"))
    return tidy(back.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("orders"), F.sum(money("o_totalprice")).cast("double").alias("total"),
        F.max("o_orderdate").alias("last_date"), F.sum("o_custkey").alias("custkeys")))


def _read_delimited_breaks(s: SparkSession, d: str) -> DataFrame:
    """Whole texts of documents, with their commas, quotes and line breaks, written as delimited text and read back in splits."""
    path = work_path(s, "delimited")
    quoted = F.concat(F.lit('"'), F.col("lang"), F.lit('", '), F.col("text"))
    table(s, d, "documents").select("doc_id", quoted.alias("text"), "source").write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = L.read_delimited(s, path, multiline=True)
    return back.select("doc_id", F.length("text").cast("long").alias("length"), F.md5("text").alias("text_md5"), "source")


def _kinds_of_files(s: SparkSession, d: str, line: Column, name: str) -> str:
    """A folder of text files, of another kind in each subfolder kind=0 to 3."""
    path = work_path(s, name)
    table(s, d, "documents").select((F.col("doc_id") % 4).alias("kind"), line.alias("value")).write.partitionBy("kind").text(path)
    return path


def _in_kind(name: str) -> Column:
    return F.regexp_extract("path", "kind=([0-3])/", 1).cast("long").alias(name)


def _detect_delimiter(s: SparkSession, d: str) -> DataFrame:
    sep = F.element_at(F.array(*[F.lit(x) for x in (",", "\t", ";", "|")]), (F.col("doc_id") % 4 + 1).cast("int"))
    line = F.concat("doc_id", sep, "lang", sep, "source", sep, F.translate(F.col("text"), ",;|\t\n\r\u000b\u000c\u0085", ""))
    found = L.detect_delimiter(s, _kinds_of_files(s, d, line, "separators"))
    return found.select(_in_kind("kind"), "delimiter", "score").distinct()


def _file_magic_audit(s: SparkSession, d: str) -> DataFrame:
    start = F.element_at(F.array(*[F.lit(x) for x in ("", "%PDF-1.7", "MZ", "PK\x03\x04")]), (F.col("doc_id") % 4 + 1).cast("int"))
    found = L.file_magic_audit(s, _kinds_of_files(s, d, F.concat(start, F.translate(F.col("text"), "\n\r", "  ")), "magic"))
    return found.filter(F.col("path").endswith(".txt")).select(_in_kind("kind_no"), "kind", "accepted").distinct()


def _detect_encoding(s: SparkSession, d: str) -> DataFrame:
    path = work_path(s, "encodings")
    table(s, d, "documents").select("text").write.text(path)
    return L.detect_encoding(s, path).filter(F.col("path").endswith(".txt")).select("encoding").distinct()


WRITTEN = {"utf-8": "UTF-8", "iso8859-1": "ISO-8859-1", "utf-16-le": "UTF-16LE"}


def _detect_encoding_model(s: SparkSession, d: str) -> DataFrame:
    """Documents beyond ASCII written in three charsets, told apart by a model of the other half of the documents."""
    docs = table(s, d, "documents").filter(F.col("text").rlike(r"[^\x00-\x7F]") & ~F.col("text").rlike(r"[^\x00-\xFF]"))
    path = work_path(s, "charsets")
    for name, charset in WRITTEN.items():
        even = docs.filter("doc_id % 2 = 0").select((F.col("doc_id") % 16).alias("bucket"), F.col("text").alias("value"))
        even.write.option("encoding", charset).partitionBy("bucket").csv(f"{path}/written={name}")
    model = settle(L.fit_charsets(docs.filter("doc_id % 2 = 1"), charsets=(*WRITTEN, "cp850", "mac_roman", "gbk", "shift_jis")))
    of = lambda key: F.regexp_extract("path", f"{key}=([^/]*)/", 1)
    return L.detect_encoding(s, path, model).select(of("written").alias("written"), of("bucket").cast("long").alias("bucket"), "encoding").distinct()


def _logged(s: SparkSession, d: str) -> str:
    path = work_path(s, "usage")
    L.append_usage_log(usage_log(s, d).drop("cost_usd"), path)
    return path


def _read_usage_log(s: SparkSession, d: str) -> DataFrame:
    log = L.read_usage_log(s, _logged(s, d), tenant="tenant_1", days=10, as_of="2024-01-30")
    return tidy(log.groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("token_input").alias("tokens"),
                                           F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost")), 6)


def _append_usage_log(s: SparkSession, d: str) -> DataFrame:
    path = work_path(s, "usage")
    L.append_usage_log(usage_log(s, d).drop("cost_usd"), path, format="parquet")
    log = L.read_usage_log(s, path, format="parquet", tenant="tenant_2", month="2024-01")
    return tidy(log.groupBy("tenant_id", "model").agg(
        F.count("*").alias("calls"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost")), 6)


def _scattered_log(s: SparkSession, d: str) -> str:
    """The log in several files, each with records of all days."""
    path = work_path(s, "usage")
    log = usage_log(s, d).drop("cost_usd")
    L.append_usage_log(log.repartition(6, F.xxhash64(*log.columns)), path)
    return path


def _stream_daily(s: SparkSession, d: str) -> DataFrame:
    daily = L.stream_usage_daily(L.stream_usage_log(s, _scattered_log(s, d), max_files=6))
    return tidy(drain_update(daily, "stream-daily", ["tenant_id", "date"]))


def _mixed_log(s: SparkSession, d: str) -> str:
    """The log in six appends, a fifth of each one's time span mixed with the next; then one record of a day later that ends it."""
    path = work_path(s, "usage")
    log = usage_log(s, d).drop("cost_usd")
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    low, high = log.agg(F.min(us), F.max(us)).first()
    part = F.floor((us - low) * 6 / F.lit(high - low + 1) + F.pmod(F.xxhash64("user_id", "token_input"), F.lit(5)) / 25)
    for k in range(7):
        L.append_usage_log(log.filter(part == k), path)
    last = log.filter(us == high).limit(1).withColumn("tenant_id", F.lit("end"))
    L.append_usage_log(last.withColumn("timestamp", F.date_format(F.timestamp_micros(F.lit(high) + F.lit(20 * 86_400_000_000)), "yyyy-MM-dd'T'HH:mm:ss")), path)
    return path


def _stream_rate(s: SparkSession, d: str) -> DataFrame:
    stream = L.stream_usage_log(s, _mixed_log(s, d), max_files=6)
    verdicts = drain_append(L.stream_rate_limit(stream, burst=2, window_seconds=600, watermark="15 days"), "stream-rate")
    return verdicts.groupBy("tenant_id", "admitted").agg(F.count("*").alias("calls"))


def catalog() -> dict[str, Query]:
    d, m = "o_orderdate", "amount"
    return {
        # series
        "monthly_series": _of_orders(L.monthly_series, d, m),
        "monthly_series_by_customer": _of_orders(L.monthly_series, d, m, by=["o_custkey"]),
        "mom_growth": _of_orders(L.mom_growth, d, m),
        "moving_avg_3": _of_orders(L.moving_avg_3, d, m),
        "inflection_points": _of_orders(L.inflection_points, d, m),
        "time_series": _of_orders(L.time_series, d, m),
        "time_series_by_status": _of_orders(L.time_series, d, m, by=["o_orderstatus"]),
        "annual_summary": _of_orders(L.annual_summary, d, m),
        "yoy_comparison": _of_orders(L.yoy_comparison, d, m),
        "yoy_summary": _of_orders(L.yoy_summary, d, m),
        "simple_forecast": _of_orders(L.simple_forecast, d, m, digits=2),
        "simple_forecast_by_priority": _of_orders(L.simple_forecast, d, m, by=["o_orderpriority"], digits=2),
        "forecast_fitted": _of_orders(L.forecast_fitted, d, m, digits=2),
        "date_range_filter": lambda s, p: tidy(_facts_year(s, p).select("o_orderkey", "o_orderdate", "o_totalprice")),
        "coerce_date": lambda s, p: tidy(
            L.coerce_date(orders_with_gaps(s, p), "order_date").select("o_orderkey", "order_date")),
        "drop_null_keys": _of_gaps(lambda g: L.drop_null_keys(g, ["sales", "category"])),
        # rankings and groups
        "top_ranking": _of_items(L.top_ranking, "l_partkey", "amount"),
        "top_ranking_brand": _of_items(L.top_ranking, "p_brand", "amount"),
        "concentration": _of_items(L.concentration, "p_brand", "amount", digits=6),
        "concentration_parts": _of_items(L.concentration, "l_partkey", "amount", digits=6),
        "pareto_abc": _of_items(L.pareto_abc, "l_partkey", "amount", digits=8),
        "pareto_summary": _of_items(L.pareto_summary, "p_brand", "amount", digits=6),
        "region_analysis": _of_items(L.region_analysis, "r_name", "amount"),
        "region_extremes": _of_items(L.region_extremes, "r_name", "amount"),
        "drill_down": _of_items(L.drill_down, ["p_brand", "r_name"], "amount", digits=6),
        "drill_down_cube": lambda s, p: _of_items(L.drill_down_cube, ["p_brand", "r_name"], "amount", digits=6)(s, p).fillna("(all)", ["p_brand", "r_name"]),
        "drill_down_top": _of_items(L.drill_down_top, ["p_brand", "r_name"], "amount", digits=6),
        # customers
        "rfm_values": lambda s, p: tidy(L.rfm_values(orders(s, p), "o_custkey", d, m).withColumn(
            "monetary", F.col("monetary").cast("double"))),
        "rfm_scores": _of_orders(L.rfm_scores, "o_custkey", d, m),
        "rfm_segments": lambda s, p: L.rfm_segments(orders(s, p), "o_custkey", d, m).select("customer", "segment"),
        "rfm_summary": _of_orders(L.rfm_summary, "o_custkey", d, m),
        "rfm_overview": _of_orders(L.rfm_overview, "o_custkey", d, m),
        # statistics
        "anomaly_detect": _of_stats(L.anomaly_detect, STAT_COLUMNS, digits=6),
        "anomaly_summary": _of_stats(L.anomaly_summary, STAT_COLUMNS),
        "anderson_darling": _of_stats(L.anderson_darling, [*STAT_COLUMNS, "constant"], digits=3),
        "corr_pearson": _of_stats(L.corr_pearson, [*STAT_COLUMNS, "constant"], digits=6),
        "corr_spearman": _of_stats(L.corr_spearman, STAT_COLUMNS, digits=6),
        "corr_p_values": _of_stats(L.corr_p_values, STAT_COLUMNS, digits=5),
        "strong_pairs": _of_stats(L.strong_pairs, STAT_COLUMNS, digits=6),
        "redundant_pairs": _of_stats(L.redundant_pairs, STAT_COLUMNS, digits=6),
        "distribution": _of_stats(L.distribution, STAT_COLUMNS),
        "normality_test": _of_stats(lambda x: L.normality_test(x, STAT_COLUMNS).withColumn("jb", F.round("jb", 1))),
        # profiles
        "profile_columns": _of_gaps(L.profile_columns),
        "stored_profile": _stored_profile,
        "profile_numeric": _of_gaps(L.profile_numeric),
        "profile_dates": lambda s, p: tidy(L.profile_dates(
            orders_with_gaps(s, p).select("order_date", "note")
            .withColumn("ordered_at", F.try_to_timestamp("order_date")))),
        "profile_text": _profile_text,
        "desc_overview": _of_gaps(L.desc_overview),
        "desc_stats": lambda s, p: tidy(L.desc_stats(table(s, p, "lineitem"))),
        "sample_rows": lambda s, p: tidy(L.sample_rows(
            table(s, p, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 3, ["o_orderkey"])),
        "sample_values": lambda s, p: L.sample_values(orders_with_gaps(s, p), "category", 5, ["o_orderkey"]),
        "quick_summary": _quick_summary,
        "quick_summary_samples": lambda s, p: L.quick_summary(orders_with_gaps(s, p), GAP_ROLES, order_by=["-o_orderkey"]).select(
            "row_count", F.inline(F.arrays_zip(F.array(F.lit(1), F.lit(2), F.lit(3)).alias("place"), "sample_rows"))).select(
                "row_count", "place", F.get_json_object("sample_rows", "$.o_orderkey").cast("long").alias("o_orderkey"),
                F.get_json_object("sample_rows", "$.order_date").alias("order_date"), F.get_json_object("sample_rows", "$.category").alias("category")),
        "infer_roles": _infer_roles,
        "role_ambiguity": _role_ambiguity,
        # cleaning
        "find_duplicates": lambda s, p: L.find_duplicates(
            table(s, p, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")),
        "mark_duplicates": _mark_duplicates,
        "fill_median": _of_gaps(lambda g: L.fill_median(g, ["sales"]).select("o_orderkey", "sales")),
        "fill_mode": _of_gaps(lambda g: L.fill_mode(g, ["category"]).select("o_orderkey", "category")),
        "mark_outliers": _mark_outliers,
        "clean": _of_gaps(lambda g: L.clean(g, GAP_ROLES)),
        "cleaning_log": _of_gaps(L.cleaning_log, GAP_ROLES, unparsed=True),
        "unparsed_dates": _of_gaps(L.unparsed_dates, GAP_ROLES),
        "quality_score": _of_gaps(L.quality_score, GAP_ROLES),
        # reports
        "insights": _insights,
        "monthly_facts": lambda s, p: tidy(L.monthly_facts(orders(s, p), d, m)),
        "region_facts": _of_items(L.region_facts, "r_name", "amount"),
        "report_suite": _report_suite,
        "slim": _slim,
        # usage log and tenants
        "usage_cost": lambda s, p: tidy(usage_log(s, p).groupBy("model").agg(
            F.count("*").alias("calls"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost"),
            F.max("cost_usd").alias("max_cost")), 5),
        "usage_daily": _of_log(L.usage_daily),
        "usage_daily_by_depth": _of_log(L.usage_daily_by, "depth"),
        "usage_daily_by_user": _of_log(L.usage_daily_by, "user_name"),
        "usage_top_expensive": lambda s, p: tidy(L.usage_top_expensive(usage_log(s, p)).select(
            "tenant_id", "date", "rank", "user_id", "cost_usd"), 6),
        "usage_monthly": _of_log(L.usage_monthly),
        "usage_calls_per_day": _of_log(L.usage_calls_per_day),
        "usage_user_stats": _of_log(L.usage_user_stats, 7, "2024-01-30"),
        "usage_user_breakdown": _of_log(L.usage_user_breakdown, 7, "2024-01-30"),
        "budget_alert": lambda s, p: tidy(L.budget_alert(usage_log(s, p), budgets(s, p))),
        "member_usage": lambda s, p: tidy(L.member_usage(usage_log(s, p), members(s, p), budgets(s, p), "2024-01-15")),
        "depth_violations": lambda s, p: L.depth_violations(usage_log(s, p), members(s, p)),
        "quota_violations": lambda s, p: L.quota_violations(
            usage_log(s, p), members(s, p), ("timestamp", "token_input", "token_output")).select(
            "tenant_id", "user_id", "date", "timestamp", "call_no", "daily_limit"),
        "rate_refusals": lambda s, p: tidy(L.rate_refusals(usage_log(s, p), burst=3, window_seconds=900)),
        "rate_violations": lambda s, p: tidy(L.rate_violations(usage_log(s, p), burst=3, window_seconds=900)),
        "read_usage_log": _read_usage_log,
        "append_usage_log": _append_usage_log,
        # files and streams
        "read_delimited": _read_delimited,
        "read_delimited_breaks": _read_delimited_breaks,
        "detect_delimiter_text": lambda s, p: tidy(
            L.detect_delimiter_text(table(s, p, "documents").select("doc_id", "text"), "doc_id", "text"), 6),
        "detect_delimiter": _detect_delimiter,
        "file_magic_audit": _file_magic_audit,
        "detect_encoding": _detect_encoding,
        "detect_encoding_model": _detect_encoding_model,
        "stream_usage_daily": _stream_daily,
        "stream_rate_limit": _stream_rate,
    }
